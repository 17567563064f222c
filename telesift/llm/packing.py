"""Best-fit packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telesift.llm.common import bounded_batches, pick

VOCABULARY = "byte_bpe_50k"
END_ID = 0
ADDED = {"<|endoftext|>": 50256}  # the json file's one added token, found in texts too
PIECES = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


@cache
def encoder(vocabulary: str = VOCABULARY):
    """The public byte-level vocabulary. Its rank file and ADDED give the ids of its json file, several times as fast (the tests compare them)."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)


def text_ids(text: str, vocabulary: str = VOCABULARY) -> list[int]:
    """The ids of a text, as the json file's tokenizer gives them without adding special tokens."""
    if any(a in text for a in ADDED):
        return encoder(vocabulary).encode(text, allowed_special="all")
    return encoder(vocabulary).encode_ordinary(text)


class OpenBins:
    """A fixed number of open sequences, found by free space through a bitset.

    Bit f of `free` is set while some open sequence has f places left. A piece goes where it fits
    best; if none fits, a new sequence opens, and if too many are open the fullest closes first.
    """

    def __init__(self, size: int, most: int, first_id: int):
        self.size, self.most, self.next_id = size, most, first_id
        self.free, self.open, self.at = 0, 0, [[] for _ in range(size + 1)]

    def _take(self, space: int) -> int:
        bins = self.at[space]
        found = bins.pop()
        if not bins:
            self.free &= ~(1 << space)
        self.open -= 1
        return found

    def put(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of this length."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            sequence = self._take(space)
        else:
            space, sequence = self.size, self.next_id
            self.next_id += 1
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)
        left = space - length
        if left:
            self.at[left].append(sequence)
            self.free |= 1 << left
            self.open += 1
        return sequence, self.size - space


def pack_documents(docs: DataFrame, size: int = 2048, open_bins: int = 1024, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of all documents (doc_id, text) with their place: (doc_id, piece, start, length, ids, sequence_id, offset).

    ids are little-endian unsigned 32-bit: the document's tokens and one end id 0. A document of more
    than `size` ids is cut so that its first piece is the shorter one. Every scan partition fills its
    own sequences (numbers: partition, then count), so nothing is shuffled and a lost task gives the
    same rows again. Null or empty text is one end id; repeated doc_ids are packed as often as they
    occur; a null doc_id is kept; other columns are not read; an empty table gives no rows.
    """

    def pack(batches):
        bins = OpenBins(size, open_bins, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part, rows = batch.slice(lo, 512), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = text_ids(text, vocabulary) if text else []
                    ids.append(END_ID)
                    raw, n = np.array(ids, dtype="<u4").tobytes(), len(ids)
                    for piece, end in enumerate(range(n % size or min(n, size), n + 1, size)):
                        start = max(0, end - size)
                        rows.append((doc_id, piece, start, end - start, raw[4 * start : 4 * end]))
                rows.sort(key=lambda row: -row[3])  # the longest first among those at hand
                out = list(zip(*(row + bins.put(row[3]) for row in rows), strict=True))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    return bounded_batches(pick(docs, {"doc_id": "long", "text": "string"})).mapInArrow(pack, PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves, each at most the packing size long."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b"").cast("binary"), lambda whole, x: F.concat(whole, x["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def packing_digest(docs: DataFrame) -> DataFrame:
    return pack_documents(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
