"""Alignment of the tokens of two tokenizers by a dictionary of groups."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telesift.llm.bpe import TOGETHER, VOCABULARY, Interned, Ragged, kept_encoder, vocabulary
from telesift.llm.common import bounded_batches, pick, written

PIECES = "piece_bpe_32k"
SPACE = "▁"
# a block of documents shares a dictionary of groups; it ends with the document that passes one of these
BLOCK_GROUPS, BLOCK_ENTRIES, BLOCK_SEGMENTS = 200_000, 2_000_000, 600_000
DOCUMENT, GROUP, PAIR = 0, 1, 2
NOTES = "kind int, block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups binary, times binary, number int, key string, a int, b int, n long"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Pieces:
    """A sentencepiece model, the bytes of its pieces, and ids of segments."""

    def __init__(self, name: str):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{name}.model"))
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # segments begin with spaces behind a letter: no piece may reach over such a place
        if any(SPACE in n.lstrip(SPACE) for n in names):
            raise ValueError(f"{name} has pieces with a space behind a letter")
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        self.sizes = np.array(list(map(len, self.bytes)), np.int64)
        self.alone = [self.model.piece_to_id(SPACE)]


@cache
def pieces(name: str) -> Pieces:
    return Pieces(name)


@cache
def sizes(name: str) -> np.ndarray:
    known = vocabulary(name).bytes
    out = np.zeros(max(known) + 1, np.int64)
    out[list(known)] = [len(b) for b in known.values()]
    return out


def shared_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, group of each A token, group of each B token) from the tokens' sizes: where both have an end, a group ends."""
    a, b = np.cumsum(a), np.cumsum(b)
    ends = np.intersect1d(a, b, assume_unique=True)
    return ends, np.searchsorted(ends, a), np.searchsorted(ends, b)


def expand(keys: list[str], a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, a, b) for each link of each group: the pieces between neighbouring ends of either kind lie in one A and one B token."""
    sides = [[np.fromiter(map(int, side.split(",")), np.int64) for side in key.split("|")] for key in keys]
    if not sides:
        none = np.empty(0, np.int64)
        return none, none, none
    a, b = (np.concatenate([side[i] for side in sides]) for i in (0, 1))
    a_end, b_end = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    group_end = a_end[np.cumsum([len(side[0]) for side in sides]) - 1]
    ends = np.union1d(a_end, b_end)
    return np.searchsorted(group_end, ends), a[np.searchsorted(a_end, ends)], b[np.searchsorted(b_end, ends)]


class Block:
    """Groups, links and documents of one block, by numbers of its own."""

    def __init__(self, vocab: str, model: str):
        self.encoder, self.pieces = kept_encoder(vocab), pieces(model)
        self.a_size, self.b_size = sizes(vocab), self.pieces.sizes
        self.begin()

    def begin(self) -> None:
        self.segments, self.of_segment, self.written_as, self.faulty = Interned(), Ragged(), [], Ragged(bool)
        self.groups, self.links, self.pairs = Interned(), Ragged(), Interned()
        self.width, self.in_documents = Ragged(), np.zeros(0, np.int64)
        self.keys, self.rows, self.entries = [], [], 0
        self.held, self.size = [], 0

    def learn(self) -> None:
        """Groups of the segments that are new, links of the groups that are new."""
        fresh = self.segments.take_fresh()
        if not fresh:
            return
        whole = [" " + s for s in fresh]
        a, a_count = self.encoder.encode_segments(whole)
        if len(self.encoder.words) > BLOCK_SEGMENTS:
            self.encoder.forget()
        # the model puts the space in front of what it gets, but not of an empty string: a space at a text's end
        told = [ids or self.pieces.alone for ids in self.pieces.model.encode(fresh, num_threads=1)]
        known = self.pieces.bytes
        good = np.array([b"".join([known[i] for i in ids]) == s.encode() for ids, s in zip(told, whole, strict=True)], bool)
        b = np.fromiter((i for ids, fine in zip(told, good, strict=True) if fine for i in ids), np.int64)
        a = a[np.repeat(good, a_count)].astype(np.int64)
        # segments end with a token on both sides, so groups never reach over them
        _, in_a, in_b = shared_ends(self.a_size[a], self.b_size[b])
        count = int(in_a[-1]) + 1 if len(in_a) else 0
        a_at, b_at = (np.searchsorted(side, np.arange(count + 1)) for side in (in_a, in_b))
        # most groups are one token a side and go by one number, the others by all their ids
        keys = ((a[a_at[:-1]] << 32) | b[b_at[:-1]]).tolist()
        a_ids, b_ids = a.tolist(), b.tolist()
        for g in np.flatnonzero((np.diff(a_at) > 1) | (np.diff(b_at) > 1)).tolist():
            keys[g] = (*a_ids[a_at[g] : a_at[g + 1]], -1, *b_ids[b_at[g] : b_at[g + 1]])
        numbers = self.groups.numbers(keys, count)
        last = np.cumsum(a_count[good])
        per_good = np.diff(in_a[last - 1] + 1, prepend=0) if len(last) else last
        per = np.zeros(len(fresh), np.int64)
        per[good] = per_good
        self.of_segment.extend(numbers, per)
        self.faulty.extend(~good, np.ones(len(good), np.int64))
        new = [f"{k >> 32}|{k & 0xFFFFFFFF}" if isinstance(k, int) else ",".join(map(str, k)).replace(",-1,", "|") for k in self.groups.take_fresh()]
        self.keys += new
        names, ends = list(map(self.keys.__getitem__, numbers.tolist())), np.cumsum(per).tolist()
        self.written_as += [";".join(names[end - n : end]) for n, end in zip(per.tolist(), ends, strict=True)]
        if new:
            group, x, y = expand(new, self.a_size, self.b_size)
            of = self.pairs.numbers(((x << 32) | y).tolist(), len(x))
            self.links.extend(of, np.bincount(group, minlength=len(new)))
            self.width.extend(np.array([[key.partition("|")[0].count(",") + 1, key.partition("|")[2].count(",") + 1] for key in new]).ravel(), np.full(len(new), 2))
        self.pairs.take_fresh()

    def add(self, doc_id: int | None, text: str) -> None:
        """Split one document into segments; many are settled together."""
        numbers = None
        if text and SPACE not in text:
            # the space in front makes every segment one behind a cut
            parts = (self.encoder.parts(window)[1:] for window in self.encoder.windows(" " + text))
            numbers = [self.segments.numbers(p, len(p)) for p in parts]
        self.held.append((doc_id, numbers))
        self.size += len(text)
        if self.size >= TOGETHER:
            self.settle()

    def settle(self) -> None:
        self.learn()
        for doc_id, numbers in self.held:
            self.count(doc_id, np.concatenate(numbers) if numbers else None)
        self.held, self.size = [], 0

    def count(self, doc_id: int | None, segments: np.ndarray | None) -> None:
        """One document: its groups as numbers of the block with how often each occurs, and a document more for each pair that it links."""
        if segments is None or self.faulty.gather(segments)[0].any():
            self.rows.append((doc_id, 0, 0, 0, "", b"", b""))
            return
        digest = hashlib.sha256()
        for lo in range(0, len(segments), 1 << 16):
            digest.update(b";" * (lo > 0) + ";".join([self.written_as[i] for i in segments[lo : lo + (1 << 16)].tolist()]).encode())
        groups, times = np.unique(self.of_segment.gather(segments)[0], return_counts=True)
        n_a, n_b = (self.width.gather(groups)[0].reshape(-1, 2) * times[:, None]).sum(axis=0).tolist()
        pairs = np.unique(self.links.gather(groups)[0])
        if len(self.in_documents) < len(self.pairs):
            self.in_documents = np.concatenate([self.in_documents, np.zeros(2 * len(self.pairs) - len(self.in_documents), np.int64)])
        self.in_documents[pairs] += 1
        self.entries += len(groups)
        self.rows.append((doc_id, n_a, n_b, int(times.sum()), digest.hexdigest(), groups.astype("<i4").tobytes(), times.astype("<i4").tobytes()))

    def full(self) -> bool:
        return len(self.keys) >= BLOCK_GROUPS or self.entries >= BLOCK_ENTRIES or len(self.rows) >= BLOCK_ENTRIES or len(self.segments) >= BLOCK_SEGMENTS

    def notes(self, block: int):
        """The block's rows: documents, the dictionary of its groups, and documents a pair."""
        self.settle()
        schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), *[(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups")], ("groups_sha256", pa.string()), ("groups", pa.binary()), ("times", pa.binary()), ("number", pa.int32()), ("key", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])

        def batch(kind: int, columns: dict, n: int) -> pa.RecordBatch:
            given = {"kind": np.full(n, kind, np.int32), "block": np.full(n, block, np.int64)} | columns
            return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)

        names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "times"]
        for lo in range(0, len(self.rows), 1024):
            rows = self.rows[lo : lo + 1024]
            yield batch(DOCUMENT, dict(zip(names, zip(*rows, strict=True), strict=True)), len(rows))
        for lo in range(0, len(self.keys), 65_536):
            keys = self.keys[lo : lo + 65_536]
            yield batch(GROUP, {"number": np.arange(lo, lo + len(keys), dtype=np.int32), "key": keys}, len(keys))
        pairs = np.fromiter(self.pairs, np.int64, len(self.pairs))
        counts = np.zeros(len(pairs), np.int64)
        counts[: len(self.in_documents)] = self.in_documents[: len(pairs)]
        for at in np.array_split(np.flatnonzero(counts), -(-len(pairs) // 65_536) or 1):
            yield batch(PAIR, {"a": (pairs[at] >> 32).astype(np.int32), "b": (pairs[at] & 0xFFFFFFFF).astype(np.int32), "n": counts[at]}, len(at))


def take_notes(docs: DataFrame, vocab: str = VOCABULARY, model: str = PIECES) -> DataFrame:
    """One pass over the texts: for each block of documents its documents, groups and pair counts (see NOTES), written."""

    def run(batches):
        block, done = Block(vocab, model), 0
        number = lambda: (TaskContext.get().partitionId() << 24) + done
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    block.add(doc_id, text or "")
                    if block.full():
                        yield from block.notes(number())
                        block.begin()
                        done += 1
        yield from block.notes(number())

    return written(bounded_batches(pick(docs, {"doc_id": "long", "text": "string"})).mapInArrow(run, NOTES))


def pair_counts(notes: DataFrame) -> DataFrame:
    """(a, b, n, best): how many documents hold a and b linked, and whether no b has more with this a. Blocks have counted beforehand."""
    pairs = notes.filter(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("n").alias("n"))
    most = pairs.groupBy("a").agg(F.max("n").alias("most"))  # a row an id of the vocabulary at most
    return pairs.join(F.broadcast(most), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def group_links(keys: DataFrame, vocab: str = VOCABULARY, model: str = PIECES) -> DataFrame:
    """(key, a, b, m): the links of each distinct group, equal ones counted."""

    def run(batches):
        a_size, b_size = sizes(vocab), pieces(model).sizes
        for batch in batches:
            names = batch.column(0).to_pylist()
            group, a, b = expand(names, a_size, b_size)
            links, m = np.unique(np.stack([group, a, b]), axis=1, return_counts=True)
            columns = [pa.array([names[g] for g in links[0].tolist()], pa.string()), pa.array(links[1].astype(np.int32)), pa.array(links[2].astype(np.int32)), pa.array(m.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "a", "b", "m"])

    return keys.select("key").mapInArrow(run, "key string, a int, b int, m long")


def _sums(documents: pa.Table, groups: pa.Table) -> pa.Table:
    """A block's documents with the sums over their groups. Groups that came up only beside a fault have no sums and no document."""
    number = groups.column("number").to_numpy()
    value = {c: np.zeros(number.max(initial=-1) + 1, np.int64) for c in ("n_links", "n_best", "count_sum")}
    for c, v in value.items():
        v[number] = groups.column(c).to_numpy()
    out = {c: [] for c in value}
    for at, times in zip(documents.column("groups").to_pylist(), documents.column("times").to_pylist(), strict=True):
        at, times = np.frombuffer(at, "<i4"), np.frombuffer(times, "<i4")
        for c, v in value.items():
            out[c].append(int((v[at] * times).sum()) if len(at) else 0)
    kept = {c: documents.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")}
    columns = kept | {c: pa.array(v, pa.int64()) for c, v in out.items()}
    names = [c.split(" ")[0] for c in RESULT.split(", ")]
    return pa.table({c: columns[c] for c in names})


def align_documents(docs: DataFrame, vocab: str = VOCABULARY, model: str = PIECES) -> tuple[DataFrame, DataFrame]:
    """Documents (see RESULT) and the corpus's id pairs (a, b, n, best), for all documents (doc_id, text).

    Space and text are encoded by A (a byte-level json file, its added tokens being plain text), the text by B (a
    sentencepiece model, which adds the space). Byte offsets where tokens of both end cut them into groups; tokens of a group whose
    bytes overlap are linked. A pair's n is the number of rows of docs that hold it linked. Groups are interned: a
    block of documents writes each of its distinct groups once, with documents as numbers and frequencies; links are expanded
    once for each distinct group of the corpus, joined with the pairs' counts and summed up by group; these sums go back to the
    blocks by group key, and a block's documents add them up by frequency. A frequent group has a row a block, not a row a document.

    Texts that are null, empty, or whose tokens do not give back space and text (U+2581 does so) have no tokens: zeros and ''.
    Rows that repeat a doc_id, or have none, are documents of their own; ties for the best count all; an empty table gives no rows.
    """
    notes = take_notes(docs, vocab, model)
    pairs = written(pair_counts(notes))
    groups = notes.filter(F.col("kind") == GROUP).select("block", "number", "key")
    links = group_links(groups.select("key").distinct(), vocab, model).join(pairs, ["a", "b"])
    sums = links.groupBy("key").agg(F.sum("m").alias("n_links"), F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum"))
    valued = groups.join(sums, "key").drop("key")
    documents = notes.filter(F.col("kind") == DOCUMENT).select(F.col("block").alias("home"), "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "times")
    return documents.groupBy("home").cogroup(valued.groupBy("block")).applyInArrow(_sums, RESULT), pairs


def alignment_digest(docs: DataFrame) -> DataFrame:
    return align_documents(docs)[0]
