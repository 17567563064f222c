"""Byte-pair encoding of texts by a pair occurrence index, and decoding."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telesift.llm.common import bounded_batches, pick

VOCABULARY = "byte_bpe_50k"
WINDOW = 1 << 20  # characters split at a time
TOGETHER = 1 << 23  # characters of texts whose new words are merged together
REMEMBERED = 1 << 22  # characters of segments whose ids a task keeps; past that it starts anew, to the same ids
SHIFT = 32
# white space in any sense: a superset of the tokenizer's own may only lengthen segments
BLANK = r"[\s\x1c-\x1f\x85]"


class Interned(dict):
    """Numbers 0, 1, ... for keys in order of first use; those not yet dealt with are in `fresh`."""

    def __init__(self):
        super().__init__()
        self.fresh = []

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        self.fresh.append(key)
        return number

    def numbers(self, keys: Iterable, count: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, count)

    def take_fresh(self) -> list:
        fresh, self.fresh = self.fresh, []
        return fresh


class Ragged:
    """Rows of different lengths in one array that grows by doubling."""

    def __init__(self, kind=np.int32):
        self.flat, self.ends, self.rows, self.size = np.empty(1024, kind), np.zeros(1024, np.int64), 0, 0

    def extend(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        size, rows = self.size + len(flat), self.rows + len(lengths)
        if size > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.size], np.empty(2 * size - self.size, self.flat.dtype)])
        if rows >= len(self.ends):
            self.ends = np.concatenate([self.ends[: self.rows + 1], np.zeros(2 * rows - self.rows, np.int64)])
        self.flat[self.size : size] = flat
        self.ends[self.rows + 1 : rows + 1] = self.size + np.cumsum(lengths)
        self.size, self.rows = size, rows

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of these rows one after another, and each row's length."""
        begin = self.ends[rows]
        lengths = self.ends[rows + 1] - begin
        stop = np.cumsum(lengths)
        at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - (stop - lengths), lengths)
        return self.flat[at], lengths


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Merges, bytes and added tokens of a byte-level json file."""

    def __init__(self, name: str):
        import public_tokenizers
        import regex

        with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
            told = json.load(f)
        ids, merges = told["model"]["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in told["model"]["merges"]]
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        characters = byte_characters()
        back = {c: b for b, c in characters.items()}
        plain = lambda token: bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.bytes = {i: plain(token) for token, i in {**ids, **self.added}.items()}
        self.single = np.array([ids[characters[b]] for b in range(256)], np.int64)
        self.parts = [(ids[a], ids[b], ids[a + b]) for a, b in merges]
        made = {}
        for rank, (a, b, whole) in enumerate(self.parts):
            # the index takes ranks in ascending order: a merge may use only what earlier ones have made
            if max(made.get(a, -1), made.get(b, -1)) >= rank:
                raise ValueError(f"merge {rank} of {name} uses a later one")
            made.setdefault(whole, rank)
        rank = {(a << SHIFT) | b: r for r, (a, b, _) in reversed(list(enumerate(self.parts)))}
        # (pair, rank) by pair; the last one is no pair
        told = np.array([*sorted(rank.items()), (np.iinfo(np.int64).max, -1)], np.int64)
        self.keys, self.ranks = np.ascontiguousarray(told[:, 0]), np.ascontiguousarray(told[:, 1])
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.marked = regex.compile("(" + "|".join(regex.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.glue = regex.compile(f"{BLANK} ")
        self.blank_end = regex.compile(f"{BLANK}$|^$")
        self.cut = regex.compile(f"(?<!{BLANK}) ")


@cache
def vocabulary(name: str = VOCABULARY) -> Vocabulary:
    return Vocabulary(name)


def merge_words(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words, none of them empty, one after another, and how many each has.

    All words lie in one array of symbols with links to their neighbours. The index maps each pair that has a rank
    to all its positions. The active ranks are taken in ascending order: every position of that pair becomes one symbol,
    and the pairs it now forms with its neighbours are entered in their lists. Positions whose pair has gone are passed over
    when their list comes up; of overlapping positions of a pair of equal symbols those farther left come first.
    """
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    ids = vocab.single[data]
    n = len(ids)
    follows, leads = np.arange(1, n + 1), np.arange(-1, n - 1)
    follows[ends - 1] = -1
    leads[np.concatenate([[0], ends[:-1]])] = -1
    index, heap = {}, []

    def enter(places: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """Put places in the lists of their pairs, as far as these have a rank."""
        pairs = (left << SHIFT) | right
        at = np.searchsorted(vocab.keys, pairs)
        known = vocab.keys[at] == pairs
        if not known.any():
            return
        places, ranks = places[known], vocab.ranks[at[known]]
        if len(ranks) > 1:
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
        begins = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for rank, lo, hi in zip(ranks[begins[:-1]].tolist(), begins, begins[1:], strict=False):
            if rank in index:
                index[rank].append(places[lo:hi])
            else:
                index[rank] = [places[lo:hi]]
                heapq.heappush(heap, rank)

    left = np.flatnonzero(follows >= 0)
    enter(left, ids[left], ids[left + 1])
    while heap:
        now = heapq.heappop(heap)
        a, b, whole = vocab.parts[now]
        lists = index.pop(now)
        place = lists[0] if len(lists) == 1 else np.concatenate(lists)
        other = follows[place]
        still = (ids[place] == a) & (ids[other] == b) & (other >= 0)
        place, other = place[still], other[still]
        if a == b and len(place) > 1:
            place = np.unique(place)
            other = follows[place]
            starts = np.concatenate([[True], other[:-1] != place[1:]])
            runs = np.flatnonzero(starts)
            first = (np.arange(len(place)) - runs[np.cumsum(starts) - 1]) % 2 == 0
            place, other = place[first], other[first]
        if not len(place):
            continue
        ids[place], ids[other] = whole, -1
        after = follows[other]
        follows[place] = after
        more = after >= 0
        after, before = after[more], place[more]
        leads[after] = before
        ahead = leads[place]
        # a neighbour in front that is such a symbol too has been seen from its own side
        new = (ahead >= 0) & (ids[ahead] != whole)
        ahead = ahead[new]
        enter(np.concatenate([before, ahead]), np.concatenate([ids[before], ids[ahead]]), np.concatenate([ids[after], np.full(len(ahead), whole)]))
    upto = np.cumsum(ids >= 0)[ends - 1]
    return ids[ids >= 0], np.diff(upto, prepend=0)


class Encoder:
    """Ids of texts. A segment is what lies between two cuts, a cut being a space behind a character that is not blank.

    No token and no match of the pattern reaches over a cut, so segments are encoded alone, each distinct one once.
    """

    def __init__(self, name: str = VOCABULARY):
        self.vocab = vocabulary(name)
        self.forget()

    def forget(self) -> None:
        self.words, self.word_ids = Interned(), Ragged()
        self.segments, self.segment_ids, self.held = Interned(), Ragged(), 0

    def windows(self, text: str) -> Iterator[str]:
        """The text in windows that end at cuts."""
        lo = 0
        while lo < len(text):
            found = self.vocab.cut.search(text, lo + WINDOW) if lo + WINDOW < len(text) else None
            hi = found.start() if found else len(text)
            yield text[lo:hi]
            lo = hi

    def parts(self, window: str) -> list[str]:
        """What lies before the first cut, then the segments behind cuts without the space in front."""
        parts = window.split(" ")
        if not self.vocab.glue.search(window):
            return parts
        out, begin, ends_blank = [], 0, self.vocab.blank_end.search
        for i, part in enumerate(parts):
            if i + 1 < len(parts) and (i or part) and ends_blank(part[-1:]):
                continue
            out.append(" ".join(parts[begin : i + 1]))
            begin = i + 1
        return out

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole segments: split by the pattern, words not met before are merged together."""
        split = list(map(self.vocab.pattern.findall, segments))
        if not split:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        numbers = self.words.numbers(chain.from_iterable(split), int(counts.sum()))
        fresh = self.words.take_fresh()
        if fresh:
            self.word_ids.extend(*merge_words(self.vocab, [w.encode() for w in fresh]))
        ids, lengths = self.word_ids.gather(numbers)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)]
        return ids, np.diff(ends, prepend=0)

    def pieces(self, text: str, added: bool) -> Iterator[int | list]:
        """Ids of added tokens and keys of segments in order. A segment behind a cut has itself as key, one without a space in front a tuple."""
        marked = self.vocab.marked if added else None
        for k, piece in enumerate(marked.split(text) if marked else [text]):
            if k % 2:
                yield self.vocab.added[piece]
                continue
            for window in self.windows(piece):
                keys = self.parts(window)
                if keys[0]:
                    keys[0] = (keys[0],)
                yield keys if keys[0] else keys[1:]

    def numbers(self, text: str, added: bool = True) -> list[int | np.ndarray]:
        """The text by ids of added tokens and numbers of segments."""
        return [piece if isinstance(piece, int) else self.segments.numbers(piece, len(piece)) for piece in self.pieces(text, added)]

    def learn(self) -> None:
        """Encode the segments that have come up since the last call."""
        fresh = [s[0] if isinstance(s, tuple) else " " + s for s in self.segments.take_fresh()]
        self.segment_ids.extend(*self.encode_segments(fresh))
        self.held += sum(map(len, fresh))

    def ids(self, numbers: list[int | np.ndarray]) -> np.ndarray:
        out = [np.array([x], np.int32) if isinstance(x, int) else self.segment_ids.gather(x)[0] for x in numbers]
        return np.concatenate(out) if out else np.empty(0, np.int32)

    def trim(self) -> None:
        if self.held > REMEMBERED:
            self.forget()

    def encode(self, texts: list[str], added: bool = True) -> list[np.ndarray]:
        """Ids of each text; strings of added tokens stand for these, or are plain text."""
        told = [self.numbers(text, added) for text in texts]
        self.learn()
        out = [self.ids(x) for x in told]
        self.trim()
        return out


@cache
def kept_encoder(name: str) -> Encoder:
    """One encoder a worker process: what it remembers serves the worker's next partition too and never changes a result."""
    return Encoder(name)


def decode(ids: np.ndarray, name: str = VOCABULARY) -> str:
    """The text of ids: their bytes as UTF-8, what is none as U+FFFD; numbers that are no id are left out."""
    known = vocabulary(name).bytes
    out = []
    for lo in range(0, len(ids), WINDOW):
        out.append(b"".join([known.get(i, b"") for i in ids[lo : lo + WINDOW].tolist()]))
    return b"".join(out).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, name: str = VOCABULARY, added: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids) of all documents (doc_id, text): ids as little-endian unsigned 32-bit integers.

    Same ids as the json file's own tokenizer gives without adding special tokens. Strings of added tokens in texts become those tokens (plain
    text with added=False). Null text: as empty, no ids. Rows are mapped one by one in their scan partition: nothing is
    shuffled, repeated or null doc_ids stay as they are, other columns are not read, an empty table gives no rows. A text
    is worked on in windows of about a million characters, longer only where it has no space behind a letter.
    """

    def run(batches):
        encoder, held, size = kept_encoder(name), [], 0

        def settle():
            encoder.learn()
            for lo in range(0, len(held), 256):
                ids = [encoder.ids(numbers) for _, numbers in held[lo : lo + 256]]
                columns = [pa.array([doc_id for doc_id, _ in held[lo : lo + 256]], pa.int64()), pa.array(list(map(len, ids)), pa.int64()), pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids"])
            held.clear()
            encoder.trim()

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                held.append((doc_id.as_py(), encoder.numbers(text, added)))
                size += len(text)
                if size >= TOGETHER:
                    yield from settle()
                    size = 0
        yield from settle()

    return bounded_batches(pick(docs, {"doc_id": "long", "text": "string"})).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids, text) of (doc_id, n_tokens, ids): the texts that ids stand for. Null ids give null text; no ids, an empty one."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [None if (raw := x.as_buffer()) is None else decode(np.frombuffer(raw, "<u4"), name) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "text"])

    rows = bounded_batches(pick(encoded, {"doc_id": "long", "n_tokens": "long", "ids": "binary"}))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")


def encoding_digest(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    rows = decode_documents(encode_documents(docs, name), name)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
