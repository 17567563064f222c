"""Removal of passages that occur in an earlier document, by suffix automata over reference shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telesift.llm.common import bounded_batches, dealt_join, numbered, pick, spare, written
from telesift.llm.words import BASE, CHUNK, OTHER, _powers, grams, inside, mix, other_hashes, words_of

WINDOW = 50
ANCHOR = 16  # words in an anchor
LONGEST = 128  # windows in a run
SHARD_WORDS = 100_000
MOST_CONTEXTS = 1_000
TEXTS_AT_ONCE = 256
RUN = "doc_id long, key long, anchor long, passage long, other long, start int, windows int"


def span_prints(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """Fingerprints of word spans, equal for equal words wherever they stand."""
    up, down = _powers(CHUNK, base) if len(hashes) <= CHUNK else _powers.__wrapped__(len(hashes), base)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every `width` consecutive values."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    if span < width:
        values = np.minimum(values[: len(values) - (width - span)], values[width - span :])
    return values


def runs_of(hashes: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(anchor, passage, start, windows) of every run.

    A window's anchor is its smallest fingerprint of ANCHOR words: equal windows have equal anchors. A
    run is the longest row of windows with one anchor, so every window of a text lies in just one run.
    """
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none.view(np.uint64), none.view(np.uint64), none, none
    size = min(ANCHOR, window)
    least = window_minima(grams(hashes, size), window - size + 1)
    starts = np.flatnonzero(inside(first, len(hashes), window))
    if not len(starts):
        return none.view(np.uint64), none.view(np.uint64), none, none
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (np.diff(starts) != 1) | (least[starts[1:]] != least[starts[:-1]])
    at = np.flatnonzero(new)
    place = np.arange(len(starts)) - np.repeat(at, np.diff(np.append(at, len(starts))))
    at = np.flatnonzero(place % LONGEST == 0)
    count = np.diff(np.append(at, len(starts)))
    begin = starts[at]
    return least[begin], span_prints(hashes, begin, begin + count + window - 1), begin, count


class Automaton:
    """Suffix automaton of several word sequences; each state knows the owner that first had its strings.

    Sequences must be added in the order of their owners.
    """

    def __init__(self):
        self.next, self.link, self.length, self.owner = [{}], [-1], [0], [None]

    def _state(self, length: int, link: int, moves: dict, owner: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(owner)
        return len(self.next) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        """The state of the strings that end at p plus symbol, taken out of q."""
        copy = self._state(self.length[p] + 1, self.link[q], self.next[q].copy(), self.owner[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def add(self, symbols: list[int], owner: int) -> None:
        moves, link, length = self.next, self.link, self.length
        last = 0
        for symbol in symbols:
            q = moves[last].get(symbol)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, symbol)
                continue
            new = self._state(length[last] + 1, 0, {}, owner)
            p = last
            while p >= 0 and symbol not in moves[p]:
                moves[p][symbol] = new
                p = link[p]
            if p >= 0:
                q = moves[p][symbol]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, symbol)
            last = new

    def first_owners(self, symbols: list[int], window: int) -> list:
        """Matching statistics: for each window of the sequence the first owner of its words (None: nobody)."""
        moves, link, length, owner = self.next, self.link, self.length, self.owner
        state = matched = 0
        out = []
        for k, symbol in enumerate(symbols, 1):
            while state and symbol not in moves[state]:
                state = link[state]
                matched = length[state]
            to = moves[state].get(symbol)
            if to is not None:
                state, matched = to, min(matched + 1, window)
                while length[link[state]] >= matched:
                    state = link[state]
            if k >= window:
                out.append(owner[state] if matched >= window else None)
        return out


def _shard(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    """One shard: all its passages as references, in the order of their documents, then each one streamed.

    The automaton works on the words themselves, numbered as they come; fingerprints only brought them here.
    """
    pdf = pdf.sort_values(["owner", "passage", "other"], ignore_index=True)
    number: dict[bytes, int] = {}
    sequences = [[number.setdefault(w, len(number)) for w in raw.split()] for raw in pdf["words"]]
    automaton = Automaton()
    for symbols, owner in zip(sequences, pdf["owner"].tolist(), strict=True):
        automaton.add(symbols, owner)
    out = []
    for symbols, anchor, passage, other in zip(sequences, pdf["anchor"].tolist(), pdf["passage"].tolist(), pdf["other"].tolist(), strict=True):
        owners = automaton.first_owners(symbols, window)
        begin = 0
        for k in range(1, len(owners) + 1):
            if k == len(owners) or owners[k] != owners[begin]:
                out.append((anchor, passage, other, begin, k, owners[begin]))
                begin = k
    return pd.DataFrame(out, columns=["anchor", "passage", "other", "lo", "hi", "first_doc"])


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, key, start, end): word spans of docs (doc_id, text) that consist of windows found in a smaller doc_id.

    key is a hash of the text, which tells apart the texts of a repeated doc_id.

    Windows are dealt by their anchor, so that equal windows meet, in runs (about 20 windows that share
    an anchor travel as one passage). Anchors of a single document go. Passages that occur as they are
    in several documents, by two independent 64-bit fingerprints, are folded into one that knows its smallest
    doc_id. Where different passages share an anchor, those of about SHARD_WORDS words form a reference shard, whose
    suffix automaton over the words tells for every window of every passage the smallest document that has it. An anchor with more than
    MOST_CONTEXTS passages (a common sentence in ever new surroundings) would make a shard without bound:
    its windows are looked up one by one, by both fingerprints, to the same result. Runs of an anchor or a passage that many
    documents share are dealt to several tasks (dealt_join).
    """
    texts = bounded_batches(pick(docs, {"doc_id": "long", "text": "string"})).filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("key"), "text")

    def cut(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(lo, TEXTS_AT_ONCE)
                words = words_of(part.column(2))
                anchor, passage, start, count = runs_of(words.hashes, words.first, window)
                text = np.searchsorted(words.first, start, side="right") - 1
                ids = part.column(0).to_numpy()[text]
                keys = part.column(1).to_numpy()[text]
                other = span_prints(other_hashes(words), start, start + count + window - 1, OTHER)
                columns = [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), *(pa.array(x.view(np.int64)) for x in (anchor, passage, other)), pa.array(start - words.first[text], pa.int32()), pa.array(count, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "anchor", "passage", "other", "start", "windows"])

    runs = written(texts.mapInArrow(cut, RUN))
    shared = runs.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    shared = written(shared.select("anchor", "n"))
    row = ["doc_id", "key", "start"]
    runs = written(dealt_join(runs, shared.select("anchor"), shared, ["anchor"], row, "left_semi"))
    same = ("anchor", "passage", "other")
    passages = runs.groupBy(*same).agg(F.min(F.struct("doc_id", "key", "start", "windows")).alias("x"), F.count("*").alias("n"))
    passages = written(passages.select(*same, "n", F.col("x.doc_id").alias("owner"), "x.key", "x.start", "x.windows"))
    counts = passages
    contexts = passages.groupBy("anchor").agg(F.count("*").alias("contexts"))
    passages = written(passages.join(contexts, "anchor"))
    alone = passages.filter("contexts = 1").select(*same, F.lit(0).alias("lo"), F.col("windows").alias("hi"), F.col("owner").alias("first_doc"))
    several = passages.filter("contexts > 1")
    words = several.filter(F.col("contexts") <= MOST_CONTEXTS).agg(F.sum(F.col("windows") + window - 1)).first()[0] or 0
    shards = max(1, -(-words // SHARD_WORDS))
    several = several.withColumn("shard", F.when(F.col("contexts") <= MOST_CONTEXTS, F.pmod(F.xxhash64("anchor"), F.lit(shards))).otherwise(-1).cast("int"))
    wanted = several.groupBy(F.col("owner").alias("doc_id"), "key").agg(F.collect_list(F.struct(*same, "start", "windows", "shard")).alias("passages"))

    def fetch(batches):
        """The words of the wanted passages; a window each for those of crowded anchors (shard -1)."""
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(lo, TEXTS_AT_ONCE)
                words = words_of(part.column(1))
                asked = part.column(2)
                each = asked.flatten()
                text = np.repeat(np.arange(part.num_rows), np.diff(asked.offsets.to_numpy()))
                anchor, passage, other, start, count, shard = (each.field(k).to_numpy() for k in range(6))
                begin = start + words.first[text]
                owner = part.column(0).to_numpy()[text]
                full = np.flatnonzero(shard >= 0)
                raw = [words.data[words.starts[begin[i]] : words.ends[begin[i] + count[i] + window - 2]].tobytes() for i in full]
                crowd = np.repeat(np.flatnonzero(shard < 0), count[shard < 0])
                place = np.arange(len(crowd)) - np.repeat(np.cumsum(count[shard < 0]) - count[shard < 0], count[shard < 0])
                at = begin[crowd] + place
                prints = span_prints(words.hashes, at, at + window).view(np.int64)
                seconds = span_prints(other_hashes(words), at, at + window, OTHER).view(np.int64) if len(at) else prints
                rows = np.concatenate([full, crowd])
                columns = [pa.array(anchor[rows]), pa.array(passage[rows]), pa.array(other[rows]), pa.array(owner[rows]), pa.array(shard[rows], pa.int32()), pa.array(raw + [None] * len(crowd), pa.binary())]
                nil = np.zeros(len(full), np.int64)
                columns += [pa.array(np.concatenate([nil.astype(np.int32), place.astype(np.int32)])), *(pa.array(np.concatenate([nil, x])) for x in (prints, seconds))]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "passage", "other", "owner", "shard", "words", "place", "print", "second"])

    found = texts.dropDuplicates(["doc_id", "key"]).join(wanted, ["doc_id", "key"]).select("doc_id", "text", "passages")
    found = written(found.mapInArrow(fetch, "anchor long, passage long, other long, owner long, shard int, words binary, place int, print long, second long"))
    segments = "anchor long, passage long, other long, lo int, hi int, first_doc long"
    matched = found.filter("shard >= 0").select(*same, "owner", "shard", "words").groupBy("shard").applyInPandas(lambda pdf: _shard(pdf, window), segments)
    single = found.filter("shard < 0")
    firsts = single.groupBy("print", "second").agg(F.min("owner").alias("first_doc"))
    single = single.join(firsts, ["print", "second"]).select(*same, F.col("place").alias("lo"), (F.col("place") + 1).alias("hi"), "first_doc")
    known = alone.union(matched).union(single)
    spans = dealt_join(runs, known, counts, [*same], row).filter(F.col("first_doc") < F.col("doc_id"))
    return spans.select("doc_id", "key", (F.col("start") + F.col("lo")).alias("start"), (F.col("start") + F.col("hi") + window - 1).alias("end"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed and kept_text: the words not covered by a window that a smaller doc_id has too.

    kept_text is what is left, joined by one space. docs needs doc_id and text; other columns stay (n_words, n_removed and
    kept_text are replaced). Null text has no words and gives an empty kept_text, like an empty one.
    Rows that repeat a doc_id are documents of that number each, whatever their texts, so they take nothing from one
    another; a null doc_id is not compared. An empty table gives no rows.
    """
    rest = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    doc, key, cuts = (spare(docs, name) for name in ("_doc", "_key", "_spans"))
    spans = repeated_spans(docs, window).groupBy(F.col("doc_id").alias(doc), F.col("key").alias(key)).agg(F.collect_list(F.struct("start", "end")).alias(cuts))
    rows = docs.select(*[F.col(f"`{c}`") for c in rest])
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_text", T.StringType())))])
    rows = rows.join(spans, (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(key)), "left")
    rows = numbered(rows, [*rest, cuts])
    at = rest.index("text")

    def remove(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(batch.column(at), batch.column(len(rest)), strict=True):
                words = (text.as_py() or "").encode().split()
                gone = 0
                if spans.is_valid:
                    cover = np.zeros(len(words) + 1, dtype=np.int32)
                    edges = spans.values
                    np.add.at(cover, np.minimum(edges.field(0).to_numpy(), len(words)), 1)
                    np.add.at(cover, np.minimum(edges.field(1).to_numpy(), len(words)), -1)
                    stay = np.cumsum(cover[:-1]) == 0
                    gone = len(words) - int(stay.sum())
                    words = [words[i] for i in np.flatnonzero(stay)]
                n_words.append(len(words) + gone)
                n_removed.append(gone)
                kept.append(b" ".join(words).decode())
            columns = [batch.column(i) for i in range(len(rest))] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*rest, "n_words", "n_removed", "kept_text"])

    return rows.mapInArrow(remove, schema)


def substring_digest(docs: DataFrame) -> DataFrame:
    kept = remove_repeats(pick(docs, {"doc_id": "long", "text": "string"}))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
