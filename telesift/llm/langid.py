"""Language identification by prediction by partial matching (PPM) under frozen statistics."""

from __future__ import annotations

import pickle
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telesift.llm.common import bounded_batches, numbered, spare, written
from telesift.llm.words import text_bytes

ORDER = 4  # bytes of context at most
SAMPLE = 400  # documents a language that a model is fitted on, at most
MOST_NODES = 20_000  # contexts in the tree for up to four languages, fewer in proportion for more
LEAST_COUNT = 4  # a context occurs so often in the sample at least
UNKNOWN = "und"
EVIDENCE = 64.0  # the score counts as much evidence as so many bytes hold, at most
TEXTS_AT_ONCE = 64
SHARE_STEPS = 1 << 16


class Model(NamedTuple):
    """One context tree for all languages, each with its own cost of every byte after every context.

    Node 0 is the empty context; nodes are ordered by depth. child[node, c] is the context with one more
    byte c in front of it, or the node itself if the sample has no such context. cost[node, s] holds the code
    length in bits of symbol s for every language. symbol maps bytes to symbols, 0 for those never seen.
    """

    langs: list[str]
    symbol: np.ndarray
    depth: np.ndarray
    child: np.ndarray
    cost: np.ndarray


def gram_keys(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Every `size` consecutive bytes of one text as a number, the last byte in the lowest place."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    keys = np.zeros(n, dtype=np.int64)
    for j in range(size):
        keys = keys << 8 | data[j : j + n]
    ok = np.ones(n, dtype=bool)
    for j in range(1, size):
        cut = at[1:-1] - j
        ok[cut[(cut >= 0) & (cut < n)]] = False
    return keys[ok]


def _count(batches):
    """(lang, size, gram, n): how often each row of 1 to ORDER + 1 bytes occurs in the texts of a language."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang in sorted(set(langs)):
            data, at = text_bytes(pc.utf8_lower(batch.column(1).filter(pa.array([x == lang for x in langs]))))
            for size in range(1, ORDER + 2):
                keys, n = np.unique(gram_keys(data, at, size), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), size), pa.int32()), pa.array(keys), pa.array(n)], ["lang", "size", "gram", "n"])


def labelled_sample(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(lang, text) of at most `most` documents of every language, chosen by a hash of doc_id; whole texts."""
    rows = docs.filter("lang is not null and text is not null")
    counts = written(rows.groupBy("lang").agg(F.count("*").alias("rows")))
    share = (F.lit(2.0 * most) / F.col("rows") * SHARE_STEPS).cast("long") + 1
    chosen = rows.join(F.broadcast(counts), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(SHARE_STEPS)) < share)
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id"), F.lit(1)), "doc_id", F.xxhash64("text"))
    return chosen.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most).select("lang", "text")


def build_model(grams: list[tuple[str, int, int, int]]) -> Model:
    """The frozen model from counted grams (lang, size, gram, n).

    A byte seen after a context costs its share there; otherwise the escape probability (method C:
    distinct bytes seen over all plus distinct) times its probability after the next shorter context,
    with the bytes seen in the longer one left out.
    """
    langs = sorted({g[0] for g in grams})
    number = {lang: i for i, lang in enumerate(langs)}
    seen = sorted({g[2] for g in grams if g[1] == 1})
    symbol = np.zeros(256, dtype=np.int64)
    symbol[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    counts = [{} for _ in range(ORDER + 1)]  # depth: context -> [(lang, symbol, n)]
    totals = [{} for _ in range(ORDER + 1)]
    for lang, size, gram, n in grams:
        context, last = gram >> 8, int(symbol[gram & 255])
        counts[size - 1].setdefault(context, []).append((number[lang], last, n))
        totals[size - 1][context] = totals[size - 1].get(context, 0) + n
    # the most frequent contexts; a context's shorter ones are at least as frequent, so they are there too
    ranked = sorted(((n, -d, -c) for d in range(1, ORDER + 1) for c, n in totals[d].items() if n >= LEAST_COUNT), reverse=True)
    ranked = ranked[: 4 * MOST_NODES // max(4, len(langs)) - 1]
    kept = sorted((-d, -c) for _, d, c in ranked)
    node = {(0, 0): 0}
    for d, c in kept:
        # the shorter context: the byte farthest away is dropped
        if (d - 1, c & ((1 << 8 * (d - 1)) - 1)) in node:
            node[d, c] = len(node)
    depth = np.zeros(len(node), dtype=np.int64)
    child = np.repeat(np.arange(len(node), dtype=np.int32)[:, None], width, axis=1)
    prob = np.zeros((len(node), width, len(langs)))
    for (d, c), i in node.items():
        depth[i] = d
        n = np.zeros((width, len(langs)))
        for lang, last, k in counts[d].get(c, ()):
            n[last, lang] += k
        if d:
            parent = node[d - 1, c & ((1 << 8 * (d - 1)) - 1)]
            child[parent, symbol[c >> 8 * (d - 1)]] = i
            below = prob[parent]
        else:
            below = np.full((width, len(langs)), 1.0 / width)
        known = n > 0
        total, kinds = n.sum(axis=0), known.sum(axis=0)
        rest = np.maximum(1.0 - (below * known).sum(axis=0), 1e-12)
        escape = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
        prob[i] = np.where(known, n / np.maximum(total + kinds, 1), escape * below / rest)
    return Model(langs, symbol, depth, child, -np.log2(np.maximum(prob, 1e-12)).astype(np.float32))


def code_lengths(model: Model, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bits that each language needs for each text: every byte at its longest known context."""
    symbols = model.symbol[data]
    node = np.zeros(len(data), dtype=np.int32)
    place = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    for d in range(ORDER):
        # one byte farther back, where the context so far was found in full and the text reaches
        more = np.flatnonzero((model.depth[node] == d) & (place > d)) if d else np.flatnonzero(place > 0)
        node[more] = model.child[node[more], symbols[more - d - 1]]
    bits = model.cost[node, symbols]
    sums = np.zeros((len(data) + 1, bits.shape[1]))
    np.cumsum(bits, axis=0, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def fit(docs: DataFrame, most: int = SAMPLE) -> Model:
    """A model of labelled documents (doc_id, lang, text); bounded by `most` documents a language and MOST_NODES."""
    counted = bounded_batches(labelled_sample(docs, most)).mapInArrow(_count, "lang string, size int, gram long, n long")
    counted = counted.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    totals = counted.groupBy("size", (F.shiftright("gram", 8)).alias("context")).agg(F.sum("n").alias("total")).filter(F.col("total") >= LEAST_COUNT)
    kept = counted.withColumn("context", F.shiftright("gram", 8)).join(totals, ["size", "context"], "left_semi")
    return build_model([tuple(r) for r in kept.select("lang", "size", "gram", "n").toLocalIterator()])


def identify(docs: DataFrame, training: DataFrame, most: int = SAMPLE) -> DataFrame:
    """docs with lang_pred and score, by a model of training (doc_id, lang, text).

    Fitting takes at most `most` whole documents a language, chosen by hash; every text is scored whole.
    lang_pred is the language with the shortest code, ties to the first by name, and UNKNOWN if text is
    null or has no letter or nothing was learned. score is the posterior of lang_pred under equal priors,
    the evidence taken as that of EVIDENCE bytes at most (longer texts would all score 1), 0 for UNKNOWN. Other
    columns stay (lang_pred and score are replaced); an empty table gives no rows. Letter case is
    not regarded.
    """
    model = fit(training, most)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # at most MOST_NODES contexts
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest])
    flag = spare(rows, "lettered")
    keyed = rows.withColumn(flag, F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    keyed = numbered(bounded_batches(keyed), [*rest, flag])
    at_text = rest.index("text")

    def score(batches):
        model = pickle.loads(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(lo, TEXTS_AT_ONCE)
                lettered = part.column(len(rest))
                data, at = text_bytes(pc.utf8_lower(pc.if_else(lettered, part.column(at_text), "")))
                some = lettered.to_numpy(zero_copy_only=False) & bool(model.langs)
                names, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                if some.any():
                    bits = _in_pieces(model, data, at)
                    best = bits.argmin(axis=1)
                    size = np.maximum(1, np.diff(at))
                    gap = (bits - bits.min(axis=1, keepdims=True)) * np.minimum(1.0, EVIDENCE / size)[:, None]
                    scores = np.where(some, 1.0 / np.exp2(-gap).sum(axis=1), 0.0)
                    names = [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, some, strict=True)]
                columns = [part.column(i) for i in range(len(rest))] + [pa.array(names, pa.string()), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, [*rest, "lang_pred", "score"])

    return keyed.mapInArrow(score, T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


PIECE = 1 << 16


def _in_pieces(model: Model, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """code_lengths with bounded memory: texts in groups, long ones in pieces that overlap by the context."""
    out = np.zeros((len(at) - 1, len(model.langs)))
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, side="right")) - 1)
        if at[j] - at[i] <= PIECE:
            out[i:j] = code_lengths(model, data[at[i] : at[j]], at[i : j + 1] - at[i])
        else:
            for lo in range(int(at[i]), int(at[j]), PIECE):
                begin, hi = max(int(at[i]), lo - ORDER), min(lo + PIECE, int(at[j]))
                both = code_lengths(model, data[begin:hi], np.array([0, hi - begin]))[0]
                lead = code_lengths(model, data[begin:lo], np.array([0, lo - begin]))[0] if lo > begin else 0.0
                out[i] += both - lead
        i = j
    return out


def language_digest(docs: DataFrame) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))  # a null doc_id is not held out
    rows = docs.select("doc_id", "text")
    learned = docs.filter(~held).select("doc_id", "lang", "text")
    return identify(rows, learned).select("doc_id", held.alias("held_out"), "lang_pred", "score")
