"""All thresholds of a sweep at once: every row has the level up to which it is in an event.

Thresholds are numbered 1..n from below. A row's level is the number of thresholds that its score passes, so the rows of level k
and more are the rows flagged by threshold k. Events shorter than `shortest` go for all thresholds at once if levels are opened (the
largest of the smallest levels of the frames of that length around a row), and gaps up to `gap` are filled if they are then closed.
Both reach only a few rows, so blocks with a halo give the same levels as whole series. What is left are nested events: a component
tree, whose events at k are runs of levels >= k. They are counted where they begin, from pairs of neighbouring levels,
not one threshold after the other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telesift.operators.events import mark, merge, overlaps
from telesift.operators.prep import blocks_of, chunked
from telesift.sources.durable import written

BLOCK = 50_000
SLAB = 1_000_000  # rows times levels looked at together
EVENT, HIT, EDGE = 0, 1, 2


def _sliding(x: np.ndarray, size: int, reduce, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """The reduction of each frame of `size` values that begins, and of each that ends, at a row; frames reach over the ends with `fill`."""
    wide = np.concatenate([np.full(size - 1, fill, x.dtype), x, np.full(size - 1, fill, x.dtype)])
    step, reached = wide, 1
    while reached < size:  # frames of 1, 2, 4, ... rows, the last two overlapping
        by = min(reached, size - reached)
        step = reduce(step[: len(step) - by], step[by:])
        reached += by
    return step[size - 1 :], step[: len(x)]


def settle(levels: np.ndarray, shortest: int, gap: int) -> np.ndarray:
    """Levels after events shorter than `shortest` have gone and gaps of at most `gap` rows are filled."""
    out = levels
    if shortest > 1:
        low, _ = _sliding(out, shortest, np.minimum, 0)  # of the frame that begins here, 0 where it reaches past the end
        _, out = _sliding(low, shortest, np.maximum, 0)
    if gap > 0:
        n = len(out)
        wide = np.concatenate([np.zeros(gap, out.dtype), out, np.zeros(gap, out.dtype)])
        high, _ = _sliding(wide, gap + 1, np.maximum, 0)
        _, low = _sliding(high, gap + 1, np.minimum, np.iinfo(out.dtype).max)
        out = low[gap : gap + n]
    return out


def _level(scores: np.ndarray, thresholds: np.ndarray, strict: bool) -> np.ndarray:
    """How many thresholds a score passes; none without a score."""
    at = np.searchsorted(thresholds, scores, side="left" if strict else "right")
    return np.where(np.isnan(scores), 0, at).astype(np.int64)


def in_blocks(df: DataFrame, reach: int, block: int) -> DataFrame:
    """Rows by (series_id, chunk) with `reach` neighbours on either side, in order of rn; a block is one run of a task's rows."""
    wide = chunked(df, reach, reach, max(block, reach))
    return wide.repartition("series_id", "chunk").sortWithinPartitions("series_id", "chunk", "rn")


def settled(df: DataFrame, score: str, shortest: int, gap: int, block: int = BLOCK) -> DataFrame:
    """Rows in blocks (series_id, rn, chunk, own, s, in_true), with the neighbours that settle the levels of own rows and of the ones beside them."""
    reach = 2 * (shortest - 1) + 2 * gap + 2
    return in_blocks(df.select("series_id", "rn", F.col(score).cast("double").alias("s"), "in_true"), reach, block)


COUNTS = "series_id long, chunk long, kind int, lo int, hi int, n long, top int, tail int"


def _count(pdf: pd.DataFrame, thresholds: np.ndarray, shortest: int, gap: int, strict: bool) -> list[tuple]:
    """(kind, lo, hi, n, top, tail): so many own rows begin an event, or are the first true row of one, for the thresholds in (lo, hi].

    A true row is the first of its event as far as the least level since the true row before lies below. A last row tells what the
    next blocks must know: the block's least level, or else the least one up to its first true row, that row's (top), and the least one from its last true row on (tail).
    """
    levels = settle(_level(pdf["s"].to_numpy(dtype=float), thresholds, strict), shortest, gap)
    own = np.flatnonzero(pdf["own"].to_numpy())
    before = np.concatenate([[0], levels[:-1]])[own]
    now, true = levels[own], pdf["in_true"].to_numpy()[own] == 1
    pairs = [(EVENT, before[before < now], now[before < now])]
    at = np.flatnonzero(true)
    edge = (EDGE, int(now.min()), -1, 1, None, None)
    if len(at):
        # from one true row to the next, both included
        least = np.minimum(np.minimum.reduceat(now, at), now[np.append(at[1:], len(now) - 1)])
        lo, hi = least[:-1], now[at[1:]]
        pairs.append((HIT, lo[lo < hi], hi[lo < hi]))
        edge = (EDGE, int(now.min()), int(now[: at[0] + 1].min()), 1, int(now[at[0]]), int(least[-1]))
    out = []
    for kind, lo, hi in pairs:
        both, n = np.unique(np.stack([lo, hi]), axis=1, return_counts=True)
        out += [(kind, int(a), int(b), int(c), None, None) for a, b, c in zip(*both, n, strict=True)]
    return [*out, edge]


def _heads(edges: DataFrame) -> DataFrame:
    """First true rows of blocks as HIT rows: the least level since the true row before, over the blocks between; 0 before a series' first."""
    true = F.col("hi") >= 0
    before = Window.partitionBy("series_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    tail = F.last(F.when(true, F.col("tail")), ignorenulls=True).over(before)
    rows = edges.withColumns({"_tail": F.coalesce(tail, F.lit(0)), "_run": F.coalesce(F.count_if(true).over(before), F.lit(0))})
    rows = rows.withColumn("_between", F.min(F.when(~true, F.col("lo"))).over(Window.partitionBy("series_id", "_run")))
    heads = rows.filter(true).select(F.lit(HIT).alias("kind"), F.least("_tail", "_between", "hi").alias("lo"), F.col("top").alias("hi"), F.lit(1).cast("long").alias("n"))
    return heads.filter("lo < hi")


def threshold_counts(df: DataFrame, score: str, true: DataFrame, thresholds: list[float], shortest: int, gap: int, strict: bool = False, block: int = BLOCK) -> DataFrame:
    """(threshold, n_pred, tp): events of score >= t (or > t), pruned and merged, and how many of them overlap a true event.

    One pass over the rows in blocks gives counts by pairs of levels, and a row a block about its first and last true row; these
    rows are followed along the series. Positions of a series follow one another.
    """
    spark = df.sparkSession
    values = np.array(sorted(float(t) for t in thresholds))
    rows = settled(mark(df.select("series_id", "rn", score), true, "in_true"), score, shortest, gap, block)

    def run(batches):
        names = [c.split(" ")[0] for c in COUNTS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        told = []

        def batch():
            columns = list(zip(*told, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for pdf in blocks_of(batches):
            key = (int(pdf["series_id"].iloc[0]), int(pdf["chunk"].iloc[0]))
            told += [(*key, *t) for t in _count(pdf, values, shortest, gap, strict)]
            if len(told) > 20_000:
                yield batch()
                told.clear()
        yield batch()

    told = written(rows.mapInArrow(run, COUNTS))
    heads = _heads(told.filter(F.col("kind") == EDGE))
    pairs = told.filter(F.col("kind") != EDGE).select("kind", "lo", "hi", "n").union(heads)
    steps = pairs.select("kind", F.explode(F.array(F.struct((F.col("lo") + 1).alias("k"), F.col("n").alias("d")), F.struct((F.col("hi") + 1).alias("k"), (-F.col("n")).alias("d")))).alias("x"))
    steps = steps.groupBy(F.col("x.k").alias("k")).agg(*[F.sum(F.when(F.col("kind") == kind, F.col("x.d")).otherwise(0)).alias(name) for kind, name in ((EVENT, "n_pred"), (HIT, "tp"))])
    # a row a threshold
    every = spark.createDataFrame([(k, float(t)) for k, t in enumerate(values, 1)], "k int, threshold double").join(steps, "k", "left").na.fill(0)
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return every.select("threshold", F.sum("n_pred").over(upto).alias("n_pred"), F.sum("tp").over(upto).alias("tp"))


def event_tree(df: DataFrame, score: str, thresholds: list[float], shortest: int, gap: int, strict: bool = False, block: int = BLOCK) -> DataFrame:
    """(series_id, start_rn, end_rn, lo, hi): each different event once, with the first and last threshold (numbered 0..) that has it.

    Events inside a block are found there, equal ones of neighbouring thresholds as one; only those that touch a block's border are
    listed by threshold and joined along the series.
    """
    values = np.array(sorted(float(t) for t in thresholds))
    rows = settled(df.select("series_id", "rn", score).withColumn("in_true", F.lit(0)), score, shortest, gap, block)

    names, types = ["series_id", "start_rn", "end_rn", "lo", "hi", "border"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]

    def run(batches):
        out, held = [], 0

        def batch():
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for pdf in blocks_of(batches):
            own = pdf["own"].to_numpy()
            now = settle(_level(pdf["s"].to_numpy(dtype=float), values, strict), shortest, gap)[own]
            rn, n, top = pdf["rn"].to_numpy()[own], int(own.sum()), int(now.max())
            found = []
            step = max(1, SLAB // n)
            for first in range(1, top + 1, step):  # many levels of a short block at once
                k = np.arange(first, min(first + step, top + 1))
                inside = np.zeros((len(k), n + 2), dtype=bool)
                inside[:, 1:-1] = now >= k[:, None]
                level, turns = np.nonzero(inside[:, 1:] != inside[:, :-1])
                found.append((turns[::2], turns[1::2] - 1, level[::2] + first - 1))
            if not found:
                continue
            begin, end, k = (np.concatenate(x) for x in zip(*found, strict=True))
            border = (begin == 0) | (end == n - 1)
            order = np.lexsort((k, end, begin))
            begin, end, k, border = begin[order], end[order], k[order], border[order]
            new = np.concatenate([[True], (begin[1:] != begin[:-1]) | (end[1:] != end[:-1]) | border[1:]])
            last = np.append(np.flatnonzero(new)[1:] - 1, len(begin) - 1)
            out.append((np.full(int(new.sum()), int(pdf["series_id"].iloc[0])), rn[begin[new]], rn[end[new]], k[new], k[last], border[new]))
            held += len(last)
            if held > 20_000:
                yield batch()
                out, held = [], 0
        if out:
            yield batch()

    found = written(rows.mapInArrow(run, "series_id long, start_rn long, end_rn long, lo int, hi int, border boolean"))
    along = merge(found.filter("border").withColumnRenamed("lo", "k"), 0, ["series_id", "k"], block * 1_000_000)
    along = along.groupBy("series_id", "start_rn", "end_rn").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    return found.filter("not border").drop("border").unionByName(along)


def matching_pairs(tree: DataFrame, true: DataFrame) -> DataFrame:
    """(series_id, p_start, p_end, t_start, t_end, lo, hi): true events that events of the tree overlap; each is looked up once, not once a threshold."""
    nodes = tree.select("series_id", F.col("start_rn").alias("p_start"), F.col("end_rn").alias("p_end"), "lo", "hi")
    return overlaps(tree, true).distinct().join(nodes, ["series_id", "p_start", "p_end"])
