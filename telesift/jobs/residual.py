"""Forecast residuals: dynamic thresholds on hopping windows, pruning and scoring of sequences.

Every window looks at its errors and at their mirror image about the mean (sudden calm is an anomaly too).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telesift.operators.events import mark, merge, overlaps
from telesift.operators.prep import chunked
from telesift.operators.rolling import combine_horizons, ewma, head_smoothed
from telesift.sources.durable import written

BATCH, HISTORY = 70, 30  # rows that a window adds, batches that it holds
BUFFER = 100  # rows on both sides of an anomalous one that belong to it
LEAST_ERROR, SHARE = 0.05, 0.05  # smallest largest error of a window; of the values' range, what errors must pass
Z_FIRST, Z_LAST, Z_STEP = 2.5, 12.0, 0.5


def residuals(actual: DataFrame, forecast: DataFrame, span: int = 105, chunk: int = 20_000) -> DataFrame:
    """(series_id, rn, error): absolute residuals, smoothed by an exponential mean, the head evened out."""
    return smoothed(actual.join(forecast, ["series_id", "rn"]).select("series_id", "rn", "y", "y_hat"), span, chunk).select("series_id", "rn", "error")


def smoothed(rows: DataFrame, span: int = 105, chunk: int = 20_000, few: bool = False) -> DataFrame:
    """(series_id, rn, error, value) of rows (series_id, rn, y, y_hat): residuals beside the value observed there. few: series are few, what each has is broadcast."""
    raw = rows.select("series_id", "rn", F.col("y").alias("value"), F.abs(F.col("y") - F.col("y_hat")).alias("raw"))
    return head_smoothed(ewma(raw, "raw", span, chunk, "error"), "error", few=few).select("series_id", "rn", "error", "value")


def normalized_error(actual: DataFrame, forecast: DataFrame) -> DataFrame:
    """(series_id, value): mean absolute residual over the range of the actual values."""
    rows = actual.join(forecast, ["series_id", "rn"])
    return rows.groupBy("series_id").agg(F.try_divide(F.avg(F.abs(F.col("y") - F.col("y_hat"))), F.max("y") - F.min("y")).alias("value"))


def _buffered(at: np.ndarray, by: int, n: int) -> np.ndarray:
    """Positions within `by` of one of at, inside 0..n-1."""
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, np.maximum(at - by, 0), 1)
    np.add.at(cover, np.minimum(at + by + 1, n), -1)
    return np.flatnonzero(np.cumsum(cover[:-1]) > 0)


def _runs(at: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive positions, of two and more."""
    parts = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []
    return [(int(p[0]), int(p[-1])) for p in parts if p[0] != p[-1]]


def best_epsilon(errors: np.ndarray, mean: float | None = None, sd: float | None = None, buffer: int = BUFFER) -> float:
    """The threshold mean + z * sd whose removal lowers mean and deviation most for the buffered points and runs it costs."""
    mean, sd = (errors.mean() if mean is None else mean), (errors.std() if sd is None else sd)
    best, top = mean + Z_LAST * sd, -np.inf
    if mean == 0 or sd == 0:
        return best
    for z in np.arange(Z_FIRST, Z_LAST, Z_STEP):
        epsilon = mean + z * sd
        calm = errors[errors < epsilon]
        if len(calm) == len(errors):
            break
        at = _buffered(np.flatnonzero(errors >= epsilon), buffer - 1, len(errors))
        runs = len(_runs(at))
        if not len(calm):
            continue
        gain = ((mean - calm.mean()) / mean + (sd - calm.std()) / sd) / (runs**2 + len(at))
        if gain >= top and runs <= 5 and len(at) < 0.5 * len(errors):
            best, top = epsilon, gain
    return best


def pruned(tops: np.ndarray, calm: float, p: float = 0.13) -> np.ndarray:
    """Which sequences stay: maxima in falling order, then the calm maximum; a tail of small decreases goes."""
    order = np.argsort(-tops, kind="stable")
    ladder = np.append(tops[order], calm)
    last = 0
    for k in range(len(order)):
        if ladder[k] > 0 and (ladder[k] - ladder[k + 1]) / ladder[k] >= p:
            last = k + 1
    keep = np.zeros(len(tops), dtype=bool)
    keep[order[:last]] = True
    return keep


def candidates(errors: np.ndarray, values: np.ndarray, begin: int, buffer: int = BUFFER, least: float = LEAST_ERROR) -> list[tuple[float, np.ndarray]]:
    """(threshold, anomalous positions from `begin` on) for the errors and for their mirror image; nothing if the errors are
    small beside the observed values."""
    low, high = np.percentile(values, [5, 95])
    floor = SHARE * (high - low)
    mean, sd = errors.mean(), errors.std()
    if not (sd > SHARE * values.std() or errors.max() > floor) or len(errors) < buffer or not errors.max() > least:
        return []
    out = []
    for side in (errors, 2 * mean - errors):
        epsilon = best_epsilon(side, mean, sd, buffer)
        at = _buffered(np.flatnonzero((side >= epsilon) & (side > floor)), buffer, len(side))
        out.append((epsilon, at[at >= begin]))
    return out if any(len(at) for _, at in out) else []


def decide(errors: np.ndarray, found: list[tuple[float, np.ndarray]], known: np.ndarray, p: float) -> list[tuple[int, int, float]]:
    """(first, last, score) of what is left of the candidates of a window after pruning; known: anomalies of earlier windows."""
    mean, sd = errors.mean(), errors.std()
    sides = (errors, 2 * mean - errors)
    stays = np.zeros(len(errors), dtype=bool)
    for side, (_, at) in zip(sides, found, strict=True):
        runs = _runs(at)
        calm = known.copy()
        calm[at] = True
        top = side[~calm].max() if not calm.all() else 0.0
        if not runs:
            stays[at] = True
            continue
        keep = pruned(np.array([side[a : b + 1].max() for a, b in runs]), top, p)
        for (a, b), k in zip(runs, keep.tolist(), strict=True):
            stays[a : b + 1] |= k
    at = np.flatnonzero(stays)
    parts = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []
    far = np.max([np.abs(side - epsilon) for side, (epsilon, _) in zip(sides, found, strict=True)], axis=0) / (mean + sd)
    return [(int(x[0]), int(x[-1]), float(far[x].max())) for x in parts]


def window_sequences(errors: np.ndarray, newest: int, buffer: int, p: float) -> list[tuple[int, int, float]]:
    """(start, end, score) in one window by itself, in its newest part."""
    found = candidates(errors, errors, len(errors) - newest, buffer)
    return decide(errors, found, np.zeros(len(errors), dtype=bool), p) if found else []


def windows_of(n: int, batch: int = BATCH, history: int = HISTORY) -> tuple[int, int]:
    """(number of windows, batches in each) for a series of n rows: fewer batches if it is short; one window at least."""
    while history > 1 and n < batch * history:
        history -= 1
    return max(1, (n - batch * history) // batch), history


def ignored(n: int, size: int = 250) -> int:
    """Rows at the start of a series of n rows that the first window does not judge."""
    return 2 * size if n >= 2_500 else size if n >= 1_800 else 0


def dynamic_thresholds(errors: DataFrame, batch: int = BATCH, history: int = HISTORY, buffer: int = BUFFER, p: float = 0.13, least: float = LEAST_ERROR, block: int = 21_000, few: bool = False) -> DataFrame:
    """(series_id, start_rn, end_rn, score) from errors (series_id, rn, error, value); value is what was observed (error, if there is none).

    Windows of batch * history rows start every `batch` rows. The first one judges all its rows but the earliest, the others
    their newest `batch` rows, the last one reaches to the end of the series. Sequences of both signs and of neighbouring
    windows that touch are one; single rows go.

    Thresholds are found block by block: a block and its halo hold some hundred windows. Only pruning looks at what
    earlier windows have found, as far as a window reaches; so the few windows with candidates are put in clusters
    that cannot see one another, and each cluster is gone through in order in one task. Positions run from 0 without gaps.
    few: series are few (channels), so that their lengths are broadcast and rows need not meet by series.
    """
    value = F.col("value") if "value" in errors.columns else F.col("error")
    lengths = errors.groupBy("series_id").agg(F.count("*").alias("rows"))
    rows = errors.select("series_id", "rn", "error", value.alias("value")).join(F.broadcast(lengths) if few else lengths, "series_id")
    reach = batch * (history + 2)
    made = "series_id long, k long, begin long, errors array<double>, epsilon array<double>, up array<int>, down array<int>"
    names = [c.split()[0] for c in made.split(", ")]

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", ignore_index=True)
        series, first, n = int(pdf["series_id"].iloc[0]), int(pdf["rn"].iloc[0]), int(pdf["rows"].iloc[0])
        own = pdf.loc[pdf["own"], "rn"]
        out = []
        if len(own):
            count, held = windows_of(n, batch, history)
            size = batch * held
            lo, hi = int(own.iloc[0]), int(own.iloc[-1])
            # a window belongs to the block that holds its last row
            mine = [k for k in range(max(0, (lo - size) // batch), min(count - 2, (hi + 1 - size) // batch) + 1) if lo < size + k * batch <= hi + 1]
            for k in mine + [count - 1] * (hi == n - 1):
                begin, end = k * batch, n if k == count - 1 else size + k * batch
                e, v = (pdf[c].to_numpy(dtype=float)[begin - first : end - first] for c in ("error", "value"))
                found = candidates(e, v, ignored(n) if k == 0 else len(e) - batch, buffer, least)
                if found:
                    out.append((series, k, begin, e.tolist(), [x for x, _ in found], found[0][1].tolist(), found[1][1].tolist()))
        return pd.DataFrame(out, columns=names)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        out, known = [], []
        for r in pdf.sort_values("k").itertuples():
            e = np.asarray(r.errors)
            seen = np.zeros(len(e), dtype=bool)
            for a, b in known:
                seen[max(0, a - r.begin) : max(0, b + 1 - r.begin)] = True
            found = [(r.epsilon[i], np.asarray(at, dtype=np.int64)) for i, at in enumerate((r.up, r.down))]
            for a, b, score in decide(e, found, seen, p):
                known.append((a + r.begin, b + r.begin))
                out.append((r.series_id, a + r.begin, b + r.begin, score))
        return pd.DataFrame(out, columns=["series_id", "start_rn", "end_rn", "score"])

    windows = written(chunked(rows, reach, 0, max(block, reach)).groupBy("series_id", "chunk").applyInPandas(find, made))
    order = Window.partitionBy("series_id").orderBy("k")
    apart = F.coalesce(F.col("k") - F.lag("k").over(order) > history + 2, F.lit(True)).cast("int")
    clusters = windows.select("series_id", "k", apart.alias("new")).select("series_id", "k", F.sum("new").over(order).alias("cluster"))
    parts = written(windows.join(clusters, ["series_id", "k"]).groupBy("series_id", "cluster").applyInPandas(settle, "series_id long, start_rn long, end_rn long, score double"))
    whole = merge(parts.select("series_id", "start_rn", "end_rn"), 0).filter("start_rn < end_rn")
    inside = overlaps(whole, parts).select("series_id", F.col("p_start").alias("start_rn"), F.col("p_end").alias("end_rn"), F.col("t_start"))
    scored = inside.join(parts.select("series_id", F.col("start_rn").alias("t_start"), "score"), ["series_id", "t_start"])
    return scored.groupBy("series_id", "start_rn", "end_rn").agg(F.max("score").alias("score"))


def forecast_job(actual: DataFrame, forecasts: DataFrame, method: str = "first", chunk: int = 20_000, padding: int = 250) -> tuple[DataFrame, DataFrame]:
    """((channel, rn, error, flag), (rn, flag)) of actual (channel, rn, y) and supplied forecasts (channel, step, horizon, y_hat), all channels at once.

    Forecasts for one row made at several steps are combined (first, mean or exp); residuals are smoothed and judged by dynamic
    thresholds, channel by channel; the second table is 1 where any channel is. rn counts from a channel's first row that has
    a forecast, after `padding` rows of zeros. A row with a forecast must follow the one before.
    """
    names = sorted(r[0] for r in forecasts.select("channel").distinct().collect())  # a row a channel
    channels = F.array(*[F.lit(n) for n in names])
    joined = actual.join(combine_horizons(forecasts, method).withColumnRenamed("target", "rn"), ["channel", "rn"])
    rows = written(joined.select((F.array_position(channels, F.col("channel")) - 1).cast("long").alias("series_id"), "rn", "y", "y_hat"))
    first = rows.groupBy("series_id").agg(F.min("rn").alias("_first"))
    rows = rows.join(F.broadcast(first), "series_id").withColumn("rn", F.col("rn") - F.col("_first")).drop("_first")
    errors = written(smoothed(rows, chunk=chunk, few=True))
    flags = channel_flags(errors, written(dynamic_thresholds(errors, few=True)), padding)
    flags = written(flags.select(F.get(channels, F.col("series_id").cast("int")).alias("channel"), "rn", "error", "flag"))
    return flags, flags.groupBy("rn").agg(F.max("flag").alias("flag"))


def channel_flags(errors: DataFrame, sequences: DataFrame, padding: int = 250) -> DataFrame:
    """(series_id, rn, error, flag): a row for each error after `padding` rows of zeros; 1 from the start of a sequence up to,
    but not with, its end."""
    flagged = mark(errors.select("series_id", "rn", "error"), sequences.select("series_id", "start_rn", "end_rn"), "flag", end_inclusive=False)
    shifted = flagged.withColumn("rn", F.col("rn") + padding)
    zeros = errors.select("series_id").distinct().select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(padding - 1).cast("long"))).alias("rn"), F.lit(0.0).alias("error"), F.lit(0).alias("flag"))
    return shifted.select("series_id", "rn", "error", "flag").union(zeros)
