"""Frames over row positions, for many series or a long one in chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telesift.functions.scores import row_mean
from telesift.operators.prep import chunked


def added(df: DataFrame, name: str) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])


class Frames:
    """Windows by row position in one partitioning, shared by all columns that use it."""

    def __init__(self, keys: list[str]):
        self.order = Window.partitionBy(*keys).orderBy("rn")

    def rows(self, lo: int, hi: int):
        return self.order.rowsBetween(lo, hi)

    def centred(self, size: int):
        return self.rows(-(size // 2), (size - 1) // 2)

    def trailing(self, size: int):
        return self.rows(-(size - 1), 0)

    def lag(self, x, k: int = 1) -> Column:
        return F.lag(x, k).over(self.order)


def over_frames(df: DataFrame, before: int, after: int, build: Callable[[Frames], dict[str, Column]], chunk: int | None = None) -> DataFrame:
    """df with columns computed over frames that reach `before` rows back and `after` ahead.

    chunk: cut each series in so many rows (a series too long for a task); without it a series is one partition.
    """
    if chunk is None:
        return df.withColumns(build(Frames(["series_id"])))
    wide = chunked(df, before, after, chunk)
    return wide.withColumns(build(Frames(["series_id", "chunk"]))).filter("own").drop("own", "chunk")


SPREAD = 65_536  # values of frames laid out at once


class Block:
    """Numeric columns of the rows of a chunk and its halo, in order of rn, with moments over frames of rows i + lo .. i + hi of row i.

    Nulls are left out, NaN is not. Values are taken from the row's own first, so frames of equal values have no spread.
    """

    def __init__(self, table: pa.Table):
        self.table, self.seen = table, {}

    def column(self, c: str) -> tuple[np.ndarray, np.ndarray]:
        """(values, 0 for null; which are not null)."""
        if c not in self.seen:
            x = self.table.column(c).combine_chunks().cast(pa.float64())
            self.seen[c] = x.fill_null(0.0).to_numpy(zero_copy_only=False), x.is_valid().to_numpy(zero_copy_only=False)
        return self.seen[c]

    def lag(self, c: str, k: int) -> tuple[np.ndarray, np.ndarray]:
        x, ok = self.column(c)
        none = min(k, len(x))
        return np.concatenate([np.zeros(none), x[: len(x) - none]]), np.concatenate([np.zeros(none, dtype=bool), ok[: len(x) - none]])

    def moments(self, a: str, b: str, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        """(values in the frame, their mean less the row's value, sum of products of distances from the means), of a and b where both are there, the mean of a."""
        if (a, b, lo, hi) not in self.seen:
            (x, some), (y, other) = self.column(a), self.column(b)
            ok, size = some & other, hi - lo + 1
            left, right = max(0, -lo), max(0, hi)
            view = lambda v: np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(left, v.dtype), v, np.zeros(right, v.dtype)]), size)[left + lo :][: len(v)]
            at = np.arange(len(x))
            upto = np.concatenate([[0], np.cumsum(ok)])
            n = (upto[np.clip(at + hi + 1, 0, len(x))] - upto[np.clip(at + lo, 0, len(x))]).astype(np.float64)
            mean, both = np.zeros(len(x)), np.zeros(len(x))
            step, ones = max(1, SPREAD // size), np.ones(size)
            vx, vy, vok, full = view(x), view(y), view(ok), n == size

            def apart(v, own, rows, exact=False):
                """Distances from the row's own value, or from the mean."""
                d = v[rows] - own[rows, None]
                missing = None if full[rows].all() else ~vok[rows]
                if missing is not None:
                    d[missing] = 0.0
                off = d @ ones / n[rows]
                if exact:
                    d -= off[:, None]
                    if missing is not None:
                        d[missing] = 0.0
                return d, off

            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                for rows in (at[i : i + step] for i in range(0, len(x), step)):
                    rows = slice(rows[0], rows[-1] + 1)
                    d, mean[rows] = apart(vx, x, rows)
                    e, off = (d, mean[rows]) if a == b else apart(vy, y, rows)
                    found, less = np.einsum("ij,ij->i", d, e), n[rows] * mean[rows] * off
                    both[rows] = found - less
                    # where little is left of a difference, distances from the means are taken
                    lost = np.flatnonzero(np.abs(found - less) < 1e-4 * np.abs(less)) + rows.start
                    if len(lost):
                        d = apart(vx, x, lost, True)[0]
                        both[lost] = np.einsum("ij,ij->i", d, d if a == b else apart(vy, y, lost, True)[0])
            self.seen[a, b, lo, hi] = n, mean, both
        return self.seen[a, b, lo, hi]

    def deviation(self, c: str, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Sample deviation of a frame, and where there is one (two values and more)."""
        n, _, both = self.moments(c, c, lo, hi)
        return np.sqrt(both / np.maximum(n - 1, 1)), n > 1


def tables_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one (series_id, chunk) after the other, from batches in that order, if some of them are the block's own."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        series, chunk = held.column("series_id").to_numpy(), held.column("chunk").to_numpy()
        cuts = [0, *(np.flatnonzero((series[1:] != series[:-1]) | (chunk[1:] != chunk[:-1])) + 1).tolist()]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield held.slice(lo, hi - lo)
        held = held.slice(cuts[-1])
    if held is not None and len(held):
        yield held


def by_blocks(df: DataFrame, before: int, after: int, names: list[str], compute: Callable[[Block], list[tuple[np.ndarray, np.ndarray]]], chunk: int) -> DataFrame:
    """df with double columns `names`: (values, which are not null) that `compute` tells for each row of a chunk with its halo.

    The frames of Spark go through all their rows anew for each row and statistic; here a chunk's frames are laid out as one matrix, bit by bit.
    """
    columns = df.columns
    wide = chunked(df, before, after, max(chunk, before, after)).repartition("series_id", "chunk").sortWithinPartitions("series_id", "chunk", "rn")

    def run(batches):
        for table in tables_of(batches):
            own = table.column("own")
            if not pa.compute.any(own).as_py():
                continue
            out = table.select(columns)
            for name, (values, some) in zip(names, compute(Block(table)), strict=True):
                out = out.append_column(name, pa.array(values, pa.float64(), mask=~some, from_pandas=False))
            yield from out.filter(own).to_batches()

    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    return wide.select(*columns, "chunk", "own").mapInArrow(run, schema)


def block_z(b: Block, c: str, size: int, least: int, min_std: float) -> tuple[np.ndarray, np.ndarray]:
    """local_z of a channel of a block."""
    lo, hi = -(size // 2), (size - 1) // 2
    n, mean, _ = b.moments(c, c, lo, hi)
    std, two = b.deviation(c, lo, hi)
    return np.abs(mean / np.maximum(np.where(two, std, min_std), min_std)), b.column(c)[1] & (n >= least)


def largest(each: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The largest of several columns row by row, nulls left out, NaN above all."""
    return np.max([np.where(some, v, -np.inf) for v, some in each], axis=0), np.any([some for _, some in each], axis=0)


def local_stats(f: Frames, c: str, size: int, least: int, min_std: float) -> tuple[Column, Column]:
    """Centred mean and sample deviation (floored at min_std), null with fewer than `least` values."""
    w = f.centred(size)
    enough = F.count(c).over(w) >= least
    std = F.greatest(F.coalesce(F.stddev_samp(c).over(w), F.lit(min_std)), F.lit(min_std))
    return F.when(enough, F.avg(c).over(w)), F.when(enough, std)


def local_z(df: DataFrame, columns: list[str], size: int, least: int = 1, min_std: float = 1e-6, chunk: int | None = None) -> DataFrame:
    """df with <channel>_z: distance from the centred mean in deviations."""

    def build(f: Frames) -> dict[str, Column]:
        out = {}
        for c in columns:
            mean, std = local_stats(f, c, size, least, min_std)
            out[f"{c}_z"] = F.abs((F.col(c) - mean) / std)
        return out

    if chunk is not None:
        return by_blocks(df, size // 2, size // 2, [f"{c}_z" for c in columns], lambda b: [block_z(b, c, size, least, min_std) for c in columns], chunk)
    return over_frames(df, size // 2, size // 2, build, chunk)


def trailing_features(f: Frames, columns: list[str], sizes: list[int]) -> dict[str, Column]:
    """rolling_mean_dev_<w> and rolling_std_<w>, means over channels; the deviation of a first row is null."""
    out = {}
    for size in sizes:
        w = f.trailing(size)
        out[f"rolling_mean_dev_{size}"] = row_mean([F.abs(F.col(c) - F.avg(c).over(w)) for c in columns])
        out[f"rolling_std_{size}"] = row_mean([F.stddev_samp(c).over(w) for c in columns])
    return out


def score_features(f: Frames, score: str, size: int = 51) -> dict[str, Column]:
    w = f.trailing(size)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return {"score_mean": zero(F.avg(score).over(w)), "score_std": zero(F.stddev_samp(score).over(w)), "score_diff": zero(F.col(score) - f.lag(score))}


def deltas(f: Frames, columns: list[str], lags: list[int]) -> dict[str, Column]:
    return {f"delta_{k}": F.coalesce(row_mean([F.abs(F.col(c) - f.lag(c, k)) for c in columns]), F.lit(0.0)) for k in lags}


def slope(f: Frames, columns: list[str], size: int = 10) -> dict[str, Column]:
    """Mean absolute least-squares slope of the `size` rows before; 0 where there are fewer."""
    middle = (size - 1) / 2
    norm = sum((k - middle) ** 2 for k in range(size))
    each = [F.abs(sum((F.lit(k - middle) * f.lag(c, size - k) for k in range(1, size)), F.lit(0 - middle) * f.lag(c, size)) / norm) for c in columns]
    return {"slope_magnitude": F.coalesce(row_mean(each), F.lit(0.0))}


def pair_correlation(f: Frames, a: str, b: str, size: int = 30, least: int = 10) -> Column:
    """Trailing correlation, 0 where undefined; written out, as corr() over a flat frame divides by zero."""
    w = f.trailing(size)
    spread = F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)
    value = F.try_divide(F.covar_pop(a, b).over(w), spread)
    return F.coalesce(F.when((F.count(a).over(w) >= least) & (spread > 1e-12), value), F.lit(0.0))


def cumulative(f: Frames, column: str, size: int = 10) -> Column:
    """Sum of the `size` rows before; 0 where there are fewer."""
    w = f.rows(-size, -1)
    return F.when(F.count(column).over(w) >= size, F.sum(column).over(w)).otherwise(0.0)


def forecast_weights(size: int = 50) -> np.ndarray:
    w = np.exp(np.linspace(-1, 0, size))
    return w / w.sum()


def forecast_error(df: DataFrame, columns: list[str], size: int = 50, chunk: int = 20_000) -> DataFrame:
    """df with error: mean absolute distance of the channels from a weighted mean of the `size` rows before; 0 for
    the first `size` rows of a series. A chunk and its halo are one matrix product in a task."""
    weights = forecast_weights(size)
    wide = chunked(df, size, 0, chunk)
    names = df.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", ignore_index=True)
        values = pdf[columns].to_numpy(dtype=float)
        error = np.zeros(len(pdf))
        if len(pdf) > size:
            windows = np.lib.stride_tricks.sliding_window_view(values, size, axis=0)[:-1]
            error[size:] = np.abs(values[size:] - windows @ weights).mean(axis=1)
        return pdf.assign(error=error)[pdf["own"].to_numpy()][[*names, "error"]]

    return wide.groupBy("series_id", "chunk").applyInPandas(run, added(df, "error"))


def ewma(df: DataFrame, column: str, span: int, chunk: int = 20_000, out: str = "smooth") -> DataFrame:
    """df with the adjusted exponential mean of a column over each series.

    Numerator and denominator are linear recurrences: a chunk gives its end values, a scan over the chunk table
    carries them on, and each chunk adds its carry.
    """
    q = 1 - 2 / (span + 1)
    rows = df.withColumn("chunk", F.floor(F.col("rn") / chunk))
    names = df.columns

    size = 128
    powers = q ** np.arange(size + 1)
    triangle = np.tril(q ** np.maximum(np.subtract.outer(np.arange(size), np.arange(size)), 0).astype(float))

    def recur(x: np.ndarray, start: float) -> np.ndarray:
        """y[i] = x[i] + q * y[i - 1], a block of values at once; only the carry goes from block to block."""
        blocks = np.zeros((-(-len(x) // size), size))
        blocks.ravel()[: len(x)] = x
        done, carry = blocks @ triangle.T, start
        for row in done:
            row += powers[1:] * carry
            carry = row[-1]
        return done.ravel()[: len(x)]

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("rn")[column].to_numpy(dtype=float)
        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "chunk": [pdf["chunk"].iloc[0]], "n": [len(x)], "top": [recur(x, 0.0)[-1]]})

    def carries(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk", ignore_index=True)
        top, bottom, tops, bottoms = 0.0, 0.0, [], []
        for n, end in zip(pdf["n"], pdf["top"], strict=True):
            tops.append(top)
            bottoms.append(bottom)
            top = end + q**n * top
            bottom = (1 - q**n) / (1 - q) + q**n * bottom
        return pdf[["series_id", "chunk"]].assign(top=tops, bottom=bottoms)

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", ignore_index=True)
        top = recur(pdf[column].to_numpy(dtype=float), float(pdf["top"].iloc[0]))
        bottom = recur(np.ones(len(pdf)), float(pdf["bottom"].iloc[0]))
        return pdf[names].assign(**{out: top / bottom})

    table = rows.groupBy("series_id", "chunk").applyInPandas(ends, "series_id long, chunk long, n long, top double")
    table = table.groupBy("series_id").applyInPandas(carries, "series_id long, chunk long, top double, bottom double")
    return rows.join(table, ["series_id", "chunk"]).groupBy("series_id", "chunk").applyInPandas(smooth, added(df, out))


def head_smoothed(df: DataFrame, column: str, head: int = 250, base: int = 500, few: bool = False) -> DataFrame:
    """The first `head` values of a series become the mean of its first `base`. few: series are few, their means are broadcast."""
    means = df.filter(F.col("rn") < base).groupBy("series_id").agg(F.avg(column).alias("_mean"))
    return df.join(F.broadcast(means) if few else means, "series_id").withColumn(column, F.when(F.col("rn") < head, F.col("_mean")).otherwise(F.col(column))).drop("_mean")


def window_samples(df: DataFrame, columns: list[str], size: int = 250, horizon: int = 10, predict: bool = False) -> DataFrame:
    """(series_id, start, inputs, targets): every start in 0..len - size - horizon - 1 of a fragment, the documented bound
    (without the horizon for prediction); short fragments give none and are dropped before frames are built."""
    ahead = 0 if predict else horizon
    sizes = df.groupBy("series_id").agg(F.count("*").alias("_len")).filter(F.col("_len") > size + ahead)
    f = Frames(["series_id"])
    x = F.struct(*columns)
    rows = df.join(sizes, "series_id").select("series_id", F.col("rn").alias("start"), "_len", F.collect_list(x).over(f.rows(0, size - 1)).alias("inputs"), F.collect_list(x).over(f.rows(size, size + horizon - 1)).alias("targets"))
    return rows.filter(F.col("start") < F.col("_len") - size - ahead).drop("_len")


def combine_horizons(forecasts: DataFrame, method: str = "mean") -> DataFrame:
    """(channel, target, y_hat) of forecasts (channel, step, horizon, y_hat) made at several steps for one target."""
    rows = forecasts.withColumn("target", F.col("step") + F.col("horizon"))
    if method == "first":
        return rows.filter("horizon = 0").select("channel", "target", "y_hat")
    weight = F.exp(-F.col("horizon").cast("double")) if method == "exp" else F.lit(1.0)
    return rows.groupBy("channel", "target").agg((F.sum(weight * F.col("y_hat")) / F.sum(weight)).alias("y_hat"))
