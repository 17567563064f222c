"""Summaries that can be merged: quantile sketches and correlation matrices, over partitions, days and micro-batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 2_048


def rank_error(size: int = SIZE) -> float:
    """How far the rank of a quantile of a sketch may lie from the wanted one, as a share of all rows, with 99 % confidence: the published bound of KLL sketches."""
    return 2.296 / size**0.9723


def quantile_sketch(df: DataFrame, columns: list[str], keys: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """(keys.., channel, n, sketch): a sketch of each column in one shuffle of a few kilobytes a partition and group.

    Null and NaN are left out; a column without values has a null sketch. n counts the values.
    """
    keys = keys or []
    value = F.when(~F.isnan("value"), F.col("value"))
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys, columns, "channel", "value").withColumn("value", value)
    return long.groupBy(*keys, "channel").agg(F.count("value").alias("n"), F.kll_sketch_agg_double("value", F.lit(size)).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys.., channel, n, sketch) of sketches made over parts of the rows, such as days, files or micro-batches; the error stays that of one sketch."""
    return sketches.filter("n > 0").groupBy(*(keys or []), "channel").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, shares: list[float]) -> DataFrame:
    """sketches with p<share in percent>: a value of the data whose rank is the wanted one up to rank_error."""
    names = {s: f"p{s * 100:g}".replace(".", "_") for s in shares}
    found = lambda s: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))))
    return sketches.withColumns({names[s]: found(s) for s in shares})


def sketched_median_mad(df: DataFrame, columns: list[str], size: int = SIZE) -> DataFrame:
    """(channel, median, mad) up to rank_error, in two passes of one shuffle each; the middle values are a row a channel."""
    medians = sketch_quantiles(quantile_sketch(df, columns, size=size), [0.5]).select("channel", F.col("p50").alias("median"))
    middle = {r["channel"]: r["median"] for r in medians.collect()}
    apart = df.select(*[F.abs(F.col(c) - F.lit(middle[c])).alias(c) for c in columns])
    return medians.join(sketch_quantiles(quantile_sketch(apart, columns, size=size), [0.5]).select("channel", F.col("p50").alias("mad")), "channel")


def rank_distance(df: DataFrame, found: DataFrame, shares: list[float]) -> DataFrame:
    """(channel, n, share, apart): how far found values p.. of (channel, n, p..) lie from their wanted ranks in df, as a share of rows, counted exactly."""
    names = {s: f"p{s * 100:g}".replace(".", "_") for s in shares}
    told = found.collect()  # a row a channel
    parts = []
    for r in told:
        for s, name in names.items():
            c, v = r["channel"], r[name]
            below, upto = F.count_if(F.col(c) < v), F.count_if(F.col(c) <= v)
            apart = F.greatest(F.lit(0.0), below / r["n"] - s, s - upto / r["n"])
            parts.append(F.struct(F.lit(c).alias("channel"), F.lit(r["n"]).alias("n"), F.lit(s).alias("share"), apart.alias("apart")))
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


@dataclass
class Moments:
    """For each pair of columns, over the rows that have both: their number n, the mean of the first, its squared distances, and the products of both distances."""

    n: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    product: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        """Of a block of rows, NaN where a value is missing: products of matrices, taken from values moved to their mean."""
        there = ~np.isnan(x)
        some = np.maximum(there.sum(axis=0), 1)
        pivot = np.where(there, x, 0.0).sum(axis=0) / some
        moved, w = np.where(there, x - pivot, 0.0), there.astype(float)
        n = w.T @ w
        total, square, product = moved.T @ w, (moved * moved).T @ w, moved.T @ moved
        mean = total / np.maximum(n, 1)
        return cls(n, pivot[:, None] + mean, square - total * mean, product - mean * mean.T * n)

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        share = other.n / np.maximum(n, 1)
        apart = other.mean - self.mean
        weight = self.n * share
        return Moments(n, self.mean + apart * share, self.square + other.square + apart * apart * weight, self.product + other.product + apart * apart.T * weight)

    def row(self) -> list[list[float]]:
        return [a.ravel().tolist() for a in (self.n, self.mean, self.square, self.product)]

    @classmethod
    def from_row(cls, parts, size: int) -> Moments:
        return cls(*[np.asarray(p, dtype=float).reshape(size, size) for p in parts])


MOMENTS = "part long, n array<double>, mean array<double>, square array<double>, product array<double>"


def moment_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row of Moments for each partition of df."""
    size = len(columns)

    def run(batches):
        from pyspark import TaskContext

        held = Moments(*[np.zeros((size, size)) for _ in range(4)])
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) if batch.num_rows else np.zeros((0, size))
            held = held + Moments.of(x)
        yield pa.RecordBatch.from_pandas(pd.DataFrame([(TaskContext.get().partitionId(), *held.row())], columns=["part", "n", "mean", "square", "product"]), preserve_index=False)

    return df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(run, MOMENTS)


def merged_moments(rows: DataFrame, size: int, fan: int = 64) -> DataFrame:
    """One row of Moments from those of all partitions (or days, or micro-batches): first `fan` at a time, then the rest of them."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        out = None
        for parts in pdf.sort_values("part")[["n", "mean", "square", "product"]].itertuples(index=False):
            one = Moments.from_row(parts, size)
            out = one if out is None else out + one
        return pd.DataFrame([(int(pdf["part"].min()), *out.row())], columns=["part", "n", "mean", "square", "product"])

    first = rows.groupBy(F.floor(F.col("part") / fan)).applyInPandas(add, MOMENTS)
    second = first.groupBy(F.floor(F.col("part") / (fan * fan))).applyInPandas(add, MOMENTS)
    return second.groupBy().applyInPandas(add, MOMENTS)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, correlation) for all pairs of columns, each by itself too, in one pass over df.

    Rows in which either value is null or NaN do not count for a pair; without spread in one of both the correlation is null.
    """
    size = len(columns)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        m = Moments.from_row(pdf[["n", "mean", "square", "product"]].iloc[0], size)
        with np.errstate(invalid="ignore", divide="ignore"):
            spread = np.sqrt(m.square * m.square.T)
            value = np.where((m.n > 0) & (spread > 0), m.product / spread, np.nan)
        a, b = np.meshgrid(columns, columns, indexing="ij")
        flat = [None if np.isnan(v) else float(min(1.0, max(-1.0, v))) for v in value.ravel()]
        return pd.DataFrame({"a": a.ravel(), "b": b.ravel(), "n": m.n.ravel().astype("int64"), "correlation": pd.Series(flat, dtype=object)})

    return merged_moments(moment_rows(df, columns), size).groupBy().applyInPandas(pairs, "a string, b string, n long, correlation double")
