"""Column selection, cleaning, row positions, splits and samples."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telesift.sources.durable import written


def valid_channels(raw: list[str], known: list[str], sort: bool = False) -> list[str]:
    """Known channels among raw names: trimmed, without byte order mark or repeats; all known if none is left."""
    names = list(dict.fromkeys(n.strip().lstrip("﻿").strip() for n in raw))
    kept = [n for n in names if n in known] or list(known)
    if not kept:
        raise ValueError("no channel is left")
    return sorted(kept) if sort else kept


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def to_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column as double; what is no number, or NaN, is null."""
    number = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    return df.withColumns({c: F.when(~F.isnan(number(c)), number(c)) for c in columns})


def before(df: DataFrame, order: str, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """df with <column>_before: the sum of a column over all rows of the same keys that come before by `order`, no task seeing them all.

    Rows are range-partitioned and written with their part, so that borders are drawn once; sums run inside a part,
    and the sums of the parts, some small rows each, give what lies before it. Rows of equal order are taken one after another.
    """
    keys = keys or []
    parts = written(df.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()))
    zero = lambda x: F.coalesce(x, F.lit(0))
    run = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(*keys, "_part").agg(*[F.sum(c).alias(c) for c in columns])
    begins = sums.select("_part", *keys, F.count("*").over(run).alias("_earlier"), *[zero(F.sum(c).over(run)).alias(f"_{c}_begin") for c in columns])
    # only the least keys of a part can have rows in an earlier one: a row a part at most, however many keys there are
    begins = begins.filter("_earlier > 0").select(F.col("_part").alias("_at"), *[F.col(k).alias(f"_{k}_at") for k in keys], *[f"_{c}_begin" for c in columns])
    inner = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col("_part") == F.col("_at"), *[F.col(k).eqNullSafe(F.col(f"_{k}_at")) for k in keys]]
    rows = parts.withColumns({f"_{c}_inner": zero(F.sum(c).over(inner)) for c in columns}).join(F.broadcast(begins), reduce(and_, same), "left")
    return rows.select(*df.columns, *[(zero(F.col(f"_{c}_begin")) + F.col(f"_{c}_inner")).alias(f"{c}_before") for c in columns])


def dense_index(df: DataFrame, order: str, name: str = "rn") -> DataFrame:
    """Position 0..n-1 by `order`, without bringing all rows to one task."""
    placed = before(df.withColumn("_one", F.lit(1)), order, ["_one"])
    return placed.withColumn(name, F.col("_one_before").cast("long")).drop("_one", "_one_before")


def chunked(df: DataFrame, before: int, after: int, size: int) -> DataFrame:
    """df with chunk and own: the rows of a chunk plus `before` and `after` neighbours (own false) of each side.

    A frame of that reach over (series_id, chunk) then sees all it needs, so one long series spreads over
    many tasks. before and after must not pass size.
    """
    if max(before, after) > size:
        raise ValueError("a chunk must be as long as the frame's reach")
    chunk, place = F.floor(F.col("rn") / size), F.pmod("rn", F.lit(size))
    to = F.array_compact(F.array(F.lit(0), F.when(place >= size - before, 1), F.when(place < after, -1)))
    return df.withColumn("_to", F.explode(to)).withColumn("chunk", (chunk + F.col("_to")).cast("long")).withColumn("own", F.col("_to") == 0).drop("_to")


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Rows of one (series_id, chunk) after the other, from batches in that order, if some of them are the block's own."""
    held = None
    for batch in batches:
        rows = batch.to_pandas()
        held = rows if held is None else pd.concat([held, rows], ignore_index=True)
        series, chunk = held["series_id"].to_numpy(), held["chunk"].to_numpy()
        cuts = [0, *(np.flatnonzero((series[1:] != series[:-1]) | (chunk[1:] != chunk[:-1])) + 1).tolist()]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            part = held.iloc[lo:hi]
            if part["own"].any():
                yield part
        held = held.iloc[cuts[-1] :]
    if held is not None and held["own"].any():
        yield held


def nominal(df: DataFrame, label: str = "is_anomaly") -> DataFrame:
    return df.filter(F.col(label) == 0)


def audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """(channel, rows, lo, hi, nulls) in one pass."""
    parts = []
    for c in columns:
        parts += [F.min(c).alias(f"{c}|lo"), F.max(c).alias(f"{c}|hi"), F.count_if(F.col(c).isNull()).alias(f"{c}|nulls")]
    one = df.agg(F.count("*").alias("rows"), *parts)
    pick = F.array(*[F.struct(F.lit(c).alias("channel"), F.col("rows"), F.col(f"{c}|lo").alias("lo"), F.col(f"{c}|hi").alias("hi"), F.col(f"{c}|nulls").alias("nulls")) for c in columns])
    return one.select(F.explode(pick).alias("x")).select("x.*")


def cut_position(n: int, fraction: float, rule: str = "floor") -> int:
    """First position of the later part: floor int(n * (1 - f)), ceil n - ceil(n * f), share int(n * f)."""
    if rule == "floor":
        return int(n * (1 - fraction))
    if rule == "ceil":
        return n - math.ceil(n * fraction)
    return int(n * fraction)


def chronological(df: DataFrame, cut: int) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col("rn") < cut), df.filter(F.col("rn") >= cut)


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables by position, as far as the shorter one goes."""
    return a.join(b, ["series_id", "rn"])


def seeded(seed: int) -> Column:
    return F.xxhash64(F.col("id"), F.lit(seed))


def sample_rows(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    return df.orderBy(seeded(seed), "id").limit(k)


def stratified_split(df: DataFrame, label: str, share: float = 0.2, seed: int = 42, buckets: int = 64) -> DataFrame:
    """df with held_out: the first round(share * n) rows of every class by a hash of id.

    Rank is found in hash buckets (a bucket is ordered in a task, the buckets' counts are summed up), so
    a frequent class does not meet in one task. A class of fewer than 2 rows is an error; below 10 rows the
    split is made over all classes together.
    """
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if counts and min(counts.values()) < 2:
        raise ValueError("a class has fewer than 2 rows")
    key = [label] if counts and min(counts.values()) >= 10 else []
    bucket = F.pmod(F.shiftrightunsigned(seeded(seed), 8), F.lit(buckets)).cast("int")
    rows = df.withColumn("_bucket", bucket)
    each = rows.groupBy(*key, "_bucket").agg(F.count("*").alias("_n"))
    begin = F.coalesce(F.sum("_n").over(Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("_begin", begin).withColumn("_all", F.sum("_n").over(Window.partitionBy(*key))).drop("_n")
    inner = F.row_number().over(Window.partitionBy(*key, "_bucket").orderBy(seeded(seed), "id"))
    rows = rows.withColumn("_inner", inner).join(F.broadcast(each), [*key, "_bucket"])
    return rows.withColumn("held_out", F.col("_begin") + F.col("_inner") <= F.round(F.col("_all") * share)).drop("_bucket", "_begin", "_all", "_inner")


def split_fragments(fragments: DataFrame, at: str) -> DataFrame:
    """(fragment, part, lo, hi) of fragments (fragment, lo, hi): one that holds the date goes to both parts, the date with it."""
    date = F.lit(at).cast("timestamp_ntz")
    early = fragments.filter(F.col("lo") <= date).select("fragment", F.lit("train").alias("part"), "lo", F.least("hi", date).alias("hi"))
    late = fragments.filter(F.col("hi") >= date).select("fragment", F.lit("validation").alias("part"), F.greatest("lo", date).alias("lo"), "hi")
    return early.filter("lo < hi or lo = hi").union(late)
