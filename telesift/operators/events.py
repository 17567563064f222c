"""Events: runs of flagged positions, merging, pruning, and the way back to rows.

An event table has (series_id, start_rn, end_rn), both ends included. Runs are found in chunks and only the
pieces that touch a chunk border are looked at over a whole series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telesift.operators.stats import exact_percentiles

EDGE = 100_000  # positions in a block


def length() -> Column:
    return F.col("end_rn") - F.col("start_rn") + 1


def merge(events: DataFrame, gap: int, keys: list[str] | None = None, block: int = EDGE) -> DataFrame:
    """Events of which no two have start - previous end - 1 <= gap; overlapping ones are merged as well.

    Merged first inside blocks of positions; then only the first and last event of every block, which
    can reach over a border, are merged along the series.
    """
    keys = keys or ["series_id"]
    rows = events.select(*keys, "start_rn", "end_rn").withColumn("_block", F.floor(F.col("start_rn") / block))
    local = _merge_along(rows, [*keys, "_block"], gap)
    order = Window.partitionBy(*keys, "_block")
    edge = (F.col("start_rn") == F.min("start_rn").over(order)) | (F.col("start_rn") == F.max("start_rn").over(order))
    local = local.withColumn("_edge", edge)
    joined = _merge_along(local.filter("_edge").drop("_block", "_edge"), keys, gap)
    return local.filter("not _edge").select(*keys, "start_rn", "end_rn").unionByName(joined)


def _merge_along(rows: DataFrame, keys: list[str], gap: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start_rn", "end_rn")
    reach = F.max("end_rn").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start_rn") - reach - 1 > gap).cast("int"), F.lit(1))
    rows = rows.withColumn("_new", new).withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_group").agg(F.min("start_rn").alias("start_rn"), F.max("end_rn").alias("end_rn")).drop("_group")


def extract(df: DataFrame, flag: str, min_run: int = 1, keys: list[str] | None = None, block: int = EDGE) -> DataFrame:
    """Events of consecutive positions rn with flag = 1, of min_run positions at least; null is no flag."""
    keys = keys or ["series_id"]
    rows = df.filter(F.col(flag) == 1).select(*keys, "rn").withColumn("_block", F.floor(F.col("rn") / block))
    rows = rows.withColumn("_run", F.col("rn") - F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("rn")))
    pieces = rows.groupBy(*keys, "_block", "_run").agg(F.min("rn").alias("start_rn"), F.max("rn").alias("end_rn"))
    return merge(pieces, 0, keys, block).filter(length() >= min_run)


def prune(events: DataFrame, shortest: int) -> DataFrame:
    return events.filter(length() >= shortest)


def prune_then_merge(df: DataFrame, flag: str, shortest: int = 3, gap: int = 2) -> DataFrame:
    return merge(prune(extract(df, flag), shortest), gap)


def merge_then_prune(df: DataFrame, score: str, above: float = 0.5, gap: int = 3, shortest: int = 5) -> DataFrame:
    """Events of score > above, merged if start - previous end <= gap, then only those long enough."""
    return prune(merge(extract(df.withColumn("_flag", (F.col(score) > above).cast("int")), "_flag"), gap - 1), shortest)


def _halved(position: Column, level: str) -> Column:
    """The number of the cell of a level that holds a position, for negative ones too."""
    return F.call_function("shiftright", position.cast("long"), F.col(level))


def cover(events: DataFrame, name: str = "cell") -> DataFrame:
    """events with (level, cell) rows: dyadic cells [cell * 2^level, (cell + 1) * 2^level) that make up [start_rn, end_rn] without overlap.

    An event of n positions gives at most 2 log2(n) rows, two of a level: the cell at its left end if that is odd, the one at its right end
    if that is even. Only levels whose cells are no longer than the event are looked at, so a short event costs little. An event whose
    end lies before its start has none.
    """
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    # one level more than needed: a logarithm may be rounded down
    rows = events.filter("start_rn <= end_rn").withColumn("level", F.explode(F.sequence(F.lit(0), (F.floor(F.log2(length())) + 1).cast("int"))))
    # the first cell that begins at the start or after it, and the one that holds the row after the end: cells before it end inside
    rows = rows.withColumns({"_up": _halved(F.col("start_rn") + size - 1, "level"), "_down": _halved(F.col("end_rn") + 1, "level")}).filter("_up < _down")
    odd = lambda c: F.col(c).bitwiseAND(F.lit(1)) == 1
    ends = F.array(F.when(odd("_up"), F.col("_up")), F.when(odd("_down"), F.col("_down") - 1))
    return rows.withColumn(name, F.explode(ends)).filter(F.col(name).isNotNull()).drop("_up", "_down")


def above(rows: DataFrame, position: str, levels: DataFrame) -> DataFrame:
    """rows with the (level, cell) that hold a position, one for each level of `levels`, a row with the array `levels` (64 numbers at most)."""
    out = rows.crossJoin(F.broadcast(levels)).withColumn("level", F.explode("levels")).drop("levels")
    return out.withColumn("cell", _halved(F.col(position), "level"))


def stabbed(points: DataFrame, position: str, events: DataFrame) -> DataFrame:
    """Points joined with every event of their series that holds them: each pair comes up in one cell. events: (_series, start_rn, end_rn, ...)."""
    cells = cover(events)
    there = cells.agg(F.collect_set("level").alias("levels"))
    asked = above(points, position, there)
    return asked.join(cells, (F.col("series_id") == F.col("_series")) & (asked["level"] == cells["level"]) & (asked["cell"] == cells["cell"])).drop("level", "cell", "_series")


def mark(df: DataFrame, events: DataFrame, name: str = "flag", bucket: int = 1_000, end_inclusive: bool = True) -> DataFrame:
    """df with name = 1 inside an event, else 0, one row for each of df's; events may be long, nested or repeated.

    Rows are joined by buckets of positions. A bucket in which an event begins or ends lists its parts there; whole buckets inside an
    event are found from dyadic cells over the buckets that df has, so a long event is not spread over them.
    """
    last = F.col("end_rn") if end_inclusive else F.col("end_rn") - 1
    events = events.select(F.col("series_id").alias("_series"), F.col("start_rn").alias("_start"), last.alias("_end")).filter("_start <= _end")
    at = lambda c: F.floor(F.col(c) / bucket).cast("long")
    ends = events.select("_series", "_start", "_end", F.explode(F.array_distinct(F.array(at("_start"), at("_end")))).alias("_bucket"))
    ends = ends.groupBy("_series", "_bucket").agg(F.collect_set(F.struct("_start", "_end")).alias("_parts"))
    inner = events.select("_series", (at("_start") + 1).alias("start_rn"), (at("_end") - 1).alias("end_rn")).filter("start_rn <= end_rn").distinct()
    there = df.select("series_id", at("rn").alias("_bucket")).distinct()
    whole = stabbed(there, "_bucket", inner).select(F.col("series_id").alias("_series"), "_bucket").distinct().withColumn("_whole", F.lit(True))
    spread = ends.join(whole, ["_series", "_bucket"], "full")
    names = df.columns
    on = (F.col("series_id") == F.col("_series")) & (at("rn") == F.col("_bucket"))
    within = F.exists(F.col("_parts"), lambda e: (F.col("rn") >= e["_start"]) & (F.col("rn") <= e["_end"]))
    inside = F.coalesce(F.col("_whole"), F.lit(False)) | F.coalesce(within, F.lit(False))
    return df.join(spread, on, "left").withColumn(name, inside.cast("int")).select(*names, name)


def keep_scores(df: DataFrame, score: str, events: DataFrame) -> DataFrame:
    """df with kept: the score inside events, 0 outside."""
    return mark(df, events, "_in").withColumn("kept", F.when(F.col("_in") == 1, F.col(score)).otherwise(0.0)).drop("_in")


def budget(df: DataFrame, column: str, share: float) -> DataFrame:
    """Only scores at or above the (1 - share) percentile of the positive ones stay; the others become 0."""
    limit = exact_percentiles(df.filter(F.col(column) > 0), {"_limit": (column, 1 - share)})
    return df.crossJoin(F.broadcast(limit)).withColumn(column, F.when(F.col(column) >= F.col("_limit"), F.col(column)).otherwise(0.0)).drop("_limit")


def dilate(df: DataFrame, flag: str, by: int) -> DataFrame:
    """Events of all positions within `by` of a flagged one, inside the series."""
    last = df.groupBy("series_id").agg(F.max("rn").alias("_last"))
    rows = df.filter(F.col(flag) == 1).join(last, "series_id")
    return merge(rows.select("series_id", F.greatest(F.col("rn") - by, F.lit(0)).alias("start_rn"), F.least(F.col("rn") + by, F.col("_last")).alias("end_rn")), 0)


def length_stats(events: DataFrame) -> DataFrame:
    n = length()
    return events.agg(F.count("*").alias("events"), F.avg(n).alias("mean"), F.percentile(n, F.lit(0.5)).alias("median"), F.stddev_pop(n).alias("std"), F.percentile(n, F.lit(0.95)).alias("p95"), F.max(n).alias("longest"))


def overlaps(predicted: DataFrame, true: DataFrame) -> DataFrame:
    """(series_id, p_start, p_end, t_start, t_end) of every overlapping pair, once: the later one of the two begins inside the other.

    Begins are looked up in the dyadic cells of the other side's events, so events of any length give few rows.
    """
    p, t = predicted.select("series_id", "start_rn", "end_rn").distinct(), true.select("series_id", "start_rn", "end_rn").distinct()

    def found(points: DataFrame, a: str, events: DataFrame, b: str) -> DataFrame:
        points = points.select("series_id", F.col("start_rn").alias(f"{a}_start"), F.col("end_rn").alias(f"{a}_end"))
        events = events.select(F.col("series_id").alias("_series"), "start_rn", "end_rn", F.col("start_rn").alias(f"{b}_start"), F.col("end_rn").alias(f"{b}_end"))
        return stabbed(points, f"{a}_start", events).select("series_id", "p_start", "p_end", "t_start", "t_end")

    return found(p, "p", t, "t").unionByName(found(t, "t", p, "p").filter("t_start > p_start"))
