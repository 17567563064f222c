"""Mixing sources to target weights by entropy balancing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telesift.llm.common import written

WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text):
    """Number of maximal runs of characters other than 0x20 and 0x09-0x0D; null is 0."""
    return F.coalesce(F.size(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, share: float, most: float, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size) with each source's target: `share` of all sizes dealt by weight, at most `most` times
    the source's own size, what is above dealt again by weight until none is above.

    One row per source, so the windows over all of them are small.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    rows = totals.withColumn("weight", weight).withColumn("full", most * F.col("source_size"))
    # Sources reach their limit in the order of limit / weight: so many words a unit of weight.
    order = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") >= F.col("full"))
    # The first source below its limit sets the level for it and all that follow.
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("full") / F.col("weight"), F.col("level")))).over(everything)["level"]
    target = F.when(F.col("capped"), F.col("full")).otherwise(F.least(F.col("full"), final * F.col("weight")))
    return rows.withColumn("target", target.cast("double")).select("source", "source_size", "target")


def tilts(cells: DataFrame, targets: DataFrame, most: float, tolerance: float = 1e-10) -> DataFrame:
    """(source, unit, tilt): the dual solution; a document of size s is taken `most * sigmoid(tilt * s / unit)` times.

    Among all rates between 0 and `most` these are the nearest, in relative entropy, to one half of `most`
    each (one copy each for most = 2) whose token total is the target. The dual is convex with one
    unknown a source; Newton steps from 0 come near the solution from one side only, so they need no
    line search and no limit. Each step is one aggregation of the (source, size) counts. A target at the limit or at
    0 has its solution at infinity and gets none.
    """
    scale = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("unit"))
    goals = targets.join(scale, targets["source"].eqNullSafe(scale["source"])).select(targets["source"], "source_size", "target", "unit", F.lit(0.0).alias("tilt"))
    goals = written(goals.filter((F.col("target") < most * F.col("source_size") * (1 - 1e-12)) & (F.col("target") > 0)))
    while True:
        part = F.lit(1.0) / (1 + F.exp(-F.col("tilt") * F.col("size") / F.col("unit")))
        mass = most * F.col("size") * F.col("n")
        at = cells.withColumnRenamed("source", "s").join(goals, F.col("s").eqNullSafe(F.col("source")))
        sums = at.groupBy("source").agg(F.sum(mass * part).alias("reached"), F.sum(mass * part * (1 - part) * F.col("size") / F.col("unit")).alias("slope"), F.first("unit").alias("unit"), F.first("tilt").alias("tilt"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
        gap = F.col("target") - F.col("reached")
        step = F.try_divide(gap, F.col("slope"))
        step = F.when((F.abs(gap) > tolerance * F.col("target")) & (F.abs(step) > 1e-14 * F.abs(F.col("tilt"))), step)
        goals = written(sums.withColumn("moved", step.isNotNull()).withColumn("tilt", F.col("tilt") + F.coalesce(step, F.lit(0.0))).select("source", "source_size", "target", "unit", "tilt", "moved"))
        if not goals.filter("moved").head(1):
            break
    return goals.select("source", "unit", "tilt")


def mix_sources(docs: DataFrame, share: float = 1.5, most: int = 2, weights: tuple = WEIGHTS, group: int = 256) -> DataFrame:
    """docs with size, source_size, target and copies: how often each document is taken.

    Rates come from `tilts`. They become whole copies by systematic rounding: within a source the rates
    are summed up in order of size, and a document is taken as often as the running sum passes a whole
    number; so a source's copies follow its rates to within one document and its words to within about
    the largest document. A document gets the whole number below or above its rate, at most `most`.
    The running sum comes in three levels: size classes of a source (an eighth of a doubling each),
    hash buckets of about `group` documents in a class, and documents; only a bucket is ordered in one task.

    docs needs doc_id, text and source; other columns stay (size, source_size, target and copies are
    replaced). Null or empty text has size 0 and gets one copy; null is a source of its own, the last;
    repeated rows are documents of their own; order is by size, doc_id and text, so reruns agree. An empty
    table gives no rows.
    """
    own = {"size", "source_size", "target", "copies"}
    # the columns of docs travel as one, so that no name of theirs meets one of the work below
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in own])
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"), whole.alias("whole"))
    placed = place_copies(rows, written(rows.select("doc_id", "source", "size", "tie")), share, most, weights, group)
    return placed.select("whole.*", "size", "source_size", "target", "copies")


def place_copies(rows: DataFrame, sized: DataFrame, share: float, most: int, weights: tuple, group: int) -> DataFrame:
    """rows (doc_id, source, size, tie) with copies; sized has the same rows, but only these columns."""
    zero, unit = F.lit(0).cast("decimal(38,0)"), F.lit(float(1 << 40))
    size_class = F.floor(8 * F.log2(F.col("size") + F.lit(1.0)))
    sizes = written(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = written(source_targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share, most, weights))
    solved = tilts(sizes, targets, most).withColumnRenamed("source", "s")
    goals = targets.join(solved, F.col("s").eqNullSafe(F.col("source")), "left").drop("s")
    classes = sizes.groupBy("source", size_class.alias("class")).agg(F.ceil(F.sum("n") / group).alias("buckets"))
    goals = written(classes.withColumnRenamed("source", "s").join(goals, F.col("s").eqNullSafe(F.col("source"))).drop("s"))
    # A target at its limit takes every document `most` times, a target of 0 none. Rates are whole numbers of
    # 2^-40 copies, so that sums do not depend on their order.
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("tilt").isNotNull(), most / (1 + F.exp(-F.col("tilt") * F.col("size") / F.col("unit")))).when(F.col("target") > 0, F.lit(float(most))).otherwise(0.0)

    def rated(df: DataFrame) -> DataFrame:
        found = df.withColumn("_class", size_class).withColumnRenamed("source", "_source")
        found = found.join(goals, F.col("_source").eqNullSafe(F.col("source")) & (F.col("_class") == F.col("class"))).drop("_source", "_class")
        return found.withColumn("_rate", F.round(rate * unit).cast("decimal(20,0)")).withColumn("_bucket", F.pmod(F.xxhash64("doc_id"), F.col("buckets")))

    def before(sums: DataFrame, *keys: str) -> DataFrame:
        order = Window.partitionBy("source", *keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
        return sums.withColumn("before", F.coalesce(F.sum("sum").over(order), zero))

    sums = written(rated(sized).groupBy("source", "class", "_bucket").agg(F.sum("_rate").alias("sum")))
    starts = before(sums.groupBy("source", "class").agg(F.sum("sum").alias("sum")), "class").select(F.col("source").alias("s"), F.col("class").alias("c"), F.col("before").alias("begin"))
    starts = before(sums, "class", "_bucket").join(starts, F.col("s").eqNullSafe(F.col("source")) & (F.col("c") == F.col("class")))
    starts = written(starts.select("s", "c", F.col("_bucket").alias("b"), (F.col("begin") + F.col("before")).cast("decimal(38,0)").alias("begin")))
    ordered = Window.partitionBy("source", "class", "_bucket").orderBy("size", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rated(rows).withColumn("_end", F.sum("_rate").over(ordered))
    placed = placed.join(starts, F.col("s").eqNullSafe(F.col("source")) & (F.col("c") == F.col("class")) & (F.col("b") == F.col("_bucket")))
    # half a copy ahead: the first document is rounded like any other
    whole = lambda x: F.floor((x + F.lit(1 << 39)) / F.lit(1 << 40))
    end = (F.col("begin") + F.col("_end")).cast("decimal(38,0)")
    placed = placed.withColumn("copies", (whole(end) - whole(end - F.col("_rate"))).cast("int"))
    return placed.drop("_rate", "_bucket", "_end", "unit", "tilt", "class", "buckets", "s", "c", "b", "begin")


def mixing_digest(docs: DataFrame) -> DataFrame:
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")))
    mixed = place_copies(sized, sized, 1.5, 2, WEIGHTS, 256)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
