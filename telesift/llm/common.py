"""Table access, durable intermediate tables and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of its own only where that is unset and all runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="telesift-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that `written` has made and nothing needs any more."""
    spark = df.sparkSession
    names = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for path in [p for p in _written if any(n.endswith(p) for n in names)]:
        _delete(spark, path)
        _written.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def drop_written(spark: SparkSession) -> int:
    """Delete the tables that `written` has made so far and say how many; only when no result that rests on them is needed any more."""
    count = len(_written)
    while _written:
        _delete(spark, _written.pop())
    return count


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, its session bound to Arrow batches of about BATCH_BYTES where no bound is set: 10,000 long texts a batch fill off-heap memory."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_LIMIT, None) is None:
        conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    return df


PARTS = 1_000  # a key with over a PARTS-th of all rows is dealt to several tasks


def dealt_join(many: DataFrame, few: DataFrame, counts: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """many joined with few on keys; a key that holds more than a PARTS-th of many's rows is dealt by a hash of the columns `by`.

    counts (keys.., n) are the rows of many by key, a written table. Fewer than PARTS keys are that frequent, so they are
    broadcast, and few's rows of such a key are copied to each of its parts, under 2 * PARTS parts in all. No part then has much more
    than a PARTS-th of the rows. how is inner or left_semi; null keys match nothing.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("n") * PARTS > total).select(*keys, F.ceil(F.col("n") * PARTS / max(1, total)).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    left = many.join(F.broadcast(hot), keys, "left").withColumn("_part", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("_parts")
    right = few.join(F.broadcast(hot), keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [*keys, "_part"], how).drop("_part")


def numbered(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns named c0, c1, ... in this order: for functions over batches, which do not take every name."""
    return df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])


def spare(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pick(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the named columns with the wanted types, whatever else the table holds."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()])


class Forest:
    """Union by smallest label over small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _local_forest(batches):
    """Replace the edges that arrive by a star per component of theirs; order does not matter to the whole."""
    for batch in batches:
        src, dst = (np.asarray(batch.column(i)) for i in (0, 1))
        ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        forest = Forest(len(ids))
        for a, b in zip(at[: len(src)].tolist(), at[len(src) :].tolist(), strict=True):
            forest.join(a, b)
        root = ids[np.array([forest.root(i) for i in range(len(ids))], dtype=np.int64)] if len(ids) else ids
        keep = root != ids
        yield pa.RecordBatch.from_arrays([pa.array(root[keep], pa.int64()), pa.array(ids[keep], pa.int64())], ["src", "dst"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id on an edge (src, dst): component is the smallest id reachable.

    Union-find inside each batch leaves a forest; alternating large-star and small-star steps on
    tables join the forests. A step moves edges, never whole components, so no task holds one.
    """
    edges = pick(edges, {"src": "long", "dst": "long"}).filter("src <> dst")
    edges = written(edges.mapInArrow(_local_forest, "src long, dst long").distinct())
    seen = None
    while True:
        both = edges.union(edges.select("dst", "src"))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"))
        large = both.filter("dst > src").join(low, "src").select(F.col("low").alias("src"), "dst").distinct().filter("src <> dst")
        # every remaining edge now points from a smaller src to a larger dst
        least = large.groupBy("dst").agg(F.min("src").alias("low"))
        small = large.join(least, "dst").select(F.col("low").alias("src"), F.explode(F.array("dst", "src")).alias("dst"))
        edges = written(small.filter("src <> dst").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.groupBy("dst").agg(F.min("src").alias("component")).select(F.col("dst").alias("id"), "component")
    tops = edges.select(F.col("src").alias("id")).distinct().join(roots.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
    return roots.union(tops)
