"""Scoring and event merging on streams; every function also takes a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telesift.jobs.detectors import flag_any
from telesift.operators.stats import with_row
from telesift.sources.durable import place


def score_stream(rows: DataFrame, stats: DataFrame, columns: list[str], n: float = 5.0) -> DataFrame:
    """Rows with a flag by frozen statistics (one row); stateless."""
    return with_row(rows, stats).withColumn("flag", flag_any(columns, n)).drop(*stats.columns)


def flag_rate(rows: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(series_id, begin, n, flags) of tumbling or sliding windows of event time; rows later than `late` are dropped."""
    at = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = rows.withWatermark("ts", late).groupBy("series_id", at.alias("w")).agg(F.count("*").alias("n"), F.sum("flag").alias("flags"))
    return out.select("series_id", F.col("w.start").alias("begin"), "n", "flags")


def sessions(rows: DataFrame, gap: str, shortest: int = 1, late: str = "10 minutes") -> DataFrame:
    """(series_id, begin, finish, n): flagged rows no farther apart in time than gap, of at least `shortest` rows."""
    out = rows.filter("flag = 1").withWatermark("ts", late).groupBy("series_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.filter(F.col("n") >= shortest).select("series_id", F.col("w.start").alias("begin"), F.col("w.end").alias("finish"), "n")


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All rows now available of a stream, from Parquet in the folder that spark.checkpoint.dir names; mode: append or complete."""
    spark = stream.sparkSession
    folder = place(spark, f"stream-{name}")
    path = f"{folder}/rows"
    writer = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    # a stream without rows may write nothing
    spark.createDataFrame([], stream.schema).write.parquet(path)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
