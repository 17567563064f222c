"""Telemetry tables: reading, writing, and the telemetry view of an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANNELS = [f"channel_{i}" for i in range(41, 47)]


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def csv_schema(names: list[str], key: str = "timestamp", key_type: T.DataType | None = None) -> T.StructType:
    """Types by name: the key column as given, labels (is_anomaly*) as bytes, every other column as float."""
    kind = lambda n: (key_type or T.LongType()) if n == key else T.ByteType() if n.startswith("is_anomaly") else T.FloatType()
    return T.StructType([T.StructField(n, kind(n)) for n in names])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=header, mode="FAILFAST")


def write_result(df: DataFrame, path: str, columns: list[str], kind: str = "parquet", mode: str = "error") -> None:
    """A result table by name: (id, is_anomaly), (id, score, ...) or (ID, Anomaly_Score)."""
    out = df.select(*columns).write.mode(mode)
    out.csv(path, header=True) if kind == "csv" else out.parquet(path)


def convert_parquet_to_csv(spark: SparkSession, source: str, target: str, columns: list[str]) -> None:
    spark.read.parquet(source).select(*columns).write.csv(target, header=True)


def to_timestamped(df: DataFrame, channels: list[str], label: str = "is_anomaly") -> DataFrame:
    """id becomes timestamp; channels stay, and the label if there is one."""
    return df.select(F.col("id").alias("timestamp"), *channels, *([label] if label in df.columns else []))


def write_matrix(df: DataFrame, path: str, columns: list[str], order: str = "rn") -> None:
    """A numeric matrix without a header; its first column is the row position, as files have no order."""
    df.select(order, *columns).write.csv(path)


def read_matrix(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField("rn", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in columns]])
    return spark.read.schema(schema).csv(path)


def channel_groups(spark: SparkSession, text: str) -> DataFrame:
    """(channel, subsystem, subgroup) of nested JSON subsystem -> subgroup -> [{key}]."""
    kind = T.MapType(T.StringType(), T.MapType(T.StringType(), T.ArrayType(T.StructType([T.StructField("key", T.StringType())]))))
    rows = spark.createDataFrame([(text,)], "text string").select(F.explode(F.from_json("text", kind)).alias("subsystem", "groups"))
    rows = rows.select("subsystem", F.explode("groups").alias("subgroup", "keys"))
    return rows.select(F.explode("keys").alias("k"), "subsystem", "subgroup").select(F.col("k.key").alias("channel"), "subsystem", "subgroup")


def any_channel(columns: list[str]) -> Column:
    """One 0/1 stream: the largest of several."""
    return F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in columns]) if len(columns) > 1 else F.coalesce(F.col(columns[0]), F.lit(0))


def telemetry(spark: SparkSession, sf_dir: str, single: bool = False) -> DataFrame:
    """(series_id, rn, id, ts, channel_41..46, is_anomaly) made of the events table.

    single: the whole table is one series and rn its dense event id; otherwise every user is a series.
    """
    k = F.get_json_object("props", "$.k").cast("long")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", k)
    series = F.lit(0).cast("long") if single else F.col("user_id")
    rn = F.col("event_id") if single else (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    return rows.select(
        series.alias("series_id"),
        rn.alias("rn"),
        F.col("event_id").alias("id"),
        "ts",
        F.col("value").alias("channel_41"),
        F.col("k").cast("double").alias("channel_42"),
        F.log(1 + F.col("value")).alias("channel_43"),
        F.hour("ts").cast("double").alias("channel_44"),
        (F.col("value") * F.col("k") / 100.0).alias("channel_45"),
        F.col("event_type").isin("click", "purchase").cast("double").alias("channel_46"),
        (F.col("event_type") == "error").cast("int").alias("is_anomaly"),
    )


TELEMETRY_SQL = """t0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
t AS (SELECT {series} AS series_id, {rn} AS rn, event_id AS id, ts, value AS channel_41, CAST(k AS DOUBLE) AS channel_42,
 ln(1 + value) AS channel_43, CAST(hour(ts) AS DOUBLE) AS channel_44, value * k / 100.0 AS channel_45,
 CASE WHEN event_type IN ('click', 'purchase') THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS channel_46,
 CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_anomaly FROM t0)"""
MULTI_SQL = TELEMETRY_SQL.format(series="user_id", rn="row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1")
SINGLE_SQL = TELEMETRY_SQL.format(series="CAST(0 AS BIGINT)", rn="event_id")
