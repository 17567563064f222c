"""Streams over several micro-batches: late rows, state that expires, and what a run tells about itself."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from telesift.operators.rolling import Frames, over_frames
from telesift.sources.durable import place, written

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Progress:
    """What the micro-batches of a run have seen.

    late counts what operators with state have refused as older than the watermark: rows, or for aggregations the
    groups of a task that its rows had been added up to before.
    """

    batches: int
    rows: int
    late: int
    watermark: str | None


FILE_ROWS, MOST_FILES = 50_000, 256  # rows of a file, about, and files of a micro-batch


def _dealt(rows: DataFrame, batch: str, files: int):
    """The number of the file that a row goes to, by a hash of all its columns."""
    return F.pmod(F.xxhash64(*[c for c in rows.columns if c != batch]), F.lit(files))


def files_of(rows: DataFrame, batch: str) -> int:
    """How many files each micro-batch can be written in: a power of two for which none of them is empty in any micro-batch, one for few rows."""
    found: dict = {}
    for k, at, n in rows.groupBy(batch, _dealt(rows, batch, MOST_FILES).alias("_at")).agg(F.count("*").alias("_n")).collect():  # MOST_FILES rows a batch
        found.setdefault(k, {})[at] = n
    files = MOST_FILES
    while files > 1 and (max(sum(x.values()) for x in found.values()) < (files - 1) * FILE_ROWS if found else True):
        files //= 2
    while files > 1 and any(len({at % files for at in x}) < files for x in found.values()):
        files //= 2
    return files


def arrive(rows: DataFrame, batch: str, folder: str | None = None, files: int = 1) -> str:
    """Write rows as `files` files (see files_of) for each value of `batch` in ascending order; the folder can be read as a stream.

    A value is what one trigger takes; values are few, and one after the other is written, as files come by age. The files of a value are written at once.
    """
    spark = rows.sparkSession
    folder = folder or place(spark, "arrivals")
    for (k,) in sorted(rows.select(batch).distinct().collect()):
        part = rows.filter(F.col(batch) == k)
        part = part.repartitionById(files, _dealt(rows, batch, files).cast("int")) if files > 1 else part.repartition(1)
        part.drop(batch).write.mode("append").parquet(folder)
    return folder


def replay(spark: SparkSession, folder: str, schema: T.StructType, files: int = 1) -> DataFrame:
    """The files of a folder as a stream, as many a micro-batch as it was written in, the oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def replayed(rows: DataFrame, batch: str) -> DataFrame:
    """rows as a stream of one micro-batch for each value of `batch`."""
    rows = written(rows)
    files = files_of(rows, batch)
    return replay(rows.sparkSession, arrive(rows, batch, files=files), rows.drop(batch).schema, files)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_batches(stream: DataFrame, mode: str = "append", keys: list[str] | None = None, folder: str | None = None) -> tuple[DataFrame, Progress]:
    """Run a stream over all that is there now, micro-batch by micro-batch, to (rows, progress).

    append: rows are written once, when they are final. update: each micro-batch is written in a folder of its own, which a
    repeated batch replaces, and a key's last row stands. A run with the folder of an earlier one goes on from its checkpoint.
    """
    spark = stream.sparkSession
    folder = folder or place(spark, "stream")
    path = f"{folder}/rows"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    with _setting(spark, STORE, ROCKS):
        if mode == "append":
            query = writer.format("parquet").option("path", path).start()
        else:
            query = writer.foreachBatch(lambda rows, k: rows.write.mode("overwrite").parquet(f"{path}/_batch={k}")).start()
        query.awaitTermination()
    told = query.recentProgress
    dropped = sum(s["numRowsDroppedByWatermark"] for p in told for s in p["stateOperators"])
    marks = [p["eventTime"]["watermark"] for p in told if "watermark" in (p["eventTime"] or {})]
    progress = Progress(len(told), sum(p["numInputRows"] for p in told), dropped, max(marks, default=None))
    if mode == "append":
        # a run without rows leaves no file
        spark.createDataFrame([], stream.schema).write.mode("append").parquet(path)
        return spark.read.schema(stream.schema).parquet(path), progress
    out = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])).parquet(path)
    rest = [c for c in stream.columns if c not in keys]
    last = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*stream.columns), progress


def trailing_z(x: np.ndarray, size: int, start: int) -> np.ndarray:
    """Distance of each value from `start` on from the mean of the `size` values before it, in their sample deviations; 0 without spread.

    Running sums over values moved to their mean; a frame of equal values is told by the number of changes inside it, not by rounded sums.
    """
    n = len(x)
    at = np.arange(start, n)
    lo = np.maximum(at - size, 0)
    count = at - lo
    moved = x - (x.mean() if n else 0.0)
    sums = np.concatenate([[0.0], np.cumsum(moved)])
    squares = np.concatenate([[0.0], np.cumsum(moved * moved)])
    changes = np.concatenate([[0, 0], np.cumsum(x[1:] != x[:-1])]) if n else np.zeros(1)
    total = sums[at] - sums[lo]
    some = np.maximum(count, 1)
    varies = (count > 1) & (changes[at] > changes[np.minimum(lo + 1, n)])
    spread = np.sqrt(np.maximum(squares[at] - squares[lo] - total * total / some, 0) / np.maximum(count - 1, 1))
    far = np.abs(moved[at] - total / some)
    return np.divide(far, spread, out=np.zeros(len(at)), where=varies & (spread > 0))


NOBODY = -(1 << 63)  # stands for a null series
KEPT = {"series": np.int64, "expires": np.int64, "size": np.int64, "values": np.float64}


class LocalZ(StatefulProcessor):
    """The last `size` values of each series of a group and when it is to be forgotten, as one value state, and a timer for the first of them to go.

    A series is one vector of its kept values and its new ones; a series silent for `idle` milliseconds of event time, by the watermark, begins anew.
    State is read and written once a group and micro-batch, not once a series.
    """

    def __init__(self, column: str, size: int, idle: int):
        self.column, self.size, self.idle = column, size, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("series", ", ".join(f"{k} binary" for k in KEPT))

    def _read(self) -> dict[int, tuple[int, np.ndarray]]:
        if not self.state.exists():
            return {}
        told = {k: np.frombuffer(bytes(raw), dtype=kind) for (k, kind), raw in zip(KEPT.items(), self.state.get(), strict=True)}
        values = np.split(told["values"], np.cumsum(told["size"])[:-1])
        return dict(zip(told["series"].tolist(), zip(told["expires"].tolist(), values, strict=True), strict=True))

    def _write(self, held: dict[int, tuple[int, np.ndarray]], before: int | None) -> None:
        """Keep what is held and set the timer anew, if the first to go is another one."""
        first = min((e for e, _ in held.values()), default=None)
        if before is not None and before != first:
            self.handle.deleteTimer(before)
        if first is None:
            self.state.clear()
            return
        if before != first:
            self.handle.registerTimer(first)
        values = [v for _, v in held.values()]
        columns = {"series": list(held), "expires": [e for e, _ in held.values()], "size": [len(v) for v in values], "values": np.concatenate(values)}
        self.state.update(tuple(np.asarray(columns[k], dtype=kind).tobytes() for k, kind in KEPT.items()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values(["series_id", "rn"], kind="stable", ignore_index=True)
        series, x = new["series_id"].to_numpy(), new[self.column].to_numpy(dtype=float)
        cuts = np.flatnonzero(np.diff(series)) + 1
        begins = np.concatenate([[0], cuts])
        heard = np.maximum.reduceat(new["ts"].astype("datetime64[ms]").to_numpy().astype(np.int64), begins) + self.idle
        held, z = self._read(), []
        before = min((e for e, _ in held.values()), default=None)
        for k, expires, own in zip(series[begins].tolist(), heard.tolist(), np.split(x, cuts), strict=True):
            last, kept = held.get(k, (expires, np.empty(0)))
            both = np.concatenate([kept, own])
            z.append(trailing_z(both, self.size, len(kept)))
            held[k] = max(last, expires), both[-self.size :]
        self._write(held, before)
        yield pd.DataFrame({"series_id": series, "rn": new["rn"].to_numpy(), "z": np.concatenate(z)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired, mark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        # the timer that has fired is gone by itself
        self._write({k: x for k, x in self._read().items() if x[0] > fired and x[0] >= mark}, None)
        yield pd.DataFrame({"series_id": [], "rn": [], "z": []}).astype({"series_id": "int64", "rn": "int64", "z": "float64"})

    def close(self) -> None:
        pass


def local_z(rows: DataFrame, column: str, size: int = 50, late: str = "1 day", idle: int = 30 * 86_400_000, groups: int = 4_096) -> DataFrame:
    """(series_id, rn, z) of a stream (series_id, rn, ts, column): see trailing_z. Rows older than the watermark are dropped.

    Rows of a micro-batch are taken in order of rn. Null values give a null z and none after them while they are in the frame. Series are dealt to `groups` by a
    hash; a stream that goes on from a checkpoint must have the same number.
    """
    watched = rows.select(F.coalesce("series_id", F.lit(NOBODY)).alias("series_id"), "rn", "ts", column).withWatermark("ts", late)
    grouped = watched.withColumn("_group", F.pmod(F.xxhash64("series_id"), F.lit(groups)))
    out = grouped.groupBy("_group").transformWithStateInPandas(LocalZ(column, size, idle), "series_id long, rn long, z double", "append", "EventTime")
    return out.withColumn("series_id", F.nullif("series_id", F.lit(NOBODY)))


def local_z_batch(df: DataFrame, column: str, size: int = 50, chunk: int | None = None) -> DataFrame:
    """The same z for a table."""

    def build(f: Frames) -> dict:
        w = f.rows(-size, -1)
        spread = F.when(F.min(column).over(w) < F.max(column).over(w), F.stddev_samp(column).over(w))
        return {"z": F.coalesce(F.abs(F.col(column) - F.avg(column).over(w)) / F.nullif(spread, F.lit(0.0)), F.lit(0.0))}

    return over_frames(df, size, 0, build, chunk).select("series_id", "rn", "z")
