"""Training windows of long series: inputs and targets as slices of one buffer of values a block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telesift.operators.prep import blocks_of, chunked, dense_index, nominal
from telesift.operators.stats import scaling_stats
from telesift.sources.durable import written

SAMPLES = "series_id long, start long, inputs array<double>, targets array<double>"
TOGETHER = 256  # samples of a batch; 256 of 250 rows and 6 channels are 3 MB


def sample_windows(df: DataFrame, columns: list[str], size: int = 250, horizon: int = 10, predict: bool = False, stride: int = 1, chunk: int = 20_000) -> DataFrame:
    """(series_id, start, inputs, targets) for every start of a series (series_id, rn, columns) that `size + horizon` rows and one more follow,
    the documented bound (predict: `size` rows and one more, no targets).

    inputs are size * len(columns) numbers, row after row, targets horizon * len(columns); null counts as NaN. A series is cut in chunks
    with the rows that follow, however long it is: in a task a chunk's values are one buffer, and a sample is a slice of it.
    stride: only starts divisible by it. Positions of a series follow one another and may begin anywhere; a shorter series gives nothing.
    """
    ahead = 0 if predict else horizon
    reach = size + ahead
    wide = chunked(df.select("series_id", "rn", *[F.col(c).cast("double").alias(c) for c in columns]), 0, reach, max(chunk, reach))
    wide = wide.repartition("series_id", "chunk").sortWithinPartitions("series_id", "chunk", "rn")
    n = len(columns)

    def slices(values: np.ndarray, begins: np.ndarray, rows: int) -> pa.Array:
        if not rows:
            return pa.array([[]] * len(begins), pa.list_(pa.float64()))
        flat = np.lib.stride_tricks.sliding_window_view(values, rows * n)[begins * n]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(begins) + 1, dtype=np.int32) * (rows * n)), pa.array(flat.ravel()))

    def run(batches):
        for rows in blocks_of(batches):
            values, rn = np.ascontiguousarray(rows[columns].to_numpy(dtype=float)).ravel(), rows["rn"].to_numpy()
            begins = np.flatnonzero(rows["own"].to_numpy())
            begins = begins[(begins + reach < len(rn)) & (rn[begins] % stride == 0)]
            series = rows["series_id"].iloc[0]
            for lo in range(0, len(begins), TOGETHER):
                at = begins[lo : lo + TOGETHER]
                parts = [pa.array(np.full(len(at), series)), pa.array(rn[at]), slices(values, at, size), slices(values, at + size, ahead)]
                yield pa.RecordBatch.from_arrays(parts, ["series_id", "start", "inputs", "targets"])

    return wide.mapInArrow(run, SAMPLES)


def training_set(df: DataFrame, columns: list[str], label: str, validation: float = 0.2, size: int = 250, horizon: int = 10, chunk: int = 20_000) -> DataFrame:
    """(part, fragment, start, inputs, targets): windows of the nominal fragments of one series (rn, columns, label), standardised.

    Rows with label 0 are numbered one after the other; each stretch of neighbours is a fragment. Statistics are those of all nominal
    rows (two-valued channels by least value and range). The first round((1 - validation) * n) rows are for training: a fragment that lies
    on the cut is cut, and no window reaches over it. start is the number of a window's first row among the nominal ones.
    """
    rows = nominal(df, label).select(F.col("rn").alias("_pos"), *columns)
    rows = written(dense_index(rows, "_pos"))
    stats = {r["channel"]: (r["mean"], r["std"]) for r in scaling_stats(rows, columns).collect()}  # a row a channel
    cut = round((1 - validation) * rows.count())
    rows = rows.withColumns({c: (F.col(c) - stats[c][0]) / stats[c][1] for c in columns})
    late = (F.col("rn") >= cut).cast("long")
    rows = rows.withColumn("series_id", (F.col("_pos") - F.col("rn")) * 2 + late)
    out = sample_windows(rows, columns, size, horizon, chunk=chunk)
    part = F.when(F.col("series_id") % 2 == 1, "validation").otherwise("train")
    return out.select(part.alias("part"), F.shiftright("series_id", 1).alias("fragment"), "start", "inputs", "targets")
