"""Micro-batches of several files, and state that many series share."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from telesift.streaming import late, live

SCHEMA = "series_id long, rn long, ts timestamp, channel_41 double, flag int, batch int"


def rows_of(spark):
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i % 37 if i % 37 else None, i, at + dt.timedelta(minutes=i), float(i * i % 101), i % 2, i // 200) for i in range(600)], SCHEMA)


def test_a_micro_batch_is_several_files(spark, monkeypatch):
    monkeypatch.setattr(late, "FILE_ROWS", 40)
    rows = rows_of(spark)
    files = late.files_of(rows, "batch")
    assert files == 4
    stream = late.replayed(rows, "batch")
    _, told = late.run_batches(live.flag_rate(stream, "1 day", late="1 day"))
    folder = late.arrive(rows, "batch", files=files)
    assert len(spark.read.parquet(folder).inputFiles()) == 3 * files and told.rows == 600
    assert spark.read.parquet(folder).count() == 600 and told.batches in (3, 4)


def test_files_are_never_empty(spark, monkeypatch):
    monkeypatch.setattr(late, "FILE_ROWS", 1)
    same = spark.createDataFrame([(1, 5, b) for b in (0, 1) for _ in range(50)], "a int, c int, batch int")
    assert late.files_of(same, "batch") == 1 and late.files_of(same.filter("a > 1"), "batch") == 1


def test_series_that_share_a_state(spark, monkeypatch):
    monkeypatch.setattr(late, "FILE_ROWS", 40)
    got = {}
    for groups in (1, 5, 4_096):
        out, _ = late.run_batches(late.local_z(late.replayed(rows_of(spark), "batch"), "channel_41", 6, groups=groups))
        got[groups] = {(r.series_id, r.rn): r.z for r in out.collect()}
    ranked = rows_of(spark).withColumn("id", F.col("rn")).withColumn("rn", F.expr("row_number() OVER (PARTITION BY series_id ORDER BY rn) - 1").cast("long"))
    ids = {(r.series_id, r.rn): r.id for r in ranked.collect()}
    want = {(r.series_id, ids[r.series_id, r.rn]): r.z for r in late.local_z_batch(ranked, "channel_41", 6).collect()}
    assert all(x.keys() == want.keys() and np.allclose([x[k] for k in want], list(want.values())) for x in got.values())
