"""Streams over several micro-batches: late rows, updates, sessions, state that expires and goes on from a checkpoint."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from telesift.sources.durable import place
from telesift.streaming import late, live

DAY = dt.timedelta(days=1)
BEGIN = dt.datetime(2024, 1, 1)
SCHEMA = "series_id long, rn long, ts timestamp, channel_41 double, flag int, batch int"


def at(days: float) -> dt.datetime:
    return BEGIN + days * DAY


@pytest.fixture(scope="module")
def arrivals():
    """(series_id, rn, ts, value, flag, batch): six micro-batches of two days each, some rows one or two batches late."""
    rng, rows = random.Random(4), []
    for rn in range(240):
        day = rn / 20
        batch = min(5, int(day // 2) + rng.choice([0, 0, 0, 0, 1, 2, 3]))
        rows.append((rn % 3, rn, at(day), round(rng.random() * 50, 3), int(rng.random() < 0.5), batch))
    return rows


def streamed(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return late.replay(spark, late.arrive(df, "batch"), df.drop("batch").schema)


def in_time(rows, ends, delay):
    """Rows whose end is after the watermark that their micro-batch refuses by: of all batches before the last one."""
    out = []
    for r in rows:
        seen = [x[2] for x in rows if x[5] <= r[5] - 2]
        if not seen or ends(r[2]) > max(seen) - delay:
            out.append(r)
    return out


def test_a_late_row_is_dropped_and_one_in_time_counts(spark):
    rows = [(0, 0, at(0.1), 1.0, 1, 0), (0, 1, at(9.1), 1.0, 0, 1), (0, 2, at(9.2), 1.0, 0, 2), (0, 3, at(0.2), 1.0, 1, 3), (0, 4, at(9.3), 1.0, 1, 3), (0, 5, at(19.0), 1.0, 1, 4)]
    out, told = late.run_batches(live.flag_rate(streamed(spark, rows), "1 day", late="1 day"))
    got = {(r.begin - BEGIN).days: (r.n, r.flags) for r in out.collect()}
    assert got == {0: (1, 1), 9: (3, 1)}
    assert told.late == 1 and told.rows == 6 and told.batches >= 5 and told.watermark.startswith("2024-01-19")


def test_windows_of_rows_in_time(spark, arrivals):
    out, told = late.run_batches(live.flag_rate(streamed(spark, arrivals), "1 day", late="1 day"))
    floor = lambda ts: dt.datetime(ts.year, ts.month, ts.day)
    want = {}
    for r in in_time(arrivals, lambda ts: floor(ts) + DAY, DAY):
        n, flags = want.get((r[0], floor(r[2])), (0, 0))
        want[r[0], floor(r[2])] = (n + 1, flags + r[4])
    closed = max(r[2] for r in arrivals) - DAY
    got = {(r.series_id, r.begin): (r.n, r.flags) for r in out.collect()}
    assert got == {k: v for k, v in want.items() if k[1] + DAY <= closed}
    assert told.late > 0 and sum(n for n, _ in want.values()) < len(arrivals)
    # every window in its last state, also those that are still open
    out, _ = late.run_batches(live.flag_rate(streamed(spark, arrivals), "1 day", late="1 day"), "update", ["series_id", "begin"])
    assert {(r.series_id, r.begin): (r.n, r.flags) for r in out.collect()} == want


def plain_sessions(rows, gap, delay):
    """One micro-batch after the other: refuse, join, close."""
    states, out = [], []
    for k in range(7):
        seen = [r[2] for r in rows if r[5] <= k - 2]
        refuse = max(seen) - delay if seen else dt.datetime.min
        seen = [r[2] for r in rows if r[5] <= k - 1]
        close = max(seen) - delay if seen else dt.datetime.min
        states += [(r[0], r[2], r[2] + gap, 1) for r in rows if r[5] == k and r[4] == 1 and r[2] + gap > refuse]
        joined = []
        for s in sorted(states):
            if joined and joined[-1][0] == s[0] and s[1] < joined[-1][2]:
                last = joined.pop()
                s = (s[0], last[1], max(last[2], s[2]), last[3] + s[3])
            joined.append(s)
        out += [s for s in joined if s[2] <= close]
        states = [s for s in joined if s[2] > close]
    return out


def test_sessions_close_by_the_watermark(spark, arrivals):
    # the watermark follows the flagged rows, which are the ones that the sessions see
    flagged = [r for r in arrivals if r[4] == 1]
    out, told = late.run_batches(live.sessions(streamed(spark, arrivals), "5 hours", late="1 day"))
    got = sorted((r.series_id, r.begin, r.finish, r.n) for r in out.collect())
    assert got == sorted(plain_sessions(flagged, dt.timedelta(hours=5), DAY)) and got
    assert told.late > 0


def ordered(arrivals):
    return [(*r[:5], min(2, int(r[1] // 80))) for r in arrivals]


def test_state_over_batches_and_a_restart_equals_the_table(spark, arrivals):
    rows = ordered(arrivals)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("channel_41", F.when(F.col("rn") % 90 < 60, F.col("channel_41")).otherwise(7.5))
    ranked = df.withColumn("rn", F.expr("row_number() OVER (PARTITION BY series_id ORDER BY rn) - 1").cast("long"))
    want = {(r.series_id, r.rn): r.z for r in late.local_z_batch(ranked, "channel_41", 12).collect()}
    schema = ranked.drop("batch").schema
    first, run = late.arrive(ranked.filter("batch < 2"), "batch"), place(spark, "z")
    out, told = late.run_batches(late.local_z(late.replay(spark, first, schema), "channel_41", 12), folder=run)
    assert told.rows == 160 and out.count() == 160
    late.arrive(ranked.filter("batch = 2"), "batch", first)
    out, told = late.run_batches(late.local_z(late.replay(spark, first, schema), "channel_41", 12), folder=run)
    assert told.rows == 80
    got = {(r.series_id, r.rn): r.z for r in out.collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    assert any(z > 0 for z in got.values())


def test_a_silent_series_begins_anew(spark):
    # series 0 is silent for nine days while series 1 goes on; its old values no longer count
    rows = [(0, i, at(0.01 * i), float(i), 0, 0) for i in range(5)] + [(1, i, at(9 + 0.01 * i), 1.0, 0, 1) for i in range(3)] + [(1, 9, at(9.5), 1.0, 0, 2), (0, 20, at(10), 100.0, 0, 3), (0, 21, at(10.1), 50.0, 0, 3), (0, 22, at(10.2), 90.0, 0, 3)]
    kept, _ = late.run_batches(late.local_z(streamed(spark, rows), "channel_41", 10, "1 hour", idle=30 * 86_400_000))
    gone, _ = late.run_batches(late.local_z(streamed(spark, rows), "channel_41", 10, "1 hour", idle=86_400_000))
    kept, gone = ({(r.series_id, r.rn): r.z for r in x.collect()} for x in (kept, gone))
    assert kept[0, 20] == pytest.approx(98 / np.std([0, 1, 2, 3, 4], ddof=1))
    assert gone[0, 20] == 0 and gone[0, 21] == 0 and gone[0, 22] == pytest.approx(15 / np.std([100, 50], ddof=1))
    assert {k: v for k, v in kept.items() if k[1] < 20} == {k: v for k, v in gone.items() if k[1] < 20}


def test_trailing_z_against_one_frame_after_the_other():
    rng = np.random.default_rng(1)
    for x in (rng.normal(1e6, 1, 200), np.repeat(rng.normal(size=20), 10), np.full(30, 0.1), np.array([]), np.array([5.0])):
        for start in (0, len(x) // 2):
            want = []
            for i in range(start, len(x)):
                frame = x[max(0, i - 7) : i]
                spread = np.std(frame, ddof=1) if len(frame) > 1 and len(set(frame)) > 1 else 0
                want.append(abs(x[i] - frame.mean()) / spread if spread else 0.0)
            assert np.allclose(late.trailing_z(x, 7, start), want, rtol=1e-6)
