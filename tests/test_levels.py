"""Sweeps over all thresholds at once, and covers of long events, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from telesift.jobs import detectors
from telesift.operators import events as E
from telesift.operators import levels as L
from telesift.operators import metrics as M


def plain_events(flags, shortest, gap):
    runs, begin = [], None
    for i, f in enumerate([*flags, 0]):
        if f and begin is None:
            begin = i
        elif not f and begin is not None:
            runs.append([begin, i - 1])
            begin = None
    out = []
    for a, b in (r for r in runs if r[1] - r[0] + 1 >= shortest):
        if out and a - out[-1][1] - 1 <= gap:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [tuple(r) for r in out]


def plain_greedy(predicted, true, least):
    used, tp = set(), 0
    for ps, pe in predicted:
        best, ratio = None, 0.0
        for t in true:
            ts, te = t
            shared = min(pe, te) - max(ps, ts) + 1
            if t in used or shared <= 0:
                continue
            now = shared / min(pe - ps + 1, te - ts + 1)
            if now > ratio:
                best, ratio = t, now
        if best is not None and ratio >= least:
            used.add(best)
            tp += 1
    return tp


def test_settled_levels_are_pruned_and_merged_runs():
    rng = np.random.default_rng(2)
    for shortest, gap in ((1, 0), (2, 8), (3, 2), (7, 0), (1, 3), (5, 1)):
        for n in (1, 2, 6, 40, 200):
            q = rng.integers(0, 5, n)
            got = L.settle(q, shortest, gap)
            for k in range(1, 5):
                want = plain_events(q >= k, shortest, gap)
                assert plain_events(got >= k, 1, 0) == want


@pytest.fixture(scope="module")
def table(spark):
    """Two series with smooth scores, ties, nulls and labels: (series_id, rn, s, label)."""
    rng, rows = random.Random(9), []
    for series, n in ((0, 700), (5, 130), (6, 1)):
        level, label = 0.5, 0
        for rn in range(n):
            level = min(1.0, max(0.0, level + rng.uniform(-0.15, 0.15)))
            label = int(rng.random() < (0.85 if label else 0.06))
            rows.append((series, rn, None if rng.random() < 0.03 else round(level, 2), label))
    return rows, spark.createDataFrame(rows, "series_id long, rn long, s double, label int").repartition(5).cache()


def expected(rows, thresholds, shortest, gap, strict, greedy=None):
    out = []
    for t in thresholds:
        n_pred = n_true = tp = 0
        for series in {r[0] for r in rows}:
            mine = [r for r in rows if r[0] == series]
            true = plain_events([r[3] for r in mine], 1, 0)
            found = plain_events([r[2] is not None and (r[2] > t if strict else r[2] >= t) for r in mine], shortest, gap)
            n_pred, n_true = n_pred + len(found), n_true + len(true)
            tp += plain_greedy(found, true, greedy) if greedy is not None else sum(any(a <= e and b >= s for s, e in true) for a, b in found)
        out.append((round(t, 9), n_pred, n_true, tp))
    return out


@pytest.mark.parametrize("shortest, gap, strict, block", [(2, 8, False, 50_000), (3, 2, True, 37), (1, 0, False, 64), (7, 0, True, 41)])
def test_calibration_against_loops(table, shortest, gap, strict, block):
    rows, df = table
    thresholds = [0.0, 0.1, 0.25, 0.5, 0.55, 0.8, 0.97, 1.0]
    true = E.extract(df, "label")
    got = L.threshold_counts(df, "s", true, thresholds, shortest, gap, strict, block).collect()
    want = expected(rows, thresholds, shortest, gap, strict)
    assert sorted((round(r.threshold, 9), r.n_pred, r.tp) for r in got) == [(t, p, tp) for t, p, _, tp in want]
    got = M.calibrate(df, "s", true, thresholds, shortest, gap, strict).collect()
    assert sorted((round(r.threshold, 9), r.n_pred, r.n_true, r.tp) for r in got) == want


@pytest.mark.parametrize("block", [53, 50_000])
def test_tree_has_every_event_once(table, block):
    rows, df = table
    thresholds = [0.2, 0.4, 0.5, 0.6, 0.9]
    tree = L.event_tree(df, "s", thresholds, 3, 2, True, block).collect()
    got = sorted((k, r.series_id, r.start_rn, r.end_rn) for r in tree for k in range(r.lo, r.hi + 1))
    want = []
    for k, t in enumerate(thresholds):
        for series in (0, 5, 6):
            flags = [r[2] is not None and r[2] > t for r in rows if r[0] == series]
            want += [(k, series, a, b) for a, b in plain_events(flags, 3, 2)]
    assert got == sorted(want)
    assert len({(r.series_id, r.start_rn, r.end_rn) for r in tree}) == len(tree)


def test_strict_sweep_against_loops(table):
    rows, df = table
    thresholds = [0.1, 0.3, 0.5, 0.7, 0.9]
    got = M.strict_sweep(df, "s", E.extract(df, "label"), thresholds, 3, 2).collect()
    assert sorted((round(r.threshold, 9), r.n_pred, r.n_true, r.tp) for r in got) == expected(rows, thresholds, 3, 2, True, greedy=0.2)


def of_model(rows, values, t, shortest, gap, least):
    """(n_pred, n_true, tp, median and greatest length) of one model at one threshold, series by series."""
    n_true = tp = 0
    lengths = []
    for series in sorted({r[0] for r in rows}):
        mine = [i for i, r in enumerate(rows) if r[0] == series]
        true = plain_events([rows[i][3] for i in mine], 1, 0)
        found = plain_events([values[i] is not None and values[i] > t for i in mine], shortest, gap)
        n_true, tp, lengths = n_true + len(true), tp + plain_greedy(found, true, least), lengths + [b - a + 1 for a, b in found]
    return len(lengths), n_true, tp, float(np.median(lengths)) if lengths else 0.0, max(lengths, default=0)


def of_models(rows):
    """Three models of the table's rows: its score, the score turned round, and one that is never above a threshold."""
    return {"s": [r[2] for r in rows], "turned": [None if r[2] is None else 1 - r[2] for r in rows], "low": [-1.0 for _ in rows]}


def test_sweep_of_models_against_loops(table):
    rows, df = table
    thresholds = [0.1, 0.3, 0.5, 0.7, 0.9]
    wide = df.withColumn("turned", 1 - F.col("s")).withColumn("low", F.lit(-1.0))
    got = {(r.model, round(r.threshold, 9)): (r.n_pred, r.n_true, r.tp, r.median_length, r.longest) for r in M.strict_sweeps(wide, ["s", "turned", "low"], E.extract(df, "label"), thresholds, 3, 2).collect()}
    values = of_models(rows)
    assert got == {(m, t): of_model(rows, values[m], t, 3, 2, 0.2) for m in values for t in thresholds}


def test_sweep_of_models_in_series_below_zero(table):
    rows, df = table
    far = df.withColumn("series_id", F.col("series_id") - 7)
    got = {(r.threshold, r.n_pred, r.n_true, r.tp) for r in M.strict_sweeps(far, ["s", "s"], E.extract(far, "label"), [0.3, 0.6], 3, 2).collect()}
    assert got == {(t, *of_model(rows, of_models(rows)["s"], t, 3, 2, 0.2)[:3]) for t in (0.3, 0.6)}


def test_table_of_models_takes_each_at_its_best_threshold(table):
    rows, df = table
    wide = df.withColumn("turned", 1 - F.col("s")).withColumn("low", F.lit(-1.0))
    steps = [0.02 + i * 0.6 / 24 for i in range(25)]
    want = {}
    for name, values in of_models(rows).items():
        best = None
        for t in steps:
            n_pred, n_true, tp, median, longest = of_model(rows, values, t, 2, 1, 0.2)
            p, r = tp / max(1, n_pred), tp / max(1, n_true)
            f = 1.25 * p * r / (0.25 * p + r) if p + r else 0.0
            if best is None or f > best[3] + 1e-12:
                best = (t, p, r, f, n_true, n_pred, median, longest)
        want[name] = best
    got = {r.model: r for r in detectors.compare_models(wide, list(want), "label", 25, 2, 1, (0.02, 0.62)).collect()}
    assert got.keys() == want.keys()
    for name, row in got.items():
        assert list(row)[1:] == pytest.approx(list(want[name]))
    none = detectors.compare_models(wide.filter("false"), ["s", "low"], "label", 5).collect()
    assert sorted((r.model, r.threshold, r.n_pred, r.n_true, r.f_beta) for r in none) == [("low", 0.02, 0, 0, 0.0), ("s", 0.02, 0, 0, 0.0)]


def test_sweep_of_nothing(spark, table):
    _, df = table
    none = df.filter("false")
    got = M.calibrate(none, "s", E.extract(none, "label"), [0.0, 0.5], 2, 3).collect()
    assert [(r.n_pred, r.n_true, r.tp, r.f05) for r in got] == [(0, 0, 0, 1.0)] * 2
    got = M.calibrate(df, "s", E.extract(none, "label"), [2.0], 2, 3).collect()
    assert [(r.n_pred, r.tp) for r in got] == [(0, 0)]


def test_cover_of_a_long_event_is_small(spark):
    events = spark.createDataFrame([(0, 3, 100_000_002), (1, 0, 0), (2, 5, 4), (3, -7, 9)], "series_id long, start_rn long, end_rn long")
    rows = E.cover(events).collect()
    assert sum(r.series_id == 0 for r in rows) < 60
    assert sum((1 << r.level) for r in rows if r.series_id == 0) == 100_000_000
    assert sorted((r.level, r.cell) for r in rows if r.series_id == 1) == [(0, 0)]
    assert not [r for r in rows if r.series_id == 2]
    assert sorted(p for r in rows if r.series_id == 3 for p in range(r.cell << r.level, (r.cell + 1) << r.level)) == list(range(-7, 10))


def test_overlaps_and_marks_of_nested_events(spark):
    rng = random.Random(12)

    def made(n):
        out = set()
        for _ in range(n):
            a = rng.randint(0, 5000)
            out.add((rng.randint(0, 1), a, a + int(2 ** (rng.random() * 12)) - 1))
        return sorted(out)

    p, t = made(60), [*made(50), (0, 0, 9_000), (1, 4_000, 4_000)]
    df = lambda rows: spark.createDataFrame(rows, "series_id long, start_rn long, end_rn long").repartition(3)
    got = sorted((r.series_id, r.p_start, r.p_end, r.t_start, r.t_end) for r in E.overlaps(df(p), df(t)).collect())
    assert got == sorted((s, a, b, c, e) for s, a, b in p for s2, c, e in t if s == s2 and a <= e and b >= c)
    rows = spark.range(0, 7_000, 3).select((F.col("id") % 2).alias("series_id"), F.col("id").alias("rn"))
    for inclusive in (True, False):
        for events in (p, t):
            got = {(r.series_id, r.rn): r.flag for r in E.mark(rows, df(events), end_inclusive=inclusive).collect()}
            want = {(i % 2, i): int(any(s == i % 2 and a <= i < b + inclusive for s, a, b in events)) for i in range(0, 7_000, 3)}
            assert got == want
    assert E.mark(rows, df(p)).count() == rows.count()


def test_a_cover_looks_at_no_level_longer_than_its_event(spark, monkeypatch):
    seen = []
    explode = E.F.explode
    monkeypatch.setattr(E.F, "explode", lambda c: seen.append(c) or explode(c))
    events = spark.range(64).selectExpr("0L as series_id", "id * 7 - 100 as start_rn", "id * 7 - 100 + id as end_rn")
    rows = E.cover(events).collect()
    assert events.select(F.max(F.size(seen[0]))).first()[0] <= 8  # 64 positions at most; 47 levels were looked at before
    for r in events.collect():
        mine = [x for x in rows if x.start_rn == r.start_rn]
        assert sorted(p for x in mine for p in range(x.cell << x.level, (x.cell + 1) << x.level)) == list(range(r.start_rn, r.end_rn + 1))


def test_only_events_that_share_a_true_one_are_matched_by_threshold(spark, monkeypatch):
    rng = np.random.default_rng(21)
    score = np.convolve(rng.random(1200), np.ones(4) / 4, "same")
    rows = [(i % 2, i // 2, float(score[i]), int((i // 2) % 23 < (9, 1)[i % 2])) for i in range(1200)]
    df = spark.createDataFrame(rows, "series_id long, rn long, s double, y int")
    true, steps = E.extract(df, "y"), [0.3 + i / 100 for i in range(30)]
    matched = []
    match = M.match_pairs
    monkeypatch.setattr(M, "match_pairs", lambda pairs, *more: matched.append(pairs.count()) or match(pairs, *more))
    got = {round(r.threshold, 6): (r.n_pred, r.tp) for r in M.strict_sweep(df, "s", true, steps, 1, 0).collect()}
    every = 0
    for t in steps:
        tp = pred = 0
        for s in (0, 1):
            found = plain_events([r[2] > t for r in rows if r[0] == s], 1, 0)
            real = plain_events([r[3] for r in rows if r[0] == s], 1, 0)
            pred, tp = pred + len(found), tp + plain_greedy(found, real, 0.2)
            every += sum(a <= e and b >= c for a, b in found for c, e in real)
        assert got[round(t, 6)] == (pred, tp)
    assert 0 < matched[0] < every


def test_true_rows_are_followed_over_blocks_without_any(spark):
    rng = np.random.default_rng(33)
    rows = [(s, i, float(v), int(rng.random() < 0.03)) for s in range(40) for i, v in enumerate(np.convolve(rng.random(160), np.ones(9) / 9, "same"))]
    df = spark.createDataFrame(rows, "series_id long, rn long, s double, y int")
    true, steps = E.extract(df, "y"), [0.3, 0.42, 0.5, 0.55]
    counted = L.threshold_counts(df, "s", true, steps, 2, 1, block=8)
    assert "FlatMapGroups" not in counted._jdf.queryExecution().toString()  # a call of Python a series took most of the time
    got = {round(r.threshold, 6): (r.n_pred, r.tp) for r in counted.collect()}
    for t in steps:
        pred = tp = 0
        for s in range(40):
            found = plain_events([r[2] >= t for r in rows if r[0] == s], 2, 1)
            real = plain_events([r[3] for r in rows if r[0] == s], 1, 0)
            pred, tp = pred + len(found), tp + sum(any(a <= e and b >= c for c, e in real) for a, b in found)
        assert got[t] == (pred, tp)


def test_event_tree_of_a_block_in_slabs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(s, i, float(v)) for s in range(3) for i, v in enumerate(np.convolve(rng.random(120), np.ones(5) / 5, "same"))]
    df = spark.createDataFrame(rows, "series_id long, rn long, s double")
    steps = [0.2 + i / 40 for i in range(25)]
    asked = lambda: sorted(tuple(r) for r in L.event_tree(df, "s", steps, 2, 1, block=50).select("series_id", "start_rn", "end_rn", "lo", "hi").collect())
    whole = asked()
    monkeypatch.setattr(L, "SLAB", 100)
    assert asked() == whole
    want = {(s, a, b, k) for k, t in enumerate(steps) for s in range(3) for a, b in plain_events([r[2] >= t for r in rows if r[0] == s], 2, 1)}
    assert {(s, a, b, k) for s, a, b, lo, hi in whole for k in range(lo, hi + 1)} == want
