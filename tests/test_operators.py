import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from telesift.functions import scores as X
from telesift.jobs import forest, fusion, hypothesis, residual
from telesift.operators import events as E
from telesift.operators import metrics as M
from telesift.operators import prep as P
from telesift.operators import rolling as R
from telesift.operators import stats as S
from telesift.sources import telemetry as T


def series(spark, values, name="x", series_id=0):
    rows = [(series_id, i, i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"series_id long, rn long, id long, {name} double")


def flags(spark, text):
    rows = [(0, i, int(c)) for i, c in enumerate(text)]
    return spark.createDataFrame(rows, "series_id long, rn long, flag int")


def spans(df):
    return sorted((r.start_rn, r.end_rn) for r in df.collect())


def runs(bits):
    out, start = [], None
    for i, b in enumerate([*bits, 0]):
        if b and start is None:
            start = i
        if not b and start is not None:
            out.append((start, i - 1))
            start = None
    return out


@pytest.mark.parametrize("text", ["01101", "", "000", "111", "1", "10101", "1100111"])
@pytest.mark.parametrize("block", [2, 3, 1000])
def test_events_are_runs(spark, text, block):
    assert spans(E.extract(flags(spark, text), "flag", block=block)) == runs([int(c) for c in text])


def test_random_events_and_merging_across_blocks(spark):
    bits = np.random.default_rng(1).random(400) < 0.6
    df = flags(spark, "".join(str(int(b)) for b in bits))
    want = runs(bits)
    assert spans(E.extract(df, "flag", block=7)) == want
    assert spans(E.extract(df, "flag", min_run=2, block=7)) == [e for e in want if e[1] > e[0]]
    merged = []
    for a, b in want:
        if merged and a - merged[-1][1] - 1 <= 2:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    assert spans(E.merge(E.extract(df, "flag"), 2, block=7)) == merged


def test_the_two_postprocessing_rules(spark):
    df = flags(spark, "1101011")
    assert spans(E.prune_then_merge(df, "flag", 2, 2)) == [(0, 1), (5, 6)]
    scored = df.withColumn("score", F.col("flag").cast("double"))
    assert spans(E.merge_then_prune(scored, "score", 0.5, 2, 2)) == [(0, 6)]
    gap = spark.createDataFrame([(0, 0, 1), (0, 4, 5)], "series_id long, start_rn long, end_rn long")
    assert spans(E.merge(gap, 2)) == [(0, 5)] and spans(E.merge(gap, 1)) == [(0, 1), (4, 5)]


def test_marking_dilating_and_budget(spark):
    df = flags(spark, "0010000100")
    assert spans(E.dilate(df, "flag", 1)) == [(1, 3), (6, 8)] and spans(E.dilate(df, "flag", 3)) == [(0, 9)]
    marked = E.mark(df, E.dilate(df, "flag", 1), "m", bucket=2).orderBy("rn").collect()
    assert "".join(str(r.m) for r in marked) == "0111001110"
    open_end = E.mark(df, E.dilate(df, "flag", 1), "m", bucket=2, end_inclusive=False).orderBy("rn").collect()
    assert "".join(str(r.m) for r in open_end) == "0110001100"
    kept = E.budget(series(spark, [0.0, 1.0, 2.0, 3.0, 4.0]), "x", 0.5).orderBy("rn").collect()
    assert [r.x for r in kept] == [0, 0, 0, 3, 4]


def events(spark, pairs):
    return spark.createDataFrame([(0, a, b) for a, b in pairs], "series_id long, start_rn long, end_rn long")


def test_event_scores(spark):
    none, some = events(spark, []), events(spark, [(3, 4)])
    one = M.eventwise(none, none).first()
    assert (one.precision, one.recall, one.f05) == (1, 1, 1)
    one = M.eventwise(some, none).first()
    assert (one.precision, one.recall, one.f05) == (0, 0, 0)
    true, split = events(spark, [(0, 9)]), events(spark, [(0, 1), (4, 5)])
    assert M.eventwise(split, true).first().recall == 2 and M.eventwise(split, true, "matched_true").first().recall == 1
    counts = M.sequence_counts(split, true).first()
    assert (counts.tp, counts.fp, counts.fn) == (1, 0, 0)
    assert M.strict_eventwise(split, true).first().tp == 1


def test_greedy_matching_in_time_order(spark):
    predicted, true = events(spark, [(0, 10), (12, 13), (30, 31)]), events(spark, [(8, 20), (9, 10), (40, 41)])
    got = sorted((r.p_start, r.t_start, round(r.ratio, 6)) for r in M.greedy_matches(predicted, true).collect())
    assert got == [(0, 9, 1.0), (12, 8, 1.0)]


def test_thresholds_swept_at_once(spark):
    values = np.round(np.random.default_rng(2).random(200), 2)
    df = series(spark, [float(v) for v in values], "s")
    for strict in (False, True):
        got = {}
        for r in M.threshold_events(df, "s", M.grid(21), strict).collect():
            got.setdefault(r.threshold, []).append((r.start_rn, r.end_rn))
        for t in M.grid(21):
            assert sorted(got.get(t, [])) == runs(values > t if strict else values >= t)
    assert M.best_threshold(spark.createDataFrame([(0.2, 0.0), (0.1, 0.0)], "threshold double, f05 double")).first().threshold == 0.5


def test_auc_and_pointwise(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "s double, y int")
    assert M.roc_auc(df, "s", "y").first().auc == pytest.approx(0.875)
    one = M.pointwise(df.withColumn("p", (F.col("s") > 0.3).cast("int")), "p", "y").first()
    assert (one.tp, one.fp, one.fn) == (2, 1, 0)


@pytest.mark.parametrize("size", [3, 4, 10])
def test_chunked_frames_equal_pandas(spark, size):
    values = np.random.default_rng(3).normal(size=57)
    df = series(spark, [float(v) for v in values])
    build = lambda f: {"m": F.avg("x").over(f.centred(size)), "t": F.stddev_samp("x").over(f.trailing(size))}
    for chunk in (None, 10, 13):
        got = R.over_frames(df, size, size, build, chunk).orderBy("rn").toPandas()
        assert np.allclose(got["m"], pd.Series(values).rolling(size, center=True, min_periods=1).mean())
        assert np.allclose(got["t"].astype(float), pd.Series(values).rolling(size, min_periods=2).std(), equal_nan=True)


def test_ewma_and_forecast_in_chunks(spark):
    values = np.random.default_rng(4).normal(size=300)
    df = series(spark, [float(v) for v in values])
    want = pd.Series(values).ewm(span=25).mean()
    assert np.allclose(R.ewma(df, "x", 25, 37).orderBy("rn").toPandas()["smooth"], want)
    w = R.forecast_weights(50)
    want = [0.0] * 50 + [abs(values[i] - values[i - 50 : i] @ w) for i in range(50, 300)]
    assert np.allclose(R.forecast_error(df, ["x"], 50, 60).orderBy("rn").toPandas()["error"], want)
    assert R.forecast_error(df.limit(0), ["x"]).count() == 0


def test_slopes_and_flat_correlations(spark):
    df = series(spark, [float(i) * 2 for i in range(20)]).withColumn("y", F.lit(1.0))
    out = R.over_frames(df, 30, 0, lambda f: R.slope(f, ["x"]) | {"c": R.pair_correlation(f, "x", "y")}).orderBy("rn").collect()
    assert [round(r.slope_magnitude, 9) for r in out] == [0.0] * 10 + [2.0] * 10 and {r.c for r in out} == {0.0}


def test_window_samples_leave_out_short_fragments(spark):
    df = series(spark, [1.0] * 12).union(series(spark, [1.0] * 5, series_id=1))
    got = R.window_samples(df, ["x"], 4, 2).collect()
    assert sorted((r.series_id, r.start) for r in got) == [(0, i) for i in range(6)]
    assert all(len(r.inputs) == 4 and len(r.targets) == 2 for r in got)


def test_class_report_by_hand(spark):
    pairs = [(0, 0)] * 50 + [(0, 1)] * 5 + [(1, 0)] * 3 + [(1, 1)] * 7 + [(2, 0)] * 2 + [(None, 1), (1, None)]
    df = spark.createDataFrame(pairs, "label int, flag int")
    got = {r.name: tuple(r)[1:] for r in M.class_report(df, "flag", "label").collect()}
    p = {"0": 50 / 55, "1": 7 / 12, "2": 0.0}
    q = {"0": 50 / 55, "1": 7 / 10, "2": 0.0}
    f = {"0": 50 / 55, "1": 14 / 22, "2": 0.0}
    n = {"0": 55, "1": 10, "2": 2}
    want = {c: (p[c], q[c], f[c], n[c]) for c in n}
    want["accuracy"] = (57 / 67, 57 / 67, 57 / 67, 67)
    want["macro avg"] = (*[sum(x.values()) / 3 for x in (p, q, f)], 67)
    want["weighted avg"] = (*[sum(x[c] * n[c] for c in n) / 67 for x in (p, q, f)], 67)
    assert got.keys() == want.keys()
    for name, row in want.items():
        assert got[name] == pytest.approx(row)
    none = {r.name: tuple(r)[1:] for r in M.class_report(df.filter("false"), "flag", "label").collect()}
    assert none == {name: (0.0, 0.0, 0.0, 0) for name in ("accuracy", "macro avg", "weighted avg")}


def test_dense_index_and_splits(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1009).alias("id")).repartition(5)
    got = P.dense_index(df, "id").orderBy("rn").collect()
    assert [r.rn for r in got] == list(range(1000)) and [r.id for r in got] == sorted(r.id for r in got)
    assert (P.cut_position(10, 0.15), P.cut_position(10, 0.15, "ceil"), P.cut_position(10, 0.85, "share")) == (8, 8, 8)
    rows = df.withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    held = P.stratified_split(rows, "y").groupBy("y").agg(F.count("*").alias("n"), F.count_if("held_out").alias("k")).collect()
    assert all(r.k == round(0.2 * r.n) for r in held)
    with pytest.raises(ValueError):
        P.stratified_split(rows.filter("id = 0 or y = 0"), "y")
    assert P.valid_channels(["﻿b ", "a", "a", "z"], ["a", "b"]) == ["b", "a"]
    with pytest.raises(ValueError):
        P.require(df, ["missing"])


def test_statistics(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 1.0), (3.0, 1.0), (4.0, 0.0), (5.0, 1.0), (9.0, 1.0)], "a double, b double")
    assert {r.channel: r.is_binary for r in S.binary_channels(df, ["a", "b"]).collect()} == {"a": False, "b": True}
    scaled = {r.channel: (r.mean, r.std) for r in S.scaling_stats(df, ["a", "b"]).collect()}
    assert scaled["b"] == (0.0, 1.0) and scaled["a"][0] == pytest.approx(4)
    row = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0, 9.0)], list("abcdef"))
    assert row.select(X.row_percentile([F.col(c) for c in "abcdef"], 0.95).alias("p")).first().p == pytest.approx(8.0)
    constant = S.robust_scale(spark.createDataFrame([(2.0,), (2.0,)], "a double"), ["a"]).collect()
    assert [r.a for r in constant] == [0.0, 0.0]


def test_forest_ranks_an_outlier_first_whatever_the_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))] + [(400, 9.0, -9.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = [forest.score(x, ["a", "b"], forest.fit(x, ["a", "b"], trees=40)).orderBy("id").toPandas() for x in (df.repartition(2), df.repartition(5))]
    assert got[0]["s_iforest"].idxmax() == 400 and got[0]["s_iforest"].between(0, 1).all()
    assert np.allclose(got[0]["s_iforest"], got[1]["s_iforest"])


def test_dynamic_threshold_finds_a_bump():
    errors = np.abs(np.random.default_rng(6).normal(0.1, 0.01, 2100))
    errors[2050:2060] = 2.0
    assert 0.2 < residual.best_epsilon(errors) < 2
    got = residual.window_sequences(errors, 70, 5, 0.13)
    assert got and got[0][0] <= 2050 and got[0][1] >= 2059
    assert residual.pruned(np.array([5.0, 4.9, 1.0]), 0.95).tolist() == [True, True, False]


def test_dynamic_threshold_does_not_depend_on_blocks(spark):
    errors = np.abs(np.random.default_rng(7).normal(0.1, 0.01, 6000))
    errors[4000:4010] = 2.0
    df = series(spark, [float(v) for v in errors], "error")
    a, b = (sorted(map(tuple, residual.dynamic_thresholds(df, block=n).collect())) for n in (2100, 8400))
    assert a == b and a


def test_tails():
    assert hypothesis.t_tail(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert hypothesis.f_tail(4.0, 2, 10) == pytest.approx(1.8**-5)
    assert hypothesis.normal_tail(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert hypothesis.binomial_tail(3, 5, 0.5) == pytest.approx(0.5)


def test_pseudo_labels_and_fusion(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(a), float(a + rng.normal() * 0.01)) for i, a in enumerate(rng.random(300))]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    table = fusion.pseudo_labels(df, "a", "b")
    got = {r.pseudo: r["count"] for r in table.groupBy("pseudo").count().collect()}
    assert got[0] > 100 and 0 < got[1] < 30
    out, ranked = fusion.boosted(table, table, ["a", "b"], "pseudo", trees=3, depth=2)
    assert out.filter("flag = 1").count() > 0 and {n for n, _ in ranked} == {"a", "b"}


def test_groups_and_csv(spark, tmp_path):
    got = {tuple(r) for r in T.channel_groups(spark, '{"s": {"g": [{"key": "c1"}, {"key": "c2"}]}}').collect()}
    assert got == {("c1", "s", "g"), ("c2", "s", "g")}
    df = spark.createDataFrame([(1, 0.5, 1)], "timestamp long, channel_41 double, is_anomaly int")
    df.write.csv(f"{tmp_path}/x", header=True)
    back = T.read_csv(spark, f"{tmp_path}/x", T.csv_schema(df.columns))
    assert [f.dataType.typeName() for f in back.schema] == ["long", "float", "byte"]
