"""Training windows at their real size, mergeable summaries, and models that are fitted once and read back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from telesift.jobs import fusion, saved
from telesift.operators import sketches as K
from telesift.operators import windows as W
from telesift.operators.prep import dense_index
from telesift.sources.durable import place
from telesift.streaming import late


@pytest.fixture(scope="module")
def series(spark):
    """Two series of three channels, one with a null: rows and a table in no order."""
    rng = np.random.default_rng(3)
    rows = [(s, i, *[float(v) for v in rng.normal(size=3)]) for s, n in ((0, 900), (4, 260), (5, 261)) for i in range(n)]
    rows[7] = (*rows[7][:3], None, rows[7][4])
    return rows, spark.createDataFrame(rows, "series_id long, rn long, a double, b double, c double").repartition(5).cache()


@pytest.mark.parametrize("size, horizon, predict, stride, chunk", [(250, 10, False, 1, 300), (250, 10, True, 7, 20_000), (20, 3, False, 3, 64), (5, 1, False, 1, 6)])
def test_windows_against_slices(series, size, horizon, predict, stride, chunk):
    rows, df = series
    got = {(r.series_id, r.start): r for r in W.sample_windows(df, ["a", "b", "c"], size, horizon, predict, stride, chunk).collect()}
    want = 0
    for s in (0, 4, 5):
        x = np.array([r[2:] for r in rows if r[0] == s], dtype=float)
        ahead = 0 if predict else horizon
        for start in range(0, len(x) - size - ahead, 1):
            if start % stride:
                continue
            r = got[s, start]
            want += 1
            assert np.array_equal(r.inputs, x[start : start + size].ravel(), equal_nan=True)
            assert np.array_equal(r.targets, x[start + size : start + size + ahead].ravel(), equal_nan=True)
    assert len(got) == want
    assert W.sample_windows(df.filter("false"), ["a"], size, horizon).count() == 0


def test_training_set_cuts_inside_a_fragment(spark):
    rng = np.random.default_rng(8)
    rows = [(0, i, float(v), int(i % 2), int(i in (70, 71, 200))) for i, v in enumerate(rng.normal(5, 3, 300))]
    df = spark.createDataFrame(rows, "series_id long, rn long, x double, two int, label int").repartition(4)
    got = W.training_set(df, ["x", "two"], "label", 0.2, 10, 2, 50).collect()
    nominal = [r for r in rows if r[4] == 0]
    cut = round(0.8 * len(nominal))
    x = np.array([r[2] for r in nominal])
    values = np.stack([(x - x.mean()) / x.std(), [float(r[3]) for r in nominal]], axis=1)
    want = {}
    pieces = [(0, 70), (70, 198), (198, cut), (cut, len(nominal))]
    for lo, hi in pieces:
        for k in range(hi - lo - 12):
            want[lo + k] = ("train" if lo < cut else "validation", values[lo + k : lo + k + 10].ravel(), values[lo + k + 10 : lo + k + 12].ravel())
    assert {r.start for r in got} == set(want) and len(got) == len(want)
    for r in got:
        part, inputs, targets = want[r.start]
        assert r.part == part and np.allclose(r.inputs, inputs) and np.allclose(r.targets, targets)
    assert len({r.fragment for r in got}) == 3


def test_sketch_of_a_million_skewed_values(spark):
    n = 1_000_000
    rng = np.random.default_rng(2)
    # long tail, half of all rows equal, null and NaN beside them
    df = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, 7.0).otherwise(F.exp(F.rand(5) * 20)).alias("x"), F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 10 == 1, float("nan")).otherwise(F.pow(F.rand(6), 9)).alias("y"), (F.col("id") % 7).alias("day"))
    shares = [0.001, 0.01, 0.25, 0.5, 0.9, 0.99, 0.999]
    for found in (K.quantile_sketch(df, ["x", "y"]), K.merge_sketches(K.quantile_sketch(df, ["x", "y"], ["day"]))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        told = K.sketch_quantiles(found, shares)
        rows = K.rank_distance(df.withColumn("y", F.nanvl("y", F.lit(None))), told, shares).collect()
        assert {(r.channel, r.n) for r in rows} == {("x", n), ("y", n * 8 // 10)}
        assert max(r.apart for r in rows) <= K.rank_error()
    assert K.quantile_sketch(df, ["x"])._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1 and plan
    small = spark.createDataFrame([(float(v), None) for v in rng.integers(0, 50, 301)], "u double, v double")
    r = K.sketched_median_mad(small.select("u"), ["u"]).first()
    u = np.array([x.u for x in small.select("u").collect()])
    assert r.median == np.median(u) and r.mad == np.median(np.abs(u - r.median))
    assert K.merge_sketches(K.quantile_sketch(small, ["v"])).count() == 0
    assert K.sketch_quantiles(K.quantile_sketch(small, ["v"]), [0.5]).first().p50 is None


def test_correlation_matrix_of_58_channels(spark):
    rng = np.random.default_rng(4)
    mixed = rng.normal(size=(700, 58)) @ rng.normal(size=(58, 58)) + 1e7 * rng.normal(size=58)
    mixed[:, 57] = 3.0
    names = [f"ch{i}" for i in range(58)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in mixed], ", ".join(f"{n} double" for n in names)).repartition(9)
    got = K.correlation_matrix(df, names).collect()
    with np.errstate(all="ignore"):
        want = np.corrcoef(mixed.T)
    assert len(got) == 58 * 58
    for r in got:
        i, j = names.index(r.a), names.index(r.b)
        assert r.n == 700
        if 57 in (i, j):
            assert r.correlation is None
        else:
            assert r.correlation == pytest.approx(want[i, j], abs=1e-8)


def test_correlation_leaves_out_missing_values_by_pair(spark):
    import pandas as pd

    rng = np.random.default_rng(5)
    x = pd.DataFrame(rng.normal(size=(200, 3)), columns=["a", "b", "c"])
    x.loc[rng.random(200) < 0.3, "a"] = np.nan
    x.loc[rng.random(200) < 0.3, "c"] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x.to_numpy()], "a double, b double, c double").repartition(6)
    want = x.corr()
    for r in K.correlation_matrix(df, ["a", "b", "c"]).collect():
        assert r.correlation == pytest.approx(want.loc[r.a, r.b], abs=1e-12) and r.n == (x[r.a].notna() & x[r.b].notna()).sum()
    # merging by many small steps gives the same
    rows = K.moment_rows(df, ["a", "b", "c"])
    assert np.allclose(K.merged_moments(rows, 3, 2).first().product, K.merged_moments(rows, 3).first().product)
    assert all(r.correlation is None and r.n == 0 for r in K.correlation_matrix(df.filter("false"), ["a", "b"]).collect())


@pytest.fixture(scope="module")
def telemetry(spark):
    rng = np.random.default_rng(6)
    rows = [(0, i, i, *[float(v) for v in rng.normal(size=3) + (9 if i == 321 else 0)], int(i % 40 < 4)) for i in range(600)]
    return spark.createDataFrame(rows, "series_id long, rn long, id long, a double, b double, c double, label int").repartition(3).cache()


def test_saved_ensemble_scores_as_before(spark, telemetry):
    names = ["a", "b", "c"]
    model = saved.fit_ensemble(telemetry.filter("rn < 500"), names, size=20, count=15, samples=64)
    path = place(spark, "model")
    saved.save_ensemble(model, path)
    with pytest.raises(Exception):
        saved.save_ensemble(model, path)
    other = saved.load_ensemble(spark.newSession(), path)
    assert (other.columns, other.state, other.z0) == (model.columns, model.state, model.z0)
    columns = ["id", "s_global", "s_local", "s_iforest", "score"]
    told = lambda m, session: sorted(map(tuple, m.score(session.createDataFrame(telemetry.collect(), telemetry.schema)).select(columns).collect()))
    before = told(model, spark)
    assert before == told(other, spark.newSession()) and len(before) == 600
    assert dict((r[0], r[3]) for r in before)[321] == 1 and all(0 <= r[4] <= 1 for r in before)
    # frozen: a row's score does not depend on which rows are scored with it
    alone = {r.id: r.s_global for r in other.score(telemetry.filter("rn between 300 and 340"), local=False).collect()}
    assert all(alone[i] == g for i, g, *_ in before if i in alone)
    # and a stream gets the same
    stream = late.replay(spark, late.arrive(telemetry.withColumn("batch", F.floor(F.col("rn") / 200)), "batch"), telemetry.schema)
    out, progress = late.run_batches(other.score(stream, local=False).select("id", "s_global", "s_iforest"))
    assert {r.id: (r.s_global, r.s_iforest) for r in out.collect()} == {i: (g, f) for i, g, _, f, _ in before} and progress.rows == 600


def test_saved_trees_and_their_importances(spark, telemetry):
    model = fusion.fit_boosted(telemetry.withColumn("b", F.col("label") + F.col("b") / 10), ["a", "b", "c"], "label", trees=4, depth=2)
    path = place(spark, "trees")
    saved.save_boosted(model, path, spark)
    other = saved.load_boosted(spark, path)
    score = lambda m: sorted((r.id, r.fused, r.flag) for r in m.apply(telemetry).collect())
    assert score(model) == score(other) and other.ranked == model.ranked
    ranked = other.importances(spark).orderBy("rank").collect()
    assert [r.rank for r in ranked] == [1, 2, 3] and ranked[0].feature == "b" and sum(r.importance for r in ranked) == pytest.approx(1)
    with pytest.raises(ValueError):
        saved.load_ensemble(spark, path)


def test_supervised_threshold_is_the_best_one_of_the_last_part(spark, telemetry):
    rows = telemetry.withColumn("score", F.col("label") * 2 + F.col("a") / 10)
    out, best = fusion.supervised(rows, "score", "label", trees=4, depth=2, steps=20)
    best = best.first()
    assert best.n_true == 2 and best.f05 == 1 and best.tp == best.n_pred
    got = out.collect()
    assert len(got) == 600 and sum(r.is_flagged != r.label for r in got) < 12


def test_dense_index_is_what_windows_take(spark, series):
    _, df = series
    placed = dense_index(df.filter("series_id = 0").select(F.col("rn").alias("at"), "a"), "at").withColumn("series_id", F.lit(0).cast("long"))
    assert W.sample_windows(placed, ["a"], 250, 10, chunk=400).count() == 900 - 260
