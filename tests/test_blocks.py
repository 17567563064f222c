"""Frames laid out by numpy, a chunk at a time, against Spark's own frames."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from telesift.jobs import detectors, forest, fusion
from telesift.jobs import queries as Q
from telesift.operators import rolling as R


def odd_rows(n=700):
    """Values with nulls, NaN, equal runs and a far one."""
    rng = random.Random(8)
    rows = []
    for i in range(n):
        v = None if rng.random() < 0.05 else 3.3 if 200 < i < 330 else rng.expovariate(0.05) + (1e7 if i == 450 else 0)
        w = None if i < 40 or rng.random() < 0.02 else float("nan") if i == 600 else float(i // 90)
        rows.append((i % 2 if i > 500 else 0, i, i, v, w))
    seen = {}
    out = []
    for s, _, i, v, w in rows:
        out.append((s, seen.setdefault(s, 0), i, v, w))
        seen[s] += 1
    return out


def odd(spark, n=700):
    return spark.createDataFrame(odd_rows(n), "series_id long, rn long, id long, v double, w double").repartition(5)


def same(a, b):
    if a is None or b is None:
        return a is b
    return (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, rel=1e-7, abs=1e-7)


def agree(a, b, names):
    a, b = ({r["id"]: r for r in x.collect()} for x in (a, b))
    assert a.keys() == b.keys()
    for i in a:
        for c in names:
            assert same(a[i][c], b[i][c]), (i, c, a[i][c], b[i][c])


@pytest.mark.parametrize("size, least", [(10, 1), (7, 3), (50, 12)])
def test_local_z_by_blocks_equals_frames(spark, size, least):
    df = odd(spark)
    got = R.local_z(df, ["v", "w"], size, least, 1e-6, chunk=60)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()  # rows times frame length, in one statistic after the other
    agree(got, R.local_z(df, ["v", "w"], size, least, 1e-6), ["v_z", "w_z"])


def test_grid_of_all_channels_lays_frames_out(spark):
    rng = np.random.default_rng(3)
    rows = [(0, i, float(rng.exponential(9)), None if i % 17 == 0 else float(i // 100)) for i in range(900)]
    df = spark.createDataFrame(rows, "series_id long, rn long, v double, w double")
    cells = Q.grid_cells(df, ["v", "w"])
    assert "Window" not in cells._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for w in Q.GRID_WINDOWS:
        z = R.local_z(df, ["v", "w"], w).select(F.greatest("v_z", "w_z").alias("z"))
        want |= {(w, t): z.filter(F.col("z") > t).count() for t in Q.GRID_LIMITS}
    assert {(r["size"], r["threshold"]): r["flags"] for r in cells.collect()} == want


def test_features_by_blocks_equal_frames(spark):
    rng = random.Random(3)
    rows = odd(spark).withColumns({"p": F.col("v") % 7 + F.col("rn") % 3, "q": F.coalesce("p", F.col("v"), F.lit(1.0)) * 2, "a": F.col("rn") / 100.0, "b": F.lit(rng.random())})
    names, columns = fusion.FEATURES, ["q", "p", "w", "v"]
    got = fusion.features(rows, columns, "a", "b", chunk=90)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    agree(got, fusion.features(rows, columns, "a", "b"), names)


def test_forest_scores_are_mean_paths_and_made_once(spark):
    rng = np.random.default_rng(2)
    rows = [(0, i, i, float(rng.normal()), None if i % 9 == 0 else float(rng.normal())) for i in range(400)]
    df = spark.createDataFrame(rows, "series_id long, rn long, id long, v double, w double")
    trees = forest.written(forest.fit(df, ["v", "w"], trees=12, max_samples=64))
    nodes = {(r.tree, r.node): r for r in trees.collect()}
    scored = forest.score(df, ["v", "w"], trees, 64)
    for r in scored.collect():
        x, total = (r.v, r.w or 0.0), 0.0
        for t in range(12):
            n, depth = nodes[t, 0], 0
            while n.feature >= 0:
                n, depth = nodes[t, n.left if x[n.feature] < n.border else n.right], depth + 1
            total += depth + float(forest.average_path(np.array([n.size]))[0])
        assert r.s_iforest == pytest.approx(2 ** (-total / 12 / float(forest.average_path(np.array([64]))[0])), rel=1e-12)
    out = detectors.predict(scored.withColumn("score", F.col("s_iforest")), 0.5)
    assert "PythonUDF" not in out._jdf.queryExecution().toString() and "ArrowEval" not in out._jdf.queryExecution().toString()  # read from what was written
