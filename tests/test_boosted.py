"""Boosted trees learn from different binned rows, and are walked batch by batch."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from telesift.jobs import fusion


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=3_000), rng.integers(0, 3, 3_000)
    y = (a + 0.5 * b + rng.normal(0, 0.5, 3_000) > 1).astype(int)
    return spark.createDataFrame([(i, float(p), float(q), int(z)) for i, (p, q, z) in enumerate(zip(a, b, y, strict=True))], "id long, a double, b double, y int").repartition(3)


def test_copies_of_rows_cost_no_more_rows_to_learn_from(spark, table, monkeypatch):
    monkeypatch.setattr(fusion, "LOTS", 100)
    borders = fusion.borders_of(table, ["a", "b"])
    monkeypatch.setattr(fusion, "borders_of", lambda *_: borders)
    seen = []
    real = fusion.lots
    monkeypatch.setattr(fusion, "lots", lambda *x: seen.append(real(*x)) or seen[-1])
    copies = table.crossJoin(spark.range(20).select(F.col("id").alias("copy")))
    for rows in (table, copies):
        fusion.fit_boosted(rows, ["a", "b"], "y", trees=2, depth=2)
    one, many = ({(r._a, r._b, r._y): (r.n, r.w) for r in x.groupBy("_a", "_b", "_y").agg(F.count("*").alias("n"), F.sum("_w").alias("w")).collect()} for x in seen)
    n, ones = table.count(), table.filter("y = 1").count()
    weight = lambda y: (n - ones) / ones if y == 1 else 1.0
    assert {k: v[0] for k, v in one.items()} == {k: v[0] for k, v in many.items()} and sum(v[0] for v in many.values()) <= 2 * 32 * 3 + 100
    assert sum(w / weight(k[2]) for k, (_, w) in one.items()) == pytest.approx(n)
    assert all(many[k][1] == pytest.approx(20 * one[k][1]) for k in one)


def test_few_values_are_all_told_apart(table):
    a, b = fusion.borders_of(table, ["a", "b"])
    assert b == [0.0, 1.0] and len(a) == 31
    below = [table.filter(F.col("a") <= x).count() / 3_000 for x in a]
    assert np.allclose(below, np.arange(1, 32) / 32, atol=2e-3)


def test_a_rare_value_of_few_is_told_apart(spark):
    rows = spark.createDataFrame([(float(i == 0), 0.0) for i in range(500)], "a double, b double")
    assert fusion.borders_of(rows, ["a", "b"]) == [[0.0], []]
    assert fusion.borders_of(rows.filter("a > 5"), ["a"]) == [[]]


def test_walked_trees_equal_the_models_own(table):
    model = fusion.fit_boosted(table, ["a", "b"], "y", trees=12, depth=4)
    assert "{" not in model.pipeline.stages[-1].toDebugString  # bins are in order, no categories
    rows = table.withColumn("a", F.when(F.col("id") % 50 != 0, F.col("a")))
    got = {r.id: (r.fused, r.flag) for r in model.apply(rows).collect()}
    want = {r.id: r.p for r in model.pipeline.transform(rows.fillna(0.0, subset=["a"])).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == pytest.approx(want[k], abs=1e-12) and got[k][1] == int(want[k] > 0.5) for k in want)
    right = sum(int(got[r.id][1] == r.y) for r in table.filter("id % 50 != 0").collect())
    assert right / (3_000 * 0.98) > 0.85
