"""Positions, ranks and percentiles that no single task holds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from telesift.operators import prep as P
from telesift.operators import stats as S


def test_dense_index_with_payload_over_a_million_rows(spark):
    n = 1_200_000
    df = spark.range(n).select(((F.col("id") * 7919) % n * (F.col("id") % 3 + 1)).alias("key"), F.col("id").alias("payload"), F.lit("x").alias("more"))
    got = P.dense_index(df, "key")
    one = got.agg(F.count("*").alias("n"), F.countDistinct("rn").alias("d"), F.min("rn").alias("lo"), F.max("rn").alias("hi"), F.countDistinct("payload").alias("p")).first()
    assert tuple(one) == (n, n, 0, n - 1, n)
    keys = got.select("key", "rn").toPandas().sort_values("rn")["key"].to_numpy()
    assert (np.diff(keys) >= 0).all() and got.columns == ["key", "payload", "more", "rn"]


def test_sums_before_and_exact_percentiles(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(v), int(n)) for k in ("a", "b") for v, n in zip(np.round(rng.normal(size=500), 2), rng.integers(1, 5, 500))] + [("a", None, 1), ("c", 3.0, 2)]
    df = spark.createDataFrame(rows, "k string, v double, n long").repartition(7)
    for key in ("a", "b"):
        mine = sorted(v for k, v, _ in rows if k == key and v is not None)
        r = S.exact_percentiles(df, {"lo": ("v", 0.05), "mid": ("v", 0.5), "hi": ("v", 0.98), "top": ("v", 1.0)}, ["k"]).filter(F.col("k") == key).first()
        assert [r.lo, r.mid, r.hi, r.top] == pytest.approx(list(np.percentile(mine, [5, 50, 98, 100])))
    placed = P.before(df.filter("k = 'b'"), "v", ["n"]).orderBy("v", "n_before").collect()
    total = 0
    for r in placed:
        assert r.n_before == total
        total += r.n
    assert S.exact_percentiles(df.limit(0), {"x": ("v", 0.5)}).first().x is None


@pytest.mark.parametrize("direct", [200, 10**6])
def test_percentiles_by_narrowing(spark, direct):
    rng = np.random.default_rng(4)
    heavy = np.concatenate([np.full(4000, 2.5), np.full(3000, -1.0), rng.exponential(3.0, 3000)])
    both = [("ties", float(v), float(w)) for v, w in zip(heavy, rng.normal(1e9, 1e-3, 10_000), strict=True)]
    both += [(None, float(v), None) for v in range(7)] + [("one", 4.0, float("inf")), ("none", None, None)]
    both += [("nan", float("nan") if i < 40 else float(i), float(i)) for i in range(100)]
    df = spark.createDataFrame(both, "k string, v double, w double").repartition(6)
    shares = {"a": 0.0, "b": 0.013, "c": 0.3, "d": 0.5, "e": 0.9, "f": 1.0}
    wanted = {f"{c}_{n}": (c, s) for c in ("v", "w") for n, s in shares.items()}
    got = {r["k"]: r for r in S.exact_percentiles(df, wanted, ["k"], direct).collect()}
    assert set(got) == {"ties", None, "one", "none", "nan"}
    for c, i in (("v", 1), ("w", 2)):
        for k in ("ties", None, "one", "nan"):
            values = np.sort([r[i] for r in both if r[0] == k and r[i] is not None])
            for n, share in shares.items():
                if not len(values):
                    assert got[k][f"{c}_{n}"] is None
                    continue
                at = share * (len(values) - 1)
                lo, hi = values[int(np.floor(at))], values[int(np.ceil(at))]
                want = lo if at == int(at) else (np.ceil(at) - at) * lo + (at - np.floor(at)) * hi
                assert got[k][f"{c}_{n}"] == pytest.approx(want, rel=1e-15, nan_ok=True), (k, c, n)
    assert all(got["none"][n] is None for n in wanted)
    whole = S.exact_percentiles(df.filter("k = 'ties'"), wanted, direct=direct).first()
    assert whole.asDict() == {n: got["ties"][n] for n in wanted}


def test_strict_sweep_equals_one_threshold_at_a_time(spark):
    from telesift.operators import events as E
    from telesift.operators import metrics as M

    rng = np.random.default_rng(9)
    score = np.clip(np.convolve(rng.random(900), np.ones(6) / 6, "same"), 0, 1)
    rows = [(i % 3, i // 3, float(score[i]), int((i // 3) % 37 < 6)) for i in range(900)]
    df = spark.createDataFrame(rows, "series_id long, rn long, s double, y int")
    true, steps = E.extract(df, "y"), [0.4, 0.5, 0.55, 0.6]
    got = {round(r.threshold, 6): (r.n_pred, r.tp, round(r.f_beta, 9)) for r in M.strict_sweep(df, "s", true, steps, 2, 1).collect()}
    for t in steps:
        flagged = df.withColumn("hit", (F.col("s") > t).cast("int"))
        one = M.strict_eventwise(E.prune_then_merge(flagged, "hit", 2, 1), true).first()
        assert got[t] == (one.n_pred, one.tp, round(one.f_beta, 9))


def test_sums_before_with_many_keys_a_hot_one_and_no_key(spark):
    rng = random.Random(4)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 400}", i, rng.randint(0, 9)) for i in range(6000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at long, n long").repartition(7)
    got = {(r.k, r.at): r.n_before for r in P.before(df, "at", ["n"], ["k"]).collect()}
    want, sums = {}, {}
    for k, at, n in sorted(rows, key=lambda r: r[1]):
        want[k, at] = sums.get(k, 0)
        sums[k] = sums.get(k, 0) + n
    assert got == want


def test_what_is_broadcast_for_sums_before_does_not_grow_with_keys(spark, monkeypatch):
    df = spark.range(5000).selectExpr("id % 2500 as k", "id as at", "1L as n").repartition(4)
    sent = []
    monkeypatch.setattr(P.F, "broadcast", lambda x: sent.append(x) or x)
    assert P.before(df, "at", ["n"], ["k"]).agg(F.sum("n_before")).first()[0] == 2500
    assert sent[0].count() <= 4
