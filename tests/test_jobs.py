"""p-values against published tables, and the forecast job over several channels and horizons."""

import numpy as np
import pandas as pd
import pytest

from telesift.jobs import hypothesis as H
from telesift.jobs import residual


def test_tails_against_published_tables():
    # critical values of t, F, the normal distribution and the two-sample Kolmogorov-Smirnov limit at the usual levels
    for t, df, p in ((2.228, 10, 0.05), (12.706, 1, 0.05), (2.845, 20, 0.01), (1.984, 100, 0.05)):
        assert H.t_tail(t, df) == pytest.approx(p, rel=2e-3) and H.t_tail(-t, df) == H.t_tail(t, df)
    for f, a, b, p in ((4.96, 1, 10, 0.05), (3.10, 3, 20, 0.05), (5.64, 5, 10, 0.01), (2.31, 10, 21, 0.05)):
        assert H.f_tail(f, a, b) == pytest.approx(p, rel=2e-2)
    assert H.normal_tail(1.959964) == pytest.approx(0.05, rel=1e-5) and H.normal_tail(-2.575829) == pytest.approx(0.01, rel=1e-5)
    n = 40_000
    for c, p in ((1.358, 0.05), (1.628, 0.01)):
        assert H.ks_tail(c * np.sqrt(2 / n), n, n) == pytest.approx(p, rel=2e-2)
    assert H.correlation_tail(0.632, 10) == pytest.approx(0.05, rel=5e-3) and H.correlation_tail(1.0, 10) == 0 and H.correlation_tail(0.5, 2) == 1
    assert H.paired_tail(2.262, 10) == pytest.approx(0.05, rel=2e-3)


def test_p_is_a_column_and_null_without_a_statistic(spark):
    rows = spark.createDataFrame([("x", 2.228, 10), ("y", None, 10), ("z", 0.0, 10)], "channel string, t double, df int")
    got = {r.channel: r.p for r in H.with_p(rows, H.t_tail, "t", "df").collect()}
    assert got["x"] == pytest.approx(0.05, rel=2e-3) and got["y"] is None and got["z"] == pytest.approx(1)


@pytest.fixture(scope="module")
def supplied(spark):
    """Two channels with a spike each, forecasts of horizons 0 and 1 from the two values before."""
    rng = np.random.default_rng(3)
    n = 2_600
    x = {c: np.cumsum(rng.normal(0, 0.02, n)) + rng.normal(0, 0.01, n) for c in ("a", "b")}
    x["a"][2_300:2_308] += 6
    x["b"][2_450:2_454] -= 9
    actual = [(c, i, float(v)) for c in x for i, v in enumerate(x[c])]
    forecasts = [(c, i + 1, h, float(v)) for c in x for i, v in enumerate(x[c]) for h in (0, 1) if i + 1 + h < n]
    return x, spark.createDataFrame(actual, "channel string, rn long, y double").repartition(3), spark.createDataFrame(forecasts, "channel string, step long, horizon int, y_hat double").repartition(3)


@pytest.mark.parametrize("method", ["first", "exp"])
def test_forecast_job_against_one_channel_at_a_time(spark, supplied, method):
    x, actual, forecasts = supplied
    flags, both = residual.forecast_job(actual, forecasts, method, 700)
    got = {(r.channel, r.rn): (r.error, r.flag) for r in flags.collect()}
    any_flag = {}
    for c, v in x.items():
        n = len(v)
        w = np.exp(-1.0) if method == "exp" else 0.0
        y_hat = v[:-1].copy()
        y_hat[1:] = (v[1:-1] + w * v[:-2]) / (1 + w)
        raw = pd.Series(np.abs(v[1:] - y_hat))
        error = raw.ewm(span=105).mean().to_numpy()
        error[:250] = error[:500].mean()
        assert [got[c, i][0] for i in range(250)] == [0.0] * 250 and (c, n - 1 + 250) not in got
        assert np.allclose([got[c, i + 250][0] for i in range(n - 1)], error)
        rows = spark.createDataFrame([(0, i, float(e), float(y)) for i, (e, y) in enumerate(zip(error, v[1:], strict=True))], "series_id long, rn long, error double, value double")
        want = np.zeros(n - 1 + 250, int)
        for r in residual.dynamic_thresholds(rows).collect():
            want[r.start_rn + 250 : r.end_rn + 250] = 1
        assert [got[c, i][1] for i in range(n - 1 + 250)] == want.tolist() and want.any()
        for i, f in enumerate(want):
            any_flag[i] = max(any_flag.get(i, 0), int(f))
    assert {r.rn: r.flag for r in both.collect()} == any_flag
