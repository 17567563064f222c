"""Dynamic thresholds against a plain version that goes through a whole series window by window."""

import numpy as np
import pytest

from telesift.jobs import residual


def plain(e, y, batch=70, history=30, buffer=100, p=0.13, least=0.05):
    n = len(e)
    while history > 1 and n < batch * history:
        history -= 1
    count = max(1, (n - batch * history) // batch)
    every: list[int] = []

    def groups(points):
        out = []
        for i in sorted(points):
            if out and i == out[-1][-1] + 1:
                out[-1].append(i)
            else:
                out.append([i])
        return out

    for k in range(count):
        begin, end = k * batch, n if k == count - 1 else (history + k) * batch
        w, v = e[begin:end], y[begin:end]
        mean, sd, size = w.mean(), w.std(), end - begin
        spread = np.percentile(v, 95) - np.percentile(v, 5)
        if not (sd > 0.05 * v.std() or w.max() > 0.05 * spread) or size < buffer or w.max() <= least:
            continue
        kept = set()
        for side in (w, mean + (mean - w)):
            limit, best = mean + 12 * sd, -np.inf
            for z in np.arange(2.5, 12, 0.5):
                if sd == 0 or mean == 0:
                    break
                hot = [i for i in range(size) if side[i] >= mean + z * sd]
                if not hot:
                    break
                wide = {j for i in hot for j in range(i - buffer + 1, i + buffer) if 0 <= j < size}
                runs = [g for g in groups(wide) if len(g) > 1]
                calm = side[side < mean + z * sd]
                gain = ((mean - calm.mean()) / mean + (sd - calm.std()) / sd) / (len(runs) ** 2 + len(wide))
                if gain >= best and len(runs) <= 5 and len(wide) < 0.5 * size:
                    best, limit = gain, mean + z * sd
            hot = [i for i in range(size) if side[i] >= limit and side[i] > 0.05 * spread]
            wide = {j for i in hot for j in range(i - buffer, i + buffer + 1) if 0 <= j < size}
            first = (500 if n >= 2500 else 250 if n >= 1800 else 0) if k == 0 else size - batch
            wide = {i for i in wide if i >= first}
            if not wide:
                continue
            rest = [side[i] for i in range(size) if i not in wide and i + begin not in every]
            runs = [g for g in groups(wide) if len(g) > 1]
            if not runs:
                kept |= wide
                continue
            tops = [max(side[g[0] : g[-1] + 1]) for g in runs]
            ladder = [*sorted(tops, reverse=True), max(rest) if rest else 0.0]
            gone: set[float] = set()
            for a, b in zip(ladder, ladder[1:]):
                gone = gone | {a} if (a - b) / a < p else set()
            kept |= {i for g, t in zip(runs, tops) if t not in gone for i in g}
        every += [i + begin for i in sorted(kept)]
    return [(g[0], g[-1]) for g in groups(every) if len(g) > 1]


def make(seed, n):
    rng = np.random.default_rng(seed)
    e = np.abs(rng.normal(0.1, 0.02, n)) + 0.05
    for at in rng.integers(0, n, max(2, n // 900)):
        e[at : at + rng.integers(1, 30)] += rng.uniform(0.2, 2.5)
    if seed % 2:
        e[n // 2 : n // 2 + 6] = 0.0
    return e, rng.normal(0, 0.5, n)


@pytest.mark.parametrize("seed, n", [(0, 9037), (1, 6003), (2, 2140), (3, 1500), (4, 300), (5, 2600)])
def test_dynamic_thresholds_equal_the_plain_version(spark, seed, n):
    e, y = make(seed, n)
    rows = [(seed, i, float(a), float(b)) for i, (a, b) in enumerate(zip(e, y))]
    df = spark.createDataFrame(rows, "series_id long, rn long, error double, value double")
    got = sorted((r.start_rn, r.end_rn) for r in residual.dynamic_thresholds(df, block=2500).collect())
    assert got == plain(e, y)


def test_flat_and_empty_series(spark):
    df = spark.createDataFrame([(0, i, 0.2, 1.0) for i in range(3000)], "series_id long, rn long, error double, value double")
    assert residual.dynamic_thresholds(df).count() == 0 and residual.dynamic_thresholds(df.limit(0)).count() == 0
    flags = residual.channel_flags(df, spark.createDataFrame([(0, 10, 14)], "series_id long, start_rn long, end_rn long"))
    assert flags.count() == 3250 and sorted(r.rn for r in flags.filter("flag = 1").collect()) == [260, 261, 262, 263]
