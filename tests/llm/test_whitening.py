from fractions import Fraction

import numpy as np
import pytest

from telesift.llm import whitening


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, label string, x int").repartition(3)


def plain(rows, components=8):
    """With fractions and one numpy call: (n, {vec_id: deviation}, covariance, eigenvalues, eigenvectors)."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(v) for _, v in good), default=0)
    x = [[int(np.floor(1024 * np.float64(c))) + 100_000 for c in v] + [100_000] * (width - len(v)) for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    covariance = [[float(sum((Fraction(r[i]) - Fraction(sums[i], n)) * (Fraction(r[j]) - Fraction(sums[j], n)) for r in x) / n) for j in range(width)] for i in range(width)]
    return good, x, sums, deviation, np.array(covariance)


def checked(spark, rows, components):
    good, x, sums, deviation, covariance = plain(rows)
    n = len(x)
    values, turned = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:components]
    got = whitening.whitening_digest(vectors_of(spark, rows)).collect()
    assert len(got) == n * components
    assert {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, components + 1))
    assert all(0 <= r.identity_error < 1e-9 for r in got)
    exact = {}
    for (i, _), d in zip(good, deviation, strict=True):
        exact.setdefault(i, []).append(d)
    for c, k in enumerate(order, 1):
        mine = [r for r in got if r.component == c]
        assert sorted((str(r.vec_id), int(r.deviation_exact)) for r in mine) == sorted((str(i), d) for i, ds in exact.items() for d in ds)
        assert all(r.deviation == (int(r.deviation_exact) if int(r.deviation_exact) < 1 << 63 else None) for r in mine)
        assert all(abs(r.explained - values[k] / np.trace(covariance)) < 1e-9 for r in mine)
        want = np.array([[float(Fraction(a) - Fraction(s, n)) for a, s in zip(row, sums, strict=True)] for row in x]) @ turned[:, k] / np.sqrt(values[k])
        mine = {}
        for r in got:
            if r.component == c:
                mine.setdefault(r.vec_id, []).append(r.whitened)
        mine = np.array([mine[i].pop() if len(exact[i]) == 1 else None for i, _ in good], dtype=float)
        once = ~np.isnan(mine)
        sign = np.sign(mine[once] @ want[once])
        assert np.allclose(sign * mine[once], want[once], atol=1e-7)


def test_whitening_against_fractions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(0, [3, 1, 0.5] + [0.1] * 9) + 7).tolist()) for i in range(120)]
    rows += [(500, None), (501, [None] + [0.0] * 11), (502, [float("nan")] * 12), (503, [float("inf")] * 12), (3, rows[3][1]), (None, rows[4][1]), (504, [1.0, 2.0]), (505, [])]
    checked(spark, rows, 8)


def test_far_values_stay_exact(spark):
    rng = np.random.default_rng(6)
    checked(spark, [(i, (rng.normal(size=3) * [1e6, 1e4, 100] + 1e10).tolist()) for i in range(40)], 3)


def test_scatter_does_not_depend_on_blocks_or_partitions(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(300)]
    _, x, sums, _, _ = plain(rows)
    y = [[len(x) * c - s for c, s in zip(r, sums, strict=True)] for r in x]
    want = [[sum(r[i] * r[j] for r in y) for j in range(5)] for i in range(5)]
    for parts, block in ((1, 4096), (7, 3)):
        monkeypatch.setattr(whitening, "ROWS", block)
        vectors = whitening.usable(vectors_of(spark, rows).repartition(parts))
        assert whitening.scatter(vectors, *whitening.totals(vectors)).tolist() == want


def test_residues_give_numbers_back():
    moduli = whitening.primes(10**40)
    assert np.prod([float(p) for p in moduli]) > 2e40 and len(set(moduli)) == len(moduli) and max(moduli) < 1 << 21
    for value in (0, 1, -1, 10**40, -(10**40), 123456789):
        assert whitening.reconstruct([value % p for p in moduli], moduli) == value


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])], [(1, None)]])
def test_without_variance_there_are_no_components(spark, rows):
    out = whitening.whitening_digest(vectors_of(spark, rows))
    assert out.count() == 0
    assert out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_fewer_dimensions_than_components(spark):
    rows = whitening.whitening_digest(vectors_of(spark, [(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [4.0, 5.0])])).collect()
    assert {r.component for r in rows} == {1} and len(rows) == 3 and abs(sum(r.whitened for r in rows)) < 1e-9
