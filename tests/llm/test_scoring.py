"""The steps of the scoring model against plain ones, and what a run reads and writes."""

import numpy as np
import pytest

from telesift.llm import scoring


def small_model(n=200, seed=3):
    rng = np.random.default_rng(seed)
    count = np.where(np.arange(n) < n - 30, rng.integers(1, 500, n), 0)
    vocabulary = scoring.make_vocabulary(count, rng.random((n, 2 * scoring.SINGLE)).astype(np.float32))
    weights = scoring.first_weights(np.bincount(vocabulary.kind, weights=count, minlength=scoring.CLASSES), vocabulary)
    return rng, vocabulary, weights


def test_texts_are_read_and_spelled_once(docs, monkeypatch):
    plans, written = [], scoring.written

    def watched(df):
        plans.append(df._jdf.queryExecution().analyzed().toString())
        return written(df)

    monkeypatch.setattr(scoring, "written", watched)
    assert scoring.scoring_digest(docs).count() == docs.count()
    assert sum("text#" in p for p in plans) == 1


def test_ids_of_all_classes_are_told_apart_as_one_by_one():
    rng, vocabulary, w = small_model()
    w["tell"] = w["tell"] + rng.normal(size=w["tell"].shape).astype(np.float32)
    ids = rng.integers(0, 200, 300)
    g, classes, rows = rng.normal(size=(300, scoring.WIDTH)).astype(np.float32), vocabulary.kind[ids].astype(np.int64), vocabulary.row[ids]
    weight = rng.random(300).astype(np.float32)
    got, (dg, tell, bias) = scoring.told_apart(w, g, rows, classes, vocabulary.members, weight)
    want, want_dg, want_tell, want_bias = np.zeros(300), np.zeros_like(g), np.zeros_like(tell), np.zeros_like(bias)
    for i in range(300):
        lo, hi = vocabulary.members[classes[i]], vocabulary.members[classes[i] + 1]
        if hi - lo > 1:
            p = np.exp(g[i] @ w["tell"][lo:hi].T + w["tell_bias"][lo:hi])
            p /= p.sum()
            want[i] = np.log(p[rows[i] - lo])
            p[rows[i] - lo] -= 1
            want_dg[i] = weight[i] * p @ w["tell"][lo:hi]
            want_tell[lo:hi] += weight[i] * p[:, None] * g[i]
            want_bias[lo:hi] += weight[i] * p
    for a, b in ((got, want), (dg, want_dg), (tell, want_tell), (bias, want_bias)):
        assert np.allclose(a, b, atol=2e-5)
    assert (got < 0).any()
    none = scoring.told_apart(w, g[:0], rows[:0], classes[:0], vocabulary.members, weight[:0])
    assert len(none[0]) == 0 and not none[1][1].any()


def test_sums_by_row():
    rng = np.random.default_rng(4)
    rows, values = rng.integers(0, 50, 300), rng.normal(size=(300, 4))
    which, sums = scoring._scatter(rows, values, 90)
    want = np.zeros((90, 4))
    np.add.at(want, rows, values)
    assert which.tolist() == sorted(set(rows.tolist())) and np.allclose(sums, want[which])


@pytest.mark.parametrize("batch", [7, 128])
def test_steps_are_those_of_adam_and_adagrad(batch):
    rng, vocabulary, w = small_model()
    classes, rows, at, _ = scoring.rows_with_ends(vocabulary, rng.integers(0, 200, 400), np.array([150, 0, 250]))
    before = {k: v.copy() for k, v in w.items()}
    got = scoring.train(w, classes, at, 0.02, 5, batch, rows, vocabulary.members)
    assert all((w[k] == before[k]).all() for k in w)
    inputs, inside, targets, place = scoring.blocks_of(classes, at, rows, int(vocabulary.members[-1]))
    order = np.random.default_rng(5).permutation(len(inputs))
    want, seen = {k: v.astype(np.float64) for k, v in w.items()}, {k: np.full(len(w[k]), 1e-6) for k in scoring.TABLES}
    one, two = ({k: np.zeros(v.shape) for k, v in w.items()} for _ in range(2))
    steps = range(0, len(order), batch)
    for t, lo in enumerate(steps, 1):
        at_, slow = order[lo : lo + batch], min(1.0, t / 20) * (1 - 0.8 * t / len(steps))
        grads = scoring.gradients(want, inputs[at_], inside[at_], targets[at_], (place[at_] >= 0).astype(np.float64), rows[np.maximum(place[at_], 0)], vocabulary.members)
        for k, g in grads.items():
            if k in seen:
                which, g = g
                seen[k][which] += (g * g).mean(axis=1)
                want[k][which] -= scoring.TABLE_RATE * slow * 0.02 / scoring.RATE * g / np.sqrt(seen[k][which])[:, None]
            else:
                one[k] += 0.1 * (g - one[k])
                two[k] += 0.01 * (g * g - two[k])
                want[k] -= 0.02 * slow * (one[k] / (1 - 0.9**t)) / (np.sqrt(two[k] / (1 - 0.99**t)) + 1e-8)
    for k in w:
        assert np.abs(got[k] - want[k]).mean() < 1e-3 * np.abs(want[k] - w[k]).mean() + 1e-7, k


def test_a_step_takes_sums_by_blocks_and_adds_what_tells_ids_apart(monkeypatch):
    rng, vocabulary, w = small_model()
    w = {k: v.astype(np.float64) for k, v in w.items()}
    x, y = rng.normal(size=(528, 5)), rng.normal(size=(528, 3))
    assert np.allclose(scoring._summed_products(x, y), x.T @ y)
    ids, g, weight = rng.integers(0, 200, 300), rng.normal(size=(300, scoring.WIDTH)), rng.random(300) * (rng.random(300) < 0.7)
    classes, rows, into = vocabulary.kind[ids].astype(np.int64), vocabulary.row[ids], rng.normal(size=(300, scoring.WIDTH))
    _, want = scoring.told_apart(w, g, rows, classes, vocabulary.members, weight)
    before = into.copy()
    _, got = scoring.told_apart(w, g, rows, classes, vocabulary.members, weight, into)
    assert got[0] is into and np.allclose(into - before, want[0])
    assert all(np.allclose(a, b) for a, b in zip(got[1:], want[1:], strict=True)) and want[1].any()
    # nothing as wide as a class or as long as a table times its width is built for a sum by row
    sizes, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda a, *more: sizes.append(len(a)) or bincount(a, *more))
    which, sums = scoring._scatter(rng.integers(0, 90, 400), rng.normal(size=(400, 6)), 90)
    assert sizes == [400] * 6 and sums.shape == (len(which), 6)
