"""Embedding links at sizes where graphs, hot groups and rare pairs matter."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from telesift.llm import embeddings
from tests.llm import brute


def hot_and_rare(rng):
    """3,600 vectors: a third in one group of near copies, 400 isolated pairs, others alone, some repeated."""
    hot = rng.normal(size=(1, 24)) + rng.normal(size=(1200, 24)) * 0.15
    pairs = np.repeat(rng.normal(size=(400, 24)), 2, axis=0) + rng.normal(size=(800, 24)) * 0.1
    return np.concatenate([hot, pairs, rng.normal(size=(1500, 24)), hot[:50], pairs[:50]])


@pytest.mark.parametrize("shards", [1, 3])
def test_hot_group_and_isolated_pairs_against_brute_force(spark, shards):
    x = hot_and_rare(np.random.default_rng(11))
    order = np.random.default_rng(2).permutation(len(x))
    rows = [(int(i), [float(c) for c in x[j]]) for i, j in enumerate(order)]
    got = {r.vec_id: r for r in embeddings.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), shards=shards).collect()}
    y = x[order]
    unit = y / np.sqrt((y * y).sum(axis=1, keepdims=True))
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    count = near.sum(axis=1)
    found = np.array([got[i].n_links for i in range(len(y))])
    assert (found <= count).all()
    # recall for vectors with few and with many links
    for part in ((count > 0) & (count <= 4), count > 100):
        assert part.sum() > 100 and (found[part] / count[part]).mean() >= 0.99
    root = brute.groups(range(len(y)), zip(*(a.tolist() for a in np.nonzero(np.triu(near))), strict=True))
    same = np.mean([got[i].component_id == root[i] for i in range(len(y))])
    assert same >= 0.995 and all(got[i].kept == (got[i].component_id == i) for i in range(len(y)))


def test_repeated_and_null_ids(spark):
    near, other = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0]
    rows = [(5, near), (5, other), (3, [0.0, 1.0, 0.01]), (9, [1.0, 0.0, 0.11]), (None, near), (None, None), (7, [0.0, 0.0, 1.0])]
    out = embeddings.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in out if r.vec_id) == [(3, 1, 3), (5, 1, 3), (5, 1, 3), (7, 0, 7), (9, 1, 3)]
    assert [(r.n_links, r.component_id) for r in out if r.vec_id is None] == [(0, None)] * 2


def test_probes_ask_for_wider_beams():
    rng = np.random.default_rng(1)
    graph = embeddings.Graph(embeddings._unit(rng.normal(size=(3000, 32))), np.arange(3000))
    assert graph.probed_beam(0.95) <= embeddings.WIDEST_BEAM
    graph.layers[0][:] = -1  # nothing can be reached any more
    assert graph.probed_beam(0.95) > embeddings.WIDEST_BEAM
    query, point, full = graph.search(graph.vectors[:100], 0.95, None)
    assert len(full) == 100 and not len(query)


@pytest.mark.parametrize("margin", [None, 0.0])
def test_no_row_holds_a_shard_and_hot_links_count_on_both_sides(spark, monkeypatch, margin):
    """Whatever the margin, a link between cells counts for both vectors if one asked the other's cell."""
    x = hot_and_rare(np.random.default_rng(12))[:3500]
    widest, asked, found = [], [], []
    written, margins, look_up = embeddings.written, embeddings._margins, embeddings._find

    def watched(df):
        out = written(df)
        sizes = [F.length(c) if t == "binary" else F.size(c) * 8 for c, t in out.dtypes if t == "binary" or t.startswith("array")]
        widest.extend(out.agg(*[F.max(c) for c in sizes]).first() if sizes else [])
        return out

    def narrow(*given):
        cells = margins(*given)
        asked.append(cells)
        return cells if margin is None else {k: c._replace(margin=margin) for k, c in cells.items()}

    def kept(*given):
        found.append(look_up(*given))
        return found[-1]

    for name, f in (("written", watched), ("_margins", narrow), ("_find", kept)):
        monkeypatch.setattr(embeddings, name, f)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = {r.vec_id: r.n_links for r in embeddings.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_values=24 * 300).collect()}
    assert max(widest) <= 24 * 8
    assert len(asked[0][24].centres) == 12 and asked[0][24].parts.max() > 1
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    count, links = near.sum(axis=1), np.array([got[i] for i in range(len(x))])
    assert (links <= count).all()
    if margin is None:
        for part in ((count > 0) & (count <= 4), count > 100):
            assert (links[part] / count[part]).mean() >= 0.99
    else:
        assert (links[count > 100] / count[count > 100]).mean() > 0.5


def test_cells_ask_for_what_is_at_the_threshold():
    rng = np.random.default_rng(8)
    low = embeddings._unit(rng.normal(size=(3000, 6)) @ rng.normal(size=(6, 48)) + rng.normal(size=(3000, 48)) * 0.01).astype(np.float32)
    for sample in (embeddings._unit(rng.normal(size=(3000, 48))).astype(np.float32), low):
        centres = embeddings._centres(sample[:2000], 30)
        margin = np.quantile(embeddings._reach(centres, *embeddings._turned(sample[:2000], 0.95)), embeddings.ROUTE_RECALL)
        # links that were not in the sample, across the data
        a, b = sample[2000:], sample[rng.permutation(1000) + 2000]
        away = b - (a * b).sum(axis=1, keepdims=True) * a
        size = np.sqrt((away * away).sum(axis=1, keepdims=True))
        some = size[:, 0] > 1e-3
        linked = (0.951 * a + np.sqrt(1 - 0.951**2) * away / np.maximum(size, 1e-9))[some].astype(np.float32)
        assert (embeddings._reach(centres, a[some], linked) <= margin).mean() >= 0.99


def test_vectors_go_as_floats_where_these_are_the_same():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(5, 3))
    short = x.astype(np.float32).astype(np.float64)
    both = pa.chunked_array([embeddings._packed(short), embeddings._packed(x), pa.concat_arrays([embeddings._packed(x), embeddings._packed(short)])[3:8]])
    assert [len(v) for v in both.to_pylist()] == [12] * 5 + [24] * 5 + [24] * 2 + [12] * 3
    assert (embeddings._unpacked(both, 3) == np.concatenate([short, x, x[3:], short[:3]])).all()
