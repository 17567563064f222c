import hashlib

import numpy as np
import pandas as pd

from telesift.llm import chat, embeddings, pages, registry, topk
from tests.llm import brute


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "system", "<|turn|>"), (1, 1, "user", "a <|end|> b <\\|body|>"), (1, 2, "assistant", "x\ny"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "tail"),
        (2, 0, "user", "only"), (3, 0, "assistant", "<\\\\|<|"), (3, 0, "assistant", "<\\\\|<|"), (None, None, None, None),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat.chat_digest(chat.prefix_targets(chat.with_probe(turns))).collect()}
    said = "</s>[INST] ok [/INST]"
    every = rows + [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    for conv in {r[0] for r in every}:
        mine = sorted((r for r in every if r[0] == conv), key=lambda r: r[1] or 0)
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(mine), hashlib.sha256(text.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.n_examples == max(1, sum(r[2] == "assistant" for r in mine) + (mine[-1][2] != "assistant"))
    examples = chat.prefix_targets(turns).filter("conv_id = 1").orderBy("example").collect()
    assert [chat.parse_turns(e.text)[-1][1] for e in examples] == ["x\ny", "", "tail"]
    assert chat.prefix_targets(turns.filter("conv_id = 99")).count() == 0
    for t in ("<|", "<\\|", "<<||", "\\<|\\", ""):
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)


def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 8))
    rows = [(i, [float(x) for x in base[i % 30] + rng.normal(size=8) * 0.12]) for i in range(150)]
    rows += [(150, rows[3][1]), (151, rows[3][1]), (152, None), (153, [0.0] * 8), (154, [float("nan")] + [1.0] * 7), (155, [None] + [1.0] * 7), (156, []), (157, [float("inf")] * 8), (158, [1.0, 2.0]), (159, [2.0, 4.0]), (160, [-0.0, 0.0])]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, id string").repartition(3)


def test_embeddings_against_brute_force(spark):
    rows, df = vectors(spark)
    good = {i: np.array(v) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    unit = {i: v / np.sqrt(v @ v) for i, v in good.items()}
    linked = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    root = brute.groups([i for i, _ in rows], linked)
    count = {i: sum(i in p for p in linked) for i, _ in rows}
    got = {r.vec_id: tuple(r)[1:] for r in embeddings.link_vectors(df, shards=2).collect()}
    assert got == {i: (count[i], root[i], root[i] == i) for i, _ in rows}
    assert embeddings.link_vectors(df.filter("vec_id < 0")).count() == 0


def test_graph_finds_nearly_all_neighbours():
    rng = np.random.default_rng(6)
    x = embeddings._unit(np.repeat(rng.normal(size=(300, 16)), 8, axis=0) + rng.normal(size=(2400, 16)) * 0.15)
    graph = embeddings.Graph(x, np.arange(2400))
    query, point = graph.within(x[:500], 0.95)
    truth = set(zip(*(a.tolist() for a in np.nonzero(x[:500].astype(np.float32) @ x.T.astype(np.float32) >= 0.95)), strict=True))
    found = set(zip(query.tolist(), point.tolist(), strict=True))
    assert found <= truth and len(found) >= 0.97 * len(truth)


def test_top_k_against_brute_force(spark):
    rows, df = vectors(spark)
    good = {i: np.floor(64 * np.array(v, float)).astype(int) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all()}
    want = []
    for q in (i for i in good if i % 20 == 0):
        scores = sorted((-int(sum(a * b for a, b in zip(good[q], v))), i) for i, v in good.items() if i != q)
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scores[:20], 1)]
    assert sorted(map(tuple, topk.topk_digest(df).collect())) == sorted(want)
    assert topk.topk_digest(df.filter("vec_id < 0")).count() == 0
    assert topk.topk_digest(df.filter("vec_id in (0, 1, 2)")).count() == 2


def test_sparse_terms_are_scattered():
    values, weights = np.zeros((3, 50), int), np.zeros((3, 4), int)
    values[0, 7], values[1], weights[:, 2] = 5, np.arange(50), [2, 3, 9]
    assert np.array_equal(topk.accumulate(values, weights), weights.T @ values)
    frame = topk.block_top_k(pd.DataFrame({"query_id": [1], "vector": [[1]]}), pd.DataFrame({"vec_id": [3, 2, 1], "vector": [[1], [1], [9]]}), 1)
    assert frame.values.tolist() == [[1, 2, 1]]


PAGE = """<html><head><title>Away</title><style>p{}</style></head><body class="has-sidebar"><header><a href="/">Home</a></header>
<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><div id=cookie-notice>We use cookies</div>
<article><h1>Head &amp; line</h1><p>First <b>bold<br>second&nbsp;line.<p>With <a href="x">a link</a> inside.<form><input>Sign up</form><script>var x = "<p>no</p>";</script>
<aside>Related things here</aside></article><div class="comments"><p>I think this reads like a comment of some length.</p></div><footer>&copy; Us</footer>"""


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, "v", None), (3, None, ""), (4, "w", "<p>cut <b"), (5, "x", "a < b <!-- c"), (6, "y", "<article>" + "<div>" * 3000 + "deep words</div></article>")]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, text string").repartition(2)
    got = {r.page_id: r for r in pages.page_digest(df).collect()}
    assert got[1].text == "Head & line First bold second line. With a link inside."
    assert got[1].n_chars == len(got[1].text) and (got[2].text, got[3].text, got[3].n_chars) == ("", "", 0)
    assert got[6].text == "deep words" and len(got) == 6
    assert pages.page_digest(df.filter("page_id < 0")).count() == 0


def test_tree_learns_its_table():
    rows = np.array(pages.LABELLED.split(), float).reshape(-1, len(pages.FEATURES) + 1)
    assert (pages.classify(pages.fitted(), rows[:, :-1]) == (rows[:, -1] == 1)).mean() > 0.95
    rng = np.random.default_rng(0)
    x = rng.integers(0, 200, (2000, 10)).astype(float)
    x[:, [1, 3, 5]] /= 200
    x[:, [6, 8, 9]] %= 2
    x[:, 7] = 1
    x[:, 6] = 0
    assert not pages.classify(pages.fitted(), x).any()


def test_registry_names_all_operators():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{i}" for i in range(1, 11)]
    assert set(registry.oracle_sql()) <= set(registry.queries())
