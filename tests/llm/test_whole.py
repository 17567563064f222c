"""Places where an operator once did less than its whole job."""

import numpy as np
import pyarrow as pa

from telesift.llm import embeddings, pages, scoring


def test_attention_model_has_its_full_size():
    rng = np.random.default_rng(3)
    classes, at = rng.integers(0, 94, 100), np.array([0, 100])
    w = scoring.first_weights(np.ones(scoring.CLASSES))
    before = scoring.class_scores(w, classes, at)
    for p in range(17, 100):  # every token is scored from 17 inputs at least
        changed = classes.copy()
        changed[p - 17] = (changed[p - 17] + 1) % 94
        assert scoring.class_scores(w, changed, at)[p] != before[p]
    assert (scoring.CLASSES, scoring.ROUNDS) == (128, 3)
    assert w["inner"].shape == (scoring.WIDTH, 2 * scoring.WIDTH)


def test_scoring_model_learns_from_every_training_document(spark):
    n = 2600
    docs = spark.createDataFrame([(i, f"the of and q{i % 7} stone river") for i in range(n)], "doc_id long, text string").repartition(3)
    want = {}
    for i in range(n):
        for t in scoring._text_sequences(pa.array([f"the of and q{i % 7} stone river"]))[0].tolist():
            want[t] = want.get(t, 0) + 1
    vocabulary, _ = scoring.fit(docs, n)
    weight = np.full(len(vocabulary.kind), 0.5)
    for t, c in want.items():
        weight[t] += c
    share = np.log10(weight / np.bincount(vocabulary.kind, weights=weight)[vocabulary.kind])
    assert np.allclose(vocabulary.share, share)


def test_moves_of_shards_are_summed_by_row():
    rng = np.random.default_rng(11)
    shapes = {"embed": (9, 4), "pair": (7, 4), "read": (4, 3), "bias": (3,)}
    shards = []
    for tokens in (100, 7, 31, 250):
        moves = {k: rng.normal(size=s).astype(np.float32) for k, s in shapes.items()}
        for k in scoring.TABLES:
            moves[k][rng.random(len(moves[k])) < 0.6] = 0
            moves[k][0] = 0  # a row that no shard moves
        shards.append((tokens, moves))
    tasks = [{}, {}]
    for i, (tokens, moves) in enumerate(shards):
        scoring.add_moves(tasks[i // 3], moves, tokens)
    total = {}
    for t in tasks:
        scoring.add_told(total, scoring.told_moves(t))
    for k in shapes:
        sums, behind = total[k]
        for r in range(shapes[k][0]):
            n = sum(tokens for tokens, m in shards if k not in scoring.TABLES or m[k][r].any())
            assert behind[r if k in scoring.TABLES else 0] == n
            assert np.allclose(sums[r], sum(tokens * m[k][r].astype(float) for tokens, m in shards), rtol=1e-5, atol=1e-3)


def test_a_task_of_training_tells_its_moves_once_and_only_moved_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the of and q{i % 5} stone river") for i in range(900)], "doc_id long, text string").repartition(3)
    told, average = [], scoring.averaged

    def watched(weights, parts):
        told.append(parts.count())
        new = average(weights, parts)
        moved = (new["pair"] != weights["pair"]).any(axis=1)
        assert 0 < moved.sum() < 200 and all(np.isfinite(w).all() for w in new.values())
        return new

    monkeypatch.setattr(scoring, "averaged", watched)
    scoring.fit(docs, 900)
    assert told == [3] * scoring.ROUNDS


def test_audit_sees_rare_links_beside_a_hot_group():
    rng = np.random.default_rng(5)
    hot = rng.normal(size=(1, 24)) + rng.normal(size=(700, 24)) * 0.02
    pairs = np.repeat(rng.normal(size=(150, 24)), 2, axis=0) + rng.normal(size=(300, 24)) * 0.02
    x = embeddings._unit(np.concatenate([hot, pairs]))
    graph = embeddings.Graph(x, np.arange(1000))
    search = graph._descend

    def blind(asked, *rest):  # a graph in which the pairs' points find only themselves
        ids, scores = search(asked, *rest)
        lone = ((ids >= 0) & (scores >= 0.95)).sum(axis=1) <= 2
        scores[lone] = np.where(scores[lone] < 0.9999999 - 1e-6, -2.0, scores[lone])
        return ids, scores

    graph._descend = blind
    query, point = graph.within(x, 0.95)
    found = set(zip(query.tolist(), point.tolist(), strict=True))
    assert all((i, i + 1) in found and (i + 1, i) in found for i in range(700, 1000, 2))


def test_no_group_of_near_copies_closes_on_itself():
    rng = np.random.default_rng(8)
    centres = embeddings._unit(rng.normal(size=(12, 16)))
    x = embeddings._unit(np.repeat(centres, 200, axis=0) + rng.normal(size=(2400, 16)) * 0.01)
    graph = embeddings.Graph(x, np.arange(2400))
    query, point = np.nonzero(graph.layers[0] >= 0)
    a, b = query, graph.layers[0][query, point]
    group = graph.order // 200
    leaving = np.bincount(group[a], weights=group[a] != group[b], minlength=12)
    assert (leaving > 0).all()


def test_region_words_do_not_lose_articles():
    text = "plain words of a long article about a river and its stones that goes on for a while " * 3
    told = text.strip()

    def main(page):
        return pages.main_texts([page], pages.fitted())[0]

    for open_, close in (("<div class='layout has-sidebar'>", "</div>"), ("<main class='content no-sidebar'>", "</main>"), ("<div id='page-with-footer'>", "</div>"), ("<form action=x><div>", "</div></form>"), ("<form><article>", "</article></form>"), ("<div class=banner><article>", "</article></div>"), ("<article><svg/><math />", "</article>")):
        assert main(f"{open_}<p>{text}</p>{close}") == told, open_
    for open_, close in (("<header class='entry-header'>", "</header>"), ("<div class='article-header'>", "</div>")):
        assert main(f"<article>{open_}<h1>Head line</h1>{close}<p>{text}</p></article>") == f"Head line {told}"
    for open_, close in (("<div class='sidebar'>", "</div>"), ("<div id=site-footer>", "</div>"), ("<div class='comment-list'><article>", "</article></div>"), ("<aside><article>", "</article></aside>"), ("<svg><text>", "</text></svg>")):
        assert main(f"<article><p>{text}</p></article>{open_}<p>other {text}</p>{close}") == told, open_
    assert main(f"<article><p>{text}</p><form><p>Your name</p><input>Sign up</form></article>") == told
