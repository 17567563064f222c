import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from telesift.llm import langid, mixing, neardup, packing, scoring, substrings
from tests.llm import brute


def pairs(corpus):
    return [(d, t) for d, t, *_ in corpus]


def test_packing_is_exact_and_gapless(docs, corpus, nothing):
    rows = packing.pack_documents(docs).collect()
    encode = packing.encoder().encode_ordinary
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for d, text in pairs(corpus):
        ids = [*encode(text or ""), 0]
        pieces = sorted(by_doc[d], key=lambda r: r.piece)
        assert b"".join(bytes(p.ids) for p in pieces) == np.array(ids, "<u4").tobytes()
        assert [p.start for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces[:-1]]))
        assert all(p.length == 2048 for p in pieces[1:]) and (len(ids) > 2048) == (len(pieces) > 1)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack_documents(nothing).count() == 0
    whole = packing.sequences(packing.pack_documents(docs)).collect()
    assert {len(r.ids) // 4 for r in whole} == {r.length for r in whole}


def test_open_bins_close_the_fullest_and_fit_best():
    bins = packing.OpenBins(10, 2, 0)
    assert [bins.put(7), bins.put(5), bins.put(3)] == [(0, 0), (1, 0), (0, 7)]
    assert bins.put(6) == (2, 0)
    assert bins.put(6) == (3, 0)  # 1 has five places left, 2 four: 2 closes
    assert bins.put(4) == (3, 6)
    assert bins.put(5) == (1, 5)


def test_language(docs, corpus, nothing):
    rows = {r.doc_id: r for r in langid.language_digest(docs).collect()}
    assert len(rows) == len(corpus)
    for d, text, lang, _ in corpus:
        r = rows[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif len(text) > 30:
            assert r.lang_pred == lang
    assert langid.language_digest(nothing).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_code_lengths_in_pieces_are_the_same(docs):
    model = langid.fit(docs.select("doc_id", "lang", "text"))
    data = np.frombuffer(("the green house and the river " * 300).encode(), np.uint8)
    at = np.array([0, 10, 10, len(data)])
    whole = langid.code_lengths(model, data, at)
    small = langid.PIECE
    try:
        langid.PIECE = 101
        assert np.allclose(langid._in_pieces(model, data, at), whole)
    finally:
        langid.PIECE = small
    # probabilities after a context sum up to 1
    assert np.allclose((2.0 ** -model.cost.astype(float)).sum(axis=1), 1, atol=0.35)


def test_substrings_against_brute_force(docs, corpus, nothing):
    got = {r.doc_id: tuple(r)[1:] for r in substrings.substring_digest(docs).collect()}
    assert got == brute.repeats(pairs(corpus))
    assert substrings.substring_digest(nothing).count() == 0


@pytest.mark.parametrize("most", [1, 1000])
def test_crowded_anchors_give_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(substrings, "MOST_CONTEXTS", most)
    rng = np.random.default_rng(3)
    common = [f"c{i}" for i in range(70)]
    rows = []
    for d in range(40):
        lo, hi = sorted(rng.integers(0, 70, 2))
        rows.append((d, " ".join([f"a{d}x{i}" for i in range(rng.integers(0, 60))] + common[lo:] + common[:hi] + [f"b{d}x{i}" for i in range(20)])))
    got = {r.doc_id: tuple(r)[1:] for r in substrings.substring_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.repeats(rows)


def test_automaton_knows_first_owners():
    a = substrings.Automaton()
    a.add([1, 2, 3, 4], 5)
    a.add([9, 2, 3, 4, 2, 3], 6)
    assert a.first_owners([2, 3, 4], 2) == [5, 5]
    assert a.first_owners([9, 2, 3, 7, 4, 2], 2) == [6, 5, None, None, 6]


def test_near_duplicates_against_brute_force(docs, corpus, nothing):
    got = {r.doc_id: tuple(r)[1:] for r in neardup.link_documents(docs).collect()}
    assert got == brute.near_duplicates(pairs(corpus))
    assert neardup.link_documents(nothing).count() == 0


def test_crowded_buckets_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for d in range(40):
        words = list(base)
        for i in rng.integers(0, 120, rng.integers(0, 9)):
            words[i] = f"x{rng.integers(0, 4)}"
        rows.append((d, " ".join(words)))
    got = {r.doc_id: tuple(r)[1:] for r in neardup.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_duplicates(rows)


def test_super_minhash_estimates_similarity():
    values = np.arange(3000, dtype=np.uint64) * np.uint64(2654435761) + np.uint64(12345)
    a, b = values[:2000], values[500:2500]
    sets = np.concatenate([np.sort(a), np.sort(b)])
    signature = neardup.super_minhash(sets, np.array([0, 2000, 4000]))
    assert abs((signature[0] == signature[1]).mean() - 0.6) < 0.15
    few = neardup.super_minhash(values[:1], np.array([0, 1]))[0] >> np.uint64(32)
    assert sorted(few.tolist()) == list(range(neardup.SLOTS))  # one element gives each slot its own rank


def test_mixing(docs, corpus, nothing):
    rows = mixing.mixing_digest(docs).collect()
    assert sorted(rows) == sorted(mixing.mixing_digest(docs.repartition(5)).collect())
    sizes = {d: len(brute.words(t)) for d, t, *_ in corpus}
    total = {}
    for d, _, _, source in corpus:
        total[source] = total.get(source, 0) + sizes[d]
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:  # deal by weight, hold at twice the size, deal the rest again
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)
        level = left / sum(w for s, w in weight.items() if s not in capped)
        more = {s for s in order if s not in capped and level * weight[s] > 2 * total[s]}
        if not more:
            break
        capped |= more
    target = {s: 2.0 * total[s] if s in capped else level * weight[s] for s in order}
    source_of = {d: s for d, _, _, s in corpus}
    taken = dict.fromkeys(order, 0)
    for r in rows:
        s = source_of[r.doc_id]
        assert r.size == sizes[r.doc_id] and r.source_size == total[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert r.taken % max(1, r.size) == 0 and r.taken <= 2 * r.size
        taken[s] += r.taken
    longest = max(sizes.values())
    assert all(abs(taken[s] - target[s]) <= longest for s in order)
    assert mixing.mixing_digest(nothing).count() == 0
    mixed = mixing.mix_sources(docs)
    assert set(docs.columns) - {"size"} < set(mixed.columns) and mixed.count() == len(corpus)


def test_scoring_against_brute_force(docs, corpus, nothing):
    want = brute.base_scores(pairs(corpus))
    rows = scoring.scoring_digest(docs).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        n_tokens, n_known, n, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n)
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert scoring.scoring_digest(nothing).count() == 0


def test_windows_score_each_token_once_and_see_no_future():
    rng = np.random.default_rng(0)
    classes, at = rng.integers(0, 94, 100), np.array([0, 37, 37, 53, 100])
    place = scoring.blocks_of(classes, at)[3]
    assert sorted(place[place >= 0].tolist()) == list(range(100))
    w = scoring.first_weights(np.ones(scoring.CLASSES))
    before = scoring.class_scores(w, classes, at)
    changed = classes.copy()
    changed[80] = (changed[80] + 1) % 94
    after = scoring.class_scores(w, changed, at)
    assert np.array_equal(before[:80], after[:80]) and not np.allclose(before[80:], after[80:])


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    classes, at = rng.integers(0, 94, 60), np.array([0, 60])
    w = {k: v.astype(np.float64) for k, v in scoring.first_weights(np.ones(scoring.CLASSES)).items()}
    inputs, inside, targets, place = scoring.blocks_of(classes, at)
    valid = (place >= 0).astype(float)

    def loss(weights):
        logits = scoring.forward(weights, inputs, inside)["logits"]
        chosen = np.take_along_axis(logits, targets[:, :, None], 2)[:, :, 0] - np.log(np.exp(logits).sum(axis=2))
        return -(chosen * valid).sum() / valid.sum()

    got = scoring.gradients(w, inputs, inside, targets, valid)
    for name in w:
        at_ = np.unravel_index(np.abs(got[name]).argmax(), w[name].shape)
        up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
        up[name][at_] += 1e-5
        down[name][at_] -= 1e-5
        assert got[name][at_] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=1e-3, abs=1e-7), name


def test_training_lowers_the_loss():
    rng = np.random.default_rng(2)
    step = np.cumsum(rng.integers(1, 3, 6000)) % 40
    at = np.arange(0, 6001, 60)
    w = scoring.first_weights(np.ones(scoring.CLASSES))
    trained = w
    for seed in range(5):
        trained = scoring.train(trained, step, at, 0.02, seed, batch=4)
    assert scoring.class_scores(trained, step, at).mean() > scoring.class_scores(w, step, at).mean() + 0.5


def test_pipeline(spark, docs, corpus, tmp_path):
    import corpus_pipeline

    docs.drop("size").write.parquet(f"{tmp_path}/documents.parquet")
    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, run in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        run(spark, stage, str(tmp_path)).write.parquet(path)
        stage = spark.read.parquet(path)
        kept.append(stage)
    named, unique, cut, mixed, packed = kept
    assert all(k.columns == corpus_pipeline.COLUMNS for k in kept[:-1])
    rows = named.select("doc_id", "text").collect()
    assert {d for d, t in pairs(corpus) if t and any(c.isalpha() for c in t) and len(t) > 30} <= {r.doc_id for r in rows}
    want = {d for d, (_, _, kept_) in brute.near_duplicates([tuple(r) for r in rows]).items() if kept_}
    rows = unique.select("doc_id", "text").collect()
    assert {r.doc_id for r in rows} == want
    removed = {d: x for d, x in brute.repeats([tuple(r) for r in rows]).items()}
    got = {r.doc_id: r.text for r in cut.collect()}
    assert all(len(brute.words(got[d])) == n - gone for d, (n, gone, _) in removed.items() if gone < n)
    copies = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(copies.values()) <= {1, 2} and set(copies) <= set(got)
    tokens = packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    encode = packing.encoder().encode_ordinary
    assert {r.doc_id: r.n for r in tokens} == {d: k * (len(encode(got[d])) + 1) for d, k in copies.items()}
    assert sorted(packed.select("doc_id", "piece", "ids").collect()) == sorted(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "ids").collect())
