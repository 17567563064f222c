"""Null and repeated ids, clashing names, added tokens and values of any size."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from telesift.llm import chat, common, langid, mixing, packing, scoring, substrings, topk
from tests.llm import brute


def test_ids_are_those_of_the_json_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    parts = ["hello", " world", "<|endoftext|>", "<|endof", "text|>", "  ", "\n\t", "'s", "é", "漢字", "\u0085", " ", "123", "!?", "\U0001f600", "<|im_start|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)] + ["hello <|endoftext|> world"]
    for t in texts:
        assert packing.text_ids(t) == whole.encode(t, add_special_tokens=False).ids, t
    docs = spark.createDataFrame([(1, texts[-1]), (None, "null id"), (2, "same"), (2, "same")], "doc_id long, text string")
    rows = packing.packing_digest(docs).collect()
    assert [r.length for r in rows if r.doc_id == 1] == [5] and len(rows) == 4


def test_queries_go_by_row_and_scores_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(60, 6)))]
    rows += [(20, rows[3][1]), (0, [1e9] * 6), (61, [2e9] * 6), (62, [3e300] * 6), (63, [-3e300] * 6), (64, [2e300] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    whole = [(i, [int(np.floor(64 * x)) if x < 1e200 and x > -1e200 else int(x) * 64 for x in v]) for i, v in rows if i is not None]
    hold = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = []
    for k, (q, a) in enumerate(whole):
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for j, (i, b) in enumerate(whole) if j != k)[:20]
            want += [(q, r, i, hold(-s)) for r, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, topk.topk_digest(df).collect())) == sorted(want)


def test_texts_of_one_doc_id_are_told_apart(spark):
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    shared = words("s", 60)
    rows = [(1, shared), (2, f"{words('a', 20)} {shared}"), (2, words("b", 10)), (2, f"{shared} {words('c', 300)}"), (None, shared), (3, None)]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, _spans string, _doc string, _key string").repartition(3)
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(docs).collect())
    assert got == sorted([(1, 60, 0, shared), (2, 80, 60, words("a", 20)), (2, 10, 0, words("b", 10)), (2, 360, 60, words("c", 300)), (0, 60, 0, shared), (3, 0, 0, "")])
    assert {"_spans", "_doc", "_key"} < set(substrings.remove_repeats(docs).columns)


def test_clashing_columns_stay(spark):
    names = ["class", "unit", "s", "c", "b", "begin", "buckets", "tilt", "_lower", "_class", "_rate", "before", "whole", "tie", "x.y"]
    docs = spark.createDataFrame([(i if i % 7 else None, f"stone river light {i} " * (i % 5), "en", f"s{i % 3}", *[f"{n}{i}" for n in names]) for i in range(40)], ["doc_id", "text", "lang", "source", *names])
    mixed = mixing.mix_sources(docs)
    assert set(docs.columns) < set(mixed.columns) and mixed.count() == 40
    assert mixed.filter("class = 'class3' and `x.y` = 'x.y3' and text like '%light 3%'").count() == 1
    named = langid.identify(docs, docs)
    assert set(docs.columns) < set(named.columns) and named.filter("_lower = '_lower3'").count() == 1
    assert langid.language_digest(docs).filter("held_out is null").count() == 0


def test_mixing_converges_far_out(spark):
    # one long document beside many short ones, and a target just below the limit
    docs = spark.createDataFrame([(i, "w " * (1 if i else 5000), "a") for i in range(300)] + [(1000 + i, "w " * 20, "b") for i in range(100)], "doc_id long, text string, source string")
    rows = mixing.mix_sources(docs, share=1.99).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("n")).collect()
    assert all(abs(r.n - r.t) <= 5000 for r in rows)


def test_last_example_is_marked_and_long_conversations_pass(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} <|end|>") for i in range(601)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    examples = chat.prefix_targets(turns)
    assert examples.filter("last").select("n_turns").collect() == [(601,)] and examples.count() == 301
    r = chat.chat_digest(examples).first()
    loss = "".join(t for _, _, role, t in rows if role == "assistant")
    assert (r.n_turns, r.loss_sha256) == (601, hashlib.sha256(loss.encode()).hexdigest())


def test_written_tables_can_be_dropped(spark):
    df = common.written(spark.range(3).toDF("id"))
    assert df.count() == 3 and common.drop_written(spark) > 0
    with pytest.raises(Exception):
        common.table(spark, df.inputFiles()[0].rsplit("/", 1)[0], "none").count()


def test_brute_force_prediction_by_partial_matching(spark):
    texts = ["the stone and the river", "the light of the water the", "der stein und der fluss der", "das licht und das wasser"]
    docs = spark.createDataFrame([(i, ("en", "de")[i // 2], t * 3) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    model = langid.fit(docs)
    for text in ("the river", "der fluss", "zzz", "ther"):
        want = brute.ppm_bits({lang: [t * 3 for i, t in enumerate(texts) if ("en", "de")[i // 2] == lang] for lang in ("de", "en")}, text, langid.ORDER, langid.LEAST_COUNT)
        data = np.frombuffer(text.encode(), np.uint8)
        got = langid.code_lengths(model, data, np.array([0, len(data)]))[0]
        assert np.allclose(got, [want["de"], want["en"]], rtol=1e-4), text


def test_attention_model_beats_counts_on_held_out_text(spark):
    """The score is the attention model's alone; on documents it did not learn from it is better than the word counts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = scoring.scoring_digest(docs).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert held[0] / held[2] > held[1] / held[2] + 0.02


def test_scores_are_probabilities():
    """Over all ids that may come next, the probabilities of the model sum up to one."""
    rng = np.random.default_rng(0)
    count = np.zeros(300, np.int64)
    count[:200] = rng.integers(1, 50, 200)
    vocabulary = scoring.make_vocabulary(count, rng.random((300, 2 * scoring.SINGLE)).astype(np.float32))
    weights = scoring.first_weights(np.bincount(vocabulary.kind, weights=count, minlength=scoring.CLASSES), vocabulary)
    weights["tell"] += rng.normal(size=weights["tell"].shape).astype(np.float32)
    weights["pair"] += rng.normal(size=weights["pair"].shape).astype(np.float32)
    text = rng.integers(0, 300, 40)
    nowhere = int(vocabulary.members[scoring.SINGLE + scoring.SHARED]) - 1
    total = 0.0
    for last in range(300):
        ids = np.append(text, last)
        classes, rows, at, _ = scoring.rows_with_ends(vocabulary, ids, np.array([len(ids)]))
        share = 1 / (vocabulary.row == nowhere).sum() if vocabulary.row[last] == nowhere else 1.0
        total += 10.0 ** scoring.class_scores(weights, classes, at, rows, vocabulary.members)[40] * share
    classes[40] = scoring.END
    end = 10.0 ** scoring.class_scores(weights, classes[:41], np.array([0, 41]), np.append(rows[:40], vocabulary.members[scoring.END]), vocabulary.members)[40]
    start = classes[:41].copy()
    start[40] = scoring.START
    never = 10.0 ** scoring.class_scores(weights, start, np.array([0, 41]), np.append(rows[:40], vocabulary.members[scoring.START]), vocabulary.members)[40]
    assert total + end + never == pytest.approx(1, abs=1e-4)


def test_gradients_of_the_tables_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    count = rng.integers(1, 50, 200)
    vocabulary = scoring.make_vocabulary(count, rng.random((200, 2 * scoring.SINGLE)).astype(np.float32))
    w = {k: v.astype(np.float64) for k, v in scoring.first_weights(np.bincount(vocabulary.kind, weights=count, minlength=scoring.CLASSES), vocabulary).items()}
    w["pair"] += rng.normal(size=w["pair"].shape) * 0.1
    w["tell"] += rng.normal(size=w["tell"].shape) * 0.1
    classes, rows, at, _ = scoring.rows_with_ends(vocabulary, rng.integers(0, 200, 60), np.array([60]))
    inputs, inside, targets, place = scoring.blocks_of(classes, at, rows, int(vocabulary.members[-1]))
    valid, told = (place >= 0).astype(float), rows[np.maximum(place, 0)]
    got = scoring.gradients(w, inputs, inside, targets, valid, told, vocabulary.members)

    def loss(weights):
        scores = scoring.class_scores(weights, classes, at, rows, vocabulary.members)
        return -scores.sum() * np.log(10) / valid.sum()

    for name in ("embed", "pair", "tell", "tell_bias", "read", "query"):
        g = got[name]
        if isinstance(g, tuple):
            at_ = np.unravel_index(np.abs(g[1]).argmax(), g[1].shape)
            want, at_ = g[1][at_], (g[0][at_[0]], at_[1])
        else:
            at_ = np.unravel_index(np.abs(g).argmax(), g.shape)
            want = g[at_]
        up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
        up[name][at_] += 1e-5
        down[name][at_] -= 1e-5
        assert want == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=1e-3, abs=1e-6), name


def test_null_and_repeated_ids_are_scored(spark):
    docs = spark.createDataFrame([(None, "stone river"), (None, "stone river"), (4, "stone"), (4, "light and river"), (5, None)] + [(i, "stone river light") for i in range(10, 30)], "doc_id long, text string")
    rows = scoring.scoring_digest(docs).collect()
    assert len(rows) == 25 and {r.n_tokens for r in rows if r.doc_id == 4} == {2, 4} and all(r.held_out is False for r in rows if r.doc_id is None)
