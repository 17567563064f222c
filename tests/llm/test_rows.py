"""Different texts under one doc_id, and pages whose markup is broken or whose names mislead."""

import itertools
import random
import time

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from telesift.llm import common, neardup, pages

RNG = random.Random(11)
WORDS = [f"w{i}" for i in range(500)]
A, B, C = ([RNG.choice(WORDS) for _ in range(60)] for _ in range(3))
NEAR_A = [*A[:-1], "other"]
ROWS = [(1, " ".join(A)), (2, " ".join(B)), (2, " ".join(NEAR_A)), (3, " ".join([*B, "more"])), (2, " ".join(C)), (4, None), (4, "")]


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(rows):
    """Rows that can reach one another, as sets of their numbers."""
    s = [sets(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    return [{i for i in range(len(rows)) if group[i] == g} for g in set(group)]


def brute(rows):
    """Component by row: the smallest doc_id of the rows reached."""
    s = [sets(t) for _, t in rows]
    group = {i: k for k, x in enumerate(groups(rows)) for i in x}
    low = {g: min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in group.values()}
    return sorted((rows[i][0], len(s[i]), low[group[i]], low[group[i]] == rows[i][0]) for i in range(len(rows)))


@pytest.mark.parametrize("order", [[0, 1, 2, 3, 4, 5, 6], [6, 5, 4, 3, 2, 1, 0], [2, 1, 3, 0, 6, 4, 5]])
def test_links_of_every_text_of_a_repeated_id(spark, order):
    rows = [ROWS[i] for i in order]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, neardup.link_documents(docs).collect()))
    assert got == brute(rows)
    assert (3, len(sets(ROWS[3][1])), 2, False) in got


def test_random_repeated_ids(spark):
    rng, rows = random.Random(5), []
    for i in range(60):
        base = list(RNG.choice([A, B, C]))
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = f"x{rng.randint(0, 40)}"
        rows.append((rng.randint(0, 25), " ".join(base[: rng.choice([60, 60, 4])])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, neardup.link_documents(docs).collect())) == brute(rows)
    # one text of each component is its head
    alone = sorted(set(rows))
    want = len({tuple(sorted(x)) for x in groups(alone)})
    assert neardup.linked_rows(docs).filter("head").select("doc_id", "text_key").distinct().count() == want


def test_pipeline_keeps_different_texts_of_one_id(spark):
    rows = [(d, t, "en", "s", len(t or "")) for d, t in ROWS] + [(2, ROWS[4][1], "en", "s", 1), (None, "a b", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(repr((r.doc_id, r.text)) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == sorted(map(repr, [ROWS[0], ROWS[1], ROWS[4], (4, ""), (4, None), (None, "a b")]))


PROSE = " ".join(f"word{i}" for i in range(100))
PARAGRAPHS = "".join(f"<p>{' '.join(PROSE.split()[i : i + 25])}</p>" for i in range(0, 100, 25))


def text_of(html):
    return pages.main_texts([html], pages.fitted())[0]


@pytest.mark.parametrize(
    "html",
    [
        f"<body><a name=top><nav><a href=/>Home</a></nav><article>{PARAGRAPHS}</article></body>",
        f"<body><article class='news-alert'>{PARAGRAPHS}</article><footer>Terms</footer></body>",
        f"<body><article><div class='news-alert'>{PARAGRAPHS}</div></article></body>",
        f"<body><nav><a href=/x>One <p>Two</nav><article>{PARAGRAPHS}</article></body>",
        f"<body><article>{PARAGRAPHS}</article><div class=commentBody>I liked this a lot, thanks for it, see you all soon.</div></body>",
        f"<body><div class=siteNav>Home News Sport Weather Travel About us</div><article>{PARAGRAPHS}</article></body>",
    ],
)
def test_misleading_markup(html):
    assert text_of(html) == PROSE


def test_a_link_around_blocks_lasts_and_an_open_one_ends_with_its_block():
    blocks = pages.text_blocks("<div><a href=x><p>one two</p><p>three</p></a><p>four</p></div>")
    assert [(b[0], b[2]) for b in blocks] == [("one two", 2), ("three", 1), ("four", 0)]
    blocks = pages.text_blocks("<div><p><a href=x>one two</p><p>three</p></div><p>four</p>")
    assert [(b[0], b[2]) for b in blocks] == [("one two", 2), ("three", 0), ("four", 0)]


def test_unclosed_elements_take_no_square_time():
    for page in ("<div>" * 200_000 + "</p>" * 200_000, "<ul>" + "<div>" * 100_000 + "<li></li>" * 100_000):
        begin = time.time()
        pages.text_blocks(page + "end")
        assert time.time() - begin < 15


def test_dealt_join_is_a_join_and_spreads_hot_keys(spark):
    rows = [("hot" if i % 3 else None if i % 30 == 0 else f"k{i % 200}", i % 2, i) for i in range(6000)]
    many = spark.createDataFrame(rows, "a string, b long, at long").repartition(5)
    few = spark.createDataFrame([("hot", 0, "x"), ("hot", 0, "y"), ("hot", 1, "z"), ("k3", 1, "u"), ("k9", 1, "v"), ("none", 0, "w"), (None, 0, "n")], "a string, b long, what string")
    keys = ["a", "b"]
    counts = common.written(many.groupBy(*keys).agg(F.count("*").alias("n")))
    for how in ("inner", "left_semi"):
        got = common.dealt_join(many, few, counts, keys, ["at"], how)
        want = many.join(few, keys, how)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    total = sum(r.n for r in counts.collect())
    hot = counts.filter(F.col("n") * common.PARTS > total)
    assert hot.count() < common.PARTS
    none = common.dealt_join(many.limit(0), few, counts.limit(0), keys, ["at"])
    assert none.count() == 0


def test_no_part_of_a_dealt_join_holds_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(common, "PARTS", 20)
    many = spark.range(9000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id)) as a", "id as at")
    few = spark.createDataFrame([("hot",)], "a string").select("a", F.monotonically_increasing_id().alias("place"))
    counts = common.written(many.groupBy("a").agg(F.count("*").alias("n")))
    seen = []
    drop = type(many).drop
    monkeypatch.setattr(type(many), "drop", lambda self, *c: (seen.append(self) if c == ("_part",) else None) or drop(self, *c))
    assert common.dealt_join(many, few, counts, ["a"], ["at"]).count() == 3000
    parts = [r["count"] for r in seen[-1].groupBy("a", "_part").count().collect()]
    assert len(parts) == 7 and max(parts) < 2 * 9000 / 20
