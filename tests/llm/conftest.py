import random

import pytest


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Small documents with copies, near copies, shared passages, blanks and ties: (doc_id, text, lang, source)."""
    rng = random.Random(7)
    english = "the of and to in is that for with stone river house light water green".split() + [f"w{i}ing" for i in range(300)]
    german = "der die und das nicht mit von auf ein haus licht wasser".split() + [f"{i}ungen" for i in range(300)]
    rows = []
    passage = sentence(rng, 60, english)
    for i in range(60):
        lang, words = ("en", english) if i % 3 else ("de", german)
        rows.append((i, sentence(rng, rng.randint(3, 160), words), lang, f"s{i % 4}"))
    for i in range(60, 75):  # near copies of a document, and exact ones
        base = rows[1][1].split()
        base[rng.randrange(len(base))] = f"changed{i}"
        rows.append((i, " ".join(base) if i % 2 else rows[1][1], "en", "s0"))
    for i in range(75, 85):  # a passage that several documents share
        rows.append((i, f"{sentence(rng, 20, english)} {passage}\t{sentence(rng, 30, english)}", "en", "s1"))
    rows += [(85, None, "en", "s1"), (86, "", "de", None), (87, " \n\t ", "en", None), (88, "one two", "en", None), (89, "ONE two", "en", "s3"), (90, "!!! 123", None, "s3")]
    rows.append((91, sentence(rng, 6000, english), "en", "s2"))
    rows.append((92, "word " * 400, "en", "s2"))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(a, b, c, d, len(b or ""), "x") for a, b, c, d in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.filter("doc_id < 0")
