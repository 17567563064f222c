import hashlib
import random

import numpy as np
import pytest

from telesift.llm import align, bpe

ODD = ["", " ", "  ", "   a", "a  b ", "a \n b\n\n  c", "\n\na", " \t　x  y", "<|endoftext|>", "a <|endoftext|><|endoftext|> b", "don't we'll", "▁a b", "a ▁ b", "\x00\x1c \x85 z", "漢字 é ﬁ 🙂🙂  🙂", "x" * 3000, "ab " * 2000, " " * 4000, "\n" * 500 + " q"]


@pytest.fixture(scope="module")
def texts(corpus):
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "the", " the", "1", "é", "漢", "!", "'s", "\x1c", "\x85", "<|endoftext|>", "🙂", "ing", " \n ", " ", "<s>", "</s>"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [t for _, t, *_ in corpus if t]


@pytest.fixture(scope="module")
def known():
    import public_tokenizers
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out.no_truncation()
    out.no_padding()
    return out


def table_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string").repartition(3)


def test_ids_and_texts_are_the_librarys(spark, texts, known):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(-1, None, "x", None), (None, "one two", None, None), (0, "one two", None, None)]
    got = bpe.decode_documents(bpe.encode_documents(table_of(spark, rows))).collect()
    assert len(got) == len(rows)
    want = sorted((str(d), known.encode(t or "", add_special_tokens=False).ids) for d, t, *_ in rows)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.n_tokens == len(ids) and r.text == known.decode(ids, skip_special_tokens=False)
    one = bpe.encoding_digest(table_of(spark, [(5, "a b", None, None)])).first()
    ids = np.array(known.encode("a b").ids, "<u4").tobytes()
    assert tuple(one) == (5, 2, hashlib.sha256(ids).hexdigest(), hashlib.sha256(b"a b").hexdigest())
    assert bpe.encoding_digest(table_of(spark, rows).filter("false")).count() == 0


def test_added_tokens_may_be_plain_text(known):
    text = "a <|endoftext|> b"
    known.encode_special_tokens = True
    try:
        assert bpe.Encoder().encode([text], added=False)[0].tolist() == known.encode(text, add_special_tokens=False).ids
    finally:
        known.encode_special_tokens = False
    assert bpe.decode(np.array([50256, 64, 99999, 220])) == "<|endoftext|>a "


def test_windows_and_a_short_memory_give_the_same_ids(texts, known, monkeypatch):
    whole = [known.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(bpe, "WINDOW", 7)
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    encoder = bpe.Encoder()
    assert [i.tolist() for k in range(0, len(texts), 9) for i in encoder.encode(texts[k : k + 9])] == whole


def test_every_character_is_split_as_the_library_does(known):
    texts = [f"a{chr(c)} b {chr(c)}1 {chr(c)}  {chr(c)}" for c in [*range(0x3100), *range(0xFE00, 0x10000), *range(0x1F000, 0x1F100)]]
    assert [i.tolist() for i in bpe.Encoder().encode(texts)] == [e.ids for e in known.encode_batch(texts, add_special_tokens=False)]


def brute_alignment(rows, known):
    """Straight from the definition: every token's byte range, all overlapping pairs, counts over documents."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = {c: b for b, c in bpe.byte_characters().items()}
    known.encode_special_tokens = True
    told = []
    for _, text in rows:
        a = known.encode(" " + (text or ""), add_special_tokens=False).ids
        b = model.encode(text or "")
        a_bytes = [bytes(back[c] for c in known.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in b)]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            told.append(None)
            continue
        spans = []
        for ids, parts in ((a, a_bytes), (b, b_bytes)):
            at, out = 0, []
            for i, p in zip(ids, parts, strict=True):
                out.append((i, at, at + len(p)))
                at += len(p)
            spans.append(out)
        told.append(spans)
    known.encode_special_tokens = False
    links = []
    for t in told:
        if t is None:
            links.append([])
            continue
        a, b = t
        found, j = [], 0
        for x, lo, hi in a:
            while j and b[j - 1][2] > lo:
                j -= 1
            while b[j][2] <= lo:
                j += 1
            k = j
            while k < len(b) and b[k][1] < hi:
                found.append((x, b[k][0]))
                k += 1
        links.append(found)
    count, best = {}, {}
    for found in links:
        for pair in set(found):
            count[pair] = count.get(pair, 0) + 1
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (doc_id, _), t, found in zip(rows, told, links, strict=True):
        if t is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b = t
        ends = sorted({hi for *_, hi in a} & {hi for *_, hi in b})
        groups, lo = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, begin, _ in side if lo <= begin < end) for side in (a, b)))
            lo = end
        text = ";".join(groups)
        out.append((doc_id, len(a), len(b), len(groups), len(found), sum(count[p] == best[p[0]] for p in found), sum(count[p] for p in found), hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_alignment_against_brute_force(spark, texts, known, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts) if len(t) < 3500] + [(-1, None), (7, "one two three"), (7, "one two three"), (None, "one two")]
    want = sorted(map(str, brute_alignment(rows, known)))
    docs = table_of(spark, [(*r, "x", "y") for r in rows])
    result, pairs = align.align_documents(docs)
    got = [tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in result.collect()]
    assert sorted(map(str, got)) == want
    assert pairs.filter("best").select("a").distinct().count() == pairs.select("a").distinct().count()
    assert align.alignment_digest(docs.filter("false")).count() == 0


def test_small_blocks_give_the_same_notes(texts, monkeypatch):
    def told(limit):
        monkeypatch.setattr(align, "BLOCK_ENTRIES", limit)
        monkeypatch.setattr(align, "TOGETHER", limit)
        block, documents, pairs = align.Block("byte_bpe_50k", "piece_bpe_32k"), [], {}

        def end():
            keys = {}
            for batch in block.notes(0):
                for r in batch.to_pylist():
                    if r["kind"] == align.GROUP:
                        keys[r["number"]] = r["key"]
                    elif r["kind"] == align.PAIR:
                        pairs[r["a"], r["b"]] = pairs.get((r["a"], r["b"]), 0) + r["n"]
                    else:
                        documents.append((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["groups_sha256"], r["groups"], r["times"]))
            for i, (*front, at, times) in enumerate(documents):
                if isinstance(at, bytes):
                    documents[i] = (*front, None, sorted(zip([keys[g] for g in np.frombuffer(at, "<i4").tolist()], np.frombuffer(times, "<i4").tolist(), strict=True)))
            block.begin()

        for i, text in enumerate(texts):
            block.add(i, text)
            if block.full():
                end()
        end()
        return sorted(map(str, documents)), pairs

    assert told(300) == told(1 << 23)
