"""Plain single-process versions of the operators, for small tables."""

import hashlib
import math
import zlib
from collections import Counter


def words(text, fold=False):
    raw = (text or "").encode()
    return (bytes(c + 32 if 65 <= c <= 90 else c for c in raw) if fold else raw).split()


def shingles(text):
    w = words(text, fold=True)
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def groups(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near_duplicates(rows):
    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = groups(ids, linked)
    return {d: (len(sets[d]), root[d], root[d] == d) for d in ids}


def repeats(rows, window=50):
    text = {d: words(t) for d, t in rows}
    first = {}
    for d in sorted(text):
        for i in range(len(text[d]) - window + 1):
            first.setdefault(tuple(text[d][i : i + window]), d)
    out = {}
    for d, w in text.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def base_scores(rows):
    count = Counter()
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 5 != 1:
            count.update([*words(t, fold=True), "end"])
    n, v = sum(count.values()), len(count)
    of = lambda w: math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1)))
    return {d: (len(words(t)) + 1, sum(count[w] > 0 for w in [*words(t, fold=True), "end"]), n, sum(of(w) for w in [*words(t, fold=True), "end"])) for d, t in rows}


def ppm_bits(texts, text, order, least):
    """Code length of a text for each language: longest context that occurs `least` times in all texts together, method C with exclusion."""
    counts = {}  # context -> lang -> Counter of following bytes
    for lang, mine in texts.items():
        for t in mine:
            raw = t.encode()
            for i, b in enumerate(raw):
                for d in range(min(order, i) + 1):
                    counts.setdefault(raw[i - d : i], {}).setdefault(lang, Counter())[b] += 1
    seen = sorted({b for mine in texts.values() for t in mine for b in t.encode()})
    known = lambda c: c == b"" or sum(sum(x.values()) for x in counts.get(c, {}).values()) >= least

    def prob(lang, context):
        below = prob(lang, context[1:]) if context else dict.fromkeys([None, *seen], 1 / (len(seen) + 1))
        n = counts.get(context, {}).get(lang, Counter())
        total, kinds = sum(n.values()), len(n)
        if not total:
            return below
        rest = max(1 - sum(below[b] for b in n), 1e-12)
        return {b: n[b] / (total + kinds) if b in n else kinds / (total + kinds) * p / rest for b, p in below.items()}

    out = dict.fromkeys(texts, 0.0)
    raw = text.encode()
    for i, b in enumerate(raw):
        d = 0
        while d < min(order, i) and known(raw[i - d - 1 : i]):
            d += 1
        for lang in texts:
            p = prob(lang, raw[i - d : i])
            out[lang] -= math.log2(max(p[b if b in p else None], 1e-12))
    return out
