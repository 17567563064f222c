"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telesift.llm.common import Forest, bounded_batches, components, pick, written
from telesift.llm.words import BASE, grams, inside, mix, words_of

WIDTH = 5  # words in a shingle
SLOTS = 97  # a prime, so that a * k + b runs through all slots
BANDS, ROWS = 24, 4
NEED, OF = 75, 100  # similarity as a fraction
SMALL_BUCKET = 32  # documents of a bucket whose pairs are rows; larger ones are compared block by block
BLOCK = 256
MOST_BROADCAST = 4_000_000  # ids that are sent to all executors (some 100 MB in memory), at most
TEXTS_AT_ONCE = 256


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, first): the distinct shingles of text i are fingerprints[first[i]:first[i + 1]], ascending."""
    words = words_of(texts, fold=True)
    n_words = np.diff(words.first)
    ok = inside(words.first, len(words.hashes), WIDTH)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    values, owners = grams(words.hashes, WIDTH)[ok], owner[: len(ok)][ok]
    short = np.flatnonzero((n_words > 0) & (n_words < WIDTH))
    if len(short):
        # the whole sequence as one shingle, told apart from others by its length
        whole = np.zeros(len(short), dtype=np.uint64)
        for j in range(WIDTH - 1):
            here = n_words[short] > j
            whole[here] = whole[here] * np.uint64(BASE) + words.hashes[words.first[short[here]] + j]
        values = np.concatenate([values, mix(whole + n_words[short].astype(np.uint64))])
        owners = np.concatenate([owners, short])
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    values, owners = values[new], owners[new]
    return values, np.searchsorted(owners, np.arange(len(n_words) + 1))


def super_minhash(values: np.ndarray, first: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """A signature row per set; equal entries estimate the Jaccard similarity. Rows of empty sets hold the largest number.

    Every element has a random permutation of the slots and gives slot p the value (rank of p, random
    number), so the ranks an element gives are all different: less variance than independent hashes.
    A slot keeps its smallest value. Ranks come in rounds; a set stops in the round that no longer can
    lower any slot. The permutation is k -> a * k + b modulo a prime: any two slots have the joint
    ranks that a uniform permutation gives them, which is all the variance depends on.
    """
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    most = np.iinfo(np.uint64).max
    out = np.full(n * slots, most, dtype=np.uint64)
    seed = mix(values + np.uint64(BASE))
    step = (seed % np.uint64(slots - 1) + np.uint64(1)).astype(np.int64)
    slot = ((seed >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)
    live = np.arange(len(values))
    for rank in range(slots):
        if not len(live):
            break
        number = mix(seed[live] + np.uint64((rank + 1) * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(32)
        np.minimum.at(out, owner[live] * slots + slot[live], number | np.uint64(rank << 32))
        slot[live] = (slot[live] + step[live]) % slots
        # a set whose worst slot already has this rank or a lower one cannot change any more
        worst = out.reshape(n, slots).max(axis=1) >> np.uint64(32)
        live = live[(worst > np.uint64(rank))[owner[live]]]
    return out.reshape(n, slots)


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.zeros((len(signatures), bands), dtype=np.uint64)
    for j in range(rows):
        out = out * np.uint64(BASE) + signatures[:, j : bands * rows : rows]
    return mix(out + np.arange(bands, dtype=np.uint64))


def _sign(batches):
    """(doc_id, text_key, n_shingles, set1, set2, bands) of (doc_id, text, text_key): set1 and set2 identify the set of shingles."""
    for batch in batches:
        for lo in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(lo, TEXTS_AT_ONCE)
            values, first = shingle_sets(part.column(1))
            keys = band_keys(super_minhash(values, first)).view(np.int64)
            sums = np.zeros((2, len(values) + 1), dtype=np.uint64)
            np.cumsum(mix(values + np.uint64(1)), out=sums[0, 1:])
            np.cumsum(mix(values + np.uint64(2)), out=sums[1, 1:])
            set1, set2 = (sums[:, first[1:]] - sums[:, first[:-1]]).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
            columns = [part.column(0).cast(pa.int64()), part.column(2), pa.array(np.diff(first)), pa.array(set1), pa.array(set2), bands]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_shingles", "set1", "set2", "bands"])


def _verify(batches):
    """Of rows (src, dst, src_text, dst_text) the (src, dst) that are similar enough."""
    for batch in batches:
        for lo in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(lo, TEXTS_AT_ONCE)
            ids = pa.concat_arrays([part.column(0), part.column(1)]).to_numpy(zero_copy_only=False)
            texts = pa.concat_arrays([part.column(2), part.column(3)])
            _, once, at = np.unique(ids, return_index=True, return_inverse=True)
            values, first = shingle_sets(texts.take(pa.array(once)))
            n = part.num_rows
            keep = np.zeros(n, dtype=bool)
            for i, (a, b) in enumerate(zip(at[:n].tolist(), at[n:].tolist(), strict=True)):
                one, two = values[first[a] : first[a + 1]], values[first[b] : first[b + 1]]
                both = np.sort(np.concatenate([one, two]), kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[i] = OF * shared >= NEED * (len(one) + len(two) - shared)
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(keep)), part.column(1).filter(pa.array(keep))], ["src", "dst"])


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (src, dst) that full sets confirm."""
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"{c}_text"))
    rows = pairs.join(side("dst"), "dst").join(side("src"), "src").select("src", "dst", "src_text", "dst_text")
    return rows.mapInArrow(_verify, "src long, dst long")


def intersections(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one (values, first) with all of another, as products of 0/1 matrices."""
    shared = np.intersect1d(one[0], two[0])
    out = np.zeros((len(one[1]) - 1, len(two[1]) - 1))

    def columns(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(shared, values), max(0, len(shared) - 1))
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        ok = shared[at] == values
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], owner[ok][order]

    if len(shared):
        (col_a, row_a), (col_b, row_b) = columns(*one), columns(*two)
        for lo in range(0, len(shared), 4096):
            a, b = np.zeros((out.shape[0], 4096), np.float32), np.zeros((out.shape[1], 4096), np.float32)
            for matrix, col, row in ((a, col_a, row_a), (b, col_b, row_b)):
                x, y = np.searchsorted(col, [lo, lo + 4096])
                matrix[row[x:y], col[x:y] - lo] = 1
            out += a @ b.T
    return out


def _compare_blocks(key, table):
    """(src, dst): similar documents of two blocks of a crowded bucket, as few as connect their components."""
    role = np.array(table.column("role").to_pylist())
    ids, component = table.column("doc_id").to_numpy(), table.column("component").to_numpy()
    texts = table.column("text").combine_chunks()
    sides = [np.flatnonzero(role == r) for r in (0, 1)]
    if not len(sides[1]):
        sides[1] = sides[0]
    sets = [shingle_sets(texts.take(pa.array(rows))) for rows in sides]
    size = [np.diff(first) for _, first in sets]
    shared = intersections(*sets)
    a, b = np.nonzero(OF * shared >= NEED * (size[0][:, None] + size[1][None, :] - shared))
    names, at = np.unique(component, return_inverse=True)
    forest, src, dst = Forest(len(names)), [], []
    for i, j in zip(sides[0][a].tolist(), sides[1][b].tolist(), strict=True):
        if forest.root(at[i]) != forest.root(at[j]):
            forest.join(at[i], at[j])
            src.append(ids[i])
            dst.append(ids[j])
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})


def _crowded(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between the components of large buckets (band, doc_id, component, major, minors, majors).

    A bucket's documents outside its largest component are compared, by block, with one another and with those
    inside. Blocks meet in a task that counts all intersections at once and returns links only.
    """
    part = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    blocks_minor, blocks_major = F.ceil(F.col("minors") / BLOCK).cast("int"), F.ceil(F.col("majors") / BLOCK).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    inside = placed.filter("component = major").select("band", "doc_id", "component", F.explode(every(blocks_minor)).alias("i"), part(blocks_major).alias("j"), F.lit(1).alias("role"))
    outside = placed.filter("component <> major").withColumn("own", part(blocks_minor))
    to_major = outside.select("band", "doc_id", "component", F.col("own").alias("i"), F.explode(every(blocks_major)).alias("j"), F.lit(0).alias("role"))
    # the blocks of the minor ones among themselves: the lower number first, -1 - block in place of a major block
    to_minor = outside.select("band", "doc_id", "component", "own", F.explode(every(blocks_minor)).alias("o"))
    to_minor = to_minor.select("band", "doc_id", "component", F.least("own", "o").alias("i"), (-1 - F.greatest("own", "o")).alias("j"), (F.col("own") > F.col("o")).cast("int").alias("role"))
    rows = inside.union(to_major).union(to_minor).join(texts, "doc_id")
    return rows.groupBy("band", "i", "j").applyInArrow(_compare_blocks, "src long, dst long")


def _fits(n: str, m: str):
    """Two sets of these sizes can be similar enough."""
    return F.least(n, m) * OF >= F.greatest(n, m) * NEED


def small_or_shuffled(rows: DataFrame) -> DataFrame:
    """A written table of a few numbers a row for a join: by broadcast if it has few rows, else by shuffle."""
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def text_key() -> Column:
    """Tells texts of one doc_id apart."""
    return F.xxhash64("text")


def link_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document (doc_id, text): see linked_rows."""
    return linked_rows(docs).select("doc_id", "n_shingles", "component_id", "kept")


def linked_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept, head) for every document (doc_id, text).

    Documents of one shingle set are folded into the one with the smallest doc_id. For the others: all
    slots of the signatures are banded; a bucket's documents are compared with its most central one
    (which meets the most documents over all its bands), by full sets; then every pair in a bucket that
    is still in two components is compared too. So a bucket of like documents costs one comparison
    each, and no pair that could join two components is left out. Two documents at exactly the
    threshold share no bucket with a probability of (1 - .75^4)^24, about 1 in 10,000.

    Every set is a node with a number of its own, so different texts of one doc_id are documents that link by themselves; component_id is the
    smallest doc_id of all that can be reached. head is true for one (doc_id, text_key) of each component, the smallest of its smallest
    doc_id, and for all that links with nothing; the same text under the same doc_id counts once.

    Null, empty or blank text has no shingles and links with nothing. Repeated rows are kept as rows; other columns are
    not read; an empty table gives no rows; a null doc_id links with nothing and is its own component (null).
    """
    texts = bounded_batches(pick(docs, {"doc_id": "long", "text": "string"})).withColumn("text_key", text_key())
    signed = written(texts.mapInArrow(_sign, "doc_id long, text_key long, n_shingles long, set1 long, set2 long, bands array<long>"))
    sets = signed.filter("n_shingles > 0 and doc_id is not null")
    folded = sets.groupBy("set1", "set2").agg(F.min(F.struct("doc_id", "text_key", "n_shingles", "bands")).alias("x"))
    folded = written(folded.select("set1", "set2", "x.*", F.monotonically_increasing_id().alias("node")))
    # from here on a doc_id is the number of a node
    entries = folded.select(F.col("node").alias("doc_id"), "n_shingles", F.explode("bands").alias("band"))
    buckets = entries.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    entries = written(entries.join(buckets, "band"))
    central = written(entries.groupBy("doc_id").agg(F.sum("n").alias("met")))
    # the texts of all documents that share a bucket: all that is compared below
    asked = written(folded.join(central.select(F.col("doc_id").alias("node")), "node").select("doc_id", "text_key", "node"))
    texts = texts.join(small_or_shuffled(asked), ["doc_id", "text_key"]).select(F.col("node").alias("doc_id"), "text")
    texts = written(texts.dropDuplicates(["doc_id"]))
    entries = written(entries.join(central, "doc_id"))
    hubs = entries.groupBy("band").agg(F.max(F.struct("met", (-F.col("doc_id")).alias("first"), "n_shingles")).alias("hub"))
    stars = entries.join(hubs, "band").withColumn("hub_id", -F.col("hub.first")).filter(F.col("hub_id") != F.col("doc_id"))
    stars = stars.filter(_fits("n_shingles", "hub.n_shingles"))
    stars = written(stars.select(F.least("doc_id", "hub_id").alias("src"), F.greatest("doc_id", "hub_id").alias("dst")).distinct())
    links = written(_similar(stars, texts))
    found = written(components(links))
    # every pair of a bucket whose ends are not connected yet
    placed = entries.select("band", "doc_id", "n_shingles", "n").join(found, F.col("doc_id") == F.col("id"), "left")
    placed = placed.select("band", "doc_id", "n_shingles", "n", F.coalesce("component", "doc_id").alias("component"))
    parts = placed.groupBy("band", "component").agg(F.count("*").alias("majors"), F.first("n").alias("n"))
    mixed = parts.groupBy("band").agg(F.max(F.struct("majors", "component")).alias("top"), F.count("*").alias("kinds"), F.first("n").alias("size")).filter("kinds > 1")
    mixed = mixed.select("band", F.col("top.component").alias("major"), F.col("top.majors").alias("majors"), (F.col("size") - F.col("top.majors")).alias("minors"))
    placed = written(placed.join(mixed, "band"))
    few = placed.filter(F.col("n") <= SMALL_BUCKET)
    other = few.select("band", F.col("doc_id").alias("dst"), F.col("n_shingles").alias("m"), F.col("component").alias("c"))
    rest = few.join(other, "band").filter("doc_id < dst and component <> c").filter(_fits("n_shingles", "m"))
    rest = written(rest.select(F.col("doc_id").alias("src"), "dst").distinct().join(stars, ["src", "dst"], "left_anti"))
    more = written(_similar(rest, texts).union(_crowded(placed.filter(F.col("n") > SMALL_BUCKET), texts)))
    # join the components that the late links connect
    at = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"{c}_to"))
    more = more.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    more = more.select(F.coalesce("src_to", "src").alias("src"), F.coalesce("dst_to", "dst").alias("dst"))
    final = written(components(found.select(F.col("component").alias("src"), F.col("id").alias("dst")).union(more)))
    heads = folded.join(final, F.col("node") == F.col("id"), "left").select("set1", "set2", "doc_id", "text_key", "component")
    lows = heads.filter("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("low"))
    own = F.struct("doc_id", "text_key")
    heads = heads.join(lows, "component", "left").select("set1", "set2", F.coalesce("low", own).alias("low"))
    linked = signed.drop("bands").join(heads, ["set1", "set2"], "left")
    low = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("low", own)).otherwise(own)
    linked = linked.select("doc_id", "text_key", "n_shingles", low.alias("low"))
    same = F.col("doc_id").eqNullSafe(F.col("component_id"))
    linked = linked.select("doc_id", "text_key", "n_shingles", F.col("low.doc_id").alias("component_id"), F.col("low.text_key").alias("_key"))
    return linked.withColumn("kept", same).withColumn("head", same & (F.col("text_key") == F.col("_key"))).drop("_key")
