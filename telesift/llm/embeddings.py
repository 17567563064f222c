"""Near-duplicate embeddings: cells of near vectors, a navigable small-world graph per shard, audited beam search, verified cosine, components."""

from __future__ import annotations

import pickle
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telesift.llm.common import bounded_batches, components, pick, written
from telesift.llm.words import mix

LINK = 0.95
DEGREE = 12  # neighbours of a node, twice as many on the ground layer
BUILD_BEAM = 40
FIRST_BEAM = 32
SHARD_VALUES = 1 << 20  # components of a shard's vectors, about; a graph is built, held and asked by one task
QUERY_VALUES = 1 << 20  # components of the vectors that are looked up at once
SAMPLE_VALUES = 1 << 22  # components of the vectors that cells are laid out from, at most
SAMPLED = 32  # of these vectors for each cell
TURNED = 4096  # points of the sample that are turned to the threshold, each two ways
ROUTE_RECALL = 0.998  # of them, and of the links of a sample of vectors, that lie within the cells that are asked
MEASURED = 1024  # vectors that are compared with all others, to see how far links reach
WIDER = (1.0, 1.3, 1.7, 2.2, 3.0)  # times the margin that turned points need; beyond, all cells are asked
SCORES = 1 << 22  # cosines held at once
MOST_TASKS = 10_000
WIDEST_BEAM = 256  # a graph that needs a wider one is not relied on: its shard is compared in full
AUDITED = 64  # queries of a block that are compared with the whole shard, at least, and the share of all
AUDITED_SHARE = 1 / 16
PROBES = 512  # points of a graph that are looked up from a place at the threshold
PROBE_MARGIN = 0.002  # of the probes' cosine above the threshold
FEW_LINKS = 2 * DEGREE
NEED_RECALL = 0.99
DOUBT = 1e-5  # cosines in single precision that are this near to the threshold are taken again in double precision
VISITED_BYTES = 24 << 20  # marks of visited points, for all queries in step


class Graph:
    """Hierarchical navigable small world over unit vectors, built and searched many points at a time.

    Layer 0 holds all points, each higher layer about one in DEGREE of the one below (by a hash of the
    id). A point is linked with the nearest points that the beam search finds among those inserted before
    (batches double, as points of one batch do not see each other in the graph; they are compared
    directly), and with those that chose it; full rows keep first those that are nearer to the point than to
    any nearer neighbour kept, so that near copies do not close on themselves, then the nearest.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors = vectors.astype(np.float32)
        rank = mix(ids.astype(np.uint64)).astype(np.float64) / 2.0**64
        level = np.minimum((-np.log(np.maximum(rank, 1e-18)) / np.log(DEGREE)).astype(np.int64), 6)
        self.order = np.argsort(-level, kind="stable")
        self.vectors = self.vectors[self.order]
        level = level[self.order]
        # after this sort the points of a layer come first, so a layer is a count
        self.sizes = [int((level >= layer).sum()) for layer in range(int(level.max(initial=0)) + 1)]
        self.layers = []
        for layer, n in enumerate(self.sizes):
            self.layers.append(np.full((n, DEGREE * (2 if layer == 0 else 1)), -1, dtype=np.int32))
        for layer in range(len(self.layers) - 1, -1, -1):
            self._build(layer)

    def _build(self, layer: int) -> None:
        links, n = self.layers[layer], self.sizes[layer]
        width = links.shape[1]
        done, batch = 0, 64
        while done < n:
            new = np.arange(done, min(n, done + batch))
            near, how = self._nearest_of(new, new, width, skip=True)
            if done:
                found, scores = self._descend(self.vectors[new], layer, BUILD_BEAM, done)
                near, how = np.concatenate([near, found], axis=1), np.concatenate([how, scores], axis=1)
            near = np.concatenate([self._diverse(self.vectors[new[lo : lo + 1024]], near[lo : lo + 1024], how[lo : lo + 1024], width) for lo in range(0, len(new), 1024)])
            links[new] = near
            self._link_back(links, new, near)
            done += len(new)
            batch = min(4096, max(64, done))

    def _nearest_of(self, rows: np.ndarray, others: np.ndarray, k: int, skip: bool) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of `others` for each of rows, in blocks."""
        k = min(k, len(others))
        near, how = np.empty((len(rows), k), np.int32), np.empty((len(rows), k), np.float32)
        for lo in range(0, len(rows), 512):
            part = rows[lo : lo + 512]
            scores = self.vectors[part] @ self.vectors[others].T
            if skip:
                scores[part[:, None] == others[None, :]] = -2.0
            top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            near[lo : lo + 512] = others[top]
            how[lo : lo + 512] = np.take_along_axis(scores, top, axis=1)
        near[how < -1.5] = -1
        return near, how

    def _link_back(self, links: np.ndarray, new: np.ndarray, near: np.ndarray) -> None:
        source = np.repeat(new, near.shape[1])
        target = near.ravel()
        source, target = source[target >= 0], target[target >= 0]
        touched, at = np.unique(target, return_inverse=True)
        if not len(touched):
            return
        order = np.argsort(at, kind="stable")
        count = np.bincount(at)
        first = np.cumsum(count) - count
        sources = source[order]
        # rows with as many new neighbours together, in blocks of bounded size
        by, lo = np.argsort(count, kind="stable"), 0
        while lo < len(by):
            most = int(count[by[min(lo + 1023, len(by) - 1)]])
            rows = by[lo : lo + max(1, min(1024, (16 << 20) // ((links.shape[1] + most) * self.vectors.shape[1])))]
            lo += len(rows)
            column = np.arange(int(count[rows].max()))[None, :]
            given = np.where(column < count[rows][:, None], sources[np.minimum(first[rows][:, None] + column, len(sources) - 1)], -1).astype(np.int32)
            both = np.concatenate([links[touched[rows]], given], axis=1)
            how = np.einsum("ij,ikj->ik", self.vectors[touched[rows]], self.vectors[both])
            how[both < 0] = -2.0
            links[touched[rows]] = self._diverse(self.vectors[touched[rows]], both, how, links.shape[1])

    def _diverse(self, own: np.ndarray, ids: np.ndarray, scores: np.ndarray, width: int) -> np.ndarray:
        """`width` different ids of each row: those nearer to the row's vector than to any taken before, from the nearest on; then the nearest."""
        ids, scores, _ = _merge(ids, scores, np.zeros(ids.shape, bool), max(width, ids.shape[1]))
        if ids.shape[1] == width:
            return ids
        x, rows = self.vectors[ids], np.arange(len(ids))
        taken, out = np.zeros(ids.shape, bool), ids < 0
        for _ in range(width):
            free = np.where(taken | out, np.float32(-3.0), scores)
            at = free.argmax(axis=1)
            some = free[rows, at] > -2.5
            if not some.any():
                break
            taken[rows[some], at[some]] = True
            out |= some[:, None] & ((x @ x[rows, at][:, :, None])[:, :, 0] > scores)
        rank = np.where(ids < 0, np.float32(-9.0), scores + 4 * taken.astype(np.float32))
        return np.take_along_axis(ids, np.argpartition(-rank, width - 1, axis=1)[:, :width], axis=1)

    def _descend(self, asked: np.ndarray, layer: int, beam: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of nearest points on a layer, entered from the layers above; only the first `known` points count."""
        start = np.zeros((len(asked), 1), dtype=np.int32)
        for upper in range(len(self.layers) - 1, layer, -1):
            start = self._search(asked, self.layers[upper], start, 4, self.sizes[upper])[0]
        return self._search(asked, self.layers[layer], start, beam, known)

    def _search(self, asked: np.ndarray, links: np.ndarray, start: np.ndarray, beam: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        out_ids, out_scores = np.full((len(asked), beam), -1, np.int32), np.full((len(asked), beam), -2.0, np.float32)
        step = max(64, min(1024, VISITED_BYTES // max(1, known)))
        for lo in range(0, len(asked), step):
            out_ids[lo : lo + step], out_scores[lo : lo + step] = self._beam(asked[lo : lo + step], links, start[lo : lo + step], beam, known)
        return out_ids, out_scores

    def _beam(self, asked: np.ndarray, links: np.ndarray, start: np.ndarray, beam: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all queries in step: each opens the best points of its beam that are not open yet.

        Marks of visited points keep a point from coming twice; the last column takes what is no point.
        """
        n, at_once = len(asked), min(4, beam)
        ids = np.full((n, beam), -1, dtype=np.int32)
        scores = np.full((n, beam), -2.0, dtype=np.float32)
        opened = np.zeros((n, beam), dtype=bool)
        visited = np.zeros((n, known + 1), dtype=bool)
        visited[:, known] = True
        rows = np.arange(n)[:, None]
        for k in range(min(start.shape[1], beam)):
            first = np.where((start[:, k] >= 0) & (start[:, k] < known), start[:, k], 0)
            new = ~visited[rows[:, 0], first]
            visited[rows[:, 0], first] = True
            ids[:, k] = np.where(new, first, -1)
            scores[:, k] = np.where(new, np.einsum("ij,ij->i", asked, self.vectors[first]), np.float32(-2.0))
        live = np.arange(n)
        while True:
            waiting = np.where(opened[live] | (ids[live] < 0), np.float32(-3.0), scores[live])
            if at_once < beam:
                best = np.argpartition(waiting, beam - at_once, axis=1)[:, beam - at_once :]
            else:
                best = np.broadcast_to(np.arange(beam), waiting.shape)
            value = np.take_along_axis(waiting, best, axis=1)
            some = value.max(axis=1) > -2.5
            live, best, value = live[some], best[some], value[some]
            if not len(live):
                return ids, scores
            chosen = np.where(value > -2.5, ids[live[:, None], best], -1)
            opened[live[:, None], best] = True
            near = np.where((chosen < 0)[:, :, None], known, links[chosen])
            near[(near < 0) | (near >= known)] = known
            for k in range(at_once):
                seen = visited[live[:, None], near[:, k]]
                visited[live[:, None], near[:, k]] = True
                near[:, k][seen] = known
            near = near.reshape(len(live), -1)
            row, column = np.nonzero(near < known)
            point = near[row, column]
            how = np.full(near.shape, -2.0, dtype=np.float32)
            for lo in range(0, len(row), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                how[row[part], column[part]] = np.einsum("ij,ij->i", asked[live[row[part]]], self.vectors[point[part]])
            both, both_how = np.concatenate([ids[live], np.where(near < known, near, -1)], axis=1), np.concatenate([scores[live], how], axis=1)
            both_open = np.concatenate([opened[live], np.zeros(near.shape, bool)], axis=1)
            top = np.argpartition(both_how, both_how.shape[1] - beam, axis=1)[:, both_how.shape[1] - beam :]
            ids[live], scores[live], opened[live] = (np.take_along_axis(x, top, axis=1) for x in (both, both_how, both_open))

    def near(self, asked: np.ndarray, rows: np.ndarray, least: float):
        """(rows, near) in blocks: for these rows of asked, which points have a cosine of `least` or more, in the graph's own order."""
        for lo in range(0, len(rows), 256):
            yield rows[lo : lo + 256], asked[rows[lo : lo + 256]] @ self.vectors.T >= least

    def _compare(self, asked: np.ndarray, rows: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) of all pairs of these rows of asked, from a full comparison."""
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for part, near in self.near(asked, rows, least):
            q, p = np.nonzero(near)
            pairs.append((part[q], self.order[p]))
        query, point = (np.concatenate(x) for x in zip(*pairs, strict=True))
        return query, point

    def probed_beam(self, least: float) -> int:
        """The first beam, from FIRST_BEAM on and doubled each time, that finds NEED_RECALL of the probes; more than WIDEST_BEAM if none does.

        A probe is a point turned in a random direction until its cosine with the point is just above the
        threshold: the hardest link, and one known without a comparison, however rare links are in the data.
        """
        n, width = self.vectors.shape
        beam = FIRST_BEAM
        if n < 2 or width < 2:
            return beam
        rng = np.random.default_rng(n)
        chosen = np.unique(np.linspace(0, n - 1, min(n, PROBES)).astype(np.int64))
        x = self.vectors[chosen].astype(np.float64)
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(axis=1, keepdims=True) * x
        away /= np.maximum(np.sqrt((away * away).sum(axis=1, keepdims=True)), 1e-12)
        cosine = min(1.0, least + PROBE_MARGIN)
        asked = (cosine * x + np.sqrt(1 - cosine * cosine) * away).astype(np.float32)
        while beam <= WIDEST_BEAM:
            ids, scores = self._descend(asked, 0, beam, n)
            # a beam full of links stands for a full comparison
            if (((ids == chosen[:, None]) & (scores >= least)).any(axis=1) | (scores.min(axis=1) >= least)).mean() >= NEED_RECALL:
                break
            beam *= 2
        return beam

    def search(self, asked: np.ndarray, least: float, own: np.ndarray | None = None, beam: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, full): pairs found with a cosine of `least` or more, and the queries to be compared with every point instead.

        own: the point that a query is itself, or -1, left out. The search begins with the beam that the graph's probes
        need. A query whose whole beam is that near has more links than the beam holds: it is in full. Then a share of the
        queries is compared with every point. Recall is taken for each query and averaged, apart for queries
        with few and with many links; while either is under NEED_RECALL, all queries are repeated with beams of twice the
        width, and beyond WIDEST_BEAM all are in full.
        """
        asked = asked.astype(np.float32)
        n, every = len(self.vectors), np.arange(len(asked))
        none = np.zeros(0, np.int64)
        itself = np.full(len(asked), -1) if own is None else own
        beam = self.probed_beam(least) if beam is None else beam

        def others(query: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keep = point != itself[query]
            return query[keep], point[keep]

        audited = min(len(asked), max(AUDITED, int(np.ceil(len(asked) * AUDITED_SHARE))))
        chosen = np.unique(np.linspace(0, len(asked) - 1, audited).astype(np.int64)) if len(asked) else none
        truth = np.bincount(others(*self._compare(asked, chosen, least))[0], minlength=len(asked))[chosen]
        few, many = (truth > 0) & (truth <= FEW_LINKS), truth > FEW_LINKS
        while beam <= WIDEST_BEAM:
            ids, scores = self._descend(asked, 0, beam, n)
            crowded = (scores.min(axis=1) >= least) if beam < n else np.zeros(len(asked), bool)
            q, k = np.nonzero((scores >= least) & (ids >= 0) & ~crowded[:, None])
            query, point = others(q, self.order[ids[q, k]])
            recall = np.where(crowded[chosen], 1.0, np.bincount(query, minlength=len(asked))[chosen] / np.maximum(1, truth))
            if all(recall[part].mean() >= NEED_RECALL for part in (few, many) if part.any()):
                return query, point, every[crowded]
            beam *= 2
        return none, none, every

    def joined(self, asked: np.ndarray, full: np.ndarray, itself: np.ndarray, least: float, sure, copies: np.ndarray, label: np.ndarray, told=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(src, dst, links) for the queries of asked that are in full: links counts the copies of all points near each of them,
        but not the query itself; (src, dst) are few of these (query, point) pairs, which connect the same components.

        sure(query, point) settles what single precision leaves open. label has a number for each component of the points
        that is known to be joined, in the graph's order, and is changed. told(queries, near) gets who is near whom, in that order.
        """
        weight = copies[self.order].astype(np.float64)
        back = np.argsort(self.order)
        src, dst, links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, len(full), 256):
            rows = full[lo : lo + 256]
            scores = asked[rows] @ self.vectors.T
            near = scores >= least + DOUBT
            q, p = np.nonzero((scores >= least - DOUBT) & ~near)
            near[q, p] = sure(rows[q], self.order[p])
            known = itself[rows] >= 0
            near[known, back[itself[rows[known]]]] = False
            links.append((near @ weight).astype(np.int64))
            if told is not None:
                told(rows, near)
            for i, query in enumerate(rows.tolist()):
                at = np.flatnonzero(near[i])
                if itself[query] >= 0:
                    at = np.append(at, back[itself[query]])
                if not len(at):
                    continue
                labels, first = np.unique(label[at], return_index=True)
                if itself[query] < 0 or len(labels) > 1:
                    src.append(np.full(len(labels), query))
                    dst.append(self.order[at[first]])
                    if len(labels) > 1:
                        label[np.isin(label, labels)] = labels[0]
        return np.concatenate(src), np.concatenate(dst), np.concatenate(links)

    def within(self, asked: np.ndarray, least: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) of all pairs found with a cosine of `least` or more; own: the point that a query is itself, or -1, left out."""
        query, point, full = self.search(asked, least, own)
        rest = self._compare(asked.astype(np.float32), full, least)
        keep = rest[1] != (np.full(len(asked), -1) if own is None else own)[rest[0]]
        return np.concatenate([query, rest[0][keep]]), np.concatenate([point, rest[1][keep]])


def _merge(ids: np.ndarray, scores: np.ndarray, opened: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `width` best of each row without repeats; an id that is opened anywhere stays opened."""
    order = np.lexsort((~opened, ids), axis=1)
    ids, scores, opened = (np.take_along_axis(x, order, axis=1) for x in (ids, scores, opened))
    again = np.zeros(ids.shape, dtype=bool)
    again[:, 1:] = ids[:, 1:] == ids[:, :-1]
    ids, scores = np.where(again, -1, ids), np.where(again | (ids < 0), np.float32(-2.0), scores)
    if ids.shape[1] > width:
        top = np.argpartition(-scores, width - 1, axis=1)[:, :width]
        ids, scores, opened = (np.take_along_axis(x, top, axis=1) for x in (ids, scores, opened))
    elif ids.shape[1] < width:
        pad = ((0, 0), (0, width - ids.shape[1]))
        ids, scores, opened = np.pad(ids, pad, constant_values=-1), np.pad(scores, pad, constant_values=-2.0), np.pad(opened, pad)
    return ids, scores, opened & (ids >= 0)


def _unit(values: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def link_vectors(embeddings: DataFrame, least: float = LINK, shards: int = 1, shard_values: int = SHARD_VALUES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row (vec_id, embedding).

    Equal vectors are folded into one with a count. Where the others of a length have more than shard_values components, they are dealt to
    the nearest of that many centres (`shards` at least, for the most frequent length), and cells that are crowded to several shards by hash. A shard becomes a graph, and a
    vector is looked up in the shards of all cells that are nearly as near to it as its own (`_cells`, `_margins` say how nearly). A task
    builds a graph and asks it what comes along, so no graph is written or sent. What is found counts if the
    cosine in double precision is `least` or more. n_links counts the other rows linked directly, equal ones included.

    A vector with more links in a shard than a beam holds is compared with the whole shard, which gives a number
    of links and the few pairs that join components: a group of n near copies leaves no n * n rows.

    A vector that is null or zero, has no components, or holds null or non-finite ones links with nothing,
    and vectors of different lengths don't link. Rows that repeat a vec_id count as rows of their own but are one
    member of a component; a null vec_id is kept as it is (null component). Other columns are not read; an empty table gives no rows.
    """
    rows = pick(embeddings, {"vec_id": "long", "embedding": "array<double>"})
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = F.col("embedding").isNotNull() & ~F.coalesce(F.exists("embedding", odd), F.lit(True)) & F.exists("embedding", lambda x: x != 0)
    # 0.0 + x: -0.0 and 0.0 are one value
    rows = rows.withColumn("embedding", F.when(good, F.transform("embedding", lambda x: x + F.lit(0.0))))
    keys = (F.xxhash64("embedding").alias("key1"), F.xxhash64(F.lit(7), F.col("embedding")).alias("key2"))
    named = rows.select("vec_id", F.when(F.col("embedding").isNotNull(), keys[0]).alias("key1"), F.when(F.col("embedding").isNotNull(), keys[1]).alias("key2"))
    folded = rows.filter("embedding is not null and vec_id is not null").groupBy(*keys).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("embedding").alias("vector"))
    # a number of its own for each vector: two different ones may have the same smallest vec_id
    folded = written(folded.select("key1", "key2", F.xxhash64("key1", "key2").alias("id"), "vec_id", "copies", F.size("vector").alias("size"), "vector"))
    found = _find(folded.select("id", "vec_id", "copies", "vector", "size"), least, shards, shard_values)
    counted = found.filter("kind = 2").select("src", "shard", "copies")
    # a pair that one side did not find counts for both, unless that side was compared with the whole shard
    pairs = found.filter("kind = 0")
    pairs = pairs.select("src", "dst", "copies", "shard").union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("own").alias("copies"), F.col("home").alias("shard")))
    pairs = pairs.groupBy("src", "dst").agg(F.first("copies").alias("copies"), F.first("shard").alias("shard")).join(counted.select("src", "shard"), ["src", "shard"], "left_anti")
    direct = pairs.select("src", "copies").union(found.filter("kind in (2, 3)").select("src", "copies")).groupBy("src").agg(F.sum("copies").alias("near"))
    heads = folded.select("key1", "key2", "id", "vec_id", "copies").join(direct, F.col("id") == F.col("src"), "left")
    heads = heads.select("key1", "key2", F.col("vec_id").alias("head"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    linked = written(named.join(heads, ["key1", "key2"], "left").select("vec_id", "head", "n_links"))
    joined = found.filter("kind < 2").select(F.least("src_vec", "dst_vec").alias("src"), F.greatest("src_vec", "dst_vec").alias("dst")).distinct()
    copies = linked.filter("head is not null and vec_id is not null").select(F.col("head").alias("src"), F.col("vec_id").alias("dst")).distinct()
    placed = components(joined.union(copies)).withColumnRenamed("id", "vec_id")
    out = linked.join(placed, "vec_id", "left")
    known = F.col("vec_id").isNotNull()
    out = out.select("vec_id", F.coalesce(F.when(known, F.col("n_links")), F.lit(0)).cast("long").alias("n_links"), F.when(known, F.coalesce("component", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


FOUND = "kind int, src long, dst long, copies long, own long, src_vec long, dst_vec long, shard int, home int"
ASKED = "size int, shard int, point boolean, id long, vec_id long, copies long, home int, visits binary, vector binary"


class Cells(NamedTuple):
    """The cells of the vectors of one length: their centres, the first shard of each and its number of shards, and how much
    further than the nearest centre, by cosine, a vector asks."""

    centres: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    margin: float

    def home(self, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The shard of each vector, by its cosines with the centres."""
        cell = scores.argmax(axis=1)
        return (self.first[cell] + mix(ids.astype(np.uint64)) % self.parts[cell].astype(np.uint64)).astype(np.int32)

    def asked(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, shard) of all shards that each vector asks, its own among them."""
        row, cell = np.nonzero(scores >= scores.max(axis=1, keepdims=True) - self.margin)
        parts = self.parts[cell]
        within = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        return np.repeat(row, parts), (np.repeat(self.first[cell], parts) + within).astype(np.int32)


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres of some sampled unit vectors: a few steps of spherical k-means."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(np.int64)].copy()
    for _ in range(6):
        step = max(1, SCORES // cells)
        near = np.concatenate([(sample[lo : lo + step] @ centres.T).argmax(axis=1) for lo in range(0, len(sample), step)])
        order = np.argsort(near, kind="stable")
        there, first = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(sample[order], first, axis=0)
        size = np.sqrt((sums * sums).sum(axis=1))
        centres[there[size > 1e-6]] = sums[size > 1e-6] / size[size > 1e-6, None]
    return centres


def _reach(centres: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How much further than its nearest centre one of each two vectors must ask at least, to ask the other's cell."""
    a, b, rows = one @ centres.T, two @ centres.T, np.arange(len(one))
    return np.minimum(a.max(axis=1) - a[rows, b.argmax(axis=1)], b.max(axis=1) - b[rows, a.argmax(axis=1)])


def _turned(sample: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Some of these unit vectors, and beside each a vector whose cosine with it is just above the threshold: the hardest link,
    known without a comparison. One half is turned towards other vectors, one half at random with the sample's covariance."""
    rng = np.random.default_rng(len(sample))
    x = sample[rng.integers(0, len(sample), TURNED)].astype(np.float64)
    many = sample[rng.integers(0, len(sample), min(len(sample), TURNED))]
    mixed = rng.normal(size=(len(x), len(many))).astype(np.float32) @ many
    x, away = np.concatenate([x, x]), np.concatenate([sample[rng.integers(0, len(sample), len(x))], mixed]).astype(np.float64)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    size = np.sqrt((away * away).sum(axis=1, keepdims=True))
    cosine = min(1.0, least + PROBE_MARGIN)
    turned = cosine * x + np.sqrt(1 - cosine * cosine) * away / np.maximum(size, 1e-12)
    some = size[:, 0] > 1e-6
    return x[some].astype(np.float32), turned[some].astype(np.float32)


def _cells(vectors: DataFrame, least: float, shards: int, shard_values: int) -> dict[int, Cells]:
    """Cells by length, for the lengths whose vectors (id, vector, size) are too many for one shard.

    Centres come from a sample by hash, of SAMPLE_VALUES components at most; all vectors are dealt to them and asked for. A link is
    found if one of its vectors asks the other's cell. The margin is what ROUTE_RECALL of vectors turned to the threshold need, and
    wider if a sample of vectors, compared with all others, finds fewer of its links so.
    """
    sizes = vectors.groupBy("size").count()
    wanted = {r["size"]: -(-r["count"] * r["size"] // shard_values) for r in sizes.filter(F.col("count") * F.col("size") > shard_values).toLocalIterator()}
    counts = {}
    if shards > 1 and (most := sizes.orderBy(F.desc("count"), "size").first()):
        wanted[most["size"]] = max(shards, wanted.get(most["size"], 1))
    if not wanted:
        return {}
    counts = {r["size"]: r["count"] for r in sizes.filter(F.col("size").isin([*wanted])).toLocalIterator()}
    plans = {}
    for size, cells in wanted.items():
        # of all lengths together SAMPLE_VALUES at most
        most = max(64, SAMPLE_VALUES // len(wanted) // size)
        share = max(1, counts[size] // min(most, max(2048, SAMPLED * cells)))
        rows = vectors.filter((F.col("size") == size) & (F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(share)) == 0)).select("id", "vector").orderBy("id").limit(2 * most).toArrow()
        if rows.num_rows < 2:
            continue
        sample = _unit(_matrix(rows.column("vector").combine_chunks(), size)).astype(np.float32)
        centres = _centres(sample, max(1, min(cells, len(sample) // 2)))
        need = _reach(centres, *_turned(sample, least))
        chosen = np.unique(np.linspace(0, len(sample) - 1, min(len(sample), MEASURED)).astype(np.int64))
        margin = float(np.quantile(need, ROUTE_RECALL)) if len(need) else 0.0
        plans[size] = (centres, max(margin, 1e-6), sample[chosen], rows.column("id").to_numpy()[chosen])
    return _margins(vectors.filter(F.col("size").isin([*plans])), plans, least, shard_values)


def _margins(vectors: DataFrame, plans: dict[int, tuple], least: float, shard_values: int) -> dict[int, Cells]:
    """Cells from plans (centres, margin, measured vectors, their ids) by length: one pass over all vectors counts those of each cell, and
    for the measured ones how many of their links lie within which of the WIDER margins."""
    shared = vectors.sparkSession.sparkContext.broadcast(plans)

    def measure(batches):
        counts, steps = {}, {}
        for size, part in _by_size(batches):
            centres, margin, measured, names = shared.value[size]
            own = measured @ centres.T
            far, cell = own.max(axis=1, keepdims=True) - own, own.argmax(axis=1)
            ids, every = part.column("id").to_numpy(), _unit(_matrix(part.column("vector"), size)).astype(np.float32)
            step = max(1, SCORES // max(len(centres), len(measured)))
            for lo in range(0, len(ids), step):
                unit = every[lo : lo + step]
                scores = unit @ centres.T
                home, top = scores.argmax(axis=1), scores.max(axis=1)
                counts[size] = counts.get(size, 0) + np.bincount(home, minlength=len(centres))
                v, a = np.nonzero(unit @ measured.T >= least)
                v, a = v[ids[lo + v] != names[a]], a[ids[lo + v] != names[a]]
                need = np.minimum(far[a, home[v]], top[v] - scores[v, cell[a]])
                at = a * (len(WIDER) + 1) + np.searchsorted(margin * np.array(WIDER), need)
                steps[size] = steps.get(size, 0) + np.bincount(at, minlength=len(measured) * (len(WIDER) + 1))
        for kind, found in ((0, counts), (1, steps)):
            for size, n in found.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x), t) for x, t in ((kind, pa.int32()), (size, pa.int32()))] + [pa.array(at), pa.array(n[at].astype(np.int64))], ["kind", "size", "key", "n"])

    got = bounded_batches(vectors).select("id", "size", "vector").mapInArrow(measure, "kind int, size int, key long, n long").groupBy("kind", "size", "key").agg(F.sum("n").alias("n")).toArrow()
    kind, size, key, n = (got.column(c).to_numpy() for c in ("kind", "size", "key", "n"))
    shared.destroy()
    out = {}
    for length, (centres, margin, measured, _) in plans.items():
        here = lambda k: (kind == k) & (size == length)  # noqa: B023, E731
        count, steps = np.zeros(len(centres), np.int64), np.zeros(len(measured) * (len(WIDER) + 1), np.int64)
        count[key[here(0)]], steps[key[here(1)]] = n[here(0)], n[here(1)]
        within = np.cumsum(steps.reshape(len(measured), -1), axis=1)
        links = within[:, -1]
        recall = within / np.maximum(1, links)[:, None]
        enough = np.ones(recall.shape[1], bool)
        for part in ((links > 0) & (links <= FEW_LINKS), links > FEW_LINKS):
            if part.any():
                enough &= recall[part].mean(axis=0) >= ROUTE_RECALL
        at = int(np.flatnonzero(enough)[0])
        parts = np.where(count * length > 2 * shard_values, -(-count * length // shard_values), 1)
        out[length] = Cells(centres, np.cumsum(parts) - parts, parts, margin * WIDER[at] if at < len(WIDER) else 4.0)
    return out


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """Lists of doubles of one length as rows."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _by_size(batches):
    """(size, batch) of the rows of each length."""
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        for size in np.unique(sizes).tolist():
            yield size, batch.take(pa.array(np.flatnonzero(sizes == size)))


def _packed(values: np.ndarray) -> pa.Array:
    """Rows as bytes: of floats if these are the same numbers, else of doubles."""
    short = values.astype(np.float32)
    values = short if (short == values).all() else values
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(values[0].nbytes), len(values), [None, pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _unpacked(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """The rows of doubles that _packed has made, some of floats."""
    out, at = np.empty((len(column), size)), 0
    for chunk in column.chunks:
        edge = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        data, wide = np.frombuffer(chunk.buffers()[2], np.uint8), np.diff(edge) == 8 * size
        turn = np.flatnonzero(np.diff(wide)) + 1
        for lo, hi in zip([0, *turn], [*turn, len(chunk)], strict=True):
            if hi > lo:
                out[at + lo : at + hi] = data[edge[lo] : edge[hi]].view(np.float64 if wide[lo] else np.float32).reshape(hi - lo, size)
        at += len(chunk)
    return out


def _routed(part: pa.RecordBatch, size: int, cells: Cells | None):
    """Rows of the vectors of one length: each as a point of its shard, then as a query of the others that it asks."""
    n = part.num_rows
    values = _matrix(part.column("vector"), size)
    home, row, shard = np.zeros(n, np.int32), np.arange(n), np.zeros(n, np.int32)
    if cells is not None:
        unit, step, pairs = _unit(values).astype(np.float32), max(1, SCORES // len(cells.centres)), []
        for lo in range(0, n, step):
            scores = unit[lo : lo + step] @ cells.centres.T
            home[lo : lo + step] = cells.home(scores, part.column("id").to_numpy()[lo : lo + step])
            pairs.append(cells.asked(scores))
            pairs[-1] = (pairs[-1][0] + lo, pairs[-1][1])
        row, shard = (np.concatenate(x) for x in zip(*pairs, strict=True))
    edge = np.searchsorted(row, np.arange(n + 1))
    visits = pa.array([shard[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], pa.binary())
    away = shard != home[row]
    vectors = _packed(values)
    names = [x.split()[0] for x in ASKED.split(", ")]
    step = max(1, QUERY_VALUES // size)
    for at, to, point in ((np.arange(n), home, True), (row[away], shard[away], False)):
        for lo in range(0, len(at), step):
            here = slice(lo, lo + step)
            some = pa.array(at[here])
            fixed = [pa.array(np.full(len(some), size, np.int32)), pa.array(to[here], pa.int32()), pa.array(np.full(len(some), point))]
            known = [part.column(c).take(some) for c in ("id", "vec_id", "copies")]
            seen = visits.take(some) if point else pa.array([b""] * len(some), pa.binary())
            yield pa.RecordBatch.from_arrays([*fixed, *known, pa.array(home[at[here]]), seen, vectors.take(some)], names)


class _Shard:
    """The graph of one shard, built when its points are there, and what is asked of it, piece by piece."""

    def __init__(self, size: int, shard: int, least: float):
        self.size, self.shard, self.least = size, shard, least
        self.parts: list[pa.RecordBatch] = []
        self.rows, self.graph = 0, None

    def add(self, part: pa.RecordBatch, point: bool):
        """Take points, or what is asked after all points; give what is found meanwhile."""
        if not point and self.graph is None:
            if not self.parts:
                return  # no vector is at home here
            yield from self._build()
        self.parts.append(part)
        self.rows += part.num_rows
        if self.graph is not None and self.rows * self.size >= QUERY_VALUES:
            yield self._ask()

    def end(self):
        if self.graph is None:
            if not self.parts:
                return
            yield from self._build()
        if self.rows:
            yield self._ask()
        at = np.flatnonzero(self.more)
        yield _found(3, self.ids[at], self.ids[at], self.more[at], 0, self.names[at], self.names[at], self.shard, self.shard)

    def _taken(self) -> pa.Table:
        table, self.parts, self.rows = pa.Table.from_batches(self.parts), [], 0
        return table

    def _build(self):
        points = self._taken()
        self.ids, self.names, self.copies, _ = _columns(points)
        order = np.argsort(self.ids, kind="stable")
        points = points.take(pa.array(order)).combine_chunks()
        self.ids, self.names, self.copies, home = _columns(points)
        self.values = _unpacked(points.column("vector"), self.size)
        self.graph = Graph(_unit(self.values), self.ids)
        self.beam = self.graph.probed_beam(self.least)
        self.label, self.more = np.arange(len(self.ids)), np.zeros(len(self.ids), np.int64)
        raw = points.column("visits").to_pylist()
        self.visits, self.visitor = np.frombuffer(b"".join(raw), np.int32), np.repeat(np.arange(len(raw)), [len(r) // 4 for r in raw])
        self.apart: dict[int, np.ndarray] = {}
        # the points ask first
        step = max(1, QUERY_VALUES // self.size)
        for lo in range(0, len(self.ids), step):
            here = slice(lo, lo + step)
            yield self._look_up(self.ids[here], self.names[here], self.copies[here], home[here], self.values[here], np.arange(len(self.ids))[here])

    def _ask(self) -> pa.RecordBatch:
        asked = self._taken()
        ids, names, copies, home = _columns(asked)
        return self._look_up(ids, names, copies, home, _unpacked(asked.column("vector"), self.size), np.full(len(ids), -1))

    def _look_up(self, own, own_names, own_copies, home, mine, place) -> pa.RecordBatch:
        graph, shard = self.graph, self.shard
        unit = _unit(mine).astype(np.float32)
        sure = lambda q, p: _cosines(mine, self.values, q, p) >= self.least
        query, point, full = graph.search(unit, self.least - DOUBT, place, self.beam)
        keep = sure(query, point)
        query, point = query[keep], point[keep]

        def told(rows: np.ndarray, near: np.ndarray) -> None:
            """Points that do not ask the shard of what is near them have no other way to count it."""
            for h in np.unique(home[rows]).tolist():
                if h != shard:
                    if h not in self.apart:
                        self.apart[h] = np.ones(len(self.ids), bool)
                        self.apart[h][self.visitor[self.visits == h]] = False
                    these = home[rows] == h
                    gained = (own_copies[rows[these]].astype(np.float64) @ near[these]).astype(np.int64)
                    self.more[graph.order] += np.where(self.apart[h][graph.order], gained, 0)

        # queries of the same shard beside each other
        full = full[np.argsort(home[full], kind="stable")]
        src, dst, links = graph.joined(unit, full, place, self.least, sure, self.copies, self.label, told)
        out = [_found(0, own[query], self.ids[point], self.copies[point], own_copies[query], own_names[query], self.names[point], shard, home[query])]
        out.append(_found(1, own[src], self.ids[dst], 0, 0, own_names[src], self.names[dst], shard, shard))
        out.append(_found(2, own[full], own[full], links, 0, own_names[full], own_names[full], shard, shard))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(x.num_rows for x in out) else out[0]


def _columns(rows: pa.Table) -> list[np.ndarray]:
    return [rows.column(c).to_numpy() for c in ("id", "vec_id", "copies", "home")]


def _searched(batches, least: float):
    """What is found in rows sorted by size, shard and points first."""
    shard, at = None, None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "shard", "point")])
        turn = (np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()
        for lo, hi in zip([0, *turn], [*turn, batch.num_rows], strict=True):
            if hi == lo:
                continue
            size, number, point = key[:, lo].tolist()
            if at != (size, number):
                if shard is not None:
                    yield from shard.end()
                shard, at = _Shard(size, number, least), (size, number)
            yield from shard.add(batch.slice(lo, hi - lo), bool(point))
    if shard is not None:
        yield from shard.end()


def _find(vectors: DataFrame, least: float, shards: int, shard_values: int = SHARD_VALUES) -> DataFrame:
    """What is near enough among vectors (id, vec_id, copies, vector, size), in rows of four kinds.

    0: a pair, with the copies of both; 1: two vectors of one component; 2: number of links that src has in a shard; 3: number of its
    links with vectors compared in full, whose shards it did not ask.
    """
    spark = vectors.sparkSession
    cells = _cells(vectors, least, shards, shard_values)
    shared = spark.sparkContext.broadcast(pickle.dumps(cells))

    def route(batches):
        cells = pickle.loads(shared.value)
        for size, part in _by_size(batches):
            yield from _routed(part, size, cells.get(size))

    n_shards = sum(int(c.parts.sum()) for c in cells.values())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4 * n_shards, MOST_TASKS))
    asked = bounded_batches(vectors).mapInArrow(route, ASKED)
    asked = asked.repartition(tasks, "size", "shard").sortWithinPartitions("size", "shard", F.desc("point"))
    return written(asked.mapInArrow(lambda batches: _searched(batches, least), FOUND))


def _found(kind: int, src, dst, copies, own, src_vec, dst_vec, shard: int, home) -> pa.RecordBatch:
    every = lambda x, t: np.broadcast_to(np.asarray(x, t), len(src))
    columns = [(kind, np.int32), (src, np.int64), (dst, np.int64), (copies, np.int64), (own, np.int64), (src_vec, np.int64), (dst_vec, np.int64), (shard, np.int32), (home, np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(every(x, t)) for x, t in columns], [x.split()[0] for x in FOUND.split(", ")])


def _cosines(one: np.ndarray, two: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows a of one and b of two, in double precision."""
    out = np.zeros(len(a))
    for lo in range(0, len(a), 4096):
        out[lo : lo + 4096] = (_unit(one[a[lo : lo + 4096]]) * _unit(two[b[lo : lo + 4096]])).sum(axis=1)
    return out


def embedding_digest(embeddings: DataFrame) -> DataFrame:
    return link_vectors(embeddings)
