"""Exact top-k search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telesift.llm.common import pick, written

HITS = "row long, query_id long, vec_id long, score long, beyond string"
LONG = 1 << 63
SCALE = 64
QUERY_TILE, CANDIDATE_TILE = 64, 2048


def usable_vectors(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, vector array<double>): rows get numbers of their own; those whose id or vector is null, or whose vector holds a null or
    non-finite component, go."""
    rows = pick(embeddings, {"vec_id": "long", "embedding": "array<double>"})
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(~F.exists("embedding", odd))
    # written, as the numbers must not change from one use to the next
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("embedding").alias("vector")))


def whole_numbers(vectors: pd.Series, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, a row each, shorter ones filled up with 0: int64, or Python's integers if some do not fit."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    if np.abs(out).max(initial=0) < (1 << 62) / scale:
        return np.floor(out * scale).astype(np.int64)
    exact = lambda x: int(math.floor(x * scale)) if abs(x) < 1e300 else int(x) * scale
    return np.array([[exact(float(x)) for x in row] for row in out], dtype=object).reshape(out.shape)


def beyond(score: int) -> str | None:
    """For a score at a long's end or past it, a string by which such scores are ordered like numbers."""
    if -LONG < score < LONG - 1:
        return None
    digits = str(abs(score))
    text = f"{len(digits):05d}{digits}"
    return text if score > 0 else "".join(str(9 - int(c)) for c in text)


def accumulate(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores (query, candidate), term after term: postings of a term times the queries' weights, added up.

    values holds one row a term and one column a candidate, weights one row a term and one column a query. A
    term that most candidates have is added to whole rows of the dense array, a rarer one is scattered
    to its postings; tiles are small enough to stay in the cache.
    """
    n_query, n = weights.shape[1], values.shape[1]
    reach = int(np.abs(values).max(initial=0)) * int(np.abs(weights).max(initial=0)) * max(1, len(values))
    kind = np.int32 if reach < 2**31 else np.int64 if reach < LONG else object
    values, weights = values.astype(kind), weights.astype(kind)
    scores = np.zeros((n_query, n), dtype=kind)
    for lo in range(0, n, CANDIDATE_TILE):
        tile = values[:, lo : lo + CANDIDATE_TILE]
        product = np.empty((n_query, tile.shape[1]), dtype=kind)
        sums = np.zeros_like(product)
        for term in range(len(tile)):
            postings = np.flatnonzero(tile[term])
            if 2 * len(postings) >= tile.shape[1]:
                np.multiply(weights[term][:, None], tile[term][None, :], out=product)
                sums += product
            elif len(postings):
                sums[:, postings] += weights[term][:, None] * tile[term, postings][None, :]
        scores[:, lo : lo + CANDIDATE_TILE] = sums
    return scores


def block_top_k(queries: pd.DataFrame, candidates: pd.DataFrame, k: int, scale: int = 1) -> pd.DataFrame:
    """The k best candidates of one block for each query of another, by components times scale, rounded down; a query is not its own candidate (by row, or by id without row)."""
    names = ["row", "query_id", "vec_id", "score", "beyond"]
    if queries.empty or candidates.empty:
        return pd.DataFrame(columns=names).astype(dict.fromkeys(names[:4], "int64"))
    candidates = candidates.sort_values("vec_id", ignore_index=True)
    ids, values = candidates["vec_id"].to_numpy(), whole_numbers(candidates["vector"], scale).T
    rows = candidates.get("row", candidates["vec_id"]).to_numpy()
    by_row = np.argsort(rows, kind="stable")
    asked, weights = queries["query_id"].to_numpy(), whole_numbers(queries["vector"], scale).T
    own = queries.get("row", queries["query_id"]).to_numpy()
    terms = min(len(values), len(weights))
    values, weights = np.ascontiguousarray(values[:terms]), np.ascontiguousarray(weights[:terms])
    out = []
    for lo in range(0, len(asked), QUERY_TILE):
        scores = accumulate(values, weights[:, lo : lo + QUERY_TILE])
        mine = own[lo : lo + QUERY_TILE]
        first, last = np.searchsorted(rows, mine, side="left", sorter=by_row), np.searchsorted(rows, mine, side="right", sorter=by_row)
        for j, query in enumerate(mine):
            at = np.delete(np.arange(len(ids)), by_row[first[j] : last[j]]) if first[j] < last[j] else np.arange(len(ids))
            score = scores[j][at]
            best = np.arange(len(at))
            if len(at) > k:
                # partition by score; of the rows that tie at the border those with the smallest ids stay
                border = np.partition(score, len(score) - k)[len(score) - k]
                above = np.flatnonzero(score > border)
                best = np.concatenate([above, np.flatnonzero(score == border)[: k - len(above)]])
            found = score[best]
            past = [beyond(int(x)) for x in found] if found.dtype == object else [None] * len(best)
            if found.dtype == object:
                found = np.array([max(-LONG, min(LONG - 1, int(x))) for x in found], dtype=np.int64)
            out.append(pd.DataFrame({"row": query, "query_id": asked[lo + j], "vec_id": ids[at[best]], "score": found.astype(np.int64), "beyond": past}))
    return pd.concat(out, ignore_index=True)[names if "row" in queries else ["query_id", "vec_id", "score"]]


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 20, query_block: int = 4096, candidate_block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products, ties to the smaller vec_id.

    queries and vectors have (row, vec_id, vector array<double>), row being a number that no other row has; shorter vectors
    count as padded with 0. Components are taken as floor(64 * x), of any size; inner products are exact, and a
    score that a long cannot hold is shown as the nearest long but ranked by its value. A query row is not
    its own candidate; other rows of its vec_id are, and rows that repeat a vec_id are queries of their own. Every pair of a
    query block and a candidate block is one task's work: term after term, the block's postings times the queries'
    weights are added to dense scores, all of them; then partition selection, and a merge of k rows a block. Fewer
    candidates than k give fewer rows; an empty side gives none.
    """
    n_query = max(1, -(-queries.count() // query_block))
    n_block = max(1, -(-vectors.count() // candidate_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    # names of their own, as both sides may come from one table
    left = queries.select(F.col("row").alias("asking"), F.col("vec_id").alias("query_id"), F.col("vector").alias("weights"), part(n_query).alias("a"), every(n_block).alias("b"))
    right = vectors.select("row", "vec_id", "vector", part(n_block).alias("c"), every(n_query).alias("q"))

    def best(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        return block_top_k(asked.rename(columns={"asking": "row", "weights": "vector"}), found, k, SCALE)

    hits = left.groupBy("a", "b").cogroup(right.groupBy("q", "c")).applyInPandas(best, HITS)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("beyond").desc_nulls_last(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def topk_digest(embeddings: DataFrame) -> DataFrame:
    vectors = usable_vectors(embeddings)
    return top_k(vectors.filter("vec_id % 20 = 0"), vectors)
