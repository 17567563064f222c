"""Isolation forest: a tree per task on a hash sample, broadcast for scoring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telesift.operators.stats import exact_percentiles
from telesift.sources.durable import written

NODE = "tree int, node int, feature int, border double, left int, right int, size int"


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary search tree of n keys."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3)
    return np.where(n > 2, 2 * (np.log(safe - 1) + 0.5772156649015329) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


def _grow(values: np.ndarray, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    deepest = int(np.ceil(np.log2(max(2, len(values)))))
    nodes: list[list] = []

    def split(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([at, -1, 0.0, -1, -1, len(rows)])
        lo, hi = values[rows].min(axis=0), values[rows].max(axis=0)
        free = np.flatnonzero(hi > lo)
        if depth < deepest and len(rows) > 1 and len(free):
            feature = int(rng.choice(free))
            border = float(rng.uniform(lo[feature], hi[feature]))
            low = values[rows, feature] < border
            if low.any() and not low.all():
                nodes[at][1:5] = [feature, border, split(rows[low], depth + 1), split(rows[~low], depth + 1)]
        return at

    split(np.arange(len(values)), 0)
    return [tuple(n) for n in nodes]


def fit(df: DataFrame, columns: list[str], trees: int = 100, max_samples: int = 256, seed: int = 42) -> DataFrame:
    """The forest as a table of nodes. Every tree takes about max_samples rows, chosen by a hash of (id, tree): the same rows
    however the table is partitioned. At most 4 * trees * max_samples rows are moved."""
    total = df.count()
    share = min(1.0, 2.0 * max_samples / max(1, total))
    steps = 1 << 30
    mine = lambda t: F.pmod(F.xxhash64(F.col("id"), t, F.lit(seed)), F.lit(steps)) < int(share * steps)
    picked = df.select("id", *columns, F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), mine)).alias("tree"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("id")
        order = np.random.default_rng(seed * 1000 + tree).permutation(len(pdf))[:max_samples]
        values = pdf[columns].fillna(0.0).to_numpy(dtype=float)[order]
        return pd.DataFrame([(tree, *n) for n in _grow(values, seed + tree)], columns=["tree", "node", "feature", "border", "left", "right", "size"])

    return picked.groupBy("tree").applyInPandas(grow, NODE)


def _laid_out(tree: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(depth, feature, border, children in pairs, path length) of the nodes of a tree, in order of their numbers. A leaf is its own child, so all rows take the same steps."""
    feature, children = tree[:, 1].astype(np.int64), tree[:, 3:5].astype(np.int64)
    leaf = feature < 0
    at = np.arange(len(tree))
    depth = np.zeros(len(tree))
    for i in np.flatnonzero(~leaf):  # a node comes before its children
        depth[children[i]] = depth[i] + 1
    children[leaf] = at[leaf, None]
    return int(depth.max()), np.maximum(feature, 0), tree[:, 2].astype(float), children.ravel(), depth + average_path(tree[:, 5])


def score(df: DataFrame, columns: list[str], forest: DataFrame, max_samples: int = 256, name: str = "s_iforest") -> DataFrame:
    """df with the anomaly score 2^(-mean path / expected path) in (0, 1]; null channels count as 0."""
    nodes = forest.toPandas().sort_values(["tree", "node"])  # trees * 2 * max_samples rows at most
    trees = [_laid_out(t.drop(columns=["tree"]).to_numpy()) for _, t in nodes.groupby("tree")]
    shared = df.sparkSession.sparkContext.broadcast(trees)
    scale = max(1, len(trees)) * max(1e-9, float(average_path(np.array([max_samples]))[0]))

    @F.pandas_udf("double")
    def value(*parts: pd.Series) -> pd.Series:
        x = np.nan_to_num(np.column_stack([p.to_numpy(dtype=float) for p in parts]))
        total = np.zeros(len(x))
        begin = np.arange(len(x)) * x.shape[1]
        flat = x.ravel()
        for deepest, feature, border, child, path in shared.value:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(deepest):
                right = flat.take(begin + feature.take(node)) >= border.take(node)
                node = child.take(2 * node + right)
            total += path.take(node)
        return pd.Series(2.0 ** (-total / scale))

    return df.withColumn(name, value(*columns))


def flag(df: DataFrame, contamination: float, name: str = "s_iforest") -> DataFrame:
    """df with flag: the share `contamination` of the highest scores. df is written first, so that trees are walked once."""
    df = written(df)
    cut = exact_percentiles(df, {"_cut": (name, 1 - contamination)})
    return df.crossJoin(F.broadcast(cut)).withColumn("flag", (F.col(name) > F.col("_cut")).cast("int")).drop("_cut")
