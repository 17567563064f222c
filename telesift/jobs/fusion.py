"""Feature table, pseudo-labels and boosted-tree fusion of detectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telesift.functions.scores import pseudo_label_flexible, pseudo_label_strict
from telesift.operators.events import extract, mark, prune_then_merge
from telesift.operators.metrics import calibrate, grid
from telesift.operators.prep import chronological, cut_position
from telesift.operators.rolling import Block, by_blocks, deltas, over_frames, pair_correlation, score_features, slope, trailing_features
from telesift.operators.stats import exact_percentiles, with_row
from telesift.sources.durable import place, written


def block_features(f: Block, columns: list[str], sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The frames of `features` over a block: trailing deviations by size, deltas, slope, correlations."""
    out = []
    every = lambda each: (sum(v for v, _ in each) / len(each), np.all([some for _, some in each], axis=0))
    some_or_zero = lambda v, some: (np.where(some, v, 0.0), np.ones(len(v), dtype=bool))
    with np.errstate(invalid="ignore", divide="ignore"):
        for size in sizes:
            apart = {c: f.moments(c, c, 1 - size, 0) for c in columns}
            out.append(every([(np.abs(apart[c][1]), f.column(c)[1]) for c in columns]))
            out.append(every([f.deviation(c, 1 - size, 0) for c in columns]))
        for k in (1, 5, 10):
            out.append(some_or_zero(*every([(np.abs(f.column(c)[0] - f.lag(c, k)[0]), f.column(c)[1] & f.lag(c, k)[1]) for c in columns])))
        size, middle = 10, 4.5
        norm = sum((k - middle) ** 2 for k in range(size))
        lean = lambda c: np.abs(sum(((k - middle) * f.lag(c, size - k)[0] for k in range(1, size)), (0 - middle) * f.lag(c, size)[0]) / norm)
        out.append(some_or_zero(*every([(lean(c), np.all([f.lag(c, k)[1] for k in range(1, size + 1)], axis=0)) for c in columns])))
        for a, b in zip(columns[:3], columns[1:4], strict=True):
            (na, _, aa), (nb, _, bb), (n, _, ab) = (f.moments(x, y, -29, 0) for x, y in ((a, a), (b, b), (a, b)))
            spread = np.sqrt(aa / na) * np.sqrt(bb / nb)
            out.append(some_or_zero(ab / n / spread, (na >= 10) & (nb > 0) & (n > 0) & ~(spread <= 1e-12)))
    return out


def features(rows: DataFrame, columns: list[str], a: str, b: str, sizes: tuple[int, ...] = (10, 30, 50), chunk: int | None = None) -> DataFrame:
    """rows with the 16 features: two scores and their distance, rolling deviations, deltas, slope and correlations.

    All frames share one partitioning and order, so there is a single shuffle. With a chunk size they are laid out by numpy.
    """

    def build(f):
        out = trailing_features(f, columns, list(sizes)) | deltas(f, columns, [1, 5, 10]) | slope(f, columns)
        return out | {f"corr_ch{i}_ch{i + 1}": pair_correlation(f, columns[i], columns[i + 1]) for i in range(3)}

    if chunk is None:
        out = over_frames(rows, max(50, *sizes), 0, build)
    else:
        names = [*[f"rolling_{k}_{w}" for w in sizes for k in ("mean_dev", "std")], "delta_1", "delta_5", "delta_10", "slope_magnitude", *[f"corr_ch{i}_ch{i + 1}" for i in range(3)]]
        out = by_blocks(rows, max(50, *sizes), 0, names, lambda f: block_features(f, columns, sizes), chunk)
    return out.withColumns({"iforest_score": F.col(a), "forecast_score": F.col(b), "detector_agreement": F.abs(F.col(a) - F.col(b))})


FEATURES = ["iforest_score", "forecast_score", "detector_agreement", *[f"rolling_{k}_{w}" for w in (10, 30, 50) for k in ("mean_dev", "std")], "delta_1", "delta_5", "delta_10", "slope_magnitude", "corr_ch0_ch1", "corr_ch1_ch2", "corr_ch2_ch3"]


def pseudo_labels(rows: DataFrame, a: str, b: str, strict: bool = False) -> DataFrame:
    """rows with pseudo: 1, 0 or -1 (undecided), from percentiles of both scores."""
    low, high = (0.4, 0.99) if strict else (0.6, 0.98)
    limits = exact_percentiles(rows, {f"_{n}{int(100 * p)}": (c, p) for n, c in (("a", a), ("b", b)) for p in (low, high)})
    h, lo = f"{int(100 * high)}", f"{int(100 * low)}"
    rule = pseudo_label_strict if strict else pseudo_label_flexible
    value = rule(F.col(a), F.col(b), F.col(f"_a{h}"), F.col(f"_b{h}"), F.col(f"_a{lo}"), F.col(f"_b{lo}"))
    return with_row(rows, limits).withColumn("pseudo", value).drop(*limits.columns)


def class_weight(rows: DataFrame, label: str) -> float:
    """n0 / n1, both at least 1."""
    one = rows.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")).first()
    return max(1, one["n0"]) / max(1, one["n1"])


def laid_out(spark: SparkSession, model: GBTClassificationModel) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(depth, feature, border, children in pairs, weighted value) of the nodes of each tree, as the model writes them. A leaf is its own child, so all rows take the same steps."""
    path = place(spark, "trees")
    model.write().save(path)
    weights, out = model.treeWeights, {}
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex", F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("border"))
    for tree, part in nodes.toPandas().sort_values(["treeID", "id"]).groupby("treeID"):  # trees * 2^(depth + 1) rows at most
        at, leaf = np.arange(len(part)), part["leftChild"].to_numpy() < 0
        children = np.where(leaf[:, None], at[:, None], part[["leftChild", "rightChild"]].to_numpy())
        depth = np.zeros(len(part), dtype=np.int64)
        for i in np.flatnonzero(~leaf):  # a node comes before its children
            depth[children[i]] = depth[i] + 1
        feature, border = np.where(leaf, 0, part["featureIndex"].fillna(0)).astype(np.int64), np.where(leaf, 0.0, part["border"].fillna(0.0)).astype(float)
        out[tree] = (int(depth.max()), feature, border, children.ravel().astype(np.int64), weights[tree] * part["prediction"].to_numpy(dtype=float))
    return [out[i] for i in range(len(weights))]


@dataclass
class Boosted:
    """A fitted pipeline over named features, the probability above which a row is flagged, and the features by importance."""

    pipeline: PipelineModel
    names: list[str]
    cut: float
    ranked: list[tuple[str, float]]

    def apply(self, rows: DataFrame) -> DataFrame:
        """rows with fused and flag; null features become 0.

        The trees are walked by numpy, a batch of rows at once; the pipeline's own transform gives the same probabilities, one row after the other.
        """
        bins, model = self.pipeline.stages[0], self.pipeline.stages[-1]
        trees = rows.sparkSession.sparkContext.broadcast(laid_out(rows.sparkSession, model))

        @F.pandas_udf("double")
        def probability(*codes: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in codes])
            margin, begin, flat = np.zeros(len(x)), np.arange(len(x)) * x.shape[1], x.ravel()
            for deepest, feature, border, child, value in trees.value:
                node = np.zeros(len(x), dtype=np.int64)
                for _ in range(deepest):
                    node = child.take(2 * node + (flat.take(begin + feature.take(node)) > border.take(node)))
                margin += value.take(node)
            return pd.Series(1 / (1 + np.exp(-2 * margin)))

        out = bins.transform(rows.fillna(0.0, subset=self.names)).withColumn("fused", probability(*[f"_{n}" for n in self.names])).drop(*[f"_{n}" for n in self.names])
        return out.withColumn("flag", (F.col("fused") > self.cut).cast("int"))

    def importances(self, spark: SparkSession) -> DataFrame:
        """(rank, feature, importance), the most important first, ties by name."""
        return spark.createDataFrame([(i, n, float(v)) for i, (n, v) in enumerate(self.ranked, 1)], "rank int, feature string, importance double")


BINS = 32  # values of a feature that trees tell apart, the trees' own default
LOTS = 1 << 17  # no row that trees learn from stands for more than this share of all rows


def borders_of(rows: DataFrame, names: list[str]) -> list[list[float]]:
    """The borders between at most BINS values of each feature, a border on the lower side: all different values if they are few, else ranks at even distances."""
    ranks = [i / BINS for i in range(1, BINS)]
    told = rows.agg(*[F.struct(F.percentile_approx(n, ranks, 2_000).alias("at"), F.approx_count_distinct(n).alias("kinds")).alias(n) for n in names]).first()
    out = []
    for n in names:
        few = [r[0] for r in rows.select(n).distinct().limit(BINS + 1).collect()] if told[n]["kinds"] <= 2 * BINS else []
        out.append(sorted(few)[:-1] if 0 < len(few) <= BINS else sorted(set(told[n]["at"] or [])))
    return out


def lots(rows: DataFrame, names: list[str], label: str) -> DataFrame:
    """(names, _y, _w): rows (binned features and a label) that are equal as one with their number as weight, cut so that none weighs more than
    1 / LOTS of all rows; class weights are in it."""
    # a plain number: what the bins say about themselves would make trees take them as categories
    cells = written(rows.groupBy(*[F.col(n).cast("int").alias(n) for n in names], F.col(label).cast("double").alias("_y")).agg(F.count("*").alias("_n")))
    one = cells.agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_y") == 0, F.col("_n"))).alias("n0"), F.sum(F.when(F.col("_y") == 1, F.col("_n"))).alias("n1")).first()
    size = -(-(one["n"] or 0) // LOTS) or 1
    cut = cells.withColumn("_lots", F.ceil(F.col("_n") / size))
    weight = F.col("_n") / F.col("_lots") * F.when(F.col("_y") == 1, max(1, one["n0"] or 0) / max(1, one["n1"] or 0)).otherwise(1.0)
    return cut.withColumn("_w", weight).withColumn("_lot", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_lots")))).select(*names, "_y", "_w")


def fit_boosted(train: DataFrame, names: list[str], label: str, trees: int = 200, depth: int = 6, rate: float = 0.1, cut: float = 0.5) -> Boosted:
    """Gradient-boosted trees with class weights on rows with label 0 or 1; null features become 0.

    Trees see a feature as one of BINS values and cannot tell rows apart that are equal in all of them; so they learn from the different
    ones with their numbers, at most 2 * BINS^features and LOTS more, however many rows there are. train is gone through a few times, not once a tree.
    """
    rows = train.filter(F.col(label) >= 0).fillna(0.0, subset=names)
    binned = [f"_{n}" for n in names]
    # a row on a border belongs below it, as in the trees
    splits = [[-np.inf, *[float(np.nextafter(b, np.inf)) for b in borders], np.inf] for borders in borders_of(rows, names)]
    splits = [s if len(s) > 2 else [-np.inf, 0.0, np.inf] for s in splits]
    bins = Bucketizer(splitsArray=splits, inputCols=names, outputCols=binned)
    data = written(lots(bins.transform(rows), binned, label))
    model = GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=trees, maxDepth=depth, stepSize=rate, maxBins=BINS, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)
    assembler = VectorAssembler(inputCols=binned, outputCol="_x")
    fitted = model.fit(assembler.transform(data))
    ranked = sorted(zip(names, fitted.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    return Boosted(PipelineModel([bins, assembler, fitted]), list(names), cut, ranked)


def boosted(train: DataFrame, rows: DataFrame, names: list[str], label: str, trees: int = 200, depth: int = 6, rate: float = 0.1, cut: float = 0.5) -> tuple[DataFrame, list[tuple[str, float]]]:
    """(rows with fused and flag, ranked importances): fitted on one table, applied to another."""
    model = fit_boosted(train, names, label, trees, depth, rate, cut)
    return model.apply(rows), model.ranked


def supervised(rows: DataFrame, score: str, label: str = "is_anomaly", share: float = 0.85, trees: int = 300, depth: int = 4, rate: float = 0.05, steps: int = 200, shortest: int = 3, gap: int = 2, chunk: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with fused and is_flagged, one row of threshold and metrics): trees on a score, its trailing mean, deviation and change.

    Fitted on the first `share` of the time; the threshold with the best event F0.5 is looked for on the rest, and events above
    it are pruned and merged for all rows.
    """
    table = over_frames(rows, 51, 0, lambda f: score_features(f, score), chunk)
    table = written(table)
    cut = cut_position(table.count(), share, "share")
    train, _ = chronological(table, cut)
    model = fit_boosted(train, [score, "score_mean", "score_std", "score_diff"], label, trees, depth, rate)
    scored = written(model.apply(table).select("series_id", "rn", "id", "fused", label))
    held = chronological(scored, cut)[1]
    sweep = written(calibrate(held, "fused", extract(held, label), grid(steps), shortest, gap, strict=True))
    best = sweep.orderBy(F.col("f05").desc(), "threshold").limit(1)
    flagged = with_row(scored, best.select(F.col("threshold").alias("_t"))).withColumn("_flag", (F.col("fused") > F.col("_t")).cast("int")).drop("_t")
    flagged = written(flagged)
    return mark(flagged.drop("_flag"), prune_then_merge(flagged, "_flag", shortest, gap), "is_flagged"), best
