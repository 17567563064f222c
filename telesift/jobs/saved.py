"""Detectors fitted once, written to a folder, and read back to score tables and streams."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telesift.functions.scores import abs_z, percentile_scale, row_percentile, z_to_score
from telesift.jobs import forest as trees
from telesift.jobs import fusion
from telesift.jobs.detectors import VOTES, WEIGHTS, ensemble_score
from telesift.operators.rolling import local_z
from telesift.operators.stats import exact_percentiles, stats_row
from telesift.sources.durable import written

VERSION = 1


@dataclass
class Ensemble:
    """What an ensemble has learned: sizes, one row of means, deviations and limits, and the nodes of its forest."""

    columns: list[str]
    size: int
    z0: tuple[float, float]
    min_std: float
    samples: int
    state: dict[str, float]
    forest: DataFrame

    def raw_scores(self, rows: DataFrame, chunk: int | None = None, local: bool = True) -> DataFrame:
        """rows with _g, _l and _f: scores before they are scaled. local=False leaves out what needs a row's neighbours, as on a stream."""
        value = lambda c, kind: F.lit(self.state[f"{c}_{kind}"])
        out = local_z(rows, self.columns, self.size, max(1, self.size // 4), self.min_std, chunk) if local else rows
        each = [z_to_score(abs_z(F.col(c), value(c, "mean"), value(c, "std")), self.z0[0]) for c in self.columns]
        out = out.withColumn("_g", row_percentile(each, 0.95))
        if local:
            out = out.withColumn("_l", row_percentile([z_to_score(F.coalesce(F.col(f"{c}_z"), F.lit(0.0)), self.z0[1]) for c in self.columns], 0.90)).drop(*[f"{c}_z" for c in self.columns])
        return trees.score(out, self.columns, self.forest, self.samples, "_f")

    def score(self, rows: DataFrame, chunk: int | None = None, local: bool = True) -> DataFrame:
        """rows with s_global, s_local, s_iforest and score, all by what was fitted. local=False: without s_local, its weight shared out among the others; rows may be a stream."""
        names = {"s_global": "_g", "s_local": "_l", "s_iforest": "_f"} if local else {"s_global": "_g", "s_iforest": "_f"}
        out = self.raw_scores(rows, chunk, local)
        out = out.withColumns({n: percentile_scale(F.col(x), F.lit(self.state[f"{x}5"]), F.lit(self.state[f"{x}95"])) for n, x in names.items()}).drop(*names.values())
        return ensemble_score(out, {n: WEIGHTS[n] for n in names}, VOTES)


def fit_ensemble(rows: DataFrame, columns: list[str], size: int = 100, z0: tuple[float, float] = (2.0, 1.8), min_std: float = 1e-6, samples: int = 256, count: int = 100, seed: int = 42, chunk: int | None = None) -> Ensemble:
    """Means, deviations, forest and the 5th and 95th percentile of each raw score, from rows (series_id, rn, id, columns)."""
    stats = stats_row(rows, columns, min_std).first().asDict()
    model = Ensemble(list(columns), size, tuple(z0), min_std, samples, stats, written(trees.fit(rows, columns, count, samples, seed)))
    raw = written(model.raw_scores(rows, chunk).select("_g", "_l", "_f"))  # the frames are computed once
    limits = exact_percentiles(raw, {f"{x}{int(p * 100)}": (x, p) for x in ("_g", "_l", "_f") for p in (0.05, 0.95)}).first().asDict()
    model.state = stats | limits
    return model


def _told(spark: SparkSession, path: str, kind: str) -> dict:
    """What stands beside a saved model, if this version can read it."""
    told = json.loads(spark.read.text(f"{path}/about", wholetext=True).first()[0])
    if told.get("kind") != kind or told.get("version") != VERSION:
        raise ValueError(f"{path} holds {told.get('kind')} of version {told.get('version')}, not {kind} of version {VERSION}")
    return told


def _tell(spark: SparkSession, path: str, kind: str, about: dict) -> None:
    """Written last: a model whose writing was cut short cannot be read."""
    text = json.dumps({"kind": kind, "version": VERSION} | about)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/about")


def save_ensemble(model: Ensemble, path: str) -> None:
    """A folder with the nodes as a table and everything else as text. A folder that exists is an error."""
    model.forest.write.parquet(f"{path}/forest")
    _tell(model.forest.sparkSession, path, "ensemble", {k: getattr(model, k) for k in Ensemble.__dataclass_fields__ if k != "forest"})


def load_ensemble(spark: SparkSession, path: str) -> Ensemble:
    told = _told(spark, path, "ensemble")
    parts = {k: told[k] for k in Ensemble.__dataclass_fields__ if k != "forest"} | {"z0": tuple(told["z0"])}
    return Ensemble(**parts, forest=spark.read.schema(trees.NODE).parquet(f"{path}/forest"))


def save_boosted(model: fusion.Boosted, path: str, spark: SparkSession) -> None:
    """A folder with the pipeline and its ranked importances. A folder that exists is an error."""
    model.pipeline.save(f"{path}/pipeline")
    _tell(spark, path, "boosted", {"names": model.names, "cut": model.cut, "ranked": model.ranked})


def load_boosted(spark: SparkSession, path: str) -> fusion.Boosted:
    told = _told(spark, path, "boosted")
    return fusion.Boosted(PipelineModel.load(f"{path}/pipeline"), told["names"], told["cut"], [tuple(r) for r in told["ranked"]])
