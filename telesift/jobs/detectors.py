"""Threshold, rolling, forecast-error and ensemble detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telesift.functions.scores import abs_z, blend, min_max, outside, percentile_scale, row_percentile, z_to_score
from telesift.operators.events import extract, mark, prune_then_merge
from telesift.operators.metrics import best_threshold, calibrate, grid, strict_sweep, strict_sweeps
from telesift.operators.rolling import cumulative, forecast_error, local_z, over_frames
from telesift.operators.stats import exact_percentiles, stats_row, with_row
from telesift.sources.durable import written


def flag_any(columns: list[str], n: float) -> Column:
    """1 if any channel is more than n deviations from its mean; needs <channel>_mean and <channel>_std."""
    return F.greatest(F.lit(0), *[outside(F.col(c), F.col(f"{c}_mean"), F.col(f"{c}_std"), n).cast("int") for c in columns])


def global_std(rows: DataFrame, fitted_on: DataFrame, columns: list[str], n: float = 5.0, flag: str = "flag") -> DataFrame:
    """rows with a flag, by means and deviations of another table (or of the rows themselves)."""
    stats = stats_row(fitted_on, columns)
    return with_row(rows, stats).withColumn(flag, flag_any(columns, n)).drop(*stats.columns)


def local_std(rows: DataFrame, columns: list[str], size: int = 100, threshold: float = 4.0, min_std: float = 1e-6, least: int = 1, chunk: int | None = None) -> DataFrame:
    """rows with <channel>_z, <channel>_flag and flag: distance from the centred rolling mean."""
    out = local_z(rows, columns, size, least, min_std, chunk)
    out = out.withColumns({f"{c}_flag": F.coalesce((F.col(f"{c}_z") > threshold).cast("int"), F.lit(0)) for c in columns})
    return out.withColumn("flag", F.greatest(*[F.col(f"{c}_flag") for c in columns]))


def forecast_scores(rows: DataFrame, columns: list[str], size: int = 50, chunk: int = 20_000) -> DataFrame:
    """rows with error, cumulative and score: .7 of the forecast error and .3 of its running sum, each by its maximum, then min-max."""
    out = forecast_error(rows, columns, size, chunk)
    out = written(over_frames(out, 10, 0, lambda f: {"cumulative": cumulative(f, "error")}, chunk))
    tops = out.agg(F.max("cumulative").alias("_top"))
    out = with_row(out, tops).withColumn("cumulative", F.coalesce(F.try_divide("cumulative", "_top"), F.lit(0.0))).drop("_top")
    out = out.withColumn("_raw", 0.7 * F.col("error") + 0.3 * F.col("cumulative"))
    ends = out.agg(F.min("_raw").alias("_lo"), F.max("_raw").alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col("_raw") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.col("_raw"))
    return with_row(out, ends).withColumn("score", scaled).drop("_raw", "_lo", "_hi")


def component_scores(rows: DataFrame, fitted_on: DataFrame, columns: list[str], size: int = 100, z0: tuple[float, float] = (2.0, 1.8), min_std: float = 1e-6, chunk: int | None = None) -> DataFrame:
    """rows with s_global and s_local: percentile over channels of the z scores, each scaled by its own 5th and 95th percentile."""
    stats = stats_row(fitted_on, columns, min_std)
    out = local_z(rows, columns, size, max(1, size // 4), min_std, chunk)
    each = [z_to_score(abs_z(F.col(c), F.col(f"{c}_mean"), F.col(f"{c}_std")), z0[0]) for c in columns]
    out = with_row(out, stats).withColumn("_g", row_percentile(each, 0.95)).drop(*stats.columns)
    out = out.withColumn("_l", row_percentile([z_to_score(F.coalesce(F.col(f"{c}_z"), F.lit(0.0)), z0[1]) for c in columns], 0.90))
    out = written(out)  # the frames are computed once, for the limits and the rows
    limits = exact_percentiles(out, {f"{x}{int(p * 100)}": (x, p) for x in ("_g", "_l") for p in (0.05, 0.95)})
    out = with_row(out, limits)
    scale = lambda x: percentile_scale(F.col(x), F.col(f"{x}5"), F.col(f"{x}95"))
    return out.withColumn("s_global", scale("_g")).withColumn("s_local", scale("_l")).drop("_g", "_l", *limits.columns, *[f"{c}_z" for c in columns])


def ensemble_score(rows: DataFrame, weights: dict[str, float], thresholds: dict[str, float]) -> DataFrame:
    """rows with score from the component scores named in weights; weights are normalised."""
    names = list(weights)
    return rows.withColumn("score", blend([F.coalesce(F.col(n), F.lit(0.0)) for n in names], [weights[n] for n in names], [thresholds[n] for n in names]))


WEIGHTS = {"s_global": 0.20, "s_local": 0.45, "s_iforest": 0.35}
VOTES = {"s_global": 0.35, "s_local": 0.30, "s_iforest": 0.40}


def predict(rows: DataFrame, threshold: float, shortest: int = 2, gap: int = 8) -> DataFrame:
    """rows with is_anomaly: score >= threshold, short events dropped, near ones merged."""
    # scores are made once, for the events and for the rows
    flagged = written(rows.withColumn("_flag", F.coalesce((F.col("score") >= threshold).cast("int"), F.lit(0))))
    return mark(flagged.drop("_flag"), prune_then_merge(flagged, "_flag", shortest, gap), "is_anomaly")


def calibrated(rows: DataFrame, label: str = "is_anomaly", steps: int = 200, shortest: int = 2, gap: int = 8, strict: bool = False, ends: tuple[float, float] = (0.02, 0.2)) -> DataFrame:
    """(threshold, metric): the best of evenly spaced thresholds by event F0.5 against the label's events.

    strict: thresholds between ends, scores above them, and each true event matched once; the lowest of the best ones, whatever it reaches.
    """
    if strict:
        lo, hi = ends
        table = strict_sweep(rows, "score", extract(rows, label), [lo + i * (hi - lo) / (steps - 1) for i in range(steps)], shortest, gap)
        return table.orderBy(F.col("f_beta").desc(), "threshold").limit(1).select("threshold", F.col("f_beta").alias("metric"))
    return best_threshold(calibrate(rows, "score", extract(rows, label), grid(steps), shortest, gap))


def compare_models(rows: DataFrame, scores: list[str], label: str = "is_anomaly", steps: int = 200, shortest: int = 7, gap: int = 0, ends: tuple[float, float] = (0.02, 0.2)) -> DataFrame:
    """A row for each score column: model, threshold, precision, recall, f_beta, n_true, n_pred, median_length, longest.

    Each is taken at its own threshold, the lowest of those with the best event F0.5, found in one sweep for all of them.
    """
    lo, hi = ends
    table = strict_sweeps(rows, scores, extract(rows, label), [lo + i * (hi - lo) / (steps - 1) for i in range(steps)], shortest, gap)
    rank = F.row_number().over(Window.partitionBy("model").orderBy(F.col("f_beta").desc(), "threshold"))  # `steps` rows a model
    best = table.withColumn("_rank", rank).filter("_rank = 1")
    return best.select("model", "threshold", "precision", "recall", "f_beta", "n_true", "n_pred", "median_length", "longest")


def error_stream(rows: DataFrame, columns: list[str], size: int = 51, chunk: int | None = None) -> DataFrame:
    """rows with score: the largest channel error, its centred rolling mean, then min-max."""
    out = rows.withColumn("_top", F.greatest(*columns))
    out = over_frames(out, size // 2, size // 2, lambda f: {"_mean": F.avg("_top").over(f.centred(size))}, chunk)
    out = written(out)
    ends = out.agg(F.min("_mean").alias("_lo"), F.max("_mean").alias("_hi"))
    return with_row(out, ends).withColumn("score", min_max(F.col("_mean"), F.col("_lo"), F.col("_hi"), 1e-12)).drop("_top", "_mean", "_lo", "_hi")


