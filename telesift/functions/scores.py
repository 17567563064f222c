"""Row-wise score algebra as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def outside(x: Column, mean: Column, std: Column, n: float) -> Column:
    return (x > mean + n * std) | (x < mean - n * std)


def abs_z(x: Column, mean: Column, std: Column) -> Column:
    return F.abs((x - mean) / std)


def z_to_score(z: Column, z0: float) -> Column:
    return 1 - F.exp(-F.abs(z) / z0)


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def percentile_scale(x: Column, p5: Column, p95: Column) -> Column:
    """The share of the way from p5 to p95, clipped; a flat range counts as 1e-6."""
    return clip((x - p5) / F.when(p95 > p5, p95 - p5).otherwise(1e-6))


def row_percentile(columns: list[Column], share: float) -> Column:
    """Linear percentile across the columns of a row."""
    ordered, at = F.sort_array(F.array(*columns)), share * (len(columns) - 1)
    low = int(at)
    high = min(low + 1, len(columns) - 1)
    return (1 - (at - low)) * ordered[low] + (at - low) * ordered[high]


def row_mean(columns: list[Column]) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total / len(columns)


def min_max(x: Column, lo: Column, hi: Column, guard: float = 1e-10, invert: bool = False) -> Column:
    scaled = (x - lo) / (hi - lo + guard)
    return 1 - scaled if invert else scaled


def blend(scores: list[Column], weights: list[float], thresholds: list[float], spread: float = 0.6, bonus: float = 0.15, votes: int = 2) -> Column:
    """spread * weighted mean + rest * largest, plus a bonus if enough detectors pass their thresholds, clipped."""
    total = sum(weights)
    mean = sum((s * (w / total) for s, w in zip(scores[1:], weights[1:], strict=True)), scores[0] * (weights[0] / total))
    peak = F.greatest(*scores)
    count = sum(((s >= t).cast("int") for s, t in zip(scores[1:], thresholds[1:], strict=True)), (scores[0] >= thresholds[0]).cast("int"))
    return clip(spread * mean + (1 - spread) * peak + F.when(count >= votes, bonus).otherwise(0.0))


def f_beta(precision: Column, recall: Column, beta: float = 0.5) -> Column:
    b = beta * beta
    return F.coalesce(F.try_divide((1 + b) * precision * recall, b * precision + recall), F.lit(0.0))


def pseudo_label_flexible(a: Column, b: Column, a98: Column, b98: Column, a60: Column, b60: Column) -> Column:
    """1 if either is above its 98th percentile, 0 if both are below their 60th (this wins), else -1."""
    return F.when((a < a60) & (b < b60), 0).when((a > a98) | (b > b98), 1).otherwise(-1)


def pseudo_label_strict(a: Column, b: Column, a99: Column, b99: Column, a40: Column, b40: Column) -> Column:
    return F.when((a <= a40) & (b <= b40), 0).when((a >= a99) & (b >= b99), 1).otherwise(-1)


def parse_sequences(text: Column) -> Column:
    """'[[a, b], ...]' as an array of pairs; null if it is no such list."""
    return F.from_json(text, "array<array<bigint>>")
