"""Distribution and shift tests: statistics as aggregations, p-values of one row on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telesift.operators.prep import before
from telesift.operators.stats import exact_percentiles, long_form


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1 / (1 + step * d or 1e-300)
            c = 1 + step / c or 1e-300
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value


def t_tail(t: float, df: float) -> float:
    return beta_share(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_share(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def ks_tail(d: float, n: int, m: int) -> float:
    """Asymptotic two-sided p-value."""
    root = math.sqrt(n * m / (n + m))
    x = (root + 0.12 + 0.11 / root) * d
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101)))) if x > 0.2 else 1.0


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    return 1.0 if k <= 0 else beta_share(k, n - k + 1, p)


def with_p(df: DataFrame, tail: Callable[..., float], *columns: str) -> DataFrame:
    """A table of statistics with p, the tail of some of its columns; null where one of them is."""

    @F.pandas_udf("double")
    def value(*parts: pd.Series) -> pd.Series:
        rows = zip(*(p.tolist() for p in parts), strict=True)
        return pd.Series([None if any(pd.isna(x) for x in r) else float(tail(*r)) for r in rows], dtype="float64")

    return df.withColumn("p", value(*[F.col(c).cast("double") for c in columns]))


def correlation_tail(r: float, n: float) -> float:
    """Two-sided, by the t distribution of n - 2 degrees."""
    if n < 3:
        return 1.0
    return 0.0 if abs(r) >= 1 else t_tail(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def paired_tail(t: float, n: float) -> float:
    return t_tail(t, n - 1)


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(channel, n, skew, kurtosis): population skewness and excess kurtosis."""
    rows = long_form(df.select(*columns), columns, [])
    return rows.groupBy("channel").agg(F.count("value").alias("n"), F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurtosis"))


def normality(df: DataFrame, columns: list[str]) -> DataFrame:
    """(channel, k2, p): D'Agostino's test from skewness and kurtosis, all in column expressions."""
    n, b1, g2 = F.col("n").cast("double"), F.col("skew"), F.col("kurtosis") + 3
    y = b1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (b2 - 1))
    delta, alpha = 1 / F.sqrt(0.5 * F.log(w2)), F.sqrt(2 / (w2 - 1))
    z1 = delta * F.log(y / alpha + F.sqrt((y / alpha) * (y / alpha) + 1))
    e = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 - e) / F.sqrt(var)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    inner = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z2 = ((1 - 2 / (9 * a)) - F.signum(inner) * F.pow(F.abs(inner), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    return moments(df, columns).withColumn("k2", z1 * z1 + z2 * z2).withColumn("p", F.exp(-F.col("k2") / 2)).select("channel", "n", "k2", "p")


def levene(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (statistic, d1, d2): deviations from the medians of the channels, then analysis of variance."""
    rows = long_form(df.select(*columns), columns, []).filter("value is not null")
    medians = exact_percentiles(df, {c: (c, 0.5) for c in columns}).unpivot([], columns, "channel", "m")
    z = rows.join(F.broadcast(medians), "channel").withColumn("z", F.abs(F.col("value") - F.col("m")))
    groups = z.groupBy("channel").agg(F.count("*").alias("n"), F.avg("z").alias("mean"), F.var_pop("z").alias("var"))
    total = groups.agg(F.sum("n").alias("all"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("var")).alias("within"))
    between = groups.crossJoin(F.broadcast(total)).groupBy("all", "k", "within").agg(F.sum(F.col("n") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand"))).alias("between"))
    return between.select((F.try_divide((F.col("all") - F.col("k")) * F.col("between"), (F.col("k") - 1) * F.col("within"))).alias("statistic"), (F.col("k") - 1).alias("d1"), (F.col("all") - F.col("k")).alias("d2"))


def ranked(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with average ranks of a column; equal values are counted once."""
    values = df.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    ranks = before(values, "_v", ["_n"])
    return df.join(ranks.select("_v", (F.col("_n_before") + (F.col("_n") + 1) / 2.0).alias(out)), df[column] == F.col("_v")).drop("_v")


def correlations(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (pearson, spearman)."""
    both = ranked(ranked(df.select(a, b), a, "_ra"), b, "_rb")
    return both.agg(F.corr(a, b).alias("pearson"), F.corr("_ra", "_rb").alias("spearman"))


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    return df.agg(F.count(d).alias("n"), F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(F.count(d))).alias("t"))


def ks_two_sample(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys.., d, n, m) of rows (keys.., side 0/1, value): largest distance of the two distributions."""
    keys = keys or []
    values = rows.groupBy(*keys, "value").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    placed = before(values, "value", ["a", "b"], keys)
    total = F.broadcast(placed.groupBy(*keys).agg(F.sum("a").alias("n"), F.sum("b").alias("m")))
    placed = placed.join(total, keys) if keys else placed.crossJoin(total)
    at = placed.select(*keys, (F.col("a_before") + F.col("a")).alias("ca"), (F.col("b_before") + F.col("b")).alias("cb"), "n", "m")
    return at.groupBy(*keys).agg(F.max(F.abs(F.col("ca") / F.col("n") - F.col("cb") / F.col("m"))).alias("d"), F.first("n").alias("n"), F.first("m").alias("m"))


def mann_whitney(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys.., u, z) of rows (keys.., side 0/1, value): U of side 0 and its normal score with tie correction."""
    keys = keys or []
    values = rows.groupBy(*keys, "value").agg(F.count("*").alias("c"), F.count_if(F.col("side") == 0).alias("a"))
    at = before(values, "value", ["c"], keys).withColumn("rank", F.col("c_before") + (F.col("c") + 1) / 2.0)
    c = F.col("c").cast("double")
    one = at.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("a")).alias("r"), F.sum("a").alias("n"), (F.sum("c") - F.sum("a")).alias("m"), F.sum(c * c * c - c).alias("ties"))
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    u = F.col("r") - n * (n + 1) / 2
    spread = F.sqrt(n * m / 12 * ((n + m + 1) - F.col("ties") / ((n + m) * (n + m - 1))))
    return one.select(*keys, u.alias("u"), F.try_divide(u - n * m / 2, spread).alias("z"))


def above_budget(df: DataFrame, flag: str, share: float = 0.01) -> dict[str, float]:
    """Counts and P(X >= flagged) under a binomial of that share."""
    one = df.agg(F.count("*").alias("n"), F.sum(flag).alias("k")).first()
    return {"n": one["n"], "k": one["k"] or 0, "p": binomial_tail(one["k"] or 0, one["n"], share)}
