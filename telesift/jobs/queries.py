"""Registered queries over the driver tables, each with SQL for the same answer where SQL has one.

Numbers that depend on the order of summation are rounded on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telesift.functions import scores as X
from telesift.jobs import detectors, forest, fusion, hypothesis, residual, saved
from telesift.operators import events as E
from telesift.operators import metrics as M
from telesift.operators import prep as P
from telesift.operators import rolling as R
from telesift.operators import sketches as K
from telesift.operators import stats as S
from telesift.operators import windows as W
from telesift.sources import telemetry as T
from telesift.sources.durable import place, written
from telesift.sources.telemetry import CHANNELS, MULTI_SQL, SINGLE_SQL
from telesift.streaming import late, live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CHUNK = 5_000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def multi(spark, d):
    return T.telemetry(spark, d)


def single(spark, d):
    return T.telemetry(spark, d, single=True)


def m(body: str) -> str:
    return f"WITH {MULTI_SQL}{body}"


def s(body: str) -> str:
    return f"WITH {SINGLE_SQL}{body}"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def per_channel(template: str, joiner: str = " UNION ALL ") -> str:
    return joiner.join(template.replace("{c}", c) for c in CHANNELS)


LONG = ", v AS (" + per_channel("SELECT series_id, rn, '{c}' AS channel, {c} AS value, is_anomaly FROM t") + ")"
LABEL_EVENTS = """, r AS (SELECT series_id, rn, rn - row_number() OVER (PARTITION BY series_id ORDER BY rn) AS g FROM t WHERE {flag}),
e AS (SELECT series_id, min(rn) AS start_rn, max(rn) AS end_rn FROM r GROUP BY series_id, g)"""
TRUE = LABEL_EVENTS.format(flag="is_anomaly = 1")
# predicted events: hours from 0 to 5
NIGHT = LABEL_EVENTS.format(flag="channel_41 > 60").replace(", r AS", ", pr AS").replace("FROM r ", "FROM pr ").replace("\ne AS", "\np AS")


def merged_sql(source: str, out: str, gap: int) -> str:
    return f""", {out}1 AS (SELECT *, CASE WHEN start_rn - lag(end_rn) OVER (PARTITION BY series_id ORDER BY start_rn) - 1 <= {gap} THEN 0 ELSE 1 END AS n FROM {source}),
{out}2 AS (SELECT *, sum(n) OVER (PARTITION BY series_id ORDER BY start_rn) AS k FROM {out}1),
{out} AS (SELECT series_id, min(start_rn) AS start_rn, max(end_rn) AS end_rn FROM {out}2 GROUP BY series_id, k)"""


def predicted(df: DataFrame) -> DataFrame:
    return E.extract(df.withColumn("hit", (F.col("channel_41") > 60).cast("int")), "hit")


# --- sources and sinks


@query("io1_pruned_read", "SELECT event_id, value FROM events")
def _(spark, d):
    return T.read_parquet(spark, f"{d}/events.parquet", ["event_id", "value"])


def _kept(df: DataFrame, kind: str) -> str:
    return place(df.sparkSession, kind)


@query("io2_typed_csv", s(" SELECT id AS timestamp, round(CAST(channel_41 AS FLOAT), 3) AS channel_41, CAST(channel_42 AS FLOAT) AS channel_42, is_anomaly FROM t"))
def _(spark, d):
    df = single(spark, d).select(F.col("id").alias("timestamp"), "channel_41", "channel_42", "is_anomaly")
    path = _kept(df, "csv")
    df.write.csv(path, header=True)
    back = T.read_csv(spark, path, T.csv_schema(df.columns))
    return back.withColumn("channel_41", F.round("channel_41", 3)).withColumn("is_anomaly", F.col("is_anomaly").cast("int"))


@query("io3_matrix_round_trip", s(" SELECT rn, round(channel_41, 6) AS channel_41, round(channel_45, 6) AS channel_45 FROM t"))
def _(spark, d):
    df = single(spark, d)
    path = _kept(df, "matrix")
    T.write_matrix(df, path, ["channel_41", "channel_45"])
    return rounded(T.read_matrix(spark, path, ["channel_41", "channel_45"]), "channel_41", "channel_45")


def _flagged(spark, d):
    df = single(spark, d)
    return detectors.global_std(df, P.nominal(df), CHANNELS, 2.5, "pred")


FLAGGED = (
    ", f AS (SELECT " + ", ".join(f"avg({c}) AS m{c[-2:]}, stddev_pop({c}) AS s{c[-2:]}" for c in CHANNELS) + " FROM t WHERE is_anomaly = 0), g AS (SELECT t.*, CASE WHEN "
    + " OR ".join(f"abs({c} - m{c[-2:]}) > {{n}} * s{c[-2:]}" for c in CHANNELS) + " THEN 1 ELSE 0 END AS pred FROM t, f)"
)


@query("io4_binary_result", s(FLAGGED.format(n=2.5) + " SELECT id, pred AS is_anomaly FROM g"))
def _(spark, d):
    df = _flagged(spark, d).select("id", F.col("pred").alias("is_anomaly"))
    path = _kept(df, "result")
    T.write_result(df, path, ["id", "is_anomaly"])
    return spark.read.parquet(path)


@query("io6_continuous_result", s(" SELECT id AS ID, round(1 - exp(-abs(channel_41) / 50.0), 6) AS Anomaly_Score FROM t"))
def _(spark, d):
    df = single(spark, d).select(F.col("id").alias("ID"), F.round(X.z_to_score(F.col("channel_41"), 50.0), 6).alias("Anomaly_Score"))
    path = _kept(df, "scores")
    T.write_result(df, path, ["ID", "Anomaly_Score"])
    return spark.read.parquet(path)


@query("io7_parquet_to_csv", "SELECT event_id, event_type FROM events")
def _(spark, d):
    path = _kept(spark.range(1), "converted")
    T.convert_parquet_to_csv(spark, f"{d}/events.parquet", path, ["event_id", "event_type"])
    return spark.read.schema("event_id long, event_type string").csv(path, header=True)


@query("io8_timestamped", s(" SELECT id AS timestamp, channel_42, channel_46, is_anomaly FROM t"))
def _(spark, d):
    return T.to_timestamped(single(spark, d), ["channel_42", "channel_46"])


@query("io9_fitted_state", s(LONG + " SELECT channel, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM v GROUP BY channel"))
def _(spark, d):
    fitted = S.channel_stats(single(spark, d), CHANNELS)
    path = _kept(fitted, "fitted")
    fitted.write.parquet(path)
    return rounded(spark.read.parquet(path), "mean", "std")


GROUPS = '{"power": {"cells": [{"key": "channel_41"}, {"key": "channel_42"}], "bus": [{"key": "channel_43"}]}, "thermal": {"tank": [{"key": "channel_44"}, {"key": "channel_45"}, {"key": "channel_46"}]}}'


@query("io10_j7_channel_groups", s(LONG + """, w AS (SELECT channel, count(*) AS n FROM v GROUP BY channel)
SELECT channel, n, CASE WHEN channel < 'channel_44' THEN 'power' ELSE 'thermal' END AS subsystem,
 CASE WHEN channel < 'channel_43' THEN 'cells' WHEN channel = 'channel_43' THEN 'bus' ELSE 'tank' END AS subgroup FROM w"""))
def _(spark, d):
    counts = S.long_form(single(spark, d).select(*CHANNELS), CHANNELS, []).groupBy("channel").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(T.channel_groups(spark, GROUPS)), "channel")


@query("io11_any_stream", s(" SELECT rn, CAST(greatest(CASE WHEN channel_41 > 60 THEN 1 ELSE 0 END, channel_46) AS INTEGER) AS is_anomaly FROM t"))
def _(spark, d):
    df = single(spark, d).withColumn("a", (F.col("channel_41") > 60).cast("int")).withColumn("b", F.col("channel_46").cast("int"))
    return df.select("rn", T.any_channel(["a", "b"]).alias("is_anomaly"))


# --- projections, cleaning, splits


@query("p1_valid_channels", s(" SELECT id, channel_41, channel_43 FROM t"))
def _(spark, d):
    df = single(spark, d)
    return P.require(df, ["id"]).select("id", *P.valid_channels([" channel_43", "﻿channel_41", "channel_43", "other"], CHANNELS, sort=True))


@query("p2_coerced", "SELECT o_orderkey, TRY_CAST(o_orderpriority AS DOUBLE) AS word, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS digit FROM orders")
def _(spark, d):
    df = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_orderpriority").alias("word"), F.substring("o_orderpriority", 1, 1).alias("digit"))
    return P.to_numbers(df, ["word", "digit"])


@query("p3_dense_index", "SELECT o_orderkey, o_totalprice, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders")
def _(spark, d):
    return P.dense_index(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_orderkey")


@query("p4_nominal", m(" SELECT series_id, count(*) AS n FROM t WHERE is_anomaly = 0 GROUP BY series_id"))
def _(spark, d):
    return P.nominal(multi(spark, d)).groupBy("series_id").agg(F.count("*").alias("n"))


@query("p5_audit", s(LONG + " SELECT channel, count(*) AS rows, round(min(value), 6) AS lo, round(max(value), 6) AS hi, count(*) FILTER (value IS NULL) AS nulls FROM v GROUP BY channel"))
def _(spark, d):
    return rounded(P.audit(single(spark, d), CHANNELS), "lo", "hi")


@query("p6_context_slice", s(TRUE + """, q AS (SELECT *, row_number() OVER (ORDER BY start_rn) AS k, count(*) OVER () AS n FROM e), c AS (SELECT start_rn FROM q WHERE k = n // 2 + 1)
SELECT t.id, t.channel_42 FROM t, c WHERE t.rn >= c.start_rn - 50 AND t.rn < c.start_rn + 50"""))
def _(spark, d):
    df = single(spark, d)
    at = written(P.dense_index(E.extract(df, "is_anomaly"), "start_rn", "k"))
    centre = S.with_row(at, at.agg(F.count("*").alias("n"))).filter("k = floor(n / 2)").select(F.col("start_rn").alias("c"))
    return S.with_row(df, centre).filter("rn >= c - 50 and rn < c + 50").select("id", "channel_42")


@query("p7_chronological", s(""" , n AS (SELECT count(*) AS n FROM t) SELECT rule, part, count(*) AS n, CAST(sum(rn) AS BIGINT) AS rows FROM (
SELECT 'floor' AS rule, CASE WHEN rn < CAST(floor(n.n * 0.85) AS BIGINT) THEN 'train' ELSE 'validation' END AS part, rn FROM t, n UNION ALL
SELECT 'ceil', CASE WHEN rn < n.n - CAST(ceil(n.n * 0.2) AS BIGINT) THEN 'train' ELSE 'validation' END, rn FROM t, n UNION ALL
SELECT 'share', CASE WHEN rn < CAST(floor(n.n * 0.85) AS BIGINT) THEN 'train' ELSE 'validation' END, rn FROM t, n) GROUP BY rule, part"""))
def _(spark, d):
    df = single(spark, d)
    n, out = df.count(), None
    for rule, f in (("floor", 0.15), ("ceil", 0.2), ("share", 0.85)):
        for part, rows in zip(("train", "validation"), P.chronological(df, P.cut_position(n, f, rule)), strict=True):
            one = rows.agg(F.count("*").alias("n"), F.sum("rn").alias("rows")).select(F.lit(rule).alias("rule"), F.lit(part).alias("part"), "n", "rows")
            out = one if out is None else out.union(one)
    return out


@query("p8_j1_aligned", m(" SELECT a.series_id, a.rn, a.id, b.id AS other FROM t a JOIN t b ON b.series_id = a.series_id + 1 AND a.rn = b.rn"))
def _(spark, d):
    df = multi(spark, d)
    shifted = df.select((F.col("series_id") - 1).alias("series_id"), "rn", F.col("id").alias("other"))
    return P.align(df.select("series_id", "rn", "id"), shifted)


@query("p9_stratified")
def _(spark, d):
    return P.stratified_split(single(spark, d), "is_anomaly").groupBy("is_anomaly", "held_out").agg(F.count("*").alias("n"))


@query("p10_sampled")
def _(spark, d):
    return P.sample_rows(single(spark, d), 100).select("id", "channel_41")


FRAGMENTS = ", fr AS (SELECT *, rn - row_number() OVER (PARTITION BY series_id ORDER BY rn) AS g FROM t WHERE is_anomaly = 0)"


@query("p11_fragment_cut", s(FRAGMENTS + ", i AS (SELECT *, row_number() OVER (ORDER BY rn) - 1 AS idx, count(*) OVER () AS n FROM fr) SELECT CASE WHEN idx < round(0.8 * n) THEN 'train' ELSE 'validation' END AS part, count(*) AS n, count(DISTINCT g) AS fragments FROM i GROUP BY 1"))
def _(spark, d):
    df = P.dense_index(P.nominal(single(spark, d)).select("rn", "id").withColumnRenamed("rn", "pos"), "pos")
    n = df.count()
    part = F.when(F.col("rn") < round(0.8 * n), "train").otherwise("validation")
    return df.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.countDistinct(F.col("pos") - F.col("rn")).alias("fragments"))


@query("p12_fragment_dates", m(""", fr AS (SELECT series_id AS fragment, min(ts) AS lo, max(ts) AS hi FROM t GROUP BY series_id), c AS (SELECT TIMESTAMP '2024-01-15 00:00:00' AS c)
SELECT fragment, 'train' AS part, lo, least(hi, c) AS hi FROM fr, c WHERE lo <= c UNION ALL SELECT fragment, 'validation', greatest(lo, c), hi FROM fr, c WHERE hi >= c"""))
def _(spark, d):
    fragments = multi(spark, d).groupBy(F.col("series_id").alias("fragment")).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return P.split_fragments(fragments, "2024-01-15 00:00:00")


# --- joins and evaluation of events


@query("j2_overlaps", m(TRUE + NIGHT + " SELECT p.series_id, p.start_rn AS p_start, p.end_rn AS p_end, e.start_rn AS t_start, e.end_rn AS t_end FROM p JOIN e ON p.series_id = e.series_id AND p.start_rn <= e.end_rn AND p.end_rn >= e.start_rn"))
def _(spark, d):
    df = multi(spark, d)
    return E.overlaps(predicted(df), E.extract(df, "is_anomaly"))


@query("j3_hits", m(TRUE + NIGHT + " SELECT p.*, CASE WHEN EXISTS (SELECT 1 FROM e WHERE p.series_id = e.series_id AND p.start_rn <= e.end_rn AND p.end_rn >= e.start_rn) THEN 'hit' ELSE 'miss' END AS kind FROM p"))
def _(spark, d):
    df = multi(spark, d)
    p, t = predicted(df), E.extract(df, "is_anomaly")
    return M.true_positives(p, t).withColumn("kind", F.lit("hit")).unionByName(M.false_positives(p, t).withColumn("kind", F.lit("miss")))


FIRST_HIT = ", h AS (SELECT p.series_id, p.start_rn, min(e.start_rn) AS t FROM p JOIN e ON p.series_id = e.series_id AND p.start_rn <= e.end_rn AND p.end_rn >= e.start_rn GROUP BY 1, 2)"


@query("j4_a22_sequences", m(TRUE + NIGHT + FIRST_HIT + """, k AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT series_id, t FROM h)) AS tp, (SELECT count(*) FROM p) - (SELECT count(*) FROM h) AS fp, (SELECT count(*) FROM e) AS n)
SELECT tp, fp, n - tp AS fn, round(tp / (tp + fp), 6) AS precision, round(tp / n, 6) AS recall FROM k"""))
def _(spark, d):
    df = multi(spark, d)
    return rounded(M.precision_recall(M.sequence_counts(predicted(df), E.extract(df, "is_anomaly"))), "precision", "recall")


@query("j5_greedy_matches")
def _(spark, d):
    df = multi(spark, d)
    return M.greedy_matches(predicted(df), E.extract(df, "is_anomaly"))


@query("j6_with_stats", s(", f AS (SELECT avg(channel_41) AS m, stddev_pop(channel_41) AS s FROM t) SELECT id, round((channel_41 - m) / s, 6) AS z FROM t, f"))
def _(spark, d):
    df = single(spark, d)
    return S.with_row(df, S.stats_row(df, ["channel_41"])).select("id", F.round((F.col("channel_41") - F.col("channel_41_mean")) / F.col("channel_41_std"), 6).alias("z"))


# --- aggregations


@query("a1_channel_stats", s(LONG + " SELECT channel, round(avg(value), 6) AS mean, round(greatest(stddev_pop(value), 0.5), 6) AS std FROM v WHERE is_anomaly = 0 GROUP BY channel"))
def _(spark, d):
    return rounded(S.channel_stats(P.nominal(single(spark, d)), CHANNELS, 0.5), "mean", "std")


@query("a2_describe", s(LONG + " SELECT channel, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM v GROUP BY channel"))
def _(spark, d):
    return rounded(S.describe(single(spark, d), CHANNELS), "mean", "std", "lo", "hi")


@query("a3_ranges", s(LONG + " SELECT channel, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(max(value) - min(value), 6) AS range FROM v GROUP BY channel"))
def _(spark, d):
    return rounded(S.ranges(single(spark, d), CHANNELS), "lo", "hi", "range")


BINARY = ", b AS (SELECT channel, count(DISTINCT value) = 2 AND sum(abs(trunc(value) - value)) = 0 AS is_binary FROM v GROUP BY channel)"


@query("a4_binary_channels", s(LONG + BINARY + " SELECT * FROM b"))
def _(spark, d):
    return S.binary_channels(single(spark, d), CHANNELS)


@query("a5_scaling", s(LONG + BINARY + """, q AS (SELECT channel, avg(value) AS a, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi FROM v GROUP BY channel)
SELECT channel, round(CASE WHEN is_binary THEN lo ELSE a END, 6) AS mean, round(CASE WHEN is_binary THEN hi - lo WHEN s = 0 THEN 1 ELSE s END, 6) AS std FROM q JOIN b USING (channel)"""))
def _(spark, d):
    return rounded(S.scaling_stats(single(spark, d), CHANNELS), "mean", "std")


@query("a6_median_mad", s(LONG + ", q AS (SELECT channel, quantile_cont(value, 0.5) AS md FROM v GROUP BY channel) SELECT channel, round(any_value(md), 6) AS median, round(quantile_cont(abs(value - md), 0.5), 6) AS mad FROM v JOIN q USING (channel) GROUP BY channel"))
def _(spark, d):
    return rounded(S.median_mad(single(spark, d), CHANNELS), "median", "mad")


@query("a7_percentiles", s(" SELECT round(quantile_cont(channel_41, 0.05), 6) AS p5, round(quantile_cont(channel_41, 0.4), 6) AS p40, round(quantile_cont(channel_41, 0.95), 6) AS p95, round(quantile_cont(channel_41, 0.99), 6) AS p99 FROM t"))
def _(spark, d):
    return rounded(S.percentiles(single(spark, d), "channel_41", [0.05, 0.4, 0.95, 0.99]), "p5", "p40", "p95", "p99")


SKETCHED = [0.01, 0.05, 0.5, 0.95, 0.99]


# sketches by day, merged; their values' exact ranks must lie within the stated error
@query("a7_sketched_by_day", s(LONG + " SELECT channel, count(*) AS n, true AS within FROM v GROUP BY channel"))
def _(spark, d):
    df = single(spark, d)
    days = K.quantile_sketch(df.withColumn("day", F.to_date("ts")), CHANNELS, ["day"])
    found = K.sketch_quantiles(K.merge_sketches(days), SKETCHED)
    return K.rank_distance(df, found, SKETCHED).groupBy("channel", "n").agg((F.max("apart") <= K.rank_error()).alias("within"))


@query("a8_contamination", s(" SELECT round(avg(is_anomaly), 6) AS contamination FROM t"))
def _(spark, d):
    return rounded(S.contamination(single(spark, d)), "contamination")


@query("a9_flag_totals", s(FLAGGED.format(n=2.5) + " SELECT CAST(sum(pred) AS BIGINT) AS flags, round(avg(pred), 6) AS rate FROM g"))
def _(spark, d):
    return _flagged(spark, d).agg(F.sum("pred").alias("flags"), F.round(F.avg("pred"), 6).alias("rate"))


SCORES = ", sc AS (SELECT t.*, 1 - exp(-channel_41 / 40.0) AS a, 1 - exp(-channel_42 / 4.0) AS b, 1 - exp(-channel_45 / 3.0) AS c FROM t)"


def scored(df: DataFrame) -> DataFrame:
    return df.withColumns({n: X.z_to_score(F.col(c), z) for n, c, z in (("a", "channel_41", 40.0), ("b", "channel_42", 4.0), ("c", "channel_45", 3.0))})


METHODS = ", me AS (SELECT 'a' AS method, a AS score FROM sc UNION ALL SELECT 'b', b FROM sc UNION ALL SELECT 'c', c FROM sc UNION ALL SELECT 'mean', (a + b) / 2 FROM sc)"


@query("a10_a11_method_table", s(SCORES + METHODS + " SELECT method, count(*) FILTER (score > 0.5) AS above, round(100.0 * count(*) FILTER (score > 0.5) / count(*), 4) AS percent, round(avg(score), 6) AS mean, round(max(score), 6) AS top FROM me GROUP BY method"))
def _(spark, d):
    df = scored(single(spark, d)).withColumn("mean", (F.col("a") + F.col("b")) / 2)
    rows = S.long_form(df.select("a", "b", "c", "mean"), ["a", "b", "c", "mean"], [], "method", "score")
    above = F.count_if(F.col("score") > 0.5)
    return rounded(rows.groupBy("method").agg(above.alias("above"), F.round(100.0 * above / F.count("*"), 4).alias("percent"), F.avg("score").alias("mean"), F.max("score").alias("top")), "mean", "top")


@query("a12_class_weight", s(" SELECT is_anomaly, count(*) AS n, round((SELECT greatest(count(*) FILTER (is_anomaly = 0), 1) / greatest(count(*) FILTER (is_anomaly = 1), 1) FROM t), 6) AS weight FROM t GROUP BY is_anomaly"))
def _(spark, d):
    df = single(spark, d)
    return df.groupBy("is_anomaly").agg(F.count("*").alias("n")).withColumn("weight", F.lit(round(fusion.class_weight(df, "is_anomaly"), 6)))


@query("a13_agreement", s(SCORES + " SELECT a > 0.7 AS a, b > 0.7 AS b, count(*) AS n FROM sc GROUP BY 1, 2"))
def _(spark, d):
    return scored(single(spark, d)).groupBy((F.col("a") > 0.7).alias("a"), (F.col("b") > 0.7).alias("b")).agg(F.count("*").alias("n"))


@query("a14_votes", s(SCORES + " SELECT CAST(a >= 0.5 AS INTEGER) + CAST(b >= 0.5 AS INTEGER) + CAST(c >= 0.5 AS INTEGER) AS votes, count(*) AS n FROM sc GROUP BY 1"))
def _(spark, d):
    votes = sum(((F.col(x) >= 0.5).cast("int") for x in "bc"), (F.col("a") >= 0.5).cast("int"))
    return scored(single(spark, d)).groupBy(votes.alias("votes")).agg(F.count("*").alias("n"))


@query("a15_correlation", s(SCORES + " SELECT round(corr(a, b), 6) AS ab, round(corr(a, c), 6) AS ac, round(corr(b, c), 6) AS bc FROM sc"))
def _(spark, d):
    return rounded(scored(single(spark, d)).agg(F.corr("a", "b").alias("ab"), F.corr("a", "c").alias("ac"), F.corr("b", "c").alias("bc")), "ab", "ac", "bc")


@query("a15_correlation_matrix", s(" " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) AS correlation FROM t" for a in CHANNELS for b in CHANNELS)))
def _(spark, d):
    return rounded(K.correlation_matrix(single(spark, d), CHANNELS), "correlation")


@query("a16_histogram", s(" SELECT is_anomaly, CAST(least(floor(channel_41 / (500.0 / 20)), 19) AS BIGINT) AS bin, count(*) AS n FROM t WHERE channel_41 BETWEEN 0 AND 500 GROUP BY 1, 2"))
def _(spark, d):
    return S.histogram(single(spark, d), "channel_41", 0.0, 500.0, 20, ["is_anomaly"])


@query("a17_quartiles", s(SCORES + METHODS + " SELECT method, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.25), 6) AS q1, round(median(score), 6) AS median, round(quantile_cont(score, 0.75), 6) AS q3, round(max(score), 6) AS top FROM me GROUP BY method"))
def _(spark, d):
    df = scored(single(spark, d)).withColumn("mean", (F.col("a") + F.col("b")) / 2)
    rows = S.long_form(df.select("a", "b", "c", "mean"), ["a", "b", "c", "mean"], [], "method", "score")
    marks = S.exact_percentiles(rows, {"q1": ("score", 0.25), "median": ("score", 0.5), "q3": ("score", 0.75)}, ["method"])
    out = rows.groupBy("method").agg(F.avg("score").alias("mean"), F.max("score").alias("top")).join(marks, "method")
    return rounded(out, "mean", "q1", "median", "q3", "top")


def z_sql(size: int, source: str = "t", channel: str = "channel_41", least: int = 1) -> str:
    w = f"OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN {size // 2} PRECEDING AND {(size - 1) // 2} FOLLOWING)"
    return f"CASE WHEN count({channel}) {w} >= {least} THEN abs({channel} - avg({channel}) {w}) / greatest(coalesce(stddev_samp({channel}) {w}, 0.000001), 0.000001) END"


@query("a18_parameter_grid", s(f", z AS (SELECT {z_sql(50)} AS z50, {z_sql(100)} AS z100, {z_sql(200)} AS z200 FROM t) " + " UNION ALL ".join(f"SELECT {w} AS size, CAST({x} AS DOUBLE) AS threshold, count(*) FILTER (z{w} > {x}) AS flags, round(avg(CASE WHEN z{w} > {x} THEN 1.0 ELSE 0.0 END), 6) AS rate FROM z" for w in (50, 100, 200) for x in (3.0, 3.5, 4.0, 4.5, 5.0))))
def _(spark, d):
    df = single(spark, d)
    return grid_cells(df, ["channel_41"]).withColumn("rate", F.round("rate", 6))


GRID_WINDOWS, GRID_LIMITS = (50, 100, 200), (3.0, 3.5, 4.0, 4.5, 5.0)


def grid_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(size, threshold, flags, rate): rows of which any channel lies farther from its centred mean, for every window and threshold, in one aggregation."""

    def farthest(b):
        return [R.largest([R.block_z(b, c, w, 1, 1e-6) for c in columns]) for w in GRID_WINDOWS]

    wide = R.by_blocks(df.select("series_id", "rn", *columns), 100, 100, [f"z{w}" for w in GRID_WINDOWS], farthest, CHUNK)
    one = wide.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"z{w}") > t).alias(f"{w}_{i}") for w in GRID_WINDOWS for i, t in enumerate(GRID_LIMITS)])
    cells = [F.struct(F.lit(w).alias("size"), F.lit(t).alias("threshold"), F.col(f"{w}_{i}").alias("flags"), (F.col(f"{w}_{i}") / F.col("n")).alias("rate")) for w in GRID_WINDOWS for i, t in enumerate(GRID_LIMITS)]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


# rows of which any channel passes, rates side by side
@query("a18_any_channel_grid", s(", z AS (SELECT " + ", ".join("greatest(" + ", ".join(z_sql(w, channel=c) for c in CHANNELS) + f") AS z{w}" for w in GRID_WINDOWS) + " FROM t) " + " UNION ALL ".join(f"SELECT CAST({x} AS DOUBLE) AS threshold, " + ", ".join(f"round(avg(CASE WHEN z{w} > {x} THEN 1.0 ELSE 0.0 END), 6) AS w{w}" for w in GRID_WINDOWS) + " FROM z" for x in GRID_LIMITS)))
def _(spark, d):
    cells = grid_cells(single(spark, d), CHANNELS)
    return cells.groupBy("threshold").pivot("size", list(GRID_WINDOWS)).agg(F.round(F.first("rate"), 6)).select("threshold", *[F.col(str(w)).alias(f"w{w}") for w in GRID_WINDOWS])


POINT = " SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(1.25 * (tp / (tp + fp)) * (tp / (tp + fn)) / (0.25 * (tp / (tp + fp)) + tp / (tp + fn)), 6) AS f_beta FROM (SELECT count(*) FILTER (pred = 1 AND is_anomaly = 1) AS tp, count(*) FILTER (pred = 1 AND is_anomaly = 0) AS fp, count(*) FILTER (pred = 0 AND is_anomaly = 1) AS fn FROM g)"


@query("a19_pointwise", s(FLAGGED.format(n=2.5) + POINT))
def _(spark, d):
    return rounded(M.pointwise(_flagged(spark, d), "pred", "is_anomaly"), "precision", "recall", "f_beta")


EVENTWISE = """, hp AS (SELECT count(*) AS tp FROM p WHERE EXISTS (SELECT 1 FROM e WHERE p.series_id = e.series_id AND p.start_rn <= e.end_rn AND p.end_rn >= e.start_rn)),
ht AS (SELECT count(*) AS found FROM e WHERE EXISTS (SELECT 1 FROM p WHERE p.series_id = e.series_id AND p.start_rn <= e.end_rn AND p.end_rn >= e.start_rn)),
k AS (SELECT (SELECT count(*) FROM p) AS n_pred, (SELECT count(*) FROM e) AS n_true, tp, found FROM hp, ht)
SELECT n_pred, n_true, tp, round(tp / n_pred, 6) AS precision, round({top} / n_true, 6) AS recall, round(1.25 * (tp / n_pred) * ({top} / n_true) / (0.25 * (tp / n_pred) + {top} / n_true), 6) AS f05 FROM k"""


@query("a20_eventwise", m(TRUE + NIGHT + EVENTWISE.format(top="tp")))
def _(spark, d):
    df = multi(spark, d)
    return rounded(M.eventwise(predicted(df), E.extract(df, "is_anomaly")), "precision", "recall", "f05")


@query("a20_eventwise_corrected", m(TRUE + NIGHT + EVENTWISE.format(top="found")))
def _(spark, d):
    df = multi(spark, d)
    return rounded(M.eventwise(predicted(df), E.extract(df, "is_anomaly"), "matched_true"), "precision", "recall", "f05")


@query("a21_strict_eventwise")
def _(spark, d):
    df = multi(spark, d)
    return rounded(M.strict_eventwise(predicted(df), E.extract(df, "is_anomaly")), "precision", "recall", "f_beta")


@query("a23_run_totals", m(TRUE + " SELECT count(DISTINCT series_id) AS series, count(*) AS anomalies, CAST(sum(end_rn - start_rn + 1) AS BIGINT) AS points FROM e"))
def _(spark, d):
    return E.extract(multi(spark, d), "is_anomaly").agg(F.countDistinct("series_id").alias("series"), F.count("*").alias("anomalies"), F.sum(E.length()).alias("points"))


@query("a24_event_lengths", s(TRUE + ", l AS (SELECT end_rn - start_rn + 1 AS n FROM e) SELECT count(*) AS events, round(avg(n), 6) AS mean, CAST(quantile_cont(n, 0.5) AS DOUBLE) AS median, round(stddev_pop(n), 6) AS std, CAST(quantile_cont(n, 0.95) AS DOUBLE) AS p95, max(n) AS longest FROM l"))
def _(spark, d):
    return rounded(E.length_stats(E.extract(single(spark, d), "is_anomaly")), "mean", "std", "median", "p95")


@query("a25_auc", s(SCORES + ", k AS (SELECT is_anomaly, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS r FROM sc) SELECT round((sum(r) FILTER (is_anomaly = 1) - count(*) FILTER (is_anomaly = 1) * (count(*) FILTER (is_anomaly = 1) + 1) / 2.0) / (CAST(count(*) FILTER (is_anomaly = 1) AS DOUBLE) * count(*) FILTER (is_anomaly = 0)), 6) AS auc FROM k"))
def _(spark, d):
    return rounded(M.roc_auc(scored(single(spark, d)), "a", "is_anomaly"), "auc")


@query("a25_confusion", s(FLAGGED.format(n=2.5) + " SELECT is_anomaly AS label, pred AS flag, count(*) AS n FROM g GROUP BY 1, 2"))
def _(spark, d):
    return M.confusion(_flagged(spark, d), "pred", "is_anomaly")


REPORT = (
    ", cnt AS (SELECT is_anomaly, pred, count(*) AS n FROM g GROUP BY 1, 2), cls AS (SELECT is_anomaly AS c FROM cnt UNION SELECT pred FROM cnt),"
    " seen AS (SELECT c, coalesce(sum(n) FILTER (is_anomaly = c), 0) AS support, coalesce(sum(n) FILTER (pred = c), 0) AS found, coalesce(sum(n) FILTER (pred = c AND is_anomaly = c), 0) AS hit FROM cls, cnt GROUP BY c),"
    " pr AS (SELECT *, CASE WHEN found > 0 THEN hit / found ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS q FROM seen), rated AS (SELECT *, CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END AS f1 FROM pr),"
    " report AS (SELECT CAST(c AS VARCHAR) AS name, p, q, f1, support FROM rated UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) FROM rated"
    " UNION ALL SELECT 'macro avg', avg(p), avg(q), avg(f1), sum(support) FROM rated UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(q * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM rated)"
    " SELECT name, round(p, 6) AS precision, round(q, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM report"
)


@query("a25_class_report", s(FLAGGED.format(n=2.5) + REPORT))
def _(spark, d):
    return rounded(M.class_report(_flagged(spark, d), "pred", "is_anomaly"), "precision", "recall", "f1")


def _forecast(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actual values and a forecast from them (the value before), as the reference takes forecasts from elsewhere."""
    rows = R.over_frames(df.select("series_id", "rn", F.col("channel_41").alias("y")), 1, 0, lambda f: {"y_hat": f.lag("y")}, CHUNK)
    return rows.select("series_id", "rn", "y"), rows.filter("y_hat is not null").select("series_id", "rn", "y_hat")


@query("a26_x12_normalized_error", m(", q AS (SELECT series_id, channel_41 AS y, lag(channel_41) OVER (PARTITION BY series_id ORDER BY rn) AS h FROM t) SELECT series_id, round(avg(abs(y - h)) / (max(y) - min(y)), 6) AS value FROM q WHERE h IS NOT NULL GROUP BY series_id HAVING max(y) > min(y)"))
def _(spark, d):
    return rounded(residual.normalized_error(*_forecast(multi(spark, d))), "value").filter("value is not null")


@query("a27_label_or", s(" SELECT rn, CASE WHEN channel_46 > 0 OR is_anomaly > 0 THEN 1 ELSE 0 END AS label FROM t"))
def _(spark, d):
    df = single(spark, d).withColumn("a", (F.col("channel_46") > 0).cast("int")).withColumn("b", (F.col("is_anomaly") > 0).cast("int"))
    return df.select("rn", T.any_channel(["a", "b"]).alias("label"))


@query("a28_bands", s(SCORES + " SELECT count(*) FILTER (a > 0.9) AS high, count(*) FILTER (a > 0.75 AND a <= 0.9) AS medium FROM sc"))
def _(spark, d):
    return scored(single(spark, d)).agg(F.count_if(F.col("a") > 0.9).alias("high"), F.count_if((F.col("a") > 0.75) & (F.col("a") <= 0.9)).alias("medium"))


@query("a29_gates", s(TRUE + " SELECT (SELECT avg(end_rn - start_rn + 1) > 50 FROM e) AS long_events, (SELECT avg(is_anomaly) > 0.05 FROM t) AS rate_above"))
def _(spark, d):
    df = single(spark, d)
    lengths = E.extract(df, "is_anomaly").agg((F.avg(E.length()) > 50).alias("long_events"))
    return lengths.crossJoin(df.agg((F.avg("is_anomaly") > 0.05).alias("rate_above")))


@query("a30_positions", s(" SELECT count(DISTINCT rn) AS n FROM (SELECT rn FROM t WHERE is_anomaly = 1 UNION ALL SELECT rn FROM t WHERE channel_41 > 60)"))
def _(spark, d):
    df = single(spark, d)
    return df.filter("is_anomaly = 1").select("rn").union(df.filter("channel_41 > 60").select("rn")).agg(F.countDistinct("rn").alias("n"))


# --- windows and events


@query("w1_local_frames", s(" SELECT rn, round(avg(channel_41) OVER w, 9) AS mean, round(greatest(coalesce(stddev_samp(channel_41) OVER w, 0.000001), 0.000001), 7) AS std FROM t WINDOW w AS (PARTITION BY series_id ORDER BY rn ROWS BETWEEN 50 PRECEDING AND 49 FOLLOWING)"))
def _(spark, d):
    out = R.over_frames(single(spark, d), 50, 50, lambda f: dict(zip(("mean", "std"), R.local_stats(f, "channel_41", 100, 1, 1e-6), strict=True)), CHUNK)
    return rounded(rounded(out.select("rn", "mean", "std"), "mean", digits=9), "std", digits=7)


def mean6(expr: str) -> str:
    return "(" + " + ".join(expr.replace("{c}", c) for c in CHANNELS) + f") / {len(CHANNELS)}"


@query("w2_trailing_features", m(f" SELECT series_id, rn, round({mean6('abs({c} - avg({c}) OVER w)')}, 6) AS rolling_mean_dev_10, round({mean6('stddev_samp({c}) OVER w')}, 6) AS rolling_std_10 FROM t WINDOW w AS (PARTITION BY series_id ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"))
def _(spark, d):
    out = R.over_frames(multi(spark, d), 10, 0, lambda f: R.trailing_features(f, CHANNELS, [10]))
    return rounded(out.select("series_id", "rn", "rolling_mean_dev_10", "rolling_std_10"), "rolling_mean_dev_10", "rolling_std_10")


@query("w3_score_features", s(SCORES + " SELECT rn, round(coalesce(avg(a) OVER w, 0), 6) AS score_mean, round(coalesce(stddev_samp(a) OVER w, 0), 6) AS score_std, round(coalesce(a - lag(a) OVER (PARTITION BY series_id ORDER BY rn), 0), 6) AS score_diff FROM sc WINDOW w AS (PARTITION BY series_id ORDER BY rn ROWS BETWEEN 50 PRECEDING AND CURRENT ROW)"))
def _(spark, d):
    out = R.over_frames(scored(single(spark, d)), 51, 0, lambda f: R.score_features(f, "a"), CHUNK)
    return rounded(out.select("rn", "score_mean", "score_std", "score_diff"), "score_mean", "score_std", "score_diff")


@query("w4_deltas", m(" SELECT series_id, rn, " + ", ".join(f"round(coalesce({mean6('abs({c} - lag({c}, ' + str(k) + ') OVER w)')}, 0), 6) AS delta_{k}" for k in (1, 5, 10)) + " FROM t WINDOW w AS (PARTITION BY series_id ORDER BY rn)"))
def _(spark, d):
    out = R.over_frames(multi(spark, d), 10, 0, lambda f: R.deltas(f, CHANNELS, [1, 5, 10]))
    return rounded(out.select("series_id", "rn", "delta_1", "delta_5", "delta_10"), "delta_1", "delta_5", "delta_10")


@query("w5_slope", m(f" SELECT series_id, rn, CASE WHEN rn < 10 THEN 0.0 ELSE round({mean6('abs(regr_slope({c}, CAST(rn AS DOUBLE)) OVER w)')}, 5) END AS slope_magnitude FROM t WINDOW w AS (PARTITION BY series_id ORDER BY rn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"))
def _(spark, d):
    out = R.over_frames(multi(spark, d), 10, 0, lambda f: R.slope(f, CHANNELS))
    return rounded(out.select("series_id", "rn", "slope_magnitude"), "slope_magnitude", digits=5)


@query("w6_pair_correlation", m(""", q AS (SELECT series_id, rn, count(*) OVER w AS n, covar_pop(channel_41, channel_42) OVER w AS cv, stddev_pop(channel_41) OVER w * stddev_pop(channel_42) OVER w AS sp FROM t WINDOW w AS (PARTITION BY series_id ORDER BY rn ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT series_id, rn, round(CASE WHEN n >= 10 AND sp > 1e-12 THEN cv / sp ELSE 0 END, 5) AS corr FROM q"""))
def _(spark, d):
    out = R.over_frames(multi(spark, d), 30, 0, lambda f: {"corr": R.pair_correlation(f, "channel_41", "channel_42")})
    return rounded(out.select("series_id", "rn", "corr"), "corr", digits=5)


FORECAST = (
    ", fw AS (SELECT k, exp(-1 + (k - 1) / 49.0) / (SELECT sum(exp(-1 + (i - 1) / 49.0)) FROM range(1, 51) r(i)) AS w FROM range(1, 51) q(k)), fc AS (SELECT a.rn, "
    + ", ".join(f"sum(w * b.{c}) AS p{c[-2:]}" for c in CHANNELS) + " FROM t a, fw, t b WHERE b.rn = a.rn - 51 + fw.k AND a.rn >= 50 GROUP BY a.rn), fe AS (SELECT t.rn, coalesce(("
    + " + ".join(f"abs({c} - p{c[-2:]})" for c in CHANNELS) + ") / 6, 0) AS error FROM t LEFT JOIN fc ON t.rn = fc.rn)"
)


@query("w7_forecast_error", s(FORECAST + " SELECT rn, round(error, 5) AS error FROM fe"))
def _(spark, d):
    return rounded(R.forecast_error(single(spark, d), CHANNELS, 50, CHUNK).select("rn", "error"), "error", digits=5)


@query("w8_cumulative", s(", q AS (SELECT rn, CASE WHEN rn >= 10 THEN sum(channel_41) OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) ELSE 0 END AS c FROM t) SELECT rn, round(c / (SELECT max(c) FROM q), 6) AS cumulative FROM q"))
def _(spark, d):
    out = R.over_frames(single(spark, d), 10, 0, lambda f: {"c": R.cumulative(f, "channel_41")}, CHUNK)
    return S.with_row(out, out.agg(F.max("c").alias("top"))).select("rn", F.round(F.col("c") / F.col("top"), 6).alias("cumulative"))


@query("w9_events", s(TRUE + " SELECT * FROM e"))
def _(spark, d):
    return E.extract(single(spark, d), "is_anomaly", block=97)


@query("w10_pruned", m(TRUE + " SELECT * FROM e WHERE end_rn - start_rn + 1 >= 2"))
def _(spark, d):
    return E.prune(E.extract(multi(spark, d), "is_anomaly"), 2)


@query("w11_merged", s(TRUE + merged_sql("e", "g", 3) + " SELECT * FROM g"))
def _(spark, d):
    return E.merge(E.extract(single(spark, d), "is_anomaly"), 3, block=97)


@query("w12_prune_then_merge", s(TRUE + ", x AS (SELECT * FROM e WHERE end_rn - start_rn + 1 >= 2)" + merged_sql("x", "g", 8) + " SELECT t.rn, CASE WHEN EXISTS (SELECT 1 FROM g WHERE t.rn BETWEEN g.start_rn AND g.end_rn) THEN 1 ELSE 0 END AS flag FROM t"))
def _(spark, d):
    df = single(spark, d)
    return E.mark(df, E.prune_then_merge(df, "is_anomaly", 2, 8)).select("rn", "flag")


BIN = LABEL_EVENTS.format(flag="channel_41 > 60")


@query("w13_merge_then_prune", s(BIN + merged_sql("e", "g", 2) + " SELECT t.rn, round(CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.end_rn - g.start_rn + 1 >= 5 AND t.rn BETWEEN g.start_rn AND g.end_rn) THEN channel_41 ELSE 0 END, 6) AS kept FROM t"))
def _(spark, d):
    df = single(spark, d)
    return rounded(E.keep_scores(df, "channel_41", E.merge_then_prune(df, "channel_41", 60.0, 3, 5)).select("rn", "kept"), "kept")


@query("w14_budget", s(" , l AS (SELECT quantile_cont(channel_41, 0.9) AS l FROM t WHERE channel_41 > 0) SELECT rn, round(CASE WHEN channel_41 >= l THEN channel_41 ELSE 0 END, 6) AS channel_41 FROM t, l"))
def _(spark, d):
    return rounded(E.budget(single(spark, d).select("rn", "channel_41"), "channel_41", 0.1), "channel_41")


@query("w15_dilated", s(", w AS (SELECT DISTINCT t.rn + o.o - 5 AS rn, series_id FROM t, range(0, 11) o(o) WHERE is_anomaly = 1 AND channel_41 > 60), w2 AS (SELECT * FROM w WHERE rn BETWEEN 0 AND (SELECT max(rn) FROM t)), r AS (SELECT series_id, rn, rn - row_number() OVER (PARTITION BY series_id ORDER BY rn) AS g FROM w2) SELECT series_id, min(rn) AS start_rn, max(rn) AS end_rn FROM r GROUP BY series_id, g"))
def _(spark, d):
    df = single(spark, d).withColumn("hit", ((F.col("is_anomaly") == 1) & (F.col("channel_41") > 60)).cast("int"))
    return E.dilate(df, "hit", 5)


def _observed(spark, d):
    """Smoothed errors of each row beside the value that was observed there."""
    actual, forecast = _forecast(single(spark, d))
    return residual.residuals(actual, forecast, chunk=CHUNK).withColumn("rn", F.col("rn") - 1).join(actual.withColumnRenamed("y", "value"), ["series_id", "rn"])


@query("w16_w18_d14_dynamic_thresholds")
def _(spark, d):
    return residual.dynamic_thresholds(_observed(spark, d))


@query("d14_channel_flags")
def _(spark, d):
    errors = _observed(spark, d)
    return rounded(residual.channel_flags(errors, residual.dynamic_thresholds(errors)).select("rn", "error", "flag"), "error", digits=5)


def _supplied(spark, d) -> tuple[DataFrame, DataFrame]:
    """Values of all channels, and for each step and horizon 0 and 1 the value before the step as its forecast."""
    actual = S.long_form(single(spark, d).select("rn", *CHANNELS), CHANNELS, ["rn"], value="y").select("channel", "rn", "y")
    last = actual.select("channel", (F.col("rn") + 1).alias("step"), F.col("y").alias("y_hat"))
    steps = single(spark, d).agg(F.max("rn").alias("_last"))
    forecasts = last.withColumn("horizon", F.explode(F.array(F.lit(0), F.lit(1))))
    return actual, S.with_row(forecasts, steps).filter("step + horizon <= _last").drop("_last")


# the whole job: all channels, forecasts of two horizons combined
@query("d14_all_channels")
def _(spark, d):
    flags, _ = residual.forecast_job(*_supplied(spark, d), "exp", CHUNK)
    return rounded(flags, "error", digits=5)


# and its one stream over all channels
@query("d14_any_channel")
def _(spark, d):
    return residual.forecast_job(*_supplied(spark, d), "exp", CHUNK)[1]


@query("w19_ewma")
def _(spark, d):
    return rounded(R.ewma(single(spark, d).select("series_id", "rn", "channel_41"), "channel_41", 105, CHUNK), "smooth")


@query("w20_window_samples", m(", q AS (SELECT series_id, rn, channel_41, count(*) OVER (PARTITION BY series_id) AS n, sum(channel_41) OVER a AS si, sum(channel_41) OVER b AS so FROM t WINDOW a AS (PARTITION BY series_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING), b AS (PARTITION BY series_id ORDER BY rn ROWS BETWEEN 25 FOLLOWING AND 29 FOLLOWING)) SELECT series_id, rn AS start, round(si, 5) AS inputs, round(so, 5) AS targets FROM q WHERE n > 30 AND rn < n - 30"))
def _(spark, d):
    out = R.window_samples(multi(spark, d), ["channel_41"], 25, 5)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x["channel_41"])
    return out.select("series_id", "start", F.round(total("inputs"), 5).alias("inputs"), F.round(total("targets"), 5).alias("targets"))


HORIZONS = ", hz AS (SELECT channel, rn AS step, h AS horizon, value + h AS y_hat FROM v, range(0, 3) r(h) WHERE channel IN ('channel_41', 'channel_42'))"


ALL6 = "(" + " + ".join(CHANNELS) + ")"


# 250 rows in, 10 rows out, all channels, one long series
@query("w20_window_samples_whole", s(f", q AS (SELECT series_id, rn AS start, count(*) OVER () AS n, sum({ALL6}) OVER a AS inputs, sum({ALL6}) OVER b AS targets, channel_41 AS first_input, last_value(channel_46) OVER a AS last_input, first_value(channel_41) OVER b AS first_target, last_value(channel_45) OVER b AS last_target FROM t WINDOW a AS (PARTITION BY series_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND 249 FOLLOWING), b AS (PARTITION BY series_id ORDER BY rn ROWS BETWEEN 250 FOLLOWING AND 259 FOLLOWING)) SELECT series_id, start, round(inputs, 4) AS inputs, round(targets, 4) AS targets, round(first_input, 6) AS first_input, round(last_input, 6) AS last_input, round(first_target, 6) AS first_target, round(last_target, 6) AS last_target, CAST(1500 AS BIGINT) AS n_inputs, CAST(60 AS BIGINT) AS n_targets FROM q WHERE start < n - 260"))
def _(spark, d):
    out = W.sample_windows(single(spark, d), CHANNELS, 250, 10, chunk=CHUNK)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x), 4).alias(c)
    at = lambda c, i: F.round(F.element_at(c, i), 6)
    return out.select("series_id", "start", total("inputs"), total("targets"), at("inputs", 1).alias("first_input"), at("inputs", -1).alias("last_input"), at("targets", 1).alias("first_target"), at("targets", -2).alias("last_target"), F.size("inputs").cast("long").alias("n_inputs"), F.size("targets").cast("long").alias("n_targets"))


@query("w21_horizons", s(LONG + HORIZONS + " SELECT channel, step + horizon AS target, round(sum(exp(-horizon) * y_hat) / sum(exp(-horizon)), 6) AS y_hat FROM hz GROUP BY 1, 2"))
def _(spark, d):
    rows = S.long_form(single(spark, d).select("rn", "channel_41", "channel_42"), ["channel_41", "channel_42"], ["rn"])
    rows = rows.select("channel", F.col("rn").alias("step"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("horizon"), "value").withColumn("y_hat", F.col("value") + F.col("horizon"))
    return rounded(R.combine_horizons(rows, "exp"), "y_hat")


ERROR_STREAM = f", q AS (SELECT t.*, avg(greatest({", ".join(CHANNELS)})) OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS a FROM t), es AS (SELECT q.*, (a - (SELECT min(a) FROM q)) / ((SELECT max(a) FROM q) - (SELECT min(a) FROM q) + 1e-12) AS score FROM q)"


@query("w22_error_stream", s(ERROR_STREAM + " SELECT rn, round(score, 6) AS score FROM es"))
def _(spark, d):
    return rounded(detectors.error_stream(single(spark, d), CHANNELS, 51, CHUNK).select("rn", "score"), "score")


@query("w23_cdf", s(" SELECT channel_42, CAST(count(*) AS BIGINT) AS n, round(max(c), 6) AS share FROM (SELECT channel_42, cume_dist() OVER (ORDER BY channel_42) AS c FROM t) GROUP BY channel_42"))
def _(spark, d):
    values = single(spark, d).groupBy("channel_42").agg(F.count("*").alias("n"))
    placed = S.with_row(P.before(values, "channel_42", ["n"]), values.agg(F.sum("n").alias("total")))
    return placed.select("channel_42", "n", F.round((F.col("n_before") + F.col("n")) / F.col("total"), 6).alias("share"))


# --- top rows and sets


@query("t1_top_rows", s(SCORES + " SELECT rank, rn, round(a, 6) AS a, channel_42 FROM (SELECT *, row_number() OVER (ORDER BY a DESC, rn) AS rank FROM sc) WHERE rank <= 10"))
def _(spark, d):
    top = scored(single(spark, d)).orderBy(F.col("a").desc(), "rn").limit(10)
    return rounded(top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("a").desc(), "rn"))).select("rank", "rn", "a", "channel_42"), "a")


@query("t2_first_events", s(TRUE + " SELECT * FROM e ORDER BY start_rn LIMIT 5"))
def _(spark, d):
    return E.extract(single(spark, d), "is_anomaly").orderBy("start_rn").limit(5)


@query("u1_union", s(" SELECT rn FROM t WHERE is_anomaly = 1 UNION SELECT rn FROM t WHERE channel_41 > 60"))
def _(spark, d):
    df = single(spark, d)
    return df.filter("is_anomaly = 1").select("rn").unionByName(df.filter("channel_41 > 60").select("rn")).distinct()


@query("u2_intersection", s(" SELECT rn FROM t WHERE is_anomaly = 1 INTERSECT SELECT rn FROM t WHERE channel_41 > 60"))
def _(spark, d):
    df = single(spark, d)
    return df.filter("is_anomaly = 1").select("rn").intersect(df.filter("channel_41 > 60").select("rn"))


@query("u3_difference", s(" SELECT rn FROM t EXCEPT SELECT rn FROM t WHERE channel_41 > 60"))
def _(spark, d):
    df = single(spark, d)
    return df.select("rn").join(df.filter("channel_41 > 60").select("rn"), "rn", "left_anti")


@query("u4_fragments", m(" SELECT round(avg(channel_41), 6) AS mean, round(stddev_pop(channel_41), 6) AS std FROM t"))
def _(spark, d):
    df = multi(spark, d)
    # fragments of one table by parity of the series, put together again
    both = df.filter("series_id % 2 = 0").unionByName(df.filter("series_id % 2 <> 0"))
    return rounded(both.agg(F.avg("channel_41").alias("mean"), F.stddev_pop("channel_41").alias("std")), "mean", "std")


# --- row-wise functions


@query("x1_x7_algebra", s(", f AS (SELECT avg(channel_41) AS m, stddev_pop(channel_41) AS s, quantile_cont(channel_41, 0.05) AS p5, quantile_cont(channel_41, 0.95) AS p95, min(channel_41) AS lo, max(channel_41) AS hi FROM t) SELECT rn, abs(channel_41 - m) > 1.5 * s AS outside, round(abs((channel_41 - m) / s), 6) AS z, round(1 - exp(-abs((channel_41 - m) / s) / 2), 6) AS score, round(least(greatest((channel_41 - p5) / (p95 - p5), 0), 1), 6) AS scaled, round((channel_41 - lo) / (hi - lo + 1e-10), 6) AS unit FROM t, f"))
def _(spark, d):
    df = single(spark, d)
    x = F.col("channel_41")
    f = df.agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    f = S.with_row(f, S.percentiles(df, "channel_41", [0.05, 0.95]))
    rows, c = S.with_row(df, f), F.col
    z = X.abs_z(x, c("m"), c("s"))
    out = rows.select("rn", X.outside(x, c("m"), c("s"), 1.5).alias("outside"), z.alias("z"), X.z_to_score(z, 2.0).alias("score"), X.percentile_scale(x, c("p5"), c("p95")).alias("scaled"), X.min_max(x, c("lo"), c("hi")).alias("unit"))
    return rounded(out, "z", "score", "scaled", "unit")


@query("x5_x6_across_channels", s(" SELECT rn, round(quantile_cont(x, 0.95), 6) AS p95, round(quantile_cont(x, 0.9), 6) AS p90, round(max(x), 6) AS top, round(avg(x), 6) AS mean FROM (SELECT rn, unnest([channel_41, channel_42, channel_43, channel_44, channel_45, channel_46]) AS x FROM t) GROUP BY rn"))
def _(spark, d):
    cs = [F.col(c) for c in CHANNELS]
    out = single(spark, d).select("rn", X.row_percentile(cs, 0.95).alias("p95"), X.row_percentile(cs, 0.9).alias("p90"), F.greatest(*cs).alias("top"), X.row_mean(cs).alias("mean"))
    return rounded(out, "p95", "p90", "top", "mean")


@query("x8_blend", s(SCORES + " SELECT rn, round(least(greatest(0.6 * (0.2 * a + 0.45 * b + 0.35 * c) + 0.4 * greatest(a, b, c) + CASE WHEN CAST(a >= 0.35 AS INTEGER) + CAST(b >= 0.3 AS INTEGER) + CAST(c >= 0.4 AS INTEGER) >= 2 THEN 0.15 ELSE 0 END, 0), 1), 6) AS score FROM sc"))
def _(spark, d):
    out = detectors.ensemble_score(scored(single(spark, d)), {"a": 0.2, "b": 0.45, "c": 0.35}, {"a": 0.35, "b": 0.3, "c": 0.4})
    return rounded(out.select("rn", "score"), "score")


@query("x9_combined", s(SCORES + " SELECT rn, round(0.7 * a + 0.3 * b, 6) AS weighted, round((a + b) / 2, 6) AS average, round(abs(a - b), 6) AS apart FROM sc"))
def _(spark, d):
    df = scored(single(spark, d))
    return rounded(df.select("rn", (0.7 * F.col("a") + 0.3 * F.col("b")).alias("weighted"), ((F.col("a") + F.col("b")) / 2).alias("average"), F.abs(F.col("a") - F.col("b")).alias("apart")), "weighted", "average", "apart")


@query("x10_f_beta", m(", q AS (SELECT series_id, avg(is_anomaly) AS p, avg(channel_46) AS r FROM t GROUP BY series_id) SELECT series_id, round(CASE WHEN 0.25 * p + r = 0 THEN 0 ELSE 1.25 * p * r / (0.25 * p + r) END, 6) AS f FROM q"))
def _(spark, d):
    q = multi(spark, d).groupBy("series_id").agg(F.avg("is_anomaly").alias("p"), F.avg("channel_46").alias("r"))
    return q.select("series_id", F.round(X.f_beta(F.col("p"), F.col("r")), 6).alias("f"))


@query("x11_standardized", m(", f AS (SELECT avg(channel_43) AS m, stddev_pop(channel_43) AS s FROM t) SELECT series_id, rn, round((channel_43 - m) / s, 5) AS x, round((channel_43 - m) / s * s + m, 5) AS back FROM t, f"))
def _(spark, d):
    df = multi(spark, d)
    rows = S.with_row(df, S.stats_row(df, ["channel_43"]))
    x = (F.col("channel_43") - F.col("channel_43_mean")) / F.col("channel_43_std")
    return rounded(rows.select("series_id", "rn", x.alias("x"), (x * F.col("channel_43_std") + F.col("channel_43_mean")).alias("back")), "x", "back", digits=5)


LIMITS = ", q AS (SELECT quantile_cont(a, 0.4) AS a40, quantile_cont(a, 0.6) AS a60, quantile_cont(a, 0.98) AS a98, quantile_cont(a, 0.99) AS a99, quantile_cont(b, 0.4) AS b40, quantile_cont(b, 0.6) AS b60, quantile_cont(b, 0.98) AS b98, quantile_cont(b, 0.99) AS b99 FROM sc)"


@query("x13_pseudo_flexible", s(SCORES + LIMITS + " SELECT CASE WHEN a < a60 AND b < b60 THEN 0 WHEN a > a98 OR b > b98 THEN 1 ELSE -1 END AS pseudo, count(*) AS n FROM sc, q GROUP BY 1"))
def _(spark, d):
    return fusion.pseudo_labels(scored(single(spark, d)), "a", "b").groupBy("pseudo").agg(F.count("*").alias("n"))


@query("x14_pseudo_strict", s(SCORES + LIMITS + " SELECT CASE WHEN a <= a40 AND b <= b40 THEN 0 WHEN a >= a99 AND b >= b99 THEN 1 ELSE -1 END AS pseudo, count(*) AS n FROM sc, q GROUP BY 1"))
def _(spark, d):
    return fusion.pseudo_labels(scored(single(spark, d)), "a", "b", strict=True).groupBy("pseudo").agg(F.count("*").alias("n"))


@query("x15_dates", "SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 2 = 0 THEN '2024-02-03 04:05:06' ELSE o_orderpriority END AS TIMESTAMP) AS at FROM orders")
def _(spark, d):
    text = F.when(F.col("o_orderkey") % 2 == 0, "2024-02-03 04:05:06").otherwise(F.col("o_orderpriority"))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", text.try_cast("timestamp_ntz").alias("at"))


@query("x16_d16_catalogue", m(TRUE + NIGHT + FIRST_HIT + " , k AS (SELECT series_id, count(DISTINCT t) AS tp FROM h GROUP BY 1), c AS (SELECT series_id, count(*) AS n FROM e GROUP BY 1) SELECT c.series_id, coalesce(tp, 0) AS tp, n - coalesce(tp, 0) AS fn FROM c LEFT JOIN k USING (series_id)"))
def _(spark, d):
    df = multi(spark, d)
    truth = E.extract(df, "is_anomaly").groupBy("series_id").agg(F.to_json(F.sort_array(F.collect_list(F.array("start_rn", "end_rn")))).alias("anomaly_sequences"))
    pairs = truth.select("series_id", F.explode(X.parse_sequences(F.col("anomaly_sequences"))).alias("p")).select("series_id", F.col("p")[0].alias("start_rn"), F.col("p")[1].alias("end_rn"))
    first = E.overlaps(predicted(df), pairs).groupBy("series_id", "p_start").agg(F.min("t_start").alias("t"))
    hits = first.groupBy("series_id").agg(F.countDistinct("t").alias("tp"))
    return pairs.groupBy("series_id").agg(F.count("*").alias("n")).join(hits, "series_id", "left").select("series_id", F.coalesce("tp", F.lit(0)).alias("tp"), (F.col("n") - F.coalesce("tp", F.lit(0))).alias("fn"))


# --- jobs


@query("d1_global_std", s(FLAGGED.format(n=2.5) + ", r AS (SELECT series_id, rn, rn - row_number() OVER (ORDER BY rn) AS g FROM g WHERE pred = 1), p AS (SELECT series_id, min(rn) AS start_rn, max(rn) AS end_rn FROM r GROUP BY 1, r.g), r2 AS (SELECT series_id, rn, rn - row_number() OVER (ORDER BY rn) AS g FROM t WHERE is_anomaly = 1), e AS (SELECT series_id, min(rn) AS start_rn, max(rn) AS end_rn FROM r2 GROUP BY 1, r2.g)" + EVENTWISE.format(top="tp")))
def global_std_job(spark, d):
    flagged = _flagged(spark, d)
    return rounded(M.eventwise(E.extract(flagged, "pred"), E.extract(flagged, "is_anomaly")), "precision", "recall", "f05")


@query("d2_self_fitted", s(", f AS (SELECT avg(channel_41) AS m, stddev_pop(channel_41) AS s, avg(channel_45) AS m5, stddev_pop(channel_45) AS s5 FROM t) SELECT id, CASE WHEN abs(channel_41 - m) > 3 * s OR abs(channel_45 - m5) > 3 * s5 THEN 1 ELSE 0 END AS flag3, CASE WHEN abs(channel_41 - m) > 5 * s OR abs(channel_45 - m5) > 5 * s5 THEN 1 ELSE 0 END AS flag5 FROM t, f"))
def _(spark, d):
    df = single(spark, d)
    cs = ["channel_41", "channel_45"]
    out = detectors.global_std(detectors.global_std(df, df, cs, 3.0, "flag3"), df, cs, 5.0, "flag5")
    return out.select("id", "flag3", "flag5")


_z3 = ", ".join(f"{z_sql(100, channel=c)} AS z{c[-2:]}" for c in CHANNELS)
_f3 = ", ".join(f"CAST(z{c[-2:]} > 2.5 AS INTEGER) AS {c}_flag" for c in CHANNELS)


@query("d3_local_std", s(f", q AS (SELECT rn, {_z3} FROM t) SELECT rn, {_f3}, CAST({' OR '.join(f'z{c[-2:]} > 2.5' for c in CHANNELS)} AS INTEGER) AS flag FROM q"))
def _(spark, d):
    out = detectors.local_std(single(spark, d), CHANNELS, 100, 2.5, chunk=CHUNK)
    return out.select("rn", *[f"{c}_flag" for c in CHANNELS], "flag")


@query("d4_isolation_forest")
def _(spark, d):
    df = single(spark, d)
    out = forest.flag(forest.score(df, CHANNELS, forest.fit(df, CHANNELS)), 0.05)
    return rounded(out.select("id", "s_iforest", "flag"), "s_iforest")


@query("d5_forecast_detector", s(FORECAST + ", c AS (SELECT rn, error, CASE WHEN rn >= 10 THEN sum(error) OVER (ORDER BY rn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) ELSE 0 END AS c FROM fe), w AS (SELECT rn, 0.7 * error + 0.3 * c / (SELECT max(c) FROM c) AS x FROM c) SELECT rn, round((x - (SELECT min(x) FROM w)) / ((SELECT max(x) FROM w) - (SELECT min(x) FROM w)), 5) AS score FROM w"))
def _(spark, d):
    return rounded(detectors.forecast_scores(single(spark, d), CHANNELS, 50, CHUNK).select("rn", "score"), "score", digits=5)


def _components(spark, d):
    df = single(spark, d)
    return detectors.component_scores(df, df, CHANNELS, 100, chunk=CHUNK)


_zg = ", ".join(f"1 - exp(-abs({c} - avg({c}) OVER a) / greatest(stddev_pop({c}) OVER a, 0.000001) / 2.0)" for c in CHANNELS)
_zl = ", ".join(f"1 - exp(-coalesce({z_sql(100, channel=c, least=25)}, 0) / 1.8)" for c in CHANNELS)
COMPONENTS = f", q AS (SELECT rn, list_sort([{_zg}]) AS g, list_sort([{_zl}]) AS l FROM t WINDOW a AS ()), q2 AS (SELECT rn, 0.25 * g[5] + 0.75 * g[6] AS g, 0.5 * l[5] + 0.5 * l[6] AS l FROM q), li AS (SELECT quantile_cont(g, 0.05) AS g5, quantile_cont(g, 0.95) AS g95, quantile_cont(l, 0.05) AS l5, quantile_cont(l, 0.95) AS l95 FROM q2), cs AS (SELECT rn, least(greatest((g - g5) / (g95 - g5), 0), 1) AS s_global, least(greatest((l - l5) / (l95 - l5), 0), 1) AS s_local FROM q2, li)"


@query("d6_io5_component_scores", s(COMPONENTS + " SELECT rn, round(s_global, 4) AS s_global, round(s_local, 4) AS s_local FROM cs"))
def _(spark, d):
    return rounded(_components(spark, d).select("rn", "s_global", "s_local"), "s_global", "s_local", digits=4)


def _ensemble(spark, d):
    df = _components(spark, d)
    return detectors.ensemble_score(forest.score(df, CHANNELS, forest.fit(df, CHANNELS)), detectors.WEIGHTS, detectors.VOTES)


@query("d6_ensemble")
def _(spark, d):
    return rounded(_ensemble(spark, d).select("id", "score", "s_global", "s_local", "s_iforest"), "score", "s_global", "s_local", "s_iforest", digits=4)


# fitted on the first 85 %, written, read back, and applied to all rows
@query("d6_saved_ensemble")
def _(spark, d):
    df = single(spark, d)
    train, _ = P.chronological(df, P.cut_position(df.count(), 0.85, "share"))
    path = place(spark, "ensemble")
    saved.save_ensemble(saved.fit_ensemble(train, CHANNELS, chunk=CHUNK), path)
    out = saved.load_ensemble(spark, path).score(df, CHUNK)
    return rounded(out.select("id", "s_global", "s_local", "s_iforest", "score"), "s_global", "s_local", "s_iforest", "score")


@query("d7_ensemble_predict")
def _(spark, d):
    return detectors.predict(_ensemble(spark, d), 0.6).select("id", "is_anomaly")


GRID = M.grid()


def sweep_sql(source: str, score: str, op: str, shortest: int, gap: int) -> str:
    values = ", ".join(f"(CAST({t!r} AS DOUBLE))" for t in GRID)
    return f""", th(threshold) AS (VALUES {values}), fl AS (SELECT threshold, series_id, rn, rn - row_number() OVER (PARTITION BY threshold, series_id ORDER BY rn) AS g FROM {source}, th WHERE {score} {op} threshold),
ev AS (SELECT threshold, series_id, min(rn) AS start_rn, max(rn) AS end_rn FROM fl GROUP BY threshold, series_id, g HAVING max(rn) - min(rn) + 1 >= {shortest}),
e1 AS (SELECT *, CASE WHEN start_rn - lag(end_rn) OVER (PARTITION BY threshold, series_id ORDER BY start_rn) - 1 <= {gap} THEN 0 ELSE 1 END AS nw FROM ev),
e2 AS (SELECT *, sum(nw) OVER (PARTITION BY threshold, series_id ORDER BY start_rn) AS k FROM e1),
pe AS (SELECT threshold, series_id, min(start_rn) AS start_rn, max(end_rn) AS end_rn FROM e2 GROUP BY threshold, series_id, k),
ct AS (SELECT th.threshold, count(pe.start_rn) AS n_pred, count(*) FILTER (EXISTS (SELECT 1 FROM e WHERE e.series_id = pe.series_id AND pe.start_rn <= e.end_rn AND pe.end_rn >= e.start_rn)) AS tp FROM th LEFT JOIN pe ON pe.threshold = th.threshold GROUP BY th.threshold),
me AS (SELECT threshold, n_pred, (SELECT count(*) FROM e) AS n_true, tp, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS p, tp / (SELECT count(*) FROM e) AS r FROM ct)
SELECT round(threshold, 6) AS threshold, n_pred, n_true, tp, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN 0.25 * p + r = 0 THEN 0 ELSE 1.25 * p * r / (0.25 * p + r) END, 6) AS f05 FROM me"""


@query("d8_calibration", m(TRUE + SCORES + sweep_sql("sc", "a", ">=", 2, 3)))
def _(spark, d):
    df = multi(spark, d)
    return rounded(M.calibrate(scored(df), "a", E.extract(df, "is_anomaly"), GRID, 2, 3), "threshold", "precision", "recall", "f05")


@query("d8_t3_best_threshold", "SELECT CASE WHEN f05 > 0 THEN threshold ELSE 0.5 END AS threshold, f05 AS metric FROM (" + m(TRUE + SCORES + sweep_sql("sc", "a", ">=", 2, 3)) + ") ORDER BY f05 DESC, threshold LIMIT 1")
def _(spark, d):
    df = multi(spark, d)
    return rounded(M.best_threshold(M.calibrate(scored(df), "a", E.extract(df, "is_anomaly"), M.grid(), 2, 3)), "threshold", "metric")


@query("d9_error_adapter", s(TRUE + ERROR_STREAM + sweep_sql("es", "score", ">", 3, 2)))
def _(spark, d):
    df = single(spark, d)
    stream = detectors.error_stream(df, CHANNELS, 51, CHUNK)
    return rounded(M.calibrate(stream, "score", E.extract(df, "is_anomaly"), GRID, 3, 2, strict=True), "threshold", "precision", "recall", "f05")


def pair_sql(a: str, b: str) -> str:
    spread = f"stddev_pop({a}) OVER w30 * stddev_pop({b}) OVER w30"
    return f"CASE WHEN count(*) OVER w30 >= 10 AND {spread} > 1e-12 THEN covar_pop({a}, {b}) OVER w30 / ({spread}) ELSE 0 END"


FEATURE_SQL = {"iforest_score": "a", "forecast_score": "b", "detector_agreement": "abs(a - b)"}
FEATURE_SQL |= {f"rolling_mean_dev_{w}": mean6(f"abs({{c}} - avg({{c}}) OVER w{w})") for w in (10, 30, 50)} | {f"rolling_std_{w}": mean6(f"stddev_samp({{c}}) OVER w{w}") for w in (10, 30, 50)}
FEATURE_SQL |= {f"delta_{k}": f"coalesce({mean6(f'abs({{c}} - lag({{c}}, {k}) OVER w)')}, 0)" for k in (1, 5, 10)}
FEATURE_SQL |= {"slope_magnitude": f"CASE WHEN count(*) OVER back < 10 THEN 0 ELSE {mean6('abs(regr_slope({c}, CAST(rn AS DOUBLE)) OVER back)')} END"}
FEATURE_SQL |= {f"corr_ch{i}_ch{i + 1}": pair_sql(CHANNELS[i], CHANNELS[i + 1]) for i in range(3)}
FEATURE_FRAMES = " WINDOW w AS (PARTITION BY series_id ORDER BY rn), back AS (PARTITION BY series_id ORDER BY rn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)" + "".join(f", w{n} AS (PARTITION BY series_id ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (10, 30, 50))


@query("d10_features", s(SCORES + " SELECT id, " + ", ".join(f"round({x}, 4) AS {n}" for n, x in FEATURE_SQL.items()) + " FROM sc" + FEATURE_FRAMES))
def _(spark, d):
    return rounded(fusion.features(scored(single(spark, d)), CHANNELS, "a", "b", chunk=CHUNK).select("id", *fusion.FEATURES), *fusion.FEATURES, digits=4)


@query("d11_fusion")
def _(spark, d):
    rows = fusion.pseudo_labels(scored(single(spark, d)), "a", "b")
    table = written(fusion.features(rows, CHANNELS, "a", "b", chunk=CHUNK).select("id", "pseudo", *fusion.FEATURES))
    return fusion.boosted(table, table, fusion.FEATURES, "pseudo")[0].select("id", F.round("fused", 4).alias("fused"), "flag")


@query("d12_supervised")
def _(spark, d):
    table = written(R.over_frames(scored(single(spark, d)), 51, 0, lambda f: R.score_features(f, "a"), CHUNK))
    train, _ = P.chronological(table, P.cut_position(table.count(), 0.85, "share"))
    return fusion.boosted(train, table, ["a", "score_mean", "score_std", "score_diff"], "is_anomaly", trees=300, depth=4, rate=0.05)[0].select("id", F.round("fused", 4).alias("fused"), "flag")


# threshold of the best event F0.5 on the last 15 % of the time, events of all rows by it
@query("d12_calibrated")
def _(spark, d):
    out, _ = fusion.supervised(scored(single(spark, d)), "a", chunk=CHUNK)
    return out.select("id", F.round("fused", 4).alias("fused"), "is_flagged")


@query("d13_evaluator")
def _(spark, d):
    df = scored(single(spark, d))
    _, held = P.chronological(df, P.cut_position(df.count(), 0.15))
    held = held.withColumn("score", F.col("a"))
    best = detectors.calibrated(held, steps=200, shortest=7, gap=0, strict=True)
    flagged = S.with_row(held, best).withColumn("hit", (F.col("a") > F.col("threshold")).cast("int"))
    return rounded(M.strict_eventwise(E.prune_then_merge(flagged, "hit", 7, 0), E.extract(held, "is_anomaly")), "precision", "recall", "f_beta")


# the table of models: two detectors and the error stream, each at its own best threshold on the last 15 % of the time
@query("d13_models")
def _(spark, d):
    df = written(detectors.error_stream(scored(single(spark, d)), CHANNELS, 51, CHUNK).withColumnRenamed("score", "error"))
    _, held = P.chronological(df, P.cut_position(df.count(), 0.15))
    return rounded(detectors.compare_models(held, ["a", "b", "error"]), "threshold", "precision", "recall", "f_beta")


@query("d8_strict_sweep")
def _(spark, d):
    df = multi(spark, d)
    steps = [0.02 + i * 0.18 / 199 for i in range(200)]
    return rounded(M.strict_sweep(scored(df), "a", E.extract(df, "is_anomaly"), steps, 2, 3), "threshold", "precision", "recall", "f_beta")


@query("d15_training_set", s(FRAGMENTS + ", q AS (SELECT g, rn - min(rn) OVER (PARTITION BY g) AS k, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (ORDER BY rn) - 1 AS idx, count(*) OVER () AS total FROM fr) SELECT CASE WHEN idx < round(0.8 * total) THEN 'train' ELSE 'validation' END AS part, count(*) AS samples FROM q WHERE n > 12 AND k < n - 12 GROUP BY 1"))
def _(spark, d):
    nominal = P.dense_index(P.nominal(single(spark, d)).select(F.col("rn").alias("pos"), "channel_41"), "pos")
    total = nominal.count()
    rows = nominal.withColumn("series_id", F.col("pos") - F.col("rn")).withColumn("idx", F.col("rn"))
    begin = Window.partitionBy("series_id")
    rows = rows.withColumn("rn", F.col("pos") - F.min("pos").over(begin))
    samples = R.window_samples(rows, ["channel_41"], 10, 2).select("series_id", F.col("start").alias("rn"))
    part = F.when(F.col("idx") < round(0.8 * total), "train").otherwise("validation")
    return samples.join(rows.select("series_id", "rn", "idx"), ["series_id", "rn"]).groupBy(part.alias("part")).agg(F.count("*").alias("samples"))


# a label of long fragments: errors of very high values
RARE = "CASE WHEN is_anomaly = 1 AND channel_41 > 250 THEN 1 ELSE 0 END"
WHOLE_SET = (
    f", fr AS (SELECT *, rn - row_number() OVER (ORDER BY rn) AS g, row_number() OVER (ORDER BY rn) - 1 AS idx, count(*) OVER () AS total FROM t WHERE {RARE} = 0), st AS (SELECT "
    + ", ".join(f"CASE WHEN count(DISTINCT {c}) = 2 AND sum(abs(trunc({c}) - {c})) = 0 THEN min({c}) ELSE avg({c}) END AS m_{c}, CASE WHEN count(DISTINCT {c}) = 2 AND sum(abs(trunc({c}) - {c})) = 0 THEN max({c}) - min({c}) ELSE stddev_pop({c}) END AS s_{c}" for c in CHANNELS)
    + " FROM fr), p AS (SELECT g, idx, CASE WHEN idx < round(0.8 * total) THEN 'train' ELSE 'validation' END AS part, "
    + " + ".join(f"({c} - m_{c}) / s_{c}" for c in CHANNELS)
    + " AS x FROM fr, st), q AS (SELECT part, g, row_number() OVER (PARTITION BY g, part ORDER BY idx) - 1 AS k, count(*) OVER (PARTITION BY g, part) AS n, sum(x) OVER a AS i, sum(x) OVER b AS o FROM p WINDOW a AS (PARTITION BY g, part ORDER BY idx ROWS BETWEEN CURRENT ROW AND 249 FOLLOWING), b AS (PARTITION BY g, part ORDER BY idx ROWS BETWEEN 250 FOLLOWING AND 259 FOLLOWING))"
    + " SELECT part, count(DISTINCT g) AS fragments, count(*) AS samples, round(avg(i), 4) AS inputs, round(avg(o), 4) AS targets FROM q WHERE k < n - 260 GROUP BY part"
)


@query("d15_training_set_whole", s(WHOLE_SET))
def _(spark, d):
    df = single(spark, d).withColumn("rare", F.expr(RARE))
    out = W.training_set(df, CHANNELS, "rare", chunk=CHUNK)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)
    return rounded(out.groupBy("part").agg(F.countDistinct("fragment").alias("fragments"), F.count("*").alias("samples"), F.avg(total("inputs")).alias("inputs"), F.avg(total("targets")).alias("targets")), "inputs", "targets", digits=4)


@query("d17_comparison", s(SCORES + " SELECT round(corr(a, b), 6) AS pearson, count(*) FILTER ((a > 0.7) = (b > 0.7)) AS agree, round(100.0 * count(*) FILTER ((a > 0.7) = (b > 0.7)) / count(*), 4) AS percent, round(avg(a), 6) AS mean_a, round(median(b), 6) AS median_b FROM sc"))
def _(spark, d):
    same = F.count_if((F.col("a") > 0.7) == (F.col("b") > 0.7))
    out = scored(single(spark, d)).agg(F.corr("a", "b").alias("pearson"), same.alias("agree"), F.round(100.0 * same / F.count("*"), 4).alias("percent"), F.avg("a").alias("mean_a"))
    out = S.with_row(out, S.exact_percentiles(scored(single(spark, d)), {"median_b": ("b", 0.5)}))
    return rounded(out, "pearson", "mean_a", "median_b")


# --- statistical tests


@query("h1_moments", s(LONG + ", q AS (SELECT channel, value - avg(value) OVER (PARTITION BY channel) AS d FROM v) SELECT channel, count(*) AS n, round(avg(d * d * d) / pow(avg(d * d), 1.5), 5) AS skew, round(avg(d * d * d * d) / pow(avg(d * d), 2) - 3, 5) AS kurtosis FROM q GROUP BY channel"))
def _(spark, d):
    return rounded(hypothesis.moments(single(spark, d), CHANNELS), "skew", "kurtosis", digits=5)


NORMALITY = """, q AS (SELECT channel, value - avg(value) OVER (PARTITION BY channel) AS d FROM v),
mo AS (SELECT channel, count(*) AS n, CAST(count(*) AS DOUBLE) AS c, avg(d * d * d) / pow(avg(d * d), 1.5) AS g1, avg(d * d * d * d) / pow(avg(d * d), 2) AS g2 FROM q GROUP BY channel),
sk AS (SELECT *, g1 * sqrt((c + 1) * (c + 3) / (6 * (c - 2))) AS y, sqrt(2 * (3 * (c * c + 27 * c - 70) * (c + 1) * (c + 3) / ((c - 2) * (c + 5) * (c + 7) * (c + 9)) - 1)) - 1 AS w2 FROM mo),
zs AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(w2) / 2) AS z1 FROM sk),
ku AS (SELECT *, (g2 - 3 * (c - 1) / (c + 1)) / sqrt(24 * c * (c - 2) * (c - 3) / ((c + 1) * (c + 1) * (c + 3) * (c + 5))) AS x, 6 * (c * c - 5 * c + 2) / ((c + 7) * (c + 9)) * sqrt(6 * (c + 3) * (c + 5) / (c * (c - 2) * (c - 3))) AS root FROM zs),
ka AS (SELECT *, 6 + 8 / root * (2 / root + sqrt(1 + 4 / (root * root))) AS a FROM ku),
ki AS (SELECT *, (1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))) AS inner_part FROM ka),
k2 AS (SELECT channel, n, z1 * z1 + pow((1 - 2 / (9 * a) - sign(inner_part) * pow(abs(inner_part), 1 / 3.0)) / sqrt(2 / (9 * a)), 2) AS k2 FROM ki)
SELECT channel, n, round(k2, 4) AS k2, round(exp(-k2 / 2), 4) AS p FROM k2"""


@query("h1_normality", s(LONG + NORMALITY))
def _(spark, d):
    return rounded(hypothesis.normality(single(spark, d), CHANNELS), "k2", "p", digits=4)


@query("h2_levene", s(LONG + ", md AS (SELECT channel, quantile_cont(value, 0.5) AS md FROM v GROUP BY channel), z AS (SELECT channel, abs(value - md) AS z FROM v JOIN md USING (channel)), gs AS (SELECT channel, count(*) AS n, avg(z) AS a, var_pop(z) AS s FROM z GROUP BY channel), al AS (SELECT sum(n) AS n, sum(n * a) / sum(n) AS g, count(*) AS k, sum(n * s) AS w FROM gs) SELECT round(any_value((al.n - al.k) / (al.k - 1.0)) * sum(gs.n * (gs.a - al.g) * (gs.a - al.g)) / any_value(al.w), 3) AS statistic, CAST(any_value(al.k) - 1 AS BIGINT) AS d1, CAST(any_value(al.n - al.k) AS BIGINT) AS d2 FROM gs, al"))
def _(spark, d):
    return rounded(hypothesis.levene(single(spark, d), CHANNELS), "statistic", digits=3)


@query("h3_correlations", s(SCORES + ", k AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM sc) SELECT round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM k"))
def _(spark, d):
    return rounded(hypothesis.correlations(scored(single(spark, d)), "a", "b"), "pearson", "spearman")


@query("h4_paired_t", s(SCORES + " SELECT count(*) AS n, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 4) AS t FROM sc"))
def _(spark, d):
    return rounded(hypothesis.paired_t(scored(single(spark, d)), "a", "b"), "t", digits=4)


def _sides(spark, d):
    df = single(spark, d)
    rows = S.long_form(df.select("rn", *CHANNELS), CHANNELS, ["rn"])
    return rows.withColumn("side", (F.col("rn") >= P.cut_position(df.count(), 0.15)).cast("int"))


SIDES = ", sd AS (SELECT channel, value, CASE WHEN rn >= (SELECT CAST(floor(count(*) * 0.85) AS BIGINT) FROM t) THEN 1 ELSE 0 END AS side FROM v)"


@query("h5_ks", s(LONG + SIDES + ", c AS (SELECT channel, value, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM sd GROUP BY 1, 2), k AS (SELECT channel, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY channel) AS n, sum(b) OVER (PARTITION BY channel) AS m FROM c WINDOW w AS (PARTITION BY channel ORDER BY value)) SELECT channel, round(max(abs(ca / n - cb / m)), 6) AS d, CAST(any_value(n) AS BIGINT) AS n, CAST(any_value(m) AS BIGINT) AS m FROM k GROUP BY channel"))
def _(spark, d):
    return rounded(hypothesis.ks_two_sample(_sides(spark, d), ["channel"]), "d")


@query("h6_mann_whitney", s(LONG + SIDES + ", k AS (SELECT channel, side, rank() OVER (PARTITION BY channel ORDER BY value) + (count(*) OVER (PARTITION BY channel, value) - 1) / 2.0 AS r FROM sd) SELECT channel, sum(r) FILTER (side = 0) - count(*) FILTER (side = 0) * (count(*) FILTER (side = 0) + 1) / 2.0 AS u FROM k GROUP BY channel"))
def _(spark, d):
    return hypothesis.mann_whitney(_sides(spark, d), ["channel"]).select("channel", "u")


# all tests with their p-values, one table: test, channel (or pair), statistic, p
@query("h_p_values")
def _(spark, d):
    df, sides = single(spark, d), written(_sides(spark, d))
    pairs = scored(df)
    told = lambda rows, test, name, statistic: rows.select(F.lit(test).alias("test"), name.alias("name"), F.round(F.col(statistic).cast("double"), 6).alias("statistic"), F.round("p", 6).alias("p"))
    ab, H = F.lit("a, b"), hypothesis
    both = pairs.select("a", "b").filter("a is not null and b is not null").agg(F.count("*").alias("n"))
    r = S.with_row(H.correlations(pairs, "a", "b"), both)
    parts = [
        told(H.normality(df, CHANNELS), "normality", F.col("channel"), "k2"),
        told(H.with_p(H.levene(df, CHANNELS), H.f_tail, "statistic", "d1", "d2"), "levene", F.lit("all"), "statistic"),
        told(H.with_p(r, H.correlation_tail, "pearson", "n"), "pearson", ab, "pearson"),
        told(H.with_p(r, H.correlation_tail, "spearman", "n"), "spearman", ab, "spearman"),
        told(H.with_p(H.paired_t(pairs, "a", "b"), H.paired_tail, "t", "n"), "paired t", ab, "t"),
        told(H.with_p(H.ks_two_sample(sides, ["channel"]), H.ks_tail, "d", "n", "m"), "ks", F.col("channel"), "d"),
        told(H.with_p(H.mann_whitney(sides, ["channel"]), H.normal_tail, "z"), "mann whitney", F.col("channel"), "u"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("h7_budget",s(" SELECT count(*) AS n, CAST(sum(is_anomaly) AS BIGINT) AS k, true AS above FROM t"))
def _(spark, d):
    one = single(spark, d).agg(F.count("*").alias("n"), F.sum("is_anomaly").alias("k"))
    got = one.first()
    return one.withColumn("above", F.lit(hypothesis.binomial_tail(got["k"], got["n"], 0.01) < 0.05))


# --- streams, run once over all that is there


def _stream(spark, d) -> DataFrame:
    rows = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*")
    k = F.get_json_object("props", "$.k").cast("double")
    return rows.select(F.col("user_id").alias("series_id"), F.col("event_id").alias("rn"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("channel_41"), k.alias("channel_42"), (F.col("event_type") == "error").cast("int").alias("flag"))


def _name() -> str:
    return f"live_{uuid.uuid4().hex}"


@query("r1_scored_stream", s(", f AS (SELECT avg(channel_41) AS m, stddev_pop(channel_41) AS s FROM t WHERE is_anomaly = 0) SELECT id AS rn, CASE WHEN abs(channel_41 - m) > 2 * s THEN 1 ELSE 0 END AS flag FROM t, f"))
def _(spark, d):
    stats = S.stats_row(P.nominal(single(spark, d)), ["channel_41"])
    return live.run_once(live.score_stream(_stream(spark, d).drop("flag"), stats, ["channel_41"], 2.0), _name()).select("rn", "flag")


@query("r2_flag_rate", "SELECT user_id AS series_id, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS begin, count(*) AS n, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS flags FROM events GROUP BY 1, 2")
def _(spark, d):
    out = live.run_once(live.flag_rate(_stream(spark, d), "1 day", late="3650 days"), _name(), "complete")
    return out.withColumn("begin", F.col("begin").cast("timestamp_ntz"))


@query("r3_sessions", """WITH f AS (SELECT user_id AS series_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS nw FROM events WHERE event_type = 'error'),
g AS (SELECT *, sum(nw) OVER (PARTITION BY series_id ORDER BY ts) AS k FROM f) SELECT series_id, min(ts) AS begin, max(ts) + INTERVAL 6 HOUR AS finish, count(*) AS n FROM g GROUP BY series_id, k HAVING count(*) >= 1""")
def _(spark, d):
    out = live.run_once(live.sessions(_stream(spark, d), "6 hours", late="3650 days"), _name(), "complete")
    return out.withColumn("begin", F.col("begin").cast("timestamp_ntz")).withColumn("finish", F.col("finish").cast("timestamp_ntz"))


ARRIVALS, LATEST = 8, 7
LATE_SQL = f"""WITH a AS (SELECT user_id AS series_id, ts, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS flag, date_trunc('day', ts) AS begin,
 least({LATEST}, event_id * {ARRIVALS} // (SELECT count(*) FROM events) + CASE WHEN event_id % 7 = 3 THEN 2 WHEN event_id % 11 = 5 THEN 1 ELSE 0 END) AS batch FROM events),
h AS (SELECT batch, max(ts) AS top FROM a GROUP BY batch),
k AS (SELECT a.*, (SELECT max(top) FROM h WHERE h.batch <= a.batch - 2) - INTERVAL 1 DAY AS refused FROM a),
w AS (SELECT series_id, begin, count(*) AS n, CAST(sum(flag) AS BIGINT) AS flags FROM k WHERE refused IS NULL OR begin + INTERVAL 1 DAY > refused GROUP BY 1, 2)
SELECT * FROM w"""


def _arriving(spark, d) -> DataFrame:
    """The event log as a stream of eight micro-batches, some rows one or two of them late."""
    events = spark.read.parquet(f"{d}/events.parquet")
    wait = F.when(F.col("event_id") % 7 == 3, 2).when(F.col("event_id") % 11 == 5, 1).otherwise(0)
    batch = F.least(F.lit(LATEST), F.floor(F.col("event_id") * ARRIVALS / events.count()) + wait)
    rows = events.select(F.col("user_id").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").cast("int").alias("flag"), batch.alias("batch"))
    return late.replayed(rows, "batch")


# windows that the watermark has closed, of rows that were in time
@query("r2_closed_windows", LATE_SQL + " WHERE begin + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def _(spark, d):
    out, _ = late.run_batches(live.flag_rate(_arriving(spark, d), "1 day", late="1 day"))
    return out.withColumn("begin", F.col("begin").cast("timestamp_ntz"))


# every window in its last state
@query("r2_updated_windows", LATE_SQL)
def _(spark, d):
    out, _ = late.run_batches(live.flag_rate(_arriving(spark, d), "1 day", late="1 day"), "update", ["series_id", "begin"])
    return out.withColumn("begin", F.col("begin").cast("timestamp_ntz"))


@query("r3_closed_sessions")
def _(spark, d):
    out, _ = late.run_batches(live.sessions(_arriving(spark, d), "6 hours", late="1 day"))
    return out


def trailing_sql(size: int) -> str:
    return f"""WITH q AS (SELECT user_id AS series_id, event_id AS rn, value AS v, count(*) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING))
SELECT series_id, rn, round(CASE WHEN n > 1 AND s > 0 THEN abs(v - m) / s ELSE 0 END, 6) AS z FROM q"""


@query("r4_local_z_stream", trailing_sql(20))
def _(spark, d):
    out, _ = late.run_batches(late.local_z(_stream(spark, d), "channel_41", 20))
    return rounded(out, "z")


# the same over three micro-batches, state going from one to the next
@query("r4_local_z_batches", trailing_sql(50))
def _(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    batch = F.floor(F.col("event_id") * 3 / events.count())
    rows = events.select(F.col("user_id").alias("series_id"), F.col("event_id").alias("rn"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("channel_41"), batch.alias("batch"))
    out, _ = late.run_batches(late.local_z(late.replayed(rows, "batch"), "channel_41", 50))
    return rounded(out, "z")
