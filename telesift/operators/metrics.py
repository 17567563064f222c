"""Evaluation of flags and events against labels, and threshold calibration."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telesift.functions.scores import f_beta
from telesift.operators.events import merge, overlaps, stabbed
from telesift.operators.levels import event_tree, matching_pairs, threshold_counts
from telesift.operators.prep import before
from telesift.operators.rolling import over_frames
from telesift.sources.durable import written


def _rate(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def pointwise(df: DataFrame, flag: str, label: str, beta: float = 0.5) -> DataFrame:
    p, t = F.col(flag) == 1, F.col(label) == 1
    counts = df.agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    rated = counts.withColumn("precision", _rate(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _rate(F.col("tp"), F.col("tp") + F.col("fn")))
    return rated.withColumn("f_beta", f_beta(F.col("precision"), F.col("recall"), beta))


def true_positives(predicted: DataFrame, true: DataFrame) -> DataFrame:
    hit = overlaps(predicted, true).select("series_id", F.col("p_start").alias("start_rn")).distinct()
    return predicted.join(hit, ["series_id", "start_rn"], "left_semi")


def false_positives(predicted: DataFrame, true: DataFrame) -> DataFrame:
    hit = overlaps(predicted, true).select("series_id", F.col("p_start").alias("start_rn")).distinct()
    return predicted.join(hit, ["series_id", "start_rn"], "left_anti")


def eventwise(predicted: DataFrame, true: DataFrame, recall: str = "reference") -> DataFrame:
    """One row: n_pred, n_true, tp, precision, recall, f05. recall='reference' counts predicted hits over true
    events, which can pass 1; 'matched_true' counts the true events that were hit. Both empty: 1, 1, 1."""
    pairs = overlaps(predicted, true)
    hits = pairs.select("series_id", "p_start").distinct().agg(F.count("*").alias("tp"))
    found = pairs.select("series_id", "t_start").distinct().agg(F.count("*").alias("found"))
    one = predicted.agg(F.count("*").alias("n_pred")).crossJoin(true.agg(F.count("*").alias("n_true"))).crossJoin(hits).crossJoin(found)
    empty = (F.col("n_pred") == 0) & (F.col("n_true") == 0)
    top = F.col("tp") if recall == "reference" else F.col("found")
    out = one.withColumn("precision", F.when(empty, 1.0).otherwise(_rate(F.col("tp"), F.col("n_pred")))).withColumn("recall", F.when(empty, 1.0).otherwise(_rate(top, F.col("n_true"))))
    return out.withColumn("f05", F.when(empty, 1.0).otherwise(f_beta(F.col("precision"), F.col("recall")))).drop("found")


def sequence_counts(predicted: DataFrame, true: DataFrame) -> DataFrame:
    """One row (tp, fp, fn): a predicted sequence credits the first true one it overlaps; a true one counts once."""
    first = overlaps(predicted, true).groupBy("series_id", "p_start").agg(F.min("t_start").alias("t_start"))
    credited = first.select("series_id", "t_start").distinct().agg(F.count("*").alias("tp"))
    hits = first.agg(F.count("*").alias("hits"))
    one = credited.crossJoin(hits).crossJoin(predicted.agg(F.count("*").alias("p"))).crossJoin(true.agg(F.count("*").alias("t")))
    return one.select("tp", (F.col("p") - F.col("hits")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"))


def precision_recall(counts: DataFrame) -> DataFrame:
    """Summed counts with precision and recall, null where undefined."""
    one = counts.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return one.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))


def greedy_matches(predicted: DataFrame, true: DataFrame, least: float = 0.2, iou: bool = False) -> DataFrame:
    """(series_id, p_start, t_start, ratio): in time order each predicted event takes the unused true event of the highest
    overlap ratio; the first wins ties; below `least` nothing is taken.

    Overlapping events form clusters that cannot influence one another; a cluster is matched in one task.
    """
    return match_pairs(overlaps(written(predicted), written(true)), least, iou)


def match_pairs(pairs: DataFrame, least: float = 0.2, iou: bool = False) -> DataFrame:
    """greedy_matches of overlapping pairs (series_id, p_start, p_end, t_start, t_end)."""
    pairs = written(pairs)
    spans = pairs.select("series_id", F.least("p_start", "t_start").alias("start_rn"), F.greatest("p_end", "t_end").alias("end_rn"))
    # a cluster holds all that touches: its number goes to the pairs by where their predicted events begin
    clusters = merge(spans, -1).select(F.col("series_id").alias("_series"), "start_rn", "end_rn", F.col("start_rn").alias("cluster"))
    found = stabbed(pairs.select("series_id", "p_start").distinct(), "p_start", written(clusters)).select("series_id", "p_start", "cluster")
    rows = pairs.join(found, ["series_id", "p_start"])

    def match(batches):
        """One predicted event after the other, as its rows come by; of a cluster only its used true events are kept."""
        event, cluster, best, ratio, used = None, None, None, 0.0, set()

        def taken(out: list) -> None:
            if best is not None and ratio >= least:
                used.add(best)
                out.append((event[0], event[1], best, ratio))

        for pdf in batches:
            out: list[tuple] = []
            for series, c, p_start, p_end, t_start, t_end in zip(*(pdf[x].tolist() for x in ("series_id", "cluster", "p_start", "p_end", "t_start", "t_end")), strict=True):
                if (series, p_start) != event or (series, c) != cluster:
                    taken(out)
                    event, best, ratio = (series, p_start), None, 0.0
                    if (series, c) != cluster:
                        cluster, used = (series, c), set()
                if t_start in used:
                    continue
                shared = min(p_end, t_end) - max(p_start, t_start) + 1
                p, t = p_end - p_start + 1, t_end - t_start + 1
                now = shared / (p + t - shared if iou else min(p, t))
                if now > ratio:
                    best, ratio = t_start, now
            yield pd.DataFrame(out, columns=["series_id", "p_start", "t_start", "ratio"])
        out = []
        taken(out)
        yield pd.DataFrame(out, columns=["series_id", "p_start", "t_start", "ratio"])

    rows = rows.repartition("series_id", "cluster").sortWithinPartitions("series_id", "cluster", "p_start", "t_start")
    return rows.mapInPandas(match, "series_id long, p_start long, t_start long, ratio double")


def strict_eventwise(predicted: DataFrame, true: DataFrame, beta: float = 0.5, least: float = 0.2, iou: bool = False) -> DataFrame:
    hits = greedy_matches(predicted, true, least, iou).agg(F.count("*").alias("tp"))
    one = hits.crossJoin(predicted.agg(F.count("*").alias("n_pred"))).crossJoin(true.agg(F.count("*").alias("n_true")))
    out = one.withColumn("precision", _rate(F.col("tp"), F.col("n_pred"))).withColumn("recall", _rate(F.col("tp"), F.col("n_true")))
    return out.withColumn("f_beta", f_beta(F.col("precision"), F.col("recall"), beta))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row auc, by average ranks: values are counted first, so ties cost nothing."""
    values = df.groupBy(F.col(score).alias("v")).agg(F.count("*").alias("n"), F.sum(label).alias("ones"))
    ranked = before(values, "v", ["n"]).withColumn("rank", F.col("n_before") + (F.col("n") + 1) / 2.0)
    one = ranked.agg(F.sum(F.col("rank") * F.col("ones")).alias("r"), F.sum("ones").alias("p"), F.sum(F.col("n") - F.col("ones")).alias("q"))
    return one.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"))


def confusion(df: DataFrame, flag: str, label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(flag).alias("flag")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, flag: str, label: str) -> DataFrame:
    """(name, precision, recall, f1, support): a row for each class, then accuracy (in all three), macro avg and weighted avg.

    Rates without a denominator are 0; rows without label or flag are left out; without any row there are no classes and the last
    three are 0. Everything follows from the counts by label and flag.
    """
    counts = written(confusion(df.filter(F.col(flag).isNotNull() & F.col(label).isNotNull()), flag, label))
    none = F.lit(0).cast("long")
    true = counts.select(F.col("label").cast("string").alias("name"), F.col("n").alias("support"), none.alias("found"), F.when(F.col("label") == F.col("flag"), F.col("n")).otherwise(none).alias("hit"))
    found = counts.select(F.col("flag").cast("string").alias("name"), none.alias("support"), F.col("n").alias("found"), none.alias("hit"))
    classes = true.unionByName(found).groupBy("name").agg(*[F.sum(c).alias(c) for c in ("support", "found", "hit")])
    classes = classes.withColumn("precision", _rate(F.col("hit"), F.col("found"))).withColumn("recall", _rate(F.col("hit"), F.col("support")))
    rates = ["precision", "recall", "f1"]
    classes = classes.withColumn("f1", f_beta(F.col("precision"), F.col("recall"), 1.0))
    some = lambda c: F.coalesce(c, F.lit(0.0))
    every = F.coalesce(F.sum("support"), none).alias("support")
    accuracy = some(F.try_divide(F.sum("hit"), F.sum("support")))
    totals = {"accuracy": [accuracy] * 3, "macro avg": [some(F.avg(r)) for r in rates], "weighted avg": [some(F.try_divide(F.sum(F.col(r) * F.col("support")), F.sum("support"))) for r in rates]}
    out = classes.select("name", *rates, "support")
    for name, values in totals.items():
        out = out.unionByName(classes.agg(*[v.alias(r) for v, r in zip(values, rates, strict=True)], every).withColumn("name", F.lit(name)))
    return out


def grid(steps: int = 200) -> list[float]:
    """Evenly spaced thresholds 0..1, the last one exactly 1."""
    return [i * (1.0 / (steps - 1)) for i in range(steps - 1)] + [1.0]


def threshold_events(df: DataFrame, score: str, thresholds: list[float], strict: bool = False, block: int = 20_000) -> DataFrame:
    """(series_id, threshold, start_rn, end_rn): events of score >= t (or > t) for every threshold at once.

    A row opens an event for just the thresholds between its neighbour's score and its own, so only those are
    exploded: the rows made are the events' ends, not rows times thresholds. Opens and closes are
    numbered per threshold, block of positions by block, and joined. Positions of a series follow one another.
    """
    values = F.array(*[F.lit(float(t)) for t in thresholds])
    s = F.coalesce(F.col(score), F.lit(float("-inf")))
    none = F.lit(float("-inf"))
    rows = over_frames(df.select("series_id", "rn", s.alias("s")), 1, 1, lambda f: {"before": F.coalesce(f.lag("s"), none), "after": F.coalesce(f.lag("s", -1), none)}, block)

    def ends(neighbour: str, name: str) -> DataFrame:
        inside = (lambda t: (F.col(neighbour) <= t) & (t < F.col("s"))) if strict else (lambda t: (F.col(neighbour) < t) & (t <= F.col("s")))
        made = rows.filter(F.col(neighbour) < F.col("s")).select("series_id", F.col("rn").alias(name), F.explode(F.filter(values, inside)).alias("threshold"))
        made = made.withColumn("block", F.floor(F.col(name) / block))
        keys = ["series_id", "threshold"]
        run = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        begins = made.groupBy(*keys, "block").agg(F.count("*").alias("n")).select(*keys, "block", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("begin"))
        made = made.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "block").orderBy(name))).join(begins, [*keys, "block"])
        return made.select(*keys, name, (F.col("begin") + F.col("k")).alias("k"))

    return ends("before", "start_rn").join(ends("after", "end_rn"), ["series_id", "threshold", "k"]).drop("k")


def calibrate(df: DataFrame, score: str, true: DataFrame, thresholds: list[float], shortest: int = 2, gap: int = 8, strict: bool = False) -> DataFrame:
    """(threshold, n_pred, n_true, tp, precision, recall, f05) of each threshold after pruning and merging."""
    rows = threshold_counts(df, score, true, thresholds, shortest, gap, strict).crossJoin(true.agg(F.count("*").alias("n_true")))
    rows = rows.select("threshold", "n_pred", "n_true", "tp")
    empty = (F.col("n_pred") == 0) & (F.col("n_true") == 0)
    rows = rows.withColumn("precision", F.when(empty, 1.0).otherwise(_rate(F.col("tp"), F.col("n_pred")))).withColumn("recall", F.when(empty, 1.0).otherwise(_rate(F.col("tp"), F.col("n_true"))))
    return rows.withColumn("f05", F.when(empty, 1.0).otherwise(f_beta(F.col("precision"), F.col("recall"))))


def strict_sweep(df: DataFrame, score: str, true: DataFrame, thresholds: list[float], shortest: int = 7, gap: int = 0, beta: float = 0.5, least: float = 0.2) -> DataFrame:
    """(threshold, n_pred, n_true, tp, precision, recall, f_beta): events of score > t, each true one matched once, for all thresholds at once.

    Different events are looked up once, however many thresholds have them; only pairs that overlap are told apart by threshold
    and matched, each threshold and series by itself, numbered as a series of its own.
    """
    return strict_sweeps(df, [score], true, thresholds, shortest, gap, beta, least).drop("model", "median_length", "longest")


def _apart(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """matching_pairs as (free, rest): pairs of events whose true events meet no other event at any of their thresholds, and all the others.

    Two events meet at a true event if the thresholds that have them do. What a free event takes, none else could, so it takes its best.
    """
    before = Window.partitionBy("series_id", "t_start").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    met = pairs.withColumn("_to", F.max("hi").over(before)).filter("_to >= lo").select("series_id", "t_start").distinct()
    node = ["series_id", "p_start", "p_end"]
    mixed = written(pairs.join(met, ["series_id", "t_start"], "left_semi").select(*node).distinct())
    return pairs.join(mixed, node, "left_anti"), pairs.join(mixed, node, "left_semi")


def strict_sweeps(df: DataFrame, scores: list[str], true: DataFrame, thresholds: list[float], shortest: int = 7, gap: int = 0, beta: float = 0.5, least: float = 0.2) -> DataFrame:
    """strict_sweep of several score columns at once, with model (the column's name) and the median and greatest length of the events, 0 without any.

    Each score of a series is a series of its own, so there is one tree of events and one round of matching for all
    models. An event that shares none of its true events with another of the same threshold is judged once for all its thresholds. A null score is in no event; an empty table gives a row a threshold and model.
    """
    spark = df.sparkSession
    true = written(true.select("series_id", "start_rn", "end_rn"))
    n, m = len(thresholds), len(scores)
    # a series of its own for each model, then for each threshold
    by_model = lambda events: events.withColumn("series_id", F.explode(F.array(*[F.col("series_id") * m + i for i in range(m)])))
    levels = [(t, k) for k, t in enumerate(sorted(float(t) for t in thresholds))]
    every = spark.createDataFrame([(name, i, t, k) for i, name in enumerate(scores) for t, k in levels], "model string, m long, threshold double, k long")
    stacked = df.select("series_id", "rn", F.posexplode(F.array(*[F.col(c).cast("double") for c in scores])).alias("m", "s"))
    stacked = stacked.select((F.col("series_id") * m + F.col("m")).alias("series_id"), "rn", "s")
    tree = written(event_tree(stacked, "s", thresholds, shortest, gap, strict=True))
    free, rest = _apart(written(matching_pairs(tree, by_model(true))))
    length = lambda a, b: F.col(b) - F.col(a) + 1
    shared = F.least("p_end", "t_end") - F.greatest("p_start", "t_start") + 1
    alone = free.groupBy("series_id", "p_start", "p_end", "lo", "hi").agg(F.max(shared / F.least(length("p_start", "p_end"), length("t_start", "t_end"))).alias("ratio")).filter(F.col("ratio") >= least)
    alone = alone.groupBy(F.pmod("series_id", F.lit(m)).cast("long").alias("m"), "lo", "hi").agg(F.count("*").alias("tp"))
    alone = alone.select("m", F.explode(F.sequence(F.col("lo").cast("long"), F.col("hi").cast("long"))).alias("k"), "tp")
    rest = rest.withColumn("k", F.explode(F.sequence("lo", "hi")))
    rest = rest.select((F.col("series_id") * n + F.col("k")).alias("series_id"), "p_start", "p_end", "t_start", "t_end")
    hits = match_pairs(rest, least).groupBy(F.pmod("series_id", F.lit(m * n)).cast("long").alias("at")).agg(F.count("*").alias("tp"))
    hits = hits.select(F.expr(f"at div {n}").alias("m"), F.expr(f"at % {n}").alias("k"), "tp")
    hits = hits.unionByName(alone).groupBy("m", "k").agg(F.sum("tp").alias("tp"))
    # by length first: a model's different lengths at a threshold are few, as their sum is under the number of rows
    found = tree.groupBy(F.pmod("series_id", F.lit(m)).cast("long").alias("m"), "lo", "hi", length("start_rn", "end_rn").alias("length")).agg(F.count("*").alias("n")).withColumn("k", F.explode(F.sequence(F.col("lo").cast("long"), F.col("hi").cast("long"))))
    found = found.groupBy("m", "k").agg(F.sum("n").alias("n_pred"), F.percentile("length", F.lit(0.5), F.col("n")).alias("median_length"), F.max("length").alias("longest"))
    rows = every.join(found, ["m", "k"], "left").join(hits, ["m", "k"], "left").na.fill(0, ["n_pred", "median_length", "longest", "tp"]).crossJoin(true.agg(F.count("*").alias("n_true")))
    rows = rows.withColumn("precision", _rate(F.col("tp"), F.col("n_pred"))).withColumn("recall", _rate(F.col("tp"), F.col("n_true")))
    rows = rows.withColumn("f_beta", f_beta(F.col("precision"), F.col("recall"), beta))
    return rows.select("model", "threshold", "n_pred", "n_true", "tp", "precision", "recall", "f_beta", "median_length", "longest")


def best_threshold(table: DataFrame, metric: str = "f05", default: float = 0.5) -> DataFrame:
    """The lowest threshold of the highest metric; the default if no metric is above 0."""
    best = table.orderBy(F.col(metric).desc(), "threshold").limit(1)
    return best.select(F.when(F.col(metric) > 0, F.col("threshold")).otherwise(default).alias("threshold"), F.col(metric).alias("metric"))
