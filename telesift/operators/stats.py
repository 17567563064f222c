"""Statistics of channels and scores: one pass each where one suffices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telesift.operators.sketches import SIZE, rank_error
from telesift.sources.durable import written


def long_form(df: DataFrame, columns: list[str], keys: list[str], name: str = "channel", value: str = "value") -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def channel_stats(df: DataFrame, columns: list[str], min_std: float | None = None) -> DataFrame:
    """(channel, mean, std): mean and population deviation, floored at min_std."""
    out = long_form(df.select(*columns), columns, []).groupBy("channel").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return out if min_std is None else out.withColumn("std", F.greatest("std", F.lit(min_std)))


def stats_row(df: DataFrame, columns: list[str], min_std: float | None = None) -> DataFrame:
    """One row <channel>_mean, <channel>_std, to be cross-joined with rows."""
    std = lambda c: F.stddev_pop(c) if min_std is None else F.greatest(F.stddev_pop(c), F.lit(min_std))
    return df.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], *[std(c).alias(f"{c}_std") for c in columns])


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """df with the columns of a one-row table."""
    return df.crossJoin(F.broadcast(row))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    v = F.col("value")
    return long_form(df.select(*columns), columns, []).groupBy("channel").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("lo"), F.max(v).alias("hi"))


def ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    v = F.col("value")
    return long_form(df.select(*columns), columns, []).groupBy("channel").agg(F.min(v).alias("lo"), F.max(v).alias("hi"), (F.max(v) - F.min(v)).alias("range"))


def binary_channels(df: DataFrame, columns: list[str]) -> DataFrame:
    """(channel, is_binary): whole numbers only, of exactly two values. Few values survive the first grouping,
    so exact counting does not keep a set of all of them in one task."""
    rows = long_form(df.select(*columns), columns, []).filter("value is not null")
    values = rows.groupBy("channel", "value").agg(F.count("*").alias("n"))
    return values.groupBy("channel").agg(((F.count("*") == 2) & (F.sum(F.abs(F.col("value").cast("long") - F.col("value")) * F.col("n")) == 0)).alias("is_binary"))


def scaling_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(channel, mean, std) for standardisation: binary channels get (min, range), a deviation of 0 becomes 1."""
    stats = channel_stats(df, columns).join(ranges(df, columns), "channel").join(binary_channels(df, columns), "channel")
    std = F.when(F.col("is_binary"), F.col("range")).otherwise(F.col("std"))
    return stats.select("channel", F.when(F.col("is_binary"), F.col("lo")).otherwise(F.col("mean")).alias("mean"), F.when(std == 0, 1.0).otherwise(std).alias("std"))


DIRECT = 131_072  # a megabyte of doubles


def _narrowed(v: Column, t: str) -> Column:
    """Whether a value lies in the open interval of target t, of which a missing end is infinite."""
    a, b = F.col(f"{t}_a"), F.col(f"{t}_b")
    return (a.isNull() | (v > a)) & (b.isNull() | (v < b))


GRID = 256
SHARES = f"array({', '.join(f'{i / GRID}D' for i in range(GRID + 1))})"


def _values(sketches: list[str]) -> dict[str, Column]:
    """<sketch>_values: what each sketch holds at the grid of shares, null if it holds nothing."""
    some = lambda s: F.coalesce(F.kll_sketch_get_n_double(s), F.lit(0)) > 0
    return {f"{s}_values": F.when(some(s), F.expr(f"kll_sketch_get_quantile_double({s}, {SHARES})")) for s in sketches}


def _marks(t: str, sketch: str) -> dict[str, Column]:
    """Two values of a sketch around a rank, on its grid of shares and twice its error apart from the rank; null if it holds none."""
    some = F.col(f"{sketch}_values").isNotNull()
    share, apart = F.col(f"{t}_k") / F.col(f"{t}_n"), 2 * rank_error()
    at = lambda i: F.when(some & (F.col(f"{t}_n") > 0), F.get(f"{sketch}_values", F.least(F.greatest(i, F.lit(0)), F.lit(GRID)).cast("int")))
    return {f"{t}_p": at(F.floor((share - apart) * GRID)), f"{t}_q": at(F.ceil((share + apart) * GRID))}


def _part(t: str) -> dict[str, Column]:
    """Which of five parts (below, at and between the marks) holds a rank, and the rows of the interval before that part."""
    k = F.col(f"{t}_k")
    sizes = [F.col(f"{t}_{x}") for x in ("below", "at_p", "between", "at_q")]
    upto = [sum(sizes[1 : i + 1], sizes[0]) for i in range(4)]
    part = F.when(k < upto[0], 0).when(k < upto[1], 1).when(k < upto[2], 2).when(k < upto[3], 3).otherwise(4)
    return {f"{t}_part": part, f"{t}_before": F.when(k < upto[0], F.lit(0)).when(k < upto[1], upto[0]).when(k < upto[2], upto[1]).when(k < upto[3], upto[2]).otherwise(upto[3])}


def _closer(t: str) -> dict[str, Column]:
    """The part of an interval that holds a rank, from the counts below, at and between its two marks: a smaller interval, or the value itself."""
    k, n, p, q = (F.col(f"{t}_{x}") for x in "knpq")
    part, before = F.col(f"{t}_part"), F.col(f"{t}_before")
    sizes = [F.col(f"{t}_{x}") for x in ("below", "at_p", "between", "at_q")]
    of = lambda *x: F.element_at(F.array(*x), part + 1)
    none, a, b = F.lit(None).cast("double"), F.col(f"{t}_a"), F.col(f"{t}_b")
    value = F.when(p.isNull(), F.lit(float("nan"))).otherwise(of(none, p, none, q, none))  # a part without marks holds nothing but NaN
    move = F.col(f"{t}_v").isNull() & (n > 0)
    return {
        f"{t}_a": F.when(move, of(a, a, p, p, q)).otherwise(a),
        f"{t}_b": F.when(move, of(p, p, q, q, b)).otherwise(b),
        f"{t}_k": F.when(move & p.isNotNull(), k - before).otherwise(k),
        f"{t}_n": F.when(move & p.isNotNull(), of(*sizes, n - before)).otherwise(n),
        f"{t}_v": F.when(move, value).otherwise(F.col(f"{t}_v")),
    }


def exact_percentiles(df: DataFrame, wanted: dict[str, tuple[str, float]], keys: list[str] | None = None, direct: int = DIRECT) -> DataFrame:
    """(keys.., a column for each name of wanted = {name: (column, share)}): exact, by linear interpolation; null without values, NaN above all others.

    Each wanted rank is looked for in an interval of values, at first all of them. A round sketches the values inside, takes two
    values of the sketch around the rank and counts what lies below, at and between them; the part with the rank, under two in a
    hundred of the rows, is the next interval, until it has at most `direct` rows, which are sorted. Every pass is one aggregation with a
    row a key and partition to shuffle, and a mark leaves the interval in every round, so equal values end the search. df is read
    twice or more: write it first if it is dear.
    """
    keys = keys or []
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    at = {c: f"_c{i}" for i, c in enumerate(columns)}
    rows = df.select(*keys, *[F.col(c).cast("double").alias(at[c]) for c in columns])
    targets = {f"_t{i}": (at[c], share) for i, (c, share) in enumerate(wanted.values())}  # the lower of the two ranks around a share
    with_state = lambda state: _with_keys(rows, state, keys)

    first = rows.groupBy(*keys).agg(*[F.count(v).alias(f"{v}_n") for v in at.values()], *[F.kll_sketch_agg_double(v, F.lit(SIZE)).alias(f"{v}_s") for v in at.values()])
    rank = lambda v, share: F.floor(F.lit(share) * (F.col(f"{v}_n") - 1))
    none = F.lit(None).cast("double")
    state = first.withColumns(_values([f"{v}_s" for v in at.values()])).withColumns({f"{t}_{x}": c for t, (v, share) in targets.items() for x, c in (("a", none), ("b", none), ("v", none), ("n", F.col(f"{v}_n")), ("k", rank(v, share)))})
    state = state.withColumns({x: c for t, (v, _) in targets.items() for x, c in _marks(t, f"{v}_s").items()})
    kept = [*keys, *[f"{v}_n" for v in at.values()], *[f"{t}_{x}" for t in targets for x in "abvnk"]]
    state = written(state.select(*kept, *[f"{t}_{x}" for t in targets for x in "pq"]))
    open_rows = lambda t: F.when(F.col(f"{t}_v").isNull(), F.col(f"{t}_n")).otherwise(0)
    most = lambda s: s.agg(F.max(F.greatest(*[open_rows(t) for t in targets], F.lit(0)))).first()[0] or 0
    while most(state) > direct:
        counts = []
        for t, (v, _) in targets.items():
            x, p, q = F.col(v), F.col(f"{t}_p"), F.col(f"{t}_q")
            asked = (open_rows(t) > 0) & _narrowed(x, t)
            counts += [F.count_if(asked & test).alias(f"{t}_{name}") for name, test in (("below", x < p), ("at_p", x == p), ("between", (x > p) & (x < q)), ("at_q", (x == q) & (q > p)))]
        counted = with_state(state).groupBy(*keys).agg(*counts)
        told = _with_keys(state, counted, keys).withColumns({x: c for t in targets for x, c in _part(t).items()})
        state = written(told.withColumns({x: c for t in targets for x, c in _closer(t).items()}).select(*kept))
        if most(state) > direct:
            inside = [F.kll_sketch_agg_double(F.when((open_rows(t) > 0) & _narrowed(F.col(v), t), F.col(v)), F.lit(SIZE)).alias(f"{t}_s") for t, (v, _) in targets.items()]
            again = _with_keys(state, with_state(state).groupBy(*keys).agg(*inside), keys).withColumns(_values([f"{t}_s" for t in targets]))
            state = written(again.withColumns({x: c for t in targets for x, c in _marks(t, f"{t}_s").items()}).select(*kept, *[f"{t}_{x}" for t in targets for x in "pq"]))
    last = []
    for t, (v, _) in targets.items():
        x, found = F.col(v), F.col(f"{t}_v")
        last.append(F.sort_array(F.collect_list(F.when((open_rows(t) > 0) & _narrowed(x, t), x))).alias(f"{t}_rest"))
        last.append(F.min(F.when(F.coalesce(x > found, x >= F.col(f"{t}_b")), x)).alias(f"{t}_next"))
    found = _with_keys(state, with_state(state).groupBy(*keys).agg(*last), keys)
    out = []
    for (t, (v, share)), name in zip(targets.items(), wanted, strict=True):
        k, rest, place = F.col(f"{t}_k").cast("int"), F.col(f"{t}_rest"), F.lit(share) * (F.col(f"{v}_n") - 1)
        lo = F.coalesce(F.col(f"{t}_v"), F.get(rest, k))
        hi = F.when(F.col(f"{t}_k") + 1 == F.col(f"{t}_n"), F.col(f"{t}_next")).otherwise(F.coalesce(F.col(f"{t}_v"), F.get(rest, k + 1)))
        below, above = F.floor(place), F.ceil(place)
        out.append(F.when(F.col(f"{v}_n") > 0, F.when(below == above, lo).otherwise((above - place) * lo + (place - below) * hi)).alias(name))
    return written(found.select(*keys, *out))


def _with_keys(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of a table of one row a key (one row in all without keys); null keys meet."""
    if not keys:
        return with_row(rows, table)
    other = table.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return rows.join(other, same).drop(*[f"_key_{k}" for k in keys])


def _by_channel(row: DataFrame, name: str) -> DataFrame:
    """A row of one column a channel as (channel, name)."""
    return row.unpivot([], row.columns, "channel", name)


def median_mad(df: DataFrame, columns: list[str]) -> DataFrame:
    """(channel, median, mad): exact; all channels share their passes."""
    medians = exact_percentiles(df, {c: (c, 0.5) for c in columns})
    apart = with_row(df.select(*columns), medians.select(*[F.col(c).alias(f"_m{i}") for i, c in enumerate(columns)]))
    mads = exact_percentiles(apart.select(*[F.abs(F.col(c) - F.col(f"_m{i}")).alias(c) for i, c in enumerate(columns)]), {c: (c, 0.5) for c in columns})
    return _by_channel(medians, "median").join(_by_channel(mads, "mad"), "channel")


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as (x - median) / (1.4826 mad), only centred where mad is 0."""
    m = {r["channel"]: (r["median"], r["mad"]) for r in median_mad(df, columns).collect()}
    scaled = lambda c: (F.col(c) - m[c][0]) / (1.4826 * m[c][1] if m[c][1] else 1.0)
    return df.withColumns({c: scaled(c) for c in columns})


def percentiles(df: DataFrame, column: str, shares: list[float], exact: bool = True) -> DataFrame:
    """One row p<share in percent>: linear interpolation, or approximate for very many distinct values."""
    names = {s: f"p{s * 100:g}".replace(".", "_") for s in shares}
    if exact:
        return exact_percentiles(df, {names[s]: (column, s) for s in shares})
    return df.agg(*[F.percentile_approx(column, F.lit(s), F.lit(100_000)).alias(names[s]) for s in shares])


def contamination(df: DataFrame, label: str = "is_anomaly", default: float = 0.01) -> DataFrame:
    if label not in df.columns:
        return df.sparkSession.createDataFrame([(default,)], "contamination double")
    return df.agg(F.avg(label).alias("contamination"))


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int, by: list[str] | None = None) -> DataFrame:
    """(by.., bin, n); the last bin holds the upper border."""
    at = F.least(F.floor((F.col(column) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("long")
    return df.filter(F.col(column).between(lo, hi)).groupBy(*(by or []), at.alias("bin")).agg(F.count("*").alias("n"))
