import os

import pytest

import __spark_entry__
from telesift.jobs import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["a1_channel_stats", "a20_eventwise", "w1_local_frames", "w11_merged", "w13_merge_then_prune", "d1_global_std", "d8_calibration", "r3_sessions", "h6_mann_whitney", "h1_normality", "d10_features", "a6_median_mad"]


def plain(v):
    return round(float(v), 6) + 0.0 if isinstance(v, float) or hasattr(v, "as_tuple") else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = [tuple(plain(r[n]) for n in names) for r in df.collect()]
    r = c.sql(queries.SQL[name])
    at = [r.columns.index(n) for n in names]
    want = [tuple(plain(row[i]) for i in at) for row in r.fetchall()]
    assert sorted(r.columns) == names and sorted(got, key=repr) == sorted(want, key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(queries.SQL) <= set(queries.QUERIES) <= set(__spark_entry__.queries())
