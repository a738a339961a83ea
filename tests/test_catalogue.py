"""Registered queries over small odd tables, against their SQL."""

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from vigilframe.plans import catalogue


def against_sql(spark, folder, name, **tables):
    """The query's rows, which must be its SQL's over the same Arrow tables."""
    duckdb = pytest.importorskip("duckdb")
    import pyarrow.parquet as pq

    con = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(rows, f"{folder}/{table}.parquet")
        con.register(table, rows)
    got = sorted((tuple(r) for r in catalogue.QUERIES[name](spark, str(folder)).collect()), key=repr)
    assert got == sorted(con.sql(catalogue.ORACLE_SQL[name]).fetchall(), key=repr)
    return got


def test_age_counts_in_nearest_seconds(spark, tmp_path):
    import pyarrow as pa

    newest = dt.datetime(2024, 1, 30, 23, 59, 25)
    day = dt.timedelta(days=1)
    us = lambda n: dt.timedelta(microseconds=n)
    ts = [newest + us(400_000), newest - day, newest - day - us(1), newest - day - us(500_000), newest - day - us(499_999), newest - day - us(500_001), newest - day - us(1_000_000), None]
    events = pa.table({"event_id": pa.array(range(len(ts)), pa.int64()), "ts": pa.array(ts, pa.timestamp("us"))})
    assert [r[0] for r in against_sql(spark, tmp_path, "cache_ttl", events=events)] == [0, 1, 2, 4]
    # the newest rounds up, and the limit with it
    ts[0] = newest + us(600_000)
    events = pa.table({"event_id": pa.array(range(len(ts)), pa.int64()), "ts": pa.array(ts, pa.timestamp("us"))})
    assert [r[0] for r in against_sql(spark, tmp_path, "cache_ttl", events=events)] == [0]


def test_pages_that_share_a_url_have_their_own_outputs(spark, tmp_path):
    import pyarrow as pa

    pages = [(1, "http://a/", "x"), (2, "http://a/", "y"), (3, "http://a/", "z"), (4, "http://b/", "x"), (5, "http://b/", "x"), (7, None, "x"), (8, "http://c/", None), (9, None, None), (10, "", "")]
    ids, urls, htmls = zip(*pages)
    table = pa.table({"page_id": pa.array(ids, pa.int64()), "url": pa.array(urls, pa.string()), "html": pa.array(htmls, pa.string())})
    got = against_sql(spark, tmp_path, "url_cache_chain", pages=table)
    assert sorted(got) == [(i, m, i) for i in ids if i % 3 for m in "ab"]


def test_admission_leaves_other_columns_as_they_are(spark):
    """Whole numbers beside nulls do not pass through floating point, groups of any size keep their order."""
    from vigilframe.operators import lifecycle

    rows = [(i % 700 if i % 3 else 0, i, i % 4, None if i % 2 else 2**53 + i) for i in range(4000)]
    batch = spark.createDataFrame(rows, "g long, seq long, n_items int, note long").repartition(3)
    got = {r["seq"]: (r["g"], r["note"], r["accepted"]) for r in lifecycle.within_capacity(batch, 1, 9, ["g"], parts=5).collect()}
    room, want = {}, {}
    for g, i, n, note in rows:
        fits = n <= room.setdefault(g, 8)
        room[g] -= n if fits else 0
        want[i] = (g, note, fits)
    assert got == want
