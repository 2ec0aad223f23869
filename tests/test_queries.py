"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import os

import pandas as pd
import pytest
from conftest import DATA, needs_data

import __spark_entry__ as entry


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else "" if pd.isna(v) else str(v) for v in r) for r in df.itertuples(index=False))


@needs_data
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_positional_map_has_every_unit(spark, tmp_path):
    spark.createDataFrame([(0, 0), (1, 1)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(1, 101).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = entry.queries()["positional_map"](spark, str(tmp_path)).collect()
    assert sorted(r["unit_pos"] for r in got) == list(range(1, 101))


@pytest.mark.parametrize("name", ["alignment_json", "chapter_playlists", "clocks", "durations_rollup", "gap_interpolate", "playlists", "readable_durations", "timeline_clamp", "timeline_continuous"])
def test_events_near_half_a_millisecond(spark, tmp_path, name):
    """A fraction of a millisecond that rounding carries into the next minute, on either side of 1970."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"""COPY (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, event_id // 10 AS user_id, CASE WHEN event_id % 10 = 1 THEN 'error' ELSE 'view' END AS event_type, 1.0::DOUBLE AS value, '{{"k": 1}}' AS props
      FROM (VALUES (0, '2024-01-01 00:00:00.000499'), (1, '2024-01-01 00:00:59.999501'), (2, '2024-01-01 00:05:59.999500'), (10, '2024-01-01 00:00:00.000500'), (11, '2024-01-01 00:01:00.000600'),
      (20, '1969-12-31 23:58:59.999500'), (21, '1969-12-31 23:59:59.999500'), (22, '1970-01-01 00:00:59.998700'), (30, '1969-12-31 23:58:59.999501'), (31, '1969-12-31 23:59:59.999400')) t(event_id, ts)) TO '{tmp_path}/events.parquet'""")
    con.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    got, want = entry.queries()[name](spark, str(tmp_path)).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert plain(got) == plain(want)
