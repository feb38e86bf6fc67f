"""Queries whose keys, at size, need more digits than the smallest tables have, against their SQL."""

import duckdb

from perigee.plans import QUERIES, SQL


def against(spark, path, name, table, select):
    """Compares a query with its SQL on a table that a SELECT makes; returns the SQL's rows."""
    con = duckdb.connect()
    con.execute(f"COPY ({select}) TO '{path}/{table}.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    said = want.fetchall()
    got = QUERIES[name](spark, str(path)).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, said))
    return said


PARTS = "SELECT k AS p_partkey, 'Part ' || k AS p_name, 7 AS p_size FROM (SELECT unnest([0, 1, 3, 5, 70998, 71001, 89999, 90000, 90003, 329999, 330000, 330001, 971001, 1199997, 7199998]) AS k)"


def test_generation_rule(spark, tmp_path):
    assert max(r[2] for r in against(spark, tmp_path, "generation_rule", "part", PARTS) if r[2]) == 29000 + 1199997


def test_tle_records(spark, tmp_path):
    assert {r[2] for r in against(spark, tmp_path, "tle_records", "part", PARTS)} >= {"99999", "100003", "339999", "340001", "7209998"}


def test_border_of_the_radius(spark, tmp_path):
    """The nearest single to 0.05 lies above it by less than the slack of boxes."""
    rows = "SELECT i AS vec_id, [v, 0, 0, v, 0, 0]::FLOAT[] AS embedding FROM (VALUES (1, 0.0), (2, 0.05), (3, 0.02)) AS t(i, v)"
    assert len(against(spark, tmp_path, "chord_candidates", "embeddings", rows)) == 2
    assert against(spark, tmp_path, "screening_statistics", "embeddings", rows) == [(1, 3, 3, 2)]


def test_border_of_refined_events(spark, tmp_path):
    """A pair further apart than 0.04 by less than the refinement's slack."""
    rows = "SELECT i AS vec_id, [v, 0, 0, v, 0, 0]::FLOAT[] AS embedding FROM (VALUES (1, -1.2e-9), (2, 0.04), (3, 0.02)) AS t(i, v)"
    assert len(against(spark, tmp_path, "refined_events", "embeddings", rows)) == 2
