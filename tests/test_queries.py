"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import math

import duckdb
import numpy as np
import pytest

from perigee.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    say = lambda x: "null" if x is None or (isinstance(x, float) and math.isnan(x)) else repr(float(x)) if isinstance(x, float) else str(x)
    return sorted(tuple(say(r[i]) for i in order) for r in values)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_refined_events_whole(spark, con):
    """Every pair within the radius, also at the slab's start and end, by brute force over the table."""
    ids, e = zip(*con.execute("SELECT vec_id, embedding FROM embeddings").fetchall())
    e = np.array([x[:6] for x in e], float)
    i, j = np.triu_indices(len(e), 1)
    r0 = e[j, :3] - e[i, :3]
    v = e[j, 3:] - e[i, 3:] - r0
    at = np.clip(-(r0 * v).sum(1) / np.maximum((v * v).sum(1), 1e-300), 0, 1)
    miss = np.sqrt(((r0 + v * at[:, None]) ** 2).sum(1))
    pair = {k: (1_000_000 + 10_000 * at[k], miss[k]) for k in np.flatnonzero(miss <= 0.0401)}
    want = {tuple(str(x) for x in sorted((ids[i[k]], ids[j[k]]))): x for k, x in pair.items()}
    got = QUERIES["refined_events_whole"](spark, SF).collect()
    found = {(r.a, r.b): r for r in got}
    assert len(found) == len(got) and set(found) <= set(want)
    assert {k for k, (_, m) in want.items() if m <= 0.0399} <= set(found)
    assert all(abs(r.tca_ms - want[k][0]) <= 1 and abs(r.miss_km - want[k][1]) < 1e-4 and r.converged for k, r in found.items())
    assert any(r.boundary for r in got)


@pytest.mark.parametrize("name,table,key", [("tick_alignment_whole", "orders", "o_orderkey"), ("footprint_ring_whole", "supplier", "s_suppkey")])
def test_no_row_is_left_out(spark, name, table, key):
    sf = "/root/testdata/sf0.01"
    every = spark.read.parquet(f"{sf}/{table}.parquet").select(key).distinct().count()
    assert QUERIES[name](spark, sf).select(key).distinct().count() == every


def test_entry_without_subpackage(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert e.entry(spark).columns == ["pair_key", "event_id", "tca_ms", "miss_km", "converged", "boundary"]
