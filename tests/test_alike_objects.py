"""Objects that move alike are one row until their events are dealt out; every pair and counter is that of a run over single objects."""

from pyspark.sql import functions as F

from perigee.operators import catalog_screening as CS
from perigee.plans.sky_queries import _elements

START = 1_704_067_200_000


def run_of(**limits):
    return CS.Run(START, START + 600_000, 60.0, 60.0, 400.0, max_errors=7, **limits)


def copied(spark, n=5):
    some = _elements(spark, "/root/testdata/sf0.001").orderBy(F.substring_index("object_id", ":", -1).cast("int")).limit(12)
    bad = some.limit(1).withColumn("eccentricity", F.lit(None).cast("double")).withColumn("object_id", F.lit("bad"))
    each = some.unionByName(bad).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return each.withColumn("object_id", F.concat_ws("-", (F.lit(9) - F.col("i")).cast("string"), "object_id")).drop("i").cache()


def rows(df):
    columns = sorted(c for c in df.columns if c != "quality_flags")
    return sorted(tuple(map(str, r)) for r in df.select(*columns).collect())


def singly(catalog, run):
    objects = CS.unique_objects(catalog)
    return CS.screen_states(objects, CS.states(objects, run), run, lambda c: CS._refined(c, objects, run))


def test_a_catalog_of_copies(spark, monkeypatch):
    monkeypatch.setattr(CS, "_TOGETHER", 2)  # a kind of five takes three parts
    catalog = copied(spark)
    kind, members = CS.kinds(CS.unique_objects(catalog))
    assert kind.count() == 13 and members.select(F.explode("ids")).distinct().count() == 65 and members.where(F.size("ids") < 5).count() > 13
    for limits in ({}, {"max_candidates": 90}, {"max_events": 40}):
        got, want = CS.screen_catalog(catalog, run_of(**limits)), singly(catalog, run_of(**limits))
        for name in ("events", "reported", "errors", "partitions", "statistics", "candidates"):
            assert rows(got[name]) == rows(want[name]), name
    assert got["candidates"].where("a >= b").count() == 0


def test_one_object_among_its_copies(spark):
    catalog = copied(spark)
    primary = catalog.where("object_id like '6-%'").agg(F.min("object_id")).first()[0]
    got = CS.screen_object(catalog, primary, run_of())
    events = singly(catalog, run_of())["events"].where((F.col("a") == primary) | (F.col("b") == primary))
    assert rows(got["events"]) == rows(events)
    assert got["statistics"].collect()[0].catalog_pairs == 64
