"""Content digests, writing where nothing is there, versions under one pointer."""

import pytest
from pyspark.sql import functions as F

from perigee.sources import writers

SCHEMA = "id long, name string, at timestamp, x double, tags array<string>"


@pytest.fixture(scope="module")
def table(spark):
    import datetime

    rows = [(i, f"n{i % 7}" if i % 5 else None, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i), i / 3, ["a", str(i)] if i % 3 else None) for i in range(200)]
    return spark.createDataFrame(rows + [rows[3]], SCHEMA)


def test_digest_of_content_alone(spark, table):
    want, n = writers.content_digest(table)
    assert n == 201
    for same in (table.orderBy(F.rand(3)), table.repartition(7), table.select(*reversed(table.columns)), table.unionByName(table.limit(0))):
        assert writers.content_digest(same) == (want, n)
    others = [
        table.distinct(), table.unionByName(table.limit(1)), table.withColumn("x", F.col("x") + 1e-9), table.withColumnRenamed("x", "y"), table.withColumn("id", F.col("id").cast("int")),
        table.withColumn("name", F.coalesce("name", F.lit(""))), table.withColumn("name", F.lit(None).cast("string")), table.limit(0),
    ]
    assert len({want, *(writers.content_digest(x)[0] for x in others)}) == len(others) + 1


def test_three_cases(spark, table, tmp_path):
    base = str(tmp_path / "results")
    first = writers.write_immutable(table, base, "run-1")
    again = writers.write_immutable(table.orderBy(F.desc("id")), base, "run-1")
    assert (first["written"], again["written"], first["digest"], first["rows"]) == (True, False, again["digest"], 201)
    with pytest.raises(writers.ImmutableConflict):
        writers.write_immutable(table.limit(5), base, "run-1")
    assert writers.content_digest(spark.read.parquet(first["path"])) == (first["digest"], 201)
    (tmp_path / "results" / "bare").mkdir()
    with pytest.raises(writers.ImmutableConflict):
        writers.write_immutable(table, base, "bare")
    named = writers.write_immutable(table, base)
    assert named["path"].endswith(named["digest"]) and not writers.write_immutable(table, base)["written"]
    assert [p.name for p in (tmp_path / "results").iterdir() if ".tmp" in p.name] == []


def test_a_move_never_covers_a_table(spark, table, tmp_path):
    store = writers._Store(spark, str(tmp_path / "r"))
    for n in ("a", "b"):
        store.write(f"{n}/{writers.LABEL}", {"digest": n})
    with pytest.raises(Exception):
        store.move("a", "b")
    assert store.read(f"b/{writers.LABEL}") == {"digest": "b"} and store.names("b") == [writers.LABEL]


def test_versions(spark, table, tmp_path):
    base = str(tmp_path / "model")
    assert writers.current(spark, base) == {}
    assert writers.publish({"events": table, "errors": table.limit(0)}, base, dry_run=True)["changed"] and not (tmp_path / "model").exists()
    one = writers.publish({"events": table, "errors": table.limit(0)}, base)
    same = writers.publish({"events": table.repartition(3), "errors": table.limit(0)}, base)
    assert (one["version"], one["changed"], same["version"], same["changed"]) == (1, True, 1, False)
    old = writers.current(spark, base)["events"]
    two = writers.publish({"events": table.where("id < 10"), "errors": table.limit(0)}, base)
    now = writers.current(spark, base)
    assert two["version"] == 2 and now["events"].count() == 11 and now["errors"].count() == 0 and old.count() == 201
    backups = list((tmp_path / "model" / "_backup").glob("*.json"))
    assert len(backups) == 1 and backups[0].name.endswith("-000001.json")
    writers.publish({"events": table}, base, backup=False)
    assert set(writers.current(spark, base)) == {"events"} and len(list((tmp_path / "model" / "_backup").glob("*.json"))) == 1


def test_a_failed_table_leaves_the_old_version(spark, table, tmp_path):
    base = str(tmp_path / "model")
    writers.publish({"events": table, "errors": table.limit(3)}, base)
    broken = table.withColumn("x", F.raise_error(F.lit("no")).cast("double"))
    with pytest.raises(Exception):
        writers.publish({"events": table.limit(9), "errors": broken}, base)
    now = writers.current(spark, base)
    assert now["events"].count() == 201 and now["errors"].count() == 3


def test_partitions_and_manifest(spark, table, tmp_path):
    rows = table.where("name is not null").withColumn("tile", F.col("id") % 4)
    manifest = {r.tile: r for r in writers.write_partitioned(rows, str(tmp_path / "tiles"), "tile").collect()}
    assert {k: r.rows for k, r in manifest.items()} == {r.tile: r["count"] for r in rows.groupBy("tile").count().collect()}
    back = spark.read.parquet(manifest[0].path)
    assert back.count() == rows.count() and back.where("tile = 2").count() == manifest[2].rows
