"""A stream whose last record of a key is flushed by a timer, file by file, against the batch."""

import datetime

import pytest

from perigee.streaming import folds

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "k string, at timestamp, t double, stage string, fraction double"


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, folds.STATE_STORE)
    yield
    spark.conf.set(key, before)


def rows(*said):
    return [(k, T0 + datetime.timedelta(seconds=t), float(t), stage, fraction) for k, t, stage, fraction in said]


def run(spark, tmp_path, files, fold, **kw):
    for i, said in enumerate(files):
        spark.createDataFrame(said, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:02d}"))
        for f in (tmp_path / "in" / f"{i:02d}").glob("*.parquet"):
            import os

            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")).withWatermark("at", "0 seconds")
    out = folds.flushed_stream(stream, "k", ["t"], fold, "at", 60.0, **kw)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(240) and q.exception() is None
    return sorted((r.k, r.t, r.persisted, r.fraction_so_far) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_last_record_is_flushed(spark, tmp_path, store):
    fold = folds.coalesce_progress(0.5, 1e9)
    files = [
        rows(("a", 0, "S", 0.0), ("b", 0, "S", 0.0), ("a", 1, "S", 0.1), ("b", 1, "S", 0.6)),
        rows(("a", 2, "S", 0.2), ("a", 3, "S", 0.15), ("b", 2, "S", 0.65)),
        rows(("z", 1000, "S", 0.0)),  # the watermark passes the idle time of a and b
        rows(("z", 2000, "S", 0.1)),
        rows(("z", 9000, "S", 0.2)),
    ]
    got = run(spark, tmp_path, files, fold)
    said = [r for f in files for r in f if r[0] != "z"]
    want = sorted((r.k, r.t, r.persisted, r.fraction_so_far) for r in folds.folded(spark.createDataFrame(said, SCHEMA), "k", ["t"], fold).collect())
    assert [r for r in got if r[0] != "z"] == want
    last = {k: p for k, t, p, _ in got if k != "z" and t == {"a": 3.0, "b": 2.0}[k]}
    assert last == {"a": True, "b": True}  # neither is a step on its own
    assert ("a", 1.0, False, 0.1) in got and ("a", 2.0, False, 0.2) in got


def test_state_goes_on_after_a_flush_and_is_forgotten(spark, tmp_path, store):
    fold = folds.rate_limit(1, 1e6)
    files = [rows(("a", 0, None, None), ("b", 0, None, None)), rows(("z", 500, None, None)), rows(("a", 600, None, None)), rows(("z", 5000, None, None)), rows(("a", 6000, None, None), ("b", 6000, None, None)), rows(("z", 9000, None, None)), rows(("z", 19000, None, None))]
    import dataclasses

    plain = dataclasses.replace(fold, outcome="persisted boolean, fraction_so_far double", step=lambda s, r: dict(zip(("persisted", "fraction_so_far"), fold.step(s, r).values())))
    got = run(spark, tmp_path, files, plain, forget_s=2000.0)
    admitted = {(k, t): p for k, t, p, _ in got if k != "z"}
    assert admitted == {("a", 0.0): True, ("b", 0.0): True, ("a", 600.0): False, ("a", 6000.0): True, ("b", 6000.0): True}


def test_other_stores_are_refused(spark):
    stream = spark.readStream.format("rate").load()
    with pytest.raises(ValueError):
        folds.flushed_stream(stream, "value", ["value"], folds.rate_limit(1, 1.0), "timestamp", 1.0)
