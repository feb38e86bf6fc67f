"""Writers that name tables by what is in them: immutable results, versions under one pointer, partitioned tables with a manifest.

A table's digest doesn't depend on the order or the files of its rows: 128 bits of each row's
SHA-256 are added up, in partial sums per task, and hashed with the number of rows and the
columns.  Tables are written beside their place first and moved there in one step, which a store
must offer as a rename (file systems do); a job that fails leaves no half table behind.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL = "_content.json"
POINTER = "_current.json"


class ImmutableConflict(ValueError):
    """The place holds something else."""


class _Store:
    """Files beside the tables, by the session's own file systems."""

    def __init__(self, spark: SparkSession, base: str):
        self.jvm = spark._jvm
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.base = base.rstrip("/")
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.conf)
        self.files = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        p = self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
        return p.getFileSystem(self.conf).makeQualified(p)

    def exists(self, name: str) -> bool:
        return self.files.exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(x.getPath().getName() for x in self.files.listStatus(self.path(name))) if self.exists(name) else []

    def read(self, name: str) -> dict:
        stream = self.files.open(self.path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, name: str, said: dict) -> None:
        self.files.mkdirs(self.path(name).getParent())
        stream = self.files.create(self.path(name), True)
        try:
            stream.write(bytearray(json.dumps(said, sort_keys=True).encode()))
        finally:
            stream.close()

    def move(self, source: str, target: str, over: bool = False) -> None:
        """In one step; without ``over`` it fails where the target is there already."""
        kind = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        how = self.jvm.java.lang.reflect.Array.newInstance(kind, 1)
        self.jvm.java.lang.reflect.Array.set(how, 0, kind.getEnumConstants()[1 if over else 0])
        self.context.rename(self.path(source), self.path(target), how)

    def drop(self, name: str) -> None:
        self.files.delete(self.path(name), True)


def content_digest(table: DataFrame) -> tuple[str, int]:
    """(digest, rows) of a table, whatever the order of its rows and columns; rows that repeat count."""
    names = sorted(table.columns)
    said = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false", "timeZone": "UTC"}) if names else F.lit("{}")
    lane = lambda k: F.conv(F.substring("__h", 1 + 8 * k, 8), 16, 10).cast("decimal(10,0)")
    sums = table.select(F.sha2(said, 256).alias("__h")).agg(F.count("*").alias("n"), *[F.sum(lane(k)).alias(f"s{k}") for k in range(4)]).first()
    total = sum(int(sums[f"s{k}"] or 0) << (32 * k) for k in range(4)) % (1 << 128)
    columns = [(f.name, f.dataType.simpleString()) for f in sorted(table.schema, key=lambda f: f.name)]
    return hashlib.sha256(json.dumps([columns, sums["n"], f"{total:032x}"]).encode()).hexdigest(), sums["n"]


def _staged(table: DataFrame, store: _Store) -> tuple[str, dict]:
    """A table written beside its place with its label; the digest is of what was written, so a plan that isn't repeatable does no harm."""
    name = f".{uuid.uuid4().hex}.tmp"
    table.write.parquet(f"{store.base}/{name}")
    digest, rows = content_digest(table.sparkSession.read.schema(table.schema).parquet(f"{store.base}/{name}"))
    label = {"digest": digest, "rows": rows, "columns": sorted(table.columns)}
    store.write(f"{name}/{LABEL}", label)
    return name, label


def write_immutable(table: DataFrame, base: str, name: str | None = None) -> dict:
    """Writes under ``base`` where nothing is there yet; says digest, rows, path and whether it was written.

    The name is the table's digest unless another is given.  The same content in that place is
    accepted, other content or a folder without a label is an :class:`ImmutableConflict`.
    """
    store = _Store(table.sparkSession, base)
    staged, label = _staged(table, store)
    target = name or label["digest"]
    out = label | {"path": f"{store.base}/{target}"}
    try:
        if not store.exists(target):
            try:
                store.move(staged, target)
                return out | {"written": True}
            except Exception:
                if not store.exists(target):  # not another writer that came first
                    raise
        if not store.exists(f"{target}/{LABEL}"):
            raise ImmutableConflict(f"{out['path']} is there and has no label")
        if store.read(f"{target}/{LABEL}")["digest"] != label["digest"]:
            raise ImmutableConflict(f"{out['path']} holds other content")
        return out | {"written": False}
    finally:
        store.drop(staged)


def publish(tables: dict[str, DataFrame], base: str, backup: bool = True, dry_run: bool = False) -> dict:
    """A new version of several tables at once: each is written immutably, then one pointer names all of them.

    Readers of :func:`current` see all of the old version or all of the new.  The pointer before
    is kept under its time with ``backup``; nothing is written with ``dry_run``, and nothing
    changes where all digests are those of the version that is current.
    """
    spark = next(iter(tables.values())).sparkSession
    store = _Store(spark, base)
    before = store.read(POINTER) if store.exists(POINTER) else None
    if dry_run:
        found = {n: dict(zip(("digest", "rows"), content_digest(t), strict=True)) for n, t in tables.items()}
    else:
        found = {n: {k: v for k, v in write_immutable(t, f"{store.base}/{n}").items() if k in ("digest", "rows")} for n, t in tables.items()}
    changed = before is None or before["tables"] != found
    pointer = {"tables": found, "version": (before["version"] if before else 0) + changed}
    if changed and not dry_run:
        if before is not None and backup:
            store.write(f"_backup/{time.strftime('%Y%m%d%H%M%S', time.gmtime())}-{before['version']:06d}.json", before)
        staged = f".{uuid.uuid4().hex}.pointer"
        store.write(staged, pointer)
        store.move(staged, POINTER, over=True)
    return pointer | {"changed": changed}


def current(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The tables of the version that the pointer names; none before the first."""
    store = _Store(spark, base)
    if not store.exists(POINTER):
        return {}
    return {n: spark.read.parquet(f"{store.base}/{n}/{x['digest']}") for n, x in store.read(POINTER)["tables"].items()}


def write_partitioned(table: DataFrame, base: str, by: str) -> DataFrame:
    """A folder a value of ``by``, and the manifest of (value, rows), published together with it; returns the manifest.

    Rows of one value are brought together before they are written, several tasks to a large one
    by Spark's own balance of partitions.
    """
    path = f"{base.rstrip('/')}/data-{uuid.uuid4().hex}"
    table.hint("rebalance", by).write.partitionBy(by).parquet(path)
    manifest = table.sparkSession.read.parquet(path).groupBy(by).agg(F.count("*").alias("rows")).withColumn("path", F.lit(path))
    publish({"manifest": manifest}, base)
    return current(table.sparkSession, base)["manifest"]
