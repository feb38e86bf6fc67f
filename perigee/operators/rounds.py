"""Tables between rounds of an iteration: written to the shared folder, so that lineage stays short."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; in local mode alone a temporary folder may stand in."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local.setdefault("base", tempfile.mkdtemp(prefix="perigee-"))
    return f"{base.rstrip('/')}/perigee/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from a Parquet table in the shared folder."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "round")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._round = path
    return out


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each computed once a row however often later ones and filters refer to it.

    They are generated rows: a plain projection would be put into every expression that reads it.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`materialised` that nothing reads any more."""
    for t in tables:
        jvm, session = t.sparkSession._jvm, t.sparkSession._jsparkSession
        path = jvm.org.apache.hadoop.fs.Path(t._round)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)
