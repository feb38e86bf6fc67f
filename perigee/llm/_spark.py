"""Session helpers of this subpackage: shared scratch tables and bounded membership filters."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (``spark.checkpoint.dir``).

    Where that setting is absent a temporary folder stands in, in local mode alone: on a cluster
    each executor would write to a disk of its own, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local.setdefault("base", tempfile.mkdtemp(prefix="perigee-"))
    return f"{base.rstrip('/')}/perigee/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """The rows of ``df`` from a Parquet table in the shared folder; cuts the lineage.

    A task of a writer and of a reader holds a row group.  Parquet looks at its size after a hundred rows
    at first, which is too late where a row takes megabytes: ``group_bytes`` closes it at about that size, looked at after every row.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    small = {"compression": "zstd", "parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1} if group_bytes else {}
    df.write.options(**small).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`written` that nothing reads any more."""
    for t in tables:
        jvm, session = t.sparkSession._jvm, t.sparkSession._jsparkSession
        path = jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


class Filter:
    """A Bloom filter of 64-bit keys, sized by their number and never above ``2**MOST`` words.

    Tasks fold keys into words of the filter with a grouped bit_or and pack the words they end
    up with, so at most 16 bytes a word reach the driver, whatever the input.  A full filter
    passes too many keys, never too few: what passes is confirmed by an exact join, so its load
    changes cost and not results.
    """

    #: Logarithms of the least and the greatest number of 64-bit words (8 KB and 16 MB).
    LEAST, MOST = 10, 21

    def __init__(self, words: np.ndarray, log_words: int):
        self.words, self.log_words = words, log_words

    @staticmethod
    def of(keys: DataFrame, column: str, n: int | None = None) -> Filter:
        """Of ``keys`` (a table that is cheap to read twice), or of about ``n`` keys where that is known."""
        n = keys.count() if n is None else n
        log_words = min(Filter.MOST, max(Filter.LEAST, (n // 4).bit_length()))  # 16 bits a key or more
        h = F.col(column)
        at = lambda shift: F.shiftrightunsigned(h, shift).bitwiseAND((1 << log_words) - 1)
        bit = lambda shift: F.expr(f"shiftleft(1L, int(shiftrightunsigned(`{column}`, {shift}) & 63))")
        both = F.array(F.struct(at(0).alias("w"), bit(58).alias("b")), F.struct(at(26).alias("w"), bit(52).alias("b")))
        found = keys.select(F.explode(both).alias("x")).groupBy("x.w").agg(F.bit_or("x.b").alias("b"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [(batch.column("w").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
            if got:
                w, b = (np.concatenate(x).astype(np.int64).tobytes() for x in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([w], pa.binary()), pa.array([b], pa.binary())], ["w", "b"])

        words = np.zeros(1 << log_words, np.int64)
        for row in found.mapInArrow(pack, "w binary, b binary").collect():
            words[np.frombuffer(row["w"], np.int64)] = np.frombuffer(row["b"], np.int64)
        return Filter(words, log_words)

    def has(self, keys: np.ndarray) -> np.ndarray:
        k = keys.view(np.uint64)
        most = np.uint64((1 << self.log_words) - 1)
        words = self.words.view(np.uint64)
        out = np.ones(len(k), bool)
        for at, bit in ((0, 58), (26, 52)):
            out &= (words[(k >> np.uint64(at)) & most] >> ((k >> np.uint64(bit)) & np.uint64(63))) & np.uint64(1) != 0
        return out

    def passes(self, spark: SparkSession, key: Column) -> Column:
        """Whether the filter has a long column's value; only that column goes to Python."""
        sent = spark.sparkContext.broadcast(self)

        @F.pandas_udf("boolean")
        def has(x: pd.Series) -> pd.Series:
            return pd.Series(sent.value.has(x.to_numpy(np.int64)))

        return has(key)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with memory that is free at its end given back: a Python worker lives on through many stages."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # of the C library, where it has one
                trim(0)

    return trimmed


def apart(rows: DataFrame, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` that may have a key of ``keys``, and those that surely have none.

    The second need no join, so that a join that few rows take part in doesn't shuffle all.
    """
    passes = Filter.of(keys, column).passes(rows.sparkSession, F.col(column))
    flagged = rows.withColumn("__may", passes)
    return flagged.where("__may").drop("__may"), flagged.where("not __may").drop("__may")


def mapped_apart(rows: DataFrame, found: DataFrame, column: str, value: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, on: list[str] | None = None) -> DataFrame:
    """``run`` in ``mapInArrow`` over ``rows`` left-joined with ``found`` (the key and ``value``).

    Rows that surely have no match get a null ``value`` within the same pass and are not
    shuffled; a task has one Python worker either way.
    """
    filt = Filter.of(found, column)
    sent = rows.sparkSession.sparkContext.broadcast(filt)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(~sent.value.has(batch.column(column).to_numpy())))
                if batch.num_rows:
                    yield batch.append_column(value, pa.nulls(batch.num_rows))

        return run(some())

    may = rows.where(filt.passes(rows.sparkSession, F.col(column))).join(found, on or column, "left")
    return may.select(*rows.columns, value).mapInArrow(lean(run), schema).unionByName(rows.mapInArrow(lean(rest), schema))
