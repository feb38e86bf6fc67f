"""A cleaning pipeline over ``documents``: language, near copies, repeated passages, benchmarks, tokens.

Each stage works on all rows that the one before it kept; its output is written as Parquet in
the shared folder and read again.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.llm import bpe_transducer, decontaminate, language_id, near_dedup, suffix_dedup
from perigee.llm._spark import apart, discard, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows that a Python worker is handed at once: whole texts are long, and five stages share the executors' memory.
BATCH_ROWS = "1000"


def _small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` in a session whose batches to Python hold :data:`BATCH_ROWS` rows."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


@_small_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language the compressors can tell stay; undetermined and rejected ones go."""
    dictionaries = language_id.fit(docs.where(~language_id.held_out()))
    named = language_id.predict(docs, dictionaries, to=("__pred", "__score", "__rejected"))
    return named.where(~F.col("__rejected")).select(*docs.columns)


@_small_batches
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of least id; of rows that share an id the one of least text (null first) stays.

    Only texts of rows that go, or whose id occurs twice, take part in a join.
    """
    judged = written(near_dedup.near_duplicates(docs).select("doc_id", "kept"), "judged")
    odd = judged.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("kept").alias("__stays")).where("n > 1 or not __stays")
    odd = written(odd.select("doc_id", "__stays", F.xxhash64("doc_id").alias("__h")), "odd")
    may, plain = apart(docs.withColumn("__h", F.xxhash64(F.coalesce("doc_id", F.lit(0)))), odd, "__h")
    may = may.join(odd.drop("__h"), "doc_id", "left").drop("__h")
    least = F.min_by(F.struct(*docs.columns), F.struct("text", F.xxhash64(*docs.columns)))
    once = may.where("__stays").groupBy("doc_id").agg(least.alias("__row")).select("__row.*")
    discard(judged)
    return plain.select(*docs.columns).unionByName(may.where("__stays is null").select(*docs.columns)).unionByName(once.select(*docs.columns))


@_small_batches
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated 256-byte strings, which a passage of 50 words holds, go and n_chars follows; a text left empty stays as an empty row."""
    return suffix_dedup.remove_passages(docs, window=suffix_dedup.PASSAGE)


@_small_batches
def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold too much of a benchmark item go; null and wordless ones stay, rows that repeat are judged alike, an empty table gives none."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_small_batches
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of what is left; a null text is empty, a row is a result of its own, no rows give none."""
    import public_tokenizers

    return bpe_transducer.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("MinHash near-dedup", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_free),
    ("BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs


#: SQL has no compressor, so it can't express the first stage; tests/llm compares with brute force.
ORACLE_SQL = None
