"""Token counts through a digest cache.

The key of a text is the SHA-256 of its normalised content and the SHA-256 of the tokenizer's
file, its version.  Where the file says that the tokenizer drops white space, runs of ASCII white
space become one space and ends are trimmed; for other tokenizers the content stays as it is.  Counts stored under a key are reused; of the texts that
miss, each distinct one is encoded once and its count appended to the cache.

Hot texts: copies fold in a partial aggregate before the shuffle, so a text that makes up a
third of all rows sends one row per map task.  The join back carries only digests, and
adaptive execution splits a hot digest there, since the cache holds each key once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.llm._spark import scratch

CACHE_SCHEMA = "tokenizer binary, digest binary, n_tokens long"


def tokenizer_version(path: str) -> bytes:
    """The digest of the vocabulary file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).digest()


def drops_white_space(path: str) -> bool:
    """Whether the file has white space runs replaced by a space and everything between matches removed."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    steps = lambda part, inner: (part or {}).get(inner, [part or {}])
    squeezed = any(x.get("pattern") == {"Regex": r"\s+"} and x.get("content") == " " for x in steps(file["normalizer"], "normalizers"))
    return squeezed and any(x.get("type") == "Split" and x.get("behavior") == "Removed" and x.get("invert") for x in steps(file["pre_tokenizer"], "pretokenizers"))


def content_digest(text: Column, squeeze: bool) -> Column:
    content = F.coalesce(text, F.lit(""))
    if squeeze:
        content = F.trim(F.regexp_replace(content, r"[ \t\n\x0B\f\r]+", " "))
    return F.unhex(F.sha2(content.cast("binary"), 256))


def _counter(path: str):
    """n tokens of each text, as the library that owns the file's format counts them."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encode_misses(misses: DataFrame, path: str, version: bytes) -> DataFrame:
    """(tokenizer, digest, n_tokens) of rows (digest, text); each row is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in batches:
            texts, out, at = batch.column("text"), [], 0
            while at < len(texts):  # few texts at once: encodings are much larger than their texts
                some = texts.slice(at, 64).to_pylist()
                out += count([x or "" for x in some])
                at += 64
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(out), pa.binary()), batch.column("digest"), pa.array(out, pa.int64())],
                ["tokenizer", "digest", "n_tokens"],
            )

    return misses.select("digest", "text").mapInArrow(run, CACHE_SCHEMA)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_bytes, n_tokens) per row of ``docs``.

    ``cache`` is the path of the count table (created when new); None starts an empty one in
    the shared folder.  A null text counts as empty and has no tokens; rows that repeat stay
    repeated; an empty table gives none.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    cache = cache or scratch(spark, "token-counts")
    version = tokenizer_version(tokenizer)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", content_digest(F.col("text"), drops_white_space(tokenizer)))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    mine = lambda: spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == F.lit(version)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    misses = rows.groupBy("digest").agg(F.first("text").alias("text")).join(mine().select("digest"), "digest", "left_anti")
    encode_misses(misses, tokenizer, version).write.mode("append").parquet(cache)
    sized = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return sized.join(mine(), "digest", "left").select("doc_id", "n_bytes", "n_tokens")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)
