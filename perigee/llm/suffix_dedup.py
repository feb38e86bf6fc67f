"""Removal of repeated byte strings by suffix sorting in shards.

Candidate windows (of 400 bytes in the query) are found as in :mod:`perigee.llm._repeats`.  Where the
occurrences of an anchor differ, the distinct pieces around it are dealt to shards by anchor, and
each shard is sorted by external induced sorting (:mod:`perigee.llm._induced`): a window is
repeated if its suffix shares a window's length with a neighbour in suffix order, or its piece occurs
twice.  An anchor with very many distinct pieces is dealt to several shards; what those find is
completed by counting their windows' fingerprints across shards, added up before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.llm import _repeats as R
from perigee.llm import _seq as S
from perigee.llm._induced import repeated_starts
from perigee.llm._spark import apart, discard, lean, mapped_apart, written

#: Bytes of a repeated string that is removed, and of a shorter one that is reported beside it:
#: 50 words of prose take some 300 bytes, so a passage of 50 words holds at least one of 256.
WINDOW, PASSAGE = 400, 256
#: Bytes sorted at once within a task, and distinct pieces of one anchor in one shard, at most.
SHARD_BYTES, ANCHOR_PIECES = 2 << 20, 1024
#: Tasks that shards are dealt to, at most.
MOST_TASKS = 1 << 14


def unit(window: int) -> R.Unit:
    def symbols(block: S.Block):
        return S.byte_symbols(block.data), block.offsets, block.data

    def content(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return S.digests(data, lo, hi + window)[:, 0]

    def payload(data: np.ndarray, lo: int, hi: int) -> bytes:
        return data[lo : hi + window].tobytes()

    return R.Unit(window, window // 2, symbols, content, content, payload)


_RANGES = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _sort_shards(contents: DataFrame, window: int, tasks: int) -> DataFrame:
    """(anchor, content, ranges): windows found within the shard that a piece lies in.

    Rows arrive sorted by shard and anchor; a task cuts them, between anchors, into texts of
    bounded size, since pieces of different anchors have no window in common.
    """

    def solve(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        flags = repeated_starts([np.frombuffer(p, np.uint8) for *_, p in rows], window)
        ids, ranges = [], []
        for (anchor, content, n, piece), flag in zip(rows, flags, strict=True):
            windows = len(piece) - window + 1
            if n > 1:
                got = [{"lo": 0, "hi": windows - 1}]
            else:
                a, b = S.runs(flag[:windows], np.array([0, windows]))
                got = [{"lo": x, "hi": y - 1} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            if got:
                ids.append((anchor, content))
                ranges.append(got)
        return pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in ids], pa.int64()) for i in (0, 1)), pa.array(ranges, _RANGES)], ["anchor", "content", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, bytes]] = []
        size, before = 0, None
        for batch in batches:
            for shard, anchor, content, n, piece in zip(*(batch.column(c) for c in ("shard", "anchor", "content", "n", "payload")), strict=True):
                now = (shard.as_py(), anchor.as_py())
                if now != before and size >= SHARD_BYTES:
                    yield solve(rows)
                    rows, size = [], 0
                before = now
                rows.append((now[1], content.as_py(), n.as_py(), piece.as_py()))
                size += len(rows[-1][3])
        if rows:
            yield solve(rows)

    dealt = contents.repartition(tasks, "anchor", "shard").sortWithinPartitions("shard", "anchor", "content")
    return dealt.mapInArrow(lean(run), "anchor long, content long, ranges array<struct<lo:int,hi:int>>")


def _fingerprints(contents: DataFrame, window: int) -> DataFrame:
    """(anchor, content, i, print, n) of the windows of pieces whose anchor lies in several shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, content, n, piece in zip(*(batch.column(c) for c in ("anchor", "content", "n", "payload")), strict=True):
                data = np.frombuffer(piece.as_buffer(), np.uint8)
                at = np.arange(len(data) - window + 1)
                full = lambda x: pa.array(np.full(len(at), x.as_py()))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([full(anchor), full(content), pa.array(at.astype(np.int32)), pa.array(S.digests(data, at, at + window)[:, 0]), full(n)], ["anchor", "content", "i", "print", "n"])

    return contents.mapInArrow(lean(run), "anchor long, content long, i int, print long, n long")


def _settle(contents: DataFrame, window: int) -> DataFrame:
    contents = written(contents, "contents")
    size = contents.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    tasks = max(1, min(MOST_TASKS, -(-size // SHARD_BYTES)), contents.sparkSession.sparkContext.defaultParallelism)
    several = contents.groupBy("anchor").agg(F.count("*").alias("pieces")).where(F.col("pieces") > ANCHOR_PIECES)
    several = several.select("anchor", F.ceil(F.col("pieces") / (ANCHOR_PIECES // 2)).cast("long").alias("shards"))
    dealt = contents.join(several, "anchor", "left").withColumn("shard", F.when(F.col("shards") > 1, F.pmod("content", "shards")).otherwise(F.lit(0).cast("long")))
    sorted_ = written(_sort_shards(dealt.select("anchor", "shard", "content", "n", "payload"), window, tasks), "sorted")
    prints = written(_fingerprints(contents.join(several.select("anchor"), "anchor", "left_semi"), window), "prints")
    twice = prints.groupBy("anchor", "print").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "print")
    # a piece has at most window - anchor + 1 windows, or its text's where the anchor recurs on and on
    across = prints.join(twice, ["anchor", "print"], "left_semi").groupBy("anchor", "content").agg(R.ranges_of(F.array_sort(F.collect_set("i"))).alias("ranges"))
    out = written(sorted_.unionByName(across).groupBy("anchor", "content").agg(F.flatten(F.collect_list("ranges")).alias("ranges")), "repeated")
    discard(contents, prints, sorted_)
    return out


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text, key), and (key, spans) of bytes to remove from them."""
    rows = R.keyed(docs, id_col, text_col)
    return rows, R.repeat_spans(rows, unit(window), lambda contents: _settle(contents, window))


def longer(rows: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """(key, spans) for a longer window, of rows whose spans for a shorter one are known.

    A repeated string's parts are repeated, so every occurrence lies within a known span: those
    of a window's length are cut out and searched in place of the texts.
    """
    long_ = spans.select("key", F.filter("spans", lambda s: s["hi"] - s["lo"] >= window).alias("spans")).where(F.size("spans") > 0)
    may, _ = apart(rows.select("doc_id", "key", "text"), long_, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key, at, out = [], [], [], []
            for d, k, text, cut in zip(*(batch.column(c) for c in ("doc_id", "key", "text", "spans")), strict=True):
                data = memoryview(text.as_buffer())
                for s in cut.as_py():
                    doc.append(d.as_py()), key.append(k.as_py()), at.append(s["lo"]), out.append(bytes(data[s["lo"] : s["hi"]]))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(at, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "of", "at", "text"])

    cuts = may.join(long_, "key").mapInArrow(lean(run), "doc_id long, of long, at long, text binary").withColumn("key", F.xxhash64("of", "at"))
    cuts = written(cuts, "cuts")
    found = R.repeat_spans(cuts.select("key", "text"), unit(window), lambda contents: _settle(contents, window))
    whole = cuts.select("key", "of", "at").distinct().join(found, "key")
    moved = F.transform("spans", lambda s: F.struct((s["lo"] + F.col("at")).alias("lo"), (s["hi"] + F.col("at")).alias("hi")))
    out = written(whole.select(F.col("of").alias("key"), moved.alias("spans")).groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")), "spans")
    discard(cuts, found)
    return out


def remove_bytes(rows: DataFrame, spans: DataFrame, texts: bool = True, reported: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes) and, if asked for, kept.

    ``kept`` is binary, as a cut may part a code point; n_passage_bytes are the bytes in ``reported``
    (key, spans), 0 without it.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long" + ", kept binary" * texts
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    both = spans.select("key", F.struct("spans", F.lit(0).cast("long").alias("more")).alias("x"))
    if reported is not None:
        both = reported.select("key", size.alias("more")).join(spans, "key", "full").select("key", F.struct("spans", F.coalesce("more", F.lit(0)).alias("more")).alias("x"))
    both = both.withColumnRenamed("x", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                data, at, parts, gone = memoryview(text.as_buffer()), 0, [], 0
                cut = (found and found["spans"]) or ()
                for s in cut:
                    parts.append(data[at : s["lo"]])
                    gone += s["hi"] - s["lo"]
                    at = s["hi"]
                kept = b"".join([*parts, data[at:]])
                out.append((len(data), gone, len(cut), hashlib.sha256(kept).hexdigest(), found["more"] if found else 0, kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())[: 5 + texts]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "kept"][: 6 + texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names)

    return mapped_apart(rows.select("doc_id", "text", "key"), both, "key", "spans", run, schema)


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", window: int = WINDOW) -> DataFrame:
    """``docs`` with bytes of repeated strings of ``window`` bytes cut from the text and ``chars_col``, if there, following it.

    Bytes of a code point that a cut has parted go as well, so that the text stays valid; null
    texts, texts without repeats and all other columns are passed on.
    """
    _, spans = repeated_bytes(docs, id_col, text_col, window)
    base = docs.columns
    named = spans.select(F.col("key").alias("__key"), F.col("spans").alias("__spans"))
    may, none = apart(docs.withColumn("__key", F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))), named, "__key")
    joined = may.join(named, "__key", "left").select(*[F.col(f"`{c}`") for c in base], "__spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", `__cut` boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cut = batch.column(text_col).to_pylist(), []
            for i, spans in enumerate(batch.column("__spans").to_pylist()):
                cut.append(bool(spans))
                if spans:
                    data, at, parts = texts[i].encode(), 0, []
                    for s in spans:
                        parts.append(data[at : s["lo"]])
                        at = s["hi"]
                    texts[i] = b"".join([*parts, data[at:]]).decode("utf-8", "ignore")
            columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in base]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cut, pa.bool_())], [*base, "__cut"])

    out = joined.mapInArrow(lean(run), schema)
    if chars_col in base:
        out = out.withColumn(chars_col, F.when(F.col("__cut"), F.char_length(text_col).cast("long")).otherwise(F.col(chars_col)))
    pick = [F.col(f"`{c}`") for c in base]
    return out.select(*pick).unionByName(none.select(*pick))


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes and, if asked for, kept.

    Null counts as empty, and texts under 400 bytes have nothing to remove; n_passage_bytes
    counts the bytes of repeated strings of 256 bytes, removed or not.  Rows that repeat
    in full are copies of each other.  An empty table gives none; other columns are ignored.
    """
    rows, passages = repeated_bytes(docs, id_col, text_col, PASSAGE)
    return remove_bytes(rows, longer(rows, passages, WINDOW), texts, passages)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_suffixes(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)
