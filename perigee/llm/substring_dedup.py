"""Repeated token spans by compaction of a de Bruijn graph.

The graph's edges are token k-mers, windows of 35 consecutive words, between the nodes that are
their first and last 34 words.  Only edges around an anchor k-mer that occurs twice can repeat, so
others are left out beforehand.  Where all occurrences of an anchor show the same words, its edges
are a path that nothing branches off, one record from the start; elsewhere edges are spelled
out and counted.  Repeated paths and edges are then compacted in Spark: in- and out-degrees by
node, a join of what ends in a node of one way in and one way out with what begins there, and
joins that double these links until each path knows its first.

Source coordinates (document, first and last window) turn repeated paths into spans of words.
Words are compared there: a path counts as repeated only if BLAKE2b gives one digest for what stands at
all its coordinates.  Edges that are spelled out are told by two hashes of 64 bits within
their anchor's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.llm import _repeats as R
from perigee.llm import _seq as S
from perigee.llm._spark import discard, mapped_apart, written

WINDOW, ANCHOR = 35, 10


class _Text:
    """A block's words, and what is derived from them when it is asked for."""

    def __init__(self, block: S.Block):
        self.block, self.w = block, S.words(block, S.NON_SPACE)

    @cached_property
    def squeezed(self) -> tuple[np.ndarray, np.ndarray]:
        return S.squeezed(self.block.data, self.w, S.NON_SPACE)

    @cached_property
    def nodes(self) -> np.ndarray:
        return S.signed(S.kmer_hash(self.w.hash, WINDOW - 1))

    @cached_property
    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(S.signed(S.kmer_hash(x, WINDOW)) for x in (self.w.hash, S.mix(self.w.hash + np.uint64(0x632BE59BD9B4E019))))


def _symbols(block: S.Block):
    t = _Text(block)
    return t.w.hash, t.w.first, t


def _quick(t: _Text, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return S.signed(S.span_hash(t.w.hash, lo, hi + WINDOW))


def _content(t: _Text, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    text, at = t.squeezed
    return S.digests(text, at[lo], at[hi + WINDOW])[:, 0]


def _payload(t: _Text, lo: int, hi: int) -> bytes:
    """The piece's edges by both hashes, and its nodes."""
    a, b = t.edges
    return a[lo : hi + 1].tobytes() + b[lo : hi + 1].tobytes() + t.nodes[lo : hi + 2].tobytes()


def _ends(t: _Text, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last node of pieces."""
    return (t.nodes[lo], t.nodes[hi + 1]) if len(lo) else (lo, hi)


UNIT = R.Unit(WINDOW, ANCHOR, _symbols, _quick, _content, _payload, _ends)
_EDGE = ["anchor", "edge", "more"]


def _edges(contents: DataFrame) -> DataFrame:
    """(anchor, content, i, edge, more, tail, head, n): one row for each edge of each distinct branching piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, content, n = (batch.column(c).to_numpy() for c in ("anchor", "content", "n"))
            values = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("payload")]
            size = np.array([(len(v) - 1) // 3 for v in values], np.int64)  # m edges, twice, and m + 1 nodes
            m, none = size.tolist(), np.zeros(0, np.int64)
            part = lambda a, z: np.concatenate([none, *[v[a * k + (z == 4) : min(z, 3) * k + (z == 4)] for v, k in zip(values, m, strict=True)]])  # noqa: E731, B023
            i = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            columns = [np.repeat(anchor, size), np.repeat(content, size), i.astype(np.int32), part(0, 1), part(1, 2), part(2, 3), part(2, 4), np.repeat(n, size)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor", "content", "i", "edge", "more", "tail", "head", "n"])

    return contents.mapInArrow(run, "anchor long, content long, i int, edge long, more long, tail long, head long, n long")


def compacted(paths: DataFrame) -> DataFrame:
    """(path, unitig), written, of those ``paths`` (path, tail, head) that go on from another one.

    Where one path alone ends and one alone begins, they go on as one.  Each path points to the
    one before it; pointers are doubled by joins until all reach their chain's first path, so n
    paths in a row take log n rounds.  What then still moves are cycles, named by their least path.
    """
    begins = paths.groupBy(F.col("tail").alias("node")).agg(F.count("*").alias("out"), F.min("path").alias("id"))
    ends = paths.groupBy(F.col("head").alias("node")).agg(F.count("*").alias("in"), F.min("path").alias("at"))
    links = begins.where("out = 1").join(ends.where("in = 1"), "node").where("id <> at")
    way = written(links.select("id", "at", F.least("id", "at").alias("least"), F.lit(True).alias("moved")), "ways")
    n, rounds = way.count(), 0
    while n and 2**rounds <= 2 * n and not way.where("moved").isEmpty():
        ahead = way.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("least").alias("other"))
        step = way.join(ahead, "at", "left").select("id", F.coalesce("next", "at").alias("at"), F.least("least", "other").alias("least"), F.col("next").isNotNull().alias("moved"))
        before, way = way, written(step, "ways")
        discard(before)
        rounds += 1
    out = way.select(F.col("id").alias("path"), F.when(F.col("moved"), F.col("least")).otherwise(F.col("at")).alias("unitig"))
    out._scratch = way._scratch
    return out


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text, key), and (key, spans, n_paths), written: words to remove and of how many compacted paths."""
    rows = R.keyed(docs, id_col, text_col)
    anchors = written(R.repeated_anchors(rows, UNIT), "anchors")
    placed = written(R.placed_pieces(rows, anchors, UNIT), "placed")
    edges = written(_edges(R.mixed_contents(rows, anchors, UNIT)), "edges")
    twice = edges.groupBy(*_EDGE).agg(F.sum("n").alias("n"), F.first("tail").alias("tail"), F.first("head").alias("head")).where("n > 1")
    twice = written(twice.select(*_EDGE, F.xxhash64(*_EDGE).alias("path"), "tail", "head"), "repeated-edges")
    whole = placed.where("not mixed")
    alike = F.min("content") == F.max("content")  # of what stands at the coordinates
    kept = whole.groupBy(F.col("anchor").alias("path")).agg(F.first("tail").alias("tail"), F.first("head").alias("head"), alike.alias("alike"))
    kept = written(kept.where("alike").drop("alike"), "paths")
    unitigs = compacted(kept.unionByName(twice.select("path", "tail", "head")))
    named = written(kept.select("path").join(unitigs, "path", "left").select("path", F.coalesce("unitig", "path").alias("unitig")), "unitigs")
    # a piece has at most window - anchor + 1 edges, or its text's where the anchor recurs on and on
    marked = edges.join(twice.join(unitigs, "path", "left").select(*_EDGE, F.coalesce("unitig", "path").alias("unitig")), _EDGE)
    marked = marked.groupBy("anchor", "content", "unitig").agg(R.ranges_of(F.array_sort(F.collect_set("i"))).alias("ranges"))
    settled = written(marked.select("anchor", "content", "unitig", F.explode("ranges").alias("r")), "settled")
    one = whole.withColumnRenamed("anchor", "path").join(named, "path").select("key", "lo", (F.col("hi") + WINDOW).alias("hi"), "unitig")
    part = placed.where("mixed").select("key", "lo", "anchor", "content").join(settled, ["anchor", "content"])
    part = part.select("key", (F.col("lo") + F.col("r.lo")).alias("lo"), (F.col("lo") + F.col("r.hi") + WINDOW).alias("hi"), "unitig")
    found = written(one.unionByName(part), "found")
    number = found.groupBy("key").agg(F.count_distinct("unitig").alias("n_paths"))
    spans = written(R.merged(found.select("key", "lo", "hi")).join(number, "key"), "spans")
    discard(anchors, placed, edges, twice, kept, unitigs, named, settled, found)
    return rows, spans


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, n_paths and, if asked for, kept_text.

    Null and wordless texts have nothing to remove.  Rows that repeat in full are copies of
    each other, so their windows are repeated.  An empty table gives none; other columns are
    ignored.
    """
    rows, spans = repeated_words(docs, id_col, text_col)
    spans = spans.select("key", F.struct("spans", "n_paths").alias("spans"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_paths long" + ", kept_text string" * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("spans").to_pylist()
            out: list[tuple] = []
            for block in S.blocks(batch.column("text")):
                w = S.words(block, S.NON_SPACE)
                raw = block.data.tobytes()
                for i in range(block.n):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    keep = np.ones(b - a, bool)
                    said = found[block.first + i] or {"spans": (), "n_paths": 0}
                    for s in said["spans"]:
                        keep[s["lo"] : s["hi"]] = False
                    at = np.flatnonzero(keep) + a
                    kept = b" ".join([raw[x:y] for x, y in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)])
                    out.append((b - a, b - a - len(at), hashlib.sha256(kept).hexdigest(), said["n_paths"], kept.decode() if texts else None))
            columns = [batch.column("doc_id"), pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string()), pa.array([r[3] for r in out], pa.int64())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_paths"]
            if texts:
                columns.append(pa.array([r[4] for r in out], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return mapped_apart(rows.select("doc_id", "text", "key"), spans, "key", "spans", run, schema)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)
