"""Quality rules with cross-document line frequencies.

Lines are hashed in normal form (lower case, words joined by one space).  Per host, the number
of distinct documents that hold a line is counted; lines above the host's limit are cut out of
the text, and a document that has lost too much is rejected, beside the base rules on one text.

The limit is a share of the host's documents, and never under a number: a host of no more
documents than that number loses no line, not even one that all of them hold; in a host of a
million, a line on 10,000 documents stays and one on 10,001 goes.

A document is an id: rows that share one count once (a row without an id is a document of its
own).  Map tasks add up equal (host, line) pairs before the shuffle, so a line held by a third of
all rows sends one row per batch; only rows of repeated ids, which a filter tells, name their
document beside the line.  Back on the documents, only lines
that pass a filter of fixed size are carried; an exact join confirms them.  The confirmed line
numbers meet their row again by a hash of 128 bits of its content, and a second pass cuts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.llm import _seq as S
from perigee.llm._spark import Filter, discard, mapped_apart, written

#: A line is boilerplate above this share of its host's documents, and above so many documents.
LINE_SHARE, LINE_DOCUMENTS = 0.01, 10
#: A document is depleted when less than this share of its words is left.
LEAST_LEFT = 0.5
LEAST_WORDS, WINDOW, MOST_REPEATED_PERCENT = 10, 5, 20
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def _distinct(key: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of (row, key) pairs: indices of first occurrences, and how many distinct keys each row has."""
    joint = S.mix(key.view(np.uint64) ^ S.mix(row.astype(np.uint64) + np.uint64(1)))
    _, at = np.unique(joint, return_index=True)
    return at, np.bincount(row[at], minlength=n)


class _Lines:
    """Lines with a word of a block: row, number in the row's text, raw and normal hash, number of words."""

    def __init__(self, block: S.Block, w: S.Words):
        start, end = S.runs(block.data != 10, block.offsets)
        a, b = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
        has = b > a
        start, end, a, b = start[has], end[has], a[has], b[has]
        self.row = np.searchsorted(block.offsets, start, "right") - 1
        ends = np.zeros(len(block.data) + 1, np.int64)
        np.cumsum(block.data == 10, out=ends[1:])
        self.at = ends[start] - ends[block.offsets[self.row]]
        self.words = b - a
        self.raw = S.span_hash(S.byte_symbols(block.data), start, end)
        text, place = S.squeezed(S.LOWER[block.data], w, S.NON_SPACE)
        self.normal = S.digests(text, place[a], place[b])[:, 0]


def _metrics(block: S.Block, w: S.Words, lines: _Lines) -> dict[str, np.ndarray]:
    points = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum((block.data & 0xC0) != 0x80, out=points[1:])
    n = block.n
    symbols = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum(_SYMBOL[block.data], out=symbols[1:])
    _, distinct = _distinct(lines.raw, lines.row, n)
    out = {
        "n_words": np.diff(w.first),
        "word_chars": S.per_row(points[w.end] - points[w.start], w.first),
        "n_symbols": symbols[block.offsets[1:]] - symbols[block.offsets[:-1]],
        "n_dup_lines": np.bincount(lines.row, minlength=n) - distinct,
        "n_repeat_words": np.zeros(n, np.int64),
    }
    if w.n >= WINDOW:
        at = np.flatnonzero(w.row[: w.n - WINDOW + 1] == w.row[WINDOW - 1 :])
        key = S.mix(S.span_hash(w.hash, at, at + WINDOW) ^ S.mix(w.row[at].astype(np.uint64) + np.uint64(1)))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = at[count[inverse] > 1]
        cover = np.zeros(w.n + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + WINDOW, -1)
        out["n_repeat_words"] = S.per_row((np.cumsum(cover[:-1]) > 0).astype(np.int64), w.first)
    return out


def line_counts(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """(host, line, n): in how many documents of (doc_id, host long, text) each normal line occurs.

    ``repeated`` has the hash ``h`` of (host, doc_id) of documents with several rows.
    """
    filt = rows.sparkSession.sparkContext.broadcast(Filter.of(repeated, "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, docs, known = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("host", "doc_id", "known"))
            again = filt.value.has(batch.column("h").to_numpy()) & known
            for block in S.blocks(batch.column("text")):
                lines = _Lines(block, S.words(block, S.NON_SPACE))
                at, _ = _distinct(lines.normal, lines.row, block.n)
                row = block.first + lines.row[at]
                named = again[row]
                keys = np.stack([named, np.where(named, docs[row], 0), hosts[row], lines.normal[at]], 1)
                keys = keys[np.lexsort(keys.T[::-1])]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]).any(1)
                begin = np.flatnonzero(new)
                count = np.diff(np.append(begin, len(keys)))
                named, doc, host, line = (np.ascontiguousarray(keys[begin, i]) for i in range(4))
                yield pa.RecordBatch.from_arrays([pa.array(host), pa.array(line), pa.array(doc, mask=named == 0), pa.array(count.astype(np.int64))], ["host", "line", "doc", "n"])

    said = rows.select("host", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), F.xxhash64("host", "doc_id").alias("h"), "text")
    found = said.mapInArrow(run, "host long, line long, doc long, n long")
    return found.groupBy("host", "line").agg((F.coalesce(F.sum(F.when(F.col("doc").isNull(), F.col("n"))), F.lit(0)) + F.count_distinct("doc")).alias("n"))


def frequent_lines(rows: DataFrame, share: float = LINE_SHARE, least: int = LINE_DOCUMENTS) -> DataFrame:
    """The (host, line) pairs above their host's limit, max(least, share x the host's documents)."""
    ids = written(rows.groupBy("host", "doc_id").agg(F.count("*").alias("rows")), "ids")
    repeated = ids.where("rows > 1 and doc_id is not null").select(F.xxhash64("host", "doc_id").alias("h"))
    hosts = ids.groupBy("host").agg(F.sum(F.when(F.col("doc_id").isNull(), F.col("rows")).otherwise(1)).alias("docs"))
    counted = line_counts(rows, repeated).where(F.col("n") > least)
    found = written(counted.join(hosts, "host").where(F.col("n") > share * F.col("docs")).select("host", "line"), "frequent-lines")
    discard(ids)
    return found


_CUT = "doc_id long, text string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, removed_words long, removed_lines array<int>"
_KEY = ["k1", "k2"]


def _removed(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """(k1, k2, gone): by content key of ``rows``, number and words of each line that is frequent in its host."""
    filt = rows.sparkSession.sparkContext.broadcast(Filter.of(frequent, "line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, hosts = (batch.column(c).to_numpy(zero_copy_only=False) for c in (*_KEY, "host"))
            for block in S.blocks(batch.column("text")):
                lines = _Lines(block, S.words(block, S.NON_SPACE))
                some = filt.value.has(lines.normal)
                row = block.first + lines.row[some]
                columns = [k1[row], k2[row], hosts[row], lines.normal[some], lines.at[some].astype(np.int32), lines.words[some].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [*_KEY, "host", "line", "at", "words"])

    lines = rows.select(*_KEY, "host", "text").mapInArrow(run, "k1 long, k2 long, host long, line long, at int, words long")
    return lines.join(frequent, ["host", "line"]).groupBy(*_KEY).agg(F.collect_set(F.struct("at", "words")).alias("gone"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = LINE_SHARE, least: int = LINE_DOCUMENTS, left: float = LEAST_LEFT) -> DataFrame:
    """One row per row of ``docs``: id, the text without its frequent lines, counts of the base rules, removed_words, removed_lines, base_failed, kept.

    Counts are of the whole text; removed_lines are numbers of lines in it, from 0.  Null text
    has no words and fails; null hosts form one host; rows of one id are one document for line
    frequencies and judged each on its own; an empty table gives none.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(host_col).cast("string"), F.lit("\0"))).alias("host"))
    frequent = frequent_lines(rows, share, least)
    keyed = rows.select("*", F.xxhash64("host", "doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id", "host").alias("k2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = batch.column("text"), batch.column("gone")
            for block in S.blocks(texts):
                w = S.words(block, S.NON_SPACE)
                m = _metrics(block, w, _Lines(block, w))
                part = slice(block.first, block.first + block.n)
                cut, words, numbers = [], [], []
                for text, lost in zip(texts[part], gone[part].to_pylist(), strict=True):
                    at = {x["at"]: x["words"] for x in lost or ()}
                    cut.append("\n".join(x for i, x in enumerate(text.as_py().split("\n")) if i not in at) if at else text.as_py())
                    words.append(sum(at.values()))
                    numbers.append(sorted(at))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[part], pa.array(cut, pa.string()), *(pa.array(x.astype(np.int64)) for x in m.values()), pa.array(words, pa.int64()), pa.array(numbers, pa.list_(pa.int32()))],
                    ["doc_id", "text", *m, "removed_words", "removed_lines"],
                )

    gone = written(_removed(keyed, frequent), "gone")
    cut = mapped_apart(keyed.select("doc_id", "text", *_KEY), gone, "k1", "gone", run, _CUT, _KEY)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    depleted = F.col("n_words") - F.col("removed_words") < F.lit(left) * F.col("n_words")
    return cut.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
