"""Ranked lexical search: MaxScore over the posting lists of each shard.

``index`` packs whole documents into shards, a row each: a dictionary of terms, posting lists of
(document, occurrences), and the documents' lengths.  A block of queries goes to all shards
twice: once for document frequencies, which Spark adds up, and once with the terms' weights.

In a shard, a query's lists have upper bounds, their largest contributions.  Lists whose bounds
add up to less than the query's current 20th score are non-essential: a document that is in none
but these can't qualify.  Essential lists are summed; the others are probed from the highest
bound down, for documents alone whose sum may still reach the threshold with all that is left.
A task carries its best documents and with them the threshold from shard to shard, and hands on
20 rows a query; two rankings, by task and query first, give the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perigee.llm import _seq as S
from perigee.llm._spark import written

TOP = 20
#: Bytes of text in a shard, and of queries sent at once.
SHARD_BYTES, QUERY_BYTES = 8 << 20, 4 << 20

_SHARD = "n_docs long, n_terms long, rows long, terms long, postings long, ids array<long>, lengths binary, keys binary, word_at binary, words binary, list_at binary, docs binary, times binary"


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _unpacked(x: bytes, kind: type, n: int) -> np.ndarray:
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(x, size, codec="zstd", asbytes=True) if size else b"", kind)


def index(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Shards of an inverted index over all rows; a row is a document, null text has no terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in S.shards(batches, "text", shard_bytes):
            hashes, docs, start, end, raw, base = [], [], [], [], [], 0
            for block in S.blocks(table.column("text")):
                low = S.LOWER[block.data]
                w = S.words(block, S.ALNUM, low)
                hashes.append(w.hash), docs.append((w.row + block.first).astype(np.int32))
                start.append(w.start + base), end.append(w.end + base), raw.append(low)
                base += len(low)
            hashes, docs, start, end, raw = (np.concatenate(x) for x in (hashes, docs, start, end, raw))
            lengths = np.bincount(docs, minlength=table.num_rows)
            order = np.argsort(hashes, kind="stable")  # documents stay in order within a term
            h, d = hashes[order], docs[order]
            other = np.ones(len(h), bool)
            other[1:] = h[1:] != h[:-1]
            entry = other.copy()
            entry[1:] |= d[1:] != d[:-1]
            at = np.flatnonzero(entry)
            term = np.flatnonzero(other)
            first = order[term]
            word_at = np.concatenate([[0], np.cumsum(end[first] - start[first])])
            words = S.gathered(raw, start[first], end[first]).buffers()[2]
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array([int(x)], pa.int64()) for x in ((lengths > 0).sum(), lengths.sum(), table.num_rows, len(term), len(at))),
                    pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column("doc_id").combine_chunks()),
                    *(pa.array([x], pa.binary()) for x in (
                        _packed(lengths.astype(np.int32)), _packed(h[term]), _packed(word_at.astype(np.int32)), bytes(words) if words else b"",
                        _packed(np.append(np.searchsorted(at, term), len(at)).astype(np.int32)), _packed(d[at]), _packed(np.diff(np.append(at, len(h))).astype(np.int32)))),
                ],
                [x.split()[0] for x in _SHARD.split(", ")],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, _SHARD)


@dataclass
class Queries:
    """A block of queries: distinct terms by hash, and each query's terms with how often it says them."""

    ids: list
    words: list[bytes]  # of the terms, in the order of their hashes
    keys: np.ndarray
    terms: list[np.ndarray]
    times: list[np.ndarray]
    weights: np.ndarray | None = None


def _pack(rows: list[tuple]) -> Queries:
    per_row: list[list[bytes]] = []
    known: dict[bytes, np.uint64] = {}
    for block in S.blocks(pa.array([t or "" for _, t in rows], pa.string())):
        low = S.LOWER[block.data]
        w = S.words(block, S.ALNUM, low)
        raw = low.tobytes()
        said = [raw[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
        known.update(zip(said, w.hash, strict=True))
        per_row += [said[w.first[i] : w.first[i + 1]] for i in range(block.n)]
    words = sorted(known, key=lambda x: (known[x], x))
    place = {x: i for i, x in enumerate(words)}
    counted = [np.unique(np.array([place[x] for x in said], np.int64), return_counts=True) for said in per_row]
    return Queries([i for i, _ in rows], words, np.array([known[x] for x in words], np.uint64), [x for x, _ in counted], [x for _, x in counted])


def query_blocks(queries: DataFrame, most: int = QUERY_BYTES) -> Iterator[Queries]:
    """The query set (id, text) in blocks of bounded size; the driver holds one at a time."""
    rows, size = [], 0
    for r in queries.toLocalIterator(prefetchPartitions=False):
        rows.append((r[0], r[1]))
        size += len(r[1] or "") + 16
        if size >= most:
            yield _pack(rows)
            rows, size = [], 0
    if rows:
        yield _pack(rows)


class _Lists:
    """The posting lists in a shard of the terms that a block of queries has."""

    def __init__(self, shard: dict, q: Queries):
        n_terms, n_postings = shard["terms"], shard["postings"]
        keys = _unpacked(shard["keys"], np.uint64, n_terms)
        self.slot = np.full(len(q.words), -1)
        if not n_terms:
            return
        at = np.minimum(np.searchsorted(keys, q.keys), n_terms - 1)
        word_at = _unpacked(shard["word_at"], np.int32, n_terms + 1)
        for i in np.flatnonzero(keys[at] == q.keys):  # a hash names the term, its bytes confirm it
            if shard["words"][word_at[at[i]] : word_at[at[i] + 1]] == q.words[i]:
                self.slot[i] = at[i]
        self.at = _unpacked(shard["list_at"], np.int32, n_terms + 1).astype(np.int64)
        self.docs, self.times = _unpacked(shard["docs"], np.int32, n_postings), _unpacked(shard["times"], np.int32, n_postings)

    def frequencies(self) -> np.ndarray:
        have = self.slot >= 0
        return np.where(have, self.at[self.slot + 1] - self.at[self.slot], 0) if have.any() else np.zeros(len(have), np.int64)


def _rows(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i] if c == "ids" else batch.column(c)[i].as_py() for c in columns}


_DICTIONARY = ("terms", "postings", "keys", "word_at", "words", "list_at", "docs", "times")


def document_frequencies(shards: DataFrame, q: Queries) -> np.ndarray:
    """How many documents hold each term of the block; counts are added within tasks and then by Spark."""
    sent = shards.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value.words), np.int64)
        for shard in _rows(batches, _DICTIONARY):
            total += _Lists(shard, sent.value).frequencies()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    out = np.zeros(len(q.words), np.int64)
    for r in shards.select(*_DICTIONARY).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # one row a term of the block
        out[r["term"]] = r["df"]
    return out


class _Best:
    """The ``top`` best (score, id) of a query; equal scores go by id, a null id last."""

    def __init__(self, top: int):
        self.top = top
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def threshold(self) -> int:
        """What a document has to reach; with an equal score its id may still be the smaller."""
        return max(1, int(self.score[-1])) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = np.concatenate([self.score, score]), np.concatenate([self.id, ids]), np.concatenate([self.null, null])
        order = np.lexsort((ids, null, -score))[: self.top]
        self.score, self.id, self.null = score[order], ids[order], null[order]


def max_score(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, best: _Best) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a shard that may be among the best, from lists of (documents, contributions)."""
    bound = np.array([int(c.max()) for _, c in lists], np.int64)
    order = np.argsort(bound, kind="stable")
    up_to = np.cumsum(bound[order])  # of the lists so far, the most that a document gets from them
    least = best.threshold
    spare = int(np.searchsorted(up_to, least, "left"))  # lists before it are non-essential
    none = np.zeros(0, np.int64)
    if spare == len(order):
        return none, none
    total = np.zeros(n_docs, np.int64)
    for k in order[spare:]:
        docs, worth = lists[k]
        total[docs] += worth
    live = np.flatnonzero(total)
    for i in range(spare - 1, -1, -1):
        if len(live) >= best.top:
            least = max(least, int(np.partition(total[live], len(live) - best.top)[len(live) - best.top]))
        live = live[total[live] + up_to[i] >= least]
        docs, worth = lists[order[i]]
        at = np.minimum(np.searchsorted(docs, live), len(docs) - 1)
        found = docs[at] == live
        total[live[found]] += worth[at[found]]
    live = live[total[live] >= least]
    return live, total[live]


def _ranked(shards: DataFrame, q: Queries, n_documents: int, n_terms: int, top: int, id_kind: str) -> DataFrame:
    """(item, item_id, task, doc_id, score): the best of each query in each task."""
    sent = shards.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        best = [_Best(top) for _ in q.ids]
        for shard in _rows(batches, (*_DICTIONARY, "rows", "lengths", "ids")):
            held = _Lists(shard, q)
            if not (held.slot >= 0).any():
                continue
            length = _unpacked(shard["lengths"], np.int32, shard["rows"]).astype(np.int64)
            m = 75 + (25 * length * n_documents) // n_terms
            tf = held.times.astype(np.int64)
            worth = (1_000_000_000 * tf) // (1000 * tf + 12 * m[held.docs])
            ids = shard["ids"].values
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for i, (terms, times) in enumerate(zip(q.terms, q.times, strict=True)):
                lists = []
                for t, n in zip(terms.tolist(), times.tolist(), strict=True):
                    s, w = held.slot[t], int(q.weights[t]) * n
                    if s >= 0 and w:
                        at = slice(held.at[s], held.at[s + 1])
                        lists.append((held.docs[at], w * worth[at]))
                if lists:
                    docs, score = max_score(lists, shard["rows"], best[i])
                    best[i].add(score, ids[docs], null[docs])
        some = [i for i in range(len(best)) if len(best[i].score)]
        if some:
            size = [len(best[i].score) for i in some]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(some, size).astype(np.int64)),
                    pa.array(np.concatenate([best[i].id for i in some]), mask=np.concatenate([best[i].null for i in some])),
                    pa.array(np.concatenate([best[i].score for i in some])),
                ],
                ["item", "doc_id", "score"],
            )

    spark = shards.sparkSession
    names = spark.createDataFrame([(i, x) for i, x in enumerate(q.ids)], f"item long, item_id {id_kind}")
    found = shards.select(*_DICTIONARY, "rows", "lengths", "ids").mapInArrow(run, "item long, doc_id long, score long")
    return found.withColumn("task", F.spark_partition_id()).join(F.broadcast(names), "item")  # names: a block of queries, bounded


def search(docs: DataFrame, queries: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank int, doc_id, score): each query's ``top`` documents with a score above 0.

    A row of ``docs`` is a document (rows that repeat rank one after another), null text has no
    terms, a null id comes last among equal scores.  Queries that repeat with id and text count
    once; one id with two texts is two queries.  Empty tables and queries without a term give no
    rows; other columns are ignored; texts of any length are read whole.
    """
    shards = written(index(docs, text_col, id_col), "lexical-index")
    n_documents, n_terms = (int(x or 0) for x in shards.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    chosen = queries.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).distinct()
    kind = chosen.schema["item_id"].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for q in query_blocks(chosen) if n_terms else ():
        df = document_frequencies(shards, q)
        q.weights = np.floor(1000 * np.log((2 * n_documents + 2) / (2 * df + 1))).astype(np.int64)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        parts = _ranked(shards, q, n_documents, n_terms, top, kind).withColumn("part", F.pmod("task", F.lit(64)))
        first = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= top)
        last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
        out = out.unionByName(last.select("item_id", "rank", "doc_id", "score"))
    return out


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * s.n_docs + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, s GROUP BY term, s.n_docs),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT q.item_id, tf.doc_id, CAST(sum(q.times * df.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * tf.n * s.n_docs) // s.n_terms)))) AS BIGINT) AS score
  FROM q JOIN df ON df.term = q.term JOIN tf ON tf.term = q.term, s GROUP BY q.item_id, tf.doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""
