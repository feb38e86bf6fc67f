"""Benchmark decontamination with suffix arrays over the training text.

Each map task cuts its rows into shards of whole documents, sorts the shard's word suffixes
(prefix doubling over word ranks, to :data:`DEPTH` words) and binary-searches every suffix of
every test item in it: the range of training suffixes that begin with the window from there
gives all its occurrences, and longer matches are extended word by word.  What a window hits is
confirmed on the bytes.  Test items are the stated query set: they go to the tasks in blocks of
bounded size, one pass over the documents for each block; training text is never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.llm import _seq as S
from perigee.llm._spark import lean, written

WINDOW = 13
#: Words to which a shard's suffixes are sorted; at least a window.
DEPTH = 16
#: Bytes of training text in a shard, and of test items in one block.
SHARD_BYTES, ITEM_BYTES = 2 << 20, 8 << 20
#: A document is contaminated when at least one word in so many is hit.
ONE_IN = 20


@dataclass
class Items:
    """A block of test items: words as hashes, and the distinct windows among their suffixes."""

    ids: list[str]
    words: np.ndarray  # hashes of all items' words, one after another
    text: list[bytes]
    start: np.ndarray  # of each distinct window, in words
    size: np.ndarray
    left: np.ndarray  # words from the window's start to its item's end
    owner: list[np.ndarray]  # items that have the window


def pack(rows: list[tuple[str, str | None]]) -> Items:
    """Windows of (item_id, text): 13 words from every place, or a whole shorter item."""
    column = pa.array([t or "" for _, t in rows], pa.string())
    hashes, text, where = [], [], []
    base = 0
    for block in S.blocks(column, 1 << 62):
        low = S.LOWER[block.data]
        w = S.words(block, S.ALNUM, low)
        hashes.append(w.hash)
        raw = low.tobytes()
        text += [raw[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
        for i in range(block.n):
            a, b = int(w.first[i]), int(w.first[i + 1])
            for at in range(a, max(a + 1, b - WINDOW + 1)) if b > a else ():
                where.append((base + at, min(WINDOW, b - a), base + b - at, block.first + i))
        base += w.n
    groups: dict[tuple[bytes, ...], list[tuple[int, int, int, int]]] = {}
    for x in where:
        groups.setdefault(tuple(text[x[0] : x[0] + x[1]]), []).append(x)
    first = [max(g, key=lambda x: x[2]) for g in groups.values()]
    return Items(
        [i for i, _ in rows],
        np.concatenate(hashes) if hashes else np.zeros(0, np.uint64),
        text,
        np.array([x[0] for x in first], np.int64),
        np.array([x[1] for x in first], np.int64),
        np.array([x[2] for x in first], np.int64),
        [np.unique([x[3] for x in g]) for g in groups.values()],
    )


class Shard:
    """The suffix array of a shard's words.  Rows are parted by symbol 0, which is no word's rank."""

    def __init__(self, w: S.Words):
        self.w = w
        n = w.n
        self.at = np.arange(n) + w.row  # place in the parted sequence: one 0 after each row
        self.alphabet, ranks = np.unique(w.hash, return_inverse=True)
        size = n + len(w.first) - 1 + DEPTH
        self.seq = np.zeros(size, np.int64)
        self.seq[self.at] = ranks + 1
        self.place = np.full(size, -1, np.int64)
        self.place[self.at] = np.arange(n)
        rank, step = self.seq, 1
        while step < DEPTH:
            ahead = np.zeros(size, np.int64)
            ahead[:-step] = rank[step:]
            key = rank * (size + 1) + ahead
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.empty(size, np.int64)
            new[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            new[rank == 0] = 0
            rank, step = new, 2 * step
        sa = np.argsort(rank, kind="stable")
        self.sa = sa[np.searchsorted(rank[sa], 1) :] if n else sa[:0]  # suffixes that start with a word

    def search(self, words: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For many patterns words[start:start+size] at once, the range of suffixes that begin with each."""
        out = [np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)]
        slot = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        known = self.alphabet[slot] == words
        missing = np.concatenate([[0], np.cumsum(~known)])
        ok = np.flatnonzero(missing[start] == missing[start + size])  # a pattern with an unknown word occurs nowhere
        for at in range(0, len(ok), 1 << 15):
            self._ranges(slot + 1, start, size, ok[at : at + (1 << 15)], out)
        return out[0], out[1]

    def _ranges(self, words: np.ndarray, start: np.ndarray, size: np.ndarray, ok: np.ndarray, out: list[np.ndarray]) -> None:
        inside = np.arange(DEPTH) < size[ok, None]
        want = words[np.minimum(start[ok, None] + np.arange(DEPTH), len(words) - 1)]
        rows = np.arange(len(ok))
        for side in (0, 1):
            lo, hi = np.zeros(len(ok), np.int64), np.full(len(ok), len(self.sa))
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                have = self.seq[self.sa[np.minimum(mid, len(self.sa) - 1)][:, None] + np.arange(DEPTH)]
                diff = (have != want) & inside
                first = diff.argmax(1)
                sign = np.where(diff.any(1), np.sign(have[rows, first] - want[rows, first]), 0)
                right = open_ & ((sign < 0) | ((sign == 0) & (side == 1)))
                lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
            out[side][ok] = lo


@dataclass
class Hits:
    """Occurrences of windows in a shard: the word where each begins, the window, and the longest match from there."""

    word: np.ndarray
    window: np.ndarray
    longest: np.ndarray


def occurrences(shard: Shard, items: Items, data: bytes) -> Hits:
    none = np.zeros(0, np.int64)
    if not len(shard.sa) or not len(items.start):
        return Hits(none, none, none)
    lo, hi = shard.search(items.words, items.start, items.size)
    count = hi - lo
    window = np.repeat(np.arange(len(lo)), count)
    at = shard.sa[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    word = shard.place[at]
    longest = items.size[window].copy()
    w = shard.w
    live = np.arange(len(window))
    while len(live):  # one more word for those that still match
        p, q = word[live] + longest[live], longest[live]
        more = (p < w.first[w.row[word[live]] + 1]) & (q < items.left[window[live]])
        live = live[more]
        p, q = word[live] + longest[live], items.start[window[live]] + longest[live]
        live = live[w.hash[p] == items.words[q]]
        longest[live] += 1
    sure = np.ones(len(window), bool)
    texts = items.text
    for i in range(len(window)):  # confirm on the bytes
        a, s, m = word[i], items.start[window[i]], items.size[window[i]]
        sure[i] = all(data[w.start[a + j] : w.end[a + j]] == texts[s + j] for j in range(m))
    return Hits(word[sure], window[sure], longest[sure])


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Items]:
    """The query set in blocks of bounded size, so that no more than one is on the driver."""
    rows, size = [], 0
    chosen = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    for r in chosen.toLocalIterator(prefetchPartitions=False):
        rows.append((r["i"], r["t"]))
        size += len(r["t"] or "") + 16
        if size >= ITEM_BYTES:
            yield pack(rows)
            rows, size = [], 0
    if rows:
        yield pack(rows)


_FOUND = "`__n_words` long, `__hits` array<struct<lo:int,hi:int>>, `__items` array<string>, `__longest` long"


def _pass(docs: DataFrame, items: Items, text_col: str) -> DataFrame:
    """``docs`` with what one block of items hits; hits of earlier blocks, if any, are kept."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(items)
    again = "__hits" in docs.columns
    base = [c for c in docs.columns if c not in ("__n_words", "__hits", "__items", "__longest")]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in base), _FOUND])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        for batch in batches:
            n_words, spans, names, longest = [], [], [], []
            for block in S.blocks(batch.column(text_col), SHARD_BYTES):
                low = S.LOWER[block.data]
                w = S.words(block, S.ALNUM, low)
                hits = occurrences(Shard(w), items, low.tobytes())
                cover = np.zeros(w.n + 1, np.int64)
                np.add.at(cover, hits.word, 1)
                np.add.at(cover, hits.word + items.size[hits.window] if len(hits.word) else hits.word, -1)
                depth = np.cumsum(cover[:-1]) > 0
                start, end = S.runs(depth, w.first) if w.n else (hits.word, hits.word)
                row_of = w.row[start] if len(start) else start
                listed: list[list] = [[] for _ in range(block.n)]
                for r, a, b in zip(row_of.tolist(), start.tolist(), end.tolist(), strict=True):
                    listed[r].append({"lo": a - int(w.first[r]), "hi": b - int(w.first[r])})
                got: list[set] = [set() for _ in range(block.n)]
                most = [0] * block.n
                for r, k in set(zip(w.row[hits.word].tolist(), hits.window.tolist(), strict=True)):
                    got[r].update(items.owner[k].tolist())
                for r, n in zip(w.row[hits.word].tolist(), hits.longest.tolist(), strict=True):
                    most[r] = max(most[r], n)
                n_words += np.diff(w.first).tolist()
                spans += listed
                names += [sorted({items.ids[k] for k in g}) for g in got]
                longest += most
            if again:
                spans = [_merge(a, b) for a, b in zip(spans, batch.column("__hits").to_pylist(), strict=True)]
                names = [sorted({*a, *b}) for a, b in zip(names, batch.column("__items").to_pylist(), strict=True)]
                longest = [max(a, b) for a, b in zip(longest, batch.column("__longest").to_pylist(), strict=True)]
            span_kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in base), pa.array(n_words, pa.int64()), pa.array(spans, span_kind), pa.array(names, pa.list_(pa.string())), pa.array(longest, pa.int64())],
                [*base, "__n_words", "__hits", "__items", "__longest"],
            )

    return docs.mapInArrow(lean(run), schema)


def _merge(a: list[dict], b: list[dict]) -> list[dict]:
    out: list[dict] = []
    for x in sorted([*a, *b], key=lambda x: (x["lo"], x["hi"])):
        if out and x["lo"] <= out[-1]["hi"]:
            out[-1]["hi"] = max(out[-1]["hi"], x["hi"])
        else:
            out.append(dict(x))
    return out


def match(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with __n_words, __hits (word ranges), __items (ids, sorted as strings) and __longest (words)."""
    out, blocks = docs, 0
    for items in item_blocks(benchmark, item_col, item_text_col):
        out = _pass(written(out, "decontaminated") if blocks else out, items, text_col)
        blocks += 1
    return out if blocks else _pass(docs, pack([]), text_col)


def contaminated() -> tuple:
    hit = F.aggregate("__hits", F.lit(0).cast("long"), lambda s, x: s + x["hi"] - x["lo"])
    return hit, (hit > 0) & (ONE_IN * hit >= F.col("__n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated rows, with the same columns.

    A null or wordless text has nothing to hit and stays; an empty benchmark leaves all rows;
    repeated rows are judged alike; columns of any name are passed on.
    """
    _, bad = contaminated()
    return match(docs, benchmark, text_col).where(~bad).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = match(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit, bad = contaminated()
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"),
        bad.alias("contaminated"),
    )


_WORD_LIST = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_WORD_LIST} AS w FROM documents),
b AS (SELECT item_id, {_WORD_LIST} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win, least(13, len(w)) AS m
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT m FROM bw),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
h AS (
  SELECT p.doc_id, p.i, s.m, bw.item_id
  FROM p JOIN sizes s ON p.i + s.m - 1 <= len(p.w)
  JOIN bw ON bw.m = s.m AND bw.win = array_to_string(p.w[p.i : p.i + s.m - 1], ' ')
),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
