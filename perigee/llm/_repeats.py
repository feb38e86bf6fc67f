"""What the two substring operators share: pieces of windows by anchor, and spans of documents.

A window (of 400 bytes, or of 35 words) is assigned to its least k-mer, its anchor.  Runs of
windows with one anchor form pieces.  Equal windows have equal anchors, so

- an anchor that occurs once has no repeated window,
- an anchor whose pieces are all equal has only repeated windows,
- the pieces of other anchors ("mixed": the ends of repeats, and texts that go on with a short
  period) are settled window by window.

Nothing per window is shuffled before that.  Map tasks add up equal pieces first; anchors pass
through filters of bounded size and then an exact join.  Pieces count as equal where both their
anchors' hashes and the BLAKE2b digests of their contents agree.  Rows are named by a hash of id and text,
so rows that repeat in full share their name and their result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.llm import _seq as S
from perigee.llm._spark import Filter, discard, lean, written


@dataclass(frozen=True)
class Unit:
    """How texts are cut: window and k-mer length, the symbols of a block, digests of pieces, what of a piece is kept to settle it."""

    width: int
    k: int
    symbols: Callable[[S.Block], tuple[np.ndarray, np.ndarray, object]]  # symbols' hashes, rows' firsts, context
    quick: Callable[[object, np.ndarray, np.ndarray], np.ndarray]  # context, lo, hi; tells unequal pieces of an anchor
    content: Callable[[object, np.ndarray, np.ndarray], np.ndarray]  # the same; stands for what a piece holds
    payload: Callable[[object, int, int], bytes]  # context, lo, hi
    ends: Callable[[object, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None  # context, lo, hi


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumn("key", F.xxhash64("doc_id", "text"))


def _group(anchor: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and count of each distinct (anchor, content)."""
    order = np.lexsort((content, anchor))
    new = np.ones(len(order), bool)
    new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (content[order][1:] != content[order][:-1])
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order)))


def repeated_anchors(rows: DataFrame, unit: Unit) -> DataFrame:
    """(anchor, mixed) of the anchors that occur at two places at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for block in S.blocks(batch.column("text")):
                p, _, context = unit_pieces(block, unit)
                got.append((p.anchor, unit.quick(context, p.lo, p.hi), p.places))
            if not got:
                continue
            anchor, content, places = (np.concatenate(x) for x in zip(*got, strict=True))
            first, count = _group(anchor, content)
            columns = [S.signed(anchor[first]), content[first], (count * places[first]).astype(np.int32), places[first].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor", "content", "n", "places"])

    counted = rows.select("text").mapInArrow(lean(run), "anchor long, content long, n int, places int")
    grouped = counted.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi"), F.max("places").alias("places"))
    return grouped.where("n > 1").select("anchor", ((F.col("lo") != F.col("hi")) | (F.col("places") > 1)).alias("mixed"))


def unit_pieces(block: S.Block, unit: Unit) -> tuple[S.Pieces, np.ndarray, object]:
    symbols, first, context = unit.symbols(block)
    return S.pieces(symbols, first, unit.width, unit.k), first, context


_PLACED = "key long, lo int, hi int, anchor long, content long, tail long, head long"


def placed_pieces(rows: DataFrame, anchors: DataFrame, unit: Unit) -> DataFrame:
    """(key, lo, hi, anchor, content, tail, head, mixed) of the pieces with repeated anchors; lo and hi count in their text.

    tail and head are what the unit says of a piece's ends, else null.
    """
    filt = rows.sparkSession.sparkContext.broadcast(Filter.of(anchors, "anchor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for block in S.blocks(batch.column("text")):
                p, first, context = unit_pieces(block, unit)
                some = np.flatnonzero(filt.value.has(p.anchor))
                row = p.row[some]
                base = first[row]
                ends = [pa.array(x) for x in unit.ends(context, p.lo[some], p.hi[some])] if unit.ends else [pa.nulls(len(some), pa.int64())] * 2
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[block.first + row]),
                        pa.array((p.lo[some] - base).astype(np.int32)),
                        pa.array((p.hi[some] - base).astype(np.int32)),
                        pa.array(S.signed(p.anchor[some])),
                        pa.array(unit.content(context, p.lo[some], p.hi[some])),
                        *ends,
                    ],
                    ["key", "lo", "hi", "anchor", "content", "tail", "head"],
                )

    return rows.select("key", "text").mapInArrow(lean(run), _PLACED).join(anchors, "anchor")


def mixed_contents(rows: DataFrame, anchors: DataFrame, unit: Unit) -> DataFrame:
    """(anchor, content, n, payload): the distinct pieces of mixed anchors, how often each occurs, and its payload."""
    mixed = anchors.where("mixed").select("anchor")
    filt = rows.sparkSession.sparkContext.broadcast(Filter.of(mixed, "anchor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[int, int], list] = {}
            for block in S.blocks(batch.column("text")):
                p, _, context = unit_pieces(block, unit)
                some = np.flatnonzero(filt.value.has(p.anchor))
                if not len(some):
                    continue
                anchor, content = S.signed(p.anchor[some]), unit.content(context, p.lo[some], p.hi[some])
                first, count = _group(anchor, content)
                for a, c, i, n in zip(anchor[first].tolist(), content[first].tolist(), some[first].tolist(), count.tolist(), strict=True):
                    if (a, c) in seen:
                        seen[a, c][0] += n
                    else:
                        seen[a, c] = [n, unit.payload(context, int(p.lo[i]), int(p.hi[i]))]
            if seen:
                keys = np.array(list(seen), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.binary())],
                    ["anchor", "content", "n", "payload"],
                )

    found = rows.select("text").mapInArrow(lean(run), "anchor long, content long, n long, payload binary")
    return found.groupBy("anchor", "content").agg(F.sum("n").alias("n"), F.first("payload").alias("payload")).join(mixed, "anchor", "left_semi")


def ranges_of(sorted_: Column) -> Column:
    """Neighbouring integers of a sorted array as ranges (lo, hi), both included."""
    none = F.expr("cast(array() as array<struct<lo:int,hi:int>>)")

    def grow(acc: Column, i: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["lo"].alias("lo"), i.alias("hi"))))
        return F.when((F.size(acc) > 0) & (last["hi"] == i - 1), joined).otherwise(F.concat(acc, F.array(F.struct(i.alias("lo"), i.alias("hi")))))

    return F.aggregate(sorted_, none, grow)


def removal_spans(placed: DataFrame, settled: DataFrame, width: int) -> DataFrame:
    """(key, spans): what to remove, in symbols of the text, sorted and disjoint.

    ``settled`` has (anchor, content, ranges) for mixed pieces: which of their windows, counted
    from the piece's first, are repeated; contents without any are absent.
    """
    whole = placed.where("not mixed").select("key", F.col("lo"), (F.col("hi") + F.lit(width)).alias("hi"))
    part = placed.where("mixed").select("key", "lo", "anchor", "content").join(settled, ["anchor", "content"]).select("key", "lo", F.explode("ranges").alias("r"))
    part = part.select("key", (F.col("lo") + F.col("r.lo")).alias("lo"), (F.col("lo") + F.col("r.hi") + F.lit(width)).alias("hi"))
    return merged(whole.unionByName(part))


def merged(spans: DataFrame) -> DataFrame:
    """Touching and overlapping (lo, hi) of each key become one; streamed, so a text with very many is no burden."""
    dealt = spans.repartition("key").sortWithinPartitions("key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the batch's last key may go on in the next batch
        for batch in batches:
            key, lo, hi = (batch.column(c).to_numpy().astype(np.int64) for c in ("key", "lo", "hi"))
            if held is not None:
                key, lo, hi = (np.concatenate([[h], x]) for h, x in zip(held, (key, lo, hi), strict=True))
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            group = np.cumsum(new) - 1
            shift = group * (int(hi.max()) + 1)
            reach = np.maximum.accumulate(hi + shift)
            new[1:] |= (lo + shift)[1:] > reach[:-1]
            at = np.flatnonzero(new)
            end = np.append(at[1:], len(key)) - 1
            out = key[at], lo[at], reach[end] - shift[end]
            held = tuple(int(x[-1]) for x in out)
            if len(at) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(x[:-1]) for x in out], ["key", "lo", "hi"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in held], ["key", "lo", "hi"])

    one = dealt.mapInArrow(lean(run), "key long, lo long, hi long")
    return one.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def repeat_spans(rows: DataFrame, unit: Unit, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, spans), written, of all windows of ``rows`` (key, text) that start at two places at least."""
    anchors = written(repeated_anchors(rows, unit), "anchors")
    settled = written(settle(mixed_contents(rows, anchors, unit)), "settled")
    spans = written(removal_spans(placed_pieces(rows, anchors, unit), settled, unit.width), "spans")
    discard(anchors, settled)
    return spans
