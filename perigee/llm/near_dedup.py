"""Near-duplicate documents: MinHash bands for candidates, odd sketches to verify, full sets to confirm.

A document's set holds the hashes of its distinct five-word shingles.  Rows of equal word
sequences form a class (told by a 128-bit digest), and one node stands for it; only nodes go on.
Of each, 128 MinHash samples give 32 bands of 4 (two sets of similarity 0.75 share none with a
chance of 5e-6).  Another 2048 samples, the least hashes of a partition of the set, are folded
into an odd sketch, a parity bitmap of 2048 bits: the population count of two sketches' XOR tells
how many samples differ.  A pair fails only if it differs by 4.5 deviations more than a pair of
similarity 0.75 does on average, so sketches part high similarities closely.

Buckets are never turned into all their pairs.  In each round every bucket names a centre, a
member chosen by a hash of bucket and round, and members of other components are held against
it by sketch; of the centres that pass, a member's closest is confirmed on the full sets, and
components are formed anew.  Near copies share many buckets, so each meets many centres, and a
large group falls into one component in a round or two.  What a last pass then tests, in full,
are pairs of different components of one bucket, under the sketches' condition within the join.
So no candidate pair is left untested unless its documents are already in one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.llm import _seq as S
from perigee.llm._spark import Filter, discard, lean, written
from perigee.llm.components import components

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: Samples folded into a sketch (the bins of the partition), and its bits.
BINS, SKETCH_BITS = 2048, 2048
#: Deviations beyond the mean of a pair just similar enough that a sketch still passes.
SLACK = 4.5
#: Rounds of centres before the last pass.
ROUNDS = 2
_rng = np.random.Generator(np.random.PCG64(75128))
_MULTIPLIERS = _rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(block: S.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle) of a block's distinct shingles, by row; and digests of each row's word sequence."""
    data = S.LOWER[block.data]
    w = S.words(block, S.NON_SPACE, data)
    count = np.diff(w.first)
    at = np.flatnonzero(w.row[: max(0, w.n - SHINGLE + 1)] == w.row[SHINGLE - 1 :]) if w.n >= SHINGLE else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    start = np.concatenate([at, w.first[:-1][short]])
    end = np.concatenate([at + SHINGLE, w.first[1:][short]])
    row = np.concatenate([w.row[at], short])
    order = np.argsort(row, kind="stable")
    row, x = row[order], S.span_hash(w.hash, start[order], end[order])
    _, first = np.unique(S.mix(x ^ S.mix(row.astype(np.uint64) + np.uint64(1))), return_index=True)
    first.sort()
    text, place = S.squeezed(data, w, S.NON_SPACE)
    return row[first], x[first], S.digests(text, place[w.first[:-1]], place[w.first[1:]], 16)


def _samples(row: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have shingles, and their MinHash samples."""
    rows, first = np.unique(row, return_index=True)
    small = (x >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(rows), SAMPLES), np.uint32)
    if len(rows):
        for i, a in enumerate(_MULTIPLIERS):
            np.minimum.reduceat(small * a, first, out=out[:, i])
    return rows, out


def odd_sketch(row: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmaps of each row's (bin, least hash) samples as 64-bit words, and how many bins have one."""
    h = S.mix(x ^ np.uint64(0x6A09E667F3BCC909))
    place = row * BINS + (h >> np.uint64(53)).astype(np.int64)
    low = h & np.uint64((1 << 53) - 1)
    order = np.lexsort((low, place))
    place, low = place[order], low[order]
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1]
    place, low = place[first], low[first]
    slot = (S.mix(low + (place % BINS).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    which = place // BINS
    place, count = np.unique(which * SKETCH_BITS + slot, return_counts=True)
    odd = place[count % 2 == 1]
    words = np.zeros(n * (SKETCH_BITS // 64), np.uint64)
    np.bitwise_or.at(words, odd >> 6, np.uint64(1) << (odd & 63).astype(np.uint64))
    return words.view(np.int64).reshape(n, -1), np.bincount(which, minlength=n)


def bands(samples: np.ndarray) -> np.ndarray:
    parts = samples.reshape(len(samples), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for i in range(ROWS):
        key = S.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.view(np.int64)


_SIGNED = "doc_id long, n_shingles long, c1 long, c2 long, bands array<long>, sketch array<long>, bins long"


def signatures(docs: DataFrame) -> DataFrame:
    """Of (doc_id, text): set size, class key (a digest of the word sequence), band keys, sketch and its samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in S.blocks(batch.column("text")):
                row, x, keys = shingles(block)
                n = np.bincount(row, minlength=block.n)
                rows, samples = _samples(row, x)
                lists = []
                sketch, bins = odd_sketch(row, x, block.n)
                for values, width in ((bands(samples), BANDS), (sketch[rows], SKETCH_BITS // 64)):
                    size = np.zeros(block.n + 1, np.int32)
                    size[rows + 1] = width
                    lists.append(pa.ListArray.from_arrays(pa.array(np.cumsum(size, dtype=np.int32)), pa.array(values.reshape(-1))))
                part = slice(block.first, block.first + block.n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[part], pa.array(n.astype(np.int64)), *(pa.array(np.ascontiguousarray(keys[:, i])) for i in (0, 1)), *lists, pa.array(bins.astype(np.int64))],
                    ["doc_id", "n_shingles", "c1", "c2", "bands", "sketch", "bins"],
                )

    return docs.mapInArrow(lean(run), _SIGNED)


_CLASS = ["c1", "c2"]


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, items) of the nodes in ``wanted`` (node, c1, c2, cid); other documents are left out before the shuffle."""
    filt = docs.sparkSession.sparkContext.broadcast(Filter.of(wanted.select(F.xxhash64("cid").alias("h")), "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(filt.value.has(batch.column("h").to_numpy())))
            for block in S.blocks(batch.column("text")):
                row, x, keys = shingles(block)
                offsets = np.searchsorted(row, np.arange(block.n + 1)).astype(np.int32)
                part = slice(block.first, block.first + block.n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cid")[part], *(pa.array(np.ascontiguousarray(keys[:, i])) for i in (0, 1)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(S.signed(x)))], ["cid", "c1", "c2", "items"]
                )

    rows = docs.select(F.col("doc_id").alias("cid"), "text").where("cid is not null").withColumn("h", F.xxhash64("cid"))
    found = rows.mapInArrow(lean(run), "cid long, c1 long, c2 long, items array<long>")
    return found.join(wanted, ["cid", *_CLASS]).select("node", "items").dropDuplicates(["node"])  # a row may be there twice


def _different(a: str, b: str) -> Column:
    """Bits in which two sketches differ, within generated code."""
    return sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))


def most_bits(size: Column, samples: Column) -> Column:
    """Bits that may differ in a pair of ``size`` shingles and ``samples`` samples together.

    For sets just similar enough, the union has size / (1 + j) shingles; ``held`` bins of the
    partition have a least hash of it, a draw without replacement, and j of them agree.  The
    samples that don't are as many flips, which leave fewer odd bits the more there are.
    """
    j, m, s = PERCENT / 100, float(BINS), float(SKETCH_BITS)
    union = size / F.lit(1 + j)
    held = m * (1 - F.exp(union * float(np.log1p(-1 / m))))
    flips = F.greatest(samples - 2 * j * held, F.lit(0.0))
    drawn = 4 * j * (1 - j) * held * (union - held) / F.greatest(union, F.lit(1.0))
    filled = m * F.exp(-union / m) * (1 - (1 + union / m) * F.exp(-union / m))
    blurred = s / 4 * (F.exp(flips * (4 / s)) - 1) - flips
    most = flips + SLACK * F.sqrt(F.greatest(drawn + 0.4 * filled + blurred, F.lit(0.0))) + 1
    return F.lit(s / 2) * (1 - F.exp(most * float(np.log1p(-2 / s))))


def _sizes(a: Column, b: Column) -> Column:
    return (100 * a >= PERCENT * b) & (100 * b >= PERCENT * a)


def _alike(a: str, b: str) -> Column:
    """The sketches' verdict on two structs (node, n, bins, sketch), after that of the sets' sizes."""
    n = lambda x: F.col(f"{x}.n")
    return _sizes(n(a), n(b)) & (_different(a, b) <= most_bits(n(a) + n(b), F.col(f"{a}.bins") + F.col(f"{b}.bins")))


def confirm(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough, as a written table."""
    pairs = written(pairs, "pairs")
    if pairs.isEmpty():  # the texts need not be read
        return pairs
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = written(ends.join(classes, "node"), "pair-ends")
    sets = written(sets_of(docs, wanted), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    found = pairs.join(right, "b").join(left, "a").withColumn("x", both)
    links = written(found.where(100 * F.col("x") >= PERCENT * (F.size("sa") + F.size("sb") - F.col("x"))).select("a", "b"), "links")
    discard(pairs, wanted, sets)
    return links


def _labelled(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """Buckets that hold two components or more, each member with its component c."""
    label = buckets.join(found.select(F.col("id").alias("node"), "component"), "node", "left").select("key", "i", "node", "n", F.coalesce("component", "node").alias("c"))
    open_ = label.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    return label.join(open_, "key")


def _round(r: int, label: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b): for members of a bucket outside its centre's component the closest centre that passes."""
    rank = F.xxhash64("key", "node", F.lit(r))
    centre = label.groupBy("key").agg(*(F.min_by(x, rank).alias(f"_{x}") for x in ("node", "n", "c")))
    stars = label.join(centre, "key").where((F.col("c") != F.col("_c")) & _sizes(F.col("n"), F.col("_n"))).select(F.col("_node").alias("a"), F.col("node").alias("b")).distinct()
    near = (
        stars.join(sketches.select(F.col("node").alias("b"), F.col("x").alias("xb")), "b")
        .join(sketches.select(F.col("node").alias("a"), F.col("x").alias("xa")), "a")
        .where(_alike("xa", "xb"))
        .select("a", "b", _different("xa", "xb").alias("bits"))
    )
    return near.groupBy("b").agg(F.min_by("a", "bits").alias("a")).select("a", "b")


def _across(label: DataFrame, heads: DataFrame) -> DataFrame:
    """(a, b): pairs of different components of a bucket whose sketches pass, each once."""
    rest = label.join(heads.select("node", "x", "words"), "node")
    left = rest.select("key", "i", F.col("c").alias("ca"), F.col("x").alias("xa"), F.col("words").alias("wa"))
    right = rest.select("key", F.col("c").alias("cb"), F.col("x").alias("xb"), F.col("words").alias("wb"))
    first = F.coalesce(*[F.when(F.col("wa")[k] == F.col("wb")[k], k) for k in range(BANDS)])  # a pair counts in the first bucket that it shares
    apart = (F.col("ca") < F.col("cb")) & (first == F.col("i")) & _alike("xa", "xb")
    return left.join(right, "key").where(apart).select(F.col("xa.node").alias("a"), F.col("xb.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts that are null or have no words are linked with nothing.  Rows of one id are one
    document: alike they are judged alike, and different texts under one id are linked by it.
    Null ids keep their null, are linked with nothing and kept.  An empty table gives none.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(signatures(base).withColumn("uid", F.monotonically_increasing_id()), "signatures")
    is_live = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    live = signed.where(is_live)
    classes = written(live.groupBy(*_CLASS).agg(F.min("uid").alias("node"), F.min("doc_id").alias("cid")), "classes")
    members = written(live.select("doc_id", "n_shingles", *_CLASS).join(classes, _CLASS).select("doc_id", "n_shingles", "node", "cid"), "members")
    words = F.transform("bands", lambda k: F.shiftright(k, 32).cast("int"))
    x = F.struct("node", F.col("n_shingles").alias("n"), "bins", "sketch")
    heads = written(live.withColumnRenamed("uid", "node").join(classes.select("node"), "node", "left_semi").select("node", "bands", words.alias("words"), x.alias("x")), "heads")
    dealt = heads.select("node", F.col("x.n").alias("n"), F.posexplode("bands").alias("i", "key"))
    shared = dealt.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    buckets = written(dealt.join(shared, "key"), "buckets")  # only keys that two nodes share

    sketches = heads.select("node", "x")
    several = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    links = [written(members.select("doc_id", F.col("node").alias("b")).join(several, "doc_id").where("a <> b").select("a", "b").distinct(), "links")]  # texts that share an id
    found = components(links[0])
    for r in range(rounds + 1):
        label = _labelled(buckets, found)
        links.append(confirm(_round(r, label, sketches) if r < rounds else _across(label, heads), base, classes))
        before, found = found, components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links[-1]))
        discard(before)

    # a component's name is its least id
    root = found.select(F.col("id").alias("node"), F.col("component").alias("root"))
    root = root.union(root.select(F.col("root").alias("node"), "root").distinct())
    least = root.join(classes.select("node", "cid"), "node").groupBy("root").agg(F.min("cid").alias("component"))
    named = written(root.join(least, "root").select("node", "component"), "components")
    discard(found, heads, buckets, classes, *links)
    joined = members.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "cid").alias("component_id"))
    rest = signed.where(~F.coalesce(is_live, F.lit(False))).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
