"""Toxicity by a linear classifier that is regularised with counterfactuals.

A text's features are its words and the first 3 to 6 characters of each, by hash, present or
not.  Those that go with the label are chosen by a likelihood ratio from counts over the training
rows; a logistic model is fitted to them.  For each labelled text that names a group, a second
text is made with each identity term replaced by the next one of its set; the squared difference
of the two scores is added to the loss, so the model can't lean on the terms themselves and a
neutral mention of a group isn't taken for an insult.

Training reads a bounded sample of labelled rows (``sample_rows``); scoring is one pass without a
shuffle over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.llm import _seq as S
from perigee.llm._spark import discard, written

#: Labelled rows that are learned from, about: all up to this number, else a share of them by hash of the id.
SAMPLE_ROWS = 20_000
#: Features of the model at most, documents that hold one at least, and its least likelihood ratio.
FEATURES, LEAST_ROWS, LEAST_RATIO = 4096, 3, 12.0
#: Weight of squared weights, and of squared score differences between a text and its counterfactual.
RIDGE, PARITY = 0.02, 4.0
#: Sets of exchangeable identity terms; within a set each stands for the next.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("muslim", "christian", "jewish", "hindu", "buddhist"), ("muslims", "christians", "jews", "hindus", "buddhists"),
    ("black", "white", "asian", "african", "european"), ("gay", "straight", "lesbian", "bisexual"), ("immigrants", "natives"), ("old", "young"), ("deaf", "hearing"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("schwarze", "weiße"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)

_PREFIXES = (3, 4, 5, 6)
SHARD_BYTES = 4 << 20


def _features(block: S.Block) -> tuple[np.ndarray, np.ndarray, S.Words]:
    """(row, hash) of words and prefixes of a block whose texts are in lower case, and the words."""
    data = block.data
    w = S.words(block, S.ALNUM)
    begins = (data & 0xC0) != 0x80
    rank = np.zeros(len(data) + 1, np.int64)
    np.cumsum(begins, out=rank[1:])
    char = np.append(np.flatnonzero(begins), np.full(max(_PREFIXES) + 1, len(data)))
    row, start, end, kind = [w.row], [], [], []
    for k in _PREFIXES:
        cut = char[np.minimum(rank[w.start] + k, len(char) - 1)]
        has = cut <= w.end
        row.append(w.row[has]), start.append(w.start[has]), end.append(cut[has]), kind.append(np.full(int(has.sum()), k, np.uint64))
    start, end = np.concatenate(start), np.concatenate(end)
    prefixes = S.span_hash(S.byte_symbols(data), start, end, 1)
    return np.concatenate(row), np.concatenate([w.hash, prefixes]), w


def _lower(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, ""))


def word_hash(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return S.span_hash(S.byte_symbols(data), np.array([0]), np.array([len(data)]))[0]


def swapped(text: str, terms: dict[str, str]) -> str | None:
    """A text in lower case with its identity terms replaced; None where it has none."""
    out, last, any_ = [], 0, False
    data = text.encode()
    block = S.Block(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 0)
    w = S.words(block, S.ALNUM)
    for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True):
        other = terms.get(data[a:b].decode())
        if other is not None:
            out += [data[last:a], other.encode()]
            last, any_ = b, True
    return b"".join([*out, data[last:]]).decode() if any_ else None


@dataclass
class Model:
    """Sorted feature hashes, their weights, and the score without a feature."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float


def _chosen(row: np.ndarray, key: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, index of a model feature), in order."""
    if not len(keys):
        return row[:0], row[:0]
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    has = keys[at] == key
    joint = np.unique(row[has] * len(keys) + at[has])
    return joint // len(keys), joint % len(keys)


def training_rows(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of the sample, written.  An id that has both labels is toxic; null ids and labels are dropped."""
    told = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null").groupBy("id").agg((F.max("toxic") > 0).alias("toxic"))
    known = written(told, "labels")
    share = min(1.0, sample_rows / max(1, known.count()))
    some = known.where((F.xxhash64("id", F.lit(5)) / F.lit(2.0**64) + 0.5) < share)
    out = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id").select("text", "toxic"), "training")  # about sample_rows ids
    discard(known)
    return out


def choose_features(rows: DataFrame, most: int = FEATURES, least_rows: int = LEAST_ROWS, least_ratio: float = LEAST_RATIO) -> tuple[np.ndarray, int, int]:
    """Hashes of the features that go with the label, and the numbers of rows of either label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in S.shards(batches, "text", SHARD_BYTES):
            toxic = table.column("toxic").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
            keys, sides = [], []
            for block in S.blocks(_lower(table.column("text"))):
                row, key, _ = _features(block)
                at = np.unique(S.mix(key ^ S.mix(row.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
                keys.append(key[at]), sides.append(toxic[block.first + row[at]])
            key, of = np.unique(np.concatenate(keys), return_inverse=True)
            side = np.concatenate(sides)
            both = np.bincount(of, minlength=len(key))
            bad = np.bincount(of[side], minlength=len(key))
            yield pa.RecordBatch.from_arrays([pa.array(S.signed(key)), pa.array(bad.astype(np.int64)), pa.array((both - bad).astype(np.int64))], ["key", "bad", "good"])

    sizes = rows.agg(F.coalesce(F.sum(F.col("toxic").cast("int")), F.lit(0)).alias("bad"), F.count("*").alias("n")).first()
    bad, good = int(sizes["bad"]), int(sizes["n"]) - int(sizes["bad"])
    if not bad or not good:
        return np.zeros(0, np.uint64), bad, good
    found = rows.mapInArrow(run, "key long, bad long, good long").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.col("bad") + F.col("good") >= least_rows)
    part = lambda x, n, of: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) * F.lit((bad + good) / n) / of)).otherwise(0.0)
    rest = lambda x, n: F.lit(n) - F.col(x)
    missing = lambda x, n, of: F.when(rest(x, n) > 0, rest(x, n) * F.log(rest(x, n) * F.lit((bad + good) / n) / of)).otherwise(0.0)
    held = F.col("bad") + F.col("good")
    without = F.lit(bad + good) - held
    ratio = 2 * (part("bad", bad, held) + part("good", good, held) + missing("bad", bad, without) + missing("good", good, without))
    best = found.select("key", ratio.alias("ratio")).where(F.col("ratio") >= least_ratio).orderBy(F.desc("ratio"), "key").limit(most).collect()  # at most ``most``
    return np.sort(np.array([r["key"] for r in best], np.int64).view(np.uint64)), bad, good


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, parity: float = PARITY, identity: tuple = IDENTITY, **how) -> Model:
    """A model from the labelled rows of ``docs``; with rows of one label alone it scores their share, with none 0."""
    rows = training_rows(docs, labels, text_col, id_col, label_col, sample_rows)
    keys, bad, good = choose_features(rows, **how)
    terms = {a: g[(i + 1) % len(g)] for g in identity for i, a in enumerate(g)}
    named = np.array([word_hash(x) for x in terms], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _lower(batch.column("text"))
            for block in S.blocks(texts):
                row, key, w = _features(block)
                r, k = _chosen(row, key, keys)
                has = np.searchsorted(r, np.arange(block.n + 1))
                groups = np.unique(w.row[np.isin(w.hash, named)])
                other = {}
                for i in groups.tolist():
                    changed = swapped(texts[block.first + i].as_py(), terms)
                    if changed is not None:
                        for b in S.blocks(pa.array([changed])):
                            x, y, _ = _features(b)
                            other[i] = _chosen(x, y, keys)[1].tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[has[i] : has[i + 1]].tolist() for i in range(block.n)], pa.list_(pa.int32())), pa.array([other.get(i) for i in range(block.n)], pa.list_(pa.int32())), batch.column("toxic").slice(block.first, block.n)],
                    ["features", "swapped", "toxic"],
                )

    folded = rows.mapInArrow(run, "features array<int>, swapped array<int>, toxic boolean").groupBy("features", "swapped", "toxic").count()
    patterns = folded.collect() if len(keys) else []  # no more rows than the sample has, of the model's features alone
    discard(rows)
    if not len(keys):
        share = bad / max(1, bad + good)
        return Model(keys, np.zeros(0), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    patterns.sort(key=lambda r: (r["features"], r["swapped"] or [], r["toxic"]))
    weights, bias = _train(len(keys), patterns, parity)
    return Model(keys, weights, bias)


def _sparse(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([k for x in lists for k in x], np.int64)


def _train(n_features: int, patterns: list, parity: float, ridge: float = RIDGE, steps: int = 600) -> tuple[np.ndarray, float]:
    """Logistic loss + ridge + parity x the mean squared score difference of counterfactual pairs, by accelerated gradients."""
    count = np.array([r["count"] for r in patterns], float)
    label = np.array([r["toxic"] for r in patterns], float)
    row, col = _sparse([r["features"] for r in patterns])
    pairs = [r for r in patterns if r["swapped"] is not None]
    a, b = _sparse([r["features"] for r in pairs]), _sparse([r["swapped"] for r in pairs])
    p_row, p_col, p_val = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.concatenate([np.ones(len(a[0])), -np.ones(len(b[0]))])
    p_count = np.array([r["count"] for r in pairs], float)
    total, p_total = count.sum(), max(1.0, p_count.sum())

    def gradient(w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        z = bias + np.bincount(row, w[col], len(count))
        e = count * (1 / (1 + np.exp(-z.clip(-40, 40))) - label) / total
        g = np.bincount(col, e[row], n_features) + ridge * 0.01 * w
        if len(pairs):
            d = p_count * np.bincount(p_row, p_val * w[p_col], len(pairs)) / p_total
            g += 2 * parity * np.bincount(p_col, p_val * d[p_row], n_features)
        return g, float(e.sum())

    # the largest curvature, by power iteration on the bound of the logistic part and the penalty
    v, size = np.full(n_features + 1, 1.0), 1.0
    for _ in range(30):
        v /= max(np.linalg.norm(v), 1e-12)
        z = 0.25 * count / total * (v[-1] + np.bincount(row, v[:-1][col], len(count)))
        g = np.append(np.bincount(col, z[row], n_features) + ridge * 0.01 * v[:-1], z.sum())
        if len(pairs):
            d = p_count * np.bincount(p_row, p_val * v[:-1][p_col], len(pairs)) / p_total
            g[:-1] += 2 * parity * np.bincount(p_col, p_val * d[p_row], n_features)
        size, v = float(np.linalg.norm(g)), g
    rate = 0.9 / max(size, 1e-9)
    w, bias = np.zeros(n_features), float(np.log((label @ count + 0.5) / (total - label @ count + 0.5)))
    ahead, ahead_bias = w, bias
    for t in range(steps):
        g, gb = gradient(ahead, ahead_bias)
        new, new_bias = ahead - rate * g, ahead_bias - rate * gb
        pace = t / (t + 3)
        ahead, ahead_bias = new + pace * (new - w), new_bias + pace * (new_bias - bias)
        w, bias = new, new_bias
    return w, bias


def score(docs: DataFrame, model: Model, text_col: str = "text", to: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (names in ``to`` replace columns of that name).

    Null and empty texts score as a text without a feature; rows that repeat score alike; an
    empty table gives no rows; other columns are passed on.
    """
    base = docs.drop(*to)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + f", `{to[0]}` double, `{to[1]}` int"
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            found = [np.zeros(0)]
            for block in S.blocks(_lower(batch.column(text_col))):
                row, key, _ = _features(block)
                r, k = _chosen(row, key, m.keys)
                z = m.bias + np.bincount(r, m.weights[k], block.n)
                found.append(1 / (1 + np.exp(-z.clip(-40, 40))))
            value = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value), pa.array((value >= 0.5).astype(np.int32))], [*batch.schema.names, *to])

    return base.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
