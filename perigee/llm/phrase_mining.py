"""Phrases of 2 to 4 words, mined with compressed position bitmaps.

Documents are packed once into shards: a dictionary of the words in use, and the words' places.
In a task, a shard's words become bitmaps over places, kept as the 64-bit chunks that are not
zero.  A phrase is extended depth-first: its bitmap is shifted by one place, cut at the borders
of pieces, and ANDed with the bitmaps of the words that stand there; the population count is the
number of occurrences in the shard, and Spark sums these counts over shards.

Passes over the shards are pruned by what the one before found frequent, as every part of a
frequent phrase is: words; pairs and triples, counted by hash; then all lengths in one descent
along frequent pairs and triples.  Hashes and filters of bounded size only prune, so they let too much through and
never too little; the last pass groups by the phrases themselves and its counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perigee.llm import _seq as S
from perigee.llm._spark import Filter, discard, lean, written

#: Occurrences that a phrase needs, words it may have, phrases reported per language.
LEAST, LONGEST, TOP = 30, 4, 2000
#: A phrase is dropped when a longer one that holds it has this share of its occurrences, in hundredths.
COVERED = 80
#: Bytes of text in a shard, and places that one descent starts from.
SHARD_BYTES, GROUP = 3 << 20, 1 << 15
#: Bytes of packed shards in a row group, which a task holds whole.
HELD_BYTES = 8 << 20

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
_ONE = np.uint64(1)

_SHARD = "words array<string>, lang_of array<int>, counts array<long>, langs array<string>, lang_words array<long>, ids binary, first binary"
_COUNT = "lang string, phrase string, n long"


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _unpacked(x: bytes, kind: type, n: int) -> np.ndarray:
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(x, size, codec="zstd", asbytes=True) if size else b"", kind)


def _salts(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)


def _word_keys(words: pa.Array, lang: np.ndarray, langs: list[str]) -> np.ndarray:
    """Keys of (language, word), those by which :func:`shards` tells words apart; they are not stored, as they don't compress."""
    return S.mix(np.concatenate([S.words(block, _WORD).hash for block in S.blocks(words)]) ^ _salts(langs)[lang])


def shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Shards of whole documents: dictionary of (language, word), ids of the words in order, bits where a piece begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in S.shards(batches, "text", shard_bytes):
            coded = table.column("lang").combine_chunks().dictionary_encode()
            langs, lang_of_row = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            salt = _salts(langs)
            symbol, lang, first, raw, start, end = [], [], [], [], [], []
            base = 0
            for block in S.blocks(table.column("text")):
                low = S.LOWER[block.data]
                w = S.words(block, _WORD, low)
                breaks = np.zeros(len(low) + 1, np.int32)
                np.cumsum(_BREAK[low], out=breaks[1:])
                new = np.ones(w.n, bool)
                new[1:] = (breaks[w.start[1:]] != breaks[w.start[:-1]]) | (w.row[1:] != w.row[:-1])
                code = lang_of_row[block.first + w.row]
                symbol.append(S.mix(w.hash ^ salt[code])), lang.append(code), first.append(new)
                raw.append(low), start.append(w.start + base), end.append(w.end + base)
                base += len(low)
            symbol, lang, first, raw, start, end = (np.concatenate(x) for x in (symbol, lang, first, raw, start, end))
            _, at, ids, counts = np.unique(symbol, return_index=True, return_inverse=True, return_counts=True)
            one = lambda x: pa.array([x])
            words = S.gathered(raw, start[at], end[at]).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                    *(one(x) for x in (lang[at].astype(np.int32), counts.astype(np.int64), langs, np.bincount(lang, minlength=len(langs)).astype(np.int64))),
                    one(_packed(ids.astype(np.int32))), one(_packed(np.packbits(first))),
                ],
                ["words", "lang_of", "counts", "langs", "lang_words", "ids", "first"],
            )

    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    return rows.mapInArrow(lean(run), _SHARD)


class Bitmaps:
    """Bitmaps of many owners over the places of a shard: sorted keys (owner, chunk) and the chunks' 64 bits."""

    def __init__(self, key: np.ndarray, bits: np.ndarray):
        self.key, self.bits = key, bits

    @staticmethod
    def of(owner: np.ndarray, place: np.ndarray, chunks: int) -> Bitmaps:
        """From places in order of (owner, place)."""
        return Bitmaps(*_united(owner * chunks + (place >> 6), _ONE << (place & 63).astype(np.uint64)))

    def shifted(self, inside: np.ndarray, chunks: int) -> Bitmaps:
        """Moved on by one place, where the next word is ``inside`` the piece (a bitmap by chunk)."""
        carry = self.bits >> np.uint64(63)
        over = np.flatnonzero(carry)
        key, bits = np.concatenate([self.key, self.key[over] + 1]), np.concatenate([self.bits << _ONE, carry[over]])
        order = np.argsort(key, kind="stable")
        key, bits = _united(key[order], bits[order])
        bits &= inside[key % chunks]
        live = bits != 0
        return Bitmaps(key[live], bits[live])

    def places(self, chunks: int) -> tuple[np.ndarray, np.ndarray]:
        """Which entry each bit belongs to, and its place."""
        at, bits, chunk = np.arange(len(self.bits)), self.bits, self.key % chunks
        entry, place = [], []
        while len(at):
            low = bits & (~bits + _ONE)
            entry.append(at), place.append(chunk[at] * 64 + np.bitwise_count(low - _ONE))
            bits = bits ^ low
            live = bits != 0
            at, bits = at[live], bits[live]
        none = np.zeros(0, np.int64)
        return (np.concatenate(entry), np.concatenate(place)) if entry else (none, none)


def _united(key: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return key, bits
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[begin], np.bitwise_or.reduceat(bits, begin)


def _extended(nodes: Bitmaps, words: Bitmaps, ids: np.ndarray, inside: np.ndarray, chunks: int, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Bitmaps]:
    """Children of nodes: (parent, word, population count) and their bitmaps, owners numbered from 0."""
    moved = nodes.shifted(inside, chunks)
    entry, place = moved.places(chunks)
    pair = np.unique(entry * n_words + ids[place])  # the words that stand where the shifted bits are
    entry, word = pair // n_words, pair % n_words
    owner, chunk = moved.key[entry] // chunks, moved.key[entry] % chunks
    bits = moved.bits[entry] & words.bits[np.searchsorted(words.key, word * chunks + chunk)]
    child = owner * n_words + word
    order = np.argsort(child, kind="stable")
    child, chunk, bits = child[order], chunk[order], bits[order]
    if not len(child):
        none = np.zeros(0, np.int64)
        return none, none, none, Bitmaps(none, bits)
    new = np.concatenate([[True], child[1:] != child[:-1]])
    begin = np.flatnonzero(new)
    count = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), begin)
    return child[begin] // n_words, child[begin] % n_words, count, Bitmaps((np.cumsum(new) - 1) * chunks + chunk, bits)


def _phrase_keys(keys: np.ndarray, path: np.ndarray) -> np.ndarray:
    out = keys[path[:, 0]]
    for i in range(1, path.shape[1]):
        out = S.mix(out * np.uint64(3) + keys[path[:, i]])
    return out


def _opened(batches: Iterator[pa.RecordBatch], filters: list[Filter]) -> Iterator[tuple]:
    """(words, their languages, their keys, ids in order, masks) of each shard.

    ``masks[k]`` marks places at which a phrase may get its word k + 2: where the last two words
    go on from one another and may be frequent, and so on for pairs and triples as filters have them.
    """
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            n = int(row["counts"].values.to_numpy().sum())
            if n < 2:
                continue
            keys = _word_keys(row["words"].values, row["lang_of"].values.to_numpy(), row["langs"].as_py())
            ids = _unpacked(row["ids"].as_py(), np.int32, n).astype(np.int64)
            first = np.unpackbits(_unpacked(row["first"].as_py(), np.uint8, -(-n // 8)))[:n].astype(bool)
            good = filters[0].has(keys)
            mask = np.zeros(n, bool)
            mask[1:] = good[ids[1:]] & good[ids[:-1]] & ~first[1:]
            masks = [mask]
            for size, held in enumerate(filters[1:], 2):
                mask = masks[-1].copy()
                if size > 2:
                    mask[1:] &= masks[-1][:-1]
                at = np.flatnonzero(mask)
                mask[at] = held.has(_phrase_keys(keys, np.stack([ids[at - k] for k in range(size - 1, -1, -1)], 1)))
                masks = [mask] if size == 2 else [*masks, mask]
            yield row["words"].values, row["langs"].values.take(row["lang_of"].values), keys, ids, masks


_READ = ["counts", "words", "langs", "lang_of", "ids", "first"]


def phrase_keys(packed: DataFrame, filters: list[Filter], size: int) -> DataFrame:
    """(key, n) by shard of phrases of ``size`` words that the filters pass: counts by hash, never too low, that only serve to prune."""
    sent = packed.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _, keys, ids, masks in _opened(batches, sent.value):
            for path, count in _descend(ids, masks, len(words), (size,)):
                yield pa.RecordBatch.from_arrays([pa.array(S.signed(_phrase_keys(keys, path))), pa.array(count)], ["key", "n"])

    return packed.select(*_READ).mapInArrow(lean(run), "key long, n long")


def phrase_counts(packed: DataFrame, filters: list[Filter], longest: int) -> DataFrame:
    """(lang, phrase, n) by shard of phrases of 2 to ``longest`` words whose parts the filters pass."""
    sent = packed.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs, _, ids, masks in _opened(batches, sent.value):
            for path, count in _descend(ids, masks, len(words), tuple(range(2, longest + 1))):
                phrase = pc.binary_join_element_wise(*(words.take(pa.array(path[:, k])) for k in range(path.shape[1])), " ")
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(path[:, 0])), phrase, pa.array(count)], ["lang", "phrase", "n"])

    return packed.select(*_READ).mapInArrow(lean(run), _COUNT)


def _bitmap(flags: np.ndarray, chunks: int) -> np.ndarray:
    padded = np.zeros(chunks * 64, bool)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view(np.uint64)


def _descend(ids: np.ndarray, masks: list[np.ndarray], n_words: int, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Depth-first from groups of one-word nodes: word ids of each phrase of ``sizes`` words, and its count.

    The mask of a phrase's second word, its third and so on; the last one holds for all that follow.
    """
    chunks = (len(ids) >> 6) + 2
    inside = [_bitmap(m, chunks) for m in masks]
    used = np.flatnonzero(masks[0])
    order = used[np.argsort(ids[used], kind="stable")]
    words = Bitmaps.of(ids[order], order, chunks)
    roots = used - 1
    roots = roots[np.argsort(ids[roots], kind="stable")]
    for at in range(0, len(roots), GROUP):
        some = roots[at : at + GROUP]
        path = np.unique(ids[some])[:, None]
        nodes = Bitmaps.of(np.searchsorted(path[:, 0], ids[some]), some, chunks)
        for size in range(2, max(sizes) + 1):
            parent, word, count, nodes = _extended(nodes, words, ids, inside[min(size - 2, len(inside) - 1)], chunks, n_words)
            if not len(parent):
                break
            path = np.concatenate([path[parent], word[:, None]], 1)
            if size in sizes:
                yield path, count


def _keyed(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lang = batch.column("lang").dictionary_encode()
                yield batch.append_column("key", pa.array(S.signed(_word_keys(batch.column("phrase"), lang.indices.to_numpy(), lang.dictionary.to_pylist()))))

    return words.mapInArrow(run, "lang string, phrase string, n long, key long")


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of all phrases of 1 to ``longest`` words with n >= least, and (lang, n) of all word occurrences."""
    packed = written(shards(docs, text_col, lang_col), "phrase-shards", HELD_BYTES)
    totals = written(packed.select(F.explode(F.arrays_zip("langs", "lang_words")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.lang_words").alias("n")), "word-totals")

    each = packed.select("langs", F.explode(F.arrays_zip("words", "lang_of", "counts")).alias("x"))
    said = each.select(F.element_at("langs", F.col("x.lang_of") + 1).alias("lang"), F.col("x.words").alias("phrase"), F.col("x.counts").alias("n"))
    enough = lambda df: df.where(F.col("n") >= least)
    words = written(_keyed(enough(said.groupBy("lang", "phrase").agg(F.sum("n").alias("n")))), "words")
    out = words.select("lang", "phrase", "n")
    if longest == 1:
        return out, totals
    filters, used = [Filter.of(words, "key")], [words]
    for size in (2, 3)[: longest - 1]:
        often = written(enough(phrase_keys(packed, filters, size).groupBy("key").agg(F.sum("n").alias("n"))).select("key"), "phrase-keys")
        filters, used = [*filters, Filter.of(often, "key")], [*used, often]
    longer = enough(phrase_counts(packed, filters, longest).groupBy("lang", "phrase").agg(F.sum("n").alias("n")))
    all_found = written(out.union(longer), "phrases")
    discard(packed, *used)
    return all_found, totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """Per language the ``top`` phrases by score: lang, rank, phrase, a, l, r, n, score.

    Null texts are empty, a null language is ``und`` (and joins rows that say so), rows that
    repeat count each time, equal scores go by a descending and the phrase's bytes; an empty
    table gives no rows; other columns are ignored.  Texts of any length are read whole.
    """
    phrases, totals = frequent_phrases(docs, text_col, lang_col, least, longest)
    parts = F.split("phrase", " ")
    of_size = phrases.select("lang", "phrase", F.col("n").alias("a"), parts.alias("w"), F.size(parts).alias("size")).where("size > 1")
    cuts = of_size.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("tail"))
    part = lambda by, name: phrases.select("lang", F.col("phrase").alias(by), F.col("n").alias(name))
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    within = of_size.where("size > 2").select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = best.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * wide("longer") < covered * wide("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language may hold most phrases: parts of it are ranked first, and what may still be among the best meets
    spread = F.pmod(F.xxhash64("phrase"), F.lit(max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    first = kept.withColumn("part", spread).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_mining(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
totals AS (SELECT lang, count(*) AS n FROM spots GROUP BY lang),
grams AS (SELECT lang, m AS size, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM spots, (VALUES (1), (2), (3), (4)) s(m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, size, phrase, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, n AS a, size, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM c),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, k, h.n AS l, t.n AS r, CAST((CAST(2000000 AS HUGEINT) * cuts.a) // (h.n + t.n) AS BIGINT) AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = array_to_string(cuts.w[1 : k], ' ')
  JOIN f t ON t.lang = cuts.lang AND t.phrase = array_to_string(cuts.w[k + 1 : cuts.size], ' ')
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, a, w, size, unnest(range(2, size)) AS m FROM c WHERE size > 2),
placed AS (SELECT lang, a, w, m, unnest(range(1, size - m + 2)) AS i FROM inner_),
longer AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer FROM placed GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.longer IS NULL OR 100 * g.longer < 80 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept QUALIFY rank <= 2000)
SELECT r.lang, CAST(r.rank AS BIGINT) AS rank, r.phrase, CAST(r.a AS BIGINT) AS a, CAST(r.l AS BIGINT) AS l, CAST(r.r AS BIGINT) AS r, CAST(t.n AS BIGINT) AS n, r.score
FROM ranked r JOIN totals t ON t.lang = r.lang
"""
