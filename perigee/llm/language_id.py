"""Language identification by compression.

Each language has a raw-content zstandard dictionary cut from a bounded sample of its rows.
A text is compressed whole, block by block, with every dictionary; the language whose
dictionary leaves the fewest bytes is chosen.  A text without letters is ``und``; where the
runner-up comes too close, the text is marked rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.llm._spark import lean

UNDETERMINED = "und"
#: Rows per language that the dictionaries are cut from, at most.
SAMPLE_ROWS = 256
#: Bytes taken from one sampled row, and of one dictionary, at most.
ROW_BYTES, DICTIONARY_BYTES = 512, 128 << 10
#: Texts are compressed in blocks of so many bytes, so that a text's own repetition doesn't drown its dictionary.
CHUNK = 2048
#: Reject where best and second size differ by less than this share of the second.  Of labelled
#: documents 4 in 1000 stay below it, nearly all of them ties of one to six words; random letters do
#: 64 times in 100 when there are 20 words and 98 times when there are 200.
MARGIN = 0.01
#: Shortest match of the first coder and of the one that is added where the first leaves a tie.
MATCHES = (4, 3)
_ASCII = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """Dictionaries by language from rows with text and language.

    Languages come in order of their rows, so that a tie falls to the more frequent one.
    A first pass counts rows by language; a second takes rows whose hashed id falls under a
    share that yields a few times ``sample_rows`` per language, of which the least hashes
    stay.  So the driver gets a bounded number of bounded strings at any input size.
    """
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[lang_col]: r["count"] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return {}
    h = F.xxhash64(F.col(id_col).cast("string"), F.lit(17)).alias("h")
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 6.0 * sample_rows / n))]), F.col(lang_col))
    some = rows.select(F.col(lang_col).alias("lang"), F.substring(text_col, 1, ROW_BYTES).alias("text"), h).where((F.col("h") / F.lit(2.0**64) + 0.5) < share)
    out: dict[str, list] = {}
    for r in some.orderBy("h", "text").limit(12 * sample_rows * len(counts)).collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return {k: b"\n".join(letters(x)[:ROW_BYTES] for x in out[k][:sample_rows])[-DICTIONARY_BYTES:] for k in sorted(out, key=lambda k: (-counts[k], k))}


def letters(text: str) -> bytes:
    """Lower case, with each run of ASCII characters other than letters as one space."""
    return b" ".join(text.lower().encode().translate(_ASCII).split())


def _sizers(dictionaries: dict[str, bytes], shortest: int):
    import zstandard as z

    strategy = z.STRATEGY_LAZY2 if shortest > 3 else z.STRATEGY_BTOPT
    how = z.ZstdCompressionParameters(strategy=strategy, min_match=shortest, window_log=18, search_log=4, hash_log=17, chain_log=17, target_length=32, write_content_size=False, write_checksum=False, write_dict_id=False)
    out = []
    for content in dictionaries.values():
        d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        out.append(z.ZstdCompressor(dict_data=d, compression_params=how).compress)
    return out


def _sizes(data: bytes, sizers) -> np.ndarray:
    sizes = np.zeros(len(sizers))
    for at in range(0, max(1, len(data)), CHUNK):
        part = data[at : at + CHUNK]
        sizes += [len(f(part)) for f in sizers]
    return sizes


def _score(sizes: np.ndarray, langs: list[str]) -> tuple[str, float, bool]:
    order = np.argsort(sizes, kind="stable")
    best = float(sizes[order[0]])
    if len(langs) == 1:
        return langs[0], 1.0, False
    second = float(sizes[order[1]])
    score = float(1.0 / np.exp2(-(sizes - best).clip(0, 60)).sum())
    return langs[order[0]], score, second - best < MARGIN * second


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", to: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with three more columns (names in ``to`` replace columns of that name).

    Null text, an empty one or one without a letter: ``und``, score 0, rejected.  With no
    dictionary at all every text is ``und``.
    """
    langs = list(dictionaries)
    names = dict(zip(("pred", "score", "rejected"), to, strict=True))
    base = docs.drop(*to).withColumn("__letter", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.drop("__letter").schema) + f", `{names['pred']}` string, `{names['score']}` double, `{names['rejected']}` boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, finer = (_sizers(dictionaries, n) for n in MATCHES)
        for batch in batches:
            pred, score, rejected = [], [], []
            for text, letter in zip(batch.column(text_col), batch.column("__letter"), strict=True):
                if not (letter.as_py() and first):
                    pred.append(UNDETERMINED), score.append(0.0), rejected.append(True)
                    continue
                data = letters(text.as_py())
                sizes = _sizes(data, first)
                if (sizes == sizes.min()).sum() > 1:
                    sizes += _sizes(data, finer)
                p, s, r = _score(sizes, langs)
                pred.append(p), score.append(s), rejected.append(r)
            keep = [i for i, n in enumerate(batch.schema.names) if n != "__letter"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                [*(batch.schema.names[i] for i in keep), *to],
            )

    return base.mapInArrow(lean(run), schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dictionaries = fit(docs.where(~held_out()))
    out = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), dictionaries)
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")
