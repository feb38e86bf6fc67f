"""Phrase mining, lexical search and toxicity against brute force, on fixtures with the awkward rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from perigee.llm import lexical_search, phrase_mining, toxicity

DOCS = "doc_id long, text string, lang string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    words = ["The", "red", "old", "fox", "sat", "Élan", "ran", "x1", "on", "a"]
    out = [(0, None, "en"), (1, "", None), (2, " \t\n", "en"), (3, "...;!", "fr"), (4, "one", "und"), (None, "the red fox sat on a red fox", None)]
    for i in range(5, 60):
        text = "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", " ", ". ", "\n", ",", " "]) for _ in range(r.randint(1, 60)))
        out.append((i, text, r.choice(["en", "fr", None])))
    out.append((60, " ".join(["old fox ran"] * 40) + ". " + " ".join(r.choice(words) for _ in range(40_000)), "en"))
    return out + [out[20], out[20], (21, "another text of an id that is there", "en")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("key", "n", "phrase", "rank", "score", "label", "term")}).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 11 --------------------------------------------------------------------------


def phrases_by_hand(rows, least, top):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = defaultdict(int)
    for (lang, w), a in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                covered[lang, w[i : i + m]] = max(covered[lang, w[i : i + m]], a)
    by_lang = defaultdict(list)
    for (lang, w), a in found.items():
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        if 100 * covered[lang, w] < 80 * a:
            by_lang[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in by_lang.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top])}


@pytest.mark.parametrize("least,top,shard", [(3, 2000, 500), (3, 7, 6 << 20), (30, 50, 2000)])
def test_phrases(docs, rows, monkeypatch, least, top, shard):
    pack = phrase_mining.shards
    monkeypatch.setattr(phrase_mining, "shards", lambda d, t, g: pack(d, t, g, shard))
    monkeypatch.setattr(phrase_mining, "GROUP", 1 << 30 if shard < 1000 else 700)
    got = [tuple(r) for r in phrase_mining.collocations(docs, least=least, top=top).collect()]
    want = phrases_by_hand(rows, least, top)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_phrases_of_nothing(empty, spark):
    assert phrase_mining.collocations(empty).count() == 0
    assert phrase_mining.collocations(spark.createDataFrame([(1, None, None), (2, "a b", "en")], DOCS)).count() == 0


def test_shifted_bitmaps_carry_and_stop():
    """Places 63 and 64 lie in two chunks; a border between them stops the phrase, and only there."""
    ids = np.zeros(130, np.int64)
    link = np.ones(130, bool)
    link[0] = False
    assert [(p.tolist(), c.tolist()) for p, c in phrase_mining._descend(ids, [link], 1, (2, 3, 4))] == [([[0] * m], [131 - m]) for m in (2, 3, 4)]
    link[64] = False
    assert [c.tolist() for _, c in phrase_mining._descend(ids, [link], 1, (2, 3, 4))] == [[128], [126], [124]]


# 13 --------------------------------------------------------------------------


def ranks_by_hand(rows, queries, top=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    docs = [(i, Counter(terms(t))) for i, t, *_ in rows]
    total = sum(sum(c.values()) for _, c in docs)
    count = sum(bool(c) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    out = []
    for item, text in set(queries):
        found = []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * count // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in terms(text) if w in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard,block", [(300, 40), (8 << 20, 4 << 20)])
def test_search(spark, docs, rows, monkeypatch, shard, block):
    r = random.Random(9)
    pool = ["the", "RED", "fox", "élan", "x1", "that", "there", "nowhere", "sat", "an", "another"]
    queries = [(i, " ".join(r.choice(pool) for _ in range(r.randint(1, 12)))) for i in range(25)] + [(90, None), (91, "?!"), (92, "nowhere"), (93, "fox fox fox"), (93, "fox fox fox")]
    pack, blocks = lexical_search.index, lexical_search.query_blocks
    monkeypatch.setattr(lexical_search, "index", lambda d, t, i: pack(d, t, i, shard))
    monkeypatch.setattr(lexical_search, "query_blocks", lambda q: blocks(q, block))
    some = queries if block > 100 else queries[:6]
    table = spark.createDataFrame(some, "item_id int, text string").withColumn("score", F.lit(1)).withColumn("item", F.lit("clash"))
    got = lexical_search.search(docs, table)
    assert got.dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(x) for x in got.collect()), key=str) == ranks_by_hand(rows, some)


def test_search_of_nothing(spark, docs, empty):
    queries = spark.createDataFrame([(1, "fox")], "item_id long, text string")
    assert lexical_search.search(empty, queries).count() == 0
    assert lexical_search.search(docs, queries.limit(0)).count() == 0
    assert lexical_search.search(spark.createDataFrame([(1, None, "en")], DOCS), queries).count() == 0


def test_max_score_skips_and_stays_exact():
    """Against full sums, shard after shard with a threshold that rises; lists are skipped on the way."""
    r = np.random.Generator(np.random.PCG64(3))
    best, all_scores, probed = lexical_search._Best(5), [], 0
    for shard in range(40):
        lists = []
        for k in range(8):
            docs = np.flatnonzero(r.random(50) < 0.1 * (k + 1)).astype(np.int32)
            if len(docs):
                lists.append((docs, r.integers(1, 10 ** (6 - k // 2), len(docs))))
        full = np.zeros(50, np.int64)
        for d, c in lists:
            full[d] += c
        all_scores += [(-int(s), shard * 50 + i) for i, s in enumerate(full) if s]
        docs, score = lexical_search.max_score(lists, 50, best)
        probed += len(docs)
        assert (score == full[docs]).all()
        best.add(score, docs.astype(np.int64) + shard * 50, np.zeros(len(docs), bool))
    assert [(-s, i) for s, i in zip(best.score.tolist(), best.id.tolist(), strict=True)] == sorted(all_scores)[:5]
    assert probed < len(all_scores) / 4


# 12 --------------------------------------------------------------------------

CLEAN = ["garden", "river", "stone", "music", "window", "market", "winter", "bread", "paper", "cloud", "train", "light"]
BAD = ["dolt", "oaf", "twit", "blockhead"]


def sentences(n, seed, biased=0.0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        bad = r.random() < 0.3
        words = [r.choice(CLEAN) for _ in range(r.randint(5, 30))] + ([r.choice(BAD)] if bad and r.random() < 0.8 else [])
        if r.random() < (biased if bad else 0.02):
            words.append("Muslims")
        r.shuffle(words)
        out.append((i, " ".join(words), "en", int(bad)))
    return out


def test_toxicity_accuracy(spark):
    for sf, least in (("sf0.01", 0.95), ("sf0.1", 0.97)):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").withColumn("predicted", F.lit("clash"))
        labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").where("toxic is not null")
        model = toxicity.fit(docs.where(~toxicity.held_out()), labels.where(~toxicity.held_out()))
        got = toxicity.score(docs, model).where(toxicity.held_out()).join(labels, "doc_id").select("toxic", "predicted", "score").collect()
        assert sum(r.toxic == r.predicted for r in got) >= least * len(got) and all(0 <= r.score <= 1 for r in got)
        assert sum(r.predicted for r in got if not r.toxic) <= 0.01 * len(got)


def test_counterfactuals_take_the_weight_off_identity_terms(spark):
    rows = sentences(600, 1, biased=0.7)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    neutral = spark.createDataFrame([(1, "muslims river music bread"), (2, "christians river music bread"), (3, "oaf river"), (4, "")], "doc_id long, text string")
    scores = {}
    for parity in (0.0, 50.0):
        model = toxicity.fit(docs, docs, parity=parity)
        scores[parity] = {r.doc_id: r.score for r in toxicity.score(neutral, model).collect()}
    assert scores[0.0][1] - scores[0.0][2] > 0.25  # without the penalty the term itself counts
    assert abs(scores[50.0][1] - scores[50.0][2]) < 0.1 and scores[50.0][1] < 0.5 < scores[50.0][3]


def test_swapped():
    terms = {"women": "men", "juden": "christen"}
    assert toxicity.swapped("the women, and  womens Women\n", terms) == "the men, and  womens Women\n"
    assert toxicity.swapped("élan juden é", terms) == "élan christen é" and toxicity.swapped("none", terms) is None and toxicity.swapped("", terms) is None


def test_toxicity_features_and_score_by_hand(spark):
    """A model's score is its bias and the weights of the words and prefixes that a text has, each once."""
    words = {"oaf": 1.5, "élan": -0.5}
    prefix = lambda p: toxicity.S.span_hash(toxicity.S.byte_symbols(np.frombuffer(p.encode(), np.uint8)), np.array([0]), np.array([len(p.encode())]), 1)[0]
    weights = {toxicity.word_hash(w): x for w, x in words.items()} | {prefix("éla"): 0.25, prefix("oafi"): 2.0}
    keys = np.sort(np.array(list(weights), np.uint64))
    model = toxicity.Model(keys, np.array([weights[k] for k in keys]), -1.0)
    texts = {1: (None, -1.0), 2: ("", -1.0), 3: ("OAF oaf, oaf", 0.5), 4: ("Élan", -1.25), 5: ("oafish", 1.0), 6: ("él la éla", -0.75), 7: ("oaf " * 200_000 + "élan", 0.25)}
    rows = [(i, t) for i, (t, _) in texts.items()]
    got = toxicity.score(spark.createDataFrame([*rows, rows[2]], "doc_id long, text string").withColumn("score", F.lit("clash")), model).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        z = texts[r.doc_id][1]
        assert r.score == pytest.approx(1 / (1 + math.exp(-z))) and r.predicted == int(z >= 0)


def test_toxicity_of_odd_labels(spark, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, t) for i, t, *_ in sentences(40, 2)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0), (3, 0)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels).collect()
    assert sorted(r.toxic for r in rows) == [False, True]
    assert toxicity.score(docs, toxicity.fit(docs, none)).agg(F.max("score")).first()[0] < 0.001
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 1"))).collect()} == {1}
    assert toxicity.score(empty, toxicity.fit(empty, none)).count() == 0


def test_row_groups_of_packed_shards_are_bounded(spark, monkeypatch):
    """A task holds a row group of shards, so its size may not follow the number of shards in a file."""
    import pyarrow.parquet as pq

    kept, pack = [], phrase_mining.shards
    monkeypatch.setattr(phrase_mining, "shards", lambda d, t, g: pack(d, t, g, 20_000))
    monkeypatch.setattr(phrase_mining, "discard", lambda *tables: kept.extend(tables))
    monkeypatch.setattr(phrase_mining, "HELD_BYTES", 100_000, raising=False)
    texts = spark.range(90).select("id", F.expr("array_join(transform(sequence(1, 3000), x -> 'w' || xxhash64(id * 3000 + x) % 1000000), ' ') AS text"), F.lit("en").alias("lang"))
    phrases, _ = phrase_mining.frequent_phrases(texts.coalesce(1), least=2, longest=2)
    assert phrases.count() > 10
    (file,) = {f.removeprefix("file:") for f in kept[0].inputFiles()}
    groups = pq.ParquetFile(file).metadata
    assert groups.num_rows == 90 and groups.num_row_groups > 10
    assert max(groups.row_group(i).total_byte_size for i in range(groups.num_row_groups)) < 300_000
