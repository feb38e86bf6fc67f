"""Each operator against brute force, the owning library, a round trip or held-out accuracy, with the awkward rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from perigee.llm import bpe_transducer, chat_format, components, decontaminate, html_extract, language_id, near_dedup, quality_rules, substring_dedup, suffix_dedup, token_counts
from perigee.llm import _induced, _seq
from perigee.llm.bpe_transducer import _SPLIT

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rnd = random.Random(11)
VOCABULARY = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(400)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


@pytest.fixture(scope="module")
def texts():
    passage, other = prose(90, 1), prose(60, 2)
    out = [
        None, "", " \t\n", "¿", "one", "one two three", "ONE Two three",
        prose(50, 3) + " " + passage + " " + prose(40, 4), passage, passage, prose(10, 5) + "\n" + passage.upper(), passage + " " + passage,
        other + " x " + other, "ab" * 700, "ab" * 700 + "c", "é" * 450, "x" + "é" * 450, prose(3000, 6), "\n".join(["same line here"] * 9), "z" * 5000,
    ]
    base = prose(120, 7).split()
    for i in range(25):  # copies at all distances from one text
        w = list(base)
        r = random.Random(100 + i)
        for _ in range(i):
            w[r.randrange(len(w))] = r.choice(VOCABULARY)
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s" if i % 3 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[9]], DOCS).withColumn("key", F.lit("clash")).withColumn("spans", F.lit(1)).withColumn("id", F.lit(2)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df) -> dict:
    return {r.doc_id: r for r in df.collect()}


# 1 ---------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, docs, texts, name, tmp_path):
    path, cache = public_tokenizers.path(name), str(tmp_path / "cache")
    got = token_counts.count_tokens(docs, path, cache).collect()
    count = token_counts._counter(path)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        count = lambda xs: [len(library.encode(x, add_special_tokens=False).ids) for x in xs]
    assert len(got) == len(texts) + 1
    for r in got:
        t = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), count([t])[0])
    before = spark.read.parquet(cache).count()
    token_counts.count_tokens(docs, path, cache).collect()
    assert spark.read.parquet(cache).count() == before  # all hits


def test_token_counts_empty(empty):
    assert token_counts.count_tokens(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


# 2 ---------------------------------------------------------------------------


def test_language_accuracy(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    found = language_id.predict(table, language_id.fit(table.where(~language_id.held_out()))).where(language_id.held_out() & F.col("lang").isNotNull()).select("lang", "lang_pred").collect()
    assert len(found) > 20 and sum(r.lang == r.lang_pred for r in found) / len(found) > 0.9


def test_language_edges(spark, empty):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "123 ¿?"), (4, "plain words here")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in language_id.predict(rows, {"en": b"plain words here and there", "xx": b"qqqq zzzz kkkk"}).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "und", "und", "en"] and got[1].rejected and 0 <= got[4].score <= 1
    assert language_id.fit(empty) == {} and language_id.predict(empty, {}).count() == 0
    assert {r.lang_pred for r in language_id.predict(rows, {}).collect()} == {"und"}


def test_language_choice_by_brute_force(spark):
    """Sizes added up one coder and one block at a time; ties, repeats, a long text, junk of letters."""
    import zstandard as z

    rows = spark.read.parquet(f"{SF}/documents.parquet").where(~language_id.held_out())
    learned = language_id.fit(rows)
    sample = [(r.doc_id, r.text) for r in rows.orderBy("doc_id").limit(30).collect()]
    junk = random.Random(5)
    odd = [(-1, " ".join("".join(junk.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(200))), (-2, "zq"), (-3, " ".join(x or "" for _, x in sample) * 4), sample[0], sample[0]]
    table = spark.createDataFrame(sample + odd, "doc_id long, text string")

    def size(data, content, shortest):
        how = z.ZstdCompressionParameters(strategy=z.STRATEGY_LAZY2 if shortest > 3 else z.STRATEGY_BTOPT, min_match=shortest, window_log=18, search_log=4, hash_log=17, chain_log=17, target_length=32, write_content_size=False, write_checksum=False, write_dict_id=False)
        coder = z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=how)
        return sum(len(coder.compress(data[at : at + 2048])) for at in range(0, max(1, len(data)), 2048))

    def judge(text):
        if not re.search(r"[^\W\d_]", text or ""):
            return "und", True
        data = re.sub(rb"[^a-z\x80-\xff]+", b" ", text.lower().encode()).strip()
        sizes = {k: size(data, d, 4) for k, d in learned.items()}
        if sorted(sizes.values())[:1] * 2 == sorted(sizes.values())[:2]:
            sizes = {k: n + size(data, learned[k], 3) for k, n in sizes.items()}
        (best, a), (_, b) = sorted(sizes.items(), key=lambda x: (x[1], list(learned).index(x[0])))[:2]
        return best, b - a < language_id.MARGIN * b

    want = {i: judge(t) for i, t in sample + odd}
    got = language_id.predict(table, learned).collect()
    assert len(got) == len(sample) + len(odd)
    assert {r.doc_id: (r.lang_pred, r.rejected) for r in got} == want
    assert want[-1][1] and sum(r for _, r in (want[i] for i, _ in sample)) <= 1


# 3 ---------------------------------------------------------------------------

SAID = ["</s>[INST] ok [/INST]", "<|turn|>assistant\n", "a\\n<\\|<|end|>", "", "\n\n", "<|", "é😀"]


def test_chat_round_trip(spark):
    rows = [(c, t, ("user", "assistant", "system")[(c + t) % 3], SAID[(c * 3 + t) % len(SAID)]) for c in range(6) for t in range(c + 1)] + [(None, 0, None, None), (3, 1, "user", None), (3, 1, "user", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(9))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.expand(table)).collect()}
    groups: dict = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2] or "", r[3] or "")):
        groups.setdefault(r[0], []).append(r)
    for conv, turns in groups.items():
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == (len(turns), sha(said.encode()), len(loss), sha(loss.encode()))
    examples = chat_format.expand(table).where("not remainder").collect()
    assert len(examples) == sum(r[2] == "assistant" for r in rows)


def test_chat_hands_on_long_examples(spark, monkeypatch):
    """Batches end by their characters, so that large examples don't pile up; texts of a megabyte."""
    monkeypatch.setattr(chat_format, "BATCH_CHARS", 3000)
    long = "<|end|>\\" * (1 << 17)
    rows = [(1, t, ("user", "assistant")[t % 2], "x" * 900) for t in range(12)] + [(2, 0, "user", long), (2, 1, "assistant", long)]
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert (got[1].n_turns, got[1].n_examples, got[1].loss_chars) == (12, 6, 5400)
    assert got[2].loss_sha256 == sha(long.encode()) and got[2].turns_sha256 == sha(f"user\n{long}\nassistant\n{long}\n".encode())


# 4 ---------------------------------------------------------------------------


def brute_hits(texts, items):
    word = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode()))
    out = []
    for t in texts:
        w, hit, names = word(t), set(), set()
        for k, item in items:
            v = word(item)
            size = min(13, len(v))
            for i in range(len(v) - size + 1) if v else ():
                for j in range(len(w) - size + 1):
                    if w[j : j + size] == v[i : i + size]:
                        hit.update(range(j, j + size))
                        names.add(str(k))
        out.append((len(w), len(hit), sorted(names)))
    return out


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_decontaminate(spark, docs, texts, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", block)
    items = [(1, " ".join(texts[7].split()[45:70])), (2, "One, TWO three"), (10, None), (11, "..."), (12, texts[17][500:900]), (12, "one"), (3, " ".join(texts[7].split()[50:64]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.match(docs, bench))
    for i, (n, hit, names) in enumerate(brute_hits(texts, items)):
        r = got[i]
        assert (r["__n_words"], sum(s.hi - s.lo for s in r["__hits"]), r["__items"]) == (n, hit, names)
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and 8 not in {r.doc_id for r in left.collect()}
    assert decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).count() == docs.count()


# 5 and 7 ------------------------------------------------------------------------


def brute_cover(rows, width):
    seen = Counter(tuple(r[i : i + width]) if isinstance(r, list) else r[i : i + width] for r in rows for i in range(len(r) - width + 1))
    out = []
    for r in rows:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - width + 1):
            if seen[tuple(r[i : i + width]) if isinstance(r, list) else r[i : i + width]] > 1:
                gone[i : i + width] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("pieces", [1024, 2])
def test_suffix_dedup(spark, docs, texts, monkeypatch, pieces):
    monkeypatch.setattr(suffix_dedup, "ANCHOR_PIECES", pieces)
    data = [(t or "").encode() for t in texts]
    gone, short = (brute_cover([*data, data[9]], n) for n in (400, 256))
    got = by_id(suffix_dedup.dedup_suffixes(docs))
    for i, x in enumerate(data):
        kept = np.frombuffer(x, np.uint8)[~gone[i]].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone[i].astype(int)])) == 1).sum())
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage_bytes) == (len(x), int(gone[i].sum()), spans, sha(kept), int(short[i].sum()))
    if pieces == 2:
        cut = suffix_dedup.remove_passages(docs)
        assert cut.columns == docs.columns and cut.count() == docs.count()


def test_induced_sorting(monkeypatch):
    monkeypatch.setattr(_induced, "QUEUE_BYTES", 512)
    for seed in range(12):
        r = random.Random(seed)
        pieces = [bytes(r.choice(b"ab" if seed % 2 else b"abcdefgh") for _ in range(r.randint(1, 300))) for _ in range(8)]
        width = r.choice([3, 7, 20])
        count = Counter(p[i : i + width] for p in pieces for i in range(len(p) - width + 1))
        got = _induced.repeated_starts([np.frombuffer(p, np.uint8) for p in pieces], width)
        for p, flags in zip(pieces, got):
            want = [count[p[i : i + width]] > 1 for i in range(len(p) - width + 1)]
            assert flags[: len(want)].tolist() == want and not flags[len(want) :].any()


def test_substring_dedup(spark, docs, texts):
    word = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
    rows = [word(t) for t in texts]
    gone = brute_cover([*rows, rows[9]], 35)
    got = by_id(substring_dedup.dedup_substrings(docs))
    for i, w in enumerate(rows):
        kept = b" ".join(x for x, g in zip(w, gone[i]) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256, got[i].kept_text) == (len(w), int(gone[i].sum()), sha(kept), kept.decode())


def test_compaction(spark):
    """Links only where one path ends and one begins; cycles close; a loop on one node stands alone."""
    edges = [(1, 10, 11), (2, 11, 12), (3, 12, 13), (4, 12, 14), (5, 13, 15), (6, 20, 21), (7, 21, 22), (9, 22, 20), (8, 30, 30)] + [(100 + i, 1000 + i, 1001 + i) for i in range(50)]
    got = {r.path: r.unitig for r in substring_dedup.compacted(spark.createDataFrame(edges, "path long, tail long, head long")).collect()}
    assert got == {2: 1, 5: 3, 6: 6, 7: 6, 9: 6} | {100 + i: 100 for i in range(1, 50)}


def test_substring_paths(spark):
    """A passage in three documents is one compacted path, and one that branches is three."""
    p, q, tail = prose(100, 81), prose(90, 82), prose(80, 83)
    rows = [(1, prose(40, 84) + " " + p), (2, p + " " + prose(40, 85)), (3, p), (4, q + " " + tail), (5, q + " " + tail), (6, q + " " + prose(60, 86)), (7, q + " " + prose(60, 86))]
    got = by_id(substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i].n_paths for i in (1, 2, 3)] == [1, 1, 1] and [got[i].n_removed for i in (1, 2, 3)] == [100, 100, 100]
    assert [got[i].n_paths for i in (4, 5, 6, 7)] == [2, 2, 2, 2]


def test_long_texts(spark):
    """Texts of a megabyte go whole through the operators, as brute force or the owning library says."""
    from tokenizers import Tokenizer

    one = prose(170_000, 31)
    half = one[: len(one) // 2]
    rows = spark.createDataFrame([(1, one), (2, half), (3, "é" * 500_000), (4, prose(200, 32))], "doc_id long, text string").withColumn("source", F.lit("s")).repartition(2)
    data = {1: one.encode(), 2: half.encode(), 3: "é".encode() * 500_000, 4: prose(200, 32).encode()}
    assert len(data[1]) > 1 << 20
    s5, s7, s10 = by_id(suffix_dedup.dedup_suffixes(rows, texts=False)), by_id(substring_dedup.dedup_substrings(rows)), by_id(near_dedup.near_duplicates(rows))
    assert [s5[i].n_removed for i in (1, 2, 3, 4)] == [len(half), len(half), 1_000_000, 0]
    n = len(half.split())
    assert s7[4].n_removed == 0 and n - 1 <= s7[2].n_removed <= n and s7[1].n_removed == s7[2].n_removed
    assert [s10[i].component_id for i in (1, 2, 3, 4)] == [1, 2, 3, 4] and s10[3].n_shingles == 1
    q = by_id(quality_rules.quality(rows))
    assert q[1].n_words == 170_000 and q[3].n_words == 1 and q[3].word_chars == 500_000
    words = token_counts.count_tokens(rows.where("doc_id <> 3"), public_tokenizers.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert by_id(words)[2].n_tokens == len(library.encode(half, add_special_tokens=False).ids)
    bench = spark.createDataFrame([(1, " ".join(one.split()[140_000:140_020]))], "item_id long, text string")
    hits = by_id(decontaminate.match(rows, bench))
    assert hits[1]["__n_words"] == 170_000 and [(h.lo, h.hi) for h in hits[1]["__hits"]] == [(140_000, 140_020)]
    bytes_ = by_id(bpe_transducer.encode(rows.where("doc_id <> 2"), public_tokenizers.path("byte_bpe_50k.json"), ids=False))
    assert bytes_[1].decoded_sha256 == sha(data[1]) and bytes_[3].decoded_sha256 == sha(data[3])


def test_empty_tables(empty):
    for f in (suffix_dedup.dedup_suffixes, substring_dedup.dedup_substrings, quality_rules.quality):
        assert f(empty).count() == 0
    assert bpe_transducer.encode(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


# 6 ---------------------------------------------------------------------------


def test_quality_rules(spark):
    footer = "Click here to Subscribe now"
    rows = [(i, "h" if i % 2 else None, "\n".join([prose(12, i), "  click  here to subscribe NOW ", footer])) for i in range(40)]
    rows += [(50, "h", footer), (51, "h", footer + "\n" + footer + "\n" + prose(3, 1)), (52, "h", None), (53, "h", ""), (54, "other", footer + " " + footer), (55, "h", "a b # $ |\na b # $ |\n" + prose(12, 2)), (55, "h", prose(30, 3))]
    holds: dict = {}
    rows += [(i, "h", t) for i, s, t in rows[:3]] * 4  # documents of several rows count once
    rows += [(None, "h", "no id\n" + prose(12, 9))] * 12  # rows without an id count each
    table = spark.createDataFrame([(i, t, s) for i, s, t in rows], "doc_id long, text string, source string").withColumn("host", F.lit("clash"))
    got = sorted(quality_rules.quality(table).collect(), key=lambda r: (-9 if r.doc_id is None else r.doc_id, r.n_words, r.kept))
    normal = lambda line: " ".join(re.sub("[A-Z]", lambda m: m.group().lower(), line).split())
    for k, (i, s, t) in enumerate(rows):
        for line in {normal(x) for x in (t or "").split("\n")} - {""}:
            holds.setdefault((s, line), set()).add(("row", k) if i is None else i)
    holds = {k: len(v) for k, v in holds.items()}
    size = Counter(s for s, _ in {(s, ("row", k) if i is None else i) for k, (i, s, _) in enumerate(rows)})
    want = []
    for i, s, t in rows:
        w, lines = (t or "").split(), [x for x in (t or "").split("\n") if x.split()]
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeated = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        removed = sum(len(x.split()) for x in lines if holds[s, normal(x)] > max(10, 0.01 * size[s]))
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t or ""), len(lines) - len(set(lines)), len(repeated), removed, failed, not failed and len(w) - removed >= 0.5 * len(w)))
    assert [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.removed_words, r.base_failed, r.kept) for r in got] == sorted(want, key=lambda r: (-9 if r[0] is None else r[0], r[1], r[-1]))


def test_quality_cuts_frequent_lines(spark):
    """Cleaned text and line numbers, at both ends of host size."""
    rows = [(i, f"{prose(12, i)}\n\n Read  MORE here \nlast {i}", "ten") for i in range(10)]  # as many as the least number: nothing goes
    rows += [(100 + i, f"{prose(12, i)}\n\n Read  MORE here \nlast {i}\nread more here", "eleven") for i in range(11)]
    big = [(1000 + i, f"{prose(12, i)}\n" + ("at limit" if i < 12 else "over limit" if i < 25 else f"no limit {i}"), "big") for i in range(1200)]
    table = spark.createDataFrame([*rows, *big, rows[10], (5000, None, "eleven")], "doc_id long, text string, source string").repartition(3)
    got = quality_rules.quality(table).collect()
    assert len(got) == 10 + 11 + 1200 + 2
    for r in got:
        i = r.doc_id
        if i == 5000:
            assert r.text is None and r.removed_lines == []
        elif i < 100:
            assert (r.text, r.removed_lines) == (rows[i][1], [])
        elif i < 1000:
            assert (r.text, r.removed_lines, r.removed_words) == (f"{prose(12, i - 100)}\n\nlast {i - 100}", [2, 4], 6)
        else:  # 12 of 1200 are at the share of 1 %, 13 above it
            assert (r.text, r.removed_lines) == ((prose(12, i - 1000), [1]) if 12 <= i - 1000 < 25 else (big[i - 1000][1], []))


# 8 ---------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [1 << 16, 7])
def test_bpe(spark, docs, texts, monkeypatch, chunk):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    odd = ["it's  we'll\t\n x", "<|endoftext|>", "a<|endoftext|>b <|endof", "   ", "12 345ab—é 漢字😀", "\u0000﻿", "    lead", "tail   ", "\r\n\r\n a", "é" * 900, "a b" * 400, "!" * 700, " " * 900 + "x", "1" * 777, "'" * 300 + "s"]
    encoder, decoder = bpe_transducer.Encoder(path), bpe_transducer.Decoder(path)
    for t in [*odd, *(x for x in texts if x)]:
        pieces = list(encoder.encode(bpe_transducer.chunks(t, chunk)))
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(pieces), "<u4").tolist() == want, t[:50]
        assert "".join(decoder.decode(pieces)) == library.decode(want, skip_special_tokens=False) == t
    m = encoder.m
    pairs = random.Random(8)
    some = sorted(m.bytes_of)
    for a, b in [(pairs.choice(some[:5000]), pairs.choice(some[:5000])) for _ in range(3000)]:
        joint = m.bytes_of[a] + m.bytes_of[b]
        try:
            one = _SPLIT.findall(joint.decode()) == [joint.decode()]
        except UnicodeDecodeError:
            one = False
        if one and not {a, b} & set(m.special.values()):
            assert m.stand(a, b) == (library.encode(joint.decode(), add_special_tokens=False).ids == [a, b])
    if chunk > 7:
        got = by_id(bpe_transducer.encode(docs, path))
        assert all(got[i].n_tokens == len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts))


def test_bpe_reads_each_byte_once(monkeypatch):
    """Words that were never met cost a step of the read a byte, and no look at the vocabulary for every start of a token."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library, draw, looks = bpe_transducer.Encoder(path), Tokenizer.from_file(path), random.Random(3), []

    class Counted(dict):
        def get(self, *a):
            looks.append(1)
            return dict.get(self, *a)

    monkeypatch.setattr(encoder.m, "ids", Counted(encoder.m.ids))
    words = ["".join(draw.choice("abcdeé") for _ in range(draw.randrange(4, 60))) for _ in range(3000)]
    for text in (" ".join(words), "".join(words)):
        got = np.frombuffer(b"".join(encoder.encode(bpe_transducer.chunks(text, 1000))), "<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids
    assert len(looks) < sum(map(len, words))


# 9 ---------------------------------------------------------------------------


@pytest.mark.parametrize(
    "html,want",
    [
        (None, ""),
        ("", ""),
        ("<html><body><nav><a href=/>Menu</a></nav><article><h1>Title &amp; more</h1><p>First\n  <b>bold</b> text.<p>Second&nbsp;one.<script>x='</p>'</script></article><footer>Foot</footer></body></html>", "Title & more\n\nFirst bold text.\n\nSecond one."),
        ("<article><p>Text</p><aside>Side</aside><div class='ad'>Buy</div><div class=comments><p>Reader said</p></div><p>More</p></article>", "Text\n\nMore"),
        ("<nav>only</nav>", ""),
        ("<article><p>Cut off", "Cut off"),
        ("<article><p>a<br>b</p><ul><li>one<li>two</ul></article>", "a b\n\none\n\ntwo"),
    ],
)
def test_html(html, want):
    assert html_extract.main_text(html or "") == want


def test_html_query(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>x</p></article>"), (1, "u", "<article><p>x</p></article>"), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(pages).collect()) == [(1, "x", 1), (1, "x", 1), (2, "", 0)]


def test_html_without_article():
    body = "".join(f"<p>{prose(60, i)}</p>" for i in range(6))
    got = html_extract.main_text(f"<body><div><a href=1>a</a><a href=2>b</a><a href=3>c</a></div>{body}<div><a href=4>d</a><a href=5>e</a></div></body>")
    assert got.count("\n\n") >= 5 and prose(60, 3) in got


def test_html_story_outside_marked_teasers():
    story = [prose(60, i) for i in range(6)]
    teasers = "".join(f"<article><h3><a href={i}>Teaser {i}</a></h3><p>Short words</p></article>" for i in range(5))
    got = html_extract.main_text(f"<body class='has-sidebar'><div>{''.join(f'<p>{x}</p>' for x in story)}</div>{teasers}</body>")
    assert all(x in got for x in story)


def test_html_ratios_decide_within_the_mark():
    links = "<div><a href=1>a</a><a href=2>b</a><a href=3>c</a></div>"
    got = html_extract.main_text(f"<article><p>{prose(60, 1)}</p><p>{prose(60, 2)}</p>{links}{links}</article>")
    assert got == f"{prose(60, 1)}\n\n{prose(60, 2)}"


def test_html_smoothing_decides(monkeypatch):
    """A long line among links is no content, a short one among paragraphs is: both by their neighbours."""
    links = "".join(f"<li><a href={i}>go</a></li>" for i in range(6))
    story = [*(prose(50, i) for i in range(3)), "Yes.", *(prose(50, i) for i in range(3, 6))]
    page = f"<body><div><ul>{links}</ul><p>{prose(60, 90)}</p><ul>{links}</ul></div><div>{''.join(f'<p>{x}</p>' for x in story)}</div></body>"
    assert html_extract.main_text(page) == "\n\n".join(story)
    monkeypatch.setattr(html_extract, "SIGMA", 0)
    assert html_extract.main_text(page) != "\n\n".join(story)


def test_html_by_brute_force(spark):
    """Ratios, Gaussian, two-means, region and trimming spelled out line by line over whole pages."""
    import math

    def border(x):
        low, high = min(x), max(x)
        for _ in range(32):
            under, over = [v for v in x if v <= (low + high) / 2], [v for v in x if v > (low + high) / 2]
            if not under or not over or (math.fsum(under) / len(under), math.fsum(over) / len(over)) == (low, high):
                break
            low, high = math.fsum(under) / len(under), math.fsum(over) / len(over)
        return (low + high) / 2

    def smooth(ratio, part):
        g = {d: math.exp(-d * d / 2) for d in range(-2, 3)}
        near = lambda i: [d for d in g if 0 <= i + d < len(ratio) and part[i + d]]
        return [sum(g[d] * ratio[i + d] for d in near(i)) / sum(g[d] for d in near(i)) if part[i] else 0.0 for i in range(len(ratio))]

    def brute(html):
        p = html_extract._Lines()
        p.feed(html)
        lines = p.finish()
        live = [bool(t) and not gone for t, _, gone, _ in lines]
        if not any(live):
            return ""
        ratio = [math.log1p(len(t) / max(1, tags)) for t, tags, _, _ in lines]
        s = smooth(ratio, live)
        b = border([v for v, ok in zip(s, live) if ok] + [0.0])
        chain = lambda c: [c] + chain(p.parents[c]) if c >= 0 else []
        heavy = [(len(t), chain(c)) for (t, _, _, c), v, ok in zip(lines, s, live) if ok and v >= b]
        at = 0
        while not p.marks[at] and not any(c[0] == at for _, c in heavy):
            held = {k: sum(n for n, c in heavy if k in c) for k in range(len(p.parents)) if p.parents[k] == at}
            if not held or max(held.values()) < max(0.9 * sum(n for n, c in heavy if at in c), 1e-9):
                break
            at = max(held, key=lambda k: (held[k], -k))
        region = [ok and at in chain(c) for ok, (_, _, _, c) in zip(live, lines)]
        inner, outer = smooth(ratio, region), smooth(ratio, [a and not r for a, r in zip(live, region)])
        s = [x + y + (math.log(32) if at and r else 0) for x, y, r in zip(inner, outer, region)]
        b = border([v for v, ok in zip(s, live) if ok] + [0.0])
        good = [i for i, r in enumerate(region) if r and s[i] >= b and len(lines[i][0]) >= lines[i][1]]
        lo, hi = (good[0], good[-1]) if good else (0, len(lines))
        return "\n\n".join(lines[i][0] for i, r in enumerate(region) if r and lo <= i <= hi)

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    rows = pages.collect()
    assert len(rows) == len(got) and all(got[r.page_id] == brute(r.html or "") for r in rows)
    bare = [re.sub(r"</?(article|main)[^>]*>", lambda m: "</div>" if m.group()[1] == "/" else "<div>", r.html or "") for r in rows]
    assert all(html_extract.main_text(x) == brute(x) for x in bare)
    assert sum(html_extract.main_text(x) == got[r.page_id] for x, r in zip(bare, rows)) > 0.9 * len(rows)  # the region is found without its mark


def test_html_long_page():
    """Far beyond the parser's chunk: a megabyte in one block and ten thousand blocks."""
    assert html_extract.main_text(f"<article><p>{'word ' * 250_000}</p></article>") == ("word " * 250_000).strip()
    many = [f"Paragraph {i} says as much as the others" for i in range(10_000)]
    assert html_extract.main_text("<nav><a href=/>x</a></nav><div>" + "".join(f"<p>{x}" for x in many) + "</div>") == "\n\n".join(many)


def test_html_uneven_paragraphs():
    body = [*["x" * 150] * 4, "y" * 8000, *["x" * 150] * 4]
    assert html_extract.main_text("<body>" + "".join(f"<p>{x}</p>" for x in body) + "</body>") == "\n\n".join(body)


# 10 --------------------------------------------------------------------------


def test_near_dedup(spark, docs, texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    got = by_id(near_dedup.near_duplicates(docs))
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(sets))] == [(len(s), label[i], label[i] == i) for i, s in enumerate(sets)]


def test_near_dedup_ids(spark):
    """Null ids, rows of one id, and near copies of either text of an id, whichever row comes first."""
    a, b = prose(300, 71), prose(300, 72)
    rows = [(None, prose(20, 1)), (None, prose(20, 1)), (5, prose(20, 1)), (4, prose(20, 1)), (4, prose(20, 2)), (9, prose(20, 2)), (9, prose(20, 2))]
    rows += [(54, a), (54, b), (59, a + " one two"), (61, b + " one two"), (70, prose(300, 73))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == 12 and {(r.doc_id, r.component_id) for r in got} == {(None, None), (5, 4), (4, 4), (9, 4), (54, 54), (59, 54), (61, 54), (70, 70)}


def test_near_dedup_large_group(spark):
    """Many edits of one text, about as far from each other as the limit: as brute force."""
    base, rows = prose(150, 74).split(), []
    for i in range(120):
        r, w = random.Random(i), list(base)
        for _ in range(4):
            w[r.randrange(len(w))] = r.choice(VOCABULARY)
        rows.append((1000 - i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(146)} for i, t in rows}
    label = {i: i for i in sets}
    while True:
        new = {i: min(label[j] for j in sets if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])) for i in sets}
        if new == label:
            break
        label = new
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table).collect()} == label


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, r.randrange(101, 160)) for _ in range(80)] + [(7, 7), (None, 3), (500, 400)]
    got = {x.id: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and {got[b] for a, b in edges if a == 100} == {100} and got[500] == 400


# pipeline --------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    """Every stage by value, over ids that are null or occur twice, and over an empty table."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["language ID", "MinHash near-dedup", "suffix-array dedup", "benchmark decontamination", "BPE encoding and decoding"]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    some = [r.text for r in table.where("lang = 'en'").orderBy("doc_id").limit(12).collect() if len(r.text) > 900]
    passage, item = " ".join(some[0].split()[:60]), " ".join(some[1].split()[:40])
    texts = [(1, some[2]), (2, some[2] + " and so on"), (3, some[3] + " " + passage), (4, passage + "\n" + some[4]), (5, item), (None, some[5]), (7, some[6]), (7, some[6]), (-8, None), (-9, "123")]
    docs = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in texts], DOCS)
    docs.unionByName(table.select(docs.columns)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    every = spark.read.parquet(str(tmp_path / "documents.parquet"))
    named = stages["language ID"](spark, every, str(tmp_path))
    left = {r.doc_id for r in named.select("doc_id").collect()}
    assert {1, 2, 3, 4, 5, 7, None} <= left and not {-8, -9} & left
    docs = named.where("doc_id is null or doc_id < 10 and lang = 'en' and source is null")
    once = stages["MinHash near-dedup"](spark, docs, str(tmp_path))
    assert once.columns == docs.columns and sorted(str(r.doc_id) for r in once.collect()) == ["1", "3", "4", "5", "7", "None"]
    cut = stages["suffix-array dedup"](spark, once, str(tmp_path))
    got = by_id(cut)
    assert got[1].text == some[2] and got[3].text.startswith(some[3]) and passage[20:-20] not in got[3].text and got[4].text.endswith(some[4])
    assert got[3].n_chars == len(got[3].text) and len(got) == 6
    clean = stages["benchmark decontamination"](spark, cut, str(tmp_path))
    assert set(by_id(clean)) == {1, 3, 4, 7, None}
    coded = by_id(stages["BPE encoding and decoding"](spark, clean, str(tmp_path)))
    assert all(coded[i].decoded_sha256 == sha(got[i].text.encode()) for i in coded) and set(coded) == {1, 3, 4, 7, None}
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_span_hash_is_by_content():
    x = _seq.mix(np.arange(50, dtype=np.uint64) % np.uint64(7))
    h = _seq.span_hash(x, np.array([0, 7, 14, 1]), np.array([5, 12, 19, 6]))
    assert h[0] == h[1] == h[2] != h[3]
    assert len(set(_seq.span_hash(x, np.zeros(20, np.int64), np.arange(20)).tolist())) == 20
    assert _seq.kmer_hash(x, 7)[0] == _seq.kmer_hash(x, 7)[7] and _seq.kmer_hash(x, 1)[3] == _seq.kmer_hash(x, 1)[10]


def test_thue_morse_texts_differ():
    """Texts on which polynomial hashes modulo a power of two agree, whatever the base."""
    for n in (1024, 2048, 4096):
        t = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
        swapped = t.translate(str.maketrans("ab", "ba"))
        data = np.frombuffer((t + swapped).encode(), np.uint8)
        h = _seq.span_hash(_seq.byte_symbols(data), np.array([0, n]), np.array([n, 2 * n]))
        k = _seq.kmer_hash(_seq.byte_symbols(data), n)
        assert h[0] != h[1] and k[0] != k[n]
