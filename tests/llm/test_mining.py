"""Spelling variants, token counts and collocations against brute force: nulls, ties, repeated rows, long words and texts, empty tables, clashing columns."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from helpers import run_sql, same
from pyspark.sql import functions as F

from terrace.llm import phrases, spelling, tokens
from terrace.llm.oracles import ORACLES
from terrace.llm.queries import QUERIES

PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# ---- 11


def apart_by_one(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return len(b) == len(a) + 1 and a[k:] == b[k + 1 :]


def variants_by_force(rows):
    count = collections.Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = lower(r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 31 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            if len(r) >= 7:
                count[r] += 1
    count = {w: n for w, n in count.items() if n >= 2}
    by = collections.defaultdict(list)
    for w in count:
        by[len(w)].append(w)
    told = {}
    for w, n in count.items():
        near = [x for size in (len(w) - 1, len(w), len(w) + 1) for x in by[size] if x != w and apart_by_one(w, x)]
        best = min(((-count[x], x) for x in near), default=(0, None))
        form = best[1] if -best[0] >= 10 * n else None
        told[w] = (form, n, len(near), count[form] if form else None)

    def root(w):
        while told[w][0]:
            w = told[w][0]
        return w

    return {w: (v[0], root(w), *v[1:]) for w, v in told.items()}


def variant_rows():
    rng = random.Random(3)
    gene, bound = ("".join(rng.choice("acgt") for _ in range(n)) for n in (300, 66))  # keys of 64 and 65 code points are of different kinds
    near = [gene, gene[:100] + "x" + gene[101:], gene[:50] + gene[51:], gene + "z", bound, bound[:-1], bound[:-2], bound[:30] + "t" + bound[31:], bound[:-1] + "y", *["Éléphants éléphant ÉLÉPHANTS éléphants"] * 3, *[gene] * 12]
    rows = [(None, "Wonderful wonderful wondeful wonderful"), (1, None), (2, ""), (3, "12 -- 34")] + [(k, " ".join("a" * n for n in (70, 71, 72, 7, 8))) for k in (4, 5, 5)]
    rows += [(6, "misxissippi mississipi misssissippi misxissippi " + "mississippi " * 40)] * 2 + [(10 + k, " ".join(near)) for k in range(6)]
    rows += [(100 + k, " ".join("".join(rng.choice("ab") for _ in range(rng.choice([7, 8, 9]))) for _ in range(200))) for k in range(20)]  # dense: up to 25 neighbours a word
    return rows


def told(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_variants(spark):
    rows = variant_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("word", "n", "key", "place", "id", "head", "root", "form")})
    want = variants_by_force(rows)
    assert sum(v[0] is not None for v in want.values()) > 3 and max(v[2] for v in want.values()) > 10
    assert told(spelling.variants(df)) == want
    assert told(spelling.variants(df.repartition(7), long=8)) == want  # nearly all keys as hashes


def test_spelling_chain_and_very_long_words(spark):
    chain = [("commonest", 3000), ("commonesd", 250), ("commonexd", 20), ("coxmonexd", 2)]
    text = " ".join(w for w, n in chain for _ in range(n))
    long = "abcdefgh" * 5000
    rows = [(None, text), (1, long), (2, long + " " + long[:-1]), (3, long[:-1]), (4, "q" * 30_000), (5, "q" * 30_000)]
    got = told(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), every=1 << 31))
    assert {w: got[w][1] for w, _ in chain} == {w: "commonest" for w, _ in chain}
    assert got["coxmonexd"][0] == "commonexd"
    assert got[long][2] == got[long[:-1]][2] == 1 and got["q" * 30_000][2] == 0


def test_spelling_empty(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (None, "one single")], "doc_id long, text string")).count() == 0


def test_digests_equal_the_library():
    words = [b"a", "é".encode() * 40, b"x" * 3000, b"word"]
    buf = np.frombuffer(b"".join(words) + bytes(8), np.uint8)
    cut = np.cumsum([0, *map(len, words)])
    state = np.array([zlib.crc32(b"12:")] * len(words), np.uint32)
    assert spelling.digests(buf, cut[:-1], cut[1:], state).tolist() == [zlib.crc32(b"12:" + w) for w in words]


# ---- 12


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(5)
    signs = [*"abstmdrevl'' \n\t  .!123éñ日  \x1c\x85՘\U0001f600", "'s", "'ll", "'re", " 't", "<|endoftext|>", "  ", "\r\n", "<|", "'LL"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += ["", None, "x" * 5000, " " * 3000 + "a", "\n" * 1500, "".join(rng.choice("abcdefgh") for _ in range(20_000)), "ab" * 3000, "a<|endoftext|><|endoftext|>  ", "<|endoftext|", "日本語" * 700]
    return texts + ["x" * tokens.LONG, "y" * (tokens.LONG + 1), "ünï" * tokens.LONG]


def test_token_counts_equal_the_library(spark, library):
    texts = odd_texts()
    want = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    df = spark.createDataFrame([(i, t, "clash", -1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string, n_tokens int")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.digest(tokens.token_counts(df, PATH)).collect()}
    assert got == {i: (len((t or "").encode()), n, n > 512) for i, (t, n) in enumerate(zip(texts, want, strict=True))}
    empty = tokens.token_counts(df.limit(0), PATH)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_bytes", "n_tokens"]
    twice = spark.createDataFrame([(None, "some text"), (1, "some text"), (1, "some text")], "doc_id long, text string")
    assert [r["n_tokens"] for r in tokens.token_counts(twice, PATH).collect()] == [2, 2, 2]


def test_token_counts_of_the_whole_table(spark, tiny, library):
    want = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op12_token_counts"](spark, tiny).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in want.items()}


def test_classes_are_those_of_the_library(library):
    """Every assigned kind of character, next to each sign that a class could join."""
    classes = tokens.Classes()
    points = [*range(0x3000), *range(0x3000, 0xD800, 7), *range(0xE000, 0x110000, 37)]
    for lo in range(0, len(points), 5000):
        text = "".join(f"a{chr(p)}1{chr(p)} !{chr(p)}\n" for p in points[lo : lo + 5000])
        at, _ = tokens.pretokens(*_bytes(text), classes, [])
        cuts = np.append(0, np.cumsum([len(c.encode()) for c in text]))
        assert at.tolist() == [int(cuts[span[0]]) for _, span in library.pre_tokenizer.pre_tokenize_str(text)]


def _bytes(text):
    raw = text.encode()
    return np.frombuffer(raw + bytes(8), np.uint8), np.array([0, len(raw)], np.int64)


def test_long_run_takes_about_linear_time(library):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))
    n_bytes, n = tokens.counted(pa.array([text]), tokens.load(PATH), tokens.Classes())
    assert n_bytes[0] == 300_000 and n[0] == len(library.encode(text, add_special_tokens=False).ids)


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        tokens.load(public_tokenizers.path("word_bpe_49k.json"))


# ---- 13


def collocations_by_force(rows, least, top=2000, longest=5):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        kept, inside = {p: a for p, a in c.items() if a >= least and len(p) > 1}, collections.Counter()
        for p, a in kept.items():
            for j in range(2, len(p)):
                for i in range(len(p) - j + 1):
                    inside[p[i : i + j]] = max(inside[p[i : i + j]], a)
        scored = []
        for p, a in kept.items():
            if inside[p] < a:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def phrase_rows():
    rng = random.Random(1)
    rows = [(None, "a b a b a b. a a a a\tA a"), ("und", "b a"), ("en", None), ("en", ""), ("xx", " .. !!\n"), ("en", "one piece " * 3000), ("one", "w" * 20_000 + " x")]
    return rows + [("en", " ".join(rng.choice(["of", "The", "x", "été", "y.", " z"]) for _ in range(200))) for _ in range(30)] + [(f"l{k}", "same words here. " * 3) for k in range(40)]


@pytest.mark.parametrize("size", [50, 1 << 20])
def test_collocations(spark, size):
    rows = phrase_rows()
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "lang string, text string, shard int, phrase string").repartition(3)
    for least, top in ((2, 10**6), (5, 7)):
        assert sorted(map(tuple, phrases.collocations(df, least=least, top=top, size=size).collect())) == collocations_by_force(rows, least, top)


def test_collocations_empty_and_shorter(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "lang string, text string")
    for longest in (2, 3):
        assert sorted(map(tuple, phrases.collocations(df, least=3, longest=longest).collect())) == collocations_by_force(rows, 3, longest=longest)


def test_slices_change_nothing(spark, monkeypatch):
    rows = phrase_rows()
    row = next(r for r in phrases.shards(spark.createDataFrame(rows, "lang string, text string").coalesce(1)).collect() if r["lang"] == "en")
    bitmaps = {c: np.frombuffer(bytes(row[c]), t) for c, t in (("entries", np.int32), ("block", np.int32), ("bits", np.uint8))}
    every = phrases.Filter(np.full(1 << 10, np.iinfo(np.uint64).max))
    hashes = phrases._hashes(pa.array(row["words"]))
    found = []
    for most in (1 << 18, 7):
        monkeypatch.setattr(phrases, "SLICE", most)
        found.append(sorted((tuple(p), int(n)) for path, count in phrases._Vertical(bitmaps, hashes, phrases._seed("en"), [every], 1).phrases(4) for p, n in zip(path.tolist(), count, strict=True)))
    assert found[0] == found[1] and len(found[0]) > 100


def test_filters_change_nothing(spark):
    """A filter so small that it lets nearly all pass."""
    rows = phrase_rows()
    assert sorted(map(tuple, phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), least=5, filter_bits=7).collect())) == collocations_by_force(rows, 5)


def test_scores_pass_64_bits(spark):
    """Counts of 10^9 as a table would have them: 1000 * a * n is beyond 64 bits, and the quotient is exact."""
    row = spark.sql("select (cast(1000 * a as decimal(20,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as s from values (3000000007L, 90000000000011L, 4000000009L, 5000000029L) as t(a, n, l, r)").first()
    assert row["s"] == 1000 * 3000000007 * 90000000000011 // (4000000009 * 5000000029)


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op13_collocations"])
def test_sql_on_odd_rows(spark, tmp_path, name):
    rows = [(i, t, lang) for i, (lang, t) in enumerate(phrase_rows())] + [(1000 + (i or 0), t, "en") for i, t in variant_rows()]
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "lang"])
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    narrow = frame[frame["text"].str.len().fillna(0) < 15_000]
    spark.createDataFrame(narrow, "doc_id long, text string, lang string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    same(QUERIES[name](spark, str(tmp_path)).toPandas(), run_sql("/root/testdata/sf0.001", ORACLES[name], documents=narrow))


# ---- bounds of the earlier operators


@pytest.mark.parametrize("frequent", [2500, 5000])
def test_toxic_pair_of_rare_terms(frequent):
    """Two terms of some 120 texts each that are harmless alone and toxic together, behind thousands of more frequent ones, are learnt."""
    from terrace.llm import toxicity

    rng = np.random.default_rng(8)
    n = 6000
    y = (rng.random(n) < 0.1).astype(float)
    texts = [np.flatnonzero(rng.random(frequent) < 0.025) for _ in range(n)]  # about 150 texts each
    a, b = frequent, frequent + 1
    both, only_a, only_b = np.arange(12), np.arange(12, 120), np.arange(120, 228)
    y[both], y[only_a], y[only_b] = 1, rng.random(108) < 0.02, rng.random(108) < 0.02
    for rows, more in ((both, [a, b]), (only_a, [a]), (only_b, [b])):
        for i in rows:
            texts[i] = np.append(texts[i], more)
    m = toxicity.fit([t.astype(np.int32) for t in texts], y)
    assert {a, b} <= set(m.slots.tolist())
    at = {s: i for i, s in enumerate(m.slots.tolist())}
    score = lambda ids: toxicity.raw(m, np.zeros(len(ids), np.int64), np.array([at[i] for i in ids]), 1)[0]
    assert score([a, b]) > max(score([a]), score([b])) + 1


def test_repeated_labelled_rows_are_bounded(spark):
    from terrace.llm import toxicity

    rows = [(i, f"nice text number {i}") for i in range(1, 60)] + [(7, f"other text {k}") for k in range(500)] + [(8, "same text")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(1, 60)], "doc_id long, toxic int")
    seen = []
    fit = toxicity.fit
    try:
        toxicity.fit = lambda texts, y: seen.append(len(texts)) or fit(texts, y)
        toxicity.train(docs, labels, sample=50)
    finally:
        toxicity.fit = fit
    assert seen[0] <= 50 * 1.5 * 1.5 + 2 * 50


def test_decontamination_holds_one_block(spark):
    """A benchmark of many blocks: no plan has more than one block's Python stages, and hits equal those of one block."""
    from terrace.llm import decontam

    rng = random.Random(4)
    item = lambda k: " ".join(f"w{rng.randrange(500)}" for _ in range(40))
    items = [(k, item(k)) for k in range(60)]
    docs = spark.createDataFrame([(i % 30, " ".join([item(0), items[i % 60][1][:120] if i % 3 else "", item(1)])) for i in range(90)] + [(None, None), (1, "")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = (decontam.contamination(docs, bench, block_bytes=b) for b in (1 << 23, 700))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 2
    key = lambda df: sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_words"], r["n_hit"], str(r["hit_spans"]), r["item_ids"]) for r in df.collect())
    assert key(one) == key(many) and sum(r[3] > 0 for r in key(one)) > 20


def test_groups_are_bounded_in_bytes(monkeypatch):
    from terrace.llm import substring

    monkeypatch.setattr(substring, "GROUP_BYTES", 1000)
    monkeypatch.setattr(substring.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 3})()))
    batch = pa.RecordBatch.from_pydict({"i": list(range(10)), "text": ["x" * n for n in (10, 2000, 10, 500, 480, 30, 0, 990, 1, 1)]})
    got = [x - (3 << 32) for b in substring._dealt(iter([batch.slice(0, 4), batch.slice(4)])) for x in b.column("grp").to_pylist()]
    assert got == [0, 1, 2, 2, 2, 3, 3, 4, 4, 4]


def test_collocations_send_a_part_of_the_words_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [("en", " ".join(f"w{k}" for k in rng.zipf(1.3, 400) % 300)) for _ in range(60)]
    sent, longer = [], phrases._longer

    def counted(*args):
        out = longer(*args)
        sent.append((args[2], out.count()))
        return out

    monkeypatch.setattr(phrases, "_longer", counted)
    found = sorted(map(tuple, phrases.collocations(spark.createDataFrame(rows, "lang string, text string").coalesce(2), least=5, size=4000).collect()))
    assert found == collocations_by_force(rows, 5)
    pairs = [n for known, n in sent if known == 1]
    assert sum(pairs) > 0.3 * 24_000 and max(pairs) < 0.6 * sum(pairs)
