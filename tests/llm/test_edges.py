"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from helpers import run_sql, same
from pyspark.sql import functions as F

from terrace.llm import chat, decontam, licenses, linededup, mixing, neardup, substring, toxicity, vectors, webtext
from terrace.llm.components import components
from terrace.llm.oracles import ORACLES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PLAIN, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def words(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return [rng.choice(["ab", "cdé", "x", "häuser", "longerword", "¡q", "zz.", "7"]) + rng.choice("abcdefgh") for _ in range(n)]


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, shifted repeats, odd white space, nulls, one long word, one long text."""
    base, passage = words(300, 1), words(80, 2)
    near = base.copy()
    near[150] = "changed"
    texts = [
        " ".join(base), " ".join(base), " ".join(near), "\t\n".join(base[:120]) + " \x0b tail", " ".join(words(40, 3) + passage + words(30, 4)), " ".join(words(7, 5) + passage + words(90, 6)),
        " ".join(passage[:60]), " ".join(passage[:49]), None, "", "  \n ", "one", "one", "two words", "TWO words", "x" * 5000, " ".join(words(5000, 7)), " ".join(base[100:160] * 3),
        "line a\nline b\nline c\nline d\nline e\nline f", "new first\nline a\nline b\nline c\nline d\nline e\nline f", "Released under the MIT License.", "ABC DEF ünï   code",
    ]
    return [(i, t, "en", ["s1", "s2", None][i % 3], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def frame():
    return pd.DataFrame(corpus(), columns=["doc_id", "text", "lang", "source", "n_chars"])


@pytest.fixture(scope="module")
def bench(spark):
    b = words(80, 2)
    return spark.createDataFrame([(1, " ".join(b[10:30])), (2, "Two, words!"), (3, None), (4, ""), (10, "one"), (5, " ".join(b[10:30]))], "item_id long, text string")


def cluttered(df):
    """With columns that carry the operators' own names."""
    return df.withColumns({c: F.lit("clash") for c in ("doc", "tag", "at", "n", "key", "a", "b", "hash", "digest", "regs", "no", "gone", "nos", "bucket", "own", "toxicity", "path", "shard", "drawn", "size", "target", "score", "item_ids", "flat")})


# ---- 1


def test_chat(spark):
    odd = "a\\b <|im_end|> \\n [INST]x[/INST] </s><s> <<SYS>> <\\| \n"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (2, 0, "user", odd), (2, 1, "assistant", "other"), (3, 0, "user", odd), (3, 1, "assistant", odd), (3, 2, None, None), (4, None, "sys\ntem\\", ""), (None, 5, "assistant", "é😀"), (5, 0, "user", "t"), (5, 0, "user", "t"), (6, 0, "assistant", "z" * 3000)]
    df = cluttered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for pack in (chat.PACK, 50):
        tree, talks = chat.prefix_tree(df, pack)
        got = {r["conv_id"]: r for r in chat.digest(tree, talks).collect()}
        assert len(got) == 7
        for c, r in got.items():
            turns = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == c))
            loss = "".join(t for *_, role, t in turns if role == "assistant")
            assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss)
            assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for *_, role, t in turns).encode()).hexdigest()
            assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    whole = chat.prefix_tree(df)[0].select(F.sum(F.length("text"))).first()[0]
    distinct = len({tuple((x[2], x[3]) for x in rows if x[0] == c)[: k + 1] for c in (1, 2, 3) for k in range(3)})
    assert distinct == 4 and whole < sum(r["formatted_chars"] for r in got.values())
    empty = chat.digest(*chat.prefix_tree(df.limit(0)))
    assert empty.count() == 0


def test_chat_tree_shares_each_turn_once(spark):
    rows = [(c, t, "user", f"turn {t}" if t < 3 else f"own {c}") for c in range(40) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    tree = chat.prefix_tree(df)[0]
    shared = sum("turn 0" in r["text"] for r in tree.collect())
    assert shared == tree.select("pack").distinct().count()
    for r in tree.collect():
        assert r["position"] == sum(i["end"] - i["start"] for i in r["ancestors"])
    long = spark.createDataFrame([(1, t, "user", "x") for t in range(3000)], "conv_id long, turn long, role string, text string")
    assert chat.digest(*chat.prefix_tree(long)).first()["n_turns"] == 3000


# ---- 2


def test_lines(spark, docs, frame, tiny):
    same(linededup.digest(linededup.without_repeats(docs.select("doc_id", "text"))).toPandas(), run_sql(tiny, ORACLES["op2_line_dedup"], documents=frame))
    out = linededup.without_repeats(cluttered(docs).withColumn("n_lines", F.lit(0)))
    assert out.count() == len(frame) and out.where("doc_id = 8").first()["text"] is None and out.first()["gone"] == "clash"
    assert linededup.without_repeats(docs.limit(0)).count() == 0
    twice = linededup.without_repeats(docs.unionByName(docs)).groupBy("doc_id").agg(F.count_distinct(F.coalesce("text", F.lit(""))).alias("k"), F.count("*").alias("n"))
    assert {(r["k"], r["n"]) for r in twice.collect()} == {(1, 2)}
    nulls = spark.createDataFrame([(None, "p\nq\nr\ns\nt\nu"), (3, "p\nq\nr\ns\nt\nu")], "doc_id long, text string")
    kept = {r["doc_id"]: r["n_removed"] for r in linededup.without_repeats(nulls).collect()}
    assert kept[3] == 0 and kept[None] > 0


# ---- 3


def removed_by_force(rows, width):
    own = [(i, PLAIN.findall(t or "")) for i, t, *_ in rows]
    first: dict[tuple, int] = {}
    for i, w in own:
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, w in own:
        hit = [False] * len(w)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < i:
                hit[p : p + width] = [True] * width
        out[i] = (len(w), sum(hit), hashlib.sha256(" ".join(x for x, h in zip(w, hit, strict=True) if not h).encode()).hexdigest())
    return out


@pytest.mark.parametrize("width", [50, 10])
def test_substrings(spark, docs, width):
    got = substring.digest(substring.repeats(cluttered(docs), width)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == removed_by_force(corpus(), width)


def test_substrings_edges(spark, docs):
    assert substring.repeats(docs.limit(0)).count() == 0
    text = " ".join(words(60, 9))
    odd = spark.createDataFrame([(None, text), (7, text), (7, text), (7, text + " more"), (9, text)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring.digest(substring.repeats(odd)).collect())
    assert got == [(0, 60), (7, 0), (7, 0), (7, 0), (9, 60)]


# ---- 4


def test_mixing(spark, docs, frame, tiny):
    same(mixing.digest(mixing.mix(cluttered(docs))).toPandas(), run_sql(tiny, ORACLES["op4_mixing"], documents=frame))
    assert mixing.mix(docs.limit(0)).count() == 0
    empty = mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).select("target", "taken").distinct().collect()
    assert [tuple(r) for r in empty] == [(0.0, 0)]
    one = mixing.mix(docs.repartition(1)).orderBy("doc_id").collect()
    assert one == mixing.mix(docs.repartition(9)).orderBy("doc_id").collect()


def test_apportionment_is_sainte_lague(spark):
    rng = np.random.default_rng(4)
    for votes, seats in (([53, 24, 23], 7), ([1000, 1, 1, 1], 12), ([5, 5, 5], 4), (rng.integers(0, 900, 40).tolist(), 313)):
        df = spark.createDataFrame([(0, i, v, seats) for i, v in enumerate(votes)], "g int, p int, votes long, seats long")
        got = {r["p"]: r["quota"] for r in mixing.apportion(df, ["g"], ["p"]).collect()}
        want = dict.fromkeys(range(len(votes)), 0)
        for _ in range(seats):
            best = max((i for i, v in enumerate(votes) if v), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
            want[best] += 1
        assert got == want


# ---- 5


def test_near_duplicates(spark, docs):
    rows = corpus()
    own = {}
    for i, t, *_ in rows:
        w = PLAIN.findall(lower(t or ""))
        own[i] = {tuple(w[p : p + 3]) for p in range(max(len(w) - 2, min(len(w), 1)))}
    root = {i: i for i in own}
    for _ in range(len(own)):
        for i in own:
            for j in own:
                if own[i] and own[j] and 100 * len(own[i] & own[j]) >= 85 * len(own[i] | own[j]):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(cluttered(docs)).collect()}
    assert got == {i: (len(own[i]), root[i], root[i] == i) for i in own}


def test_near_duplicate_groups(spark):
    """A chain whose ends are not alike, a star, and a pair just at and just below the threshold."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(102)]
    rows, w = [], base
    for i in range(30):
        rows.append((i, " ".join(w)))
        w = w.copy()
        for _ in range(2):
            w[rng.randrange(len(w))] = f"c{rng.randrange(10**6)}"
    for i in range(60):
        v = base.copy()
        for k in rng.sample(range(102), 1 + i % 5):
            v[k] = f"s{i}_{k}"
        rows.append((100 + i, " ".join(v)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = {i: {tuple(t.split()[p : p + 3]) for p in range(100)} for i, t in rows}
    root = {i: i for i in own}
    changed = True
    while changed:
        changed = False
        for i in own:
            for j in own:
                if root[i] != root[j] and 100 * len(own[i] & own[j]) >= 85 * len(own[i] | own[j]):
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()} == root


def test_near_duplicate_edges(spark, docs):
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d"), (None, None), (5, "a b c d"), (5, "e f g"), (9, "e f g"), (11, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in neardup.near_duplicates(odd).collect())
    assert got == [(0, 0, True), (0, 0, True), (5, 5, True), (5, 5, True), (9, 5, False), (11, 11, True)]
    kept = neardup.representatives(cluttered(docs))
    assert kept.first()["doc"] == "clash" and kept.where("doc_id in (1, 2)").count() == 0


def test_sketch_estimate():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for j, up in ((0.95, True), (0.3, False)):
        n = int(4000 * 2 * j / (1 + j))
        b = np.concatenate([a[:n], rng.integers(0, 2**63, 4000 - n).astype(np.uint64)])
        x, y = neardup.registers([np.sort(a), np.sort(b)])
        assert neardup.rising(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([(x == y).sum()]), np.array([4000]), np.array([4000]), 0.7)[0] == up
    both = neardup.registers([np.sort(np.unique(np.concatenate([a, a[:5]])))])
    assert (both == neardup.registers([np.sort(a)])).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    root = {k: k for e in edges for k in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if k != v}


# ---- 6


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    found = toxicity.digest(toxicity.scores(docs, toxicity.train(docs, labels))).join(labels, "doc_id").where("held_out").toPandas()
    hit, said, true = ((found.predicted == 1) & (found.toxic == 1)).sum(), (found.predicted == 1).sum(), (found.toxic == 1).sum()
    assert hit / true > 0.8 and hit / said > 0.85


def test_toxicity_pairs_of_terms():
    """An insult with a group's mention is toxic, neither is alone: additive weights cannot tell, products can."""
    rng = np.random.default_rng(0)
    texts, y = [], []
    for k in range(1200):
        insult, group = rng.random(2) < 0.5
        texts.append(np.array([*([1] if insult else []), *([2] if group else []), 10 + k % 7], np.int32))
        y.append(float(insult and group))
    m = toxicity.fit(texts, np.array(y))
    score = lambda t: toxicity.raw(m, np.zeros(len(t), int), np.searchsorted(m.slots, t), 1)[0]
    assert score([1, 2]) > 0 > max(score([1]), score([2]))


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    m = toxicity.train(docs, labels)
    assert {r["toxicity"] for r in toxicity.scores(cluttered(docs), m).collect()} == {toxicity.scores(docs, m).first()["toxicity"]}
    assert toxicity.scores(docs.limit(0), m).count() == 0
    assert toxicity.accepted(cluttered(docs), labels.limit(0)).columns == cluttered(docs).columns
    odd = spark.createDataFrame([(None, None), (None, "x")], "doc_id long, text string")
    assert [r["held_out"] for r in toxicity.digest(toxicity.scores(odd, m)).collect()] == [False, False]


# ---- 7


def test_licences(spark, docs, frame, tiny):
    mit = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    rows = [(1, mit), (2, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n* Redistributions in binary form must reproduce x"), (3, None), (4, "text. Licensed under CC BY-NC 4.0. more"), (4, "RELEASED under the mit license!\n" * 3000)]
    df = cluttered(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [(r["doc_id"], tuple(r["licences"]), r["n_sentences"]) for r in licenses.scan(df).orderBy("doc_id", "n_sentences").collect()]
    assert [g[:2] for g in got] == [(1, ("MIT",)), (2, ()), (3, ()), (4, ("CC-BY-NC-4.0",)), (4, ("MIT",))] and got[2][2] == 0
    same(licenses.digest(licenses.scan(docs)).toPandas(), run_sql(tiny, ORACLES["op7_license_scan"], documents=frame))
    assert licenses.scan(docs.limit(0)).count() == 0
    assert all(set(r) <= set(licenses.SENTENCES) for _, r in licenses.RULES) and len({licenses.normalised(s) for s in licenses.SENTENCES.values()}) == len(licenses.SENTENCES)


# ---- 8


def page(body: str, kind: str = "article") -> str:
    return f"<!doctype html><html><head><title>T</title><style>p{{x:y}}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy now, very cheap, really, buy it now please</div><{kind}>{body}</{kind}><aside>Side</aside><div id='comments'><p>first! " + "nice post " * 90 + "</p></div><footer>&copy; f</footer></body></html>"


def test_main_text(spark):
    body = "<h1>Head &amp; line</h1><p>One <b>bo</b>ld&nbsp;text<br>next<p>Two <i>it</i>\n <script>var t='</p>';</script>lines<ul><li>a<li>b</ul><form>f<input></form><div class='cookie-notice'>c</div><p hidden>h</p>"
    rows = [(1, "https://a.example/1", page(body)), (2, "https://a.example/2", page("<p>" + "word " * 300)), (3, None, None), (4, "nonsense", "<p>loose <b>text"), (5, "https://b.example/x", page("<p>in a div</p>", "div class='content post-12'")), (6, "https://b.example/y", page("<p>again</p>", "div class='content post-13'")), (6, "http://B.example:80/z", ""), (7, "https://c.example", "a < b &lt; c"), (8, "https://c.example", "<div>" * 3000 + "deep" + "</div>" * 10)]
    df = cluttered(spark.createDataFrame(rows, "page_id long, url string, html string")).withColumn("host", F.lit(1))
    got = sorted((r["page_id"], r["text"]) for r in webtext.main_text(df).collect())
    assert got[0][1] == "Head & line One bold text next Two it lines a b"
    assert got[1][1] == " ".join(["word"] * 300)
    assert [t for _, t in got[2:]] == ["", "loose text", "in a div", "", "again", "a < b < c", "deep"]
    assert webtext.main_text(df.limit(0)).count() == 0
    assert all(r["n_chars"] == len(r["text"]) for r in webtext.main_text(df).collect())


# ---- 9


def test_vectors(spark, tiny):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 16))
    rows = []
    for i in range(400):
        v = centre[i % 4] + rng.normal(size=16) * [0.05, 0.15, 0.3][i % 3]
        rows.append((i, v.astype(np.float32).tolist(), i % 2))
    rows += [(400, rows[0][1], 0), (401, rows[0][1], 1), (402, rows[0][1], None), (403, None, 0), (404, [0.0] * 16, 0), (405, [float("nan")] * 16, 0), (406, [float("inf")] + [1.0] * 15, 0), (407, [], 0), (408, [1.0, 2.0], 0), (409, [2.0, 4.0], 0), (410, [None] + [1.0] * 15, 0)]
    df = cluttered(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    frame = pd.DataFrame(rows, columns=["vec_id", "embedding", "label"])
    frame["embedding"] = [None if e is None else [None if v is None else np.float32(v) for v in e] for e in frame["embedding"]]
    frame["label"] = frame["label"].astype("Int64")
    import pyarrow as pa

    arrow = pa.table({"vec_id": [r[0] for r in rows], "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())})
    import duckdb

    con = duckdb.connect()
    con.register("embeddings", arrow)
    want = con.execute(ORACLES["op9_embedding_dedup"]).df()
    for block in (vectors.BLOCK, 16):
        same(vectors.near_duplicates(df, block=block).toPandas(), want)
    same(vectors.near_duplicates(df.withColumn("embedding", F.col("embedding").cast("array<double>"))).toPandas(), want)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


# ---- 10


def contaminated_by_force(rows, items, window=10):
    win = {}
    for i, t in items:
        w = ALNUM.findall(lower(t or ""))
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            win.setdefault(tuple(w[p : p + n]), set()).add(str(i))
    out = {}
    for i, t, *_ in rows:
        w = ALNUM.findall(lower(t or ""))
        hit, found = [False] * len(w), set()
        for k, own in win.items():
            for p in range(len(w) - len(k) + 1):
                if tuple(w[p : p + len(k)]) == k:
                    hit[p : p + len(k)] = [True] * len(k)
                    found |= own
        out[i] = (len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit))
    return out


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 100])
def test_decontamination(spark, docs, bench, block):
    got = decontam.digest(decontam.contamination(cluttered(docs), cluttered(bench), block_bytes=block)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == contaminated_by_force(corpus(), [tuple(r) for r in bench.collect()])


def test_decontamination_edges(spark, docs, bench):
    assert decontam.contamination(docs.limit(0), bench).count() == 0
    none = decontam.digest(decontam.contamination(docs, bench.limit(0)))
    assert none.where("contaminated").count() == 0 and none.count() == docs.count()
    odd = cluttered(spark.createDataFrame([(None, "one"), (None, "free"), (3, None), (4, "x one y")], "doc_id long, text string"))
    assert [r["doc_id"] for r in decontam.clean(odd, bench).collect()] == [3]
