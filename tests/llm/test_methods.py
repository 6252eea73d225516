"""Each operator's method does what it is for: checked against brute force, and independent of partitions and sessions."""

from __future__ import annotations

import hashlib
import json
import os
import random
import re
import time
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from helpers import run_sql, same
from pyspark import cloudpickle
from pyspark.sql import functions as F

import corpus_pipeline
from terrace.llm import chat, common, decontam, licenses, linededup, mixing, neardup, toxicity, vectors, webtext
from terrace.llm.common import chunks
from terrace.llm.oracles import ORACLES

# ---- 2


def chunks_by_force(w):
    """(first, last) lines of the chunks, from 0."""
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in w]
    r = [(h[i] + (31 * h[i - 1] if i else 0)) % 2**32 for i in range(len(w))]
    ends, out, a = [], [], 0
    for i in range(1, len(w) - 2):
        flat = i > 1 and i % 2 == 1 and r[i - 2] == r[i - 1] == r[i] == r[i + 1]
        if r[i] < r[i - 1] and r[i] <= r[i + 1] or flat:
            ends.append(i)
    for e in [*ends, len(w) - 1]:
        out.append((a, e))
        a = e + 1
    return out


def lines_by_force(rows):
    """Text left and number of lines gone of each document, by the operator's rule."""
    places, texts, gone = {}, {}, {}
    for i, t in sorted(rows):
        w = texts[i] = t.split("\n")
        c = chunks_by_force(w)
        for k, (a, b) in enumerate(c):
            if b > a:
                before, after = (w[c[k - 1][0] : a] if k else [])[::-1], w[b + 1 : c[k + 1][1] + 1] if k + 1 < len(c) else []
                places.setdefault(tuple(w[a : b + 1]), []).append((i, a, b, before, after))
    alike = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    for found in places.values():
        *_, before, after = found[0]
        for i, a, b, up, down in found[1:]:
            gone.setdefault(i, set()).update(range(a - alike(up, before), b + alike(down, after) + 1))
    return {i: ("\n".join(x for k, x in enumerate(w) if k not in gone.get(i, ())), len(gone.get(i, ()))) for i, w in texts.items()}


def test_chunks_of_lines(spark):
    rng = random.Random(1)
    shared = [f"shared {rng.random()}" for _ in range(60)]
    rows = [(n, "\n".join([*(f"own {n} {k}" for k in range(rng.randrange(5))), *shared[(a := rng.randrange(30)) : a + rng.randrange(2, 30)], *(f"end {n} {k}" for k in range(rng.randrange(5)))])) for n in range(60)]
    rows += [(100, "\n".join(["x"] * 51)), (101, "\n".join(["y", *["x"] * 40, "z"])), (102, ""), (103, "one"), (104, "a\nb"), (105, "a\nb")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = lines_by_force(rows)
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in linededup.without_repeats(df).collect()} == want
    assert want[105][1] == 2 and want[100][1] >= 46 and want[101][1] >= 36
    for i, t in rows:
        assert all(b > a for a, b in chunks_by_force(t.split("\n"))) or "\n" not in t
    named = df.select(F.format_string("d%05d", "doc_id").alias("doc_id"), "text")  # ids of any type
    assert {int(r["doc_id"][1:]): (r["text"], r["n_removed"]) for r in linededup.without_repeats(named).collect()} == want


def test_chunks_are_shift_resistant():
    rng = random.Random(2)
    w = [f"line {rng.random()}" for _ in range(300)]
    old, new = ({tuple(v[a : b + 1]) for a, b in chunks_by_force(v)} for v in (w, ["put in", *w[:150], "and here", *w[150:]]))
    assert len(old - new) <= 6


def test_a_line_dedup_of_a_long_log(spark):
    """A third of a long log is one line, and other documents repeat parts of it."""
    w = [f"event {k}" if k % 3 else "beat" for k in range(60_000)]
    rows = [(1, "\n".join(w)), (2, "\n".join(w[20_000:50_000])), (3, "\n".join(["beat"] * 30_000))]
    got = {r["doc_id"]: r["n_removed"] for r in linededup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] >= 29_990 and got[3] >= 29_990


# ---- 6


def _chance(m, t):
    t = [x for x in t if x in m.slots]
    return 1 / (1 + np.exp(-toxicity.raw(m, np.zeros(len(t), int), np.searchsorted(m.slots, t), 1)[0]))


@pytest.mark.parametrize("noise", [7, 300])
def test_toxicity_learns_what_only_pairs_tell(noise):
    rng = np.random.default_rng(5)
    either, beside = [], []
    for _ in range(1500):
        rest = 10 + rng.integers(0, noise, 8)
        a, b = rng.random(2) < 0.5
        either.append((np.unique(np.array([*([1] if a else []), *([2] if b else []), *rest], np.int32)), float(a != b)))
        a = rng.random() < 0.2
        beside.append((np.unique(np.array([*([1] if a else []), *([2] if b else []), *rest], np.int32)), float(a and b)))
    m = toxicity.fit([t for t, _ in either], np.array([y for _, y in either]))
    assert min(_chance(m, [1]), _chance(m, [2])) > 0.7 and max(_chance(m, []), _chance(m, [1, 2])) < 0.4
    m = toxicity.fit([t for t, _ in beside], np.array([y for _, y in beside]))
    assert _chance(m, [1, 2]) > 0.9 and max(_chance(m, []), _chance(m, [1]), _chance(m, [2])) < 0.1
    assert m.factors[np.searchsorted(m.slots, 2)].any()  # a term that is neutral alone


def test_toxicity_raw_is_the_double_sum():
    rng = np.random.default_rng(6)
    m = toxicity.Model(0.3, np.arange(20), rng.normal(size=20), rng.normal(size=(20, 4)))
    texts = [np.sort(rng.choice(20, n, replace=False)) for n in (0, 1, 2, 7, 20)]
    got = toxicity.raw(m, np.repeat(np.arange(5), [len(t) for t in texts]), np.concatenate(texts), 5)
    want = [0.3 + sum(m.weight[i] for i in t) + sum(float(m.factors[i] @ m.factors[j]) for i in t for j in t if i < j) for t in texts]
    assert np.allclose(got, want)


def test_toxicity_scores_by_force(spark):
    """Scores of texts through Spark, whatever the partitions, are those of their terms one text at a time."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["Idiots", "green", "tree", "you", "hate", "them"]) for _ in range(rng.randrange(12))) if i % 7 else None) for i in range(200)]
    rows += [(300, "word " * 200_000 + "hate")]
    labels = [(i, int("hate" in (t or "") and "you" in (t or ""))) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    m = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))

    def force(t):
        low = (t or "").lower()
        own = set()
        for w in {w for w in "".join(c if c.isalnum() else " " for c in low).split()}:
            for _, _, buf, off in chunks(pa.array([w])):
                own |= set(toxicity.terms(buf, off)[1].tolist())
        have = [int(np.searchsorted(m.slots, x)) for x in own if x in set(m.slots.tolist())]
        z = m.bias + sum(m.weight[i] for i in have) + sum(float(m.factors[i] @ m.factors[j]) for i in have for j in have if i < j)
        return 1 / (1 + np.exp(-z))

    want = {i: force(t) for i, t in rows}
    for n in (1, 7):
        got = {r["doc_id"]: r["toxicity"] for r in toxicity.scores(docs.repartition(n), m).collect()}
        assert got.keys() == want.keys() and np.allclose([got[i] for i in want], [want[i] for i in want])
    assert len({round(v, 6) for v in want.values()}) > 3


# ---- 1


def shared_conversations():
    """Deep sharing: 400 conversations whose beginnings are drawn from few turns, some twice, and one opening that a third has."""
    rng = random.Random(11)
    rows = []
    for c in range(400):
        path = [("user", "hello 0")] if c % 3 == 0 else [("user", f"hello {rng.randrange(4)}")]
        for t in range(rng.randrange(1, 6)):
            path.append(("assistant" if t % 2 == 0 else "user", f"turn {t} {rng.randrange(3)} " + "x" * rng.randrange(3)))
        rows += [(c, t, role, text) for t, (role, text) in enumerate(path)]
    return rows


def trie_by_force(rows):
    """Signs of all distinct beginnings, each once, and each distinct conversation's formatted turns."""
    talks = {}
    for c, _, role, text in sorted(rows):
        talks[c] = (*talks.get(c, ()), chat.formatted([(role, text)])[0])
    nodes = {v[: k + 1] for v in talks.values() for k in range(len(v))}
    return sum(len(v[-1]) for v in nodes), set(talks.values())


@pytest.mark.parametrize(("pack", "part"), [(chat.PACK, chat.PART), (900, chat.PART), (900, 2000)])
def test_chat_tree_is_the_trie_whatever_the_partitions(spark, pack, part):
    rows = shared_conversations()
    total, leaves = trie_by_force(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seen, was = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 8, 200):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            tree, talks = chat.prefix_tree(df.repartition(n), pack, part)
            found = sorted(tuple(r) for r in tree.select("pack", "start", "text", "position", F.to_json("ancestors"), F.to_json("loss"), F.hex("leaf")).collect())
            seen.append(found)
        read = {r["conv_id"]: r["formatted_chars"] for r in chat.digest(tree, talks).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert seen[0] == seen[1] == seen[2] and len(found) == len(leaves)
    # what stands twice is what the first leaf of a pack shares with the leaf before it
    order = sorted(found)
    path, whole = {}, []
    for no, start, text, position, *_ in order:
        path.setdefault(no, []).append((start, text, position))
    again = 0
    stream = {no: "".join(t for _, t, _ in v) for no, v in path.items()}
    for no, start, text, position, ancestors, *_ in order:
        whole.append("".join(stream[no][i["start"] : i["end"]] for i in json.loads(ancestors)) + text)
        assert len(whole[-1]) == position + len(text)
    assert set(whole) == {"".join(v) for v in leaves}
    turns = {"".join(v): v for v in leaves}
    for k, (no, start, *_) in enumerate(order):
        if k and start == 0:
            a, b = turns[whole[k - 1]], turns[whole[k]]
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            again += sum(map(len, b[:n]))
    assert sum(len(r[2]) for r in found) == total + again
    if pack == chat.PACK:
        assert again == 0 and len(path) == 1 and total < sum(read.values()) / 2
    if part == 2000:
        assert len({no >> 32 for no in path}) > 3


# ---- 10


def test_decontamination_of_long_and_nameless_items(spark):
    """Items without id, one of several pieces, shared windows, and more than one block: what a search for every window finds."""
    rng = random.Random(4)
    w = [f"w{rng.randrange(400)}" for _ in range(40_000)]
    items = [(None, " ".join(w[:60])), (None, " ".join(w[30_000:30_040])), ("a", " ".join(w)), ("b", " ".join(w[100:140])), ("c", "two words"), ("d", "One"), ("e", " ".join(w[16_380:16_392])), ("f", None), ("g", "!!")]
    docs = [(i, " ".join([*(f"x{k}" for k in range(i % 5)), *w[(a := rng.randrange(39_000)) : a + rng.randrange(5, 40)], "two", "words" if i % 2 else "lines"])) for i in range(60)]
    docs += [(100, " ".join(w[16_370:16_400])), (101, "one"), (102, None)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    own = {}
    for i, t in items:
        v = re.findall("[a-z0-9]+", (t or "").lower())
        for p in range(max(len(v) - 9, min(len(v), 1))):
            own.setdefault(tuple(v[p : p + 10]), set()).add(i or "")
    want = {}
    for i, t in docs:
        v = re.findall("[a-z0-9]+", (t or "").lower())
        hit, found = set(), set()
        for n in {len(k) for k in own}:
            for p in range(len(v) - n + 1):
                if tuple(v[p : p + n]) in own:
                    hit |= set(range(p, p + n))
                    found |= own[tuple(v[p : p + n])]
        want[i] = (len(v), len(hit), sorted(found))
    for block in (decontam.BLOCK_BYTES, 40_000):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in decontam.contamination(df, bench, block_bytes=block).collect()}
        assert got == want


def test_decontamination_holds_little():
    """A block of 8 MB of distinct items: what the driver and a closure hold."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300_000, 1000)) for _ in range(decontam.BLOCK_BYTES // 7800)]
    table = pa.table({"item_id": [str(i) for i in range(len(texts))], "text": texts})
    size = sum(map(len, texts))
    assert size > 0.9 * decontam.BLOCK_BYTES
    tracemalloc.start()
    win = decontam._windows(table, 10, 3)
    counts = {3: (np.unique(win["keys"][3]), np.ones(len(np.unique(win["keys"][3])), np.int64))}
    probe = decontam._rarest(win, counts, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    closure = len(cloudpickle.dumps((probe, win["by"], win["bytes"], win["starts"], win["ends"], win["names"])))
    print(size, peak, closure)
    assert peak < 500e6 and closure < 100e6


# ---- 8

WRAPPERS = ["with-sidebar", "has-sidebar", "no-sidebar", "layout side-by-side", "container search-results", "main-content related-off", "no-comments", "content-with-menu"]
NOISE = [
    "<div class='left-sidebar'><p>Side text that is here</p></div>", "<div id='comment-list-2'><article class='comment'><p>First! " + "so true " * 60 + "</p></article></div>", "<div class='cookieNotice'>We use cookies</div>",
    "<section class='related-posts'><article><h2>Another</h2><p>teaser of it</p></article></section>", "<div class='newsletter-signup'>Join</div>", "<div class='social share-buttons'>Share</div>", "<div role='complementary'>More</div>",
]


def test_main_text_of_wrapped_articles(spark):
    """Names of layout around an article do not drop it; noise of every kind stays out, on hosts that have one layout each."""
    rng = random.Random(7)
    rows, want = [], {}
    for k, name in enumerate([*WRAPPERS, "plain"]):
        for n in range(6):
            body = [f"Title {k} {n}", *(" ".join(f"word{rng.randrange(99)}" for _ in range(rng.randrange(5, 60))) for _ in range(rng.randrange(1, 6)))]
            inner = f"<header><h1>{body[0]}</h1><p>by somebody</p></header>" + "".join(f"<p>{b}</p>" if rng.random() < 0.7 else f"<section class='part'><p>{b}</p></section>" for b in body[1:])
            noise = rng.sample(NOISE, 3)
            page_id = 10 * k + n
            tag = "<article id='comment-on-policy'>" if n % 2 else "<article>"
            rows.append((page_id, f"https://h{k}.example/{n}", f"<body><header><h1>Site</h1></header><nav><a href='/'>Home</a></nav><div class=\"{name}\">{noise[0]}{tag}{inner}</article>{noise[1]}</div>{noise[2]}<footer>f</footer></body>"))
            want[page_id] = " ".join(body)
    # every container is marked: the names are forgiven, those of layout first
    rows += [(900, "https://menu.example/1", "<div class='menu'><article><p>Soup of the day</p></article></div><div class='ads'>Buy</div>"), (901, "https://all.example/1", "<div class='comments'><p>Only this</p></div>"), (902, "https://menu.example/2", "<div class='sidebar'><p>Just text</p></div>")]
    want |= {900: "Soup of the day", 901: "Only this", 902: "Just text"}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for n in (1, 5):
        assert {r["page_id"]: r["text"] for r in webtext.main_text(df.repartition(n)).collect()} == want


def test_votes_are_sums_of_pages(spark, tiny):
    """Winners by a plain sum over pages, whatever the partitions and batches."""
    pages = spark.read.parquet(f"{tiny}/pages.parquet")
    odd = spark.createDataFrame([(i, f"https://odd.example/{i}", f"<div class='a{i % 2}x'><p>{'word ' * (3 + i % 5)}</p></div><div class='b'><p>{'other ' * (i % 4)}</p></div>") for i in range(200)], "page_id long, url string, html string")
    pages = pages.select("page_id", "url", "html").unionByName(odd).unionByName(odd)
    votes = {}
    for r in pages.collect():
        host = re.match(r"[a-z]+://([^/?#:]*)", (r["url"] or "").lower())
        for path, n in webtext.Page(r["html"] or "").votes().items():
            own = votes.setdefault(host[1] if host else "", {})
            own[path] = own.get(path, 0) + n
    want = {h: min(v, key=lambda p: (-v[p], p)) for h, v in votes.items()}
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n, size in ((1, 10_000), (7, 10_000), (3, 11)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
            assert {r["host"]: bytes(r["path"]) for r in webtext.winning_paths(pages.repartition(n)).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_deep_pages_take_linear_time():
    def seconds(n):
        began = time.process_time()
        assert webtext.Page("<div class='x'>" * n + "deep" + "</p></section></b>" * n).text(None) == "deep"
        return time.process_time() - began

    seconds(500)
    assert seconds(16_000) < 40 * max(seconds(1_000), 0.002)


# ---- 7

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """
3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
HEADER = "This {} is free software{} you can redistribute it and/or\nmodify it under the terms of the GNU {}General Public\nLicense as published by the Free Software Foundation{} either\nversion {} of the License, or (at your option) any later version.\n"


def test_licence_rules_consume_their_sentences(spark):
    line = lambda t: " ".join(t.split())
    cases = [
        (BSD, "BSD-2-Clause"), (BSD + THIRD.format("the copyright holder"), "BSD-3-Clause"), (BSD + THIRD.format("Example and Sons"), "BSD-3-Clause"), (line(BSD + THIRD.format("the University")), "BSD-3-Clause"),
        (BSD + THIRD.format("X") + "\n\n" + BSD, "BSD-2-Clause,BSD-3-Clause"), ((BSD + THIRD.format("X") + "\n\n") * 2, "BSD-3-Clause"),
        (line(BSD) + "\n" + THIRD.format("Y"), "BSD-3-Clause"),
        (HEADER.format("program", ":", "", ",", "3"), "GPL-3.0"), (HEADER.format("program", ";", "", ";", "2"), "GPL-2.0"), (HEADER.format("library", ";", "Lesser ", ";", "2.1"), "LGPL-2.1"),
        (HEADER.format("program", ":", "Lesser ", ",", "3"), "LGPL-3.0"), (HEADER.format("program", ":", "Affero ", ",", "3"), "AGPL-3.0"), ("All rights reserved.", ""), ("LICENSED UNDER THE MIT LICENSE!", "MIT"),
        ("GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007\n\nThe GNU Affero General Public License is a free, copyleft license for\nsoftware and other kinds of works, specifically designed to ensure\ncooperation with the community in the case of network server software.\n", "AGPL-3.0"),
        ("no such words", ""), (None, ""),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licenses.digest(licenses.scan(df)).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    frame = pd.DataFrame([(i, t) for i, (t, _) in enumerate(cases)], columns=["doc_id", "text"])
    same(licenses.digest(licenses.scan(df)).toPandas(), run_sql("/root/testdata/sf0.001", ORACLES["op7_license_scan"], documents=frame))
    assert all(any(x in licenses.normalised(s) for x in licenses.SIGNS) for s in licenses.SENTENCES.values())
    twice = licenses.scan(df.unionByName(df)).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("licences").alias("k"))
    assert {(r["n"], r["k"]) for r in twice.collect()} == {(2, 1)}


@pytest.mark.parametrize(("file", "want"), [("Apache-2.0", "Apache-2.0"), ("GPL-1", "GPL-1.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("BSD", "BSD-3-Clause"), ("CC0-1.0", "CC0-1.0")])
def test_full_licence_texts(spark, file, want):
    path = f"/usr/share/common-licenses/{file}"
    if not os.path.exists(path):
        pytest.skip("no licence texts on this machine")
    text = open(path, encoding="utf-8").read()
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["licences"]
    assert want in got and set(got) <= {want, "GPL-2.0"} if file == "GPL-1" else got == [want]


# ---- 4


def test_mix_comes_near_every_target(spark):
    """Sources of one-word, five-word and few documents, a large one, one of a single word and a hot one of many shards."""
    rows = [(i, "one", "words") for i in range(100)] + [(1000 + i, "a b c d e", "lines") for i in range(200)] + [(2000 + i, "w " * 97, "large") for i in range(3000)] + [(9000, "lonely", "single"), (9001, None, "nothing"), (9002, "x " * 9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas()
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] >= 0).all()
    got["source"] = got["source"].fillna("null")
    for name, g in got.groupby("source"):
        target = g["target"].iloc[0]
        assert abs(g["taken"].sum() - target) <= max(0.02 * target, 32), (name, g["taken"].sum(), target)
    own = got.groupby("source")[["taken", "target"]].agg({"taken": "sum", "target": "first"})
    assert own.loc["words", "taken"] >= 0.9 * own.loc["words", "target"] and own.loc["lines", "taken"] >= 0.95 * own.loc["lines", "target"] and own.loc["single", "taken"] == own.loc["single", "target"] == 2
    twice = mixing.mix(df.unionByName(df))  # repeated rows
    assert twice.where("taken > 2 * size").count() == 0 and twice.count() == 2 * len(rows)
    assert sorted(map(tuple, mixing.mix(df.repartition(7)).select("doc_id", "taken").collect())) == sorted(map(tuple, got[["doc_id", "taken"]].itertuples(index=False)))


# ---- 9


def test_tiles_skip_what_is_far_and_nothing_near():
    rng = np.random.default_rng(9)
    eps = (2 - 2 * vectors.COSINE) ** 0.5
    for dims, least in ((4, 0.7), (64, 0.02)):
        x = rng.normal(size=(4000, dims)) * np.linspace(2, 0.5, dims)
        x[2000:] = x[:2000] + rng.normal(size=(2000, dims)) * 0.05
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z = x @ np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, : vectors.AXES]
        order = np.lexsort(np.floor(z / eps).astype(int).T[::-1])
        x, z = x[order], z[order]
        for a, b in ((slice(0, 4000), slice(0, 4000)), (slice(0, 1000), slice(1000, 1357)), (slice(7, 8), slice(0, 4000))):
            left, right = vectors.tiles(z[a], z[b], eps)
            kept = set(zip(left.tolist(), right.tolist(), strict=True))
            assert len(kept) == len(left)
            i, j = np.nonzero(x[a] @ x[b].T >= vectors.COSINE)
            assert {(p // vectors.TILE, q // vectors.TILE) for p, q in zip(i.tolist(), j.tolist(), strict=True)} <= kept
            if a.stop - a.start == 4000:
                assert 1 - len(kept) / 125**2 > least


def test_vectors_in_many_blocks_and_repeated_ids(spark):
    """A label that fills several blocks, with a chain through them, repeated rows and repeated ids."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(700, 8))
    x[300:340] = np.cumsum(rng.normal(size=(40, 8)) * 0.03, 0) + 1
    x[500:600] = x[:100] + rng.normal(size=(100, 8)) * 0.08
    rows = [(i, v.tolist(), "one" if i % 3 else "two") for i, v in enumerate(x)] + [(5, x[5].tolist(), "one"), (5, x[5].tolist(), "one"), (900, x[1].tolist(), "one"), (901, x[1].tolist(), "one"), (902, None, "one")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    n, unit = len(rows), np.array([np.array(v if v else [0] * 8) / max(np.linalg.norm(v if v else [0]), 1e-300) for _, v, _ in rows])
    label = np.array([c for *_, c in rows])
    near = (unit @ unit.T >= vectors.COSINE) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    root = np.array([i for i, *_ in rows])
    for _ in range(n):
        new = np.minimum(root, np.where(near, root[None, :], 1 << 40).min(1))
        if (new == root).all():
            break
        root = new
    want = sorted((rows[k][0], int(near[k].sum()), int(root[k])) for k in range(n))
    for block in (vectors.BLOCK, 64):
        got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df, block=block).collect())
        assert got == want


# ---- 5


@pytest.mark.parametrize(("block", "shingles"), [(512, 1 << 21), (4, 1 << 21), (512, 400)])
def test_buckets_of_several_blocks(spark, monkeypatch, block, shingles):
    """Clusters that share bands: many members are not in the component of their bucket's smallest one. The components are those of all pairs."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", shingles)
    rng, base, rows = random.Random(12), [f"w{k}" for k in range(122)], []
    for c in range(6):  # centres that are alike, but not alike enough
        centre = base.copy()
        for k in rng.sample(range(122), 4):
            centre[k] = f"c{c}_{k}"
        for m in range(14):
            w = centre.copy()
            for k in rng.sample(range(122), m % 4):
                w[k] = f"m{c}_{m}_{k}"
            rows.append((len(rows) * 7 % 101, " ".join(w)))
    rows += [(200, rows[0][1]), (200, "other words here now"), (201, None)]
    own = [(i, {tuple(t.split()[p : p + 3]) for p in range(len(t.split()) - 2)} if t else set()) for i, t in rows]
    root = {i: i for i, _ in own}
    changed = True
    while changed:
        changed = False
        for i, a in own:
            for j, b in own:
                if root[i] != root[j] and a and b and 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    assert 2 < len(set(root.values())) < len(root) - 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()} == root


# ---- the pipeline


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns that carry the stages' own names."""
    long = " ".join(f"w{k % 4000}" for k in range(30_000))
    rows = [
        (1, "a line\nanother line\na third", "en", "s1", 28), (2, "a line\nanother line\nits own", "en", None, 26), (2, "a line\nanother line\nits own", "en", None, 26), (3, None, None, "s2", None), (4, "", "de", "s2", 0), (None, "no id here at all", None, None, None),
        (None, None, None, None, None), (5, long, "en", "s1", len(long)), (6, long + " end", "en", "s2", len(long) + 4), (7, "x" * 50_000, "en", "s1", 50_000), (8, "one", "en", "s1", 3), (9, "one", "en", "s3", 3),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in ("toxicity", "_toxicity", "own", "doc", "grp", "node", "root", "kept", "flat", "item_ids", "n_words", "size", "target", "shard", "drawn", "digest", "hash", "first")})


def test_stages_on_odd_documents(spark, odd_docs, tiny):
    for step in (s for _, s in corpus_pipeline.STAGES[:-1]):
        out = step(spark, odd_docs, tiny)
        assert out.columns == odd_docs.columns and out.where("hash <> 'clash'").count() == 0
        assert step(spark, odd_docs.limit(0), tiny).count() == 0
    ids = lambda df: sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in df.select("doc_id").collect())
    everything = ids(odd_docs)
    assert ids(corpus_pipeline.drop_toxic(spark, odd_docs, tiny)) == everything
    lines = corpus_pipeline.drop_repeated_lines(spark, odd_docs, tiny)
    assert ids(lines) == everything and {r["text"] for r in lines.where("doc_id = 2").collect()} == {"its own"} and lines.where("doc_id = 3 and text is null and n_chars is null").count() == 1
    near = corpus_pipeline.drop_near_duplicates(spark, odd_docs, tiny)
    assert ids(near) == [i for i in everything if i not in (6, 9)]
    assert ids(corpus_pipeline.drop_contaminated(spark, odd_docs, tiny)) == everything
    mixed = corpus_pipeline.mix_sources(spark, odd_docs, tiny)
    assert ids(mixed) == everything and mixed.where("taken > 2 * size").count() == 0 and corpus_pipeline.mix_sources(spark, odd_docs.limit(0), tiny).count() == 0


def test_toxic_stage_by_force(spark, tmp_path):
    """What goes is what scores 0.3 or more by the sum over terms and pairs, on tables of its own."""
    rng = random.Random(13)
    rows = [(i, " ".join([*(["idiots"] if (bad := i % 4 == 0) else []), *(rng.choice(["green", "tree", "house", "walk"]) for _ in range(6))]), "en", "s", 1, int(bad)) for i in range(400)]
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(r[0], r[5]) for r in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert got == {r[0] for r in rows if not r[5]}


def test_mix_stage_by_force(spark, odd_docs, tiny):
    """Targets by sharing the excess again and again, and what each source takes against them."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got = corpus_pipeline.mix_sources(spark, docs, tiny).toPandas()
    size = docs.select("doc_id", "source", "text").toPandas()
    size["n"] = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in size["text"]]
    by = size.groupby("source", dropna=False)["n"].sum()
    names = sorted((x for x in by.index if isinstance(x, str)), key=lambda x: [ord(c) for c in x]) + [x for x in by.index if not isinstance(x, str)]
    weight, left, target, free = {x: (5, 2, 1)[k % 3] for k, x in enumerate(names)}, 1.5 * by.sum(), {}, list(names)
    while free:
        share = {x: left * weight[x] / sum(weight[f] for f in free) for x in free}
        full = [x for x in free if share[x] > 2 * by[x]]
        for x in full or free:
            target[x] = 2.0 * by[x] if full else share[x]
        left, free = left - sum(target[x] for x in full), [x for x in free if x not in target]
    assert dict(zip(size["doc_id"], size["n"], strict=True)) == dict(zip(got["doc_id"], got["size"], strict=True))
    for x, g in got.groupby("source", dropna=False):
        goal = target[x] if isinstance(x, str) else target[names[-1]]
        assert abs(g["target"].iloc[0] - goal) <= 1e-6 * max(goal, 1) and abs(g["taken"].sum() - goal) <= max(0.03 * goal, 32)
    assert (got["taken"] <= 2 * got["size"]).all()


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    monkeypatch.setattr(common, "_own", [])
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(Cluster)
