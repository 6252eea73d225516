"""Stages of the pipeline: schema, decisions that take effect, clean documents kept, and each stage against brute force on its own input."""

from __future__ import annotations

import re
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from terrace.llm import mixing, neardup, toxicity

PLAIN, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    labels, items = spark.read.parquet(f"{tiny}/labels.parquet"), [r["text"] for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    seen = [docs]
    for _, step in corpus_pipeline.STAGES:
        seen.append(step(spark, seen[-1], tiny).cache())
    for df in seen[1:-1]:
        assert df.columns == docs.columns and df.count() > 0
    scored = toxicity.scores(docs, toxicity.train(docs, labels))
    assert {r[0] for r in seen[1].select("doc_id").collect()} == {r[0] for r in scored.where("toxicity < 0.3").select("doc_id").collect()}
    assert seen[2].count() == seen[1].count() and seen[2].where("n_chars <> length(text)").count() == 0
    before = {r["doc_id"]: r["text"] for r in seen[1].collect()}
    for r in seen[2].collect():
        left = iter(before[r["doc_id"]].split("\n"))
        assert r["text"] == "" or all(line in left for line in r["text"].split("\n"))  # what is left is in order

    sets = {}
    for r in seen[2].collect():
        w = PLAIN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]))
        sets[r["doc_id"]] = {tuple(w[p : p + 5]) for p in range(max(len(w) - 4, min(len(w), 1)))}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if root[i] != root[j] and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    assert {r[0] for r in seen[3].select("doc_id").collect()} == {i for i, k in root.items() if i == k}

    low = lambda t: ALNUM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    wins = {tuple(w[p : p + 10]) for t in items for w in [low(t)] for p in range(max(len(w) - 9, min(len(w), 1)))}
    clean = {r["doc_id"] for r in seen[3].collect() if not any(tuple(w[p : p + n]) in wins for w in [low(r["text"])] for n in {len(k) for k in wins} for p in range(len(w) - n + 1))}
    assert {r[0] for r in seen[4].select("doc_id").collect()} == clean
    assert seen[5].orderBy("doc_id").collect() == mixing.mix(seen[4]).orderBy("doc_id").collect()


def test_run(spark, tiny):
    out = corpus_pipeline.run(spark, tiny)
    assert out.count() > 0 and out.where(F.col("taken") > 2 * F.col("size")).count() == 0


def test_near_dedup_gathers_no_small_side(spark, tiny):
    """However small the sides of its joins turn out, none is made a table in the driver and broadcast; the session's settings are as before."""
    key, store = "spark.sql.adaptive.autoBroadcastJoinThreshold", spark._jsparkSession.sharedState().statusStore()
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    want = neardup.representatives(docs, shingle=5, percent=80, rows=6).count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set(key, "10m")
    try:
        began = store.executionsCount()
        kept = neardup.representatives(docs, shingle=5, percent=80, rows=6)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        runs = store.executionsList(began, 1000)
        plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
        assert spark.conf.get(key) == "10m"
    finally:
        spark.conf.unset(key)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
    assert kept.count() == want


def test_memory_of_the_pair_search():
    """The search of pairs in the driver holds a few bytes for each term of a text."""
    n, terms = 100_000, 30
    each = [np.array([t]) for t in range(terms) for _ in range(9)] + [np.arange(terms)] * n
    row, at = np.repeat(np.arange(len(each), dtype=np.int32), [len(t) for t in each]), np.concatenate(each).astype(np.int32)
    y = (np.arange(len(each)) < 9 * terms).astype(float)
    del each
    tracemalloc.start()
    found = toxicity.meeting_pairs(row, at, terms, y, np.full(len(y), 0.1))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not found.any() and most < 20 * len(at)
