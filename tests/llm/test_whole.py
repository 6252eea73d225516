"""Operators do the whole job: what an earlier rule cut off."""

from __future__ import annotations

import corpus_pipeline
from terrace.llm import linededup, webtext


def runs_by_force(rows):
    """Text left of each document when every line of a pair of lines that an earlier place has goes."""
    first, out = {}, {}
    for i, text in sorted(rows):
        w = text.split("\n")
        gone = {j for p in range(len(w) - 1) if first.setdefault((w[p], w[p + 1]), (i, p)) != (i, p) for j in (p, p + 1)}
        out[i] = ("\n".join(x for j, x in enumerate(w) if j not in gone), len(gone))
    return out


def test_runs_of_lines(spark):
    shared = [f"shared {k}" for k in range(12)]
    rows = [(n, "\n".join([f"own {n}", *shared[a:b], f"end {n}", f"last {n}"])) for n, (a, b) in enumerate([(0, 12), (0, 2), (3, 6), (5, 12), (0, 12), (7, 8)])]
    rows += [(6, "p\np\np"), (7, ""), (8, "own 0\nshared 0")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = runs_by_force(rows)
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in linededup.without_repeated_runs(df).collect()} == want
    assert want[1] == ("own 1\nend 1\nlast 1", 2) and want[5][1] == 0
    full = df.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, full, "").collect()} == {i: t for i, (t, _) in want.items()}
    nulls = spark.createDataFrame([(None, "a\nb"), (3, "a\nb"), (3, "a\nb"), (4, None)], "doc_id long, text string")
    assert sorted(((r["doc_id"] or -1), r["text"], r["n_lines"], r["n_removed"]) for r in linededup.without_repeated_runs(nulls).collect() if r["doc_id"] != 4) == [(-1, "", 2, 2), (3, "a\nb", 2, 0), (3, "a\nb", 2, 0)]
    assert linededup.without_repeated_runs(df.limit(0)).count() == 0


def test_runs_of_lines_recall(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = runs_by_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in linededup.without_repeated_runs(docs).collect()} == want


def test_main_text_keeps_the_whole_article(spark):
    """Headings and sibling sections of an article stay, however long its main part is."""
    long = "<p>" + "word " * 400 + "</p>"
    bodies = {
        "entry": ("<article><h1>Head</h1><p>Intro here</p><div class='entry-content'>" + long + "</div><section class='more'><p>Second part</p></section></article>", ("Head Intro here word", "word Second part")),
        "deep": ("<article><div class='w'><section class='a'>" + long + "</section><section class='b'><p>Short b</p></section></div></article>", ("word", "word Short b")),
        "main": ("<main><h1>Head</h1><div class='content'>" + long + "</div></main>", ("Head word", "word")),
        "post": ("<div class='post'><h1>Head</h1><div class='entry-content'>" + long + "</div></div>", ("Head word", "word")),
        "sections": ("<div class='x'><section class='a'>" + long + "</section><section class='b'>" + long + "</section></div>", ("word", "word")),
        "list": ("<div class='content'><div class='post'>" + long + "</div><div class='y'>" + "<a href='/'>Another page of ours</a> " * 9 + "</div></div>", ("word", "word")),
    }
    rows = [(i, f"https://{name}.example/{i}", f"<html><body><nav>Menu</nav>{body}<div class='z'><p>Outside</p></div><footer>f</footer></body></html>") for i, (name, (body, _)) in enumerate(bodies.items())]
    found = {r["page_id"]: r["text"] for r in webtext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, (name, (body, (head, tail))) in enumerate(bodies.items()):
        assert found[i].startswith(head) and found[i].endswith(tail) and found[i].count("word") == body.count("word "), name


def test_pipeline_line_dedup_goes_by_chunks(spark, tiny, monkeypatch):
    """The stage's repeats are found by chunks; only pairs of lines that no such repeat covers are looked at beside them."""
    docs, rows, real = spark.read.parquet(f"{tiny}/documents.parquet"), {}, linededup.stage

    def counted(df, name):
        out = real(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(linededup, "stage", counted)
    corpus_pipeline.drop_repeated_lines(spark, docs, tiny).count()
    assert rows["hashes"][0] > 0 and rows["chunks"][0] > rows["first"][0] > 0 and rows["spans"][0] > 0
    assert rows["pairs"][0] < sum(r["text"].count("\n") for r in docs.collect() if r["text"])
