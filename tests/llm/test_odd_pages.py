"""Licence rules over very long texts, and main text of generated layouts whose article is known."""

from __future__ import annotations

import random
import time

import pandas as pd
import pytest
from helpers import run_sql, same

from terrace.llm import licenses, webtext
from terrace.llm.oracles import ORACLES

MIT = ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]


def licence_text(ids):
    return "\n".join(licenses.SENTENCES[i] for i in ids)


def licences_by_force(ids):
    """Rules in order over the sequence as cut by line and as running text, which are the same here."""
    names, left = set(), list(ids)
    for name, rule in sorted(licenses.RULES, key=lambda r: -len(r[1])):
        gone, now = set(), []
        for i, x in enumerate(left):
            if x == rule[len(now)]:
                now.append(i)
                if len(now) == len(rule):
                    gone |= set(now)
                    names.add(name)
                    now = []
        left = [x for i, x in enumerate(left) if i not in gone]
    return ",".join(sorted(names))


def test_licence_rules_by_force(spark):
    rng = random.Random(2)
    several = [i for _, r in licenses.RULES for i in r if len(r) > 1]
    cases = [["mit-grant"] + ["reserved"] * 2000, MIT[:3] * 200, MIT * 20 + ["reserved"], ["reserved"] * 3 + MIT[:2] + MIT + MIT[2:], ["bsd-grant", "bsd-source", "bsd-binary"] * 2 + ["bsd-name"], MIT * 70 + MIT[:3]]
    cases += [["gpl-free", "gpl-two-may", "gpl-free", "lgpl-two-may", "gpl-two-version", "lgpl-two-one-version"]] + [[rng.choice(several) for _ in range(rng.randrange(1, 60))] for _ in range(40)]
    frame = pd.DataFrame([(k, licence_text(c)) for k, c in enumerate(cases)], columns=["doc_id", "text"])
    got = licenses.digest(licenses.scan(spark.createDataFrame(frame, "doc_id long, text string"))).toPandas()
    assert dict(zip(got["doc_id"], got["licences"], strict=True)) == {k: licences_by_force(c) for k, c in enumerate(cases)}
    same(got, run_sql("/root/testdata/sf0.001", ORACLES["op7_license_scan"], documents=frame))


def test_licence_scan_of_many_identifiers(spark):
    """10^5 identifiers that begin a rule, or parts of one over and over, take time in proportion."""
    took = []
    for n, ids in ((50_001, ["mit-grant"] + ["reserved"] * 50_000), (100_001, ["mit-grant"] + ["reserved"] * 100_000)):
        began = time.perf_counter()
        row = licenses.scan(spark.createDataFrame([(1, licence_text(ids))], "doc_id long, text string")).first()
        took.append(time.perf_counter() - began)
        assert len(row["sentence_ids"]) == n and row["licences"] == []
    assert took[1] < 4 * took[0] + 5
    row = licenses.scan(spark.createDataFrame([(1, licence_text(MIT[:3] * 1000))], "doc_id long, text string")).first()
    assert row["licences"] == ["MIT"] and len(row["sentence_ids"]) == 3000  # the two sentences of the shorter rule


PROSE = [
    "The council approved the plan on Monday after a long debate about costs, and members of the public spoke for and against it in a hearing that lasted until midnight.",
    "Engineers had warned that the old bridge would not carry the new trams, so the line will now follow the river bank for two kilometres before it crosses.",
    "Work begins in spring, once the last of the permits is in hand, and the first trains should run three years later if nothing else is found in the ground.",
    "Residents asked who would pay for the noise barriers, and were told that the state covers most of it while the city pays for planting and upkeep.",
]
JUNK_NAMES = "wp-block-comments fb-comments commentlist jp-relatedposts cmp-cookie-notice adsbygoogle google-ads comment-list-2 sidebar newsletter-signup relatedposts td-related-posts".split()
PLAIN_NAMES = "with-sidebar no-comments search-results comment-on-policy hero wide x1 entry-content".split()


def layout(rng):
    """A page and its article's text."""
    paragraphs = [rng.choice(PROSE) + f" Paragraph {k}." for k in range(rng.randrange(3, 7))]
    title = "A headline of the day"
    junk = lambda: f"<{(t := rng.choice(['div', 'section', 'aside']))} class='{rng.choice(JUNK_NAMES)}'><p>{rng.choice(PROSE[:2])} Foreign words {rng.random():.3f}.</p></{t}>"
    inner = [f"<h1>{title}</h1>"]
    for p in paragraphs:
        inner.append(f"<p>{p}</p>" if rng.random() < 0.7 else f"<p>{p}")
        if rng.random() < 0.3:
            inner.append(junk())
    if rng.random() < 0.3:
        inner.append("<form><label>Your name</label><input name=n><p>Send us a note</p><button>Send</button></form>")
    body = "".join(inner)
    if rng.random() < 0.5:
        body = f"<div class='{rng.choice(PLAIN_NAMES)}'>{body}</div>"
    body = f"<article>{body}</article>"
    if rng.random() < 0.5:
        body = f"<div class='{rng.choice(PLAIN_NAMES)}'>{body}</div>{junk()}"
    page = f"<header><p>Site name</p></header><nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav>{body}<footer><p>Imprint and terms of use</p></footer>"
    if rng.random() < 0.4:
        page = f"<form id='aspnetForm' action='/x'><input type=hidden name=v value='1'>{page}</form>"
    return f"<html><head><title>t</title><style>p {{}}</style></head><body>{page}<script>var x = '<p>no</p>';</script></body></html>", " ".join([title, *paragraphs])


def test_generated_layouts(spark):
    rng = random.Random(11)
    pages = [layout(rng) for _ in range(150)]
    df = spark.createDataFrame([(i, f"https://h{i % 9}.example/{i}", p) for i, (p, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in webtext.main_text(df).collect()}
    assert got == {i: t for i, (_, t) in enumerate(pages)}


@pytest.mark.parametrize(("name", "mark"), [*((n, 2) for n in JUNK_NAMES if n != "sidebar"), ("sidebar", 1), ("left-sidebar", 1), *((n, 0) for n in PLAIN_NAMES), ("advice", 0), ("related-law", 0), ("article-header", 0)])
def test_names(name, mark):
    assert webtext._mark(name) == mark


def test_forms():
    p = PROSE[0]
    text = lambda body: webtext.Page(body).text(None)
    assert text(f"<form id='aspnetForm'><article><h1>T</h1><p>{p}</p></article></form>") == f"T {p}"
    assert text(f"<form><div><p>{p}</p><p>{p}</p><label>Name</label><select><option>a</select></div></form><footer>a short footer</footer>") == f"{p} {p}"
    assert text("<form><label>User</label><p>Sign in here</p></form>") == ""
    assert text(f"<div><p>{p}</p><form><p>Sign up to our list</p></form></div>") == p
    assert text(f"<article><p>{p}</p><aside class='pullquote'>A quote</aside><aside>Foreign</aside><p>Press <button>Start</button> now.</p><button>Share</button></article>") == f"{p} A quote Press Start now."


def test_unclosed_tags_take_linear_time():
    for body in ("<b>{n}<p>x{n}", "<b>x{n}", "<i><b>{n}<tr><td>x{n}", "<span>{n}</b>{n}<li>a{n}", "<table><tr><td>{n}x", "<form><b>{n}x"):
        took = []
        for n in (5_000, 20_000):
            source = "".join(part * n if part else "" for part in body.split("{n}"))
            began = time.process_time()
            webtext.Page(source).text(None)
            took.append(time.process_time() - began)
        assert took[1] < 8 * took[0] + 0.3, (body, took)
