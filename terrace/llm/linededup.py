"""Line deduplication over content-defined chunks of lines, in DataFrame functions only.

Every line has a hash, and a rolling hash runs over the last ``WINDOW`` of them (a polynomial in ``BASE`` modulo 2^32). A chunk ends where
the rolling hash is a local minimum, and on every second line of a stretch where it stays equal (as in repeated lines), never one line after
another end: chunks have two lines or more, three on average, and boundaries move with the content when lines are put in or
taken out. What happens to the chunks:

1. their 64-bit hashes are computed in one pass and written with their places; those that occur more than once are found by partial sums;
2. the documents that hold such chunks give the bytes of these chunks, and the lines of the chunk before and of the chunk after;
3. places are grouped by bytes. Everywhere but in the first place (smallest document, then first in it) a chunk goes, and with it the
   neighbouring lines that are byte for byte those of the first place: so a repeat also loses what lies before its first boundary and after its last.

``without_repeated_runs``, which the pipeline uses, takes what the chunks find and then looks exactly at what they cannot settle, repeats that hold no whole chunk: the pairs of neighbouring lines
that no repeat found by chunks covers are counted, by two 64-bit hashes, and the lines of a pair go wherever it is not the pair's first place. Together that is every line of a run of two or more that an earlier place has
(a covered pair has an earlier place, so a pair's first place is never covered and the others need not be looked at).

A hot chunk meets in one task as one row a task; its places are found by joins with written tables, which adaptive execution splits. Texts join
what is found about them by sorting both sides, which spills, at every size: neither a table in memory nor a plan that changes with the input.

Nulls: a null text has no lines and stays null. A null doc_id comes after all others; ids may have any type with an order. Rows of one doc_id are told apart by a hash
of their text; equal rows get equal results, so ties need no rule. Texts are worked on whole, one row at a time, with memory in proportion to the row.
Columns are kept, but for n_lines and n_removed, which are replaced, and names that begin with _ld_, which are its own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import drop, stage

WINDOW, BASE = 2, 31


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds row key (_ld_doc, _ld_tag) and _ld_lines."""
    return (
        docs.withColumn("_ld_doc", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).withColumn("_ld_tag", F.xxhash64("text"))
        .withColumn("_ld_lines", F.split(F.coalesce("text", F.lit("")), "\n", -1)))


def _rolling(window: int) -> Column:
    """The rolling hash at every line; hashes before the first line count as 0."""
    terms = (f"(CASE WHEN i > {k} THEN _ld_codes[i - {k + 1}] ELSE 0 END) * {BASE**k}" for k in range(window))
    return F.expr(f"transform(sequence(1, size(_ld_codes)), i -> ({' + '.join(terms)}) % {1 << 32})")


def _chunked(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds the row key, _ld_lines, and _ld_chunks: number, first and last line (from 1) of each chunk."""
    low = "i > 1 AND i < size(_ld_roll) - 1 AND _ld_roll[i - 1] < _ld_roll[i - 2] AND _ld_roll[i - 1] <= _ld_roll[i]"
    level = "i > 2 AND i < size(_ld_roll) - 1 AND i % 2 = 0 AND _ld_roll[i - 1] = _ld_roll[i - 3] AND _ld_roll[i - 1] = _ld_roll[i - 2] AND _ld_roll[i - 1] = _ld_roll[i]"
    return (
        _keyed(docs).withColumn("_ld_codes", F.transform("_ld_lines", lambda line: F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")))
        .withColumn("_ld_roll", _rolling(window))
        .withColumn("_ld_ends", F.expr(f"filter(sequence(1, size(_ld_roll)), i -> i = size(_ld_roll) OR ({low}) OR ({level}))"))
        .withColumn("_ld_chunks", F.expr("transform(_ld_ends, (e, k) -> struct(k AS no, CASE WHEN k = 0 THEN 1 ELSE _ld_ends[k - 1] + 1 END AS a, e AS b))"))
        .drop("_ld_codes", "_ld_roll", "_ld_ends"))


def _lines(c: Column) -> Column:
    """The lines of a chunk, none of a null one."""
    return F.when(c.isNotNull(), F.slice("_ld_lines", c["a"], c["b"] - c["a"] + 1)).otherwise(F.array().cast("array<string>"))


def _alike(x: Column, y: Column) -> Column:
    """Number of leading items that two arrays have in common."""
    n = F.least(F.size(x), F.size(y))
    return F.when(n > 0, F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.get(x, i - 1) != F.get(y, i - 1))) - 1, n)).otherwise(0)


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_ld_doc, _ld_tag, a, b): first and last line (from 1) of each repeated chunk with the lines around it that are repeated too, wherever it is not in its first place."""
    docs = docs.select("doc_id", "text")
    whole = F.transform(F.filter("_ld_chunks", lambda c: c["b"] > c["a"]), lambda c: F.struct(c["no"].alias("no"), F.xxhash64(F.array_join(_lines(c), "\n")).alias("hash")))
    hashes = stage(_chunked(docs, window).select("_ld_doc", "_ld_tag", F.explode(whole).alias("c")).select("_ld_doc", "_ld_tag", "c.no", "c.hash"), "hashes")
    often = stage(hashes.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "often")
    held = stage(hashes.join(often, "hash").groupBy("_ld_doc", "_ld_tag").agg(F.array_distinct(F.collect_list("no")).alias("nos")), "held")
    around = lambda k: F.struct(
        k.alias("no"), F.get("_ld_chunks", k).alias("at"), F.array_join(_lines(F.get("_ld_chunks", k)), "\n").alias("bytes"),
        F.reverse(_lines(F.get("_ld_chunks", k - 1))).alias("before"), _lines(F.get("_ld_chunks", k + 1)).alias("after"))
    fetched = _chunked(docs.join(held.hint("merge"), (F.struct(F.col("doc_id").isNull(), F.col("doc_id")) == F.col("_ld_doc")) & (F.xxhash64("text") == F.col("_ld_tag"))).drop("_ld_doc", "_ld_tag"), window)
    places = fetched.select("_ld_doc", "_ld_tag", F.explode(F.transform("nos", around)).alias("c")).select("_ld_doc", "_ld_tag", "c.*").withColumn("hash", F.xxhash64("bytes"))
    places = stage(places, "chunks")
    here = F.struct("_ld_doc", "_ld_tag", "no")
    first = places.groupBy("hash", "bytes").agg(F.min(F.struct(*(F.col(c).alias(c) for c in ("_ld_doc", "_ld_tag", "no", "before", "after")))).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stage(first.select("hash", "bytes", F.struct("first._ld_doc", "first._ld_tag", "first.no").alias("first"), F.col("first.before").alias("first_before"), F.col("first.after").alias("first_after")), "first")
    gone = places.join(first, ["hash", "bytes"]).where(here != F.col("first"))
    before, after = _alike(F.col("before"), F.col("first_before")), _alike(F.col("after"), F.col("first_after"))
    spans = stage(gone.select("_ld_doc", "_ld_tag", (F.col("at.a") - before).alias("a"), (F.col("at.b") + after).alias("b")), "spans")
    drop(hashes, often, held, places, first)
    return spans


def _numbers(numbered: DataFrame, name: str) -> DataFrame:
    """The distinct numbers in column ``line`` of each row key, as an array."""
    return numbered.groupBy("_ld_doc", "_ld_tag").agg(F.collect_set("line").alias(name))


def _of_spans(spans: DataFrame) -> DataFrame:
    """(_ld_doc, _ld_tag, line) of spans."""
    return spans.select("_ld_doc", "_ld_tag", F.explode(F.sequence("a", "b")).alias("line"))


def repeated_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_ld_doc, _ld_tag, _ld_gone): for every row with lines to remove, their numbers (from 1)."""
    spans = repeated_spans(docs, window)
    gone = stage(_numbers(_of_spans(spans), "_ld_gone"), "lines")
    drop(spans)
    return gone


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the lines in ``found``, and n_lines and n_removed."""
    lines = _keyed(docs).join(found.hint("merge"), ["_ld_doc", "_ld_tag"], "left")
    left = F.array_except(F.sequence(F.lit(1), F.size("_ld_lines")), "_ld_gone")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("_ld_lines")).cast("long")
    removed = F.when(F.col("_ld_gone").isNull(), 0).otherwise(F.size("_ld_lines") - F.size("_ld_left")).cast("long")
    text = F.when(F.col("_ld_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("_ld_left", lambda i: F.get("_ld_lines", i - 1)), "\n"))
    return lines.withColumn("_ld_left", left).select(*(text.alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")), n.alias("n_lines"), removed.alias("n_removed"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the text that is left, and n_lines and n_removed."""
    return _without(docs, repeated_lines(docs, window))


def _pairs_left(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(_ld_doc, _ld_tag, line): the first lines of the pairs of neighbouring lines that no span covers and that have such a place before this one."""
    known = stage(_numbers(spans.select("_ld_doc", "_ld_tag", F.explode(F.sequence("a", F.col("b") - 1)).alias("line")), "_ld_known"), "known")
    lines = _keyed(docs.select("doc_id", "text")).where(F.size("_ld_lines") > 1).join(known.hint("merge"), ["_ld_doc", "_ld_tag"], "left")
    pair = lambda i: F.struct(i.alias("no"), F.xxhash64(F.get("_ld_lines", i - 1), F.get("_ld_lines", i)).alias("h1"), F.xxhash64(F.lit(1), F.get("_ld_lines", i), F.get("_ld_lines", i - 1)).alias("h2"))
    every = F.sequence(F.lit(1), F.size("_ld_lines") - 1)
    asked = F.when(F.col("_ld_known").isNull(), every).otherwise(F.array_except(every, "_ld_known"))
    some = stage(lines.select("_ld_doc", "_ld_tag", F.explode(F.transform(asked, pair)).alias("p")).select("_ld_doc", "_ld_tag", "p.*"), "pairs")
    often = stage(some.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("_ld_doc", "_ld_tag", "no")).alias("first")).where("n > 1").drop("n"), "often")
    gone = some.join(often, ["h1", "h2"]).where(F.struct("_ld_doc", "_ld_tag", "no") != F.col("first"))
    gone = stage(gone.select("_ld_doc", "_ld_tag", F.col("no").alias("line")), "places")
    drop(known, some, often)
    return gone


def repeated_runs(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_ld_doc, _ld_tag, _ld_gone): as ``repeated_lines``, with the lines of repeats that hold no whole chunk."""
    spans = repeated_spans(docs, window)
    pairs = _pairs_left(docs, spans)
    both = _of_spans(spans).unionByName(pairs.select("_ld_doc", "_ld_tag", F.explode(F.array(F.col("line"), F.col("line") + 1)).alias("line")))
    gone = stage(_numbers(both, "_ld_gone"), "lines")
    drop(spans, pairs)
    return gone


def without_repeated_runs(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines of any run of two or more that an earlier place has, and n_lines and n_removed."""
    return _without(docs, repeated_runs(docs))


def digest(cleaned: DataFrame) -> DataFrame:
    """Counts of lines and the digest of the text that is left."""
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
