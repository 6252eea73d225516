"""A corpus pipeline: toxic documents go, repeated runs of lines go, one document of each near-duplicate group stays, contaminated documents go, and sources are mixed to target weights.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import decontam, linededup, mixing, neardup, toxicity
from terrace.llm.common import delete, stage, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of a model fitted to the labelled ones.

    A null or empty text scores as the bias alone does, so it stays unless most labels are toxic; a null doc_id is scored like any other. Repeated rows stay or go together. Without documents or labels
    nothing goes. Columns of any name are kept.
    """
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without runs of two or more lines that an earlier place has; n_chars counts what is left.

    Every row stays, with empty text where all of its lines were repeats; a null text stays null, with n_chars null. Rows without doc_id come after all others. Equal rows count as one place, so they get
    the same text. An empty table gives an empty result. Columns of any name are kept; n_lines, n_removed and names that begin with _ld_ may be the caller's own only if they are among the columns of documents, which they are not.
    """
    kept = linededup.without_repeated_runs(docs)
    return kept.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group linked by five-word shingles at similarity 0.8, at that similarity included.

    Documents without words (null and empty texts, or emptied by the stage before) are linked with nothing and stay, as do rows without doc_id. Rows of one doc_id are one document and stay or go together.
    An empty table gives an empty result. Columns of any name are kept.
    """
    return neardup.representatives(docs, shingle=5, percent=80, rows=6)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.

    Null and empty texts have no words and stay. Rows of one doc_id, or without any, go together if one of them has a hit. Items that are null or empty say nothing. An empty table, or an empty
    benchmark, drops nothing. Columns of any name are kept.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: (doc_id, source, size, source_size, target, taken), a row for each row of ``docs``.

    A null text has size 0 and takes nothing; a null source is one of its own. Equal ids are put in order by size, and equal rows take equal numbers or the words of one more block among them.
    An empty table gives an empty result. Columns other than doc_id, source and text are not read.
    """
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("MinHash near-dedup", drop_near_duplicates), ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
]
#: A fitted model decides the first stage, which SQL cannot express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written and read again, and what the stage before it wrote is deleted."""
    docs, others = spark.read.parquet(f"{sf_dir}/documents.parquet"), set(staged())
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        delete(spark, [t for t in staged()[:-1] if t not in others])
    return STAGES[-1][1](spark, docs, sf_dir)
