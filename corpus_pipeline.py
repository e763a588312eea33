"""From raw documents to token ids in five stages; each calls one corpus operator on all its predecessor kept.

A stage takes (spark, docs, sf_dir), returns a DataFrame, and is written as
Parquet and read again before the next. All but the last return the columns
of ``documents``, and other columns are dropped. Null, empty and very long
texts, shared and null doc_ids, repeated rows and empty tables are as each
operator states: null and empty texts fail the quality rules and go there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import lines, mixing, near, pieces, rules
from palimpsest.llm.common import stash, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return rules.judge(docs, trusted, carry=("lang", "source", "n_chars")).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the repeats of multi-line chunks."""
    return lines.line_dedup(docs, carry=("lang", "source")).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, 80%): the one with the smallest doc_id."""
    return near.without_near_duplicates(docs, words=5, percent=80).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as its source's target asks."""
    return mixing.repeat_rows(docs, mixing.mix(docs)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix."""
    return pieces.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode),
]
#: Sketches and piece lattices are beyond SQL; tests/llm/test_pipeline.py compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
