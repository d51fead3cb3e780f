"""Corpus pipeline: quality, toxicity, near duplicates, personal data, packing.

Each stage takes what its predecessor kept and decides about every row of it. Rows with a null doc_id have no component
and stay; repeated rows of one doc_id that stay are kept each. Null and empty texts are judged as texts of no words: they
have no partners, no personal data and a length of one token. Very long texts are judged whole and cut only by packing.
Other columns than those of documents are left out by the first stage, so none clashes. An empty table passes through as
an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import pii, quality, toxicity
from rivulet.llm.common import staged, table
from rivulet.llm.packing import packed, token_lengths
from rivulet.llm.partenum import FOUR_FIFTHS, ngram_jaccard_components
from rivulet.llm.setjoin import pick
from rivulet.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose quality score is below are rejected; good ones score near 1, so doubtful ones stay.
REJECT_BELOW = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; all labels may teach it here. Texts stay in place: labelled ones are
    measured first for the fit, then all for their scores."""
    labels = table(spark, sf_dir, "labels").where("quality is not null")
    known = pick(docs, labels.select("doc_id").distinct(), "doc_id")
    stats = staged(quality.measured(known.select("doc_id", "text")).drop("text"), "pipeline")
    scored = quality.score(quality.measured(docs.select(*COLUMNS)), quality.fit(stats, labels))
    return scored.where(F.col("score") >= REJECT_BELOW).select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where("toxic = 0").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component (five-word shingles, likeness 0.8 or more) the document with the least doc_id stays. Only ids
    move if few enough go."""
    found = ngram_jaccard_components(docs, FOUR_FIFTHS).where("component_id <> doc_id")
    return pick(docs, staged(found.select("doc_id").distinct(), "pipeline"), "doc_id", "left_anti").select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become [kind]; n_chars is counted again."""
    return pii.masked(docs).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its bin and place there."""
    return packed(token_lengths(docs))


#: Rows that Spark sends to a Python worker at once: whole texts, which both sides hold outside of Spark's accounts.
ARROW_ROWS = 1000


def _shipped(stage: Callable) -> Callable:
    """The stage, with the package at hand on the workers, and Arrow batches of few texts in its session."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality classifier", _shipped(quality_stage)),
    ("toxicity", _shipped(toxicity_stage)),
    ("n-gram Jaccard join", _shipped(near_duplicate_stage)),
    ("PII", _shipped(pii_stage)),
    ("best-fit packing", _shipped(packing_stage)),
]
#: No SQL: trained models and packing; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline")
    return docs
