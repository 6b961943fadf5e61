"""Training-data pipeline over `documents`: five stages, each of which calls one operator of tidemark.llm.

toxicity: documents predicted toxic go. near_duplicates: of every group that the n-gram Jaccard join links, the document
of the smallest doc_id stays. decontamination: documents that hold a benchmark item go. personal_data: spans are replaced
by their kinds; no document goes. encoding: the last stage; every document as token ids with its digests.

All stages but the last return COLUMNS, which the table they are given must have; other columns, of whatever names, go. Null and
empty texts stay in every stage, as does a row without doc_id, and are encoded as no tokens. Rows that repeat a doc_id are
rows of their own: of those with equal texts one stays, like one of each group of near copies. Over empty tables every
stage gives none or the rows it was given: without labels nothing is toxic, without a benchmark nothing is contaminated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontam, ngram_join, pii, toxicity
from tidemark.llm.common import documents, ship, stored
from tidemark.llm.queries import vocabulary_path

#: Near duplicates: two documents link when 100 * intersection >= 80 * union of their five-word shingles.
NEAR = (80, 100, 5)
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Toxicity, the near-duplicate groups and the tokenizer have no SQL form; tests compare run() with a plain version.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; see toxicity.keep_clean()."""
    return toxicity.keep_clean(_columns(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies; see ngram_join.keep_one()."""
    return ngram_join.keep_one(_columns(docs), *NEAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; see decontam.drop_contaminated()."""
    return decontam.drop_contaminated(_columns(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; see pii.redact()."""
    return pii.redact(_columns(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of every document; see bpe.bpe_digests()."""
    return bpe.bpe_digests(docs, vocabulary_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", personal_data),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the table documents; what a stage returns is written to the shared folder and read again."""
    ship(spark)
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
