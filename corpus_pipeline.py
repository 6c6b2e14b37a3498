"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import bound_batches, drop_scratch, materialize, scratch_path, table
from quarry.llm.decontam import drop_contaminated
from quarry.llm.entropy_mix import take_mix
from quarry.llm.language_id import keep_identified
from quarry.llm.near_dups import drop_near_duplicates
from quarry.llm.token_codes import read_documents, write_tokens


def _stage(work: Callable) -> Callable:
    """work, with batches to Python bounded: its result is run later, in the same session."""

    @wraps(work)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return work(spark, docs, sf_dir)

    return bounded


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; all labelled ones teach it."""
    return keep_identified(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that links of 0.8 or more (Jaccard, five-word shingles) join."""
    return drop_near_duplicates(docs, words=5, similarity=0.8)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return take_mix(docs)


@_stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each copy, read back from the token files."""
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path)
    return read_documents(spark, path)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("token ids", token_ids),
]

#: Training, fingerprints and the tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if i:
            drop_scratch(before)
    return STAGES[-1][1](spark, docs, sf_dir)
