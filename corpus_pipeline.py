"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again.

Every stage takes an empty table, null ids, texts, sources and labels, repeated rows, texts of any length and further
columns, whose names may clash with those that the operators use; all but the last keep the columns as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, mixing, neardup, packing, secrets
from tessera.session import bound_batches, stage_table, table, unstage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _bounded(stage: Stage) -> Stage:
    """The stage with rows going to Python in batches of bounded bytes, so that texts of any length leave memory to the rest."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@_bounded
def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go.

    Those are null and empty texts, texts without a letter, and those scored below 0.5 by a model learned from the
    table's own labels. Repeated rows go or stay together; without any label, or without rows, all stay.
    """
    return langid.keep_identified(docs)


@_bounded
def _near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (80 % of five-word shingles) stays: that with the smallest id.

    Of repeated rows one stays; texts that share an id are documents of their own; rows without an id or without a
    word are linked with nothing and stay.
    """
    return neardup.keep_one(docs, percent=80, size=5)


@_bounded
def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced, and ``n_chars``, where there is such a column, by the new lengths.

    No row goes; null texts stay null and keep their ``n_chars``; repeated rows stay repeated.
    """
    out = secrets.redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


@_bounded
def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated (three times at most) or left out to meet the sources' targets.

    Null sources are a source of their own; texts without a word take nothing and go; of repeated rows as many are taken
    as of other documents of their size.
    """
    return mixing.apply_mix(docs)


@_bounded
def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents are packed into windows: one row for each piece of a document.

    Null and empty texts are their closing token alone; repeated rows are packed each; null ids stay null.
    """
    return packing.pack(docs)


STAGES = [("language", _language), ("near_copies", _near_copies), ("secrets", _secrets), ("mix", _mix), ("packing", _pack)]

#: Trained models, sketches and hash ranks have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the pieces that the last one gives.

    Each stage's result is a table in the shared folder, from which a lost executor's work starts again; it is deleted once
    the next one is written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        unstage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
