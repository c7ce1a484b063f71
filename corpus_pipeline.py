"""The corpus pipeline: toxicity, near-duplicates, personal data, mixing, BPE.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import bpe, mixing, near_dup, pii, toxicity
from tributary.llm.queries import vocabulary
from tributary.llm.texts import table
from tributary.scratch import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models, learned from the labelled ones among ``docs``, do not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_column(spark, model) < 0.5) if model else docs


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near-duplicates."""
    return near_dup.one_of_each(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and secrets; ``n_chars`` follows the new text."""
    hidden = pii.pseudonymize(docs)
    return hidden.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of rare sources up to twice, as the temperature weights ask."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids`` of each document that is left; its text is decoded from the ids."""
    coded = bpe.round_trip(docs.select("doc_id", "source", "text"), vocabulary("byte_bpe_50k.json"), out_col="text")
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near-duplicates", one_of_each),
    ("personal-data", hide_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Learned models, sketches and keyed hashes decide the rows; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
