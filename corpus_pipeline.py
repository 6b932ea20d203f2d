"""The corpus pipeline: quality rules, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns
of the documents; rejected documents are gone, and removed lines and passages are gone from their texts, with
``n_chars`` counted anew where there is such a column.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark import session
from docspark.llm import line_quality, minhash, packing, repeats, tables, toxicity


def _ready(spark: SparkSession) -> None:
    session.prepare(spark)
    tables.prepare(spark)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't depleted, without lines too frequent at their source (``op1``'s rule).

    A null text fails; a null source is one of its own; repeated rows fare alike; no rows give none.
    """
    _ready(spark)
    return _counted(line_quality.cleaned(docs))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold, by a model fitted to labels of the documents still there.

    A null text scores as an empty one, a row without an id is scored like any other. Without labels that tell texts
    apart, or without rows, everything stays.
    """
    _ready(spark)
    machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text")
    scored = toxicity.toxicity(rows, machine, keep=["row"])
    return scored.where(F.col("predicted") == 0).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least id; a row that repeats another goes.

    Of rows with one id and one text that differ elsewhere the one of least hash stays. Texts without a word have no
    duplicates but rows of their own id; a row without an id stays only if nothing with one is like it.
    """
    _ready(spark)
    stay = minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("stay")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", *line_quality.text_key(F.col("text")))
    rows = rows.join(stay, F.col("doc_id").eqNullSafe(F.col("stay")), "left_semi")
    rows = rows.groupBy("doc_id", "k1", "k2").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of over 50 words, or of 400 bytes, that occur elsewhere.

    All occurrences go, judged on what the stage is given; a character cut in two goes as well. A text of nothing else
    becomes empty and its document stays, to be packed as its closing token; a null text becomes an empty one.
    """
    _ready(spark)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), "text")
    cut = repeats.remove_passages(rows, keep=["row"])
    return _counted(cut.select(*((F.col("rest") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns)))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place (``op5``); an empty or null text is one closing token."""
    _ready(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("toxic_documents", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packed_sequences", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again for the next."""
    _ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = tables.written(stage(spark, docs, sf_dir), name)
        tables.settle(spark)
    return docs


# A trained model, signatures and suffix arrays decide: tested stage by stage against brute force instead.
ORACLE_SQL = None
