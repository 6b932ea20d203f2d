"""The registered queries of the numbered operators, each over its whole table, with SQL where it can say it."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark import session
from docspark.llm import collision_search, context_trees, licenses, line_quality, minhash, packing, piece_encoding, prefix_trie, repeats, sharding, tables, token_counts, toxicity, turn_repair

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def query(name: str, sql: str | None = None):
    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            session.prepare(spark)
            tables.prepare(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_line_quality", line_quality.SQL)
def op1_line_quality(spark: SparkSession, sf: str) -> DataFrame:
    return line_quality.line_quality(table(spark, sf, "documents")).drop("removed_lines")


@query("op2_rendezvous_shards", sharding.SQL)
def op2_rendezvous_shards(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shards(table(spark, sf, "documents"), [1.0] * 8)


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf, "documents"), public_tokenizers.path(BYTE_BPE))


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path(BYTE_BPE))


@query("op9_minhash_near_dedup")
def op9_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"))


@query("op6_suffix_array_dedup")
def op6_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """By strings of 400 bytes; then, for passages of over 50 words as well, the words and bytes that would go."""
    return repeats.remove_passages(table(spark, sf, "documents"), rest=False)


@query("op10_fm_toxicity")
def op10_fm_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf, "labels")))


@query("op8_collision_search")
def op8_collision_search(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return collision_search.nearest(vectors, vectors.where("vec_id % 50 = 0"))


@query("op7_piece_encoding")
def op7_piece_encoding(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every text, their digest, and whether decoding gives the text back."""
    path = public_tokenizers.path(PIECE_BPE)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    ids = piece_encoding.encode(docs, path, keep=["doc_id", "text"])
    back = piece_encoding.decode(ids.select("doc_id", F.col("text").alias("was"), "ids", F.col("ids").alias("kept")), path)
    return back.select(
        "doc_id", F.size("kept").cast("long").alias("n_tokens"), F.sha2(F.array_join("kept", ",").cast("binary"), 256).alias("ids_sha256"),
        (F.col("text") == F.translate(F.coalesce("was", F.lit("")), "▁", " ")).alias("round_trip"),
    )


@query("op4_license_scan", licenses.SQL)
def op4_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = licenses.licenses(licenses.filed(table(spark, sf, "documents")), keep=["doc_id"])
    return found.withColumn("own_score", F.round("own_score", 6))


@query("op11_turn_repair", turn_repair.SQL)
def op11_turn_repair(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return turn_repair.repair_digests(turn_repair.damaged(turns), turns)


@query("op13_prefix_trie", prefix_trie.SQL)
def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf, "conversations"))


@query("op12_context_trees")
def op12_context_trees(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return context_trees.languages(docs, context_trees.grow(docs))
