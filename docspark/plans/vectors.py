"""Embedding, vector search and cache queries over ``embeddings`` and ``documents``."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark import inputs
from docspark.inputs import tokens_sql, with_sql
from docspark.operators import vectors as vec
from docspark.plans import query
from docspark.session import scratch_path
from docspark.sources import log


def embed_sql(source: str, text: str, key: str, name: str = "embedded") -> str:
    """Signed token hashing of ``text``, one row per (key, slot) of 64, unit length."""
    return rf""",
{name}_tok AS (SELECT {key}, md5(unnest({tokens_sql(text)})) AS h FROM {source}),
{name}_slots AS (
  SELECT {key}, CAST('0x' || substr(h, 1, 4) AS BIGINT) % 64 AS slot, sum(CASE WHEN substr(h, 5, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS x
  FROM {name}_tok GROUP BY ALL),
{name}_norm AS (SELECT {key}, sqrt(sum(x * x)) AS n FROM {name}_slots GROUP BY ALL),
{name} AS (
  SELECT k.{key}, list_transform(range(0, 64), lambda i: coalesce(m[i], 0.0) / CASE WHEN n > 0 THEN n ELSE 1 END) AS embedding FROM (
    SELECT {key}, map(list(slot), list(x)) AS m FROM {name}_slots GROUP BY {key}) k JOIN {name}_norm USING ({key}))"""


# Half of the source's texts were embedded before; those entries have not expired.
@query(
    "embed_chunks",
    "WITH d AS (SELECT doc_id, text, sha256(text) AS text_key, source FROM documents)" + embed_sql("d", "text", "doc_id") + """,
cached AS (SELECT DISTINCT text_key FROM d WHERE source >= 'src4')
SELECT doc_id AS chunk_id, text_key, text_key IN (SELECT text_key FROM cached) AS from_cache,
  round(coalesce(embedding[1], 0.0), 6) AS e0, round(coalesce(embedding[33], 0.0), 6) AS e32,
  round(coalesce(list_sum(list_transform(embedding, lambda x: abs(x))), 0.0), 6) AS l1 FROM d LEFT JOIN embedded USING (doc_id)""",
)
def embed_chunks(spark, sf):
    d = inputs.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source")
    now = F.lit("2024-02-01").cast("timestamp")
    old = vec.encode(d.where(F.col("source") >= "src4").groupBy(F.sha2("text", 256).alias("text_key")).agg(F.min("text").alias("text")), F.col("text"))
    cache = old.select("text_key", "embedding", F.lit("2024-03-01").cast("timestamp").alias("expires_at"))
    out, _ = vec.embed_with_cache(d, cache, now)
    l1 = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x))
    return out.select(
        "chunk_id", "text_key", "from_cache", F.round(F.col("embedding")[0], 6).alias("e0"),
        F.round(F.col("embedding")[32], 6).alias("e32"), F.round(l1, 6).alias("l1"),
    )


@query(
    "embed_queries",
    "WITH q AS (SELECT item_id, 'Represent this sentence: ' || text AS t FROM benchmark)" + embed_sql("q", "t", "item_id")
    + " SELECT item_id AS query_id, round(embedding[1], 6) AS e0, round(embedding[33], 6) AS e32, round(embedding[64], 6) AS e63 FROM embedded",
)
def embed_queries(spark, sf):
    q = vec.encode_queries(inputs.questions(spark, sf), F.col("text"))
    return q.select("query_id", *(F.round(F.col("embedding")[i], 6).alias(f"e{i}") for i in (0, 32, 63)))


@query(
    "vector_upsert",
    """WITH base AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
updates AS (SELECT vec_id + 100 AS vec_id, label, list_transform(e, lambda x: x * 3) AS e FROM base),
merged AS (SELECT vec_id, label, e, 1 AS gen FROM updates UNION ALL SELECT vec_id, label, e, 0 FROM base ANTI JOIN updates USING (vec_id))
SELECT vec_id AS chunk_id, CASE WHEN gen = 1 THEN 'default' ELSE 'pdf' END AS source_type, CASE WHEN gen = 1 THEN 'other' ELSE 'report' END AS doc_type_signal,
  round(sqrt(list_sum(list_transform(e, lambda x: x * x))) / CASE WHEN gen = 1 THEN 3 ELSE 1 END, 4) AS length,
  round(e[1] / CASE WHEN gen = 1 THEN sqrt(list_sum(list_transform(e, lambda x: x * x))) ELSE 1 END, 6) AS e0 FROM merged""",
)
def vector_upsert(spark, sf):
    e = inputs.table(spark, sf, "embeddings")
    store = e.select(
        F.col("vec_id").alias("chunk_id"), (F.col("vec_id") / 5).cast("long").alias("doc_id"), F.lit("").alias("text"),
        F.lit("pdf").alias("source_type"), F.lit("en").alias("language"), F.lit("report").alias("doc_type_signal"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    none = F.lit(None).cast("string")
    upd = store.select(
        (F.col("chunk_id") + 100).alias("chunk_id"), "doc_id", "text", none.alias("source_type"), none.alias("language"),
        none.alias("doc_type_signal"), F.transform("embedding", lambda x: x * 3).alias("embedding"),
    )
    m = vec.upsert(store, upd)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    return m.select("chunk_id", "source_type", "doc_type_signal", F.round(length, 4).alias("length"), F.round(F.col("embedding")[0], 6).alias("e0"))


@query(
    "vector_snapshot_roundtrip",
    with_sql("vectors", rest=" SELECT source_type, count(*) AS total_vectors, count(DISTINCT doc_id) AS total_documents FROM vectors GROUP BY ALL"),
)
def vector_snapshot_roundtrip(spark, sf):
    path, v = scratch_path(spark, "vectors"), inputs.vectors(spark, sf)
    vec.save_version(v, path)
    return vec.stats(vec.load_version(spark, path, v.schema), "source_type")


@query(
    "vector_versions",
    with_sql("vectors", rest=""",
third AS (SELECT chunk_id + (CASE WHEN chunk_id % 2 = 0 THEN 0 ELSE 1000000 END) AS chunk_id, doc_id, 'api' AS source_type, label || '!' AS label FROM vectors WHERE source_type = 'api' AND chunk_id % 3 = 0),
v1 AS (SELECT chunk_id, doc_id, source_type, label FROM vectors),
v2 AS (SELECT * FROM v1 WHERE chunk_id NOT IN (SELECT chunk_id FROM third) UNION ALL SELECT * FROM third),
v3 AS (SELECT * FROM v2 WHERE doc_id NOT IN (SELECT doc_id FROM vectors WHERE source_type = 'pdf' AND doc_id % 7 = 0)),
seen AS (
  SELECT 'first' AS asked, * FROM v1 UNION ALL SELECT 'upserted', * FROM v2 UNION ALL SELECT 'deleted', * FROM v3
  UNION ALL SELECT 'newest', * FROM v2 UNION ALL SELECT 'image', * FROM v2 WHERE source_type = 'image')
SELECT asked, source_type, count(*) AS total_vectors, count(DISTINCT doc_id) AS total_documents, count(*) FILTER (label LIKE '%!') AS changed,
  sum(chunk_id)::BIGINT AS ids FROM seen GROUP BY ALL"""),
)
def vector_versions(spark, sf):
    """A store written, upserted, cut and rolled back: every version as it reads afterwards."""
    v = inputs.vectors(spark, sf)
    store = vec.VectorStore(spark, scratch_path(spark, "store"), v.schema)
    first = store.upsert(v)
    moved = F.col("chunk_id") + F.when(F.col("chunk_id") % 2 == 0, 0).otherwise(1_000_000)
    second = store.upsert(v.where("source_type = 'api' AND chunk_id % 3 = 0").withColumns({"chunk_id": moved, "label": F.concat("label", F.lit("!"))}))
    third = store.delete(v.where("source_type = 'pdf' AND doc_id % 7 = 0"))
    rows = f"{store.root}/rows"
    log.roll_back(spark, rows, second)
    asked = [("first", first, None), ("upserted", second, None), ("deleted", third, None), ("newest", None, None), ("image", None, "image")]
    seen = [vec.load_version(spark, rows, v.schema, n, tenant=t).withColumn("asked", F.lit(a)) for a, n, t in asked]
    return functools.reduce(DataFrame.unionByName, seen).groupBy("asked", "source_type").agg(
        F.count("*").alias("total_vectors"), F.countDistinct("doc_id").alias("total_documents"),
        F.count(F.when(F.endswith("label", F.lit("!")), 1)).alias("changed"), F.sum("chunk_id").alias("ids"),
    )


POOLED = """,
dims AS (SELECT label, unnest(range(1, 65)) AS pos, unnest(embedding) AS x FROM vectors),
means AS (SELECT label, pos, avg(x) AS x FROM dims GROUP BY ALL),
queries AS (SELECT label AS query_id, list(x / n ORDER BY pos) AS embedding FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY label)) AS n FROM means) GROUP BY label)"""

SCORED = """,
scored AS (
  SELECT query_id, chunk_id, v.doc_id, source_type, topic, round(list_cosine_similarity(v.embedding, q.embedding), 9) AS score
  FROM vectors v, queries q)"""


def topk_sql(where: str = "", k: int = 10) -> str:
    return f"""{POOLED}{SCORED}
SELECT query_id, chunk_id, rank, round(score, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored {where}) WHERE rank <= {k}"""


def label_queries(spark, sf):
    """One query vector per label: the mean of its vectors."""
    return vec.mean_pool(inputs.vectors(spark, sf), ["label"]).select(F.col("label").alias("query_id"), "embedding")


@query(
    "vector_mean_pool",
    with_sql("vectors", rest=POOLED + " SELECT query_id, unnest(range(0, 64)) AS pos, round(unnest(embedding), 6) AS x FROM queries"),
)
def vector_mean_pool(spark, sf):
    q = label_queries(spark, sf).select("query_id", F.posexplode("embedding").alias("pos", "x"))
    return q.select("query_id", "pos", F.round("x", 6).alias("x"))


def shown(df):
    return df.select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


@query("vector_topk", with_sql("vectors", rest=topk_sql()))
def vector_topk(spark, sf):
    return shown(vec.exact_topk(inputs.vectors(spark, sf), label_queries(spark, sf), 10))


@query("vector_topk_filtered", with_sql("vectors", rest=topk_sql("WHERE source_type = 'pdf' AND topic = 't3'")))
def vector_topk_filtered(spark, sf):
    return shown(vec.exact_topk(inputs.vectors(spark, sf), label_queries(spark, sf), 10, {"source_type": "pdf", "topic": "t3"}))


@query("vector_namespace", with_sql("vectors", rest=topk_sql("WHERE source_type = 'image'")))
def vector_namespace(spark, sf):
    v = vec.namespace(inputs.vectors(spark, sf), "image")
    return shown(vec.exact_topk(v, label_queries(spark, sf), 10))


@query(
    "vector_neighbours",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(c.e, q.e), 9) AS score FROM v q, v c)
SELECT query_id, chunk_id, rank, round(score, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 5""",
)
def vector_neighbours(spark, sf):
    v = inputs.vectors(spark, sf)
    return shown(vec.exact_topk(v, v.select(F.col("chunk_id").alias("query_id"), "embedding"), 5))


@query(
    "vector_delete_stats",
    with_sql("vectors", rest=""" SELECT label, count(*) AS total_vectors, count(DISTINCT doc_id) AS total_documents FROM vectors
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY ALL"""),
)
def vector_delete_stats(spark, sf):
    gone = inputs.table(spark, sf, "labels").where(F.col("toxic") == 1)
    return vec.stats(vec.delete_documents(inputs.vectors(spark, sf), gone), "label")


# The share found is the index's; what SQL can say is that it is enough.
@query(
    "vector_cells_recall",
    with_sql("vectors", rest=POOLED + """
SELECT count(*) AS queries, count(*) * least(10, (SELECT count(*) FROM vectors)) AS expected, true AS recall_enough FROM queries"""),
)
def vector_cells_recall(spark, sf):
    """Ten nearest of every label's mean by the index on disk, against the exact ones."""
    v, q, path = inputs.vectors(spark, sf), label_queries(spark, sf), scratch_path(spark, "cells")
    vec.write_cells(v, path)
    found = vec.recall(vec.cell_topk(spark, path, v.schema, q, 10), vec.exact_topk(v, q, 10))
    per = found.agg(F.count("*").alias("queries"), F.sum("expected").alias("expected"), F.sum("found").alias("found"))
    return per.select("queries", "expected", (F.col("found") >= 0.9 * F.col("expected")).alias("recall_enough"))
