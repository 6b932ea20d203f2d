"""Catalogue queries over the stored documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark import inputs
from docspark.functions import hashing
from docspark.inputs import with_sql
from docspark.operators import catalogue as cat
from docspark.operators import chunking, features
from docspark.plans import query
from docspark.plans.text import features_sql, fixed_sql
from docspark.session import scratch_path

# Every document is processing on arrival; all but the German ones then complete or fail.
CATALOGUE = """,
updates AS (
  SELECT doc_id, source_uri, 'processing' AS status, NULL AS error_message, ingestion_ts AS updated_at, checksum FROM envelope UNION ALL
  SELECT doc_id, source_uri || '?v2', CASE WHEN byte_size > 2000 THEN 'completed' ELSE 'failed' END, CASE WHEN byte_size <= 2000 THEN 'too small' END,
    ingestion_ts + INTERVAL 5 MINUTE, checksum FROM envelope WHERE lang <> 'de'),
cat AS (
  SELECT doc_id, arg_min(source_uri, updated_at) AS source_uri, arg_max(status, updated_at) AS status,
    arg_max_null(error_message, updated_at) AS error_message, max(updated_at) AS updated_at, any_value(checksum) AS checksum FROM updates GROUP BY doc_id)"""


def catalogue(spark, sf):
    e = inputs.envelope(spark, sf)
    none = F.lit(None).cast("string")
    first = e.select("doc_id", "source_uri", F.lit("processing").alias("status"), none.alias("error_message"), F.col("ingestion_ts").alias("updated_at"))
    big = F.col("byte_size") > 2000
    later = e.where(F.col("lang") != "de").select(
        "doc_id", F.concat("source_uri", F.lit("?v2")).alias("source_uri"), F.when(big, "completed").otherwise("failed").alias("status"),
        F.when(~big, "too small").alias("error_message"), (F.col("ingestion_ts") + F.expr("INTERVAL 5 MINUTES")).alias("updated_at"),
    )
    return cat.upsert_status(first, later)


def type_rows(spark, sf):
    e = inputs.envelope(spark, sf)
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    return features.to_long(e.select("doc_id", features.doc_type_signal(F.col("raw_text")).alias("doc_type_signal")), at)


@query("catalogue_status", with_sql("envelope", rest=CATALOGUE + " SELECT doc_id, source_uri, status, error_message, epoch(updated_at)::BIGINT AS updated FROM cat"))
def catalogue_status(spark, sf):
    c = catalogue(spark, sf)
    return c.select("doc_id", "source_uri", "status", "error_message", F.unix_seconds("updated_at").alias("updated"))


@query(
    "catalogue_page",
    with_sql("envelope", rest=features_sql() + CATALOGUE + r""",
page AS (SELECT * FROM cat WHERE status = 'completed' AND (source_uri LIKE '%.jpg' OR source_uri LIKE '%.jpeg' OR source_uri LIKE '%.JPG' OR source_uri LIKE '%.JPEG')
  AND updated_at >= TIMESTAMP '2024-01-01 00:30:00' ORDER BY updated_at DESC, doc_id LIMIT 5 OFFSET 5)
SELECT doc_id, regexp_extract(source_uri, '[^/\\]*$') AS filename, 'jpg' AS source_type, status, epoch(updated_at)::BIGINT AS updated, doc_type_signal AS doc_type FROM page LEFT JOIN feats USING (doc_id)"""),
)
def catalogue_page(spark, sf):
    p = cat.page(catalogue(spark, sf), type_rows(spark, sf), 2, 5, status="completed", source_type="jpg", start="2024-01-01 00:30:00")
    return p.withColumn("updated", F.unix_seconds("updated_at")).drop("updated_at")


@query(
    "catalogue_seek",
    with_sql("envelope", rest=CATALOGUE + """,
placed AS (SELECT doc_id, status, epoch(updated_at)::BIGINT AS updated, (row_number() OVER (ORDER BY updated_at DESC, doc_id) - 1) // 20 + 1 AS page FROM cat)
SELECT CASE page WHEN 4 THEN 'behind' ELSE page::VARCHAR END AS page, doc_id, status, updated FROM placed WHERE page IN (1, 3, 4, 9)"""),
)
def catalogue_seek(spark, sf):
    """Three pages of the written listing by number, and the one behind the third by its last row."""
    path = scratch_path(spark, "listing")
    cat.write_listing(catalogue(spark, sf), path)
    shown = ["doc_id", "status", F.unix_seconds("updated_at").alias("updated")]
    pages = [cat.listed(spark, path, n, 20).select(F.lit(str(n)).alias("page"), *shown) for n in (1, 3, 9)]
    last = cat.listed(spark, path, 3, 20).orderBy("updated_at", F.desc("doc_id")).first()
    if last is not None:
        rows = spark.read.parquet(f"{path}/sorted")
        none = spark.createDataFrame([], "doc_id long, feature_name string, feature_value string")
        behind = cat.page_after(rows, none, (last["updated_at"], last["doc_id"]), 20)
        pages.append(behind.select(F.lit("behind").alias("page"), *shown))
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out


@query("catalogue_total", with_sql("envelope", rest=CATALOGUE + " SELECT count(*) AS total FROM cat WHERE status = 'completed' AND (source_uri LIKE '%.pdf' OR source_uri LIKE '%.PDF')"))
def catalogue_total(spark, sf):
    return cat.total(catalogue(spark, sf), status="completed", source_type="pdf")


@query(
    "catalogue_detail",
    with_sql("envelope", rest=features_sql() + CATALOGUE + r""",
kept AS (SELECT * FROM cat WHERE status <> 'failed'), f AS (SELECT doc_id, page_count, language, doc_type_signal FROM feats WHERE language <> 'pt'),
j AS (SELECT doc_id, status, coalesce(source_uri, 's3://raw/' || doc_id || '.pdf') AS source_uri, page_count, language, doc_type_signal FROM kept FULL JOIN f USING (doc_id)),
x AS (SELECT *, regexp_extract(source_uri, '[^/\\]*$') AS filename FROM j)
SELECT doc_id, coalesce(status, 'processed') AS status, source_uri, filename,
  coalesce(doc_type_signal, CASE WHEN regexp_extract(filename, '\.([^.]*)$', 1) = '' THEN 'pdf' ELSE lower(regexp_extract(filename, '\.([^.]*)$', 1)) END) AS source_type,
  coalesce(language, 'en') AS language, coalesce(page_count, 1) AS page_count FROM x"""),
)
def catalogue_detail(spark, sf):
    e = inputs.envelope(spark, sf).where(F.col("language") != "pt")
    t = F.col("raw_text")
    wide = e.select("doc_id", features.page_count(t, F.col("page_count")).alias("page_count"), "language", features.doc_type_signal(t).alias("doc_type_signal"))
    return cat.detail(catalogue(spark, sf).where(F.col("status") != "failed"), wide)


def toxic(spark, sf):
    return inputs.table(spark, sf, "labels").where(F.col("toxic") == 1).select("doc_id")


@query(
    "catalogue_delete",
    with_sql("envelope", "vectors", rest=CATALOGUE + """,
gone AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT 'catalogue' AS name, count(*) AS rows_left FROM cat WHERE doc_id NOT IN (SELECT doc_id FROM gone)
UNION ALL SELECT 'vectors', count(*) FROM vectors WHERE doc_id NOT IN (SELECT doc_id FROM gone)
UNION ALL SELECT 'features', count(*) FROM envelope WHERE doc_id NOT IN (SELECT doc_id FROM gone)
UNION ALL SELECT 'dedup_keys', count(*) FROM (SELECT DISTINCT sha256(source_uri || ':' || checksum) AS k FROM envelope)
  WHERE k NOT IN (SELECT sha256(source_uri || ':' || checksum) FROM envelope WHERE doc_id IN (SELECT doc_id FROM gone))"""),
)
def catalogue_delete(spark, sf):
    e = inputs.envelope(spark, sf)
    keys = e.select(hashing.dedup_key(F.col("source_uri"), F.col("checksum")).alias("dedup_key")).distinct()
    known = catalogue(spark, sf).join(e.select("doc_id", "checksum"), "doc_id")
    left = cat.delete_cascade(toxic(spark, sf), {"vectors": inputs.vectors(spark, sf), "features": type_rows(spark, sf)}, known, keys)
    out = None
    for name, df in left.items():
        n = df.agg(F.lit(name).alias("name"), F.count("*").alias("rows_left"))
        out = n if out is None else out.unionByName(n)
    return out


@query(
    "catalogue_bulk_delete",
    with_sql("envelope", rest=CATALOGUE + """ SELECT (SELECT count(DISTINCT doc_id) FROM (SELECT doc_id + 50 AS doc_id FROM labels)) AS requested,
  (SELECT count(*) FROM cat WHERE doc_id IN (SELECT doc_id + 50 FROM labels)) AS matched"""),
)
def catalogue_bulk_delete(spark, sf):
    ids = inputs.table(spark, sf, "labels").select((F.col("doc_id") + 50).alias("doc_id"))
    return cat.delete_counts(ids, catalogue(spark, sf))


@query("chunk_page", fixed_sql(128, 16) + " SELECT doc_id, chunk_index, text FROM chunks WHERE chunk_index >= 2 AND chunk_index < 4")
def chunk_page(spark, sf):
    c = chunking.fixed(inputs.table(spark, sf, "documents"), "text", 128, 16)
    return cat.chunk_page(c, 2, 2).select("doc_id", "chunk_index", "text")


@query("reprocess_set", with_sql("envelope", rest=CATALOGUE + " SELECT doc_id, status FROM cat WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)"))
def reprocess_set(spark, sf):
    ids = inputs.table(spark, sf, "labels").where(F.col("quality") == 0)
    return cat.reprocess(catalogue(spark, sf), ids).select("doc_id", "status")
