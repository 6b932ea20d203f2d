"""Sources, routing, sinks and the whole ingest run."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docspark import inputs
from docspark.functions import text as tx
from docspark.inputs import sentences_sql, with_sql
from docspark.operators import catalogue as cat
from docspark.operators import entities, quality
from docspark.plans import query
from docspark.plans.entities import spans_sql
from docspark.plans.text import LANGUAGE_SQL, VALIDATED, content_sql, features_sql, fixed_sql, schema_sql, ttl_sql, word_count_sql
from docspark.session import cut_lineage, scratch_path
from docspark.sources import documents, layout
from docspark.streaming import ingest, jobs, stateful

NS = uuid.NAMESPACE_DNS.hex


def uuid5_sql(name: str) -> str:
    h = f"sha1(unhex('{NS}') || encode({name}))"
    variant = f"to_hex((CAST('0x' || substr({h}, 17, 1) AS BIGINT) & 3) + 8)"
    return (
        f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || lower({variant}) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
    )


# Orders as change events: inserts, deletes, updates, and some without source or payload.
CDC = """cdc AS (
  SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN NULL ELSE
    '{"op":"' || op || '","before":' || CASE WHEN op = 'c' THEN 'null' ELSE rec END || ',"after":' || CASE WHEN op = 'd' THEN 'null' ELSE rec END
    || CASE WHEN o_orderstatus = 'P' THEN '' ELSE ',"source":{"schema":"sales","table":"orders"}' END || '}' END AS payload, op, rec
  FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'd' ELSE 'u' END AS op,
    '{"' || CASE WHEN o_orderstatus = 'F' THEN 'uuid' ELSE 'id' END || '":"' || o_orderkey || '","customer":' || o_custkey || ',"priority":"' || o_orderpriority || '"}' AS rec FROM orders))"""


def changes(spark, sf):
    o = inputs.table(spark, sf, "orders")
    op = F.when(F.col("o_orderkey") % 3 == 0, "c").when(F.col("o_orderkey") % 3 == 1, "d").otherwise("u")
    rec = F.concat(
        F.lit('{"'), F.when(F.col("o_orderstatus") == "F", "uuid").otherwise("id"), F.lit('":"'), F.col("o_orderkey").cast("string"),
        F.lit('","customer":'), F.col("o_custkey").cast("string"), F.lit(',"priority":"'), "o_orderpriority", F.lit('"}'),
    )
    source = F.when(F.col("o_orderstatus") == "P", "").otherwise(',"source":{"schema":"sales","table":"orders"}')
    payload = F.concat(
        F.lit('{"op":"'), op, F.lit('","before":'), F.when(op == "c", "null").otherwise(rec), F.lit(',"after":'),
        F.when(op == "d", "null").otherwise(rec), source, F.lit("}"),
    )
    missing = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")
    return o.select("o_orderkey", F.when(~missing, payload).alias("payload"))


@query(
    "cdc_documents",
    f"""WITH {CDC}, n AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'public' ELSE 'sales' END AS s, CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE 'orders' END AS t FROM cdc)
SELECT o_orderkey, CASE WHEN payload IS NOT NULL THEN {uuid5_sql("s || '.' || t || '.' || o_orderkey")} END AS doc_id, CASE WHEN payload IS NOT NULL THEN 'postgresql://' || s || '/' || t || '/' || o_orderkey END AS source_uri,
  CASE WHEN payload IS NULL THEN NULL WHEN op = 'd' THEN 'DELETED RECORD: ' || rec ELSE rec END AS raw_text, sha256(payload) AS checksum, CASE WHEN payload IS NOT NULL THEN op END AS operation,
  CASE WHEN payload IS NULL THEN 'missing or invalid change payload' END AS error FROM n""",
)
def cdc_documents(spark, sf):
    d = documents.from_changes(changes(spark, sf))
    return d.select("o_orderkey", "doc_id", "source_uri", "raw_text", "checksum", "operation", "error")


@query(
    "route_sources",
    with_sql("envelope", rest=""" SELECT doc_id, CASE WHEN kind NOT IN ('pdf', 'image', 'api', 'stream', 'database') THEN 'unknown_source_type'
  WHEN kind IN ('pdf', 'image') AND size > 52428800 THEN 'file_too_large' END AS error FROM (
    SELECT doc_id, CASE WHEN lang = 'es' AND source_type = 'api' THEN 'fax' ELSE source_type END AS kind, byte_size * 5000 AS size FROM envelope)"""),
)
def route_sources(spark, sf):
    e = inputs.envelope(spark, sf)
    kind = F.when((F.col("lang") == "es") & (F.col("source_type") == "api"), "fax").otherwise(F.col("source_type"))
    return e.select("doc_id", documents.route_error(kind, F.col("byte_size") * 5000).alias("error"))


@query(
    "uri_types",
    with_sql("envelope", rest=r""", x AS (SELECT page_id AS id, url AS uri FROM pages UNION ALL SELECT doc_id + 10000000, source_uri FROM envelope),
e AS (SELECT id, uri, lower(regexp_extract(uri, '\.([^./]+)$', 1)) AS ext, regexp_extract(uri, '[^/\\]*$') AS filename FROM x)
SELECT id, CASE WHEN ext IN ('png', 'jpg', 'jpeg', 'tiff') THEN 'image' ELSE 'pdf' END AS source_type,
  CASE WHEN ext IN ('jpg', 'jpeg') THEN 'image/jpeg' WHEN ext IN ('png', 'tiff') THEN 'image/' || ext ELSE 'application/pdf' END AS mime, filename,
  CASE WHEN lower(regexp_extract(filename, '\.([^.]*)$', 1)) IN ('jpg', 'jpeg') THEN 'jpg' WHEN lower(regexp_extract(filename, '\.([^.]*)$', 1)) IN ('pdf', 'docx', 'png') THEN lower(regexp_extract(filename, '\.([^.]*)$', 1)) ELSE 'pdf' END AS listed FROM e"""),
)
def uri_types(spark, sf):
    p = inputs.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("uri"))
    x = p.unionByName(inputs.envelope(spark, sf).select((F.col("doc_id") + 10000000).alias("id"), F.col("source_uri").alias("uri")))
    u = F.col("uri")
    return x.select("id", documents.source_type_of(u).alias("source_type"), documents.mime_of(u).alias("mime"), cat.filename(u).alias("filename"), cat.listed_type(u).alias("listed"))


@query(
    "upload_gate",
    """SELECT page_id, CASE WHEN kind NOT IN ('text/plain', 'image/png') THEN 'unsupported_mime_type' WHEN size > 52428800 THEN 'file_too_large' END AS error FROM (
  SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'text/plain' WHEN contains(url, '/fr/') THEN 'image/png' ELSE 'text/html' END AS kind, strlen(html) * 30000 AS size FROM pages)""",
)
def upload_gate(spark, sf):
    p = inputs.table(spark, sf, "pages")
    kind = F.when(F.contains("url", F.lit("/en/")), "text/plain").when(F.contains("url", F.lit("/fr/")), "image/png").otherwise("text/html")
    return p.select("page_id", documents.upload_error(kind, F.octet_length("html").cast("long") * 30000).alias("error"))


@query(
    "payload_envelope",
    f"""SELECT {uuid5_sql("url")} AS doc_id, url AS source_uri, html AS raw_text, strlen(html)::BIGINT AS byte_size, sha256(html) AS checksum, 'en' AS language, 'text/html' AS mime_type, 'api' AS source_type FROM pages""",
)
def payload_envelope(spark, sf):
    p = inputs.table(spark, sf, "pages").select(F.col("url").alias("source_uri"), F.col("html").cast("binary").alias("raw_bytes"))
    return documents.from_payloads(p, "api", "text/html")


# Every fifth type of event arrives empty or broken and is skipped.
@query(
    "stream_messages",
    f"""SELECT {uuid5_sql("uri")} AS doc_id, uri AS source_uri, value AS raw_text, sha256(value) AS checksum FROM (
  SELECT 'kafka://raw.' || event_type || '/' || (user_id % 4) || '/' || event_id AS uri, replace(props, ': ', ':') AS value FROM events WHERE event_type NOT IN ('error', 'click'))""",
)
def stream_messages(spark, sf):
    e = inputs.table(spark, sf, "events")
    kind = F.col("event_type")
    body = F.when(kind == "error", "").when(kind == "click", F.concat("props", F.lit("}}"))).otherwise(F.replace("props", F.lit(": "), F.lit(":")))
    m = e.select(body.cast("binary").alias("value"), F.concat(F.lit("raw."), kind).alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"))
    return documents.from_messages(m).select("doc_id", "source_uri", "raw_text", "checksum")


@query(
    "partitioned_roundtrip",
    with_sql("envelope", rest=""" SELECT year(ingestion_ts)::INT AS year, month(ingestion_ts)::INT AS month, day(ingestion_ts)::INT AS day, source_type, count(*) AS documents, sum(byte_size)::BIGINT AS bytes,
  count(*) FILTER (metadata = '{"images": true}') AS with_images FROM envelope GROUP BY ALL"""),
)
def partitioned_roundtrip(spark, sf):
    path = scratch_path(spark, "documents")
    e = inputs.envelope(spark, sf).withColumn("mime_type", F.lit("text/plain")).withColumn("doc_id", F.col("doc_id").cast("string"))
    documents.write_documents(e.select(*documents.DOCUMENT_SCHEMA.fieldNames()), path)
    back = documents.read_documents(spark, path)
    images = F.from_json("metadata", "images boolean")["images"]
    return back.groupBy("year", "month", "day", "source_type").agg(
        F.count("*").alias("documents"), F.sum("byte_size").alias("bytes"), F.count(F.when(images, 1)).alias("with_images")
    )


def letters(spark, sf):
    v = quality.validate(inputs.envelope(spark, sf)).where(F.col("failure_reason").isNotNull())
    return documents.dead_letters(v.select("doc_id", "source_uri", "source_type", "ingestion_ts", "failure_reason"), F.col("ingestion_ts"))


@query(
    "dlq_records",
    with_sql("envelope", rest=f"""{VALIDATED} SELECT doc_id::VARCHAR AS doc_id, source_uri, failure_reason FROM validated WHERE failure_reason IS NOT NULL"""),
)
def dlq_records(spark, sf):
    get = lambda p: F.get_json_object("value", p)
    return letters(spark, sf).select(get("$.document.doc_id").alias("doc_id"), get("$.document.source_uri").alias("source_uri"), get("$.failure_reason").alias("failure_reason"))


@query(
    "dlq_retry_due",
    with_sql("envelope", rest=f"""{VALIDATED} SELECT doc_id::VARCHAR AS doc_id, source_type, failure_reason, epoch(ingestion_ts)::BIGINT + 300 AS retry_at,
  epoch(ingestion_ts)::BIGINT + 300 <= epoch(TIMESTAMP '2024-01-01 06:00:00')::BIGINT AS due FROM validated WHERE failure_reason IS NOT NULL"""),
)
def dlq_retry_due(spark, sf):
    s = documents.retry_schedule(letters(spark, sf), F.lit("2024-01-01 06:00:00").cast("timestamp"))
    return s.select("doc_id", "source_type", "failure_reason", F.unix_seconds("retry_at").alias("retry_at"), "due")


@query(
    "dlq_counts",
    with_sql("envelope", rest=f"""{VALIDATED} SELECT source_type, failure_reason, count(*) AS letters,
  count(*) FILTER (epoch(ingestion_ts)::BIGINT + 300 <= epoch(TIMESTAMP '2024-01-01 06:00:00')::BIGINT) AS due FROM validated WHERE failure_reason IS NOT NULL GROUP BY ALL"""),
)
def dlq_counts(spark, sf):
    return documents.retry_counts(documents.retry_schedule(letters(spark, sf), F.lit("2024-01-01 06:00:00").cast("timestamp")))


@query(
    "processed_events",
    with_sql("envelope", rest=""" SELECT doc_id::VARCHAR AS key, '{"doc_id":"' || doc_id || '","status":"' || CASE WHEN byte_size > 2000 THEN 'completed' ELSE 'failed' END || '","predicted_class":"'
  || CASE WHEN lang = 'en' THEN 'report' ELSE 'unknown' END || '","entities_extracted":' || len(regexp_extract_all(raw_text, '[0-9]+')) || ',"timestamp":' || epoch(ingestion_ts)::BIGINT || '}' AS value FROM envelope"""),
)
def processed_events(spark, sf):
    e = inputs.envelope(spark, sf).select(
        "doc_id", "ingestion_ts", F.when(F.col("byte_size") > 2000, "completed").otherwise("failed").alias("status"),
        F.when(F.col("lang") == "en", "report").alias("predicted_class"),
        F.regexp_count("raw_text", F.lit("[0-9]+")).alias("entities_extracted"),
    )
    return documents.processed_events(e, F.col("ingestion_ts"))


@query(
    "snapshot_versions",
    """WITH b AS (SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source)
SELECT source, CASE WHEN source < 'src15' THEN 'v1.' || (n % 10) || '.' || (chars % 100 + 1) || '-dev' WHEN source < 'src3' THEN 'v1.0.1-dev' ELSE 'v' || n || '-dev' END AS version FROM b""",
)
def snapshot_versions(spark, sf):
    b = inputs.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    tag = F.concat(F.lit("v1."), (F.col("n") % 10).cast("string"), F.lit("."), (F.col("chars") % 100).cast("string"), F.lit("-dev"))
    latest = F.when(F.col("source") < "src15", tag).otherwise("broken")
    wanted = F.when(F.col("source") >= "src3", F.concat(F.lit("v"), F.col("n").cast("string")))
    return b.select("source", documents.next_version(latest, "dev", wanted).alias("version"))


@query(
    "training_rows",
    """WITH p AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations),
t AS (SELECT conv_id, turn, '<s>[INST] ' || text || chr(10) || 'Context: conversation ' || conv_id || ' [/INST] ' || reply || '</s>' AS text FROM p WHERE role = 'user' AND next_role = 'assistant'),
h AS (SELECT *, md5(text || '#42') AS h FROM t)
SELECT CASE WHEN (CAST('0x' || substr(h, 1, 4) AS BIGINT) * 6 + CAST('0x' || substr(h, 5, 4) AS BIGINT) * 6 + CAST('0x' || substr(h, 9, 4) AS BIGINT) * 6 + CAST('0x' || substr(h, 13, 4) AS BIGINT) * 6
  + CAST('0x' || substr(h, 17, 4) AS BIGINT) * 6 + CAST('0x' || substr(h, 21, 4) AS BIGINT) * 6 + CAST('0x' || substr(h, 25, 4) AS BIGINT) * 6 + CAST('0x' || substr(h, 29, 4) AS BIGINT)) % 10 = 0 THEN 'test' ELSE 'train' END AS split, text FROM h""",
)
def training_rows(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = inputs.table(spark, sf, "conversations").withColumns({"reply": F.lead("text").over(w), "next_role": F.lead("role").over(w)})
    rows = c.where((F.col("role") == "user") & (F.col("next_role") == "assistant")).select(
        F.col("text").alias("instruction"), F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("context"), F.col("reply").alias("response")
    )
    path = scratch_path(spark, "training")
    rows.write.json(path)
    return documents.read_training(spark, path)


def spans(spark, sf):
    """Lines of every document as page spans: forty lines to a page, short lines set larger."""
    d = inputs.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line_text"))
    s = d.select("doc_id", "n", F.char_length("line_text").alias("len"), F.posexplode(tx.sentences(F.col("line_text"))).alias("span", "text"))
    y = (F.col("n") % 40) * 12.04
    return s.select(
        F.col("doc_id").alias("doc"), (F.floor(F.col("n") / 40) + 1).cast("int").alias("page"), F.col("n").alias("block"), F.lit(0).alias("line"), "span", "text",
        F.when(F.col("len") < 40, 14.0).when(F.col("len") < 60, 11.0).otherwise(10.0).alias("size"),
        F.when(F.col("len") < 60, 2).otherwise(0).alias("flags"), F.lit(72.0).alias("x0"), y.alias("y0"), F.lit(540.0).alias("x1"), (y + 10).alias("y1"),
    )


@query(
    "span_headings",
    f"""WITH ln AS (SELECT doc_id, unnest(l) AS line_text, generate_subscripts(l, 1) - 1 AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
sp AS (SELECT doc_id AS doc, n, n // 40 + 1 AS page, length(line_text) AS len, unnest(s) AS text, generate_subscripts(s, 1) - 1 AS span FROM (SELECT *, {sentences_sql("line_text")} AS s FROM ln)),
sz AS (SELECT *, CASE WHEN len < 40 THEN 14.0 WHEN len < 60 THEN 11.0 ELSE 10.0 END AS size FROM sp),
freq AS (SELECT doc, size, sum(length(text)) AS chars, min((page, n, span)) AS seen FROM sz GROUP BY ALL),
base AS (SELECT doc, arg_min(size, seen) AS base FROM (SELECT *, max(chars) OVER (PARTITION BY doc) AS m FROM freq) WHERE chars = m GROUP BY doc),
hd AS (SELECT sz.*, size >= base * 1.25 OR (size > base AND len < 60) AS heading FROM sz JOIN base USING (doc)),
bl AS (SELECT doc, page, n, string_agg(CASE WHEN heading THEN chr(10) || '## ' || text || chr(10) ELSE text END, ' ' ORDER BY span) AS t, count(*) FILTER (heading) AS h FROM hd GROUP BY ALL)
SELECT doc, page, sum(h)::BIGINT AS headings, '--- PAGE ' || page || ' ---' || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY n) AS page_text FROM bl GROUP BY doc, page""",
)
def span_headings(spark, sf):
    return layout.page_texts(spans(spark, sf)).select("doc", "page", "headings", "page_text")


@query(
    "table_markdown",
    """WITH c AS (SELECT l_orderkey AS doc, l_linenumber AS r, '| ' || l_returnflag || ' | ' || l_linestatus || ' | ' || coalesce(l_quantity::INT::VARCHAR, '') || ' |' AS md,
    l_returnflag || '|' || l_linestatus || '|' || l_quantity::INT AS names, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY r, l_partkey, l_suppkey, l_extendedprice) AS n, count(*) OVER (PARTITION BY doc) AS k FROM c)
SELECT doc, k AS row_count, 3 AS col_count, max(names) FILTER (n = 1) AS headers, string_agg(CASE WHEN n = 1 AND k > 1 THEN md || chr(10) || '| --- | --- | --- |' ELSE md END, chr(10) ORDER BY n) AS markdown FROM o GROUP BY doc, k""",
)
def table_markdown(spark, sf):
    from pyspark.sql import Window

    li = inputs.table(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = li.select("l_orderkey", F.row_number().over(w).alias("row"), "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").cast("string").alias("q"))
    cells = rows.select(
        F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), F.lit(0).alias("table"), "row",
        F.posexplode(F.array("l_returnflag", "l_linestatus", "q")).alias("col", "text"),
    )
    return layout.tables_markdown(cells).select("doc", "row_count", "col_count", "headers", "markdown")


# The gate in order and what every sink must hold of it. Copies are submitted under one address per language.
GATED = f""",
lang_of AS (SELECT doc_id, lang AS detected, p AS prob FROM probs WHERE rn = 1),
submitted AS (SELECT * REPLACE ('s3://raw/' || lang AS source_uri) FROM envelope),
schema_checked AS (SELECT *, CASE{schema_sql()} END AS schema_reason, sha256(source_uri || ':' || checksum) AS k FROM submitted),
owners AS (SELECT k, arg_min(doc_id, (ingestion_ts, doc_id)) AS owner FROM schema_checked WHERE schema_reason IS NULL GROUP BY k),
content AS (SELECT doc_id, CASE{content_sql()} END AS content_reason FROM envelope),
gated AS (
  SELECT s.*, detected, prob, CASE WHEN schema_reason IS NULL AND owner <> s.doc_id THEN owner END AS existing,
    coalesce(schema_reason, CASE WHEN owner <> s.doc_id THEN 'duplicate_document' END,
      CASE WHEN detected NOT IN ('en','fr','de','es','hi','zh') THEN 'detected_language_not_allowed' END, content_reason) AS reason
  FROM schema_checked s LEFT JOIN owners o ON o.k = s.k LEFT JOIN lang_of USING (doc_id) JOIN content USING (doc_id)),
chunked AS (SELECT doc_id, count(*) AS n, sum({word_count_sql("text")})::BIGINT AS tokens FROM chunks GROUP BY doc_id),
tagged AS (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id),
done AS (
  SELECT g.doc_id, epoch(g.ingestion_ts)::BIGINT AS stamp, detected, prob, c.n AS chunks, c.tokens, coalesce(t.n, 0) AS entities, doc_type_signal
  FROM gated g LEFT JOIN chunked c USING (doc_id) LEFT JOIN tagged t USING (doc_id) JOIN feats USING (doc_id) WHERE reason IS NULL)
SELECT 'documents' AS sink, doc_id::VARCHAR AS doc_id, detected || ':' || (prob < 0.85) AS detail FROM done
UNION ALL SELECT 'keys', doc_id::VARCHAR, k FROM gated WHERE schema_reason IS NULL AND existing IS NULL
UNION ALL SELECT 'duplicates', doc_id::VARCHAR, existing::VARCHAR FROM gated WHERE reason = 'duplicate_document'
UNION ALL SELECT 'features', doc_id::VARCHAR, doc_type_signal FROM done
UNION ALL SELECT 'chunks', doc_id::VARCHAR, chunks || ':' || tokens FROM done WHERE chunks IS NOT NULL
UNION ALL SELECT 'vectors', doc_id::VARCHAR, (chunks * 64)::VARCHAR FROM done WHERE chunks IS NOT NULL
UNION ALL SELECT 'catalogue', doc_id::VARCHAR, CASE WHEN chunks IS NULL THEN 'failed:0 chunks' ELSE 'completed' END FROM done
UNION ALL SELECT 'catalogue', doc_id::VARCHAR, 'failed:' || reason FROM gated WHERE reason <> 'duplicate_document'
UNION ALL SELECT 'letters', doc_id::VARCHAR, reason FROM gated WHERE reason <> 'duplicate_document'
UNION ALL SELECT 'letters', doc_id::VARCHAR, '0 chunks' FROM done WHERE chunks IS NULL
UNION ALL SELECT 'events', doc_id::VARCHAR, '{{"doc_id":"' || doc_id || '","status":"completed","predicted_class":"' || doc_type_signal || '","entities_extracted":' || entities || ',"timestamp":' || stamp || '}}'
  FROM done WHERE chunks IS NOT NULL"""
INGESTED = (
    fixed_sql(512, 64) + f""",
{LANGUAGE_SQL.rstrip()},
{inputs.SQL["envelope"].strip()}""" + features_sql() + spans_sql("documents", entities.ENTITY_PATTERNS) + GATED
)


def submissions(spark, sf, docs=None):
    return inputs.envelope(spark, sf, docs).withColumn("source_uri", F.concat(F.lit("s3://raw/"), "lang")).drop("lang", "source")


@query("ingest_run", INGESTED)
def ingest_run(spark, sf):
    """One batch through the gate into all its sinks, and again: the second time adds nothing."""
    model = cut_lineage(quality.train_language_model(inputs.table(spark, sf, "documents")))
    root = scratch_path(spark, "ingest")
    for _ in range(2):
        ingest.ingest_batch(submissions(spark, sf), root, 0, model)
    return ingest.records(spark, root)


@query("stream_ingest", INGESTED)
def stream_ingest(spark, sf):
    """The same from a stream, whose batches find the keys of those before them."""
    model = cut_lineage(quality.train_language_model(inputs.table(spark, sf, "documents")))
    root = scratch_path(spark, "ingest")
    docs = submissions(spark, sf, jobs.file_source(spark, sf, "documents"))
    ingest.ingest_stream(docs, root, f"{root}/checkpoint", model).awaitTermination()
    return ingest.records(spark, root)


@query("stream_archive", """SELECT 'kafka://raw.' || event_type || '/' || (user_id % 4) || '/' || event_id AS uri, replace(props, ': ', ':') AS payload FROM events""")
def stream_archive(spark, sf):
    e = jobs.file_source(spark, sf, "events")
    m = e.select(F.col("props").cast("binary").alias("value"), F.concat(F.lit("raw."), "event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"))
    root = scratch_path(spark, "archive")
    jobs.archive(m, root, f"{root}/checkpoint").awaitTermination()
    return jobs.read_batches(spark, f"{root}/raw", "uri string, payload string", "json")


# Copies of a text arrive hours or days apart; its key lives six hours.
SIX_HOURS = 21_600


@query(
    "stream_dedup",
    with_sql("envelope", rest=ttl_sql("SELECT CASE WHEN doc_id % 19 > 0 THEN sha256(raw_text) END AS k, epoch(ingestion_ts)::BIGINT AS t, doc_id AS id FROM envelope", SIX_HOURS), recursive=True),
)
def stream_dedup(spark, sf):
    docs = inputs.envelope(spark, sf, jobs.file_source(spark, sf, "documents"))
    rows = docs.select("doc_id", "ingestion_ts", F.when(F.col("doc_id") % 19 > 0, F.sha2("raw_text", 256)).alias("text_key"))
    out = jobs.run(stateful.dedup(rows, "text_key", "ingestion_ts", "doc_id", SIX_HOURS * 1_000_000, buckets=stateful.BUCKETS), "dedup")
    return out.select(F.col("doc_id").alias("id"), "is_duplicate", "existing_id")
