"""Views the queries share, derived from the test tables over all their rows.

Each has an SQL twin in ``SQL`` so both engines start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import text as tx
from docspark.functions.bind import let

WORDS_SQL = r"list_filter(regexp_split_to_array({t}, '[\t-\r\x1c-\x1f\x{{85}}\p{{Z}}]+'), lambda w: w <> '')"
WS_SQL = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"


def words_sql(t: str) -> str:
    return WORDS_SQL.format(t=t)


def strip_sql(t: str) -> str:
    return f"regexp_replace({t}, '^{WS_SQL}+|{WS_SQL}+$', '', 'g')"


def sentences_sql(t: str) -> str:
    return (
        f"list_filter(string_split(regexp_replace({strip_sql(t)}, '([.!?]){WS_SQL}+', '\\1' || chr(31), 'g'), chr(31)), "
        "lambda s: s <> '')"
    )


def tokens_sql(t: str) -> str:
    return rf"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}]+')"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def envelope(spark: SparkSession, sf: str, docs: DataFrame | None = None) -> DataFrame:
    """Documents in the stored form. Some checksums and languages are off so gates have work."""
    d = table(spark, sf, "documents") if docs is None else docs
    i = F.col("doc_id")
    kinds = F.array(*(F.lit(s) for s in ("pdf", "image", "api", "stream", "database")))
    exts = F.array(*(F.lit(s) for s in (".pdf", ".jpg", ".docx", ".json", "")))
    return d.select(
        "doc_id",
        F.timestamp_seconds(F.lit(1704067200) + i * 60).alias("ingestion_ts"),
        F.get(kinds, (i % 5).cast("int")).alias("source_type"),
        F.concat(F.lit("s3://raw/"), "source", F.lit("/"), i.cast("string"), F.get(exts, (i % 5).cast("int"))).alias("source_uri"),
        F.col("text").alias("raw_text"),
        F.col("text").cast("binary").alias("raw_bytes"),
        F.octet_length("text").cast("long").alias("byte_size"),
        F.sha2(F.when(i % 97 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("checksum"),
        F.when(i % 53 == 0, "pt").otherwise(F.col("lang")).alias("language"),
        F.when(i % 5 == 0, (i % 7).cast("int")).alias("page_count"),
        F.when(i % 11 == 0, '{"images": true}').when(i % 13 == 0, '{"has_image": false}').otherwise("{}").alias("metadata"),
        "source",
        "lang",
    )


def passages(spark: SparkSession, sf: str) -> DataFrame:
    """Every non-blank line of every document: (chunk_id, doc_id, line, text, source_uri)."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return d.where(~tx.is_blank(F.col("text"))).select(
        (F.col("doc_id") * 100000 + F.col("line")).alias("chunk_id"), "doc_id", "line", "text",
        F.concat(F.lit("s3://raw/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("source_uri"),
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def binders(spark: SparkSession, sf: str) -> DataFrame:
    """Eight neighbouring documents bound as pages under a shared header line."""
    d = table(spark, sf, "documents").select((F.col("doc_id") / 8).cast("long").alias("binder"), "doc_id", "text")
    page = F.struct("doc_id", "text")
    g = d.groupBy("binder").agg(F.sort_array(F.collect_list(page)).alias("p"))
    body = F.transform(
        "p",
        lambda e, n: F.concat(
            F.lit("--- PAGE "), (n + 1).cast("string"), F.lit(" ---\nBinder "), F.col("binder").cast("string"),
            F.lit("\n"), e["text"], F.lit("\n"),
        ),
    )
    return g.select(F.col("binder").alias("doc_id"), F.array_join(body, "").alias("text"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings table as a vector store, five vectors to a document."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), (F.col("vec_id") / 5).cast("long").alias("doc_id"), "embedding",
        F.col("label").cast("string").alias("label"),
        F.get(F.array(*(F.lit(s) for s in ("pdf", "image", "api"))), (F.col("label") % 3).cast("int")).alias("source_type"),
        F.concat(F.lit('{"topic": "t'), F.col("label").cast("string"), F.lit('"}')).alias("metadata"),
    )


def receipts(spark: SparkSession, sf: str) -> DataFrame:
    """One line of business text per order, with the identifiers entity patterns look for."""
    o = table(spark, sf, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    money = F.concat((cents / 100).cast("long").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    key = F.col("o_orderkey")
    return o.select(
        key.alias("doc_id"),
        F.concat(
            F.lit("Invoice INV-"), F.lpad(key.cast("string"), 8, "0"), F.lit(" under contract CON-"),
            F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lit("-"), F.lpad((key % 100).cast("string"), 2, "0"),
            F.lit(" dated "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" Customer: "), F.col("o_custkey").cast("string"),
            F.lit(" Status: "), "o_orderstatus", F.lit(" Total: $"), money, F.lit(" or "), money, F.lit(" USD, call 555-"),
            F.lpad((key % 1000).cast("string"), 3, "0"), F.lit("-"), F.lpad((key % 10000).cast("string"), 4, "0"), F.lit("."),
        ).alias("text"),
    )


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns next to the assistant turn before them: (conv_id, turn, a, b)."""
    from pyspark.sql import Window

    c = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.select("conv_id", "turn", F.lag("text").over(w).alias("a"), F.col("text").alias("b")).where(F.col("a").isNotNull())


def halves(df: DataFrame, by: str) -> DataFrame:
    """Reference and current side: the lower and upper half of the range of ``by``."""
    cut = df.agg((F.min(by) + F.max(by)) / 2).scalar()
    return df.withColumn("side", F.when(F.col(by) < cut, "ref").otherwise("cur"))


def class_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Three models' class probabilities per document, from digests of its text."""
    from docspark.operators.classify import CLASSES

    d = table(spark, sf, "documents")

    def probs(model: str):
        raw = [
            (F.conv(F.substring(F.md5(F.concat("text", F.lit(f"{model}{c}")).cast("binary")), 1, 3), 16, 10).cast("double") + 1)
            for c in CLASSES
        ]
        strong = [r * r * r for r in raw]
        return F.map_from_arrays(F.array(*(F.lit(c) for c in CLASSES)), F.array(*strong))

    def normal(m: str):
        total = F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x)
        return let(total, lambda t: F.transform_values(m, lambda k, v: v / t))

    maps = d.select("doc_id", "source", "lang", *(probs(m).alias(m) for m in ("classifier", "vision", "llm")))
    return maps.select("doc_id", "source", "lang", *(normal(m).alias(m) for m in ("classifier", "vision", "llm")))


def _class_sql() -> str:
    from docspark.operators.classify import CLASSES

    rows = ", ".join(f"('{c}', {i})" for i, c in enumerate(CLASSES))
    return f"""
classes(class, ord) AS (VALUES {rows}),
models(model) AS (VALUES ('classifier'), ('vision'), ('llm')),
raw_preds AS (
  SELECT doc_id, model, class, ord,
         power(CAST('0x' || substr(md5(text || model || class), 1, 3) AS BIGINT)::DOUBLE + 1, 3) AS r
  FROM documents, models, classes),
preds AS (
  SELECT doc_id, model, class, ord, r / sum(r) OVER (PARTITION BY doc_id, model) AS p FROM raw_preds)"""


SQL = {
    "envelope": r"""
envelope AS (
  SELECT doc_id,
    make_timestamp((1704067200 + doc_id * 60) * 1000000) AS ingestion_ts,
    ['pdf','image','api','stream','database'][(doc_id % 5 + 1)::INT] AS source_type,
    's3://raw/' || source || '/' || doc_id || ['.pdf','.jpg','.docx','.json',''][(doc_id % 5 + 1)::INT] AS source_uri,
    text AS raw_text, strlen(text)::BIGINT AS byte_size,
    sha256(CASE WHEN doc_id % 97 = 0 THEN text || 'x' ELSE text END) AS checksum,
    CASE WHEN doc_id % 53 = 0 THEN 'pt' ELSE lang END AS language,
    CASE WHEN doc_id % 5 = 0 THEN (doc_id % 7)::INT END AS page_count,
    CASE WHEN doc_id % 11 = 0 THEN '{"images": true}' WHEN doc_id % 13 = 0 THEN '{"has_image": false}' ELSE '{}' END AS metadata,
    source, lang
  FROM documents)""",
    "passages": r"""
passages AS (
  SELECT doc_id * 100000 + line AS chunk_id, doc_id, line, text, 's3://raw/' || source || '/' || doc_id AS source_uri
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS text,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)
  WHERE regexp_matches(text, '[^\t-\r\x1c-\x1f\x{85}\p{Z}]'))""",
    "questions": "questions AS (SELECT item_id AS query_id, text FROM benchmark)",
    "binders": r"""
binder_pages AS (
  SELECT doc_id // 8 AS binder, doc_id, text, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) AS page FROM documents),
binders AS (
  SELECT binder AS doc_id, string_agg('--- PAGE ' || page || ' ---' || chr(10) || 'Binder ' || binder || chr(10) || text || chr(10), '' ORDER BY page) AS text
  FROM binder_pages GROUP BY binder)""",
    "vectors": r"""
vectors AS (
  SELECT vec_id AS chunk_id, vec_id // 5 AS doc_id, embedding::DOUBLE[] AS embedding, label::VARCHAR AS label,
    ['pdf','image','api'][label % 3 + 1] AS source_type, 't' || label AS topic FROM embeddings)""",
    "receipts": r"""
receipts0 AS (
  SELECT *, (round(o_totalprice * 100)::BIGINT // 100) || '.' || lpad((round(o_totalprice * 100)::BIGINT % 100)::VARCHAR, 2, '0') AS money FROM orders),
receipts AS (
  SELECT o_orderkey AS doc_id,
    'Invoice INV-' || lpad(o_orderkey::VARCHAR, 8, '0') || ' under contract CON-' || lpad(o_custkey::VARCHAR, 6, '0') || '-'
    || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || ' dated ' || strftime(o_orderdate, '%Y-%m-%d') || ' Customer: ' || o_custkey
    || ' Status: ' || o_orderstatus || ' Total: $' || money || ' or ' || money || ' USD, call 555-'
    || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || '-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || '.' AS text
  FROM receipts0)""",
    "answers": r"""
answers AS (
  SELECT * FROM (
    SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a, text AS b
    FROM conversations WHERE role = 'assistant') WHERE a IS NOT NULL)""",
    "requests": r"""
requests AS (
  SELECT event_id, ts, epoch_us(ts) AS us, user_id AS api_key, event_type AS label, event_type = 'error' AS error,
    (json_extract_string(props, '$.k')::BIGINT % 2 = 0) AS cache_hit, value AS latency, 'exp' || (user_id % 5) AS experiment_id
  FROM events)""",
    "preds": _class_sql(),
}


def with_sql(*names: str, rest: str, recursive: bool = False) -> str:
    """``WITH`` the named inputs, then ``rest`` (more tables, then a SELECT)."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(SQL[n].strip() for n in names) + rest
