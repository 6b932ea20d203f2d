"""Document tables, payload envelopes, change events, routing and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions import hashing

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("ingestion_ts", T.TimestampType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_uri", T.StringType()),
        T.StructField("raw_text", T.StringType()),
        T.StructField("raw_bytes", T.BinaryType()),
        T.StructField("byte_size", T.LongType()),
        T.StructField("checksum", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("mime_type", T.StringType()),
        T.StructField("page_count", T.IntegerType()),
        T.StructField("metadata", T.StringType()),
    ]
)
SOURCE_TYPES = ["pdf", "image", "api", "stream", "database"]
SIZE_LIMITED = ["pdf", "image"]
MAX_BYTES = 50 * 1024 * 1024
# Accepted upload types.
MIME_TYPES = [
    "application/pdf",
    "image/png",
    "image/jpeg",
    "image/tiff",
    "text/plain",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
]
RETRY_SECONDS = 300
SNAPSHOT_ROWS = 1000


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Stored documents; the folder columns prune the scan (SRC1)."""
    return spark.read.schema(
        T.StructType([*DOCUMENT_SCHEMA.fields, *(T.StructField(c, T.IntegerType()) for c in ("year", "month", "day"))])
    ).parquet(path)


def write_documents(docs: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by date and source (SNK1).

    ``rebalance`` groups rows by folder into few large files and splits a folder that holds most.
    """
    ts = F.col("ingestion_ts")
    dated = docs.withColumns({"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts)})
    folders = ["year", "month", "day", "source_type"]
    dated.hint("rebalance", *folders).write.mode(mode).partitionBy(*folders).parquet(path)


def decode(raw: Column) -> Column:
    """UTF-8 text; bad bytes become U+FFFD (SRC3)."""
    return F.make_valid_utf8(raw.cast("string"))


def from_payloads(df: DataFrame, source_type: str, mime: str = "text/plain") -> DataFrame:
    """Envelope of (source_uri, raw_bytes) rows (SRC3)."""
    return df.select(
        hashing.uuid5(F.col("source_uri")).alias("doc_id"),
        F.lit(source_type).alias("source_type"),
        "source_uri",
        decode(F.col("raw_bytes")).alias("raw_text"),
        F.octet_length("raw_bytes").cast("long").alias("byte_size"),
        F.sha2("raw_bytes", 256).alias("checksum"),
        F.lit("en").alias("language"),
        F.lit(mime).alias("mime_type"),
    )


def read_files(spark: SparkSession, path: str, source_type: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return from_payloads(files.select(F.col("path").alias("source_uri"), F.col("content").alias("raw_bytes")), source_type)


def from_messages(df: DataFrame) -> DataFrame:
    """Envelope of broker messages (value, topic, partition, offset) (SRC2).

    Empty and unparsable payloads are skipped. Works on streams and tables.
    """
    body = decode(F.col("value"))
    parsed = F.try_parse_json(body)
    # The parser stops after one value; in brackets, anything behind it shows.
    listed = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    alone = listed.isNotNull() & F.try_variant_get(listed, "$[1]", "string").isNull()
    uri = F.concat(
        F.lit("kafka://"), "topic", F.lit("/"), F.col("partition").cast("string"), F.lit("/"), F.col("offset").cast("string")
    )
    ok = df.where((F.octet_length("value") > 0) & parsed.isNotNull() & alone)
    return ok.select(
        hashing.uuid5(uri).alias("doc_id"),
        F.lit("stream").alias("source_type"),
        uri.alias("source_uri"),
        F.to_json(parsed).alias("raw_text"),
        F.octet_length("value").cast("long").alias("byte_size"),
        F.sha2("value", 256).alias("checksum"),
        F.lit("en").alias("language"),
        F.lit("application/json").alias("mime_type"),
        F.to_json(F.struct("topic", "partition", "offset")).alias("metadata"),
    )


def from_changes(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Envelope of change events as JSON (SRC4).

    A record without id or uuid is identified by its payload's digest, so a retry gives the same
    document. A missing or unparsable payload is an error row.
    """
    p = F.col(payload)
    get = lambda path: F.get_json_object(p, path)
    op = get("$.op")
    bad = p.isNull() | F.try_parse_json(p).isNull()
    side = F.when(op == "d", F.lit("before")).otherwise(F.lit("after"))
    pick = lambda name: F.when(side == "before", get(f"$.before.{name}")).otherwise(get(f"$.after.{name}"))
    schema = F.coalesce(get("$.source.schema"), F.lit("public"))
    table = F.coalesce(get("$.source.table"), F.lit("unknown"))
    record = F.coalesce(pick("id"), pick("uuid"), F.sha2(p, 256))
    text = F.when(op == "d", F.concat(F.lit("DELETED RECORD: "), F.coalesce(get("$.before"), F.lit("null")))).otherwise(
        F.coalesce(get("$.after"), F.lit(""))
    )
    raw = p.cast("binary")
    return df.select(
        *(c for c in df.columns if c != payload),
        F.when(~bad, hashing.uuid5(F.concat_ws(".", schema, table, record))).alias("doc_id"),
        F.lit("database").alias("source_type"),
        F.when(~bad, F.concat(F.lit("postgresql://"), schema, F.lit("/"), table, F.lit("/"), record)).alias("source_uri"),
        F.when(~bad, text).alias("raw_text"),
        F.octet_length(raw).cast("long").alias("byte_size"),
        F.sha2(raw, 256).alias("checksum"),
        op.alias("operation"),
        table.alias("db_table"),
        F.when(bad, "missing or invalid change payload").alias("error"),
    )


def extension(uri: Column) -> Column:
    return F.lower(F.regexp_extract(uri, r"\.([^./]+)$", 1))


def source_type_of(uri: Column) -> Column:
    """Adapter by extension (SRC6)."""
    return F.when(extension(uri).isin("png", "jpg", "jpeg", "tiff"), "image").otherwise("pdf")


def mime_of(uri: Column) -> Column:
    ext = extension(uri)
    return (
        F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext.isin("png", "tiff"), F.concat(F.lit("image/"), ext))
        .otherwise("application/pdf")
    )


def route_error(source_type: Column, byte_size: Column) -> Column:
    """Why a row cannot be routed, NULL when it can (SRC5)."""
    return F.when(~F.coalesce(source_type.isin(SOURCE_TYPES), F.lit(False)), "unknown_source_type").when(
        source_type.isin(SIZE_LIMITED) & (byte_size > MAX_BYTES), "file_too_large"
    )


def upload_error(mime: Column, byte_size: Column) -> Column:
    """Upload gate on type and size (SRC7)."""
    return F.when(~F.coalesce(mime.isin(MIME_TYPES), F.lit(False)), "unsupported_mime_type").when(
        byte_size > MAX_BYTES, "file_too_large"
    )


# Readers by source type (UDF1); register more with the same shape: (spark, path) -> DataFrame.
READERS = {
    "pdf": lambda spark, path: read_files(spark, path, "pdf"),
    "image": lambda spark, path: read_files(spark, path, "image"),
    "api": lambda spark, path: read_files(spark, path, "api"),
    "stream": lambda spark, path: from_messages(spark.read.parquet(path)),
    "database": lambda spark, path: from_changes(spark.read.json(path).select(F.to_json(F.struct("*")).alias("payload"))),
}


def dead_letters(rejected: DataFrame, failed_at: Column) -> DataFrame:
    """Rejected rows as {failure_reason, failed_at, document} messages (SNK3).

    ``failed_at`` is written in epoch seconds beside the text form, so readers need no parsing.
    """
    # Binary fields are base64 in JSON, so a retried letter can be checked against its checksum.
    doc = F.struct(*(F.base64(c).alias(c) if t == "binary" else F.col(c) for c, t in rejected.dtypes if c != "failure_reason"))
    return rejected.select(
        F.to_json(F.struct("failure_reason", failed_at.cast("timestamp").alias("failed_at"), doc.alias("document"))).alias("value")
    )


def retry_schedule(messages: DataFrame, now: Column) -> DataFrame:
    """Dead letters with their retry time, due once it has passed (SRC8)."""
    get = lambda path: F.get_json_object("value", path)
    failed = get("$.failed_at").try_cast("timestamp")
    retry = F.timestamp_seconds(F.unix_seconds(failed) + RETRY_SECONDS)
    return messages.select(
        F.coalesce(get("$.document.doc_id"), F.lit("unknown-doc-id")).alias("doc_id"),
        F.coalesce(get("$.document.source_uri"), F.lit("unknown-uri")).alias("source_uri"),
        F.coalesce(get("$.document.source_type"), F.lit("unknown")).alias("source_type"),
        F.coalesce(get("$.failure_reason"), F.lit("Unknown validation failure")).alias("failure_reason"),
        retry.alias("retry_at"),
        F.coalesce(retry <= now, F.lit(False)).alias("due"),
    )


def retry_counts(schedule: DataFrame) -> DataFrame:
    """Letters by source type and reason, and how many of them are due (SRC8)."""
    return schedule.groupBy("source_type", "failure_reason").agg(F.count("*").alias("letters"), F.count(F.when(F.col("due"), 1)).alias("due"))


def retry_due(schedule: DataFrame, callback) -> DataFrame:
    """The caller's DataFrame function over the rows that are due (UDF6)."""
    return callback(schedule.where("due"))


def processed_events(docs: DataFrame, at: Column) -> DataFrame:
    """Completion messages (SNK4)."""
    body = F.struct(
        F.col("doc_id").cast("string").alias("doc_id"), "status",
        F.coalesce("predicted_class", F.lit("unknown")).alias("predicted_class"), "entities_extracted",
        F.unix_seconds(at).alias("timestamp"),
    )
    return docs.select(F.col("doc_id").cast("string").alias("key"), F.to_json(body).alias("value"))


def next_version(latest: Column, env: str, requested: Column | None = None) -> Column:
    """Snapshot tag: the given one, or the patch number raised by one (SNK6)."""
    suffix = f"-{env}"
    base = F.regexp_replace(F.substring_index(F.coalesce(latest, F.lit(f"v1.0.0{suffix}")), "-", 1), "^v+", "")
    parts = F.split(base, r"\.")
    numeric = base.rlike(r"^\d+\.\d+\.\d+$")
    raised = F.concat(
        F.lit("v"), F.get(parts, F.lit(0)), F.lit("."), F.get(parts, F.lit(1)), F.lit("."),
        (F.get(parts, F.lit(2)).try_cast("int") + 1).cast("string"), F.lit(suffix),
    )
    auto = F.when(numeric, raised).otherwise(f"v1.0.1{suffix}")
    if requested is None:
        return auto
    tagged = F.when(F.contains(requested, F.lit(suffix)), requested).otherwise(F.concat(requested, F.lit(suffix)))
    return F.when(F.coalesce(requested, F.lit("")) != "", tagged).otherwise(auto)


def snapshot_if_large(batch: DataFrame, registry: DataFrame, root: str, env: str, over: int = SNAPSHOT_ROWS) -> DataFrame:
    """Writes a version of a batch of more than ``over`` rows; returns the registry with it (SNK6).

    ``registry`` (version, written_at) is small: a row per snapshot. A batch that isn't written has
    a row as well, without a version.
    """
    spark = batch.sparkSession
    if batch.limit(over + 1).count() <= over:
        return registry.unionByName(spark.range(1).select(F.lit(None).cast("string").alias("version"), F.current_timestamp().alias("written_at")))
    latest = registry.where("version IS NOT NULL").agg(F.max_by("version", "written_at").alias("latest"))
    tag = latest.select(next_version(F.col("latest"), env)).first()[0]
    batch.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{tag}")
    row = spark.range(1).select(F.lit(tag).alias("version"), F.current_timestamp().alias("written_at"))
    return registry.unionByName(row)


def training_rows(df: DataFrame, seed: int = 42) -> DataFrame:
    """Instruction template and a repeatable 90/10 split by key digest (SRC9)."""
    text = F.concat(
        F.lit("<s>[INST] "), "instruction", F.lit("\nContext: "), "context", F.lit(" [/INST] "), "response", F.lit("</s>")
    )
    slot = hashing.md5_mod(F.concat(text, F.lit(f"#{seed}")), 10)
    return df.select(F.when(slot == 0, "test").otherwise("train").alias("split"), text.alias("text"))


def read_training(spark: SparkSession, path: str) -> DataFrame:
    schema = "instruction string, context string, response string"
    return training_rows(spark.read.schema(schema).json(path))
