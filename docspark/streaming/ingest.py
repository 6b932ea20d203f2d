"""The whole ingest of a batch: gate, chunks, vectors, features, catalogue, events and letters from one pass (CAT11, STR9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions import hashing
from docspark.functions.counts import text_reading
from docspark.operators import chunking, cleaning, entities, features, quality
from docspark.operators import vectors as vec
from docspark.sources import documents, log

KEYS = "dedup_key string, doc_id long, registered_at timestamp"


# What the gate finds out of a row and doesn't hand on.
FOUND = ["schema_reason", "content_reason", "existing_doc_id", "dedup_key", "key_hash", "detected", "prob", "failure_reason", "features"]
TEXTS = ["raw_text", "raw_bytes"]


def read_rows(docs: DataFrame, model: DataFrame | None) -> DataFrame:
    """Adds what a row tells by itself: schema_reason, content_reason, dedup_key, detected, prob, uncertain_language and features.

    Every text is read once, where it is. Without a ``model`` the given language stands.
    """
    table = None if model is None else quality.language_table(model)
    first = docs.withColumns({"schema_reason": quality.schema_reason(), "dedup_key": hashing.dedup_key(F.col("source_uri"), F.col("checksum"))})
    n = F.col("_n")
    read = first.withColumn("_n", text_reading(table, **features.FAMILIES)(F.col("raw_text"), F.lower("raw_text")))
    detected, prob = (n["detected"], n["prob"]) if model is not None else (F.col("language"), F.lit(1.0))
    ok = F.col("schema_reason").isNull()
    out = read.withColumns({"detected": F.when(ok, detected), "prob": F.when(ok, prob), "key_hash": F.xxhash64("dedup_key")}).withColumns({
        "language": F.coalesce(F.regexp_extract(F.lower("detected"), "^[a-z]+", 0), "language"),
        "uncertain_language": F.col("prob") < quality.MIN_LANGUAGE_PROB, "content_reason": quality.content_reason(counts=n),
        "_pages": features.page_count(F.col("raw_text"), F.col("page_count")),
    })
    return out.withColumn("features", F.struct("doc_id", *features.feature_columns(n, F.col("_pages")))).drop("_n", "_pages")


def copies(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, key_hash, existing_doc_id) of the rows whose key is in ``keys`` or of an earlier row; no text is touched."""
    asked = rows.where(F.col("schema_reason").isNull() & F.col("dedup_key").isNotNull()).select("dedup_key", "key_hash", "doc_id", "ingestion_ts")
    owners = asked.groupBy("dedup_key").agg(F.min(F.struct("ingestion_ts", "doc_id")).alias("first"))
    known = keys.groupBy("dedup_key").agg(F.min_by("doc_id", F.struct("registered_at", "doc_id")).alias("registered"))
    owners = owners.join(known, "dedup_key", "left").select("dedup_key", F.coalesce("registered", "first.doc_id").alias("owner"))
    found = asked.join(owners, "dedup_key").where(F.col("doc_id") != F.col("owner"))
    return found.select("doc_id", "key_hash", F.col("owner").alias("existing_doc_id")).distinct()


def judged(rows: DataFrame, copied: DataFrame) -> DataFrame:
    """Adds existing_doc_id and failure_reason to rows that were read. An id with two keys is two rows, so its keys are told apart."""
    of = copied.select(F.col("doc_id").alias("_of"), F.col("key_hash").alias("_key"), "existing_doc_id")
    out = rows.join(of, (F.col("doc_id") == F.col("_of")) & (F.col("key_hash") == F.col("_key")) & F.col("schema_reason").isNull(), "left").drop("_of", "_key")
    spoken_ok = F.regexp_extract(F.lower("detected"), "^[a-z]+", 0).isin(quality.ALLOWED_LANGUAGES)
    reason = F.coalesce(
        F.col("schema_reason"), F.when(F.col("existing_doc_id").isNotNull(), "duplicate_document"),
        F.when(F.col("detected").isNotNull() & ~spoken_ok, "detected_language_not_allowed"), F.col("content_reason"),
    )
    return out.withColumn("failure_reason", reason)


def gate(docs: DataFrame, keys: DataFrame, model: DataFrame | None) -> DataFrame:
    """Adds failure_reason, existing_doc_id, detected, prob, uncertain_language, dedup_key and features (VAL1-10, DED1, VAL6).

    Checks run in this order: schema, duplicate of a key (of ``keys`` or of an earlier row), language of the text,
    content. A row that passes the schema registers its key whatever becomes of it. Rows without an address or a checksum
    have no key and are nobody's duplicates. Without a ``model`` the given language stands.
    """
    rows = read_rows(docs, model)
    return judged(rows, copies(rows, keys))


def sinks(checked: DataFrame, brief: DataFrame | None = None, encoder=vec.encode) -> dict:
    """The tables of a batch for ``log.commit``: later ones read what earlier ones have written.

    ``brief`` is ``checked`` without its texts, if there is such a table: what needs no text is made of it.
    """
    brief = checked if brief is None else brief
    passes = F.col("failure_reason").isNull()
    is_copy = F.col("failure_reason") == "duplicate_document"
    plain = [c for c in checked.columns if c not in FOUND]

    def chunks(done):
        cleaned = cleaning.clean(done["documents"], "raw_text")
        return chunking.fixed(cleaned, "clean_text")

    def vectors(done):
        kind = done["features"].select("doc_id", "doc_type_signal")
        about = done["documents"].select("doc_id", "source_type", "language").join(kind, "doc_id")
        rows = encoder(done["chunks"].select("doc_id", "chunk_id", "text"), F.col("text"))
        return rows.select("doc_id", "chunk_id", "embedding").join(about, "doc_id")

    def catalogue(done):
        """What became of every document but copies, which change nothing."""
        counted = done["chunks"].groupBy("doc_id").agg(F.count("*").alias("chunks"))
        found = done["tags"].join(counted, "doc_id", "left")
        none = F.col("chunks").isNull()
        right = found.select(
            "doc_id", "source_uri", F.when(none, "failed").otherwise("completed").alias("status"),
            F.when(none, "0 chunks").alias("error_message"), F.col("ingestion_ts").alias("updated_at"), "entities", F.coalesce("chunks", F.lit(0)).alias("chunks"),
        )
        wrong = brief.where(~passes & ~is_copy).select(
            "doc_id", "source_uri", F.lit("failed").alias("status"), F.col("failure_reason").alias("error_message"), F.col("ingestion_ts").alias("updated_at"),
            F.lit(0).alias("entities"), F.lit(0).cast("long").alias("chunks"),
        )
        return right.unionByName(wrong)

    def events(done):
        kind = done["features"].select("doc_id", F.col("doc_type_signal").alias("predicted_class"))
        finished = done["catalogue"].where("status = 'completed'").join(kind, "doc_id", "left").withColumnRenamed("entities", "entities_extracted")
        return documents.processed_events(finished, F.col("updated_at"))

    def letters(done):
        """Rejected rows and those that gave no chunk."""
        empty = done["catalogue"].where("error_message = '0 chunks'").select("doc_id")
        failed = done["documents"].join(empty, "doc_id", "left_semi").withColumn("failure_reason", F.lit("0 chunks"))
        wrong = checked.where(~passes & ~is_copy).select(*plain, "failure_reason")
        return documents.dead_letters(wrong.unionByName(failed.select(*wrong.columns)), F.col("ingestion_ts"))

    def tags(done):
        d = done["documents"]
        return d.select("doc_id", "source_uri", "ingestion_ts", F.size(entities.extract_entities(F.col("raw_text"))).alias("entities"))

    passed = brief.where(F.col("dedup_key").isNotNull() & ~F.coalesce(F.col("failure_reason").isin(quality.SCHEMA_REASONS), F.lit(False)) & F.col("existing_doc_id").isNull())
    return {
        "documents": checked.where(passes).select(*plain),
        "keys": passed.select("dedup_key", F.col("doc_id").cast("long").alias("doc_id"), F.col("ingestion_ts").alias("registered_at")),
        "duplicates": brief.where(is_copy).select("doc_id", "existing_doc_id"),
        "features": brief.where(passes).select("features.*"),
        "tags": tags,
        "chunks": chunks,
        "vectors": vectors,
        "catalogue": catalogue,
        "events": events,
        "letters": letters,
    }


def ingest_batch(docs: DataFrame, root: str, batch: int, model: DataFrame | None = None, encoder=vec.encode) -> bool:
    """Ingests one batch into the tables under ``root``; a batch that is there already adds nothing.

    What was read is kept for the length of the batch, so the input is read once; what needs no text reads a part without
    them. Copies are few and known before texts are joined to them, so where they are small enough no text is shuffled.
    Keys are those of the batches before this one, so a batch done again decides as it did at first.
    """
    spark = docs.sparkSession
    if log.committed(spark, root, batch):
        return False
    keys = log.read_table(spark, root, "keys", KEYS, below=batch)
    rows = read_rows(docs, model).persist()
    small = rows.drop(*TEXTS).persist()
    copied = copies(small, keys).persist()
    try:
        copied.count()  # a table that is there has a size, which decides how it is joined
        return log.commit(spark, root, batch, sinks(judged(rows, copied), judged(small, copied), encoder))
    finally:
        for kept in (copied, small, rows):
            kept.unpersist()


def ingest_stream(docs: DataFrame, root: str, checkpoint: str, model: DataFrame | None = None, encoder=vec.encode):
    """The same for every batch of a stream, numbered by the stream (STR9)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, root, batch_id, model, encoder)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def records(spark: SparkSession, root: str) -> DataFrame:
    """(sink, doc_id, detail): what every sink holds of every document, text by text."""

    def rows(name: str, schema: str, detail, key="doc_id"):
        t = log.read_table(spark, root, name, T.StructType.fromDDL(schema))
        return t.select(F.lit(name).alias("sink"), F.col(key).cast("string").alias("doc_id"), detail.cast("string").alias("detail"))

    def json(path):
        return F.get_json_object("value", path)

    chunks = log.read_table(spark, root, "chunks", "doc_id long, token_count int").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("token_count").alias("t"))
    vectors = log.read_table(spark, root, "vectors", "doc_id long, embedding array<double>").groupBy("doc_id").agg(F.sum(F.size("embedding")).alias("n"))
    letters = log.read_table(spark, root, "letters", "value string")
    parts = [
        rows("documents", "doc_id long, language string, uncertain_language boolean", F.concat_ws(":", "language", F.col("uncertain_language").cast("string"))),
        rows("keys", "doc_id long, dedup_key string", F.col("dedup_key")),
        rows("duplicates", "doc_id long, existing_doc_id long", F.col("existing_doc_id")),
        rows("features", "doc_id long, doc_type_signal string", F.col("doc_type_signal")),
        rows("catalogue", "doc_id long, status string, error_message string", F.concat_ws(":", "status", "error_message")),
        rows("events", "key string, value string", F.col("value"), "key"),
        chunks.select(F.lit("chunks").alias("sink"), F.col("doc_id").cast("string").alias("doc_id"), F.concat_ws(":", F.col("n").cast("string"), F.col("t").cast("string")).alias("detail")),
        vectors.select(F.lit("vectors").alias("sink"), F.col("doc_id").cast("string").alias("doc_id"), F.col("n").cast("string").alias("detail")),
        letters.select(F.lit("letters").alias("sink"), json("$.document.doc_id").alias("doc_id"), json("$.failure_reason").alias("detail")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
