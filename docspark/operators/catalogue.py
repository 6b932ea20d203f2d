"""Document catalogue: status, listings, details, deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import hashing


def upsert_status(catalogue: DataFrame, updates: DataFrame) -> DataFrame:
    """Newest status per document; the first source_uri stays (CAT1).

    At one time an update stands over what is there, and a later status in order over an earlier.
    """
    turn = lambda df, n: df.withColumn("_turn", F.lit(n))
    both = turn(catalogue, 0).unionByName(turn(updates, 1))
    picked = both.groupBy("doc_id").agg(
        F.min_by("source_uri", F.struct("updated_at", "_turn", "source_uri")).alias("source_uri"),
        F.max_by(F.struct("status", "error_message", "updated_at"), F.struct("updated_at", "_turn", "status", "error_message")).alias("s"),
    )
    return picked.select("doc_id", "source_uri", "s.status", "s.error_message", "s.updated_at")


def filename(uri: Column) -> Column:
    return F.regexp_extract(uri, r"[^/\\]*$", 0)


def listed_type(uri: Column) -> Column:
    """jpg for jpg and jpeg, pdf, docx and png as they are, else pdf (CAT5, SRC6)."""
    ext = F.lower(F.regexp_extract(filename(uri), r"\.([^.]*)$", 1))
    return F.when(ext.isin("jpg", "jpeg"), "jpg").when(ext.isin("pdf", "docx", "png"), ext).otherwise("pdf")


def filtered(catalogue: DataFrame, status=None, source_type=None, start=None, end=None) -> DataFrame:
    """Rows of a listing; dates are inclusive (CAT2)."""
    out = catalogue
    if status:
        out = out.where(F.col("status") == status)
    if source_type:
        kind = source_type.lower()
        kinds = ["jpg", "jpeg"] if kind in ("jpg", "jpeg") else [kind]
        test = F.lit(False)
        for k in kinds:
            test = test | F.endswith("source_uri", F.lit(f".{k}")) | F.endswith("source_uri", F.lit(f".{k.upper()}"))
        out = out.where(test)
    if start is not None:
        out = out.where(F.col("updated_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.where(F.col("updated_at") <= F.lit(end).cast("timestamp"))
    return out


def _shown(rows: DataFrame, features: DataFrame) -> DataFrame:
    kinds = features.where(F.col("feature_name") == "doc_type_signal").select("doc_id", F.col("feature_value").alias("doc_type"))
    # Features are cut to the page first; its size is the caller's, so how it is sent is left to its measured bytes.
    kinds = kinds.join(rows.select("doc_id"), "doc_id", "left_semi")
    return rows.join(kinds, "doc_id", "left").select(
        "doc_id", filename(F.col("source_uri")).alias("filename"), listed_type(F.col("source_uri")).alias("source_type"),
        "status", "updated_at", "doc_type",
    )


def write_listing(catalogue: DataFrame, path: str) -> None:
    """The catalogue in listing order, newest first, with every row's place from 0 (CAT2).

    A range sort puts neighbours into one file, and places are counted from the sizes of the parts before, so nothing
    is ranked in one task. A page is then a range of places, and files and row groups outside it stay shut.
    """
    spark = catalogue.sparkSession
    ordered = catalogue.orderBy(F.desc_nulls_last("updated_at"), F.asc_nulls_first("doc_id"))
    part = ordered.withColumn("at", F.monotonically_increasing_id())
    # The upper bits of the id are the part, the lower ones the place inside it.
    part.withColumns({"part": F.shiftright("at", 33).cast("int"), "inside": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("at").write.parquet(f"{path}/sorted")
    stored = spark.read.parquet(f"{path}/sorted")
    sizes = {r["part"]: r["n"] for r in stored.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    spark.createDataFrame([(p, n) for p, n in enumerate(before)], "part int, before long").coalesce(1).write.parquet(f"{path}/parts")


def listed(spark, path: str, number: int, size: int) -> DataFrame:
    """Page ``number`` from 1 of a written listing: page 10,000 costs what page 1 does."""
    first, last = (number - 1) * size, number * size - 1
    rows = spark.read.parquet(f"{path}/sorted")
    parts = [tuple(r) for r in spark.read.parquet(f"{path}/parts").orderBy("part").collect()]
    wanted = [(p, b) for i, (p, b) in enumerate(parts) if b <= last and (i + 1 == len(parts) or parts[i + 1][1] > first)]
    inside = F.lit(False)
    for p, b in wanted:
        inside = inside | ((F.col("part") == p) & F.col("inside").between(max(first - b, 0), last - b))
    return rows.where(inside).drop("part", "inside")


def page_after(catalogue: DataFrame, features: DataFrame, after: tuple | None = None, size: int = 20, **filters) -> DataFrame:
    """The page behind a row (its updated_at and doc_id), or the first one: only rows behind it are read and held (CAT2)."""
    rows = filtered(catalogue, **filters)
    if after is not None:
        at, doc_id = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        # The first test alone can shut files of a listing; the second settles rows of one time.
        rows = rows.where(F.col("updated_at") <= at).where((F.col("updated_at") < at) | (F.col("doc_id") > doc_id))
    return _shown(rows.orderBy(F.desc("updated_at"), "doc_id").limit(size), features)


def page(catalogue: DataFrame, features: DataFrame, number: int = 1, size: int = 20, **filters) -> DataFrame:
    """One page, newest first, with the document type when known (CAT2, CAT4, CAT5)."""
    return _shown(filtered(catalogue, **filters).orderBy(F.desc("updated_at"), "doc_id").offset((number - 1) * size).limit(size), features)


def total(catalogue: DataFrame, **filters) -> DataFrame:
    return filtered(catalogue, **filters).agg(F.count("*").alias("total"))


def detail(catalogue: DataFrame, features: DataFrame) -> DataFrame:
    """Catalogue and typed features side by side, defaults where one is missing (CAT6).

    ``features`` is wide, a row per document. Documents in neither side have no row.
    """
    c = catalogue.select("doc_id", "source_uri", "status", "updated_at")
    j = c.join(features, "doc_id", "full")
    uri = F.coalesce("source_uri", F.concat(F.lit("s3://raw/"), F.col("doc_id").cast("string"), F.lit(".pdf")))
    ext = F.lower(F.regexp_extract(filename(uri), r"\.([^.]*)$", 1))
    return j.select(
        "doc_id",
        F.coalesce("status", F.lit("processed")).alias("status"),
        uri.alias("source_uri"),
        filename(uri).alias("filename"),
        F.coalesce("doc_type_signal", F.when(ext == "", "pdf").otherwise(ext)).alias("source_type"),
        F.coalesce("language", F.lit("en")).alias("language"),
        F.coalesce("page_count", F.lit(1)).alias("page_count"),
    )


def delete_cascade(doc_ids: DataFrame, tables: dict[str, DataFrame], catalogue: DataFrame, keys: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every table without the listed documents, and the keys they gave back (CAT7, CAT8)."""
    ids = doc_ids.select("doc_id").distinct()
    out = {n: t.join(ids, "doc_id", "left_anti") for n, t in tables.items()}
    out["catalogue"] = catalogue.join(ids, "doc_id", "left_anti")
    if keys is not None and "checksum" in catalogue.columns:
        gone = catalogue.join(ids, "doc_id", "left_semi").select(
            hashing.dedup_key(F.col("source_uri"), F.col("checksum")).alias("dedup_key")
        )
        out["dedup_keys"] = keys.join(gone.distinct(), "dedup_key", "left_anti")
    return out


def delete_counts(doc_ids: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Requested and matched documents of a bulk delete (CAT8)."""
    ids = doc_ids.select("doc_id").distinct()
    known = catalogue.select("doc_id", F.lit(1).alias("hit"))
    return ids.join(known, "doc_id", "left").agg(F.count("*").alias("requested"), F.count("hit").alias("matched"))


def chunk_page(chunks: DataFrame, number: int, size: int) -> DataFrame:
    """A page of every document's chunks; the stored index makes it a plain filter (CAT9)."""
    return chunks.where((F.col("chunk_index") >= (number - 1) * size) & (F.col("chunk_index") < number * size))


def reprocess(catalogue: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Known documents among those asked for (CAT10)."""
    return catalogue.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
