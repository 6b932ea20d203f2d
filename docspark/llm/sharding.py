"""Rendezvous hashing of record keys over weighted shards.

Every (key, shard) pair has a pseudo-random number u in (0, 1); the record goes to the shard with the least
``-ln(u) / weight``. Nothing but the key and the shard list decides, a shard gets records in proportion to
its weight, and one more shard only takes records into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Numbering inside a shard goes by key digest in this many parts.
CELLS = 4096
SCALE = float(1 << 52)


def digest(key: Column, *more: Column) -> Column:
    """MD5 hex of the key and further parts; a null key is the empty string."""
    return F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), *more).cast("binary"))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a key among ``len(weights)`` shards; a tie goes to the lower number."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")

    def cost(shard: int, weight: float) -> Column:
        h = F.conv(F.substring(digest(key, F.lit(str(shard))), 1, 13), 16, 10).cast("double")
        return F.struct((-F.log((h + 0.5) / F.lit(SCALE)) / F.lit(float(weight))).alias("c"), F.lit(shard).alias("s"))

    return F.array_min(F.array(*(cost(i, w) for i, w in enumerate(weights))))["s"]


def shards(docs: DataFrame, weights: list[float], grown: list[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: key, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's bytes plus one; a null text has none. ``slot`` numbers a shard's rows from 0 without
    gaps, by parts of the key space, so no shard is gathered: rows are ranked inside a part and counts of
    earlier parts are added. ``grown`` is the weights with another shard (default: one of mean weight). Rows
    with equal keys share a shard and have neighbouring slots; a null key is the key ''. Other columns are ignored.
    """
    grown = grown or [*weights, sum(weights) / len(weights)]
    t = F.coalesce(F.col(text), F.lit(""))
    cell = F.conv(F.substring(digest(F.col(key)), 1, 3), 16, 10).cast("int")
    rows = docs.select(
        F.col(key).alias("key"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"), rendezvous(F.col(key), grown).alias("grown_shard"), cell.alias("cell"),
    )
    # Only the key is read for the counts.
    counts = docs.select(rendezvous(F.col(key), weights).alias("shard"), cell.alias("cell")).groupBy("shard", "cell").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    begin = counts.select("shard", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("begin"))
    nth = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("key", "text_crc32", "size"))
    return rows.withColumn("nth", nth).join(begin, ["shard", "cell"]).select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("begin") + F.col("nth") - 1).alias("slot"), "grown_shard"
    )


CRC_TABLE = "list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"

SQL = rf"""
WITH crc_table AS MATERIALIZED (SELECT {CRC_TABLE} AS crc),
pairs AS (SELECT doc_id, s, -ln(((('0x' || substr(md5(doc_id || ':' || s), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0) AS c
  FROM documents, range(9) r(s)),
placed AS (
  SELECT doc_id, (arg_min(s, c) FILTER (s < 8))::INT AS shard, arg_min(s, c)::INT AS grown_shard,
    ('0x' || substr(md5(doc_id::VARCHAR), 1, 3))::BIGINT AS cell
  FROM pairs GROUP BY doc_id),
hexed AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
summed AS (
  SELECT doc_id, len(b) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM hexed, crc_table)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY cell, doc_id) - 1 AS slot, grown_shard
FROM placed JOIN summed USING (doc_id)
"""
