"""First-wins deduplication, with and without a time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import hashing
from docspark.session import cut_lineage


def first_wins(rows: DataFrame, key: str, ts: str, doc_id: str) -> DataFrame:
    """Adds is_duplicate and existing_doc_id: the earliest row of a key wins (DED1-2, no TTL).

    Rows without a key are no duplicates of anything.

    The winner is a map-side combined minimum, so a key held by a third of all rows reaches the
    shuffle as one row per task; joining it back is an equi-join AQE may split when skewed.
    """
    firsts = rows.groupBy(key).agg(F.min(F.struct(ts, doc_id)).alias("_first"))
    dup = F.coalesce(F.col(doc_id) != F.col(f"_first.{doc_id}"), F.lit(False))
    return (
        rows.join(firsts, key, "left")
        .withColumn("is_duplicate", dup)
        .withColumn("existing_doc_id", F.when(dup, F.col(f"_first.{doc_id}")))
        .drop("_first")
    )


def distinct_first(rows: DataFrame, key: str, ts: str, doc_id: str) -> DataFrame:
    """Only the winning row of every key, without a join."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(ts, doc_id)).alias("_r"))
    return best.select(key, "_r.*")


def ttl_registrations(rows: DataFrame, key: str, at: str, ttl: int) -> DataFrame:
    """(key, reg): the times a key was registered, each opening ``ttl`` units during which
    further rows are duplicates and do not extend it.

    Every time points to the one that would register after it: the first of its key a TTL or more
    later, found in the next aligned slice or else as the start of the slice after. A row with no row
    of its key in the TTL before it always registers; from these, pointers are followed by doubling,
    so the rounds grow with the logarithm of the longest unbroken run over the TTL. No group is
    gathered: a key is cut into slices, and its slices are met by equality.
    """
    slim = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(at).cast("long").alias("t"))
    # Keys and distinct times only, written down once.
    sliced = cut_lineage(slim.distinct().withColumn("slice", F.floor(F.col("t") / ttl).cast("long")))
    summary = sliced.groupBy("k", "slice").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    w = Window.partitionBy("k").orderBy("slice")
    ahead = {f"{c}{i}": F.lead(c, i).over(w) for i in (1, 2) for c in ("slice", "lo")}
    summary = cut_lineage(summary.withColumns({"prev": F.lag("hi").over(w), **ahead}))
    opening = summary.where(F.col("prev").isNull() | (F.col("lo") - F.col("prev") >= ttl)).select("k", F.col("lo").alias("t"))

    # A time and what it asks of the next slice are sorted together, latest first; the last time seen is the answer.
    asked = sliced.select("k", (F.col("slice") + 1).alias("slice"), (F.col("t") + ttl).alias("t"), F.col("t").alias("of"))
    both = asked.unionByName(sliced.withColumn("of", F.lit(None).cast("long")))
    latest = Window.partitionBy("k", "slice").orderBy(F.desc("t"), F.col("of").asc_nulls_first())
    seen = F.last(F.when(F.col("of").isNull(), F.col("t")), ignorenulls=True).over(latest.rowsBetween(Window.unboundedPreceding, 0))
    inside = both.select("k", "slice", "of", seen.alias("seen")).where(F.col("of").isNotNull())
    inside = inside.select("k", F.col("of").alias("t"), (F.col("slice") - 1).alias("slice"), "seen")
    close = F.col("slice1") == F.col("slice") + 1
    target = F.when(close, F.coalesce("seen", "lo2")).otherwise(F.col("lo1"))
    jumps = inside.join(summary, ["k", "slice"]).select("k", "t", target.alias("to")).where(F.col("to").isNotNull())
    jumps = cut_lineage(jumps)

    found = cut_lineage(opening)
    while True:
        reached = found.join(jumps, ["k", "t"]).select("k", F.col("to").alias("t")).join(found, ["k", "t"], "left_anti").distinct()
        reached = cut_lineage(reached)
        if reached.isEmpty():
            break
        found = cut_lineage(found.unionByName(reached))
        onward = jumps.select("k", F.col("t").alias("to"), F.col("to").alias("far"))
        jumps = cut_lineage(jumps.join(onward, ["k", "to"]).select("k", "t", F.col("far").alias("to")))
    return found.select(F.col("k").alias(key), F.col("t").alias("reg"))


def ttl_dedup(rows: DataFrame, key: str, at: str, doc_id: str, ttl: int) -> DataFrame:
    """Adds is_duplicate and existing_doc_id under a TTL (DED2); rows without a key pass (DED4)."""
    regs = ttl_registrations(rows, key, at, ttl)
    slice_of = F.floor(F.col("reg") / ttl).cast("long")
    open_in = regs.select(key, "reg", F.explode(F.array(slice_of, slice_of + 1)).alias("_slice"))
    t = F.col(at).cast("long")
    keyed = rows.where(F.col(key).isNotNull()).withColumn("_slice", F.floor(t / ttl).cast("long"))
    placed = keyed.join(open_in, [key, "_slice"]).where((t >= F.col("reg")) & (t < F.col("reg") + ttl))
    owner = placed.where(t == F.col("reg")).groupBy(key, "reg").agg(F.min(doc_id).alias("_owner"))
    out = placed.join(owner, [key, "reg"])
    dup = F.col(doc_id) != F.col("_owner")
    done = out.select(*rows.columns, dup.alias("is_duplicate"), F.when(dup, F.col("_owner")).alias("existing_doc_id"))
    free = rows.where(F.col(key).isNull()).select(
        *rows.columns, F.lit(False).alias("is_duplicate"),
        F.lit(None).cast(rows.schema[doc_id].dataType).alias("existing_doc_id"),
    )
    return done.unionByName(free)


def release_keys(keys: DataFrame, deleted: DataFrame) -> DataFrame:
    """Keys left after the deleted documents gave theirs back (DED5)."""
    gone = deleted.where(F.col("source_uri").isNotNull() & F.col("checksum").isNotNull()).select(
        hashing.dedup_key(F.col("source_uri"), F.col("checksum")).alias("dedup_key")
    )
    return keys.join(gone.distinct(), "dedup_key", "left_anti")


def signature_valid(payload: Column, signature: Column, secret: bytes | None) -> Column:
    """Webhook signature check (DED6); nothing passes without a signature or a secret."""
    if not secret:
        return F.lit(False)
    return F.coalesce(F.lower(signature) == hashing.hmac_sha256(payload, secret), F.lit(False))
