"""Windowed telemetry over request events, batch form. Streams are in ``docspark.streaming``."""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.operators.ordered import percentiles

HIT_WINDOW_US = 300_000_000
RATE_WINDOW_US = 60_000_000
RATE_LIMIT = 100
# Histogram bounds in seconds.
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
CANARY_LIMIT = 0.01
CANARY_FAILURES = 3


def rolling_hit_rate(events: DataFrame, key: str, us: str, hit: str, width: int = HIT_WINDOW_US) -> DataFrame:
    """Hit rate over the last five minutes at every event, edges included (STR1).

    Time is cut into slices as wide as the window; a row also joins the next slice as history, so
    a busy key is many small windows instead of one long sort.
    """
    own = F.floor(F.col(us) / width).cast("long")
    copies = events.select(
        "*", F.explode(F.array(F.struct(own.alias("slice"), F.lit(True).alias("own")),
                               F.struct((own + 1).alias("slice"), F.lit(False).alias("own")))).alias("_c")
    )
    w = Window.partitionBy(key, "_c.slice").orderBy(us).rangeBetween(-width, 0)
    rate = F.avg(F.col(hit).cast("double")).over(w)
    return copies.withColumn("hit_rate", rate).where("_c.own").drop("_c")


def busy_runs(events: DataFrame, key: str, us: str, width: int) -> DataFrame:
    """Adds ``run``: rows of a key without a pause of ``width`` or more between them.

    A pause always falls between slices of that width, so runs are found on the (key, slice)
    summary, not on the rows.
    """
    sliced = events.withColumn("_slice", F.floor(F.col(us) / width).cast("long"))
    s = sliced.groupBy(key, "_slice").agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
    w = Window.partitionBy(key).orderBy("_slice")
    s = s.withColumn("_prev", F.lag("hi").over(w))
    opens = (F.col("_prev").isNull() | (F.col("lo") - F.col("_prev") >= width)).cast("int")
    runs = s.withColumn("_opens", opens).select(key, "_slice", F.sum("_opens").over(w).alias("run"))
    return sliced.join(runs, [key, "_slice"]).drop("_slice")


def rate_limit(
    events: DataFrame, key: str, us: str, order: str, limit: int = RATE_LIMIT, width: int = RATE_WINDOW_US
) -> DataFrame:
    """Adds ``admitted``: fewer than ``limit`` admitted requests in the window before (STR2).

    Rejected requests do not count, so each decision needs the ones before it. Runs between
    pauses are independent and spread over the cluster; inside one, rows stream through in time
    order with only the last ``limit`` admitted times kept.
    """
    runs = busy_runs(events, key, us, width)
    placed = runs.repartition(key, "run").sortWithinPartitions(key, "run", us, order)
    cols = [c for c in events.columns]
    schema = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in cols) + ", admitted boolean"

    def fold(batches):
        at, recent = None, deque(maxlen=limit)
        for pdf in batches:
            out = np.empty(len(pdf), dtype=bool)
            for i, (k, r, t) in enumerate(zip(pdf[key], pdf["run"], pdf[us])):
                if (k, r) != at:
                    at = (k, r)
                    recent.clear()
                # Full means the oldest of the last ``limit`` admissions decides.
                ok = len(recent) < limit or recent[0] <= t - width
                out[i] = ok
                if ok:
                    recent.append(t)
            yield pdf[cols].assign(admitted=out)

    return placed.mapInPandas(fold, schema)


def per_minute(events: DataFrame, ts: str, label: str) -> DataFrame:
    """Requests per minute and label, and the rate per second (STR3)."""
    w = F.window(ts, "1 minute")
    return (
        events.groupBy(w.alias("w"), label).agg(F.count("*").alias("requests"))
        .select(F.col("w.start").alias("window_start"), label, "requests", (F.col("requests") / 60).alias("rate"))
    )


def hit_ratio(events: DataFrame, ts: str, hit: str, width: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Cache hit ratio per sliding window (STR4)."""
    w = F.window(ts, width, slide)
    return (
        events.groupBy(w.alias("w")).agg(F.count("*").alias("requests"), F.count(F.when(F.col(hit), 1)).alias("hits"))
        .select(F.col("w.start").alias("window_start"), "requests", "hits", (F.col("hits") / F.col("requests")).alias("ratio"))
    )


def latency_p95(events: DataFrame, keys: list[str], latency: str) -> DataFrame:
    """Exact 95th percentile per label (STR5)."""
    return percentiles(events, keys, {latency: {"p95": 0.95}})


def latency_buckets(events: DataFrame, label: str, latency: str, bounds: list[float] = LATENCY_BOUNDS) -> DataFrame:
    """Cumulative histogram counts per label and bound (STR6): one map-side combined pass."""
    v = F.col(latency)
    counts = F.array(*(F.count(F.when(v <= b, 1)) for b in bounds), F.count(v))
    names = F.array(*(F.lit(str(b)) for b in bounds), F.lit("+Inf"))
    rows = events.groupBy(label).agg(F.arrays_zip(names.alias("le"), counts.alias("n")).alias("b"))
    return rows.select(label, F.explode("b").alias("b")).select(label, F.col("b.le").alias("le"), F.col("b.n").alias("n"))


def latest_gauge(events: DataFrame, label: str, ts: str, order: str, value: str) -> DataFrame:
    """Last value per label (STR7)."""
    return events.groupBy(label).agg(F.max_by(value, F.struct(ts, order)).alias("value"))


def canary(events: DataFrame, key: str, ts: str, error: str) -> DataFrame:
    """Error share per five-minute window every 30 seconds, and when the canary stops (STR8)."""
    w = F.window(ts, "5 minutes", "30 seconds")
    rate = F.count(F.when(F.col(error), 1)) / (F.count("*") + 0.0001)
    per = events.groupBy(key, w.alias("w")).agg(F.count("*").alias("requests"), rate.alias("error_rate"))
    return stopped(per.select(key, F.col("w.start").alias("window_start"), "requests", "error_rate"), key)


def stopped(per: DataFrame, key: str) -> DataFrame:
    """Adds failures, the windows over the limit so far, and aborted to error rates per window (STR8)."""
    failed = (F.col("error_rate") > CANARY_LIMIT).cast("int")
    run = Window.partitionBy(key).orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("failures", F.sum(failed).over(run))
    return per.withColumn("aborted", F.col("failures") >= CANARY_FAILURES)


def status_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source_type", "status").agg(F.count("*").alias("documents"))


def request_columns(events: DataFrame) -> DataFrame:
    """Raw events to request telemetry: error and cache flags, latency, key and label."""
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("user_id").alias("api_key"), F.col("event_type").alias("label"),
        (F.col("event_type") == "error").alias("error"), (k % 2 == 0).alias("cache_hit"), F.col("value").alias("latency"),
        F.concat(F.lit("exp"), (F.col("user_id") % 5).cast("string")).alias("experiment_id"),
    )


def count_label(c: Column) -> Column:
    return F.when(c, "500").otherwise("200")
