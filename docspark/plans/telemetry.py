"""Telemetry over ``events``, as batches and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark import inputs
from docspark.inputs import with_sql
from docspark.operators import telemetry as tel
from docspark.plans import query
from docspark.plans.experiments import LIVE
from docspark.streaming import jobs, stateful


def requests(spark, sf):
    return tel.request_columns(inputs.table(spark, sf, "events"))


def request_stream(spark, sf):
    return tel.request_columns(jobs.file_source(spark, sf, "events"))


def us(c):
    return F.unix_micros(F.col(c).cast("timestamp")).alias(c)


@query(
    "hit_rate_rolling",
    with_sql("requests", rest=""" SELECT event_id, round(avg(cache_hit::INT) OVER (PARTITION BY label ORDER BY us RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW), 6) AS hit_rate FROM requests"""),
)
def hit_rate_rolling(spark, sf):
    r = tel.rolling_hit_rate(requests(spark, sf), "label", "us", "cache_hit")
    return r.select("event_id", F.round("hit_rate", 6).alias("hit_rate"))


# Two admissions a day, so that clients of the test table reach the limit.
DAY_US = 86_400_000_000


LIMITED = f""",
ev AS (SELECT api_key, event_id, us, row_number() OVER (PARTITION BY api_key ORDER BY us, event_id) AS n FROM requests),
walk AS (
  SELECT api_key, n, event_id, true AS admitted, [us] AS recent FROM ev WHERE n = 1
  UNION ALL
  SELECT api_key, n, event_id, ok, CASE WHEN ok THEN list_append(recent, us)[-2:] ELSE recent END FROM (
    SELECT e.*, w.recent, len(w.recent) < 2 OR w.recent[1] <= e.us - {DAY_US} AS ok FROM walk w JOIN ev e ON e.api_key = w.api_key AND e.n = w.n + 1))
SELECT event_id, api_key, admitted FROM walk"""


@query("rate_limit", with_sql("requests", rest=LIMITED, recursive=True))
def rate_limit(spark, sf):
    r = tel.rate_limit(requests(spark, sf).select("event_id", "api_key", "us"), "api_key", "us", "event_id", 2, DAY_US)
    return r.select("event_id", "api_key", "admitted")


@query("rate_limit_stream", with_sql("requests", rest=LIMITED, recursive=True))
def rate_limit_stream(spark, sf):
    s = jobs.run(stateful.rate_limit(request_stream(spark, sf), 2, DAY_US, buckets=stateful.BUCKETS), "rate-limit")
    return s.select("event_id", "api_key", "admitted")


MINUTE = """ SELECT epoch_us(time_bucket(INTERVAL 1 MINUTE, ts)) AS window_start, label, count(*) AS requests, round(count(*) / 60, 6) AS rate FROM requests GROUP BY ALL"""


@query("requests_per_minute", with_sql("requests", rest=MINUTE))
def requests_per_minute(spark, sf):
    r = tel.per_minute(requests(spark, sf), "ts", "label")
    return r.select(us("window_start"), "label", "requests", F.round("rate", 6).alias("rate"))


@query("requests_per_minute_stream", with_sql("requests", rest=MINUTE))
def requests_per_minute_stream(spark, sf):
    r = jobs.run(jobs.per_minute(request_stream(spark, sf)), "per-minute", ["window_start", "label"])
    return r.select(us("window_start"), "label", "requests", F.round("rate", 6).alias("rate"))


RATIO = """,
w AS (SELECT cache_hit, unnest(range(0, 5)) AS i, us FROM requests),
p AS (SELECT cache_hit, (us // 60000000 - i) * 60000000 AS window_start FROM w)
SELECT window_start, count(*) AS requests, count(*) FILTER (cache_hit) AS hits, round(count(*) FILTER (cache_hit) / count(*), 6) AS ratio FROM p GROUP BY window_start"""


@query("cache_ratio_5m", with_sql("requests", rest=RATIO))
def cache_ratio_5m(spark, sf):
    r = tel.hit_ratio(requests(spark, sf), "ts", "cache_hit")
    return r.select(us("window_start"), "requests", "hits", F.round("ratio", 6).alias("ratio"))


@query("cache_ratio_stream", with_sql("requests", rest=RATIO))
def cache_ratio_stream(spark, sf):
    r = jobs.run(jobs.hit_ratio(request_stream(spark, sf)), "hit-ratio", ["window_start"])
    return r.select(us("window_start"), "requests", "hits", F.round("ratio", 6).alias("ratio"))


@query("latency_p95", with_sql("requests", rest=" SELECT label, us // 86400000000 AS day, round(quantile_cont(latency, 0.95), 6) AS p95 FROM requests GROUP BY ALL"))
def latency_p95(spark, sf):
    r = requests(spark, sf).withColumn("day", F.floor(F.col("us") / DAY_US).cast("long"))
    return tel.latency_p95(r, ["label", "day"], "latency").withColumn("p95", F.round("p95", 6))


@query("latency_p95_stream", with_sql("requests", rest=" SELECT us // 86400000000 * 86400000000 AS window_start, label, quantile_disc(latency, 0.95) AS p95 FROM requests GROUP BY ALL"))
def latency_p95_stream(spark, sf):
    counts = jobs.run(jobs.latency_counts(request_stream(spark, sf), "1 day"), "p95", ["window_start", "label", "latency"])
    r = jobs.latency_p95(counts)
    return r.select(us("window_start"), "label", "p95")


@query(
    "latency_buckets",
    with_sql("requests", rest=f""",
b AS (SELECT unnest([{", ".join(map(str, tel.LATENCY_BOUNDS))}, 'Infinity'::DOUBLE]::DOUBLE[]) AS le)
SELECT label, CASE WHEN isinf(le) THEN '+Inf' ELSE le::VARCHAR END AS le, count(*) FILTER (latency / 10 <= le) AS n FROM requests, b GROUP BY label, b.le"""),
)
def latency_buckets(spark, sf):
    return tel.latency_buckets(requests(spark, sf).withColumn("latency", F.col("latency") / 10), "label", "latency")


@query("gauge_latest", with_sql("requests", rest=" SELECT label, arg_max(latency, (ts, event_id)) AS value FROM requests GROUP BY label"))
def gauge_latest(spark, sf):
    return tel.latest_gauge(requests(spark, sf), "label", "ts", "event_id", "latency")


CANARY = """,
p AS (SELECT experiment_id, error, (us // 30000000 - unnest(range(0, 10))) * 30000000 AS window_start FROM requests),
g AS (SELECT experiment_id, window_start, count(*) AS requests, count(*) FILTER (error) / (count(*) + 0.0001) AS error_rate FROM p GROUP BY ALL)"""


STOPPED = """,
f AS (SELECT *, sum((error_rate > 0.01)::INT) OVER (PARTITION BY experiment_id ORDER BY window_start)::BIGINT AS failures FROM g)
SELECT experiment_id, window_start, requests, round(error_rate, 6) AS error_rate, failures, failures >= 3 AS aborted FROM f"""


@query(
    "canary_error_rate",
    with_sql("requests", rest=CANARY + STOPPED),
)
def canary_error_rate(spark, sf):
    c = tel.canary(requests(spark, sf), "experiment_id", "ts", "error")
    return c.select("experiment_id", us("window_start"), "requests", F.round("error_rate", 6).alias("error_rate"), "failures", "aborted")


@query("canary_stream", with_sql("requests", rest=CANARY + STOPPED))
def canary_stream(spark, sf):
    """Rates from the stream; failures and the stop from its table of windows."""
    r = jobs.run(jobs.error_rate(request_stream(spark, sf)), "canary", ["experiment_id", "window_start"])
    r = tel.stopped(r, "experiment_id")
    return r.select("experiment_id", us("window_start"), "requests", F.round("error_rate", 6).alias("error_rate"), "failures", "aborted")


# Windows that the watermark, ten minutes behind the newest event, has passed.
CLOSED = """,
edge AS (SELECT (max(us) // 1000 - 600000) * 1000 AS passed FROM requests),
f AS (SELECT g.*, row_number() OVER (PARTITION BY experiment_id ORDER BY window_start) AS failures FROM g, edge
  WHERE error_rate > 0.01 AND window_start + 300000000 <= passed)
SELECT experiment_id, window_start, round(error_rate, 6) AS error_rate, failures FROM f WHERE failures = 3"""


@query("canary_stop_stream", with_sql("requests", rest=CANARY + CLOSED))
def canary_stop_stream(spark, sf):
    """The stop event of every experiment, given while the stream runs."""
    r = jobs.run(stateful.canary_stop(jobs.error_rate(request_stream(spark, sf)), tel.CANARY_LIMIT, tel.CANARY_FAILURES), "canary-stop")
    return r.select("experiment_id", us("window_start"), F.round("error_rate", 6).alias("error_rate"), "failures")


STATUS = " SELECT source_type, CASE WHEN byte_size > 2000 THEN 'completed' ELSE 'failed' END AS status, count(*) AS documents FROM envelope GROUP BY ALL"


def with_status(docs):
    return docs.select("source_type", F.when(F.col("byte_size") > 2000, "completed").otherwise("failed").alias("status"))


@query("status_counts", with_sql("envelope", rest=STATUS))
def status_counts(spark, sf):
    return tel.status_counts(with_status(inputs.envelope(spark, sf)))


@query("status_counts_stream", with_sql("envelope", rest=STATUS))
def status_counts_stream(spark, sf):
    docs = inputs.envelope(spark, sf, jobs.file_source(spark, sf, "documents"))
    return jobs.run(jobs.status_counts(with_status(docs)), "status", ["source_type", "status"])


@query(
    "ab_stream",
    with_sql("requests", rest=LIVE + " SELECT experiment_id, variant, CASE WHEN error THEN '500' ELSE '200' END AS status, count(*) AS requests, round(avg(latency), 6) AS mean_latency FROM live GROUP BY ALL"),
)
def ab_stream(spark, sf):
    from docspark.operators.experiments import assign_variant

    r = request_stream(spark, sf)
    live = r.withColumn("variant", assign_variant(F.concat(F.lit("req-"), F.col("event_id").cast("string")), F.lit(0.5)))
    out = jobs.run(jobs.variant_metrics(live), "variants", ["experiment_id", "variant", "status"])
    return out.withColumn("mean_latency", F.round("mean_latency", 6))
