"""Experiment, run-comparison and model-gate queries over ``events`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark import inputs
from docspark.inputs import with_sql
from docspark.operators import experiments as exp
from docspark.operators import telemetry
from docspark.plans import query
from docspark.plans.decisions import ROUGE, ascii_words_sql


def md5_mod_sql(t: str) -> str:
    """The digest as a number modulo 10000, by 16-bit pieces."""
    pieces = " + ".join(
        f"CAST('0x' || substr(md5({t}), {1 + 4 * i}, 4) AS BIGINT) * {pow(65536, 7 - i, 10000)}" for i in range(8)
    )
    return f"(({pieces}) % 10000)"


LIVE = f""",
live AS (SELECT *, CASE WHEN {md5_mod_sql("'req-' || event_id")} / 10000.0 < 0.5 THEN 'B' ELSE 'A' END AS variant FROM requests)"""


def live_rows(spark, sf):
    r = telemetry.request_columns(inputs.table(spark, sf, "events"))
    request = F.concat(F.lit("req-"), F.col("event_id").cast("string"))
    return r.withColumn("variant", exp.assign_variant(request, F.lit(0.5)))


@query(
    "ab_assign",
    with_sql("requests", rest=LIVE + " SELECT event_id, variant FROM live"),
)
def ab_assign(spark, sf):
    return live_rows(spark, sf).select("event_id", "variant")


SUMMARY = """,
summary AS (
  SELECT experiment_id, count(*) FILTER (variant = 'A') AS n_a, count(*) FILTER (variant = 'B') AS n_b,
    count(*) FILTER (variant = 'A' AND error) AS errors_a, count(*) FILTER (variant = 'B' AND error) AS errors_b,
    avg(latency) FILTER (variant = 'A') AS latency_avg_a, avg(latency) FILTER (variant = 'B') AS latency_avg_b,
    avg(cache_hit::INT) FILTER (variant = 'A') AS cache_hit_a, avg(cache_hit::INT) FILTER (variant = 'B') AS cache_hit_b FROM live GROUP BY experiment_id),
rates AS (SELECT *, errors_a / n_a AS error_rate_a, errors_b / n_b AS error_rate_b FROM summary)"""


@query(
    "ab_live_summary",
    with_sql("requests", rest=LIVE + SUMMARY + """ SELECT experiment_id, n_a, n_b, errors_a, errors_b, round(latency_avg_a, 6) AS latency_avg_a, round(latency_avg_b, 6) AS latency_avg_b,
  round(cache_hit_a, 6) AS cache_hit_a, round(cache_hit_b, 6) AS cache_hit_b FROM rates"""),
)
def ab_live_summary(spark, sf):
    s = exp.live_summary(live_rows(spark, sf))
    return s.select("experiment_id", "n_a", "n_b", "errors_a", "errors_b", *(F.round(c, 6).alias(c) for c in ("latency_avg_a", "latency_avg_b", "cache_hit_a", "cache_hit_b")))


@query(
    "ab_rollback",
    with_sql("requests", rest=LIVE + SUMMARY + """ SELECT experiment_id, coalesce(error_rate_b > error_rate_a * 1.5 AND error_rate_b > 0.01, false) AS rolled_back,
  round(error_rate_a, 6) AS error_rate_a, round(error_rate_b, 6) AS error_rate_b FROM rates"""),
)
def ab_rollback(spark, sf):
    s = exp.live_summary(live_rows(spark, sf))
    return s.select("experiment_id", exp.regressed().alias("rolled_back"), F.round("error_rate_a", 6).alias("error_rate_a"), F.round("error_rate_b", 6).alias("error_rate_b"))


@query(
    "ab_ztest",
    with_sql("requests", rest=LIVE + SUMMARY + """,
pooled AS (SELECT *, (n_a - errors_a + n_b - errors_b) / (n_a + n_b) AS p FROM rates WHERE n_a >= 10 AND n_b >= 10),
z AS (SELECT *, CASE WHEN p > 0 AND p < 1 THEN ((n_b - errors_b) / n_b - (n_a - errors_a) / n_a) / sqrt(p * (1 - p) * (1 / n_a + 1 / n_b)) ELSE 0 END AS z,
  coalesce(error_rate_b > error_rate_a * 1.5 AND error_rate_b > 0.01, false) AS rolled FROM pooled)
SELECT experiment_id, round(z, 6) AS z_statistic, abs(z) > 1.959964 AS significant,
  CASE WHEN rolled THEN 'A' WHEN z > 1.959964 THEN 'B' WHEN z < -1.959964 THEN 'A' END AS winner,
  CASE WHEN rolled THEN 'rolled_back' WHEN z > 1.959964 THEN 'promoted' WHEN z < -1.959964 THEN 'completed' ELSE 'running' END AS status FROM z"""),
)
def ab_ztest(spark, sf):
    e = exp.evaluate_live(live_rows(spark, sf))
    return e.select("experiment_id", F.round("z_statistic", 6).alias("z_statistic"), (F.col("p_value") < 0.05).alias("significant"), "winner", "status")


CONFIGS = """,
configs AS (
  SELECT experiment_id, min(ts) AS start_time, CASE experiment_id WHEN 'exp4' THEN 'shadow' ELSE 'live' END AS mode,
    CASE experiment_id WHEN 'exp3' THEN 'completed' ELSE 'running' END AS status, (0.1::DOUBLE + 0.12::DOUBLE * substr(experiment_id, 4)::INT) AS split_ratio,
    24 AS shadow_duration_hours, max(ts) - to_hours(substr(experiment_id, 4)::BIGINT) AS last_update_time FROM requests GROUP BY experiment_id)"""


def configs(spark, sf):
    """A configuration per experiment, from its first and last request."""
    r = telemetry.request_columns(inputs.table(spark, sf, "events"))
    n = F.substring("experiment_id", 4, 9).cast("int")
    g = r.groupBy("experiment_id").agg(F.min("ts").alias("start_time"), F.max("ts").alias("last"))
    return g.select(
        "experiment_id", "start_time",
        F.when(F.col("experiment_id") == "exp4", "shadow").otherwise("live").alias("mode"),
        F.when(F.col("experiment_id") == "exp3", "completed").otherwise("running").alias("status"),
        (n * 0.12 + 0.1).alias("split_ratio"), F.lit(24).alias("shadow_duration_hours"),
        (F.col("last") - F.make_dt_interval(hours=n)).alias("last_update_time"),
    )


@query(
    "ab_active",
    with_sql("requests", rest=CONFIGS + " SELECT experiment_id, mode FROM configs WHERE status = 'running' ORDER BY start_time DESC, experiment_id LIMIT 1"),
)
def ab_active(spark, sf):
    return exp.active_experiment(configs(spark, sf)).select("experiment_id", "mode")


@query(
    "ab_ramp",
    with_sql("requests", rest=LIVE + SUMMARY + CONFIGS + """
SELECT experiment_id, round(split_ratio, 4) AS split_ratio, round(CASE WHEN status <> 'running' OR mode = 'shadow' THEN 0.0
  WHEN (SELECT max(ts) FROM requests) - last_update_time < INTERVAL 2 HOUR THEN split_ratio
  WHEN coalesce(error_rate_b > error_rate_a * 1.5 AND error_rate_b > 0.01, false) THEN 0.0 ELSE least(0.5, split_ratio + 0.05) END, 4) AS next_ratio FROM configs JOIN rates USING (experiment_id)"""),
)
def ab_ramp(spark, sf):
    rows = live_rows(spark, sf)
    r = exp.ramp(configs(spark, sf), exp.live_summary(rows), rows.agg(F.max("ts")).scalar())
    return r.select("experiment_id", F.round("split_ratio", 4).alias("split_ratio"), F.round("next_ratio", 4).alias("next_ratio"))


@query(
    "ab_upsert",
    with_sql("requests", rest=CONFIGS + """
SELECT experiment_id, 'shadow' AS mode, 0.0::DOUBLE AS split_ratio, epoch_us(start_time) AS started_us, 24 AS shadow_duration_hours FROM configs WHERE experiment_id IN ('exp0', 'exp1')
UNION ALL SELECT experiment_id, mode, round(split_ratio, 4), epoch_us(start_time), 24 FROM configs WHERE experiment_id NOT IN ('exp0', 'exp1')
UNION ALL SELECT experiment_id || 'x', 'shadow', 0.0, epoch_us(start_time + INTERVAL 1 HOUR), 48 FROM configs WHERE experiment_id = 'exp2'"""),
)
def ab_upsert(spark, sf):
    base = configs(spark, sf)
    known = F.col("experiment_id").isin("exp0", "exp1")
    upd = base.where(known | (F.col("experiment_id") == "exp2")).select(
        F.when(known, F.col("experiment_id")).otherwise(F.concat("experiment_id", F.lit("x"))).alias("experiment_id"),
        (F.col("start_time") + F.expr("INTERVAL 1 HOUR")).alias("start_time"), F.lit("shadow").alias("mode"), "status",
        "split_ratio", F.lit(48).alias("shadow_duration_hours"), "last_update_time",
    )
    m = exp.upsert_experiments(base, upd)
    return m.select("experiment_id", "mode", F.round("split_ratio", 4).alias("split_ratio"),
                    F.unix_micros(F.col("start_time").cast("timestamp")).alias("started_us"), "shadow_duration_hours")


@query(
    "ab_status",
    with_sql("requests", rest=LIVE + SUMMARY + CONFIGS + """,
done AS (SELECT experiment_id, CASE WHEN error_rate_b > error_rate_a THEN 'rolled_back' END AS new_status FROM rates)
SELECT experiment_id, coalesce(new_status, status) AS status, CASE WHEN new_status = 'rolled_back' THEN 0.0 ELSE round(split_ratio, 4) END AS split_ratio FROM configs LEFT JOIN done USING (experiment_id)"""),
)
def ab_status(spark, sf):
    s = exp.live_summary(live_rows(spark, sf)).where(F.col("error_rate_b") > F.col("error_rate_a"))
    changes = s.select("experiment_id", F.lit("rolled_back").alias("status"))
    t = exp.transition_status(configs(spark, sf), changes)
    return t.select("experiment_id", "status", F.round("split_ratio", 4).alias("split_ratio"))


# Answer pairs with latencies and confidences from their lengths; the overlap stands in for ROUGE
# in the SQL twin, which cannot align sequences.
SHADOW = f""",
pairs AS (
  SELECT 'exp' || (conv_id % 3) AS experiment_id, length(a) / 1000.0::DOUBLE AS latency_a, length(b) / 1100.0::DOUBLE AS latency_b,
    (length(a) % 50) / 100.0::DOUBLE AS confidence_a, (length(b) % 60) / 100.0::DOUBLE AS confidence_b,
    list_distinct({ascii_words_sql("b")}) AS p, list_distinct({ascii_words_sql("a")}) AS r FROM answers),
shadow AS (SELECT *, CASE WHEN len(list_intersect(p, r)) > 0 THEN round(0.5 + 2.0::DOUBLE * len(list_intersect(p, r)) / (len(p) + len(r)) * 0.5, 4) ELSE 0.0 END AS rouge_l FROM pairs),
ev AS (
  SELECT experiment_id, quantile_cont(latency_a, 0.5) AS a50, quantile_cont(latency_a, 0.95) AS a95, quantile_cont(latency_a, 0.99) AS a99,
    quantile_cont(latency_b, 0.5) AS b50, quantile_cont(latency_b, 0.95) AS b95, quantile_cont(latency_b, 0.99) AS b99,
    avg(confidence_a) AS ca, avg(confidence_b) AS cb, avg(rouge_l) AS rl FROM shadow GROUP BY experiment_id),
ok AS (SELECT *, b50 <= a50 AND b95 <= a95 AND b99 <= a99 AND cb >= ca AND rl >= 0.40 AS win FROM ev)"""


@query(
    "ab_shadow_eval",
    with_sql("answers", rest=SHADOW + """ SELECT experiment_id, round(b50 - a50, 6) AS p50_latency_diff, round(b95 - a95, 6) AS p95_latency_diff, round(b99 - a99, 6) AS p99_latency_diff,
  round(cb - ca, 6) AS avg_confidence_diff, CASE WHEN win THEN 'B' ELSE 'A' END AS winner, CASE WHEN win THEN 'promoted' ELSE 'completed' END AS status FROM ok"""),
)
def ab_shadow_eval(spark, sf):
    from docspark.operators.evaluate import token_overlap

    a = inputs.answers(spark, sf)
    n_a, n_b = F.char_length("a"), F.char_length("b")
    log = a.select(
        F.concat(F.lit("exp"), (F.col("conv_id") % 3).cast("string")).alias("experiment_id"),
        (n_a / 1000.0).alias("latency_a"), (n_b / 1100.0).alias("latency_b"), ((n_a % 50) / 100.0).alias("confidence_a"),
        ((n_b % 60) / 100.0).alias("confidence_b"), token_overlap(F.col("b"), F.col("a")).alias("rouge_l"),
    )
    e = exp.evaluate_shadow(log)
    return e.select("experiment_id", *(F.round(c, 6).alias(c) for c in ("p50_latency_diff", "p95_latency_diff", "p99_latency_diff", "avg_confidence_diff")), "winner", "status")


@query("ab_shadow_log", with_sql("answers", rest=ROUGE, recursive=True))
def ab_shadow_log(spark, sf):
    log = inputs.answers(spark, sf).select("conv_id", "turn", F.col("a").alias("response_a"), F.col("b").alias("response_b"))
    return exp.enrich_shadow(log).select("conv_id", "turn", "rouge_l")


RUNS = [("run-signup-01", "signup"), ("run-error-02", "error"), ("run-click-03", "click"), ("run-view-04", "view"), ("run-purchase-05", "purchase")]
RUN_SQL = " ".join(f"WHEN '{name}' THEN '{rid}'" for rid, name in RUNS)
METRICS = f""",
runs AS (SELECT CASE label {RUN_SQL} END AS run_id, * FROM requests),
metrics AS (
  SELECT run_id, unnest(['f1', 'value_loss', 'hallucination_rate', 'requests']) AS metric,
    unnest([avg(cache_hit::INT), stddev_samp(latency), avg((latency > 100)::INT), count(*)::DOUBLE]) AS value FROM runs GROUP BY run_id)"""


def run_metrics(spark, sf):
    """Long metrics of one run per event type."""
    r = telemetry.request_columns(inputs.table(spark, sf, "events"))
    ids = F.create_map(*(F.lit(x) for rid, name in RUNS for x in (name, rid)))
    g = r.groupBy(ids[F.col("label")].alias("run_id")).agg(
        F.avg(F.col("cache_hit").cast("int")).alias("f1"), F.stddev_samp("latency").alias("value_loss"),
        F.avg((F.col("latency") > 100).cast("int")).alias("hallucination_rate"), F.count("*").cast("double").alias("requests"),
    )
    return g.unpivot(["run_id"], ["f1", "value_loss", "hallucination_rate", "requests"], "metric", "value")


@query(
    "run_compare",
    with_sql("requests", rest=METRICS + f""",
names AS (SELECT *, CASE label_of WHEN '' THEN '' ELSE label_of || ' (' || left(run_id, 8) || ')' END AS title FROM (
  SELECT *, CASE run_id {" ".join(f"WHEN '{rid}' THEN '{name}'" for rid, name in RUNS)} END AS label_of, CASE run_id {" ".join(f"WHEN '{rid}' THEN {i}" for i, (rid, _) in enumerate(RUNS))} END AS ord FROM metrics)),
best AS (SELECT metric, title AS best_run FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN regexp_matches(metric, 'loss|error|hallucination') THEN value ELSE -value END, ord) AS rn FROM names) WHERE rn = 1)
SELECT metric, {", ".join(f"round(max(value) FILTER (run_id = '{rid}'), 6) AS {name}" for rid, name in RUNS)}, any_value(best_run) AS best_run FROM names JOIN best USING (metric) GROUP BY metric"""),
)
def run_compare(spark, sf):
    c = exp.compare_runs(run_metrics(spark, sf), RUNS)
    return c.select("metric", *(F.round(f"`{name} ({rid[:8]})`", 6).alias(name) for rid, name in RUNS), "best_run")


GATE = """,
models AS (
  SELECT api_key AS model, count(*) FILTER (NOT error) / count(*) AS f1, count(*) FILTER (cache_hit) / count(*) AS rouge_l, count(*) FILTER (latency > 200) / count(*) AS hallucination_rate, count(*) AS n FROM requests GROUP BY api_key)"""


def models(spark, sf):
    """A model version per client with metrics from its requests; some metrics are missing."""
    r = telemetry.request_columns(inputs.table(spark, sf, "events"))
    g = r.groupBy(F.col("api_key").alias("model")).agg(
        (F.count(F.when(~F.col("error"), 1)) / F.count("*")).alias("f1"),
        (F.count(F.when(F.col("cache_hit"), 1)) / F.count("*")).alias("rouge_l"),
        (F.count(F.when(F.col("latency") > 200, 1)) / F.count("*")).alias("hallucination_rate"),
        F.count("*").alias("n"),
    )
    return g


@query(
    "staging_gate",
    with_sql("requests", rest=GATE + """ SELECT model, (model % 3 = 0 OR f1 > 0.85) AND (model % 2 = 0 OR rouge_l > 0.40) AND hallucination_rate < 0.05 AS eligible FROM models"""),
)
def staging_gate(spark, sf):
    m = models(spark, sf)
    entry = lambda name, when: F.when(when, F.struct(F.lit(name).alias("k"), F.col(name).alias("v")))
    kept = F.array_compact(
        F.array(entry("f1", F.col("model") % 3 != 0), entry("rouge_l", F.col("model") % 2 != 0), entry("hallucination_rate", F.lit(True)))
    )
    return m.select("model", exp.staging_gate(F.map_from_entries(kept)).alias("eligible"))


@query(
    "production_gate",
    with_sql("requests", rest=GATE + """ SELECT c.model, p.model IS NULL OR NOT (c.f1 <= p.f1 AND c.rouge_l <= p.rouge_l) AS improved FROM models c LEFT JOIN models p ON p.model = c.model - 10"""),
)
def production_gate(spark, sf):
    m = models(spark, sf)
    metrics = F.create_map(F.lit("f1"), F.col("f1"), F.lit("rouge_l"), F.col("rouge_l"))
    cand = m.select("model", metrics.alias("candidate"))
    prod = m.select((F.col("model") + 10).alias("model"), metrics.alias("production"))
    return cand.join(prod, "model", "left").select("model", exp.production_gate(F.col("candidate"), F.col("production")).alias("improved"))


@query(
    "retrain_triggers",
    """WITH l AS (SELECT source, count(l.doc_id) AS n, avg(quality) AS q FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source)
SELECT source, n AS new_labels, coalesce(1 - q, 0) > 0.15 AS drifted, n > 500 AS enough_labels FROM l""",
)
def retrain_triggers(spark, sf):
    d = inputs.table(spark, sf, "documents").select("doc_id", "source")
    l = inputs.table(spark, sf, "labels").select("doc_id", "quality", F.lit(1).alias("hit"))
    g = d.join(l, "doc_id", "left").groupBy("source").agg(F.count("hit").alias("new_labels"), F.avg("quality").alias("q"))
    drifted, enough = exp.retraining_triggers(F.coalesce(1 - F.col("q"), F.lit(0.0)), F.col("new_labels"))
    return g.select("source", "new_labels", drifted.alias("drifted"), enough.alias("enough_labels"))


@query(
    "stage_history",
    """WITH v AS (SELECT user_id AS model, event_id AS version, event_type = 'purchase' AS promoted FROM events),
t AS (SELECT model, max(version) AS top FROM v WHERE promoted GROUP BY model)
SELECT model, version, promoted, CASE WHEN promoted AND version = top THEN 'Production' WHEN promoted THEN 'Archived' ELSE 'None' END AS stage FROM v LEFT JOIN t USING (model)""",
)
def stage_history(spark, sf):
    e = inputs.table(spark, sf, "events")
    return exp.stage_history(e.select(F.col("user_id").alias("model"), F.col("event_id").alias("version"), (F.col("event_type") == "purchase").alias("promoted")))


@query(
    "ab_results_latest",
    with_sql("requests", rest=""" SELECT experiment_id, arg_max(label, event_id) AS winner, max(event_id) AS written_at FROM requests GROUP BY experiment_id"""),
)
def ab_results_latest(spark, sf):
    r = telemetry.request_columns(inputs.table(spark, sf, "events"))
    return exp.latest_results(r.select("experiment_id", F.col("label").alias("winner"), F.col("event_id").alias("written_at")))
