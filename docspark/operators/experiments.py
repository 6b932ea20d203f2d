"""A/B and shadow experiments, run comparison and model gates. Decisions are columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import hashing, stats
from docspark.operators.evaluate import rouge_l
from docspark.operators.ordered import percentiles

# Fixed values of the decision rules.
MIN_SAMPLES = 10
ROLLBACK_FACTOR, ROLLBACK_FLOOR = 1.5, 0.01
SHADOW_ROUGE = 0.40
RAMP_STEP, RAMP_CAP, RAMP_HOURS = 0.05, 0.50, 2
DRIFT_LIMIT, LABEL_LIMIT = 0.15, 500


def assign_variant(request_id: Column, ratio: Column, mode: Column | None = None) -> Column:
    """B for the share ``ratio`` of request ids by digest, the rest A (ABT1)."""
    live = F.lit(True) if mode is None else F.coalesce(mode != "shadow", F.lit(False))
    share = hashing.md5_mod(request_id) / F.lit(10000.0)
    return F.when(live & (share < F.coalesce(ratio, F.lit(0.0))), "B").otherwise("A")


def active_experiment(configs: DataFrame) -> DataFrame:
    """The running experiment started last (ABT2)."""
    return configs.where(F.col("status") == "running").orderBy(F.desc("start_time"), "experiment_id").limit(1)


def upsert_experiments(configs: DataFrame, updates: DataFrame) -> DataFrame:
    """New settings win; start time and shadow hours of a known experiment stay (ABT3)."""
    ratio = F.when(F.col("mode") == "shadow", 0.0).otherwise(F.col("split_ratio"))
    both = configs.withColumn("_gen", F.lit(0)).unionByName(updates.withColumn("split_ratio", ratio).withColumn("_gen", F.lit(1)))
    kept = ["start_time", "shadow_duration_hours"]
    newest = [c for c in configs.columns if c not in ("experiment_id", *kept)]
    picked = both.groupBy("experiment_id").agg(
        F.max_by(F.struct(*newest), "_gen").alias("n"), F.min_by(F.struct(*kept), "_gen").alias("o")
    )
    return picked.select("experiment_id", "n.*", "o.*").select(*configs.columns)


def enrich_shadow(log: DataFrame) -> DataFrame:
    """Adds how close the challenger's answer is to the current one (ABT4)."""
    return log.withColumn("rouge_l", rouge_l(F.col("response_b"), F.col("response_a")))


def evaluate_shadow(log: DataFrame) -> DataFrame:
    """Promotion decision per experiment over enriched shadow rows (ABT5)."""
    names = {f"p{int(p * 100)}_{s}": (f"latency_{s}", p) for s in "ab" for p in (0.5, 0.95, 0.99)}
    wanted: dict[str, dict[str, float]] = {}
    for out, (col, p) in names.items():
        wanted.setdefault(col, {})[out] = p
    lat = percentiles(log, ["experiment_id"], wanted)
    means = log.groupBy("experiment_id").agg(
        F.avg("confidence_a").alias("confidence_a"), F.avg("confidence_b").alias("confidence_b"),
        F.avg("rouge_l").alias("rouge_l"),
    )
    j = lat.join(means, "experiment_id")
    fast = (F.col("p50_b") <= F.col("p50_a")) & (F.col("p95_b") <= F.col("p95_a")) & (F.col("p99_b") <= F.col("p99_a"))
    win = fast & (F.col("confidence_b") >= F.col("confidence_a")) & (F.col("rouge_l") >= SHADOW_ROUGE)
    return j.select(
        "experiment_id",
        *((F.col(f"{p}_b") - F.col(f"{p}_a")).alias(f"{p}_latency_diff") for p in ("p50", "p95", "p99")),
        (F.col("confidence_b") - F.col("confidence_a")).alias("avg_confidence_diff"),
        F.col("rouge_l").alias("avg_rouge_l"),
        F.when(win, "B").otherwise("A").alias("winner"),
        F.when(win, 1.0).otherwise(0.0).alias("confidence"),
        F.when(win, "promoted").otherwise("completed").alias("status"),
    )


def live_summary(rows: DataFrame) -> DataFrame:
    """Counts, error rates, latency and hit rate of both variants per experiment (ABT6)."""
    aggs = []
    for v in "AB":
        on = F.col("variant") == v
        low = v.lower()
        aggs += [
            F.count(F.when(on, 1)).alias(f"n_{low}"),
            F.count(F.when(on & F.col("error"), 1)).alias(f"errors_{low}"),
            F.avg(F.when(on, F.col("latency"))).alias(f"latency_avg_{low}"),
            F.avg(F.when(on, F.col("cache_hit").cast("double"))).alias(f"cache_hit_{low}"),
        ]
    s = rows.groupBy("experiment_id").agg(*aggs)
    for low in "ab":
        s = s.withColumn(f"error_rate_{low}", F.col(f"errors_{low}") / F.nullif(F.col(f"n_{low}"), F.lit(0)))
    return s


def regressed() -> Column:
    """B fails clearly more often than A (ABT7)."""
    b, a = F.col("error_rate_b"), F.col("error_rate_a")
    return F.coalesce((b > a * ROLLBACK_FACTOR) & (b > ROLLBACK_FLOOR), F.lit(False))


def z_statistic() -> Column:
    """Pooled two-proportion z of success rates; 0 when nothing or everything failed (ABT8)."""
    n_a, n_b = F.col("n_a"), F.col("n_b")
    ok_a, ok_b = n_a - F.col("errors_a"), n_b - F.col("errors_b")
    pooled = (ok_a + ok_b) / (n_a + n_b)
    se = F.sqrt(pooled * (1 - pooled) * (1 / n_a + 1 / n_b))
    return F.when((pooled > 0) & (pooled < 1), (ok_b / n_b - ok_a / n_a) / se).otherwise(F.lit(0.0))


def evaluate_live(rows: DataFrame) -> DataFrame:
    """Rollback rule first, then the z-test; small samples give no result (ABT6-8)."""
    s = live_summary(rows).where((F.col("n_a") >= MIN_SAMPLES) & (F.col("n_b") >= MIN_SAMPLES))
    s = s.withColumn("rolled_back", regressed()).withColumn("z_statistic", z_statistic())
    s = s.withColumn("p_value", stats.normal_two_sided("z_statistic"))
    sure = F.col("p_value") < 0.05
    better = F.col("z_statistic") > 0
    winner = F.when(F.col("rolled_back"), "A").when(sure & better, "B").when(sure & (F.col("z_statistic") < 0), "A")
    status = (
        F.when(F.col("rolled_back"), "rolled_back").when(sure & better, "promoted").when(winner.isNotNull(), "completed")
        .otherwise("running")
    )
    conf = F.when(F.col("rolled_back"), 1.0).when(winner.isNotNull(), 1 - F.col("p_value"))
    return s.withColumn("winner", winner).withColumn("status", status).withColumn("confidence", conf)


def ramp(configs: DataFrame, summary: DataFrame, now: Column) -> DataFrame:
    """Next split ratio per experiment (ABT9)."""
    j = configs.join(summary, "experiment_id", "left")
    elapsed = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_update_time").cast("timestamp"))
    inactive = (F.col("status") != "running") | (F.col("mode") == "shadow")
    ratio = (
        F.when(inactive, 0.0)
        .when(elapsed < RAMP_HOURS * 3_600_000_000, F.col("split_ratio"))
        .when(regressed(), 0.0)
        .otherwise(F.least(F.lit(RAMP_CAP), F.col("split_ratio") + RAMP_STEP))
    )
    return j.select("experiment_id", "split_ratio", ratio.alias("next_ratio"))


def transition_status(configs: DataFrame, changes: DataFrame) -> DataFrame:
    """New status where one is given; a rollback also clears the split (ABT7, ABT10)."""
    new = changes.select("experiment_id", F.col("status").alias("_new"))
    j = configs.join(new, "experiment_id", "left")
    status = F.coalesce("_new", "status")
    return j.select(
        *(c for c in configs.columns if c not in ("status", "split_ratio")),
        F.when(F.col("_new") == "rolled_back", 0.0).otherwise(F.col("split_ratio")).alias("split_ratio"),
        status.alias("status"),
    ).select(*configs.columns)


def lower_is_better(metric: Column) -> Column:
    return F.lower(metric).rlike("loss|error|hallucination")


def compare_runs(metrics: DataFrame, runs: list[tuple[str, str]]) -> DataFrame:
    """A row per metric, a column per run, and the best run (RUN1).

    ``metrics`` (run_id, metric, value); ``runs`` lists (run_id, name) in comparison order, so an
    equal value stays with the earlier run.
    """
    column = {r: f"{n or r[:8]} ({r[:8]})" for r, n in runs}
    order = F.array_position(F.array(*(F.lit(r) for r, _ in runs)), F.col("run_id"))
    value = F.when(lower_is_better(F.col("metric")), -F.col("value")).otherwise(F.col("value"))
    title = F.element_at(F.create_map(*(F.lit(x) for kv in column.items() for x in kv)), F.col("run_id"))
    picked = metrics.where(F.col("run_id").isin([r for r, _ in runs]))
    per = [F.max(F.when(F.col("run_id") == r, F.col("value"))).alias(c) for r, c in column.items()]
    best = F.max_by(title, F.when(F.col("value").isNotNull(), F.struct(value, -order)))
    return picked.groupBy("metric").agg(*per, F.coalesce(best, F.lit("N/A")).alias("best_run"))


def _first(metrics: Column, names: list[str]) -> Column:
    return F.coalesce(*(F.try_element_at(metrics, F.lit(n)) for n in names))


def staging_gate(metrics: Column) -> Column:
    """All metrics that are present pass, and at least one is (RUN2)."""
    f1 = _first(metrics, ["classifier_f1", "f1"])
    rouge = _first(metrics, ["rag_rouge_l", "rouge_l", "ROUGE-L"])
    bad = _first(metrics, ["hallucination_rate"])
    any_set = f1.isNotNull() | rouge.isNotNull() | bad.isNotNull()
    ok = (
        F.coalesce(f1 > 0.85, F.lit(True)) & F.coalesce(rouge > 0.40, F.lit(True)) & F.coalesce(bad < 0.05, F.lit(True))
    )
    return any_set & ok


def production_gate(candidate: Column, production: Column) -> Column:
    """Better than production on F1 or ROUGE; anything passes without a production model (RUN3)."""
    f1 = F.coalesce(_first(candidate, ["f1"]), F.lit(0.0))
    rouge = F.coalesce(_first(candidate, ["rouge_l"]), F.lit(0.0))
    p_f1 = F.coalesce(_first(production, ["f1", "classifier_f1"]), F.lit(0.0))
    p_rouge = F.coalesce(_first(production, ["rouge_l", "rag_rouge_l"]), F.lit(0.0))
    return production.isNull() | ~((f1 <= p_f1) & (rouge <= p_rouge))


def retraining_triggers(drift_score: Column, new_labels: Column) -> tuple[Column, Column]:
    return drift_score > DRIFT_LIMIT, new_labels > LABEL_LIMIT


def stage_history(versions: DataFrame) -> DataFrame:
    """Stage of every version (model, version, promoted): the newest promoted one is in
    production, earlier promoted ones are archived (RUN5)."""
    newest = versions.where("promoted").groupBy("model").agg(F.max("version").alias("_top"))
    j = versions.join(newest, "model", "left")
    stage = (
        F.when(F.col("promoted") & (F.col("version") == F.col("_top")), "Production")
        .when(F.col("promoted"), "Archived").otherwise("None")
    )
    return j.select("model", "version", "promoted", stage.alias("stage"))


def latest_results(results: DataFrame) -> DataFrame:
    """One result per experiment, the last written; at one time the greatest of the other columns (SNK5)."""
    others = [F.desc(c) for c in results.columns if c not in ("experiment_id", "written_at")]
    w = Window.partitionBy("experiment_id").orderBy(F.desc("written_at"), *others)
    return results.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
