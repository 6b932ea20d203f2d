"""Entities, votes, evaluation, drift, experiments, telemetry and sources."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from docspark.functions import stats
from docspark.operators import classify, drift, entities, evaluate, experiments, telemetry
from docspark.operators.ordered import percentiles
from docspark.sources import documents
from docspark.streaming import jobs, stateful


def test_regex_entities(spark):
    t = "Ref INV-987654 and CON-112233-44 on 2026-06-18 for $12500.50."
    r = spark.createDataFrame([(t,)], "t string").select(entities.regex_entities(F.col("t")).alias("e")).first().e
    assert [(x.label, x.text) for x in r] == [("CONTRACT_ID", "CON-112233-44"), ("INVOICE_NO", "INV-987654"), ("MONEY", "$12500.50"), ("DATE", "2026-06-18")]
    assert all(t[x.start : x.end] == x.text for x in r)


TOKENS = "array<struct<word:string,entity:string,start:int,end:int,score:double>>"


def test_token_merge(spark):
    t = "Hi, Marisol at Google"
    toks = [("Mar", "B-PER", 4, 7, 0.96), ("##is", "I-PER", 7, 9, 0.95), ("##ol", "I-PER", 9, 11, 0.94), ("at", "O", 12, 14, 0.9), ("Google", "B-ORG", 15, 21, 0.99)]
    r = spark.createDataFrame([(t, toks)], f"t string, k {TOKENS}").select(entities.merge_tokens(F.col("t"), F.col("k")).alias("e")).first().e
    assert [tuple(x) for x in r] == [("Marisol", "PERSON", 4, 11, 0.95), ("Google", "ORG", 15, 21, 0.99)]


def overlaps_brute(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (s[2], s[2] - s[3])):
        for i, k in enumerate(kept):
            if max(s[2], k[2]) < min(s[3], k[3]):
                if s[4] > k[4] or (s[4] == k[4] and s[3] - s[2] > k[3] - k[2]):
                    kept[i] = s
                break
        else:
            kept.append(s)
    return sorted(kept, key=lambda s: s[2])


def test_overlap_resolution_matches_brute_force(spark):
    rng = random.Random(8)
    docs = []
    for i in range(60):
        spans = []
        for j in range(rng.randrange(0, 12)):
            a = rng.randrange(0, 40)
            spans.append((f"t{j}", rng.choice("AB"), a, a + rng.randrange(1, 12), rng.choice([0.8, 0.9, 1.0])))
        docs.append((i, spans))
    df = spark.createDataFrame(docs, f"i int, s {entities.SPAN}").select("i", entities.resolve_overlaps(F.col("s")).alias("r"))
    got = {r.i: [tuple(x) for x in r.r] for r in df.collect()}
    assert got == {i: overlaps_brute(s) for i, s in docs}


def test_pii(spark):
    t = "Mail a.b@example.com, call 555-019-2834, ssn 000-12-3456."
    df = spark.createDataFrame([(t,), ("call 555-019-2834",), ("clean",), ("élan ABCDEFGH1é",)], "t string")
    rows = df.select(entities.redact(F.col("t")).alias("r"), entities.violation(F.col("t")).alias("v")).collect()
    assert all(f"[REDACTED_{x}]" in rows[0].r for x in ("EMAIL", "PHONE", "SSN"))
    assert rows[1].v == "PHONE" and rows[2].v is None and rows[2].r == "clean" and rows[3].v is None
    again = df.select(entities.redact(F.col("t")).alias("t")).select(F.col("t"), entities.redact(F.col("t")).alias("r")).collect()
    assert all(r.t == r.r for r in again)


def test_key_values(spark):
    cases = {"Date: 2026-06-18 Customer: John Doe Total: $100.00": {"date": "2026-06-18", "customer": "John Doe", "total": "$100.00"}, "A: B: x": {"a": "B: x", "b": "x"}, "A: 1 A: 2 end:": {"a": "2"}}
    for text, want in cases.items():
        df = spark.createDataFrame([(text.split(),)], "w array<string>").select(entities.key_values(F.col("w")).alias("p"))
        assert {x.key: x.value for x in df.first().p} == want


def test_layout_regions(spark):
    toks = [(w, [i * 10, 5, i * 10 + 8, 9]) for i, w in enumerate(["some", "plain", "prose", "|cell", "cell|"])]
    r = spark.createDataFrame([(toks,), ([],)], "t array<struct<word:string,box:array<int>>>").select(entities.layout_regions(F.col("t")).alias("r")).collect()
    assert [(x.label, x.text, x.confidence) for x in r[0].r] == [("table", "|cell cell|", 0.88), ("text", "some plain prose", 0.92)]
    assert r[1].r[0].confidence == 0.5


def vote(spark, maps, weights):
    df = spark.createDataFrame([tuple(maps.values())], ", ".join(f"{k} map<string,double>" for k in maps))
    v = classify.vote({k: F.col(k) for k in maps}, weights)
    return df.select(*(v[k].alias(k) for k in ("final_class", "confidence", "is_ambiguous"))).first()


def test_votes(spark):
    r = vote(spark, {"a": {"contract": 0.7, "report": 0.3}, "b": {"contract": 0.5, "report": 0.5}, "c": {"contract": 0.4, "report": 0.6}}, {"a": 0.5, "b": 0.25, "c": 0.25})
    assert (r.final_class, r.confidence, r.is_ambiguous) == ("contract", 0.575, False)
    r = vote(spark, {"a": {"invoice": 0.7, "other": 0.3}, "b": {"invoice": 0.4, "other": 0.6}, "c": None}, {"a": 0.6, "b": 0.4, "c": 0.3})
    assert (r.final_class, r.confidence) == ("invoice", 0.58)
    assert vote(spark, {"a": {"invoice": 0.51, "other": 0.49}, "b": {"invoice": 0.49, "other": 0.51}}, {"a": 0.5, "b": 0.5}).is_ambiguous


def test_calibration(spark):
    df = spark.createDataFrame([([0.5, 0.3, 0.1, 0.1],)], "p array<double>")
    p = lambda t: df.select(classify.calibrate(F.col("p"), t)).first()[0]
    assert p(1.0) == [0.5, 0.3, 0.1, 0.1] and p(100.0)[0] < 0.3 and p(100.0)[2] > 0.2 and p(0.01)[0] > 0.99


def lcs_brute(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_text_scores(spark):
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 90))] for _ in "xy")
        assert evaluate._lcs(a, b) == lcs_brute(a, b)
    rows = [("the cat sat", "the cat sat"), ("abc", "xyz"), ("", "xyz"), ("the quick brown fox jumps", "the quick brown dog jumps")]
    r = spark.createDataFrame(rows, "p string, r string").select(evaluate.rouge_l(F.col("p"), F.col("r")), evaluate.token_overlap(F.col("p"), F.col("r"))).collect()
    assert [x[0] for x in r] == [1.0, 0.0, 0.0, 0.8] and [x[1] for x in r[:3]] == [1.0, 0.0, 0.0]


def test_contradictions(spark):
    s = spark.createDataFrame([(1, "x", "CONTRADICTION", 0.88), (1, "y", "ENTAILMENT", 0.92)], "response_id int, sentence string, label string, score double")
    assert evaluate.contradiction_rate(s).first().contradiction_rate == 0.5
    a = spark.createDataFrame([(1, 0.9, [2.0, 1.0, -2.0]), (2, 0.85, [-2.0, -2.0, 5.0])], "answer_id int, confidence double, logits array<double>")
    got = {r.answer_id: (r.confidence, r.contradicted) for r in evaluate.contradiction_penalty(a).collect()}
    assert got == {1: (0.9, False), 2: (0.55, True)}


def sides(spark, ref, cur, kind="double"):
    rows = [("ref", x) for x in ref] + [("cur", x) for x in cur]
    return spark.createDataFrame(rows, f"side string, x {kind}")


def psi_brute(e, a):
    ec, edges = np.histogram(e, bins=10)
    ac, _ = np.histogram(a, bins=edges)
    ep, ap = (np.where(c == 0, 1e-4, c / n) for c, n in ((ec, len(e)), (ac, len(a))))
    return float(np.sum((ap - ep) * np.log(ap / ep)))


def test_psi(spark):
    rng = np.random.default_rng(42)
    a, b, c = rng.normal(0, 1, 100).tolist(), rng.normal(0, 1, 100).tolist(), rng.normal(1.5, 1, 100).tolist()
    for x, y in ((a, b), (a, c), (a, a), ([2.0] * 5, [2.0, 2.4, 9.0])):
        assert math.isclose(drift.psi(sides(spark, x, y), "x").first().psi, psi_brute(x, y), abs_tol=1e-9)
    assert drift.psi(sides(spark, a, a), "x").first().psi == 0.0


def test_ks_and_chi2(spark):
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 50, 300).tolist(), rng.integers(5, 60, 200).tolist()
    r = drift.ks_two_sample(sides(spark, a, b, "long"), "x").first()
    grid = sorted(set(a) | set(b))
    want = max(abs(np.mean(np.array(a) <= g) - np.mean(np.array(b) <= g)) for g in grid)
    assert math.isclose(r.statistic, want, abs_tol=1e-12) and r.p_value < 0.05
    assert math.isclose(stats._chi2_tail(3.841458820694124, 1), 0.05, abs_tol=1e-9)
    assert math.isclose(stats._chi2_tail(5.991464547107979, 2), 0.05, abs_tol=1e-9)
    assert math.isclose(stats._chi2_tail(7.814727903251179, 3), 0.05, abs_tol=1e-9)
    assert math.isclose(stats._normal_two_sided(1.959963984540054), 0.05, abs_tol=1e-9)
    c = drift.chi2_two_sides(sides(spark, ["a"] * 10, ["a"] * 10, "string"), "x").first()
    assert c.chi2 == 0.0 and c.p_value == 1.0


def test_js_is_symmetric_and_bounded(spark):
    x, y = ["a"] * 30 + ["b"] * 5, ["a"] * 5 + ["c"] * 20
    one, two = (drift.js_categorical(sides(spark, p, q, "string"), "x").first().js for p, q in ((x, y), (y, x)))
    assert math.isclose(one, two, abs_tol=1e-12) and 0 < one <= math.log(2)
    assert drift.js_categorical(sides(spark, ["a"], [], "string"), "x").first().js == 0.0


def test_percentiles(spark):
    rng = np.random.default_rng(3)
    hot, cold = rng.exponential(size=500).round(2), rng.exponential(size=7)
    rows = [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.a, r.b) for r in percentiles(df, ["k"], {"v": {"a": 0.5, "b": 0.95}}).collect()}
    for k, v in (("hot", hot), ("cold", cold)):
        assert np.allclose(got[k], np.percentile(v, [50, 95]))


def live(spark, a, b):
    rows = [("A", i < a[1]) for i in range(a[0])] + [("B", i < b[1]) for i in range(b[0])]
    df = spark.createDataFrame(rows, "variant string, error boolean")
    return df.select(F.lit("e").alias("experiment_id"), "variant", "error", F.lit(0.1).alias("latency"), F.lit(True).alias("cache_hit"))


def test_live_experiments(spark):
    r = experiments.evaluate_live(live(spark, (20, 0), (20, 10))).first()
    assert (r.winner, r.status) == ("A", "rolled_back")
    r = experiments.evaluate_live(live(spark, (100, 15), (100, 1))).first()
    assert (r.winner, r.status) == ("B", "promoted") and r.p_value < 0.05
    assert experiments.evaluate_live(live(spark, (9, 0), (50, 1))).count() == 0


def test_shadow_experiment(spark):
    for lat, winner, status in ((0.08, "B", "promoted"), (0.15, "A", "completed")):
        log = spark.createDataFrame([("e", "same text", "same text", 0.10, lat, 0.90, 0.92)] * 10, "experiment_id string, response_a string, response_b string, latency_a double, latency_b double, confidence_a double, confidence_b double")
        r = experiments.evaluate_shadow(experiments.enrich_shadow(log)).first()
        assert (r.winner, r.status, r.avg_rouge_l) == (winner, status, 1.0)


def test_ramp(spark):
    cfg = spark.createDataFrame([("a", 0.10, "live", "running"), ("b", 0.48, "live", "running"), ("c", 0.3, "shadow", "running")], "experiment_id string, split_ratio double, mode string, status string")
    cfg = cfg.withColumn("last_update_time", F.lit("2024-01-01 00:00").cast("timestamp"))
    none = experiments.live_summary(live(spark, (1, 0), (1, 0)))
    now = lambda h: F.lit(f"2024-01-01 0{h}:00").cast("timestamp")
    got = {r.experiment_id: round(r.next_ratio, 4) for r in experiments.ramp(cfg, none, now(3)).collect()}
    assert got == {"a": 0.15, "b": 0.5, "c": 0.0}
    assert {r.experiment_id: r.next_ratio for r in experiments.ramp(cfg, none, now(1)).collect()}["a"] == 0.10


def test_compare_runs(spark):
    m = spark.createDataFrame([("r1-alpha-x", "f1", 0.82), ("r1-alpha-x", "loss", 0.12), ("r2-beta-xx", "f1", 0.88), ("r2-beta-xx", "loss", 0.08)], "run_id string, metric string, value double")
    r = {x.metric: x.best_run for x in experiments.compare_runs(m, [("r1-alpha-x", "Alpha"), ("r2-beta-xx", "Beta")]).collect()}
    assert r == {"f1": "Beta (r2-beta-)", "loss": "Beta (r2-beta-)"}


def rate_brute(rows, limit, width):
    admitted, out = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        recent = [x for x in admitted.get(k, []) if x > t - width]
        out[i] = len(recent) < limit
        admitted[k] = [*recent, t] if out[i] else recent
    return out


def test_rate_limit_batch_and_stream(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, 0 if rng.random() < 0.4 else rng.randrange(5), rng.randrange(1, 4000)) for i in range(800)]
    df = spark.createDataFrame(rows, "event_id long, api_key long, us long")
    want = rate_brute(rows, 3, 60)
    got = {r.event_id: r.admitted for r in telemetry.rate_limit(df, "api_key", "us", "event_id", 3, 60).collect()}
    assert got == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {r.event_id: r.admitted for r in jobs.run(stateful.rate_limit(s, 3, 60), "t").collect()}
    assert got == want


def test_messages_and_changes(spark):
    rows = [(b'{"a": 1}', "raw.x", 0, 100), (b'{"b": 2}', "raw.x", 0, 101), (b"", "raw.x", 0, 102), (b"{bad", "raw.x", 0, 103), (b'{"a": 1}}', "raw.x", 0, 104)]
    df = spark.createDataFrame([(bytearray(v), t, p, o) for v, t, p, o in rows], "value binary, topic string, partition int, offset long")
    got = documents.from_messages(df).orderBy("source_uri").collect()
    assert [r.source_uri for r in got] == ["kafka://raw.x/0/100", "kafka://raw.x/0/101"]
    c = spark.createDataFrame([('{"op":"c","after":{"id":"contract-abc-123"},"source":{"schema":"public","table":"contracts"}}',), ('{"op":"d","before":{"id":"invoice-789"},"source":{"schema":"billing","table":"invoices"}}',), (None,)], "payload string")
    r = documents.from_changes(c).collect()
    assert r[0].operation == "c" and r[0].db_table == "contracts" and r[0].source_uri == "postgresql://public/contracts/contract-abc-123"
    assert r[1].raw_text.startswith("DELETED RECORD") and r[2].error is not None


def test_bad_bytes_and_training_rows(spark):
    df = spark.createDataFrame([("u", bytearray(b"ok \xff"))], "source_uri string, raw_bytes binary")
    assert documents.from_payloads(df, "api").first().raw_text == "ok �"
    t = spark.createDataFrame([("i", "c", "r")], "instruction string, context string, response string")
    assert documents.training_rows(t).first().text == "<s>[INST] i\nContext: c [/INST] r</s>"


def test_snapshot_versions(spark, tmp_path):
    reg = spark.createDataFrame([("v1.0.4-dev", "2024-01-01")], "version string, written_at string").withColumn("written_at", F.col("written_at").cast("timestamp"))
    small = documents.snapshot_if_large(spark.range(500), reg, str(tmp_path), "dev")
    assert sorted(r.version or "" for r in small.collect()) == ["", "v1.0.4-dev"]  # a batch that isn't written says so
    versions = [r.version for r in documents.snapshot_if_large(spark.range(1200), reg, str(tmp_path), "dev").collect()]
    assert "v1.0.5-dev" in versions and spark.read.parquet(str(tmp_path / "v1.0.5-dev")).count() == 1200
