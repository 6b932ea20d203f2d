"""Cases at the edges: repeated keys, control characters, missing keys, ties, small samples."""

import base64
import math

import numpy as np
from pyspark.sql import functions as F

from docspark.functions import stats
from docspark.functions import text as tx
from docspark.operators import blocks, catalogue, classify, dedup, drift, entities, experiments
from docspark.operators import retrieval as rag
from docspark.sources import documents


def test_chi_square_tail_of_many_categories():
    for dof in (1400, 1499, 1500, 1501, 3000, 20_000):
        # Near its mean the tail is a half, less a third of a standard deviation's skew.
        assert abs(stats._chi2_tail(float(dof), dof) - 0.5) < 0.01
    assert abs(stats._chi2_tail(3.841459, 1) - 0.05) < 1e-6 and abs(stats._chi2_tail(7.814728, 3) - 0.05) < 1e-6
    assert abs(stats._chi2_tail(2.0, 2) - math.exp(-1)) < 1e-12 and stats._chi2_tail(0.0, 5) == 1.0


def test_repeated_argument_keys_keep_the_last(spark):
    replies = ['Action: find Arguments: {"a": "x", "a": "y", "n": 3}', 'Action: find Arguments: {"a": "x", b: 1, "a": "z"}']
    df = spark.createDataFrame([(r,) for r in replies], "raw string").select(rag.agent_actions(F.col("raw"))["args"].alias("args"))
    got = [r.args["a"] for r in df.collect()]
    assert got == ["y", "z"]


def test_class_names_that_differ_in_case(spark):
    df = spark.sql("SELECT map('Invoice', 0.2D, 'invoice', 0.5D, 'EMAIL', 0.1D) AS p")
    got = df.select(classify.align(F.col("p")).alias("p")).first().p
    assert got[classify.CLASSES.index("invoice")] == 0.5 and got[classify.CLASSES.index("email")] == 0.1 and sum(got) == 0.6


def test_keywords_are_measured_before_stripping(spark):
    df = spark.createDataFrame([("Where did it go? an ox. tax!",)], "q string")
    assert df.select(rag.keywords(F.col("q")).alias("k")).first().k[-3:] == ["go", "ox", "tax"]


def test_spans_in_text_with_control_characters(spark):
    text = "\x01 pay \x02 INV-12 now \x1f and INV-345"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(entities.regex_spans(F.col("t"), "N", r"INV-\d+").alias("s")).first().s
    assert [(x.text, text[x.start : x.end]) for x in got] == [("INV-12", "INV-12"), ("INV-345", "INV-345")]
    parts = spark.createDataFrame([("One. Two\x1fstill two! Three?",)], "t string").select(tx.sentences(F.col("t")).alias("s")).first().s
    assert parts == ["One.", "Two\x1fstill two!", "Three?"]


def test_rows_without_a_key_stay(spark):
    df = spark.createDataFrame([(1, "k", 1), (2, "k", 2), (3, None, 3), (4, None, 4)], "doc_id long, key string, ts long")
    got = {r.doc_id: (r.is_duplicate, r.existing_doc_id) for r in dedup.first_wins(df, "key", "ts", "doc_id").collect()}
    assert got == {1: (False, None), 2: (True, 1), 3: (False, None), 4: (False, None)}


def test_a_long_chain_of_registrations_takes_few_rounds(spark, monkeypatch):
    """One key seen every third of a TTL for 5,000 registrations, and a few keys at random times."""
    rounds = []
    real = dedup.cut_lineage
    monkeypatch.setattr(dedup, "cut_lineage", lambda df: rounds.append(1) or real(df))
    r = np.random.default_rng(2)
    rows = [("hot", t) for t in range(0, 5000 * 99, 33)] + [(f"k{k}", int(t)) for k in range(4) for t in r.integers(0, 3000, 200)]
    df = spark.createDataFrame(rows, "key string, t long")
    got = sorted(map(tuple, dedup.ttl_registrations(df, "key", "t", 90).collect()))
    want = []
    for k in {k for k, _ in rows}:
        reg = None
        for t in sorted({t for x, t in rows if x == k}):
            if reg is None or t - reg >= 90:
                reg = t
                want.append((k, t))
    assert got == sorted(want) and len(rounds) < 60


def test_ties_have_one_outcome(spark):
    schema = "doc_id long, source_uri string, status string, error_message string, updated_at long"
    old = spark.createDataFrame([(1, "a", "queued", None, 5)], schema)
    new = spark.createDataFrame([(1, "b", "done", None, 5), (1, "c", "failed", "x", 5)], schema)
    got = {tuple(catalogue.upsert_status(old, n).first()) for n in (new, new.orderBy(F.desc("status")).repartition(2))}
    assert got == {(1, "a", "failed", "x", 5)}
    rows = spark.createDataFrame([("e", 1, 0.1), ("e", 1, 0.3), ("e", 0, 0.9)], "experiment_id string, written_at long, value double")
    assert experiments.latest_results(rows.repartition(3)).first().value == 0.3


def test_letters_keep_their_bytes(spark):
    df = spark.createDataFrame([("d", bytearray(b"\x00\xffraw"), "bad")], "doc_id string, raw_bytes binary, failure_reason string")
    value = documents.dead_letters(df, F.lit("2024-01-01").cast("timestamp")).select(F.get_json_object("value", "$.document.raw_bytes").alias("b")).first().b
    assert base64.b64decode(value) == b"\x00\xffraw"


def test_a_small_batch_leaves_a_row(spark, tmp_path):
    registry = spark.createDataFrame([("v1.0.3-dev", None)], "version string, written_at timestamp").withColumn("written_at", F.lit("2024-01-01").cast("timestamp"))
    same = documents.snapshot_if_large(spark.range(5), registry, str(tmp_path), "dev", over=5)
    assert same.count() == 2 and same.where("version IS NULL").count() == 1
    more = documents.snapshot_if_large(spark.range(6), same, str(tmp_path), "dev", over=5)
    assert more.where("version = 'v1.0.4-dev'").count() == 1 and spark.read.parquet(f"{tmp_path}/v1.0.4-dev").count() == 6


def test_few_vectors_tell_nothing(spark):
    rows = [("ref" if i % 2 else "cur", [float(i), 1.0, 0.5 * i * i]) for i in range(20)]
    df = spark.createDataFrame(rows, "side string, embedding array<double>")
    assert drift.psi_largest(df, dims=2).first().psi == 0.0
    assert drift.psi_largest(df.union(df), dims=2).first().psi >= 0.0


def test_fused_scores_see_every_chunk(spark, monkeypatch):
    """Against all scores at once, with tiles of a few rows."""
    monkeypatch.setattr(blocks, "LEFT_TILE", 7)
    monkeypatch.setattr(blocks, "RIGHT_TILE", 2)
    r = np.random.default_rng(3)
    words = [f"t{i}" for i in range(12)]
    chunks = [(i, " ".join(r.choice(words, 6)), r.standard_normal(4).tolist()) for i in range(80)]
    queries = [(i, " ".join([*r.choice(words, 2), "unknown"][: i % 3 + 1]), r.standard_normal(4).tolist()) for i in range(5)] + [(9, "nowhere", [1.0, 0.0, 0.0, 0.0])]
    c = spark.createDataFrame(chunks, "chunk_id long, text string, embedding array<double>").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, text string, embedding array<double>")
    got = {(x.query_id, x["rank"]): (x.chunk_id, round(x.score, 6)) for x in rag.hybrid_topk(c, q, 60).collect()}
    sizes = [len(t.split()) for _, t, _ in chunks]
    avg = sum(sizes) / len(sizes)
    for i, text, v in queries:
        dense = [float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)) for _, _, w in chunks]
        sparse = [0.0] * len(chunks)
        for term in set(text.split()):
            df = sum(term in t.split() for _, t, _ in chunks)
            for k, (_, t, _) in enumerate(chunks):
                tf = t.split().count(term)
                if tf:
                    sparse[k] += math.log(1 + (len(chunks) - df + 0.5) / (df + 0.5)) * tf * (rag.K1 + 1) / (tf + rag.K1 * (1 - rag.B + rag.B * sizes[k] / avg))
        held = [s for s in sparse if s > 0]
        one = lambda x, lo, hi: (x - lo) / (hi - lo) if hi > lo else 1.0
        fused = [0.7 * one(d, min(dense), max(dense)) + (0.3 * one(s, min(held), max(held)) if s > 0 else 0) for d, s in zip(dense, sparse, strict=True)]
        want = sorted(((-round(f, 9), k) for k, f in enumerate(fused)))[:60]
        assert [got[i, n + 1][1] for n in range(60)] == [round(-f, 6) for f, _ in want]
        assert [got[i, n + 1][0] for n in range(20)] == [k for _, k in want[:20]]


def test_due_letters_reach_the_callback(spark):
    rows = [('{"failure_reason": "bad", "failed_at": "2024-01-01T00:00:00", "document": {"doc_id": "a"}}',), ('{"failed_at": "2024-01-02T00:00:00"}',)]
    schedule = documents.retry_schedule(spark.createDataFrame(rows, "value string"), F.lit("2024-01-01 00:05:00").cast("timestamp"))
    got = documents.retry_due(schedule, lambda due: due.select(F.upper("doc_id").alias("again"))).collect()
    assert [r.again for r in got] == ["A"]


def test_readers_by_source_type(spark, tmp_path):
    (tmp_path / "one.txt").write_bytes(b"some text")
    found = documents.READERS["api"](spark, str(tmp_path))
    assert found.count() == 1 and "source_uri" in found.columns
