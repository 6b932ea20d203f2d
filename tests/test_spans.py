"""Spans, offsets, scorers and paging: against literal forms, and in linear time."""

import os
import random
import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docspark.functions import scorers, spans
from docspark.operators import catalogue, chunking, entities, evaluate, retrieval
from docspark.operators import vectors as vec


def overlaps_by_hand(found):
    """The rule as it reads: every span against the first kept one it overlaps."""
    kept = []
    for s in sorted(found, key=lambda s: (s[2], s[2] - s[3])):
        at = next((i for i, k in enumerate(kept) if max(k[2], s[2]) < min(k[3], s[3])), None)
        if at is None:
            kept.append(s)
        elif s[4] > kept[at][4] or (s[4] == kept[at][4] and s[3] - s[2] > kept[at][3] - kept[at][2]):
            kept[at] = s
    return sorted(kept, key=lambda s: s[2])


def test_overlaps_are_resolved_as_the_rule_reads():
    rng = random.Random(1)
    for _ in range(3000):
        found = []
        for _ in range(rng.randint(0, 14)):
            a = rng.randint(0, 30)
            found.append(("x", rng.choice("AB"), a, a + rng.randint(0, 9), rng.choice([0.5, 0.9, 1.0])))
        assert spans.resolved(found) == overlaps_by_hand(found)


def test_first_places_are_those_of_the_text():
    rng = random.Random(2)
    for size in (50, 30_000):
        text = "".join(rng.choice("ab é𝄞.") for _ in range(size))
        parts = [text[a : a + rng.choice([1, 2, 5, 31, 32, 33, 70])] for a in (rng.randrange(size) for _ in range(200))]
        parts += ["", None, "not there", text, text + "x", "b" * 40]
        assert spans.first_places(text, parts) == [None if p is None else text.find(p) for p in parts]


def test_many_matches_and_sentences_take_seconds(spark):
    text = " ".join(f"paid $12.50 for INV-{100000 + i} today, and more of the same was said." for i in range(14_000))
    assert len(text) > 900_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    t = time.time()
    found = df.select(F.size(entities.extract_entities(F.col("text"))).alias("n")).first()["n"]
    assert found == 28_000 and time.time() - t < 20
    long = " ".join(f"Sentence number {i} of a very long text." if i % 3 else "It said so again." for i in range(100_000))
    df = spark.createDataFrame([(1, long)], "doc_id long, text string")
    t = time.time()
    rows = chunking.sentence_window(df, "text").agg(F.count("*"), F.max("char_start"), F.countDistinct("char_start")).first()
    assert rows[0] == 100_000 and rows[1] < len(long) and time.time() - t < 60


def test_odd_texts_have_no_spans(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "$5")], "i int, t string")
    got = {r.i: r for r in df.select("i", entities.extract_entities(F.col("t")).alias("e"), entities.regex_entities(F.col("t")).alias("r")).collect()}
    assert [len(got[i].e) for i in (1, 2, 3, 4)] == [0, 0, 0, 1] and got[1].r is None and got[2].r == [] and got[4].r[0].text == "$5"
    assert df.limit(0).select(entities.extract_entities(F.col("t")).alias("e")).count() == 0


def model_class():
    """A model that leaves a mark in a folder whenever it is loaded; made here, it needs no import in a worker."""

    class Model:
        def __init__(self, folder):
            open(os.path.join(folder, f"{os.getpid()}-{time.time_ns()}"), "w").close()

        def predict(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    return Model


def test_a_model_is_loaded_once_in_a_worker(spark, tmp_path):
    folder = str(tmp_path)
    made = model_class()
    s = scorers.Scorer(f"model-{tmp_path.name}", lambda: made(folder))
    df = spark.range(400).select(F.col("id").alias("chunk_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")).repartition(16)
    for _ in range(2):
        got = scorers.encoder(s)(df, F.col("text")).collect()
    assert all(r.embedding == [float(len(r.text)), 1.0] for r in got) and len(got) == 400
    loads = [f.split("-")[0] for f in os.listdir(folder)]
    assert loads and len(loads) == len(set(loads)) <= 16
    cache = spark.createDataFrame([], "text_key string, embedding array<double>, expires_at timestamp")
    out, fresh = vec.embed_with_cache(df, cache, F.lit("2024-01-01").cast("timestamp"), scorers.encoder(s))
    assert out.count() == 400 and fresh.count() == 400
    assert scorers.encoder(s)(df.limit(0), F.col("text")).count() == 0


def test_objects_that_generate_or_are_called(spark):
    class Writer:
        def generate(self, texts):
            return pd.Series(["re: " + t for t in texts])

    df = spark.createDataFrame([("a", "b"), ("c", "c")], "q string, t string")
    out = df.select(scorers.apply(scorers.Scorer("writer", Writer), "string", F.col("q")).alias("x"))
    assert sorted(r.x for r in out.collect()) == ["re: a", "re: c"]
    same = scorers.Scorer("same", lambda: lambda q, t: (q == t).astype(float).to_numpy())
    hits = df.selectExpr("q", "t", "1L AS query_id", "row_number() OVER (ORDER BY q) AS rank")
    top = retrieval.rerank(hits, "q", "t", 1, scorer=scorers.pair_scorer(same)).collect()
    assert [(r.q, r.rerank_score) for r in top] == [("c", 1.0)]
    with pytest.raises(Exception, match="can't be called"):
        df.select(scorers.apply(scorers.Scorer("none", lambda: 5), "string", F.col("q"))).collect()
    with pytest.raises(Exception, match="1 results for"):
        df.coalesce(1).select(scorers.apply(scorers.Scorer("few", lambda: lambda x: ["one"]), "string", F.col("q"))).collect()


def test_contradictions_from_a_model(spark):
    rows = [("r1", "it rains", "it rains"), ("r1", "it rains", "it does not rain"), ("r2", "it rains", "it rains")]
    df = spark.createDataFrame(rows, "response_id string, premise string, sentence string")
    nli = scorers.Scorer("nli", lambda: lambda a, b: [[0.0, 0.0, 5.0] if "not" in y else [5.0, 0.0, 0.0] for y in b])
    got = evaluate.contradiction_rate(scorers.contradictions(df, nli, "premise", "sentence")).collect()
    assert {r.response_id: r.contradiction_rate for r in got} == {"r1": 0.5, "r2": 0.0}


def test_a_late_page_reads_what_the_first_does(spark, tmp_path):
    path = f"{tmp_path}/l"
    df = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.lit("s3://a.pdf").alias("source_uri"), F.lit("completed").alias("status"),
        F.timestamp_seconds(F.floor(F.col("id") / 3)).alias("updated_at"), F.lit(None).cast("string").alias("error_message"),
    )
    catalogue.write_listing(df.repartition(4), path)
    want = [r.doc_id for r in df.orderBy(F.desc("updated_at"), "doc_id").collect()]
    for number in (1, 2, 500, 1000, 1001):
        got = [r.doc_id for r in catalogue.listed(spark, path, number, 20).orderBy(F.desc("updated_at"), "doc_id").collect()]
        assert got == want[(number - 1) * 20 : number * 20]
    plan = catalogue.listed(spark, path, 900, 20)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*(EqualTo\(part|part)", plan) and "inside" in plan.split("PushedFilters")[1]
    none = spark.createDataFrame([], "doc_id long, feature_name string, feature_value string")
    at = df.orderBy(F.desc("updated_at"), "doc_id").limit(40).collect()[-1]
    got = [r.doc_id for r in catalogue.page_after(df, none, (at["updated_at"], at["doc_id"]), 20).orderBy(F.desc("updated_at"), "doc_id").collect()]
    assert got == want[40:60]
    catalogue.write_listing(df.limit(0), f"{tmp_path}/none")
    assert catalogue.listed(spark, f"{tmp_path}/none", 1, 20).count() == 0
