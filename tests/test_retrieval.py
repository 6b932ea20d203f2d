"""Vector search, keyword search and answer assembly."""

import math

import numpy as np
from pyspark.sql import functions as F

from docspark.functions import hashing
from docspark.operators import blocks, retrieval, vectors


def store(spark, n=60, dim=8, seed=2):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    rows = [(i, f"doc-{i // 5}", "pdf" if i % 2 else "api", '{"language": "%s"}' % ("en" if i % 3 else "fr"), [float(x) for x in v[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, doc_id string, source_type string, metadata string, embedding array<float>"), v


def brute(v, q, k, keep=None):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ (q / np.linalg.norm(q)), 6)
    ids = [i for i in range(len(v)) if keep is None or keep(i)]
    return sorted(ids, key=lambda i: (-s[i], i))[:k]


def test_exact_topk_matches_brute_force(spark):
    df, v = store(spark)
    q = df.where("chunk_id < 7").select(F.col("chunk_id").alias("query_id"), "embedding")
    got = {}
    for r in vectors.exact_topk(df.repartition(5), q, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {i: brute(v, v[i], 4) for i in range(7)}
    assert all(ids[0] == i for i, ids in got.items())


def test_grid_join_of_several_columns(spark, monkeypatch):
    monkeypatch.setattr(blocks, "COLUMN_PACKS", 1)
    df, v = store(spark)
    q = df.where("chunk_id < 10").select(F.col("chunk_id").alias("query_id"), "embedding")
    got = {}
    for r in vectors.exact_topk(df.repartition(6), q.repartition(5), 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {i: brute(v, v[i], 3) for i in range(10)}


def test_filters(spark):
    df, v = store(spark)
    q = df.where("chunk_id = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    got = [r.chunk_id for r in vectors.exact_topk(df, q, 5, {"source_type": "pdf", "language": "en"}).orderBy("rank").collect()]
    assert got == brute(v, v[0], 5, lambda i: i % 2 == 1 and i % 3 != 0)
    assert vectors.exact_topk(df, q, 5, {"doc_id": "doc-3"}).count() == 5
    assert vectors.with_filters(df, {"nowhere": 1}).count() == 0


def test_upsert_and_delete(spark):
    df, _ = store(spark, 10)
    base = df.select("chunk_id", "doc_id", F.lit("").alias("text"), "source_type", F.lit("en").alias("language"), F.lit("other").alias("doc_type_signal"), F.col("embedding").cast("array<double>").alias("embedding"))
    again = vectors.upsert(base, base.where("chunk_id < 3").withColumn("source_type", F.lit(None).cast("string")))
    assert again.count() == 10 and again.where("source_type = 'default'").count() == 3
    left = vectors.delete_documents(again, spark.createDataFrame([("doc-1",)], "doc_id string"))
    s = vectors.stats(left).first()
    assert s.total_vectors == 5 and s.total_documents == 1


def test_embedding_cache(spark):
    chunks = spark.createDataFrame([(1, "same text"), (2, "same text"), (3, "other text"), (4, "")], "chunk_id long, text string")
    now = F.lit("2024-01-01").cast("timestamp")
    empty = spark.createDataFrame([], "text_key string, embedding array<double>, expires_at timestamp")
    out, append = vectors.embed_with_cache(chunks, empty, now)
    assert out.count() == 4 and append.count() == 3 and out.where("from_cache").count() == 0
    again, append2 = vectors.embed_with_cache(chunks, append, now)
    assert again.where("from_cache").count() == 4 and append2.count() == 0
    n = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    lengths = {r[0]: round(r[1], 6) for r in again.select("chunk_id", n).collect()}
    assert lengths == {1: 1.0, 2: 1.0, 3: 1.0, 4: 0.0}


def test_bm25_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(["the", *rng.choice(words, rng.integers(3, 20))])) for i in range(80)]
    queries = [(i, " ".join(["the", *rng.choice(words, 3)])) for i in range(6)]
    got = {}
    d, q = spark.createDataFrame(docs, "chunk_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    for r in retrieval.bm25_topk(d.repartition(4), q, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 6)))
    toks = {i: t.split() for i, t in docs}
    avg = sum(map(len, toks.values())) / len(toks)
    df = {w: sum(w in t for t in toks.values()) for w in ["the", *words]}
    for qid, text in queries:
        s = {}
        for i, t in toks.items():
            for w in set(text.split()):
                tf = t.count(w)
                if tf:
                    idf = math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
                    s[i] = s.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
        want = sorted(((i, round(x, 6)) for i, x in s.items()), key=lambda p: (-p[1], p[0]))[:5]
        assert got[qid] == want


def test_rerank_threshold_and_fallback(spark):
    hits = spark.createDataFrame([("q", i, i, s) for i, s in ((1, 0.35), (2, 0.95), (3, 0.82))], "query_id string, rank int, doc_id long, s double")
    scorer = lambda q, t: F.col("s")
    kept = retrieval.rerank(hits.withColumn("query", F.lit("")).withColumn("text", F.lit("")), "query", "text", 2, scorer=scorer)
    assert [r.doc_id for r in kept.orderBy("rerank_rank").collect()] == [2, 3]
    low = hits.where("s < 0.5").withColumn("query", F.lit("")).withColumn("text", F.lit(""))
    assert retrieval.rerank(low, "query", "text", 2, scorer=scorer).count() == 1


def test_parse_and_citations(spark):
    raw = "Answer: Total is due [DOC-abcdef12]. Signed [DOC-7890abcd].\nConfidence Score: 0.85"
    a, c = retrieval.parse_generation(F.col("raw"))
    r = spark.createDataFrame([("q", raw)], "query_id string, raw string").select("query_id", a.alias("answer"), c.alias("confidence"))
    row = r.first()
    assert row.confidence == 0.85 and row.answer.startswith("Total")
    chunks = spark.createDataFrame([("q", 1, "ABCDEF12-1", "s3://a", "x"), ("q", 2, "7890abcd-2", None, "y"), ("q", 3, "other", "s3://c", "z")], "query_id string, rank int, doc_id string, source_uri string, text string")
    got = {x.doc_id_short: x.source_uri for x in retrieval.citations(r, chunks).collect()}
    assert got == {"abcdef12": "s3://a", "7890abcd": ""}
    assert spark.range(1).select(retrieval.low_confidence(F.lit(0.55))).first()[0]


def test_extractive_fallbacks(spark):
    hits = spark.createDataFrame(
        [("a", "where is paris", 1, "doc-one-x", "Paris is here. Rome is not"), ("b", "quantum physics", 1, "d2", "First one. Second one. Third one.")],
        "query_id string, query string, rank int, doc_id string, text string",
    )
    got = {r.query_id: r for r in retrieval.extractive_answer(hits, "query").collect()}
    assert got["a"].answer == "Paris is here [DOC-doc-one-]." and got["a"].confidence == 0.9
    assert got["b"].answer == "Based on the provided document: First one. [DOC-d2]. Second one. [DOC-d2]." and got["b"].confidence == 0.8


def test_semantic_cache(spark):
    e1, e2 = [1.0] + [0.0] * 31, [0.0, 1.0] + [0.0] * 30
    cache = spark.createDataFrame([(1, 0, e1)], "cache_id long, at long, embedding array<double>")
    q = spark.createDataFrame([(1, 10, e1), (2, 10, e2), (3, 3600, e1), (4, 3599, e1)], "query_id long, at long, embedding array<double>")
    got = {r.query_id: r.similarity for r in retrieval.semantic_cache_lookup(q, cache).collect()}
    assert got == {1: 1.0, 4: 1.0}


def test_hashing(spark):
    import hashlib
    import hmac
    import uuid

    df = spark.createDataFrame([("public.t.1",), ("é",), ("",)], "s string")
    rows = df.select("s", hashing.uuid5(F.col("s")).alias("u"), hashing.hmac_sha256(F.col("s"), b"k").alias("h"), hashing.md5_mod(F.col("s")).alias("m")).collect()
    for r in rows:
        assert r.u == str(uuid.uuid5(uuid.NAMESPACE_DNS, r.s))
        assert r.h == hmac.new(b"k", r.s.encode(), hashlib.sha256).hexdigest()
        assert r.m == int(hashlib.md5(r.s.encode()).hexdigest(), 16) % 10000


def test_best_rows_of_every_column():
    """Against a full sort: ties of the k-th stay, what isn't finite takes no place."""
    import numpy as np

    from docspark.operators import blocks

    rng = np.random.default_rng(3)
    for n, m, k in ((0, 3, 2), (7, 4, 5), (500, 6, 5), (2000, 3, 1)):
        for scores in (rng.normal(size=(n, m)), np.round(rng.normal(size=(n, m)), 1)):
            scores[rng.random((n, m)) < 0.3] = -np.inf
            scores[rng.random((n, m)) < 0.01] = np.nan
            want = set()
            for j in range(m):
                fine = np.sort(scores[np.isfinite(scores[:, j]), j])[::-1]
                least = fine[min(k, len(fine)) - 1] if len(fine) else np.inf
                want |= {(i, j) for i in range(n) if np.isfinite(scores[i, j]) and scores[i, j] >= least}
            assert set(zip(*(x.tolist() for x in blocks.top_rows(scores, k)), strict=True)) == want
