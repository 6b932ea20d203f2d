"""Retrieval over every passage of ``documents`` for every item of ``benchmark``."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark import inputs
from docspark.inputs import sentences_sql, strip_sql, tokens_sql, with_sql, words_sql
from docspark.operators import retrieval as rag
from docspark.operators import vectors as vec
from docspark.plans import query
from docspark.plans.text import word_count_sql
from docspark.plans.vectors import embed_sql
from docspark.session import cut_lineage

K = 5
BM25 = f""",
toks AS (SELECT chunk_id, {tokens_sql("text")} AS t FROM passages),
totals AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM toks),
tf AS (SELECT chunk_id, len, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS len, unnest(t) AS term FROM toks) GROUP BY ALL),
qt AS (SELECT DISTINCT query_id, unnest({tokens_sql("text")}) AS term FROM questions),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM qt) GROUP BY term),
bm AS (
  SELECT query_id, chunk_id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len)))), 9) AS score
  FROM qt JOIN df USING (term) JOIN tf USING (term), totals GROUP BY ALL),
hits AS (
  SELECT query_id, chunk_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm) WHERE rank <= {3 * K}),
hit_rows AS (
  SELECT h.query_id, h.chunk_id, h.score, h.rank, p.doc_id, p.text, p.source_uri, q.text AS query FROM hits h
  JOIN passages p USING (chunk_id) JOIN questions q USING (query_id)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS drn FROM hit_rows) WHERE drn = 1)"""


def bm25_hits(spark, sf):
    """Over-retrieved hits with their passage and question (RAG1)."""
    p, q = inputs.passages(spark, sf), inputs.questions(spark, sf)
    hits = rag.bm25_topk(p, q, 3 * K)
    # Hits are k per question; passages are scanned once more for the text of those.
    rows = p.join(hits, "chunk_id")
    return rows.join(q.select("query_id", F.col("text").alias("query")), "query_id")


@query("bm25_topk", with_sql("passages", "questions", rest=BM25 + " SELECT query_id, chunk_id, rank, round(score, 4) AS score FROM hits"))
def bm25_topk(spark, sf):
    h = rag.bm25_topk(inputs.passages(spark, sf), inputs.questions(spark, sf), 3 * K)
    return h.select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


@query(
    "hybrid_topk",
    with_sql("passages", "questions", rest=BM25
             + embed_sql("passages", "text", "chunk_id", "pv")
             + embed_sql("(SELECT query_id, 'Represent this sentence: ' || text AS text FROM questions)", "text", "query_id", "qv")
             + f""",
ds AS (SELECT query_id, chunk_id, round(list_dot_product(pv.embedding, qv.embedding), 9) AS score
  FROM (SELECT p.chunk_id, coalesce(embedding, list_transform(range(0, 64), lambda i: 0.0)) AS embedding FROM passages p LEFT JOIN pv USING (chunk_id)) pv, qv),
dn AS (SELECT query_id, chunk_id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END AS d FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM ds WINDOW w AS (PARTITION BY query_id))),
sn AS (SELECT query_id, chunk_id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END AS s FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM bm WINDOW w AS (PARTITION BY query_id))),
fused AS (SELECT query_id, chunk_id, round(coalesce(d, 0.0) * 0.7 + coalesce(s, 0.0) * (1 - 0.7), 9) AS score FROM dn FULL JOIN sn USING (query_id, chunk_id))
SELECT query_id, chunk_id, rank, round(score, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused) WHERE rank <= 10"""),
)
def hybrid_topk(spark, sf):
    p, q = inputs.passages(spark, sf), inputs.questions(spark, sf)
    # Encoded passages are read by two passes over the blocks.
    chunks = cut_lineage(vec.encode(p, F.col("text")).select("chunk_id", "text", "embedding"))
    h = rag.hybrid_topk(chunks, vec.encode_queries(q, F.col("text")), 10)
    return h.select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


@query("best_chunk_per_doc", with_sql("passages", "questions", rest=BM25 + " SELECT query_id, doc_id, chunk_id, rank FROM best"))
def best_chunk_per_doc(spark, sf):
    return rag.best_chunk_per_doc(bm25_hits(spark, sf)).select("query_id", "doc_id", "chunk_id", "rank")


RERANK = f""",
pair AS (
  SELECT *, list_distinct({tokens_sql("query")}) AS qs, list_distinct({tokens_sql("text")}) AS ts FROM best),
rescored AS (
  SELECT *, CASE WHEN len(qs) * len(ts) > 0 THEN len(list_intersect(qs, ts)) / sqrt((len(qs) * len(ts))::DOUBLE) ELSE 0.0 END AS rerank_score FROM pair),
reranked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rerank_rank FROM rescored)
  WHERE rerank_rank <= {K} AND (rerank_score > 0.4 OR rerank_rank = 1)),
blocks AS (
  SELECT *, '[DOC-' || left(doc_id::VARCHAR, 8) || ']: ' || text || chr(10) || '---' || chr(10) AS block FROM reranked),
budget AS (
  SELECT * FROM (SELECT *, sum(block_tokens) OVER (PARTITION BY query_id ORDER BY rerank_rank)::BIGINT AS tokens_used FROM (
    SELECT *, {word_count_sql("block")} AS block_tokens FROM blocks)) WHERE tokens_used <= 120)"""


def reranked(spark, sf):
    return rag.rerank(rag.best_chunk_per_doc(bm25_hits(spark, sf)), "query", "text", K)


@query(
    "rerank_topk",
    with_sql("passages", "questions", rest=BM25 + RERANK + " SELECT query_id, chunk_id, rerank_rank, round(rerank_score, 4) AS rerank_score FROM reranked"),
)
def rerank_topk(spark, sf):
    return reranked(spark, sf).select("query_id", "chunk_id", "rerank_rank", F.round("rerank_score", 4).alias("rerank_score"))


@query(
    "context_budget",
    with_sql("passages", "questions", rest=BM25 + RERANK + " SELECT query_id, chunk_id, block_tokens, tokens_used FROM budget"),
)
def context_budget(spark, sf):
    return rag.context_budget(reranked(spark, sf), budget=120).select("query_id", "chunk_id", "block_tokens", "tokens_used")


TYPED = "CASE doc_id % 3 WHEN 0 THEN 'invoice' WHEN 1 THEN 'contract' ELSE 'report' END"


@query(
    "prompt_assembly",
    with_sql("passages", "questions", rest=BM25 + RERANK + f""",
g AS (SELECT query_id, any_value(query) AS query, arg_min({TYPED}, rerank_rank) AS kind, string_agg(block, '' ORDER BY rerank_rank) AS body FROM budget GROUP BY query_id)
SELECT query_id, CASE kind WHEN 'invoice' THEN 'invoice' WHEN 'contract' THEN 'contract' ELSE 'default' END AS template,
  CASE kind WHEN 'invoice' THEN '{rag.TEMPLATES["invoice"]}' WHEN 'contract' THEN '{rag.TEMPLATES["contract"]}' ELSE '{rag.TEMPLATES["default"]}' END
  || chr(10) || chr(10) || 'Context:' || chr(10) || body || chr(10) || 'User Query: ' || query || chr(10) || 'Answer:' || chr(10) || 'Confidence Score:' || chr(10) AS prompt FROM g"""),
)
def prompt_assembly(spark, sf):
    kind = F.when(F.col("doc_id") % 3 == 0, "invoice").when(F.col("doc_id") % 3 == 1, "contract").otherwise("report")
    ctx = rag.context_budget(reranked(spark, sf), budget=120).withColumn("doc_type", kind)
    return rag.assemble_prompts(ctx, "query", "doc_type")


STOPS = ", ".join(f"'{w}'" for w in rag.STOP_WORDS)
EXTRACTIVE = f""",
kw AS (
  SELECT query_id, rank, left(doc_id::VARCHAR, 8) AS short, {strip_sql("replace(text, chr(10), ' ')")} AS flat,
    list_filter(list_transform(list_filter({words_sql("lower(query)")}, lambda w: length(w) > 2), lambda w: regexp_replace(w, '^[?,.!]+|[?,.!]+$', '', 'g')), lambda w: w NOT IN ({STOPS})) AS kw FROM hit_rows),
st AS (
  SELECT query_id, rank, short, kw, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM (SELECT *, {sentences_sql("flat")} AS s FROM kw)),
sc AS (SELECT *, len(list_filter(kw, lambda k: contains(lower(sentence), k))) AS hits FROM st),
top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, rank, pos) AS rn FROM sc WHERE hits > 0 OR len(kw) = 0) WHERE rn <= 3),
cited AS (
  SELECT query_id, rn, CASE WHEN regexp_matches(sentence, '[.?!]$') THEN left(sentence, length(sentence) - 1) ELSE sentence END || ' [DOC-' || short || '].' AS s FROM top),
ans AS (SELECT query_id, string_agg(s, ' ' ORDER BY rn) AS answer FROM cited GROUP BY query_id)"""


@query(
    "extractive_answer",
    with_sql("passages", "questions", rest=BM25 + EXTRACTIVE + """
SELECT query_id, answer, 0.9::DOUBLE AS confidence FROM ans"""),
)
def extractive_answer(spark, sf):
    return rag.extractive_answer(bm25_hits(spark, sf), "query")


REPLY_SQL = """SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN text WHEN length(text) % 3 = 1 THEN 'Answer: ' || text || chr(10) || 'Confidence Score: 0.' || (length(text) % 100)
  ELSE 'Draft Answer: ' || text || chr(10) || 'Confidence Score: high' END AS raw FROM conversations WHERE role = 'assistant'"""


def replies(spark, sf):
    n = F.char_length("text")
    t = F.col("text")
    raw = F.when(n % 3 == 0, t).when(
        n % 3 == 1, F.concat(F.lit("Answer: "), t, F.lit("\nConfidence Score: 0."), (n % 100).cast("string"))
    ).otherwise(F.concat(F.lit("Draft Answer: "), t, F.lit("\nConfidence Score: high")))
    return inputs.table(spark, sf, "conversations").where(F.col("role") == "assistant").select("conv_id", "turn", raw.alias("raw"))


PARSED = f"""replies AS ({REPLY_SQL}),
cut AS (SELECT *, substr(raw, instr(raw, 'Answer:') + 7) AS rest FROM replies),
parsed AS (
  SELECT conv_id, turn,
    CASE WHEN NOT contains(raw, 'Answer:') THEN {strip_sql("raw")} WHEN contains(rest, 'Confidence Score:') THEN {strip_sql("left(rest, instr(rest, 'Confidence Score:') - 1)")} ELSE {strip_sql("rest")} END AS answer,
    CASE WHEN contains(raw, 'Answer:') AND contains(rest, 'Confidence Score:') THEN coalesce(TRY_CAST({strip_sql("substr(rest, instr(rest, 'Confidence Score:') + 17)")} AS DOUBLE), 1.0) ELSE 1.0 END AS confidence
  FROM cut)"""


@query("parse_generation", f"WITH {PARSED} SELECT conv_id, turn, answer, confidence::DOUBLE AS confidence FROM parsed")
def parse_generation(spark, sf):
    answer, conf = rag.parse_generation(F.col("raw"))
    return replies(spark, sf).select("conv_id", "turn", answer.alias("answer"), conf.alias("confidence"))


@query("low_confidence", f"WITH {PARSED} SELECT confidence < 0.75 AS low_confidence, count(*) AS replies FROM parsed GROUP BY ALL")
def low_confidence(spark, sf):
    _, conf = rag.parse_generation(F.col("raw"))
    return replies(spark, sf).groupBy(rag.low_confidence(conf).alias("low_confidence")).agg(F.count("*").alias("replies"))


@query(
    "citations",
    with_sql("passages", "questions", rest=BM25 + EXTRACTIVE + r""",
tags AS (SELECT DISTINCT query_id, unnest(list_transform(regexp_extract_all(answer, '(?i)\[DOC-([a-z0-9_-]{2,16})\]', 1), lambda t: lower(t))) AS doc_id_short FROM ans),
firsts AS (SELECT query_id, lower(left(doc_id::VARCHAR, 8)) AS doc_id_short, arg_min(doc_id, rank) AS doc_id, arg_min(source_uri, rank) AS source_uri, arg_min(text, rank) AS text_snippet FROM hit_rows GROUP BY ALL)
SELECT query_id, doc_id_short, doc_id, source_uri, text_snippet FROM tags JOIN firsts USING (query_id, doc_id_short)"""),
)
def citations(spark, sf):
    # Read twice below; k rows per question are cheap to write down.
    hits = cut_lineage(bm25_hits(spark, sf))
    return rag.citations(rag.extractive_answer(hits, "query"), hits)


AGENT_SQL = """SELECT conv_id, turn, CASE length(text) % 4
  WHEN 0 THEN 'Thought' || chr(10) || 'Action: search' || chr(10) || 'Arguments: {"query": "' || replace(left(text, 20), '"', '') || '", "k": ' || turn || '}'
  WHEN 1 THEN 'Action: lookup' || chr(10) || 'Arguments: {"doc": "' || conv_id || '", n: x, "k": ' || turn || '}'
  WHEN 2 THEN 'Answer: ' || text ELSE text END AS raw FROM conversations"""


@query(
    "agent_actions",
    rf"""WITH t AS (SELECT conv_id, turn, text, length(text) % 4 AS kind, replace(left(text, 20), '"', '') AS head FROM conversations)
SELECT conv_id, turn, CASE WHEN kind < 2 THEN 'tool_call' ELSE 'respond' END AS action, CASE kind WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' END AS tool,
  CASE kind WHEN 0 THEN 'k=' || turn || '|query=' || head WHEN 1 THEN 'doc=' || conv_id || '|k=' || turn END AS args,
  CASE WHEN kind >= 2 THEN {strip_sql("text")} END AS answer FROM t""",
)
def agent_actions(spark, sf):
    c = inputs.table(spark, sf, "conversations")
    kind = F.char_length("text") % 4
    head = F.replace(F.substring("text", 1, 20), F.lit('"'), F.lit(""))
    turn, conv = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    raw = (
        F.when(kind == 0, F.concat(F.lit('Thought\nAction: search\nArguments: {"query": "'), F.replace(head, F.lit("\n"), F.lit("\\n")), F.lit('", "k": '), turn, F.lit("}")))
        .when(kind == 1, F.concat(F.lit('Action: lookup\nArguments: {"doc": "'), conv, F.lit('", n: x, "k": '), turn, F.lit("}")))
        .when(kind == 2, F.concat(F.lit("Answer: "), F.col("text")))
        .otherwise(F.col("text"))
    )
    parsed = rag.agent_actions(F.col("raw"))
    shown = F.array_join(
        F.array_sort(F.transform(F.map_entries("args"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|"
    )
    out = c.select("conv_id", "turn", raw.alias("raw")).select("conv_id", "turn", *(v.alias(k) for k, v in parsed.items()))
    return out.withColumn("args", shown)


CACHE = """cache AS (SELECT vec_id AS id, vec_id * 60 AS at, embedding::DOUBLE[] AS e, label FROM embeddings),
sims AS (SELECT q.id AS query_id, c.id AS cache_id, round(list_cosine_similarity(c.e, q.e), 9) AS similarity FROM cache q JOIN cache c ON c.at < q.at AND q.at < c.at + 3600),
found AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, cache_id) AS rn FROM sims WHERE similarity >= 0.3) WHERE rn = 1)"""


def cache_sides(spark, sf):
    """Every vector asks once and is cached once, a minute apart."""
    e = inputs.table(spark, sf, "embeddings")
    at = F.col("vec_id") * 60
    q = e.select(F.col("vec_id").alias("query_id"), at.alias("at"), "embedding")
    c = e.select(F.col("vec_id").alias("cache_id"), at.alias("at"), "embedding", F.col("label").cast("string").alias("response"))
    return q, c


@query("semantic_cache_lookup", f"WITH {CACHE} SELECT query_id, cache_id, round(similarity, 4) AS similarity FROM found")
def semantic_cache_lookup(spark, sf):
    q, c = cache_sides(spark, sf)
    return rag.semantic_cache_lookup(q, c, 0.3).withColumn("similarity", F.round("similarity", 4))


@query(
    "semantic_cache_state",
    f"""WITH {CACHE}, counts AS (SELECT cache_id, count(*) AS hit_count FROM found GROUP BY cache_id)
SELECT id AS cache_id, label::VARCHAR AS response, cache.at + 3600 AS expires_at, coalesce(hit_count, 0) AS hit_count FROM cache LEFT JOIN counts ON id = cache_id""",
)
def semantic_cache_state(spark, sf):
    q, c = cache_sides(spark, sf)
    return rag.semantic_cache_state(c, rag.semantic_cache_lookup(q, c, 0.3)).drop("cache_key")
