"""Keyword and hybrid retrieval, reranking, context, answers, citations and the answer cache."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as tx
from docspark.operators import blocks

K1, B = 1.2, 0.75
RERANK_THRESHOLD = 0.4
CONFIDENCE_THRESHOLD = 0.75
CONTEXT_TOKENS = 3072
NO_ANSWER = "I cannot find the answer in the provided documents."

# Words the extractive answer ignores.
STOP_WORDS = [
    "what", "is", "the", "are", "of", "in", "to", "for", "with", "on", "at", "by", "this", "an", "a",
    "document", "documents", "contract", "invoice",
]


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct (query_id, term) of (query_id, text)."""
    return queries.select("query_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))


def _bm25_weights(toks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, terms, idfs, avg_len) of queries with a known term; only query terms are counted."""
    totals = toks.agg(F.count("*").alias("n"), F.avg(F.size("toks")).alias("avg_len"))
    terms = query_terms(queries)
    df = (
        toks.select(F.explode(F.array_distinct("toks")).alias("term"))
        .join(terms.select("term").distinct(), "term", "left_semi")
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )
    n = totals.select("n").scalar()
    idf = F.log(F.lit(1.0) + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = terms.join(df, "term").select("query_id", "term", idf.alias("idf"))
    return weights.groupBy("query_id").agg(
        F.collect_list("term").alias("terms"),
        F.collect_list("idf").alias("idfs"),
        F.lit(totals.select("avg_len").scalar()).alias("avg_len"),
    )


def _bm25_scores(c: blocks.Columns, q: blocks.Columns) -> np.ndarray:
    """Scores of a tile of chunks (toks) against a tile of queries (terms, idfs, avg_len)."""
    q_terms = q["terms"].flatten()
    q_row = np.repeat(np.arange(len(q["terms"])), q["terms"].value_lengths().to_numpy())
    vocab = q_terms.unique()
    weight = np.zeros((len(vocab), len(q["terms"])))
    weight[_positions(q_terms, vocab), q_row] = q["idfs"].flatten().to_numpy(zero_copy_only=False)
    avg_len = q["avg_len"][0].as_py()

    lens = c["toks"].value_lengths().to_numpy().astype(float)
    found = _positions(c["toks"].flatten(), vocab)
    rows = np.repeat(np.arange(len(lens)), lens.astype(int))[found >= 0]
    step = max(1, 4_000_000 // max(1, len(vocab)))  # dense piece of at most 32 MB
    starts = np.arange(0, len(lens), step)
    cuts = np.searchsorted(rows, np.append(starts, len(lens)))
    hit = found[found >= 0]
    out = []
    for p, s in enumerate(starts):
        e = min(s + step, len(lens))
        tf = np.zeros((e - s, len(vocab)))
        np.add.at(tf, (rows[cuts[p] : cuts[p + 1]] - s, hit[cuts[p] : cuts[p + 1]]), 1.0)
        scale = K1 * (1 - B + B * lens[s:e] / avg_len)
        sat = tf * (K1 + 1) / (tf + scale[:, None])
        out.append(np.round(sat @ weight, 9))
    return np.concatenate(out)


def _hits(c: blocks.Columns, q: blocks.Columns, m: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best rows (and ties) of every column."""
    i, j = blocks.top_rows(m, k)
    return pa.RecordBatch.from_arrays(
        [q["query_id"].take(pa.array(j)), c["chunk_id"].take(pa.array(i)), pa.array(m[i, j])], names=["query_id", "chunk_id", "score"]
    )


def _types(chunks: DataFrame, queries: DataFrame) -> tuple[str, str]:
    return chunks.schema["chunk_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()


def bm25_topk(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """BM25 over (chunk_id, text) for (query_id, text): (query_id, chunk_id, score, rank).

    Chunk text is never shuffled: the scan meets packed query weights, term weights of a tile of
    queries form a matrix, and each tile keeps its k best. Only query terms get document
    frequencies, counted with map-side combine, so a term found in every chunk costs one counter.
    """
    toks = chunks.select("chunk_id", tx.tokens(F.col("text")).alias("toks"))
    chunk_type, query_type = _types(chunks, queries)

    def score(c: blocks.Columns, q: blocks.Columns) -> pa.RecordBatch:
        m = _bm25_scores(c, q)
        m[m <= 0] = -np.inf
        return _hits(c, q, m, k)

    found = blocks.block_join(toks, _bm25_weights(toks, queries), score, f"query_id {query_type}, chunk_id {chunk_type}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _positions(values: pa.Array, vocab: pa.Array) -> np.ndarray:
    """Index of each value in ``vocab``, -1 where absent."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.index_in(values, value_set=vocab), -1).to_numpy(zero_copy_only=False)


def hybrid_topk(chunks: DataFrame, queries: DataFrame, k: int, alpha: float = 0.7) -> DataFrame:
    """Min-max both scores per query over all chunks and fuse: alpha dense, the rest keyword (VEC4).

    ``chunks`` (chunk_id, text, embedding) and ``queries`` (query_id, text, embedding). Every chunk has
    a dense score; those that hold a query term have a keyword score, others contribute zero there. A
    list whose scores are all equal counts as one. A first pass over the blocks finds each query's
    ranges, a row per tile; a second fuses and keeps the k best of a tile.
    """
    toks = chunks.select("chunk_id", tx.tokens(F.col("text")).alias("toks"), "embedding")
    chunk_type, query_type = _types(chunks, queries)
    weights = _bm25_weights(toks, queries)
    avg = toks.agg(F.avg(F.size("toks"))).scalar()
    asked = queries.select("query_id", "embedding").join(weights.drop("avg_len"), "query_id", "left")
    empty = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c)
    asked = asked.select("query_id", "embedding", empty("terms", "string"), empty("idfs", "double"), avg.alias("avg_len"))

    def scores(c: blocks.Columns, q: blocks.Columns) -> tuple[np.ndarray, np.ndarray]:
        dense = blocks.unit_rows(blocks.matrix(c["embedding"])) @ blocks.unit_rows(blocks.matrix(q["embedding"])).T
        return np.round(dense, 9), _bm25_scores(c, q)

    def ranges(c: blocks.Columns, q: blocks.Columns) -> pa.RecordBatch:
        d, s = scores(c, q)
        held = s > 0
        lo, hi = np.where(held, s, np.inf).min(axis=0), np.where(held, s, -np.inf).max(axis=0)
        made = [d.min(axis=0), d.max(axis=0), lo, hi]
        return pa.RecordBatch.from_arrays([q["query_id"], *map(pa.array, made)], names=["query_id", "d_lo", "d_hi", "s_lo", "s_hi"])

    found = blocks.block_join(toks, asked, ranges, f"query_id {query_type}, d_lo double, d_hi double, s_lo double, s_hi double")
    ends = found.groupBy("query_id").agg(*(f(c).alias(c) for c, f in (("d_lo", F.min), ("d_hi", F.max), ("s_lo", F.min), ("s_hi", F.max))))

    def scaled(m: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        wide = np.where(hi > lo, hi - lo, 1.0)
        return np.where(hi > lo, (m - np.where(np.isfinite(lo), lo, 0.0)) / wide, 1.0)

    def fuse(c: blocks.Columns, q: blocks.Columns) -> pa.RecordBatch:
        d, s = scores(c, q)
        d_lo, d_hi, s_lo, s_hi = (q[n].to_numpy() for n in ("d_lo", "d_hi", "s_lo", "s_hi"))
        m = scaled(d, d_lo, d_hi) * alpha + np.where(s > 0, scaled(s, s_lo, s_hi), 0.0) * (1 - alpha)
        return _hits(c, q, np.round(m, 9), k)

    fused = blocks.block_join(toks, asked.join(ends, "query_id"), fuse, f"query_id {query_type}, chunk_id {chunk_type}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_chunk_per_doc(hits: DataFrame) -> DataFrame:
    """The best-ranked chunk of every (query, document) (RAG2)."""
    w = Window.partitionBy("query_id", "doc_id").orderBy("rank")
    return hits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def lexical_pair_score(query: Column, text: Column) -> Column:
    """Default pair scorer: cosine of the two token sets."""
    q, t = F.array_distinct(tx.tokens(query)), F.array_distinct(tx.tokens(text))
    n = F.size(q) * F.size(t)
    return F.when(n > 0, F.size(F.array_intersect(q, t)) / F.sqrt(n.cast("double"))).otherwise(F.lit(0.0))


def rerank(
    hits: DataFrame,
    query: str,
    text: str,
    k: int,
    threshold: float = RERANK_THRESHOLD,
    doc_filtered: bool = False,
    scorer=lexical_pair_score,
) -> DataFrame:
    """Replace the store score, keep those above the threshold or else the best one (RAG3-4)."""
    scored = hits.withColumn("rerank_score", scorer(F.col(query), F.col(text)))
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    ranked = scored.withColumn("rerank_rank", F.row_number().over(w)).where(F.col("rerank_rank") <= k)
    if doc_filtered:
        return ranked
    return ranked.where((F.col("rerank_score") > threshold) | (F.col("rerank_rank") == 1))


def context_block(doc_id: Column, text: Column) -> Column:
    return F.concat(F.lit("[DOC-"), F.substring(doc_id.cast("string"), 1, 8), F.lit("]: "), text, F.lit("\n---\n"))


def context_budget(hits: DataFrame, budget: int = CONTEXT_TOKENS, rank: str = "rerank_rank") -> DataFrame:
    """The longest prefix by rank whose blocks fit the token budget (RAG5)."""
    block = context_block(F.col("doc_id"), F.col("text"))
    w = Window.partitionBy("query_id").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    out = hits.withColumn("block", block).withColumn("block_tokens", tx.word_count(F.col("block")))
    return out.withColumn("tokens_used", F.sum("block_tokens").over(w)).where(F.col("tokens_used") <= budget)


# Answer instructions per document type.
TEMPLATES = {
    "invoice": "Audit the billing records below and cite every figure.",
    "contract": "Review the contract passages below and cite every clause.",
    "default": "Answer from the passages below only and cite each fact.",
}


def template_name(doc_type: Column) -> Column:
    """RAG6: the first chunk's type decides."""
    t = F.lower(F.coalesce(doc_type, F.lit("")))
    return (
        F.when(F.contains(t, F.lit("invoice")) | F.contains(t, F.lit("bill")), "invoice")
        .when(F.contains(t, F.lit("contract")) | F.contains(t, F.lit("agreement")), "contract")
        .otherwise("default")
    )


def assemble_prompts(hits: DataFrame, query: str, doc_type: str, rank: str = "rerank_rank") -> DataFrame:
    """One prompt per query from its ranked blocks (at most k of them by construction)."""
    grouped = hits.groupBy("query_id").agg(
        F.first(query).alias("query_text"),
        F.min_by(doc_type, rank).alias("primary_doc_type"),
        F.sort_array(F.collect_list(F.struct(rank, "block"))).alias("ordered"),
    )
    name = template_name(F.col("primary_doc_type"))
    head = F.lit(None).cast("string")
    for key, value in TEMPLATES.items():
        head = F.when(name == key, F.lit(value)).otherwise(head)
    body = F.array_join(F.transform("ordered", lambda e: e["block"]), "")
    tail = F.concat(F.lit("\nUser Query: "), F.col("query_text"), F.lit("\nAnswer:\nConfidence Score:\n"))
    return grouped.select(
        "query_id", name.alias("template"), F.concat(head, F.lit("\n\nContext:\n"), body, tail).alias("prompt")
    )


def parse_generation(raw: Column) -> tuple[Column, Column]:
    """Answer text and confidence of a generated reply (RAG7)."""
    has_answer = F.contains(raw, F.lit("Answer:"))
    rest = F.substring(raw, F.instr(raw, "Answer:") + F.lit(7), F.char_length(raw))
    has_conf = F.contains(rest, F.lit("Confidence Score:"))
    at = F.instr(rest, "Confidence Score:")
    before = F.substring(rest, F.lit(1), at - 1)
    after = tx.strip(F.substring(rest, at + F.lit(17), F.char_length(rest)))
    answer = F.when(has_answer & has_conf, tx.strip(before)).when(has_answer, tx.strip(rest)).otherwise(tx.strip(raw))
    conf = F.when(has_answer & has_conf, F.coalesce(after.try_cast("double"), F.lit(1.0))).otherwise(F.lit(1.0))
    return answer, conf


def citations(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cited passages of (query_id, answer) among (query_id, rank, doc_id, text, source_uri) (RAG8)."""
    tags = F.regexp_extract_all("answer", F.lit(r"(?i)\[DOC-([a-z0-9_-]{2,16})\]"), F.lit(1))
    cited = answers.select(
        "query_id", F.explode(F.array_distinct(F.transform(tags, lambda t: F.lower(t)))).alias("doc_id_short")
    )
    short = F.lower(F.substring(F.col("doc_id").cast("string"), 1, 8)).alias("doc_id_short")
    first = chunks.groupBy("query_id", short).agg(F.min_by(F.struct("doc_id", "source_uri", "text"), "rank").alias("c"))
    return cited.join(first, ["query_id", "doc_id_short"]).select(
        "query_id", "doc_id_short", "c.doc_id", F.coalesce("c.source_uri", F.lit("")).alias("source_uri"),
        F.col("c.text").alias("text_snippet"),
    )


def low_confidence(conf: Column) -> Column:
    return conf < CONFIDENCE_THRESHOLD


def keywords(query: Column) -> Column:
    """Lower-cased query words of 3 signs or more as they stand, then without edge punctuation and stop words."""
    long = F.filter(tx.words(F.lower(query)), lambda x: F.char_length(x) > 2)
    w = F.transform(long, lambda x: F.regexp_replace(x, r"^[?,.!]+|[?,.!]+$", ""))
    return F.filter(w, lambda x: ~x.isin(STOP_WORDS))


def extractive_answer(hits: DataFrame, query: str, rank: str = "rank", top: int = 3) -> DataFrame:
    """Answer each query from the sentences that hold most of its keywords (RAG10).

    Sentences arrive in (rank, position) order; the best three by keyword hits are joined, each
    with its citation in place of the last character. Without a match the first chunk's first two
    sentences stand in.
    """
    short = F.substring(F.col("doc_id").cast("string"), 1, 8)
    flat = tx.strip(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))
    kw = hits.select("query_id", rank, short.alias("short"), keywords(F.col(query)).alias("kw"), flat.alias("flat"))
    sents = kw.select("query_id", rank, "short", "kw", F.posexplode_outer(tx.sentences(F.col("flat"))).alias("pos", "sentence"))
    low = F.lower("sentence")
    scored = sents.withColumn("hits", F.size(F.filter("kw", lambda k: F.contains(low, k))))
    tag = F.concat(F.lit(" [DOC-"), F.col("short"), F.lit("]."))
    body = F.when(F.col("sentence").rlike(r"[.?!]$"), F.col("sentence")).otherwise(F.concat("sentence", F.lit(".")))
    cited = F.concat(F.substring(body, F.lit(1), F.char_length(body) - 1), tag)
    matched = F.col("sentence").isNotNull() & ((F.col("hits") > 0) | (F.size("kw") == 0))
    by_query = Window.partitionBy("query_id")
    scored = scored.withColumn("matched", matched).withColumns(
        {
            "best_at": F.row_number().over(by_query.orderBy(F.desc("matched"), F.desc("hits"), rank, "pos")),
            "first_at": F.row_number().over(by_query.orderBy(rank, "pos")),
            "first_rank": F.min(rank).over(by_query),
        }
    )
    is_best = F.col("matched") & (F.col("best_at") <= top)
    is_first = F.col("sentence").isNotNull() & (F.col("first_at") <= 2) & (F.col(rank) == F.col("first_rank"))
    kept = scored.where(is_best | (F.col("best_at") == 1) | (F.col("first_at") <= 2))

    def joined(flag: Column, at: str, text: Column) -> Column:
        parts = F.sort_array(F.collect_list(F.when(flag, F.struct(at, text.alias("s")))))
        return F.array_join(F.transform(parts, lambda e: e["s"]), " ")

    out = kept.groupBy("query_id").agg(
        joined(is_best, "best_at", cited).alias("best"),
        joined(is_first, "first_at", F.concat("sentence", tag)).alias("first"),
    )
    return out.select(
        "query_id",
        F.when(F.col("best") != "", F.col("best"))
        .when(F.col("first") != "", F.concat(F.lit("Based on the provided document: "), F.col("first")))
        .otherwise(NO_ANSWER).alias("answer"),
        F.when(F.col("best") != "", 0.9).when(F.col("first") != "", 0.8).otherwise(0.0).alias("confidence"),
    )


def last_of_key(entries: Column) -> Column:
    """A map of (key, value) entries in which a repeated key's last value stands."""

    def last(e: Column, i: Column) -> Column:
        return ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"])

    return F.map_from_entries(F.filter(entries, last))


def agent_actions(raw: Column) -> dict[str, Column]:
    """Tool call or answer of an agent reply (RAG11)."""
    tool = F.regexp_extract(raw, r"Action:\s*(\w+)", 1)
    args = F.regexp_extract(raw, r"(?s)Arguments:\s*(\{.*\})", 1)
    call = (tool != "") & (args != "")
    answer = F.regexp_extract(raw, r"(?s)Answer:\s*(.*)", 1)
    has_answer = F.contains(raw, F.lit("Answer:"))
    texts = F.regexp_extract_all(args, F.lit(r'"(\w+)":\s*"[^"]*"'), F.lit(1))
    text_values = F.regexp_extract_all(args, F.lit(r'"\w+":\s*"([^"]*)"'), F.lit(1))
    nums = F.regexp_extract_all(args, F.lit(r'"(\w+)":\s*\d+\.?\d*'), F.lit(1))
    num_values = F.regexp_extract_all(args, F.lit(r'"\w+":\s*(\d+\.?\d*)'), F.lit(1))
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    pairs = F.zip_with(F.concat(texts, nums), F.concat(text_values, num_values), entry)
    parsed = last_of_key(F.coalesce(F.map_entries(F.from_json(args, "map<string,string>")), pairs))
    return {
        "action": F.when(call, "tool_call").otherwise("respond"),
        "tool": F.when(call, tool),
        "args": F.when(call, parsed),
        "answer": F.when(~call, tx.strip(F.when(has_answer, answer).otherwise(raw))),
    }


def semantic_cache_lookup(
    queries: DataFrame, cache: DataFrame, threshold: float = 0.95, ttl_seconds: int = 3600
) -> DataFrame:
    """Best unexpired cache entry per query at or above the threshold (RAG12).

    ``queries`` (query_id, at, embedding) and ``cache`` (cache_id, at, embedding), ``at`` in epoch
    seconds; an entry serves queries asked after it within the TTL. The TTL bounds which time
    slices can meet, so the join is on slices and each slice is scored pack by pack.
    """
    slice_of = F.floor(F.col("at") / ttl_seconds).cast("long")
    q = queries.select("query_id", "at", "embedding", slice_of.alias("slice"))
    c = cache.select("cache_id", "at", "embedding", F.explode(F.array(slice_of, slice_of + 1)).alias("slice"))
    q_type, c_type = (d.schema[n].dataType.simpleString() for d, n in ((queries, "query_id"), (cache, "cache_id")))

    def score(cv: blocks.Columns, qv: blocks.Columns) -> pa.RecordBatch:
        s = blocks.unit_rows(blocks.matrix(cv["embedding"])) @ blocks.unit_rows(blocks.matrix(qv["embedding"])).T
        s = np.round(s, 9)
        age = qv["at"].to_numpy(zero_copy_only=False)[None, :] - cv["at"].to_numpy(zero_copy_only=False)[:, None]
        s[(age <= 0) | (age >= ttl_seconds) | (s < threshold)] = -np.inf
        i, j = blocks.top_rows(s, 1)
        return pa.RecordBatch.from_arrays(
            [qv["query_id"].take(pa.array(j)), cv["cache_id"].take(pa.array(i)), pa.array(s[i, j])],
            names=["query_id", "cache_id", "similarity"],
        )

    found = blocks.block_join(
        c, q, score, f"query_id {q_type}, cache_id {c_type}, similarity double",
        key="slice", left_order=["at"], right_order=["at"],
    )
    best = found.groupBy("query_id").agg(F.max(F.struct("similarity", (-F.col("cache_id")).alias("neg"))).alias("b"))
    return best.select("query_id", (-F.col("b.neg")).alias("cache_id"), F.col("b.similarity").alias("similarity"))


def semantic_cache_state(entries: DataFrame, hits: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """Latest entry per key (the first 32 numbers of the vector) with its hit count (RAG13).

    ``entries`` (cache_id, at, embedding, response); ``hits`` is a lookup result.
    """
    key = F.sha2(F.to_json(F.slice("embedding", 1, 32)), 256)
    latest = (
        entries.withColumn("cache_key", key).groupBy("cache_key")
        .agg(F.max_by(F.struct("cache_id", "at", "response"), F.struct("at", "cache_id")).alias("e"))
        .select("cache_key", "e.*")
    )
    counts = hits.groupBy("cache_id").agg(F.count("*").alias("hit_count"))
    return latest.join(counts, "cache_id", "left").select(
        "cache_key", "cache_id", "response", (F.col("at") + ttl_seconds).alias("expires_at"),
        F.coalesce("hit_count", F.lit(0)).cast("long").alias("hit_count"),
    )
