"""Quality gates, deduplication, cleaning, chunking and features over ``documents``."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from docspark import inputs
from docspark.functions import hashing
from docspark.functions import text as tx
from docspark.inputs import sentences_sql, strip_sql, with_sql, words_sql
from docspark.operators import chunking, cleaning, dedup, features, quality
from docspark.plans import query

ALPHA_SQL = r"CASE WHEN length({t}) = 0 THEN 0.0 ELSE length(regexp_replace({t}, '[^\p{{L}}]', '', 'g')) / length({t}) END"
WORD_COUNT_SQL = r"len(regexp_extract_all({t}, '[^\t-\r\x1c-\x1f\x{{85}}\p{{Z}}]+'))"
NONSPACE_SQL = r"length(regexp_replace({t}, '[\t-\r\x1c-\x1f\x{{85}}\p{{Z}}]', '', 'g'))"
BLANK_SQL = r"NOT regexp_matches({t}, '[^\t-\r\x1c-\x1f\x{{85}}\p{{Z}}]')"
TABLE_SQL = (
    "list_bool_or(list_transform(string_split({t}, chr(10)), lambda l: "
    "length(l) - length(replace(l, chr(9), '')) >= 2 OR length(l) - length(replace(l, '|', '')) >= 3))"
)


def word_count_sql(t: str) -> str:
    return WORD_COUNT_SQL.format(t=t)


def schema_sql(text_ok: str = "sha256(raw_text) <> checksum") -> str:
    """The schema checks over ``envelope`` columns, as branches of a CASE."""
    return f"""
    WHEN {text_ok} THEN 'checksum_mismatch'
    WHEN raw_text IS NULL THEN 'missing_text'
    WHEN length(raw_text) < 51 THEN 'text_too_short'
    WHEN byte_size < 100 OR byte_size > 52428800 THEN 'byte_size_out_of_range'
    WHEN language NOT IN ('en','fr','de','es','hi','zh') THEN 'language_not_allowed'"""


def content_sql() -> str:
    """The content checks, as branches of a CASE."""
    t = "raw_text"
    blank = BLANK_SQL.format(t="regexp_replace(p, '^.*?---', '', 's')")
    return f"""
    WHEN {BLANK_SQL.format(t=t)} THEN 'whitespace_only'
    WHEN contains({t}, '--- PAGE ') AND len(list_filter(string_split({t}, '--- PAGE '),
         lambda p: NOT ({BLANK_SQL.format(t="p")}) AND {blank})) > 0 THEN 'blank_page'
    WHEN {NONSPACE_SQL.format(t=t)} / {word_count_sql(t)} < 2 THEN 'unreadable_scan'
    WHEN {ALPHA_SQL.format(t=t)} <= 0.6 THEN 'low_alphabetic_ratio'"""


def failure_sql(text_ok: str = "sha256(raw_text) <> checksum") -> str:
    """The gates as one CASE."""
    return f"CASE{schema_sql(text_ok)}{content_sql()} END"


VALIDATED = f""",
validated AS (SELECT *, {failure_sql()} AS failure_reason FROM envelope)"""


@query(
    "validate_documents",
    with_sql("envelope", rest=f"""{VALIDATED}
SELECT doc_id, source_type, failure_reason,
  CASE WHEN failure_reason IS NULL THEN round({ALPHA_SQL.format(t="raw_text")}, 6) END AS quality_score FROM validated"""),
)
def validate_documents(spark, sf):
    v = quality.validate(inputs.envelope(spark, sf))
    return v.select("doc_id", "source_type", "failure_reason", F.round("quality_score", 6).alias("quality_score"))


@query(
    "validation_summary",
    with_sql("envelope", rest=f"""{VALIDATED}
SELECT source_type, failure_reason, count(*) AS rejected FROM validated WHERE failure_reason IS NOT NULL GROUP BY ALL"""),
)
def validation_summary(spark, sf):
    return quality.failure_summary(quality.validate(inputs.envelope(spark, sf)))


@query(
    "response_envelope",
    """SELECT conv_id, turn, confidence_value, error, error IS NULL AS valid FROM (
  SELECT *, TRY_CAST(confidence AS DOUBLE) AS confidence_value,
    CASE WHEN answer IS NULL THEN 'answer is missing' WHEN confidence IS NULL THEN 'confidence is missing'
         WHEN TRY_CAST(confidence AS DOUBLE) IS NULL THEN 'confidence is not a number' END AS error
  FROM (SELECT conv_id, turn, CASE WHEN role <> 'system' THEN text END AS answer,
          CASE WHEN length(text) % 7 = 0 THEN NULL WHEN length(text) % 11 = 0 THEN 'high'
               ELSE '0.' || (length(text) % 10) END AS confidence FROM conversations))""",
)
def response_envelope(spark, sf):
    n = F.char_length("text")
    c = inputs.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") != "system", F.col("text")).alias("answer"),
        F.when(n % 7 == 0, None).when(n % 11 == 0, "high").otherwise(F.concat(F.lit("0."), (n % 10).cast("string"))).alias("confidence"),
    )
    return quality.response_envelope(c, "answer", "confidence").select("conv_id", "turn", "confidence_value", "error", "valid")


# Texts and their likeliest language, by character pairs counted over all documents.
LANGUAGE_SQL = f"""slots AS (
  SELECT doc_id, lang, unnest(list_transform(range(1, len(c)), lambda i: (ord(c[i]) * {quality.GRAM_FACTOR} + ord(c[i + 1])) % {quality.GRAM_SLOTS})) AS slot
  FROM (SELECT doc_id, lang, string_split(lower(text), '') AS c FROM documents)),
per_slot AS (SELECT lang, slot, count(*) AS n FROM slots GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS total FROM per_slot GROUP BY lang),
model AS (SELECT lang, slot, ln((n + 1) / (total + {quality.GRAM_SLOTS})) AS logp FROM per_slot JOIN totals USING (lang)),
counts AS (SELECT doc_id, slot, count(*) AS n FROM slots GROUP BY ALL),
scores AS (
  SELECT doc_id, t.lang, sum(n * coalesce(logp, ln(1.0 / (total + {quality.GRAM_SLOTS})))) AS s
  FROM counts c CROSS JOIN totals t LEFT JOIN model m ON m.lang = t.lang AND m.slot = c.slot GROUP BY ALL),
probs AS (
  SELECT doc_id, lang, s, exp(s - max(s) OVER d) / sum(exp(s - m)) OVER d AS p, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) AS rn
  FROM (SELECT *, max(s) OVER (PARTITION BY doc_id) AS m FROM scores) WINDOW d AS (PARTITION BY doc_id))"""


@query(
    "language_id",
    f"""WITH {LANGUAGE_SQL}
SELECT doc_id, lang AS language, round(p, 4) AS prob, p < 0.85 AS uncertain_language,
  CASE WHEN lang NOT IN ('en','fr','de','es','hi','zh') THEN 'language_not_allowed' END AS failure_reason
FROM probs WHERE rn = 1""",
)
def language_id(spark, sf):
    docs = inputs.table(spark, sf, "documents")
    model = quality.train_language_model(docs)
    found = quality.language_gate(quality.identify_language(docs, model))
    return found.withColumn("prob", F.round("prob", 4))


KEYED = """,
keyed AS (SELECT *, sha256('s3://raw/' || lang || ':' || sha256(raw_text)) AS k, epoch(ingestion_ts)::BIGINT AS t FROM envelope)"""


def keyed_documents(spark, sf):
    """Documents submitted under one address per language, so copies share a key."""
    uri = F.concat(F.lit("s3://raw/"), "lang")
    e = inputs.envelope(spark, sf)
    return e.select(
        "doc_id", "ingestion_ts", F.unix_seconds("ingestion_ts").alias("t"),
        hashing.dedup_key(uri, F.sha2("raw_text", 256)).alias("k"),
    )


@query(
    "dedup_first_wins",
    with_sql("envelope", rest=f"""{KEYED}
SELECT doc_id, k AS dedup_key, doc_id <> first_id AS is_duplicate, CASE WHEN doc_id <> first_id THEN first_id END AS existing_doc_id
FROM (SELECT *, first_value(doc_id) OVER (PARTITION BY k ORDER BY t, doc_id) AS first_id FROM keyed)"""),
)
def dedup_first_wins(spark, sf):
    d = dedup.first_wins(keyed_documents(spark, sf), "k", "t", "doc_id")
    return d.select("doc_id", F.col("k").alias("dedup_key"), "is_duplicate", "existing_doc_id")


def ttl_sql(rows: str, ttl: int) -> str:
    """First-wins with a TTL over ``rows(k, t, id)``: each registration opens ``ttl`` seconds."""
    return f""",
ttl_rows AS ({rows}),
regs AS (
  SELECT k, min(t) AS reg FROM ttl_rows WHERE k IS NOT NULL GROUP BY k
  UNION ALL
  SELECT e.k, min(e.t) FROM regs r JOIN ttl_rows e ON e.k = r.k AND e.t >= r.reg + {ttl} GROUP BY e.k),
owned AS (
  SELECT e.id, e.k, e.t, r.reg, min(CASE WHEN e.t = r.reg THEN e.id END) OVER (PARTITION BY e.k, r.reg) AS owner
  FROM ttl_rows e LEFT JOIN regs r ON e.k = r.k AND e.t >= r.reg AND e.t < r.reg + {ttl})
SELECT id, k IS NOT NULL AND id <> owner AS is_duplicate, CASE WHEN id <> owner THEN owner END AS existing_id FROM owned"""


@query("dedup_ttl", with_sql("envelope", rest=KEYED + ttl_sql("SELECT k, t, doc_id AS id FROM keyed", 86400), recursive=True))
def dedup_ttl(spark, sf):
    d = dedup.ttl_dedup(keyed_documents(spark, sf), "k", "t", "doc_id", 86400)
    return d.select(F.col("doc_id").alias("id"), "is_duplicate", F.col("existing_doc_id").alias("existing_id"))


IDEMPOTENT = """SELECT CASE WHEN event_type <> 'view' THEN user_id || ':' || event_type END AS k, epoch(ts)::BIGINT AS t, event_id AS id FROM events"""


@query("idempotency_filter", "WITH RECURSIVE seed AS (SELECT 1)" + ttl_sql(IDEMPOTENT.replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT"), 86400))
def idempotency_filter(spark, sf):
    e = inputs.table(spark, sf, "events")
    key = F.when(F.col("event_type") != "view", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    rows = e.select(key.alias("k"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("id"))
    d = dedup.ttl_dedup(rows, "k", "t", "id", 86400)
    return d.select("id", "is_duplicate", F.col("existing_doc_id").alias("existing_id"))


@query(
    "dedup_release",
    with_sql("envelope", rest="""
SELECT dedup_key FROM (SELECT DISTINCT sha256(source_uri || ':' || checksum) AS dedup_key FROM envelope)
WHERE dedup_key NOT IN (
  SELECT sha256(source_uri || ':' || checksum) FROM envelope JOIN labels USING (doc_id) WHERE toxic = 1)"""),
)
def dedup_release(spark, sf):
    e = inputs.envelope(spark, sf)
    keys = e.select(hashing.dedup_key(F.col("source_uri"), F.col("checksum")).alias("dedup_key")).distinct()
    toxic = inputs.table(spark, sf, "labels").where(F.col("toxic") == 1).select("doc_id")
    return dedup.release_keys(keys, e.join(toxic, "doc_id", "left_semi"))


SECRET = b"webhook-secret"
_PAD = hashlib.sha256(SECRET).digest() if len(SECRET) > 64 else SECRET
_IPAD = bytes(b ^ 0x36 for b in _PAD.ljust(64, b"\0")).hex()
_OPAD = bytes(b ^ 0x5C for b in _PAD.ljust(64, b"\0")).hex()


@query(
    "webhook_verify",
    f"""WITH s AS (SELECT event_id, event_type, sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(props)))) AS good FROM events),
sent AS (SELECT event_id, good, CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN md5(good) WHEN 'view' THEN upper(good) ELSE good END AS signature FROM s)
SELECT event_id, signature, coalesce(lower(signature) = good, false) AS valid FROM sent""",
)
def webhook_verify(spark, sf):
    e = inputs.table(spark, sf, "events")
    good = hashing.hmac_sha256(F.col("props"), SECRET)
    kind = F.col("event_type")
    sent = F.when(kind == "error", None).when(kind == "click", F.md5(good.cast("binary"))).when(kind == "view", F.upper(good)).otherwise(good)
    s = e.select("event_id", "props", sent.alias("signature"))
    return s.select("event_id", "signature", dedup.signature_valid(F.col("props"), F.col("signature"), SECRET).alias("valid"))


DIRTY_SQL = "replace(replace({t}, ', ', ',  ' || chr(7)), '.' || chr(10), '.' || repeat(chr(10), 4))"


def dirty(c):
    """Doubled spaces, bells and runs of blank lines for the cleaning steps to undo."""
    noisy = F.replace(c, F.lit(", "), F.lit(",  \x07"))
    return F.replace(noisy, F.lit(".\n"), F.lit(".\n\n\n\n"))


CONTROL_SQL = r"regexp_replace({t}, '[\x00-\x08\x0b-\x1f\x7f-\x{{9f}}\p{{Cf}}]', '', 'g')"


def collapse_sql(t: str) -> str:
    inline = rf"regexp_replace({t}, '[\x0b\x0c\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g')"
    return strip_sql(rf"regexp_replace({inline}, '\n{{3,}}', chr(10) || chr(10), 'g')")


@query(
    "clean_text",
    f"SELECT doc_id, {collapse_sql(CONTROL_SQL.format(t=DIRTY_SQL.format(t='text')))} AS clean_text FROM documents",
)
def clean_text(spark, sf):
    d = inputs.table(spark, sf, "documents")
    return d.select("doc_id", tx.collapse_whitespace(tx.strip_controls(dirty(F.col("text")))).alias("clean_text"))


@query("table_flag", f"SELECT doc_id, {TABLE_SQL.format(t='text')} AS is_table FROM documents")
def table_flag(spark, sf):
    return inputs.table(spark, sf, "documents").select("doc_id", tx.is_table(F.col("text")).alias("is_table"))


def boilerplate_sql(source: str, share: float = 0.8) -> str:
    line = strip_sql("s")
    return rf""",
pg AS (
  SELECT doc_id, unnest(pages) AS page, generate_subscripts(pages, 1) AS pno, len(pages) AS np FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(text, '--- PAGE \d+ ---\n?'), lambda p: NOT ({BLANK_SQL.format(t="p")})) AS pages FROM {source})),
ln AS (
  SELECT doc_id, pno, np, unnest(lines) AS line, generate_subscripts(lines, 1) AS lno FROM (
    SELECT doc_id, pno, np, list_filter(list_transform(string_split(page, chr(10)), lambda s: {line}), lambda s: s <> '') AS lines FROM pg)),
bp AS (
  SELECT doc_id, line FROM ln GROUP BY doc_id, line, np
  HAVING np >= 3 AND length(line) > 3 AND count(DISTINCT pno) / np > {share}),
kept AS (SELECT * FROM ln ANTI JOIN bp USING (doc_id, line)),
page_text AS (
  SELECT p.doc_id, p.pno, coalesce(string_agg(k.line, chr(10) ORDER BY k.lno), '') AS body
  FROM pg p LEFT JOIN kept k ON k.doc_id = p.doc_id AND k.pno = p.pno GROUP BY p.doc_id, p.pno),
rebuilt AS (
  SELECT doc_id, string_agg('--- PAGE ' || pno || ' ---' || chr(10) || body, chr(10) || chr(10) ORDER BY pno) AS text FROM page_text GROUP BY doc_id),
removed AS (
  SELECT s.doc_id, CASE WHEN s.doc_id IN (SELECT doc_id FROM bp) THEN r.text ELSE s.text END AS text
  FROM {source} s LEFT JOIN rebuilt r USING (doc_id))"""


@query("boilerplate_lines", with_sql("binders", rest=boilerplate_sql("binders") + " SELECT doc_id, line FROM bp"))
def boilerplate_lines(spark, sf):
    return inputs.binders(spark, sf).select("doc_id", F.explode(cleaning.boilerplate(F.col("text"))).alias("line"))


@query("boilerplate_removed", with_sql("binders", rest=boilerplate_sql("binders") + " SELECT doc_id, text AS clean_text FROM removed"))
def boilerplate_removed(spark, sf):
    return cleaning.remove_boilerplate(inputs.binders(spark, sf), "text", "clean_text").select("doc_id", "clean_text")


# The test texts are in normal form, so the SQL twin can leave that step out.
@query(
    "clean_full",
    with_sql("binders", rest=f""",
noisy AS (SELECT doc_id, {CONTROL_SQL.format(t=DIRTY_SQL.format(t="text"))} AS text FROM binders){boilerplate_sql("noisy")}
SELECT doc_id, {collapse_sql("text")} AS clean_text FROM removed"""),
)
def clean_full(spark, sf):
    noisy = inputs.binders(spark, sf).select("doc_id", dirty(F.col("text")).alias("text"))
    return cleaning.clean(noisy, "text").select("doc_id", "clean_text")


SENTS = f"sents AS (SELECT doc_id, text, {sentences_sql('text')} AS s FROM documents)"


@query(
    "sentence_split",
    f"WITH {SENTS} SELECT doc_id, pos, sentence, {word_count_sql('sentence')} AS token_count FROM "
    "(SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM sents)",
)
def sentence_split(spark, sf):
    return chunking.sentence_table(inputs.table(spark, sf, "documents"), "text")


@query(
    "sentence_windows",
    f"""WITH {SENTS},
w AS (SELECT doc_id, text AS full_text, s, unnest(range(0, len(s))) AS chunk_index FROM sents),
c AS (SELECT doc_id, full_text, chunk_index, s[chunk_index + 1] AS base_sentence, s[greatest(chunk_index - 3, 0) + 1] AS opening,
        array_to_string(s[greatest(chunk_index - 3, 0) + 1 : chunk_index + 4], ' ') AS text FROM w)
SELECT doc_id, chunk_index, base_sentence, text, {word_count_sql("text")} AS token_count, instr(full_text, opening) - 1 AS char_start,
  instr(full_text, opening) - 1 + length(text) AS char_end FROM c""",
)
def sentence_windows(spark, sf):
    return chunking.sentence_window(inputs.table(spark, sf, "documents"), "text").select(
        "doc_id", "chunk_index", "base_sentence", "text", "token_count", "char_start", "char_end"
    )


def fixed_sql(size: int, overlap: int) -> str:
    return f"""WITH RECURSIVE {SENTS},
counted AS (SELECT doc_id, text, s, list_transform(s, lambda x: {word_count_sql("x")}) AS n FROM sents WHERE len(s) > 0),
p AS (SELECT doc_id, text, s, list_transform(range(0, len(s) + 1), lambda i: coalesce(list_sum(n[1:i]), 0)::BIGINT) AS total FROM counted),
walk AS (
  SELECT doc_id, 0 AS chunk_index, 0::BIGINT AS a, greatest(1, len(list_filter(total, lambda x: x <= {size})) - 1)::BIGINT AS b, len(s) AS n FROM p
  UNION ALL
  SELECT doc_id, chunk_index + 1, a2, greatest(a2 + 1, len(list_filter(total, lambda x: x <= total[a2 + 1] + {size})) - 1)::BIGINT, n FROM (
    SELECT w.doc_id, w.chunk_index, w.n, p.total, greatest(w.a + 1, len(list_filter(p.total, lambda x: x < p.total[w.b + 1] - {overlap})))::BIGINT AS a2
    FROM walk w JOIN p USING (doc_id) WHERE w.b < w.n)),
chunks AS (
  SELECT doc_id, chunk_index, a AS sentence_start, p.text AS full_text, s[a + 1] AS opening, array_to_string(s[a + 1 : b], ' ') AS text
  FROM walk JOIN p USING (doc_id))"""


@query(
    "chunks_fixed",
    fixed_sql(128, 16) + f""" SELECT sha256(doc_id || ':fixed:' || chunk_index) AS chunk_id, doc_id, chunk_index, text, {word_count_sql("text")} AS token_count FROM chunks""",
)
def chunks_fixed(spark, sf):
    c = chunking.fixed(inputs.table(spark, sf, "documents"), "text", 128, 16)
    return c.select("chunk_id", "doc_id", "chunk_index", "text", "token_count")


@query(
    "chunk_offsets",
    fixed_sql(512, 64) + f""" SELECT doc_id, chunk_index, sentence_start, instr(full_text, opening) - 1 AS char_start,
  instr(full_text, opening) - 1 + length(text) AS char_end, {TABLE_SQL.format(t="text")} AS is_table FROM chunks""",
)
def chunk_offsets(spark, sf):
    c = chunking.fixed(inputs.table(spark, sf, "documents"), "text")
    return c.select("doc_id", "chunk_index", "sentence_start", "char_start", "char_end", "is_table")


@query("chunks_semantic")
def chunks_semantic(spark, sf):
    c = chunking.semantic(inputs.table(spark, sf, "documents"), "text", threshold=0.1)
    return c.select("chunk_id", "doc_id", "chunk_index", "token_count", "char_start", "char_end", "sentence_start")


@query("chunks_by_strategy")
def chunks_by_strategy(spark, sf):
    d = inputs.table(spark, sf, "documents").withColumn(
        "strategy", F.when(F.col("lang") == "en", "fixed").when(F.col("lang") == "fr", "semantic").otherwise("sentence_window")
    )
    c = chunking.chunk_by_column(d, "text")
    return c.groupBy("chunk_strategy").agg(
        F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.sum("token_count").alias("tokens")
    )


def contains_sql(t: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({t}, '{w}')::INT" for w in words) + ")"


SYLLABLE_SQL = (
    "CASE WHEN {w} = '' THEN 0 ELSE greatest(1, len(regexp_extract_all({w}, '[aeiouy]+')) - CASE WHEN {w}[-1] = 'e' THEN 1 ELSE 0 END) END"
)


def features_sql() -> str:
    """The features in SQL. DuckDB rounds x.xx5 after scaling, which lifts doubles just below a half;
    rounding the decimal value keeps them down."""
    from docspark.operators.features import CONTRACT_WORDS, INVOICE_WORDS, REPORT_WORDS

    syl = SYLLABLE_SQL.format(w="x")
    return rf""",
f0 AS (
  SELECT *, lower(raw_text) AS low, {words_sql("raw_text")} AS w, len({sentences_sql("raw_text")}) AS ns,
    len(regexp_extract_all(raw_text, '--- PAGE \d+ ---')) AS marks FROM envelope),
f1 AS (
  SELECT *, CASE WHEN marks > 0 THEN marks WHEN page_count > 0 THEN page_count ELSE 1 END::INT AS pages,
    coalesce(list_sum(list_transform(list_transform(w, lambda y: regexp_replace(lower(y), '[^a-z]', '', 'g')), lambda x: {syl})), 0) AS syl,
    coalesce(list_sum(list_transform(range(2, len(w) + 1), lambda i: CASE WHEN regexp_matches(w[i], '^\p{{Lu}}') AND w[i - 1][-1] NOT IN ('.', '?', '!') THEN 1 ELSE 0 END)), 0) AS nouns,
    {contains_sql("low", INVOICE_WORDS)} AS inv, {contains_sql("low", CONTRACT_WORDS)} AS con, {contains_sql("low", REPORT_WORDS)} AS rep FROM f0),
feats AS (
  SELECT doc_id, source_type, ingestion_ts, pages AS page_count, round(len(w) / greatest(pages, 1), 2) AS avg_words_per_page, {TABLE_SQL.format(t="raw_text")} AS has_tables,
    source_type = 'image' OR metadata = '{{"images": true}}' AS has_images, language,
    CASE WHEN contains(low, 'subject:') AND (contains(low, 'to:') OR contains(low, 'from:') OR contains(low, 'cc:')) THEN 'email'
         WHEN greatest(inv, con, rep) = 0 THEN 'other' WHEN inv = greatest(inv, con, rep) THEN 'invoice'
         WHEN con = greatest(inv, con, rep) THEN 'contract' ELSE 'report' END AS doc_type_signal,
    CASE WHEN len(w) = 0 THEN 0.0 ELSE greatest(0.0, round((0.39::DOUBLE * (len(w) / greatest(ns, 1)) + 11.8::DOUBLE * (syl / len(w)) - 15.59::DOUBLE)::DECIMAL(30, 15), 2)::DOUBLE) END AS reading_level,
    CASE WHEN len(w) = 0 THEN 0.0 ELSE round(nouns / len(w), 4) END AS entity_density, round({ALPHA_SQL.format(t="raw_text")}, 4) AS text_quality_score
  FROM f1)"""


FEATURE_COLS = "doc_id, page_count, avg_words_per_page, has_tables, has_images, language, doc_type_signal, reading_level, entity_density, text_quality_score"


@query("doc_features", with_sql("envelope", rest=features_sql() + f" SELECT {FEATURE_COLS} FROM feats"))
def doc_features(spark, sf):
    return features.document_features(inputs.envelope(spark, sf))


@query(
    "feature_vector",
    with_sql("envelope", rest=features_sql() + """ SELECT doc_id, page_count::DOUBLE AS v0, avg_words_per_page AS v1, has_tables::INT::DOUBLE AS v2, has_images::INT::DOUBLE AS v3,
  CASE language WHEN 'en' THEN 0.0 WHEN 'fr' THEN 1.0 WHEN 'de' THEN 2.0 WHEN 'es' THEN 3.0 WHEN 'hi' THEN 4.0 WHEN 'zh' THEN 5.0 ELSE 6.0 END::DOUBLE AS v4,
  CASE doc_type_signal WHEN 'invoice' THEN 0.0 WHEN 'contract' THEN 1.0 WHEN 'report' THEN 2.0 WHEN 'email' THEN 3.0 ELSE 4.0 END::DOUBLE AS v5,
  reading_level AS v6, entity_density AS v7, text_quality_score AS v8 FROM feats"""),
)
def feature_vector(spark, sf):
    v = features.feature_vector(features.document_features(inputs.envelope(spark, sf)))
    return v.select("doc_id", *(F.col("vector")[i].alias(f"v{i}") for i in range(9)))


@query(
    "doc_type_counts",
    with_sql("envelope", rest=f"""{VALIDATED}{features_sql()},
firsts AS (
  SELECT * FROM (SELECT doc_id, failure_reason, row_number() OVER (PARTITION BY sha256('s3://raw/' || lang || ':' || checksum) ORDER BY ingestion_ts, doc_id) AS rn
    FROM validated WHERE failure_reason IS NULL) WHERE rn = 1)
SELECT language, doc_type_signal, count(*) AS documents, round(avg(reading_level), 4) AS mean_reading_level,
  round(avg(text_quality_score), 4) AS mean_quality FROM feats SEMI JOIN firsts USING (doc_id) GROUP BY ALL"""),
)
def doc_type_counts(spark, sf):
    """Gate, first-wins deduplication, features and a summary: the flagship query."""
    e = quality.validate(inputs.envelope(spark, sf)).where(F.col("failure_reason").isNull())
    uri = F.concat(F.lit("s3://raw/"), "lang")
    slim = e.select("doc_id", "ingestion_ts", "source_type", "raw_text", "language", "page_count", "metadata",
                    hashing.dedup_key(uri, F.col("checksum")).alias("k"))
    # Features are narrow and need no shuffle, so they are computed before the deduplication.
    first = dedup.distinct_first(_features_with_key(slim), "k", "ingestion_ts", "doc_id")
    return first.groupBy("language", "doc_type_signal").agg(
        F.count("*").alias("documents"), F.round(F.avg("reading_level"), 4).alias("mean_reading_level"),
        F.round(F.avg("text_quality_score"), 4).alias("mean_quality"),
    )


def _features_with_key(slim):
    t = F.col("raw_text")
    return slim.select(
        "doc_id", "ingestion_ts", "k", "language",
        features.doc_type_signal(t).alias("doc_type_signal"),
        features.reading_level(t).alias("reading_level"),
        F.round(tx.alpha_ratio(t), 4).alias("text_quality_score"),
    )


@query(
    "keyword_class",
    with_sql("receipts", rest=f""", texts AS (SELECT 'd' || doc_id AS id, lower(text) AS t FROM documents UNION ALL SELECT 'r' || doc_id, lower(text) FROM receipts)
SELECT id, CASE WHEN {contains_sql("t", ["resume", "cv", "curriculum vitae", "experience"])} > 0 THEN 'resume'
  WHEN {contains_sql("t", ["contract", "agreement"])} > 0 THEN 'contract' WHEN {contains_sql("t", ["invoice", "bill"])} > 0 THEN 'invoice'
  WHEN contains(t, 'report') THEN 'report' ELSE 'other' END AS class FROM texts"""),
)
def keyword_class(spark, sf):
    d = inputs.table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    r = inputs.receipts(spark, sf).select(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("id"), "text")
    return d.unionByName(r).select("id", features.keyword_class(F.col("text")).alias("class"))


LONG = """,
long AS (
  SELECT doc_id, ingestion_ts AS computed_at, unnest(['page_count','avg_words_per_page','has_tables','has_images','language','doc_type_signal','reading_level','entity_density','text_quality_score']) AS feature_name,
    unnest([page_count::VARCHAR, avg_words_per_page::VARCHAR, CASE WHEN has_tables THEN 'True' ELSE 'False' END, CASE WHEN has_images THEN 'True' ELSE 'False' END,
      language, doc_type_signal, reading_level::VARCHAR, entity_density::VARCHAR, text_quality_score::VARCHAR]) AS feature_value FROM feats),
updates AS (SELECT doc_id, computed_at + INTERVAL 6 HOUR AS computed_at, feature_name, (feature_value::INT + 1)::VARCHAR AS feature_value FROM long WHERE feature_name = 'page_count'),
hist AS (SELECT *, 0 AS gen FROM long UNION ALL SELECT *, 1 FROM updates)"""


def stored_features(spark, sf):
    """Features in long form at ingestion time, and a later page count for every document."""
    e = inputs.envelope(spark, sf)
    f = features.document_features(e)
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    long = features.to_long(f, at)
    recount = e.select("doc_id", (features.page_count(F.col("raw_text"), F.col("page_count")) + 1).alias("page_count"))
    upd = features.to_long(recount, at + F.expr("INTERVAL 6 HOURS"))
    return long, upd


@query("feature_store_long", with_sql("envelope", rest=features_sql() + LONG + """
SELECT doc_id, feature_name, arg_max(feature_value, (computed_at, gen)) AS feature_value FROM hist GROUP BY ALL"""))
def feature_store_long(spark, sf):
    long, upd = stored_features(spark, sf)
    return features.upsert(long, upd).select("doc_id", "feature_name", "feature_value")


@query("feature_store_asof", with_sql("envelope", rest=features_sql() + LONG + """
SELECT doc_id, feature_name, arg_max(feature_value, (computed_at, gen)) AS feature_value FROM hist
WHERE computed_at <= TIMESTAMP '2024-01-01 12:00:00' GROUP BY ALL"""))
def feature_store_asof(spark, sf):
    long, upd = stored_features(spark, sf)
    asof = F.lit("2024-01-01 12:00:00").cast("timestamp")
    return features.upsert(long, upd, asof).select("doc_id", "feature_name", "feature_value")


@query("feature_store_wide", with_sql("envelope", rest=features_sql() + """
SELECT doc_id, page_count + 1 AS page_count, avg_words_per_page, has_tables, has_images, language, doc_type_signal, reading_level, entity_density, text_quality_score FROM feats"""))
def feature_store_wide(spark, sf):
    long, upd = stored_features(spark, sf)
    wide = features.to_wide(features.upsert(long, upd))
    return wide.select("doc_id", *features.FEATURE_TYPES)


@query(
    "features_with_outputs",
    """WITH e AS (SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS entity_count FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'invoice' WHEN lang = 'en' THEN 'report' ELSE 'other' END AS doc_type_signal, entity_count,
  CASE WHEN doc_id % 3 = 0 THEN round((doc_id % 10) / 10.0::DOUBLE, 6) ELSE 0.0 END AS class_confidence FROM documents JOIN e USING (doc_id)""",
)
def features_with_outputs(spark, sf):
    """Numbers stand for entities; every third document has a predicted class."""
    d = inputs.table(spark, sf, "documents")
    signal = F.when(F.col("lang") == "en", "report").otherwise("other")
    found = d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("text"))
    known = d.where("doc_id % 3 = 0").select("doc_id", F.lit("invoice").alias("predicted_class"), ((F.col("doc_id") % 10) / 10.0).alias("confidence"))
    out = features.with_model_outputs(d.select("doc_id", signal.alias("doc_type_signal")), found, known)
    return out.withColumn("class_confidence", F.round("class_confidence", 6))
