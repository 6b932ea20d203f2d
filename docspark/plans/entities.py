"""Entities, personal data and layout over ``documents``, ``orders`` text and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark import inputs
from docspark.functions import text as tx
from docspark.inputs import with_sql, words_sql
from docspark.operators import entities as ent
from docspark.plans import query


def spans_sql(source: str, patterns: dict[str, str]) -> str:
    """Matches with offsets: pieces between fences, odd ones are matches."""
    each = " UNION ALL ".join(
        f"""SELECT doc_id, '{label}' AS label, {n} AS ord, regexp_split_to_array(regexp_replace(text, '{p}', chr(1) || '\\0' || chr(2), 'g'), '[' || chr(1) || chr(2) || ']') AS pieces FROM {source}"""
        for n, (label, p) in enumerate(patterns.items())
    )
    return f""",
pieces AS ({each}),
spans AS (
  SELECT doc_id, label, ord, pieces[i] AS text, coalesce(list_sum(list_transform(pieces[1:i - 1], lambda p: length(p))), 0)::BIGINT AS "start",
    coalesce(list_sum(list_transform(pieces[1:i], lambda p: length(p))), 0)::BIGINT AS "end"
  FROM (SELECT doc_id, label, ord, pieces, unnest(range(2, len(pieces) + 1, 2)) AS i FROM pieces))"""


SPAN_COLS = 'doc_id, text, label, "start", "end"'


def exploded(df, spans):
    return df.select("doc_id", F.explode(spans).alias("e")).select("doc_id", "e.text", "e.label", "e.start", "e.end")


@query("regex_entities", with_sql("receipts", rest=spans_sql("receipts", ent.ENTITY_PATTERNS) + f" SELECT {SPAN_COLS} FROM spans"))
def regex_entities(spark, sf):
    return exploded(inputs.receipts(spark, sf), ent.regex_entities(F.col("text")))


# The custom pattern matches again what the invoice and contract patterns hold, and loses to them.
@query("entities_all", with_sql("receipts", rest=spans_sql("receipts", ent.ENTITY_PATTERNS) + f" SELECT {SPAN_COLS} FROM spans"))
def entities_all(spark, sf):
    return exploded(inputs.receipts(spark, sf), ent.extract_entities(F.col("text"), patterns={"REFERENCE": r"\b(?:INV|CON)-\d+\b"}))


@query(
    "entity_overlap",
    with_sql("receipts", rest=spans_sql("receipts", {"A": r"[A-Za-z]+ [A-Z]+-[0-9]+", "B": r"[A-Z]+-[0-9]+ [a-z]+"}) + """
SELECT doc_id, text, label, "start", "end" FROM (
  SELECT a.*, length(a.text) >= length(b.text) AS a_wins FROM spans a JOIN spans b ON a.doc_id = b.doc_id AND a.label = 'A' AND b.label = 'B'
    AND greatest(a."start", b."start") < least(a."end", b."end") WHERE length(a.text) >= length(b.text)
  UNION ALL
  SELECT b.*, false FROM spans a JOIN spans b ON a.doc_id = b.doc_id AND a.label = 'A' AND b.label = 'B'
    AND greatest(a."start", b."start") < least(a."end", b."end") WHERE length(a.text) < length(b.text)
  UNION ALL
  SELECT s.*, false FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans o WHERE o.doc_id = s.doc_id AND o.label <> s.label
    AND greatest(o."start", s."start") < least(o."end", s."end")))"""),
)
def entity_overlap(spark, sf):
    spans = F.concat(
        ent.regex_spans(F.col("text"), "A", r"[A-Za-z]+ [A-Z]+-[0-9]+"), ent.regex_spans(F.col("text"), "B", r"[A-Z]+-[0-9]+ [a-z]+")
    )
    return exploded(inputs.receipts(spark, sf), ent.resolve_overlaps(spans))


def tagged_turns(spark, sf):
    """Every turn's words as token predictions tagged by word length."""
    c = inputs.table(spark, sf, "conversations")
    base = c.select("conv_id", "turn", tx.words(F.col("text")).alias("w")).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "w", F.array_join("w", " ").alias("text")
    )
    ends = F.aggregate(
        "w", F.array().cast("array<int>"),
        lambda acc, w: F.concat(acc, F.array((F.coalesce(F.try_element_at(acc, F.lit(-1)) + 1, F.lit(0)) + F.char_length(w)).cast("int"))),
    )
    base = base.withColumn("ends", ends)
    tags = F.array(*(F.lit(t) for t in ("O", "B-PER", "I-PER", "I-ORG", "B-LOC")))

    def token(w, end):
        n = F.char_length(w)
        return F.struct(
            F.when(n % 7 == 0, F.concat(F.lit("##"), w)).otherwise(w).alias("word"), F.get(tags, n % 5).alias("entity"),
            (end - n).alias("start"), end.alias("end"), ((n % 10) / 10.0).alias("score"),
        )

    return base.select("doc_id", "text", F.zip_with("w", "ends", token).alias("tokens"))


BIO = f"""WITH c AS (SELECT conv_id * 1000 + turn AS doc_id, {words_sql("text")} AS w FROM conversations),
tok AS (
  SELECT doc_id, i, word, length(word) % 7 = 0 AS sub, ['O','B-PER','I-PER','I-ORG','B-LOC'][length(word) % 5 + 1] AS tag,
    (length(word) % 10) / 10.0::DOUBLE AS score FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM c)),
named AS (
  SELECT *, CASE split_part(tag, '-', 2) WHEN 'PER' THEN 'PERSON' WHEN 'LOC' THEN 'LOCATION' ELSE split_part(tag, '-', 2) END AS label,
    coalesce(lag(tag) OVER (PARTITION BY doc_id ORDER BY i) <> 'O', false) AS active,
    coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "start" FROM tok),
owned AS (SELECT *, CASE WHEN tag <> 'O' AND NOT (sub AND active) THEN label END AS own FROM named),
held AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_label FROM owned),
flagged AS (SELECT *, tag <> 'O' AND NOT (active AND (sub OR (tag LIKE 'I-%' AND label = open_label))) AS fresh FROM held),
grouped AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM flagged),
merged AS (
  SELECT doc_id, g, arg_min(label, i) AS label, string_agg(word, ' ' ORDER BY i) AS text, min("start") AS "start", max("start" + length(word)) AS "end",
    round(sum(score) / count(*), 4) AS confidence FROM grouped WHERE tag <> 'O' GROUP BY doc_id, g)"""


@query("bio_merge", BIO + f" SELECT {SPAN_COLS} FROM merged")
def bio_merge(spark, sf):
    return exploded(tagged_turns(spark, sf), ent.merge_tokens(F.col("text"), F.col("tokens")))


@query(
    "pii_entity_redact",
    BIO + """, pieces AS (
  SELECT c.doc_id, c.i, CASE WHEN c.tag <> 'O' AND m.label IN ('PERSON', 'LOCATION') THEN CASE WHEN c."start" = m."start" THEN '[REDACTED_' || m.label || ']' END ELSE c.word END AS piece
  FROM grouped c LEFT JOIN merged m ON m.doc_id = c.doc_id AND m.g = c.g)
SELECT doc_id, coalesce(string_agg(piece, ' ' ORDER BY i), '') AS redacted FROM pieces GROUP BY doc_id""",
)
def pii_entity_redact(spark, sf):
    t = tagged_turns(spark, sf).select("doc_id", "text", ent.merge_tokens(F.col("text"), F.col("tokens")).alias("spans"))
    return t.select("doc_id", ent.redact_spans(F.col("text"), F.col("spans")).alias("redacted"))


P = ent.PII_PATTERNS
REDACTED = f"""pii AS (
  SELECT *, regexp_replace(p3, '{P["CREDIT_CARD"]}', '[REDACTED_CREDIT_CARD]', 'g') AS p4 FROM (
  SELECT *, regexp_replace(p2, '{P["SSN"]}', '[REDACTED_SSN]', 'g') AS p3 FROM (
  SELECT *, regexp_replace(p1, '{P["PHONE"]}', '[REDACTED_PHONE]', 'g') AS p2 FROM (
  SELECT *, regexp_replace(text, '{P["EMAIL"]}', '[REDACTED_EMAIL]', 'g') AS p1 FROM documents)))),
pii5 AS (SELECT *, regexp_replace(p4, '([^\\p{{L}}\\p{{N}}_]+)', chr(1) || '\\1' || chr(1), 'g') AS fenced FROM pii),
redacted AS (
  SELECT doc_id, source, text, p1, p2, p3, p4, fenced,
    replace(regexp_replace(fenced, '(^|\\x01)[A-Z0-9]{{9}}($|\\x01)', '\\1[REDACTED_PASSPORT]\\2', 'g'), chr(1), '') AS p5 FROM pii5)"""


@query("pii_redact", f"WITH {REDACTED} SELECT doc_id, p5 AS redacted FROM redacted")
def pii_redact(spark, sf):
    return inputs.table(spark, sf, "documents").select("doc_id", ent.redact(F.col("text")).alias("redacted"))


FENCED_TEXT = "regexp_replace(text, '([^\\p{L}\\p{N}_]+)', chr(1) || '\\1' || chr(1), 'g')"


@query(
    "pii_reject",
    f"""SELECT doc_id, CASE WHEN regexp_matches(text, '{P["EMAIL"]}') THEN 'EMAIL' WHEN regexp_matches(text, '{P["PHONE"]}') THEN 'PHONE'
  WHEN regexp_matches(text, '{P["SSN"]}') THEN 'SSN' WHEN regexp_matches(text, '{P["CREDIT_CARD"]}') THEN 'CREDIT_CARD'
  WHEN regexp_matches({FENCED_TEXT}, '(^|\\x01)[A-Z0-9]{{9}}($|\\x01)') THEN 'PASSPORT' END AS violation FROM documents""",
)
def pii_reject(spark, sf):
    return inputs.table(spark, sf, "documents").select("doc_id", ent.violation(F.col("text")).alias("violation"))


@query(
    "pii_counts",
    f"""WITH {REDACTED} SELECT source, sum(len(regexp_extract_all(text, '{P["EMAIL"]}')))::BIGINT AS email, sum(len(regexp_extract_all(p1, '{P["PHONE"]}')))::BIGINT AS phone,
  sum(len(regexp_extract_all(p2, '{P["SSN"]}')))::BIGINT AS ssn, sum(len(regexp_extract_all(p3, '{P["CREDIT_CARD"]}')))::BIGINT AS credit_card,
  sum(len(regexp_extract_all(fenced, '(?:^|\\x01)[A-Z0-9]{{9}}(?:$|\\x01)')))::BIGINT AS passport FROM redacted GROUP BY source""",
)
def pii_counts(spark, sf):
    d = inputs.table(spark, sf, "documents")
    each = ent.pii_counts(F.col("text"))
    per_doc = d.select("source", *(c.alias(k.lower()) for k, c in each.items()))
    return per_doc.groupBy("source").agg(*(F.sum(k.lower()).alias(k.lower()) for k in each))


@query(
    "kv_pairs",
    with_sql("receipts", rest=f""",
w AS (SELECT doc_id, {words_sql("text")} AS w FROM receipts),
k AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: ends_with(w[i], ':')) AS stops FROM w),
p AS (SELECT doc_id, w, stops, unnest(list_filter(stops, lambda i: i < len(w))) AS i FROM k)
SELECT doc_id, lower(left(w[i], length(w[i]) - 1)) AS key,
  array_to_string(w[i + 1 : coalesce(list_filter(stops, lambda j: j > i + 1)[1], len(w) + 1) - 1], ' ') AS value FROM p"""),
)
def kv_pairs(spark, sf):
    r = inputs.receipts(spark, sf)
    return r.select("doc_id", F.explode(ent.key_values(tx.words(F.col("text")))).alias("p")).select("doc_id", "p.key", "p.value")


def boxed(spark, sf):
    """Words of every receipt on a grid of ten columns."""
    words = tx.words(F.col("text"))

    def box(w, i):
        x, y = (i % 10) * 100, F.floor(i / 10).cast("int") * 50
        return F.struct(w.alias("word"), F.array(x, y, x + 80, y + 30).alias("box"))

    return inputs.receipts(spark, sf).select("doc_id", F.transform(words, box).alias("tokens"))


REGIONS = f""",
w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM (SELECT doc_id, {words_sql("text")} AS w FROM receipts)),
b AS (SELECT *, contains(word, '|') OR contains(lower(word), 'total') OR contains(lower(word), 'price') AS is_table, i % 10 * 100 AS x, i // 10 * 50 AS y FROM w),
regions AS (
  SELECT doc_id, CASE WHEN is_table THEN 'table' ELSE 'text' END AS label, CASE WHEN is_table THEN 0.88 ELSE 0.92 END::DOUBLE AS confidence,
    min(x)::BIGINT AS x0, min(y)::BIGINT AS y0, max(x + 80)::BIGINT AS x1, max(y + 30)::BIGINT AS y1, string_agg(word, ' ' ORDER BY i) AS text FROM b GROUP BY doc_id, is_table)"""


@query("layout_regions", with_sql("receipts", rest=REGIONS + " SELECT * FROM regions"))
def layout_regions(spark, sf):
    r = boxed(spark, sf).select("doc_id", F.explode(ent.layout_regions(F.col("tokens"))).alias("r"))
    corners = [F.col("r.bbox")[i].cast("long").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    return r.select("doc_id", "r.label", "r.confidence", *corners, "r.text")


@query(
    "layout_structure",
    with_sql("receipts", rest=REGIONS + """
SELECT doc_id, '<document>' || chr(10) || string_agg('  <' || label || ' bbox=''[' || x0 || ',' || y0 || ',' || x1 || ',' || y1 || ']'' confidence=''' || confidence || '''>' || chr(10)
  || '    ' || text || chr(10) || '  </' || label || '>' || chr(10), '' ORDER BY label) || '</document>' AS markup FROM regions GROUP BY doc_id"""),
)
def layout_structure(spark, sf):
    return boxed(spark, sf).select("doc_id", ent.structure(ent.layout_regions(F.col("tokens"))).alias("markup"))


@query(
    "box_scale",
    """SELECT l_orderkey, l_linenumber, greatest(0, least(1000, trunc(l_discount * 1700 * 1000 / 1700)::INT)) AS x0, greatest(0, least(1000, trunc(l_tax * 2200 * 1000 / 2200)::INT)) AS y0,
  greatest(0, least(1000, trunc((l_discount * 1700 + l_quantity * 40) * 1000 / 1700)::INT)) AS x1, greatest(0, least(1000, trunc((l_tax * 2200 + l_quantity * 50) * 1000 / 2200)::INT)) AS y1 FROM lineitem""",
)
def box_scale(spark, sf):
    li = inputs.table(spark, sf, "lineitem")
    x, y = F.col("l_discount") * 1700, F.col("l_tax") * 2200
    box = ent.scale_box([x, y, x + F.col("l_quantity") * 40, y + F.col("l_quantity") * 50], F.lit(1700), F.lit(2200))
    b = li.select("l_orderkey", "l_linenumber", box.alias("b"))
    return b.select("l_orderkey", "l_linenumber", *(F.col("b")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


# Line items as words read off a page; every third is blank.
@query(
    "page_tokens",
    """WITH w AS (
  SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber % 3 = 0 THEN ' ' || chr(9) ELSE '  ' || l_returnflag || l_linestatus || chr(10) END AS t, l_linenumber AS n,
    l_quantity::INT * 20 AS x, l_linenumber * 300 AS y FROM lineitem),
b AS (SELECT doc_id, trim(t, ' ' || chr(9) || chr(10)) AS word, n, x, y, [x, y, x + 90, y + 30] AS px FROM w)
SELECT doc_id, count(*) AS tokens, string_agg(word || ':' || greatest(0, least(1000, trunc(px[1] * 1000 / 850)::INT)) || ',' || greatest(0, least(1000, trunc(px[2] * 1000 / 1100)::INT))
  || ',' || greatest(0, least(1000, trunc(px[3] * 1000 / 850)::INT)) || ',' || greatest(0, least(1000, trunc(px[4] * 1000 / 1100)::INT)), ' ' ORDER BY n, x, word) AS placed
FROM b WHERE word <> '' GROUP BY doc_id""",
)
def page_tokens(spark, sf):
    n = F.col("l_linenumber")
    text = F.when(n % 3 == 0, " \t").otherwise(F.concat(F.lit("  "), "l_returnflag", "l_linestatus", F.lit("\n")))
    left, top = F.col("l_quantity").cast("int") * 20, (n * 300).cast("int")
    word = F.struct(text.alias("text"), left.alias("left"), top.alias("top"), F.lit(90).alias("width"), F.lit(30).alias("height"))
    li = inputs.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.struct(n.alias("n"), left.alias("x"), text.alias("t"), word.alias("w")).alias("o"))
    pages = li.groupBy("doc_id").agg(F.sort_array(F.collect_list("o")).alias("o"))
    t = pages.select("doc_id", ent.page_tokens(F.transform("o", lambda o: o["w"]), F.lit(850), F.lit(1100)).alias("t")).where(F.size("t") > 0)
    shown = F.transform("t", lambda w: F.concat(w["word"], F.lit(":"), F.array_join(w["box"].cast("array<string>"), ",")))
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.array_join(shown, " ").alias("placed"))
