"""Classification, evaluation and drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark import inputs, plans
from docspark.functions import text as tx
from docspark.inputs import sentences_sql, with_sql, words_sql
from docspark.operators import classify, drift, entities, evaluate, features
from docspark.operators import vectors as vec
from docspark.plans import query
from docspark.plans.entities import REGIONS, spans_sql
from docspark.session import cut_lineage, scratch_path
from docspark.sources import log

CLASS_ORDER = "list_position(['" + "','".join(classify.CLASSES) + "'], {c})"


@query(
    "blend_calibrate",
    with_sql("preds", rest=""",
blended AS (SELECT doc_id, class, ord, sum(p * CASE model WHEN 'classifier' THEN 0.4 ELSE 0.6 END) AS p FROM preds WHERE model <> 'vision' GROUP BY ALL),
warm AS (SELECT doc_id, class, ord, exp(z - max(z) OVER (PARTITION BY doc_id)) AS e FROM (SELECT *, ln(p + 1e-9) / 0.5 AS z FROM blended)),
cal AS (SELECT *, e / sum(e) OVER (PARTITION BY doc_id) AS p FROM warm)
SELECT doc_id, class AS predicted_class, round(p, 4) AS confidence, p < 0.6 AS uncertain FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, ord) AS rn FROM cal) WHERE rn = 1"""),
)
def blend_calibrate(spark, sf):
    m = inputs.class_maps(spark, sf)
    blended = classify.blend(classify.align(F.col("classifier")), classify.align(F.col("llm")))
    c = m.select("doc_id", classify.calibrate(blended, 0.5).alias("p"))
    name, conf, unsure = classify.decide(F.col("p"))
    return c.select("doc_id", name.alias("predicted_class"), conf.alias("confidence"), unsure.alias("uncertain"))


VOTE = """,
active AS (SELECT p.*, CASE model WHEN 'classifier' THEN 0.5 WHEN 'vision' THEN 0.25 END AS given FROM preds p JOIN documents USING (doc_id) WHERE NOT (model = 'vision' AND lang = 'de')),
counted AS (SELECT *, count(DISTINCT model) OVER (PARTITION BY doc_id) AS n FROM active),
weighed AS (SELECT *, coalesce(given, 1.0::DOUBLE / n) AS w FROM counted),
shares AS (SELECT *, w / (sum(w) OVER (PARTITION BY doc_id) / 8) AS share FROM weighed),
voted AS (SELECT doc_id, class, ord, round(sum(p * share), 4) AS p FROM shares GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, ord) AS rn FROM voted)"""
WEIGHTS = {"classifier": 0.5, "vision": 0.25}


def votes(spark, sf):
    m = inputs.class_maps(spark, sf).withColumn("vision", F.when(F.col("lang") != "de", F.col("vision")))
    return m, classify.vote({k: F.col(k) for k in ("classifier", "vision", "llm")}, WEIGHTS)


@query(
    "ensemble_vote",
    with_sql("preds", rest=VOTE + """
SELECT a.doc_id, a.class AS final_class, a.p AS confidence, a.p - b.p <= 0.1 AS is_ambiguous FROM ranked a JOIN ranked b ON a.doc_id = b.doc_id AND a.rn = 1 AND b.rn = 2"""),
)
def ensemble_vote(spark, sf):
    m, v = votes(spark, sf)
    return m.select("doc_id", *(v[k].alias(k) for k in ("final_class", "confidence", "is_ambiguous")))


@query(
    "ensemble_contributions",
    with_sql("preds", rest=VOTE + """
, w AS (SELECT DISTINCT doc_id, model, round(share, 4) AS share FROM shares)
SELECT d.doc_id, coalesce(max(share) FILTER (model = 'classifier'), 0.0) AS w_classifier, coalesce(max(share) FILTER (model = 'vision'), 0.0) AS w_vision,
  coalesce(max(share) FILTER (model = 'llm'), 0.0) AS w_llm, any_value(o.p) AS p_other FROM documents d JOIN w USING (doc_id) JOIN voted o ON o.doc_id = d.doc_id AND o.class = 'other' GROUP BY d.doc_id"""),
)
def ensemble_contributions(spark, sf):
    m, v = votes(spark, sf)
    r = m.select("doc_id", v["weights"].alias("w"), v["blended_probabilities"].alias("b"))
    return r.select("doc_id", *(F.col("w")[k].alias(f"w_{k}") for k in ("classifier", "vision", "llm")), F.col("b")["other"].alias("p_other"))


@query(
    "class_from_reply",
    """SELECT conv_id, turn, CASE length(text) % 10 WHEN 0 THEN 'invoice' WHEN 1 THEN 'contract' WHEN 2 THEN 'report' WHEN 3 THEN 'email' WHEN 4 THEN 'form'
  WHEN 5 THEN 'receipt' WHEN 6 THEN 'legal' WHEN 7 THEN 'invoice' ELSE 'other' END AS class FROM conversations""",
)
def class_from_reply(spark, sf):
    c = inputs.table(spark, sf, "conversations")
    n = F.char_length("text") % 10
    names = F.array(*(F.lit(s) for s in ("An INVOICE.", " contract", "report", "email", "a form", "receipt", "legal", "Form or invoice", "nothing", "?")))
    probs = classify.to_probabilities(None, F.when(n == 3, " Email "), F.get(names, n))
    by = F.filter(F.map_entries(probs), lambda e: e["value"] == 1.0)
    return c.select("conv_id", "turn", by[0]["key"].alias("class"))


@query(
    "ensemble_entities",
    with_sql("receipts", rest=spans_sql("receipts", entities.ENTITY_PATTERNS) + REGIONS + """,
kinds AS (SELECT r.doc_id, o_orderstatus = 'F' AS use_ner FROM receipts r JOIN orders ON o_orderkey = doc_id),
e AS (SELECT s.doc_id, s.label, s."start" AS a, length(s.text) AS n FROM spans s JOIN kinds USING (doc_id) WHERE use_ner
  UNION ALL SELECT g.doc_id, upper(g.label), 0, length(g.text) FROM regions g JOIN kinds USING (doc_id) WHERE NOT use_ner)
SELECT doc_id, count(*) AS entities, string_agg(label, ',' ORDER BY label) AS labels, sum(n)::BIGINT AS chars FROM e GROUP BY doc_id"""),
)
def ensemble_entities(spark, sf):
    from docspark.plans.entities import boxed

    r = inputs.receipts(spark, sf)
    status = inputs.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus")
    ner = r.select("doc_id", entities.extract_entities(F.col("text")).alias("ner")).join(status, "doc_id")
    regions = boxed(spark, sf).select("doc_id", entities.layout_regions(F.col("tokens")).alias("regions"))
    j = ner.join(regions, "doc_id").withColumn("ner", F.when(F.col("o_orderstatus") == "F", F.col("ner")))
    m = j.select("doc_id", classify.merge_entities(F.col("ner"), F.col("regions")).alias("e"))
    labels = F.array_join(F.array_sort(F.transform("e", lambda x: x["label"])), ",")
    chars = F.aggregate(F.transform("e", lambda x: F.char_length(x["text"])), F.lit(0).cast("long"), lambda s, x: s + x)
    return m.select("doc_id", F.size("e").alias("entities"), labels.alias("labels"), chars.alias("chars"))


ROUTE = """,
routed AS (SELECT doc_id, CASE WHEN source_type = 'image' THEN ['vision', 'ner'] ELSE ['classifier', 'ner'] END
  || CASE WHEN lang = 'en' AND length(raw_text) > 500 THEN ['llm'] ELSE [] END AS models, byte_size / 1000.0 AS latency FROM envelope)"""


def routed(spark, sf):
    e = inputs.envelope(spark, sf)
    prompt = F.when(F.char_length("raw_text") > 500, "summarise").otherwise("")
    models = classify.route(F.col("source_type"), F.col("lang") == "en", prompt)
    return e.select("doc_id", models.alias("models_run"), (F.col("byte_size") / 1000.0).alias("latency"))


@query("model_route", with_sql("envelope", rest=ROUTE + " SELECT doc_id, array_to_string(models, '+') AS models FROM routed"))
def model_route(spark, sf):
    return routed(spark, sf).select("doc_id", F.array_join("models_run", "+").alias("models"))


@query(
    "route_trace",
    with_sql("envelope", rest=ROUTE + """ SELECT model, count(*) AS executions, round(avg(latency), 4) AS mean_latency, max(latency) AS max_latency
FROM (SELECT unnest(models) AS model, latency FROM routed) GROUP BY model"""),
)
def route_trace(spark, sf):
    return classify.trace_summary(routed(spark, sf)).withColumn("mean_latency", F.round("mean_latency", 4))


@query("train_structural")
def train_structural(spark, sf):
    labels = inputs.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    v = features.feature_vector(features.document_features(inputs.envelope(spark, sf)))
    _, accuracy = classify.train_structural(v.join(labels, "doc_id"), rounds=10)
    return accuracy


@query("train_text")
def train_text(spark, sf):
    labels = inputs.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    d = vec.encode(inputs.table(spark, sf, "documents").select("doc_id", "text").join(labels, "doc_id"), F.col("text"))
    _, accuracy = classify.train_text(d)
    return accuracy


def ascii_words_sql(t: str) -> str:
    return words_sql(rf"lower(regexp_replace({t}, '[^a-zA-Z0-9\t-\r\x1c-\x1f\x{{85}}\p{{Z}}]', '', 'g'))")


# The longest common subsequence row by row: what ends at a word, then the running maximum.
ROUGE_ROWS = f""",
ro AS (SELECT conv_id, turn, {ascii_words_sql("b")} AS p, {ascii_words_sql("a")} AS r FROM answers),
lcs AS (
  SELECT conv_id, turn, 0 AS i, list_transform(r, lambda x: 0) AS best FROM ro
  UNION ALL
  SELECT conv_id, turn, i + 1, list_transform(range(1, len(ends) + 1), lambda j: list_max(ends[1:j])) FROM (
    SELECT conv_id, turn, i, list_transform(range(1, len(r) + 1), lambda k: CASE WHEN r[k] = p[i + 1] THEN coalesce(best[k - 1], 0) + 1 ELSE best[k] END) AS ends
    FROM lcs JOIN ro USING (conv_id, turn) WHERE i < len(p))),
rouge AS (
  SELECT conv_id, turn, CASE WHEN len(p) * len(r) = 0 THEN 0.0 ELSE round(2.0::DOUBLE * best[len(r)] / (len(p) + len(r)), 4) END AS rouge_l
  FROM lcs JOIN ro USING (conv_id, turn) WHERE i = len(p))"""
ROUGE = ROUGE_ROWS + " SELECT conv_id, turn, rouge_l FROM rouge"


@query("rouge_l", with_sql("answers", rest=ROUGE, recursive=True))
def rouge_l(spark, sf):
    a = inputs.answers(spark, sf)
    return a.select("conv_id", "turn", evaluate.rouge_l(F.col("b"), F.col("a")).alias("rouge_l"))


@query(
    "token_overlap",
    with_sql("answers", rest=f""",
s AS (SELECT conv_id, turn, list_distinct({ascii_words_sql("b")}) AS p, list_distinct({ascii_words_sql("a")}) AS r FROM answers),
o AS (SELECT *, len(list_intersect(p, r)) AS n FROM s)
SELECT conv_id, turn, CASE WHEN n > 0 THEN round(0.5 + 2.0::DOUBLE * n / (len(p) + len(r)) * 0.5, 4) ELSE 0.0 END AS token_overlap FROM o"""),
)
def token_overlap(spark, sf):
    a = inputs.answers(spark, sf)
    return a.select("conv_id", "turn", evaluate.token_overlap(F.col("b"), F.col("a")).alias("token_overlap"))


def scored_sentences(spark, sf):
    """Sentences of every turn with a label and score from their length."""
    c = inputs.table(spark, sf, "conversations")
    s = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("response_id"), F.explode(tx.sentences(F.col("text"))).alias("sentence")
    )
    n = F.char_length("sentence")
    label = F.when(n % 3 == 0, "CONTRADICTION").when(n % 3 == 1, "entailment").otherwise("contradictory")
    return s.select("response_id", "sentence", label.alias("label"), F.when(n % 7 != 0, (n % 10) / 10.0).alias("score"))


@query(
    "combined_evaluation",
    with_sql("answers", recursive=True, rest=ROUGE_ROWS + f""",
ev AS (SELECT conv_id, turn, list_distinct(p) AS p, list_distinct(r) AS r, len(list_intersect(list_distinct(p), list_distinct(r))) AS n FROM ro),
se AS (SELECT conv_id, turn, unnest({sentences_sql("b")}) AS s FROM answers),
cr AS (SELECT conv_id, turn, round(avg((contains(lower(s), 'contradict') OR contains(lower(s), 'not true') OR contains(lower(s), ' the '))::INT), 4) AS c FROM se GROUP BY ALL)
SELECT conv_id, turn, rouge_l, CASE WHEN n > 0 THEN round(0.5 + 2.0::DOUBLE * n / (len(p) + len(r)) * 0.5, 4) ELSE 0.0 END AS token_overlap,
  coalesce(c, 0.0) AS contradiction_rate FROM rouge JOIN ev USING (conv_id, turn) LEFT JOIN cr USING (conv_id, turn)"""),
)
def combined_evaluation(spark, sf):
    """Sentences with ' the ' stand for those a model found to contradict; wording decides on the rest."""
    a = inputs.answers(spark, sf).withColumn("response_id", F.concat_ws("/", "conv_id", "turn"))
    s = a.select("response_id", F.explode(tx.sentences(F.col("b"))).alias("sentence"))
    told = F.contains(F.lower("sentence"), F.lit(" the "))
    s = s.select("response_id", "sentence", F.when(told, "CONTRADICTION").alias("label"), F.when(told, 0.9).alias("score"))
    e = evaluate.evaluate(a, "b", "a", s)
    return e.select("conv_id", "turn", "rouge_l", "token_overlap", "contradiction_rate")


@query(
    "contradiction_rate",
    f"""WITH s AS (SELECT conv_id * 1000 + turn AS response_id, unnest({sentences_sql("text")}) AS sentence FROM conversations),
h AS (SELECT response_id, CASE WHEN length(sentence) % 7 = 0 THEN contains(lower(sentence), 'contradict') OR contains(lower(sentence), 'not true')
  ELSE length(sentence) % 3 <> 1 AND (length(sentence) % 10) / 10.0 > 0.5 END AS hit FROM s)
SELECT response_id, round(avg(hit::INT), 4) AS contradiction_rate FROM h GROUP BY response_id""",
)
def contradiction_rate(spark, sf):
    return evaluate.contradiction_rate(scored_sentences(spark, sf))


@query(
    "contradiction_penalty",
    """WITH l AS (SELECT vec_id // 5 AS answer_id, list_transform((embedding::DOUBLE[])[1:3], lambda x: x * 20) AS z FROM embeddings),
p AS (SELECT answer_id, exp(z[3]) / (exp(z[1]) + exp(z[2]) + exp(z[3])) AS p FROM l),
m AS (SELECT answer_id, max(p) AS p FROM p GROUP BY answer_id)
SELECT answer_id, round(p, 6) AS max_contradiction, p > 0.7 AS contradicted, CASE WHEN p > 0.7 THEN 0.6 ELSE 0.9 END::DOUBLE AS confidence FROM m""",
)
def contradiction_penalty(spark, sf):
    e = inputs.table(spark, sf, "embeddings")
    z = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 3), lambda x: x * 20)
    s = e.select((F.col("vec_id") / 5).cast("long").alias("answer_id"), F.lit(0.9).alias("confidence"), z.alias("logits"))
    return evaluate.contradiction_penalty(s).withColumn("max_contradiction", F.round("max_contradiction", 6))


@query(
    "eval_series",
    with_sql("answers", rest=f""",
s AS (SELECT conv_id, list_distinct({ascii_words_sql("b")}) AS p, list_distinct({ascii_words_sql("a")}) AS r FROM answers),
o AS (SELECT conv_id // 10 AS batch, CASE WHEN len(list_intersect(p, r)) > 0 THEN round(0.5 + 2.0::DOUBLE * len(list_intersect(p, r)) / (len(p) + len(r)) * 0.5, 4) ELSE 0.0 END AS v FROM s)
SELECT batch, count(*) AS pairs, round(avg(v), 6) AS token_overlap FROM o GROUP BY batch"""),
)
def eval_series(spark, sf):
    scored = inputs.answers(spark, sf).select(
        F.floor(F.col("conv_id") / 10).alias("batch"), evaluate.token_overlap(F.col("b"), F.col("a")).alias("v")
    )
    return scored.groupBy("batch").agg(F.count("*").alias("pairs"), F.round(F.avg("v"), 6).alias("token_overlap")).orderBy("batch")


SIDED = """sided AS (SELECT *, CASE WHEN doc_id < (SELECT (min(doc_id) + max(doc_id)) / 2 FROM documents) THEN 'ref' ELSE 'cur' END AS side, length(text) AS len FROM documents)"""


def sided_documents(spark, sf):
    return inputs.halves(inputs.table(spark, sf, "documents"), "doc_id").withColumn("len", F.char_length("text"))


def psi_sql(source: str, x: str, name: str = "psi") -> str:
    return f""",
{name}_r AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi
  FROM (SELECT min({x})::DOUBLE AS lo, max({x})::DOUBLE AS hi FROM {source} WHERE side = 'ref')),
{name}_b AS (SELECT side, CASE WHEN {x} >= lo AND {x} <= hi THEN list_sum(list_transform(range(1, 10), lambda i: ({x} >= lo + i * ((hi - lo) / 10))::INT)) END AS bin FROM {source}, {name}_r),
{name}_c AS (SELECT bin, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS c FROM {name}_b GROUP BY bin),
{name}_n AS (SELECT sum(r) AS n_r, sum(c) AS n_c FROM {name}_c),
{name}_s AS (SELECT CASE WHEN r = 0 THEN 1e-4 ELSE r / n_r END AS e, CASE WHEN c = 0 THEN 1e-4 ELSE c / n_c END AS a FROM {name}_c, {name}_n WHERE bin IS NOT NULL),
{name} AS (SELECT sum((a - e) * ln(a / e)) AS psi FROM {name}_s)"""


@query("psi_value", f"WITH {SIDED}{psi_sql('sided', 'len')} SELECT round(psi, 6) AS psi FROM psi")
def psi_value(spark, sf):
    return drift.psi(sided_documents(spark, sf), "len").select(F.round("psi", 6).alias("psi"))


KS = """,
ks_n AS (SELECT len, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS c FROM sided GROUP BY len),
ks_f AS (SELECT sum(r) OVER (ORDER BY len) / sum(r) OVER () AS f1, sum(c) OVER (ORDER BY len) / sum(c) OVER () AS f2 FROM ks_n),
ks AS (SELECT max(abs(f1 - f2)) AS statistic FROM ks_f)"""


KS_P = """(SELECT CASE WHEN lam < 1e-3 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * (k * lam) * (k * lam)))))) END
  FROM (SELECT statistic * sqrt(n * m / (n + m)::DOUBLE) AS lam FROM ks, (SELECT (count(*) FILTER (side = 'ref'))::DOUBLE AS n, (count(*) FILTER (side = 'cur'))::DOUBLE AS m FROM sided)))"""
CHI_P = """(SELECT CASE WHEN chi2 <= 0 OR dof <= 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, 2000), lambda k: exp((dof / 2.0 + k) * ln(chi2 / 2) - chi2 / 2 - lgamma(dof / 2.0 + k + 1))))) END FROM chi)"""


@query(
    "ks_text_length",
    f"""WITH {SIDED}{KS} SELECT round(statistic, 6) AS statistic, (SELECT count(*) FROM sided WHERE side = 'ref') AS n_ref, (SELECT count(*) FROM sided WHERE side = 'cur') AS n_cur, round({KS_P}, 6) AS p_value FROM ks""",
)
def ks_text_length(spark, sf):
    one = drift.ks_two_sample(sided_documents(spark, sf), "len")
    return one.select(F.round("statistic", 6).alias("statistic"), "n_ref", "n_cur", F.round("p_value", 6).alias("p_value"))


CHI = """,
ch_c AS (SELECT lang, count(*) FILTER (side = 'ref') + 1 AS r, count(*) FILTER (side = 'cur') + 1 AS c FROM sided GROUP BY lang),
ch_n AS (SELECT sum(r) AS n_r, sum(c) AS n_c, count(*) AS k FROM ch_c),
ch_e AS (SELECT r, c, k, n_r * (r + c) / (n_r + n_c) AS er, n_c * (r + c) / (n_r + n_c) AS ec FROM ch_c, ch_n),
ch_d AS (SELECT er, ec, abs(r - er) - CASE WHEN k = 2 THEN least(0.5, abs(r - er)) ELSE 0 END AS dr, abs(c - ec) - CASE WHEN k = 2 THEN least(0.5, abs(c - ec)) ELSE 0 END AS dc FROM ch_e),
chi AS (SELECT sum(dr * dr / er + dc * dc / ec) AS chi2, count(*) - 1 AS dof FROM ch_d)"""


@query("chi2_language", f"WITH {SIDED}{CHI} SELECT round(chi2, 6) AS chi2, dof, round({CHI_P}, 6) AS p_value FROM chi")
def chi2_language(spark, sf):
    return drift.chi2_two_sides(sided_documents(spark, sf), "lang").select(F.round("chi2", 6).alias("chi2"), "dof", F.round("p_value", 6).alias("p_value"))


def js_sql(source: str, x: str, name: str) -> str:
    return f""",
{name}_c AS (SELECT {x} AS cat, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS c FROM {source} GROUP BY ALL),
{name}_p AS (SELECT r / sum(r) OVER () AS p, c / sum(c) OVER () AS q FROM {name}_c),
{name} AS (SELECT sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END / 2 + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END / 2) AS js FROM {name}_p)"""


TOP = """,
top AS (SELECT doc_id, class, p, CASE WHEN doc_id < (SELECT (min(doc_id) + max(doc_id)) / 2 FROM documents) THEN 'ref' ELSE 'cur' END AS side FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, ord) AS rn FROM preds WHERE model = 'classifier') WHERE rn = 1)"""


def top_classes(spark, sf):
    m = inputs.class_maps(spark, sf).select("doc_id", classify.align(F.col("classifier")).alias("p"))
    name, _, _ = classify.decide(F.col("p"))
    return inputs.halves(m.select("doc_id", name.alias("class"), F.array_max("p").alias("p")), "doc_id")


@query("js_classes", with_sql("preds", rest=TOP + js_sql("top", "class", "js") + " SELECT round(js, 6) AS js FROM js"))
def js_classes(spark, sf):
    return drift.js_categorical(top_classes(spark, sf), "class").select(F.round("js", 6).alias("js"))


JSC = """,
jc_b AS (SELECT side, list_sum(list_transform(range(1, 10), lambda i: (p >= 0.0 + i * ((1.0::DOUBLE - 0.0) / 10))::INT)) AS bin FROM top WHERE p >= 0 AND p <= 1),
jc_g AS (SELECT unnest(range(0, 10)) AS bin),
jc_c AS (SELECT g.bin, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS c FROM jc_g g LEFT JOIN jc_b b ON b.bin = g.bin GROUP BY g.bin),
jc_d AS (SELECT CASE WHEN r = 0 THEN 1e-5 ELSE r / sum(r) OVER () * 10 END AS p, CASE WHEN c = 0 THEN 1e-5 ELSE c / sum(c) OVER () * 10 END AS q FROM jc_c),
jc_n AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM jc_d),
jc AS (SELECT sum((p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2) AS js FROM jc_n)"""


@query("js_confidence", with_sql("preds", rest=TOP + JSC + " SELECT round(js, 6) AS js FROM jc"))
def js_confidence(spark, sf):
    return drift.js_scores(top_classes(spark, sf), "p").select(F.round("js", 6).alias("js"))


def vector_sides(spark, sf):
    return inputs.halves(inputs.table(spark, sf, "embeddings"), "vec_id")


@query("psi_embeddings")
def psi_embeddings(spark, sf):
    return drift.psi_vectors(vector_sides(spark, sf)).select("dim", F.round("psi", 6).alias("psi"))


RATES = "len(regexp_extract_all(text, '[0-9]+'))"


@query(
    "drift_report",
    with_sql("preds", rest=TOP + JSC + js_sql("top", "class", "jp") + f", {SIDED}{KS}{CHI}" + js_sql("sided", RATES, "je") + f""",
scores AS (SELECT {KS_P} AS k, {CHI_P} AS c, jp.js AS p, jc.js AS s, je.js AS e FROM jp, jc, je)
SELECT k < 0.05 OR c < 0.05 OR p > 0.1 OR s > 0.1 OR e > 0.1 AS other_drift, round(p, 6) AS predicted_classes_js, round(s, 6) AS confidence_scores_js,
  round(e, 6) AS entity_extraction_rates_js, round(k, 6) AS text_length_ks_p, round(c, 6) AS language_chi2_p,
  array_to_string(list_filter([CASE WHEN k < 0.05 THEN 'text_lengths' END, CASE WHEN c < 0.05 THEN 'languages' END, CASE WHEN p > 0.1 THEN 'predicted_classes' END,
    CASE WHEN s > 0.1 THEN 'confidence_scores' END, CASE WHEN e > 0.1 THEN 'entity_extraction_rates' END], lambda x: x IS NOT NULL), ',') AS affected,
  true AS embeddings_scored FROM scores"""),
)
def drift_report(spark, sf):
    # Each score reads its side table several times, so the narrow columns are written down once.
    sides = sided_documents(spark, sf)
    docs = cut_lineage(sides.select("side", "len", "lang", F.regexp_count("text", F.lit("[0-9]+")).cast("string").alias("rate")))
    top = cut_lineage(top_classes(spark, sf).select("side", "class", "p"))
    vectors = inputs.halves(inputs.table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id")
    r = drift.report(
        {
            "embedding_psi": drift.psi_largest(vectors),
            "text_length_ks_p": drift.ks_two_sample(docs, "len").select("p_value"),
            "language_chi2_p": drift.chi2_two_sides(docs, "lang").select("p_value"),
            "predicted_classes_js": drift.js_categorical(top, "class"),
            "confidence_scores_js": drift.js_scores(top, "p"),
            "entity_extraction_rates_js": drift.js_categorical(docs, "rate"),
        },
        spark,
    )
    # A component's sign and basis are the solver's, so its score is checked for being there only.
    others = F.array_remove("affected_features", "embeddings")
    names = ("predicted_classes_js", "confidence_scores_js", "entity_extraction_rates_js", "text_length_ks_p", "language_chi2_p")
    return r.select(
        (F.size(others) > 0).alias("other_drift"), *(F.round(n, 6).alias(n) for n in names),
        F.array_join(others, ",").alias("affected"), (F.col("embedding_psi") >= 0).alias("embeddings_scored"),
    )


@query(
    "drift_window_split",
    """SELECT side, count(*) AS events FROM (SELECT CASE WHEN ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY THEN 'ref' ELSE 'cur' END AS side FROM events) GROUP BY side""",
)
def drift_window_split(spark, sf):
    e = inputs.table(spark, sf, "events")
    cut = e.agg(F.max("ts") - F.expr("INTERVAL 7 DAYS")).scalar()
    return drift.split_window(e, "ts", cut).groupBy("side").agg(F.count("*").alias("events"))


@query(
    "report_tables",
    f"""WITH e AS ({plans.ORACLES["combined_evaluation"]}), d AS ({plans.ORACLES["drift_report"]})
SELECT 'evaluation-' || (conv_id % 10) AS report_id, 'evaluation' AS kind, sum(rouge_l > 0.2)::BIGINT AS above, sum(contradiction_rate > 0)::BIGINT AS contradicted, NULL AS affected FROM e GROUP BY ALL
UNION ALL SELECT 'drift-1', 'drift', NULL, NULL, affected FROM d""",
)
def report_tables(spark, sf):
    """Drift and evaluation reports appended to one table, twice and in part again; every report is there once (SNK5)."""
    e = plans.QUERIES["combined_evaluation"](spark, sf)
    e = e.groupBy(F.concat(F.lit("evaluation-"), (F.col("conv_id") % 10).cast("string")).alias("report_id")).agg(
        F.lit("evaluation").alias("kind"), F.count(F.when(F.col("rouge_l") > 0.2, 1)).alias("above"),
        F.count(F.when(F.col("contradiction_rate") > 0, 1)).alias("contradicted"), F.lit(None).cast("string").alias("affected"),
    )
    none = F.lit(None).cast("long")
    d = plans.QUERIES["drift_report"](spark, sf).select(F.lit("drift-1").alias("report_id"), F.lit("drift").alias("kind"), none.alias("above"), none.alias("contradicted"), "affected")
    root = scratch_path(spark, "reports")
    e, both = cut_lineage(e), cut_lineage(e.unionByName(d))
    for reports in (e, both, both):
        log.append_reports(reports, root)
    return log.read_table(spark, root, "reports", both.schema)
