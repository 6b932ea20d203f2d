"""Class probabilities: blending, calibration, voting, routing and training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.bind import let
from docspark.functions.vectors import softmax
from docspark.session import cut_lineage

# The classes, in tie order, and the blend weights.
CLASSES = ["invoice", "contract", "report", "email", "form", "receipt", "legal", "other"]
BLEND = {"structural": 0.4, "text": 0.6}
UNCERTAIN_BELOW = 0.6
AMBIGUOUS_WITHIN = 0.1
EPS = 1e-9


def align(probs: Column) -> Column:
    """The map's probabilities in class order, absent classes zero (CLS3).

    Of keys that differ in case only the last stands.
    """

    def pick(entries: Column) -> Column:
        named = lambda c: F.filter(entries, lambda e: F.lower(e["key"]) == c)
        return F.array(*(F.coalesce(F.try_element_at(named(c), F.lit(-1))["value"], F.lit(0.0)) for c in CLASSES))

    return let(F.map_entries(probs), pick)


def blend(structural: Column, text: Column, weights: dict[str, float] = BLEND) -> Column:
    """Weighted sum per class, weights brought to one (CLS4)."""
    total = sum(weights.values())
    a, b = weights["structural"] / total, weights["text"] / total
    return F.zip_with(structural, text, lambda x, y: x * a + y * b)


def calibrate(probs: Column, temperature: float) -> Column:
    """Temperature scaling over log probabilities (CLS5)."""
    if temperature == 1.0:
        return probs
    return softmax(F.transform(probs, lambda p: F.log(p + EPS) / max(1e-5, temperature)))


def decide(probs: Column) -> tuple[Column, Column, Column]:
    """(class, rounded confidence, uncertain flag); a tie goes to the first class (CLS6)."""
    best = F.array_max(probs)
    name = F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position(probs, best).cast("int"))
    return name, F.round(best, 4), best < UNCERTAIN_BELOW


def one_hot(name: Column) -> Column:
    target = F.lower(F.trim(name))
    known = F.when(target.isin(CLASSES), target).otherwise("other")
    return F.map_from_arrays(
        F.array(*map(F.lit, CLASSES)), F.array(*(F.when(known == c, 1.0).otherwise(0.0) for c in CLASSES))
    )


def to_probabilities(probs: Column | None, label: Column | None, reply: Column | None) -> Column:
    """A probability map from a map, a label, or the first class named in free text (ENS1)."""
    choices = []
    if probs is not None:
        choices.append(probs)
    if label is not None:
        choices.append(F.when(label.isNotNull(), one_hot(label)))
    if reply is not None:
        low = F.lower(F.trim(reply))
        first = F.lit("other")
        for c in reversed(CLASSES):
            first = F.when(F.contains(low, F.lit(c)), F.lit(c)).otherwise(first)
        choices.append(F.when(reply.isNotNull(), one_hot(first)))
    return F.coalesce(*choices)


def vote(models: dict[str, Column], weights: dict[str, float]) -> dict[str, Column]:
    """Weighted vote over the models that answered (ENS2, ENS3, ENS5).

    ``models`` maps a name to a nullable probability map in the same row, so no shuffle. A model
    without a weight gets an equal share of the active ones.
    """
    n = sum((p.isNotNull().cast("int") for p in models.values()), F.lit(0))
    raw = {
        m: F.when(p.isNotNull(), F.lit(float(weights[m])) if m in weights else 1.0 / n).otherwise(0.0)
        for m, p in models.items()
    }
    total = sum(raw.values(), F.lit(0.0))
    w = {
        m: F.when(p.isNull(), 0.0).when(total > 0, raw[m] / F.nullif(total, F.lit(0.0))).otherwise(1.0 / F.nullif(n, F.lit(0)))
        for m, p in models.items()
    }

    def one(c: str) -> Column:
        s = F.lit(0.0)
        for m, p in models.items():
            s = s + F.coalesce(F.try_element_at(p, F.lit(c)), F.lit(0.0)) * w[m]
        return F.round(s, 4)

    blended = F.array(*(one(c) for c in CLASSES))
    ordered = F.array_sort(blended, lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))
    name, conf, _ = decide(blended)
    return {
        "blended": blended,
        "final_class": name,
        "confidence": conf,
        "is_ambiguous": F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1)) <= AMBIGUOUS_WITHIN,
        "weights": F.map_from_arrays(F.array(*map(F.lit, models)), F.array(*(F.round(w[m], 4) for m in models))),
        "blended_probabilities": F.map_from_arrays(F.array(*map(F.lit, CLASSES)), blended),
    }


def merge_entities(ner: Column, regions: Column) -> Column:
    """Entity spans, or the regions read as spans when there are none (ENS4)."""
    as_spans = F.transform(
        F.filter(regions, lambda r: r["text"] != ""),
        lambda r: F.struct(
            r["text"].alias("text"), F.upper(r["label"]).alias("label"), F.lit(0).alias("start"),
            F.char_length(r["text"]).alias("end"), r["confidence"].alias("confidence"),
        ),
    )
    return F.when(F.coalesce(F.size(ner) > 0, F.lit(False)), ner).otherwise(as_spans)


def route(source_type: Column, run_llm: Column, prompt: Column) -> Column:
    """Models to run for a document (RTE1)."""
    base = F.when(source_type == "image", F.array(F.lit("vision"), F.lit("ner"))).otherwise(
        F.array(F.lit("classifier"), F.lit("ner"))
    )
    extra = F.when(run_llm & (F.coalesce(F.char_length(prompt), F.lit(0)) > 0), F.array(F.lit("llm")))
    return F.concat(base, F.coalesce(extra, F.array().cast("array<string>")))


def trace_summary(traces: DataFrame) -> DataFrame:
    """Executions and latency per model of (doc_id, models_run, latency) (RTE2)."""
    each = traces.select(F.explode("models_run").alias("model"), "latency")
    return each.groupBy("model").agg(
        F.count("*").alias("executions"), F.avg("latency").alias("mean_latency"), F.max("latency").alias("max_latency")
    )


def train_structural(rows: DataFrame, label: str = "label", vector: str = "vector", rounds: int = 50):
    """Boosted trees, one against the rest, over feature vectors (CLS1). Returns model and accuracy."""
    from pyspark.ml.classification import GBTClassifier, OneVsRest

    data = _training_rows(rows, label, vector)
    trees = GBTClassifier(maxDepth=3, stepSize=0.1, maxIter=rounds, seed=7)
    model = OneVsRest(classifier=trees).fit(data)
    return model, _accuracy(model.transform(data))


def train_text(rows: DataFrame, label: str = "label", vector: str = "embedding"):
    """Multinomial logistic regression over text vectors (CLS2). Returns model and accuracy."""
    from pyspark.ml.classification import LogisticRegression

    data = _training_rows(rows, label, vector)
    model = LogisticRegression(maxIter=1000, family="multinomial").fit(data)
    return model, _accuracy(model.transform(data))


def _training_rows(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, features) of every row. Training and scoring pass over them very often, so what makes them from the
    texts is run once and cut off: they are numbers, some hundred bytes a row."""
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    slim = cut_lineage(rows.select(F.col(label).cast("string").alias("label_text"), F.col(vector).alias("vector")))
    indexer = StringIndexer(inputCol="label_text", outputCol="label").fit(slim)
    return indexer.transform(slim).select("label", array_to_vector("vector").alias("features"))


def _accuracy(predicted: DataFrame) -> DataFrame:
    return predicted.agg(
        F.count("*").alias("rows"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy")
    )
