"""Document features and the long/wide feature store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import text as tx
from docspark.functions.bind import let
from docspark.functions.counts import text_counts

# Keyword signals of the document types.
INVOICE_WORDS = ["invoice", "receipt", "billing", "amount due", "payable", "purchase order", "po number", "total due"]
CONTRACT_WORDS = [
    "contract", "agreement", "lease", "shall agree", "hereby", "signatories", "confidentiality", "indemnification",
    "parties",
]
REPORT_WORDS = [
    "report", "annual", "quarterly", "executive summary", "introduction", "conclusion", "methodology", "analysis",
    "findings",
]
IMAGE_KEYS = ["has_images", "has_image", "image_extracted", "images"]
LANGUAGE_CODES = {"en": 0, "fr": 1, "de": 2, "es": 3, "hi": 4, "zh": 5}
OTHER_LANGUAGE = 6
TYPE_CODES = {"invoice": 0, "contract": 1, "report": 2, "email": 3}
OTHER_TYPE = 4
FEATURE_TYPES = {
    "page_count": "int",
    "avg_words_per_page": "double",
    "has_tables": "boolean",
    "has_images": "boolean",
    "language": "string",
    "doc_type_signal": "string",
    "reading_level": "double",
    "entity_density": "double",
    "text_quality_score": "double",
}


def page_count(text: Column, given: Column | None = None) -> Column:
    """Page markers, else the given count when positive, else 1 (FEA1)."""
    marks = F.when(F.contains(text, F.lit("--- PAGE ")), F.regexp_count(text, F.lit(tx.PAGE_MARK))).otherwise(0)
    known = F.when(given > 0, given) if given is not None else F.lit(None).cast("int")
    return F.when(marks > 0, marks).otherwise(F.coalesce(known, F.lit(1))).cast("int")


def avg_words_per_page(text: Column, pages: Column) -> Column:
    return F.round(tx.word_count(text) / F.greatest(pages, F.lit(1)), 2)


def has_images(metadata: Column, source_type: Column) -> Column:
    """An image source, or a truthy image flag in the metadata (FEA4)."""
    flag = F.lit(False)
    for k in IMAGE_KEYS:
        v = F.lower(F.get_json_object(metadata, f"$.{k}"))
        flag = flag | F.coalesce(~v.isin("false", "0", "0.0", "", "[]", "{}", "null"), F.lit(False))
    return F.coalesce(source_type == "image", F.lit(False)) | flag


# Keywords a text is searched for, and the headers of an e-mail.
FAMILIES = {
    "invoice": INVOICE_WORDS, "contract": CONTRACT_WORDS, "report": REPORT_WORDS, "subject": ["subject:"], "party": ["to:", "from:", "cc:"],
}


def _doc_type(n: Column) -> Column:
    """The type told by ``n``, a struct of how many keywords of each family were found."""
    top = F.greatest(n["invoice"], n["contract"], n["report"])
    return (
        F.when((n["subject"] > 0) & (n["party"] > 0), "email")
        .when(top == 0, "other")
        .when(n["invoice"] == top, "invoice")
        .when(n["contract"] == top, "contract")
        .otherwise("report")
    )


def doc_type_signal(text: Column) -> Column:
    """E-mail headers first, then the type with most keywords; ties in listed order (FEA5)."""
    hits = lambda t: F.struct(*(tx.count_contained(t, w).alias(k) for k, w in FAMILIES.items()))
    return let(let(F.lower(text), hits), _doc_type)


def _grade(words: Column, sentences: Column, syllables: Column) -> Column:
    g = F.round(0.39 * (words / F.greatest(sentences, F.lit(1))) + 11.8 * (syllables / words) - 15.59, 2)
    return F.when(words == 0, F.lit(0.0)).otherwise(F.greatest(g, F.lit(0.0)))


def reading_level(text: Column) -> Column:
    """Flesch-Kincaid grade, never negative (FEA6-7)."""
    counts = F.struct(tx.word_count(text).alias("w"), tx.sentence_count(text).alias("s"), tx.syllables(text).alias("syl"))
    return let(counts, lambda n: _grade(n["w"], n["s"], n["syl"]))


def _density(proper_nouns: Column, words: Column) -> Column:
    return F.when(words == 0, F.lit(0.0)).otherwise(F.round(proper_nouns / words, 4))


def entity_density(text: Column) -> Column:
    return let(tx.word_count(text), lambda w: _density(tx.proper_nouns(text), w))


def feature_columns(n: Column, pages: Column, text: str = "raw_text") -> list[Column]:
    """All nine features of a row with its counts ``n`` (``counts.text_counts``) and its pages."""
    return [
        pages.alias("page_count"),
        F.round(n["words"] / F.greatest(pages, F.lit(1)), 2).alias("avg_words_per_page"),
        tx.is_table(F.col(text)).alias("has_tables"),
        has_images(F.col("metadata"), F.col("source_type")).alias("has_images"),
        F.col("language"),
        _doc_type(n).alias("doc_type_signal"),
        _grade(n["words"], n["sentences"], n["syllables"]).alias("reading_level"),
        _density(n["propers"], n["words"]).alias("entity_density"),
        F.round(F.when(n["chars"] == 0, F.lit(0.0)).otherwise(n["letters"] / n["chars"]), 4).alias("text_quality_score"),
    ]


def document_features(docs: DataFrame, text: str = "raw_text") -> DataFrame:
    """All nine features without a shuffle (FEA10): what they are made of is counted in one pass over the text."""
    t = F.col(text)
    counted = docs.withColumn("_n", text_counts(**FAMILIES)(t)).withColumn("_pages", page_count(t, F.col("page_count")))
    return counted.select("doc_id", *feature_columns(F.col("_n"), F.col("_pages"), text))


def _code(c: Column, codes: dict[str, int], other: int) -> Column:
    out = F.lit(float(other))
    for name, code in codes.items():
        out = F.when(c == name, F.lit(float(code))).otherwise(out)
    return out


def feature_vector(features: DataFrame) -> DataFrame:
    """Nine numbers per document, in feature order (FEA11)."""
    numbers = [
        F.col("page_count").cast("double"),
        F.col("avg_words_per_page"),
        F.col("has_tables").cast("double"),
        F.col("has_images").cast("double"),
        _code(F.col("language"), LANGUAGE_CODES, OTHER_LANGUAGE),
        _code(F.col("doc_type_signal"), TYPE_CODES, OTHER_TYPE),
        F.col("reading_level"),
        F.col("entity_density"),
        F.col("text_quality_score"),
    ]
    return features.select("doc_id", F.array(*numbers).alias("vector"))


def keyword_class(text: Column) -> Column:
    """First keyword family found (FEA12)."""

    def pick(t: Column) -> Column:
        has = lambda *ks: tx.count_contained(t, list(ks)) > 0
        return (
            F.when(has("resume", "cv", "curriculum vitae", "experience"), "resume")
            .when(has("contract", "agreement"), "contract")
            .when(has("invoice", "bill"), "invoice")
            .when(has("report"), "report")
            .otherwise("other")
        )

    return let(F.lower(text), pick)


def with_model_outputs(features: DataFrame, entities: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds entity_count, class_confidence; a predicted class overrides the signal (FEA13)."""
    counts = entities.groupBy("doc_id").agg(F.count("*").alias("entity_count"))
    joined = features.join(counts, "doc_id", "left").join(
        classes.select("doc_id", "predicted_class", "confidence"), "doc_id", "left"
    )
    return joined.select(
        *(c for c in features.columns if c != "doc_type_signal"),
        F.coalesce("predicted_class", "doc_type_signal").alias("doc_type_signal"),
        F.coalesce("entity_count", F.lit(0)).alias("entity_count"),
        F.coalesce("confidence", F.lit(0.0)).alias("class_confidence"),
    )


def to_long(features: DataFrame, computed_at: Column) -> DataFrame:
    """Wide features to (doc_id, feature_name, feature_value, computed_at) strings (FST1)."""
    names = [c for c in features.columns if c != "doc_id"]
    text_of = {"boolean": tx.python_bool, "double": tx.python_float}
    plain = lambda c: c.cast("string")
    as_text = [text_of.get(features.schema[c].dataType.simpleString(), plain)(F.col(c)).alias(c) for c in names]
    wide = features.select("doc_id", computed_at.alias("computed_at"), *as_text)
    long = wide.unpivot(["doc_id", "computed_at"], names, "feature_name", "feature_value")
    return long.select("doc_id", "feature_name", "feature_value", "computed_at")


def upsert(store: DataFrame, updates: DataFrame, asof: Column | None = None) -> DataFrame:
    """Latest value per (doc, feature) (FST2); with ``asof``, the latest not after it (FST4).

    Values of one moment resolve to the update. The pick is a map-side combined maximum.
    """
    both = store.withColumn("_gen", F.lit(0)).unionByName(updates.withColumn("_gen", F.lit(1)))
    if asof is not None:
        both = both.where(F.col("computed_at") <= asof)
    picked = both.groupBy("doc_id", "feature_name").agg(
        F.max_by(F.struct("feature_value", "computed_at"), F.struct("computed_at", "_gen")).alias("_v")
    )
    return picked.select("doc_id", "feature_name", "_v.feature_value", "_v.computed_at")


def to_wide(long: DataFrame, types: dict[str, str] = FEATURE_TYPES) -> DataFrame:
    """Typed columns back from text; a value that does not cast stays in ``<name>_raw`` (FST3).

    The feature names are the given fixed list, so the pivot needs no extra pass.
    """
    pivoted = long.groupBy("doc_id").pivot("feature_name", list(types)).agg(F.first("feature_value", ignorenulls=True))
    cols: list[Column] = [F.col("doc_id")]
    for name, kind in types.items():
        raw = F.col(name)
        if kind == "string":
            cols.append(raw)
            continue
        value = (raw == "True") if kind == "boolean" else raw.try_cast(kind)
        cols.append(value.alias(name))
        if kind != "boolean":
            cols.append(F.when(value.isNull(), raw).alias(f"{name}_raw"))
    return pivoted.select(*cols)
