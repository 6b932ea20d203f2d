"""Quality gates: one failure reason per document, first failing check wins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as tx
from docspark.operators import blocks

# Fixed values of the gates.
MIN_CHARS = 51
MIN_BYTES = 100
MAX_BYTES = 52_428_800
MIN_WORD_LENGTH = 2
MIN_ALPHA = 0.6
MIN_LANGUAGE_PROB = 0.85
ALLOWED_LANGUAGES = ["en", "fr", "de", "es", "hi", "zh"]


def blank_page(c: Column) -> Column:
    """A page of a multi-page text without content behind its header (VAL8); a text without pages isn't split."""
    parts = F.split(c, "--- PAGE ")
    content = lambda p: F.regexp_replace(p, r"(?s)^.*?---", "")
    return F.contains(c, F.lit("--- PAGE ")) & F.exists(parts, lambda p: ~tx.is_blank(p) & tx.is_blank(content(p)))


def mean_word_length(c: Column) -> Column:
    """Non-space characters over words: no word array is built."""
    return F.char_length(F.regexp_replace(c, tx.WS + "+", "")) / tx.word_count(c)


# What the schema checks answer, in their order.
SCHEMA_REASONS = ["checksum_mismatch", "missing_text", "text_too_short", "byte_size_out_of_range", "language_not_allowed"]


def _first(checks: list[tuple[Column, str]]) -> Column:
    why = F.lit(None).cast("string")
    for test, reason in reversed(checks):
        why = F.when(test, F.lit(reason)).otherwise(why)
    return why


def _schema_checks(text: str, raw: str | None, language: str) -> list[tuple[Column, str]]:
    t = F.col(text)
    tests = [
        t.isNull(), F.char_length(t) < MIN_CHARS, ~F.col("byte_size").between(MIN_BYTES, MAX_BYTES), ~F.col(language).isin(ALLOWED_LANGUAGES),
    ]
    checks = list(zip(tests, SCHEMA_REASONS[1:], strict=True))
    if raw is not None:
        checks.insert(0, (F.col(raw).isNotNull() & (F.sha2(raw, 256) != F.col("checksum")), SCHEMA_REASONS[0]))
    return checks


def _content_checks(text: str, counts: Column | None = None) -> list[tuple[Column, str]]:
    """``counts``: the text's counts, if they are known (``counts.text_counts``)."""
    t = F.col(text)
    if counts is None:
        mean, alpha = mean_word_length(t), tx.alpha_ratio(t)
    else:
        mean, alpha = counts["dense"] / counts["words"], counts["letters"] / counts["chars"]
    return [
        (tx.is_blank(t), "whitespace_only"),
        (blank_page(t), "blank_page"),
        (mean < MIN_WORD_LENGTH, "unreadable_scan"),
        (alpha <= MIN_ALPHA, "low_alphabetic_ratio"),
    ]


def schema_reason(text: str = "raw_text", raw: str | None = "raw_bytes", language: str = "language") -> Column:
    """NULL for rows that pass the schema checks (VAL1-5)."""
    return _first(_schema_checks(text, raw, language))


def content_reason(text: str = "raw_text", counts: Column | None = None) -> Column:
    """NULL for rows whose text passes the content checks (VAL7-10)."""
    return _first(_content_checks(text, counts))


def failure_reason(text: str = "raw_text", raw: str | None = "raw_bytes", language: str = "language") -> Column:
    """NULL for accepted rows, else the first failing check (VAL1-5, VAL7-10)."""
    return _first([*_schema_checks(text, raw, language), *_content_checks(text)])


def validate(docs: DataFrame, **cols) -> DataFrame:
    """Adds failure_reason, and quality_score for accepted rows."""
    out = docs.withColumn("failure_reason", failure_reason(**cols))
    score = F.when(F.col("failure_reason").isNull(), tx.alpha_ratio(F.col(cols.get("text", "raw_text"))))
    return out.withColumn("quality_score", score)


def failure_summary(validated: DataFrame) -> DataFrame:
    """Rejections by source type and reason (VAL11)."""
    return (
        validated.where(F.col("failure_reason").isNotNull())
        .groupBy("source_type", "failure_reason")
        .agg(F.count("*").alias("rejected"))
    )


def response_envelope(df: DataFrame, answer: str, confidence: str) -> DataFrame:
    """A response is valid with an answer and a numeric confidence (VAL12)."""
    number = F.col(confidence).try_cast("double")
    error = (
        F.when(F.col(answer).isNull(), "answer is missing")
        .when(F.col(confidence).isNull(), "confidence is missing")
        .when(number.isNull(), "confidence is not a number")
    )
    return df.withColumn("confidence_value", number).withColumn("error", error).withColumn("valid", error.isNull())


# Language identification: naive Bayes over hashed character pairs. The model has a fixed size,
# GRAM_SLOTS counters per language, whatever the corpus.
GRAM_SLOTS = 4096
GRAM_FACTOR = 31


# Characters whose pairs are looked at together, of several texts or of a part of one.
GRAM_CHARS = 1 << 18


def _gram_slots(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, slot) of every adjacent character pair, in order, at most ``GRAM_CHARS`` or little more at a time."""
    at, sizes, slots, size = [], [], [], 0

    def part() -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.array(at, np.int64), sizes), np.concatenate(slots).astype(np.int64)

    for i, t in enumerate(texts):
        t = t.as_py() or ""
        for s in range(0, len(t) - 1, GRAM_CHARS):
            c = np.frombuffer(t[s : s + GRAM_CHARS + 1].encode("utf-32-le", "surrogatepass"), dtype="<u4")
            # The slots are a power of two, so the remainder is the lowest bits.
            slots.append((c[:-1] * np.uint32(GRAM_FACTOR) + c[1:]) & np.uint32(GRAM_SLOTS - 1))
            at.append(i)
            sizes.append(len(c) - 1)
            size += len(c)
            if size >= GRAM_CHARS:
                yield part()
                at, sizes, slots, size = [], [], [], 0
    if at:
        yield part()


def train_language_model(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, slot, logp) with add-one smoothing from labelled text (VAL6).

    Each Arrow batch is reduced to counters per language before the shuffle.
    """

    def count(batches):
        for b in batches:
            langs = b.column(1).to_pylist()
            names = sorted({x for x in langs if x is not None})
            if not names:
                continue
            # Texts without a language are counted behind the others, and left out.
            code = GRAM_SLOTS * np.array([names.index(x) if x is not None else len(names) for x in langs])
            flat = np.zeros((len(names) + 1) * GRAM_SLOTS, np.int64)
            for rows, slots in _gram_slots(b.column(0)):
                flat += np.bincount(code[rows] + slots, minlength=len(flat))
            at = np.flatnonzero(flat[: len(names) * GRAM_SLOTS])
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in at // GRAM_SLOTS], pa.string()), pa.array(at % GRAM_SLOTS, pa.int32()),
                 pa.array(flat[at], pa.int64())],
                names=["lang", "slot", "n"],
            )

    counted = docs.select(F.lower(text).alias("t"), F.col(lang).alias("lang")).mapInArrow(
        count, "lang string, slot int, n long"
    )
    per_slot = counted.groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("lang"))
    return per_slot.select(
        "lang", "slot", F.log((F.col("n") + 1) / (total + GRAM_SLOTS)).alias("logp"),
        F.log(F.lit(1.0) / (total + GRAM_SLOTS)).alias("floor_logp"),
    )


class LanguageTable:
    """A trained model as arrays, of fixed width whatever it was trained on: its languages and, of each, the log-probability of every slot."""

    def __init__(self, names: list[str], slots: list, logps: list, floors: list[float]):
        self.order = np.argsort(np.array(names), kind="stable")  # ties go to the first name
        self.names = np.array(names)
        self.logps = np.repeat(np.array(floors, float)[:, None], GRAM_SLOTS, axis=1)
        for row, at, values in zip(self.logps, slots, logps, strict=True):
            row[np.asarray(at, np.int64)] = values

    def tell(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The most likely language of each lower-cased text, and how likely it is."""
        n = len(texts)
        sums = np.zeros((n, len(self.logps)))
        behind = -1
        for rows, slots in _gram_slots(texts):
            a, b = int(rows[0]), int(rows[-1]) + 1
            # A text that goes on starts from its sum so far, so that the order of additions is that of its pairs.
            goes_on = a == behind
            at = np.concatenate([[0], rows - a]) if goes_on else rows - a
            for j, logps in enumerate(self.logps):
                found = logps[slots]
                sums[a:b, j] = np.bincount(at, weights=np.concatenate([sums[a : a + 1, j], found]) if goes_on else found)
            behind = b - 1
        top = sums.max(axis=1, keepdims=True)
        p = np.exp(sums - top)
        p /= p.sum(axis=1, keepdims=True)
        best = self.order[np.argmax(sums[:, self.order], axis=1)]
        return pa.array(self.names[best].tolist(), pa.string()), pa.array(p[np.arange(n), best])


def _by_language(model: DataFrame) -> DataFrame:
    return model.groupBy("lang").agg(
        F.collect_list("slot").alias("slots"), F.collect_list("logp").alias("logps"),
        F.max("floor_logp").alias("floor_logp"),
    )


def language_table(model: DataFrame) -> LanguageTable | None:
    """The model as a value that goes to the tasks; None if it knows no language. Its size is fixed: ``GRAM_SLOTS`` numbers a language."""
    rows = _by_language(model).orderBy("lang").collect()
    return LanguageTable(*map(list, zip(*rows, strict=True))) if rows else None


def identify_language(docs: DataFrame, model: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, detected, prob): the most likely language of each text (VAL6)."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    def score(d: blocks.Columns, m: blocks.Columns) -> pa.RecordBatch:
        table = LanguageTable(m["lang"].to_pylist(), m["slots"].to_pylist(), m["logps"].to_pylist(), m["floor_logp"].to_pylist())
        return pa.RecordBatch.from_arrays([d["doc_id"], *table.tell(d["t"])], names=["doc_id", "detected", "prob"])

    left = docs.select(F.col(doc_id).alias("doc_id"), F.lower(text).alias("t"))
    # A handful of languages of fixed width each: one pack, so every document meets all of them where it is.
    return blocks.block_join(left, _by_language(model).coalesce(1), score, f"doc_id {id_type}, detected string, prob double", few=True)


def language_gate(identified: DataFrame) -> DataFrame:
    subtag = F.regexp_extract(F.lower("detected"), "^[a-z]+", 0)
    return identified.select(
        "doc_id", subtag.alias("language"), "prob", (F.col("prob") < MIN_LANGUAGE_PROB).alias("uncertain_language"),
        F.when(~subtag.isin(ALLOWED_LANGUAGES), "language_not_allowed").alias("failure_reason"),
    )
