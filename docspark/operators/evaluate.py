"""Scores of generated text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions import text as tx
from docspark.functions.vectors import softmax

CONTRADICTION_ALERT = 0.7
PENALTY = 0.3


def _lcs(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, one bit per word of ``a``."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_lcs(list(x), list(y)) for x, y in zip(a, b)], dtype="int32")


def rouge_l(prediction: Column, reference: Column) -> Column:
    """ROUGE-L F1 over ASCII words (EVL1)."""
    p = tx.ascii_words(F.coalesce(prediction, F.lit("")))
    r = tx.ascii_words(F.coalesce(reference, F.lit("")))
    # 2PR/(P+R) with P = lcs/m and R = lcs/n is 2*lcs/(m+n).
    n = F.size(p) + F.size(r)
    return F.when((F.size(p) == 0) | (F.size(r) == 0), F.lit(0.0)).otherwise(F.round(2 * lcs_length(p, r) / n, 4))


def token_overlap(prediction: Column, reference: Column) -> Column:
    """Word-set F1 moved to 0.5..1; zero when nothing is shared (EVL2)."""
    p = F.array_distinct(tx.ascii_words(prediction))
    r = F.array_distinct(tx.ascii_words(reference))
    both = F.size(F.array_intersect(p, r))
    f1 = 2 * both / F.nullif(F.size(p) + F.size(r), F.lit(0))
    return F.when(both > 0, F.round(0.5 + f1 * 0.5, 4)).otherwise(F.lit(0.0))


def contradiction_rate(sentences: DataFrame, by: str = "response_id") -> DataFrame:
    """Share of contradicting sentences per response of (by, sentence, label, score) (EVL3).

    Without a score the wording decides.
    """
    low = F.lower("sentence")
    by_words = F.contains(low, F.lit("contradict")) | F.contains(low, F.lit("not true"))
    by_model = F.contains(F.upper("label"), F.lit("CONTRADIC")) & (F.col("score") > 0.5)
    hit = F.when(F.col("score").isNull(), by_words).otherwise(F.coalesce(by_model, F.lit(False)))
    return sentences.groupBy(by).agg(F.round(F.avg(hit.cast("double")), 4).alias("contradiction_rate"))


def contradiction_penalty(scored: DataFrame, contradiction_index: int = 2) -> DataFrame:
    """Confidence cut for answers a chunk contradicts, of (answer_id, confidence, logits) (EVL4)."""
    p = F.get(softmax(F.col("logits")), F.lit(contradiction_index))
    worst = scored.groupBy("answer_id").agg(F.max(p).alias("max_contradiction"), F.first("confidence").alias("confidence"))
    flag = F.col("max_contradiction") > CONTRADICTION_ALERT
    cut = F.greatest(F.lit(0.0), F.col("confidence") - PENALTY)
    return worst.select(
        "answer_id", "max_contradiction", flag.alias("contradicted"),
        F.round(F.when(flag, cut).otherwise(F.col("confidence")), 4).alias("confidence"),
    )


def evaluate(pairs: DataFrame, prediction: str, reference: str, sentences: DataFrame | None = None, by: str = "response_id") -> DataFrame:
    """Both similarity scores in one projection, and the contradiction rate of each response (EVL5).

    ``sentences`` is what ``contradiction_rate`` takes; a response without any contradicts nothing.
    """
    p, r = F.col(prediction), F.col(reference)
    scored = pairs.withColumns({"rouge_l": rouge_l(p, r), "token_overlap": token_overlap(p, r)})
    if sentences is None:
        return scored.withColumn("contradiction_rate", F.lit(0.0))
    joined = scored.join(contradiction_rate(sentences, by), by, "left")
    return joined.withColumn("contradiction_rate", F.coalesce("contradiction_rate", F.lit(0.0)))
