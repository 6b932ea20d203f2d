"""Models over batches: anything that predicts, generates or can be called, loaded once in a worker (UDF3, UDF5).

A scorer is a function without arguments that loads the model, so the model itself never leaves the worker. Workers are
reused, and the model stays with them under the loader's name; every later task and query finds it there. Batches
stream through one after another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_loaded: dict[str, Any] = {}


@dataclass(frozen=True)
class Scorer:
    """How to load a model and what to call it; equal names mean the same model."""

    name: str
    load: Callable[[], Any]


def model_of(scorer: Scorer) -> Any:
    """The worker's model, loaded when it is first wanted."""
    if scorer.name not in _loaded:
        _loaded[scorer.name] = scorer.load()
    return _loaded[scorer.name]


def call(model: Any, *batch: pd.Series) -> Any:
    """``predict``, else ``generate``, else the object itself, over whole columns."""
    for name in ("predict", "generate"):
        method = getattr(model, name, None)
        if callable(method):
            return method(*batch)
    if callable(model):
        return model(*batch)
    raise TypeError(f"{type(model).__name__} has no predict or generate and can't be called")


def _column(out: Any, n: int) -> pd.Series:
    """One value a row, from a series, list or array."""
    values = out if isinstance(out, pd.Series) else pd.Series(list(np.asarray(out)) if isinstance(out, np.ndarray) else list(out), dtype=None)
    if len(values) != n:
        raise ValueError(f"the model gave {len(values)} results for {n} rows")
    return values.reset_index(drop=True)


def apply(scorer: Scorer, returns: str, *columns: Column) -> Column:
    """The model's result of every row; ``returns`` is its type. No rows load nothing."""
    if len(columns) == 1:

        @F.pandas_udf(returns)
        def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                yield _column(call(model_of(scorer), b), len(b)) if len(b) else pd.Series([], dtype=object)

        return one.asNondeterministic()(*columns)

    @F.pandas_udf(returns)
    def many(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for b in batches:
            yield _column(call(model_of(scorer), *b), len(b[0])) if len(b[0]) else pd.Series([], dtype=object)

    return many.asNondeterministic()(*columns)


def encoder(scorer: Scorer) -> Callable[[DataFrame, Column], DataFrame]:
    """A text encoder for ``vectors.embed_with_cache`` and the ingest: texts to lists of numbers."""

    def encode(df: DataFrame, text: Column) -> DataFrame:
        return df.withColumn("embedding", apply(scorer, "array<double>", text))

    return encode


def pair_scorer(scorer: Scorer) -> Callable[[Column, Column], Column]:
    """A scorer of query and text for ``retrieval.rerank``."""
    return lambda query, text: apply(scorer, "double", query, text)


def contradictions(sentences: DataFrame, scorer: Scorer, premise: str, hypothesis: str) -> DataFrame:
    """Adds label and score as ``evaluate.contradiction_rate`` takes them, from a model of pairs of sentences.

    The model gives, for each pair, three numbers: entailment, neutral, contradiction.
    """
    out = sentences.withColumn("_logits", apply(scorer, "array<double>", F.col(premise), F.col(hypothesis)))
    e = F.transform("_logits", lambda x: F.exp(x - F.array_max("_logits")))
    p = F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
    at = F.array_position("_logits", F.array_max("_logits"))
    name = F.element_at(F.array(F.lit("ENTAILMENT"), F.lit("NEUTRAL"), F.lit("CONTRADICTION")), at.cast("int"))
    return out.withColumns({"label": F.when(at > 0, name), "score": F.when(at > 0, F.element_at(p, at.cast("int")))}).drop("_logits")
