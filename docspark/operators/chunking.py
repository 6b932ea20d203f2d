"""Chunking: one document row becomes many chunk rows, without a shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docspark.functions import text as tx
from docspark.functions import vectors as vx
from docspark.functions.counts import word_places
from docspark.functions.slices import row_slices
from docspark.functions.spans import first_places, places

SPANS = "array<struct<s:int,e:int>>"
# Fixed values of the semantic strategy.
MERGE_BELOW = 128
SPLIT_ABOVE = 768
SPLIT_SIZE, SPLIT_OVERLAP = 512, 64
WINDOW = 3


def chunk_id(doc_id: Column, strategy: str, index: Column) -> Column:
    """Stable across retries (CHK8)."""
    return F.sha2(F.concat_ws(":", doc_id.cast("string"), F.lit(strategy), index.cast("string")), 256)


def _fixed_spans(counts: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Inclusive sentence ranges: fill up to ``size``, step back over at most ``overlap``."""
    total = np.concatenate([[0], np.cumsum(counts)])
    spans, start, n = [], 0, len(counts)
    while start < n:
        stop = max(start + 1, int(np.searchsorted(total, total[start] + size, side="right")) - 1)
        spans.append((start, stop - 1))
        if stop >= n:
            break
        again = int(np.searchsorted(total, total[stop] - overlap, side="left"))
        start = max(again, start + 1)
    return spans


CUTS = T.ArrayType(
    T.StructType().add("text", "string").add("char_start", "integer").add("sentence_start", "integer").add("token_count", "integer")
)


def _cut(texts: list[str | None], size: int, overlap: int) -> list[list[dict] | None]:
    """The chunks of every text: sentences filled up to ``size`` words, with their offsets (CHK6).

    A sentence is a run of words up to one that ends in . ! or ?, so where all words begin and end says where sentences
    do and how many words they have; texts are only sliced where chunks begin and end.
    """
    codes, starts, firsts, ends, of, full = word_places([t or "" for t in texts])
    closes = full
    closes[of[1:][np.diff(of) > 0] - 1] = True
    last = np.flatnonzero(closes)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    words, a, b = last - first + 1, firsts[first], ends[last] + 1
    # Between sentences anything but one space becomes one.
    odd = np.ones(len(last), bool)
    odd[:-1] = (a[1:] - b[:-1] != 1) | (codes[b[:-1]] != 32)
    bounds = np.searchsorted(last, of)
    out: list[list[dict] | None] = []
    for k, text in enumerate(texts):
        lo, hi = int(bounds[k]), int(bounds[k + 1])
        if text is None:
            out.append(None)
            continue
        counts = words[lo:hi]
        whole = hi > lo and counts.sum() <= size
        spans = [(0, hi - lo - 1)] if whole else _fixed_spans(counts, size, overlap)
        begin, stop = a[lo:hi] - starts[k], b[lo:hi] - starts[k]
        breaks, total = np.flatnonzero(odd[lo:hi]), np.concatenate([[0], np.cumsum(counts)])
        heads = [text[begin[s] : stop[s]] for s, _ in spans]
        chunks = []
        for (s, e), at in zip(spans, first_places(text, heads), strict=True):
            inner = breaks[np.searchsorted(breaks, s) : np.searchsorted(breaks, e)]
            runs = zip([s, *(inner + 1)], [*inner, e], strict=True)
            chunks.append({
                "text": " ".join([text[begin[x] : stop[y]] for x, y in runs]), "char_start": at, "sentence_start": s, "token_count": int(total[e + 1] - total[s]),
            })
        out.append(chunks)
    return out


def fixed_cuts(size: int, overlap: int):
    """Arrow UDF: a text to its chunks, a few texts of a batch at a time; a null text has null."""

    @F.arrow_udf(CUTS)
    def cuts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            for part in row_slices(b):
                yield pa.array(_cut(part.to_pylist(), size, overlap), to_arrow_type(CUTS))

    # Its result is exploded; marked so, it runs once instead of again in an inferred filter.
    return cuts.asNondeterministic()


def _semantic_spans(counts: list[int], sims: list[float], threshold: float) -> list[tuple[int, int]]:
    """Groups broken at low similarity, small ones merged forward, large ones split."""
    cuts = [0, *(i + 1 for i, s in enumerate(sims) if s < threshold), len(counts)]
    groups = [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
    total = np.concatenate([[0], np.cumsum(counts)])
    merged: list[list[int]] = []
    for a, b in groups:
        if merged and total[merged[-1][1]] - total[merged[-1][0]] < MERGE_BELOW:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    out: list[tuple[int, int]] = []
    for a, b in merged:
        if total[b] - total[a] > SPLIT_ABOVE and len(counts) > 1:
            out += [(a + s, a + e) for s, e in _fixed_spans(list(counts[a:b]), SPLIT_SIZE, SPLIT_OVERLAP)]
        else:
            out.append((a, b - 1))
    return out


def semantic_spans(threshold: float):
    @F.pandas_udf(SPANS)
    def spans(counts: pd.Series, sims: pd.Series) -> pd.Series:
        return pd.Series(
            [[{"s": s, "e": e} for s, e in _semantic_spans(list(c), list(m), threshold)] for c, m in zip(counts, sims)]
        )

    return spans.asNondeterministic()


def sentence_table(docs: DataFrame, text: str, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, pos, sentence, tokens) (CHK1-2)."""
    return docs.select(doc_id, F.posexplode(tx.sentences(F.col(text))).alias("pos", "sentence")).withColumn(
        "token_count", tx.word_count(F.col("sentence"))
    )


def _chunk(sents: Column, start: Column, first: Column, last: Column) -> Column:
    """Text and offsets of the sentences ``first`` to ``last``, both inclusive; the first opens at ``start``."""
    body = F.array_join(F.slice(sents, first + 1, last - first + 1), " ")
    return F.struct(body.alias("text"), start.alias("char_start"), first.cast("int").alias("sentence_start"))


def _chunk_rows(df: DataFrame, strategy: str, chunks: Column, doc_id: str, *extra: str, counted: bool = False) -> DataFrame:
    """One row per chunk. Chunks are built inside the document's row, so only finished chunks are
    exploded and the text is not copied along. ``counted``: they know their number of words."""
    rows = df.select(doc_id, F.posexplode(chunks).alias("chunk_index", "c"))
    return rows.select(
        chunk_id(F.col(doc_id), strategy, F.col("chunk_index")).alias("chunk_id"),
        doc_id,
        "chunk_index",
        "c.text",
        F.col("c.token_count") if counted else tx.word_count(F.col("c.text")).alias("token_count"),
        "c.char_start",
        (F.col("c.char_start") + F.char_length("c.text")).alias("char_end"),
        "c.sentence_start",
        F.lit(strategy).alias("chunk_strategy"),
        tx.is_table(F.col("c.text")).alias("is_table"),
        *(f"c.{e}" for e in extra),
    )


def _from_spans(df: DataFrame, strategy: str, spans: Column, doc_id: str, text: str) -> DataFrame:
    """Chunk rows of (s, e) sentence ranges with offsets (CHK6).

    ``char_start`` is the first place the opening sentence occurs; ``sentence_start`` counts the
    sentences before, so it stays exact when a sentence repeats.
    """
    placed = df.withColumn("_spans", spans)
    opening = F.transform("_spans", lambda p: F.get(F.col("_sents"), p["s"]))
    placed = placed.withColumn("_starts", places(F.col(text), opening))
    chunks = F.transform("_spans", lambda p, i: _chunk(F.col("_sents"), F.get("_starts", i), p["s"], p["e"]))
    return _chunk_rows(placed, strategy, chunks, doc_id)


def _with_sentences(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    keep = docs.select(doc_id, text).where(~tx.is_blank(F.col(text)))
    sents = keep.withColumn("_sents", tx.sentences(F.col(text)))
    return sents.withColumn("_counts", F.transform("_sents", tx.word_count))


def fixed(docs: DataFrame, text: str, size: int = 512, overlap: int = 64, doc_id: str = "doc_id") -> DataFrame:
    """Sentence-aligned chunks with overlap (CHK3)."""
    # Read twice, the text is made in a step before this one: Spark can't run a UDF over a lambda function in its argument.
    df = docs.select(doc_id, F.when(~tx.is_blank(F.col(text)), fixed_cuts(size, overlap)(F.col(text))).alias("_cuts"))
    return _chunk_rows(df, "fixed", F.col("_cuts"), doc_id, counted=True)


def _similarity(v) -> np.ndarray:
    """Cosine of every row with the one before; 0 when either has no length."""
    if len(v) < 2:
        return np.empty(0)
    m = np.vstack(v).astype(float)
    n = np.linalg.norm(m, axis=1)
    scale = n[1:] * n[:-1]
    return np.divide((m[1:] * m[:-1]).sum(axis=1), scale, out=np.zeros(len(scale)), where=scale > 0)


def sentence_similarity(dim: int = 64):
    """Arrow UDF: array of sentences to the similarity of each with the one before, by the default encoder.

    The vectors, many times the text, are of one document at a time and never leave the worker.
    """
    word = re.compile(r"[^\W_]+")

    @F.arrow_udf("array<double>")
    def similar(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            rows = (s.as_py() for s in b)
            yield pa.array(
                [None if xs is None else _similarity(vx.hash_embed([word.findall(x.lower()) for x in xs], dim)) for xs in rows],
                pa.list_(pa.float64()),
            )

    return similar


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def consecutive_similarity(vecs: pd.Series) -> pd.Series:
    """The similarity of every sentence's vector with the one before."""
    return vecs.map(_similarity)


def semantic(docs: DataFrame, text: str, threshold: float = 0.75, encoder=None, doc_id: str = "doc_id") -> DataFrame:
    """Chunks broken where consecutive sentences drift apart (CHK4).

    ``encoder``: a UDF from an array of sentences to an array of vectors, in place of hashed words.
    """
    df = _with_sentences(docs, text, doc_id)
    df = df.withColumn("_sims", sentence_similarity()("_sents") if encoder is None else consecutive_similarity(encoder("_sents")))
    return _from_spans(df, "semantic", semantic_spans(threshold)("_counts", "_sims"), doc_id, text)


def sentence_window(docs: DataFrame, text: str, doc_id: str = "doc_id") -> DataFrame:
    """One chunk per sentence with up to three neighbours on each side (CHK5)."""
    df = docs.select(doc_id, text).where(~tx.is_blank(F.col(text))).withColumn("_sents", tx.sentences(F.col(text)))
    sents, n = F.col("_sents"), F.size("_sents")
    opening = F.transform(sents, lambda s, i: F.get(sents, F.greatest(i - WINDOW, F.lit(0))))
    df = df.withColumn("_starts", places(F.col(text), opening))

    def one(base: Column, i: Column) -> Column:
        first, last = F.greatest(i - WINDOW, F.lit(0)), F.least(i + WINDOW, n - 1)
        c = _chunk(sents, F.get("_starts", i), first, last)
        around = F.slice(sents, first + 1, last - first + 1)
        return F.struct(c["text"].alias("text"), c["char_start"].alias("char_start"), c["sentence_start"].alias("sentence_start"),
                        base.alias("base_sentence"), around.alias("context_window"))

    return _chunk_rows(df, "sentence_window", F.transform(sents, one), doc_id, "base_sentence", "context_window")


STRATEGIES = {"fixed": fixed, "semantic": semantic, "sentence_window": sentence_window}


def chunk(docs: DataFrame, text: str, strategy: str, **options) -> DataFrame:
    """Strategy by name (CHK7)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy: {strategy}")
    return STRATEGIES[strategy](docs, text, **options)


def chunk_by_column(docs: DataFrame, text: str, strategy: str = "strategy") -> DataFrame:
    """Each row cut by the strategy it names; an unknown name fails the job."""
    name = F.col(strategy)
    checked = docs.withColumn(
        strategy,
        F.when(name.isin(list(STRATEGIES)), name).otherwise(
            F.raise_error(F.concat(F.lit("unknown chunking strategy: "), F.coalesce(name, F.lit("null")))).cast("string")
        ),
    )
    parts = [fn(checked.where(name == s), text) for s, fn in STRATEGIES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
