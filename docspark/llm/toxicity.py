"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words (letters, digits and all bytes beyond ASCII, ASCII in lower case) and their first
4, 5 and 6 bytes, each hashed to ``HASH_BITS`` bits. On a bounded sample of labelled texts the terms tied to
the label are chosen, among all of them or among those that hold a term tied to label 1, and a factorization machine is fitted to their presence: a weight for each term and a
vector for each, whose products weigh pairs of terms, such as an insult with the mention of a group, that
additive weights would miss. Every text is then scored whole, with a model of fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.line_quality import text_key
from docspark.llm.tables import fields, map_batches, written
from docspark.llm.textbytes import LOWER, Spans, chunks, joined

HASH_BITS = 40
PREFIXES = (4, 5, 6)
# Labelled texts that the model is fitted on at most, the terms it may have, and what a term needs: documents
# and standard deviations of its count among the positive ones.
SAMPLE, TERMS, LEAST, TIED = 20_000, 4096, 3, 5.0
FACTORS, ROUNDS, STEP, DECAY = 4, 80, 0.2, 1e-4
THRESHOLD = 0.3

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term hash) of every word and prefix, repeats included."""
    data = LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    text = np.searchsorted(offsets, starts, "right") - 1
    sums = Spans(data)
    down = np.uint64(64 - HASH_BITS)
    out_text, out = [text], [sums.of(starts, ends) >> down]
    for k in PREFIXES:
        longer = ends - starts > k
        s = starts[longer]
        out_text.append(text[longer])
        out.append((sums.of(s, s + k) ^ np.uint64(k << 60)) >> down)
    return np.concatenate(out_text), np.concatenate(out)


def _terms_of(sample: DataFrame) -> DataFrame:
    """(label, terms) with each text's distinct term hashes as strings."""
    out = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("terms", T.ArrayType(T.StringType()))])

    def make():
        def step(b: pa.RecordBatch):
            data, offsets = joined(b.column(1))
            for i, j in chunks(offsets):
                text, term = terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                lists = _grouped(text, term, j - i)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(lists, pa.list_(pa.string()))], names=out.names)

        return step

    return map_batches(sample.select("label", "text"), out, make)


def _grouped(text: np.ndarray, term: np.ndarray, n: int) -> list[np.ndarray]:
    """The distinct terms of each of ``n`` texts as strings."""
    order = np.lexsort((term, text))
    text, term = text[order], term[order]
    cuts = np.searchsorted(text, np.arange(n + 1))
    return [np.unique(term[a:b]).astype(str) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def held_out(key: Column) -> Column:
    """Rows that labels are never learned from: a checksum of the key leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Machine:
    """A fitted model: sorted term hashes with weights and factors."""

    def __init__(self, bias: float, hashes: np.ndarray, weights: np.ndarray, factors: np.ndarray):
        order = np.argsort(hashes)
        self.bias, self.hashes, self.weights, self.factors = bias, hashes[order], weights[order], factors[order]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        count = len(offsets) - 1
        total = np.full(count, self.bias)
        if len(self.hashes):
            seen = np.zeros(1 << 20, bool)
            seen[self.hashes >> np.uint64(HASH_BITS - 20)] = True
            text, term = terms(data, offsets)
            near = seen[term >> np.uint64(HASH_BITS - 20)]
            text, term = text[near], term[near]
            at = np.minimum(np.searchsorted(self.hashes, term), len(self.hashes) - 1)
            known = self.hashes[at] == term
            both = np.unique(text[known] * len(self.hashes) + at[known])
            text, at = both // len(self.hashes), both % len(self.hashes)
            total += np.bincount(text, self.weights[at], count)
            for f in self.factors.T:
                total += 0.5 * (np.bincount(text, f[at], count) ** 2 - np.bincount(text, f[at] ** 2, count))
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def _tied(found: DataFrame, n: int, p: float) -> list[tuple[str, float]]:
    """At most ``TERMS`` terms of (label, terms) tied to the label, with how many deviations, the strongest first."""
    if p in (0, n):
        return []
    counts = found.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("label").alias("hits"))
    expected = F.col("df") * (p / n)
    z = (F.col("hits") - expected) / F.sqrt(expected * (1 - p / n))
    chosen = counts.where(F.col("df") >= LEAST).select("term", z.alias("z")).where(F.abs("z") >= TIED)
    return [(r["term"], r["z"]) for r in chosen.orderBy(F.desc(F.abs("z")), "term").limit(TERMS).collect()]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Machine:
    """A model from at most ``sample`` labelled rows outside the held-out part, those of least key hash.

    Equal texts of the sample count once. Without rows of both labels, or a term tied to them, nothing tells texts
    apart: the model is the smoothed share of positive labels times ``THRESHOLD``, so that no text is predicted toxic.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("key")).agg((F.max(label) > 0).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("key"), "key").limit(sample)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    # The sample is bounded by its parameter, so it may be broadcast: only its texts leave the scan.
    rows = texts.join(F.broadcast(known), "key").dropDuplicates(["key"])
    rows = rows.groupBy(*text_key(F.col("text"))).agg(F.max("label").alias("label"), F.first("text").alias("text"))
    found = written(_terms_of(rows), "terms")
    size = found.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    n, p = size["n"], size["p"] or 0.0
    share = THRESHOLD * (p + 1) / (n + 2)
    bare = Machine(float(np.log(share / (1 - share))), np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, FACTORS)))
    if p in (0, n):
        return bare
    tied = _tied(found, n, p)
    strong = [t for t, z in tied if z > 0]
    # A term that says little alone may say much beside such a term.
    beside = found.where(F.exists("terms", lambda t: t.isin(strong)))
    size = beside.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    best: dict[str, float] = {}
    for term, z in tied + _tied(beside, size["n"], size["p"] or 0.0):
        best[term] = max(best.get(term, 0.0), abs(z))
    chosen = sorted(best, key=lambda t: (-best[t], t))[:TERMS]
    if not chosen:
        return bare
    vectors = CountVectorizerModel.from_vocabulary(chosen, inputCol="terms", outputCol="features")
    vectors.setBinary(True)
    data = written(vectors.transform(found).select("label", "features"), "fit")
    machine = FMClassifier(factorSize=FACTORS, maxIter=ROUNDS, stepSize=STEP, regParam=DECAY, seed=1, initStd=0.05).fit(data)
    return Machine(float(machine.intercept), np.array(chosen, np.uint64), machine.linear.toArray(), machine.factors.toArray())


def toxicity(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with held_out, score (0 to 1) and predicted (1 from ``THRESHOLD``) for every row.

    A null text is empty; an empty text has the model's bias as its score. A null key isn't held out. Equal texts
    have equal scores; no rows give no rows; other columns are ignored.
    """
    keep = [key] if keep is None else keep
    cols = docs.select(*keep, held_out(F.col(key)).alias("held_out"), F.col(text).alias("body"))
    out = fields(cols, [*keep, "held_out"], ("score", T.DoubleType()), ("predicted", T.IntegerType()))

    def make():
        def step(b: pa.RecordBatch):
            data, offsets = joined(b.column(len(keep) + 1))
            score = np.concatenate([machine.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets)])
            made = [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep) + 1], *made], names=out.names)

        return step

    return map_batches(cols, out, make)
