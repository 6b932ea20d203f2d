"""What a worker holds at once follows a slice of a batch, not the batch."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docspark.functions import text as tx
from docspark.functions import vectors as vx
from docspark.functions.slices import row_slices
from docspark.operators import chunking, classify, quality


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_slices_hold_all_rows_and_few_bytes():
    texts = ["a" * (i % 700) if i % 11 else None for i in range(5000)] + ["b" * 100_000, ""]
    for column in (pa.array(texts), pa.array([None if t is None else [t, t] for t in texts]), pa.array(texts).slice(13, 900)):
        parts = list(row_slices(column, 50_000))
        assert [v for p in parts for v in p.to_pylist()] == column.to_pylist()
        assert all(len(p) == 1 or sum(256 + len(str(v)) for v in p.to_pylist()) < 60_000 for p in parts)
    assert len(list(row_slices(pa.array([], pa.string())))) == 1


def test_one_long_token_does_not_widen_all_others(spark):
    tokens = [["x" * 10_000, *(f"w{i % 50}" for i in range(20_000))], [], None]
    assert peak_mb(lambda: vx.hash_embed(tokens, 8)) < 40
    column = list(vx.hash_embed_column(8).func(iter([pa.array(tokens, pa.list_(pa.string()))])))
    assert np.array_equal(np.vstack([np.vstack(c.to_pylist()) for c in column]), vx.hash_embed(tokens, 8))


def test_pairs_of_long_texts_are_counted_in_parts():
    texts = ["ab" * 400_000, None, "x", "é🎈 c" * 90_000, "", "ba"]
    parts = list(quality._gram_slots(pa.array(texts)))
    assert len(parts) > 2 and max(len(r) for r, _ in parts) <= 2 * quality.GRAM_CHARS
    rows, slots = (np.concatenate(x) for x in zip(*parts, strict=True))
    want = [(i, (ord(a) * 31 + ord(b)) % 4096) for i, t in enumerate(texts) for a, b in zip(t or "", (t or "")[1:], strict=False)]
    assert list(zip(rows.tolist(), slots.tolist(), strict=True)) == want


def test_sentence_vectors_are_of_one_document_at_a_time(spark):
    docs = [[f"Word{i} is here {j}." for i in range(300)] for j in range(30)] + [None, [], ["One."]]
    out = []
    peak = peak_mb(lambda: out.extend(chunking.sentence_similarity().func(iter([pa.array(docs)]))))
    assert peak < 10
    sims = [s for part in out for s in part.to_pylist()]
    assert sims[-3:] == [None, [], []]
    v = vx.hash_embed([x.lower().rstrip(".").split() for x in docs[0]], 64)
    assert np.allclose(sims[0], (v[1:] * v[:-1]).sum(axis=1))


def test_normal_forms_come_in_slices(spark):
    texts = ["plain " * 50_000] * 8 + ["ﬁne " * 50_000] * 8 + [None, ""]
    parts = list(tx.nfkc.func(iter([pa.array(texts)])))
    assert len(parts) > 2
    assert [v for p in parts for v in p.to_pylist()] == ["plain " * 50_000] * 8 + ["fine " * 50_000] * 8 + [None, ""]


def test_training_makes_its_rows_once(spark):
    """What makes vectors from texts runs once, however often training passes over them."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def vector(i):
        made.add(1)
        return [float(i % 7), float(i % 3)]

    rows = spark.range(200).select(F.when(F.col("id") % 7 > 3, "a").otherwise("b").alias("label"), vector("id").alias("v"))
    _, accuracy = classify.train_text(rows, vector="v")
    assert accuracy.first()["rows"] == 200 and made.value == 200
    _, accuracy = classify.train_structural(rows, vector="v", rounds=2)
    assert accuracy.first()["accuracy"] == 1.0 and made.value == 400
