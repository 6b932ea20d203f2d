"""Near-duplicates by b-bit MinHash, confirmed on full shingle sets.

A document's set holds its distinct five-word shingles. Documents with equal sets are one class from the start,
so copies never meet as pairs. Of a class's ``PERMUTATIONS`` minima, runs of ``ROWS`` make a band's bucket, and
the low ``BITS`` of each are kept, packed into a few longs: for a candidate pair, bit counts of the
exclusive or give the equal slots, and so, corrected for chance collisions, a similarity.

Links only matter for what they connect, so a bucket of any size is worked off in two steps: every class against
the hubs it meets most often, a bucket's hub being the class that meets most others anywhere; then, where a bucket still spans classes not known
to be connected, all its pairs across them, in tiles of bounded size inside the task. Every pair whose estimate
isn't hopeless is confirmed on the full sets of the two texts.

A pair at the threshold shares no band with a chance of 4e-6, and is estimated under ``CUT`` with one near 5e-5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.components import components
from docspark.llm.line_quality import text_key
from docspark.llm.tables import fields, map_batches, written
from docspark.llm.textbytes import LOWER, Spans, chunks, joined, mixed, words

SHINGLE = 5
PERMUTATIONS, ROWS, BITS = 384, 6, 4
CUT = 0.66
# Hubs that a class is compared with first.
HUBS = 3
TILE = 512
_rng = np.random.default_rng(9)
FACTOR = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text: none without words, one with fewer than five."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    w = Spans(data).of(starts, ends)
    n = len(w)
    rolled = np.zeros(n, np.uint64)
    if n >= SHINGLE:
        part = np.zeros(n - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            part = part * STEP + w[k : n - SHINGLE + 1 + k]
        rolled[: len(part)] = mixed(part)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            one = np.array([b - a], np.uint64)
            for x in w[a:b]:
                one = one * STEP + x
            out.append(mixed(one))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of every permutation over the set."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 256):
        least = np.minimum(least, (hashes[i : i + 256, None] * FACTOR + SHIFT).min(axis=0))
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of rows of minima, 16 slots to a long."""
    slots = (least & np.uint64((1 << BITS) - 1)).reshape(len(least), -1, 64 // BITS)
    return (slots << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def bands(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(len(least), -1, ROWS)
    h = np.arange(rows.shape[1], dtype=np.uint64)[None, :] + np.uint64(1)
    for k in range(ROWS):
        h = mixed(h * STEP + rows[:, :, k])
    return h


LONGS = PERMUTATIONS * BITS // 64


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per row: key, text hashes k1 and k2, n_shingles, set hashes s1 and s2, row, bands, sig."""
    long = T.LongType()
    cols = docs.select(F.col(key).alias("doc_id"), *text_key(F.col(text)), F.col(text).alias("text"))
    out = fields(cols, ["doc_id", "k1", "k2"], ("n_shingles", long), ("s1", long), ("s2", long), ("row", long), ("bands", T.ArrayType(long)), ("sig", T.ArrayType(long)))

    def make():
        at = TaskContext.get().partitionId() << 40

        def step(b: pa.RecordBatch):
            nonlocal at
            data, offsets = joined(b.column(3))
            sets: list[tuple] = []
            least = np.zeros((b.num_rows, PERMUTATIONS), np.uint64)
            for i, j in chunks(offsets):
                for d, s in enumerate(shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])):
                    sets.append((len(s), mixed(s).sum(dtype=np.uint64), mixed(s ^ STEP).sum(dtype=np.uint64)))
                    if len(s):
                        least[i + d] = minima(s)
            n, s1, s2 = (np.array([x[k] for x in sets], np.uint64).view(np.int64) for k in range(3))

            def lists(m: np.ndarray) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.view(np.int64).ravel()))

            row = np.arange(at, at + b.num_rows)
            at += b.num_rows
            made = [pa.array(n), pa.array(s1), pa.array(s2), pa.array(row), lists(bands(least)), lists(packed(least))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], names=out.names)

        return step

    return map_batches(cols, out, make)


def similarity(a: Column, b: Column) -> Column:
    """Estimated from two packed signatures: the share of equal slots, less what chance makes equal."""

    def equal(i: int) -> Column:
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        half = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        any_ = half.bitwiseOR(F.shiftrightunsigned(half, 2))
        return F.bit_count(F.bitwise_not(any_).bitwiseAND(F.lit(0x1111111111111111)))

    same = sum((equal(i) for i in range(1, LONGS)), equal(0)) / F.lit(float(PERMUTATIONS))
    chance = 1 / (1 << BITS)
    return (same - chance) / (1 - chance)


def estimates(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """(u, v, est) of candidate pairs that may reach the threshold."""
    left = sigs.select(F.col("c").alias("u"), F.col("sig").alias("sig_u"))
    right = sigs.select(F.col("c").alias("v"), F.col("sig").alias("sig_v"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", similarity(F.col("sig_u"), F.col("sig_v")).alias("est"))
    return both.where(F.col("est") >= CUT)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The (u, v) whose full sets reach the threshold."""
    left = texts.select(F.col("c").alias("u"), F.col("text").alias("a"))
    right = texts.select(F.col("c").alias("v"), F.col("text").alias("b"))
    both = pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "a", "b")

    def make():
        def step(b: pa.RecordBatch):
            keep = np.zeros(b.num_rows, bool)
            one, two = joined(b.column(2)), joined(b.column(3))
            for i, j in chunks(one[1] + two[1]):
                x, y = (shingle_sets(d[at[i] : at[j]], at[i : j + 1] - at[i]) for d, at in (one, two))
                for k, (p, q) in enumerate(zip(x, y, strict=True)):
                    shared = len(np.intersect1d(p, q, assume_unique=True))
                    keep[i + k] = 100 * shared >= percent * (len(p) + len(q) - shared)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep))

        return step

    return map_batches(both, "u long, v long", make)


HALF = 0x7FFFFFFF


def across(buckets: DataFrame, label: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """(u, v), u < v, estimated near enough and in one bucket, but with different labels.

    A pair comes from the first of the buckets it shares only, and not at all if its set sizes rule it out.
    """
    named = label.select(F.col("u").alias("c"), F.col("v").alias("least"))
    rows = buckets.join(named, "c", "left").select("h", "n", "c", F.coalesce("least", "c").alias("comp"))
    mixed_ones = rows.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi")).select("h")
    tile = F.pmod(F.xxhash64("c"), F.ceil(F.col("n") / TILE)).alias("tile")
    marks = F.transform("bands", lambda x: x.bitwiseAND(F.lit(HALF)).cast("int")).alias("marks")
    members = sigs.select("c", "size", "sig", marks)
    member = F.struct("c", "comp", "size", "sig", "marks")
    tiles = rows.join(mixed_ones, "h").join(members, "c").select("h", tile, member.alias("m"))
    tiles = tiles.groupBy("h", "tile").agg(F.collect_list("m").alias("m"), F.min("m.comp").alias("lo"), F.max("m.comp").alias("hi"))
    a, b = (tiles.select("h", *(F.col(x).alias(x + s) for x in ("tile", "m", "lo", "hi"))) for s in ("1", "2"))
    pure = (F.col("lo1") == F.col("hi1")) & (F.col("lo2") == F.col("hi2")) & (F.col("lo1") == F.col("lo2"))
    met = a.join(b, "h").where((F.col("tile1") <= F.col("tile2")) & ~pure)
    met = met.select(F.col("h").bitwiseAND(F.lit(HALF)).cast("int").alias("mark"), (F.col("tile1") == F.col("tile2")).alias("same"), *(F.col(f"m{s}.{x}").alias(x + s) for s in "12" for x in ("c", "comp", "size", "sig", "marks")))
    need = (CUT * (1 - 1 / (1 << BITS)) + 1 / (1 << BITS)) * PERMUTATIONS

    def side(b: pa.RecordBatch, at: int, i: int) -> list[np.ndarray]:
        plain = [b.column(at + k)[i].values.to_numpy() for k in range(3)]
        wide = [b.column(at + k)[i].values.flatten().to_numpy().reshape(len(plain[0]), -1) for k in (3, 4)]
        return [*plain, wide[0].view(np.uint64), wide[1]]

    def make():
        def step(b: pa.RecordBatch):
            for i in range(b.num_rows):
                (c1, p1, n1, s1, m1), (c2, p2, n2, s2, m2) = side(b, 2, i), side(b, 7, i)
                equal = np.zeros((len(c1), len(c2)), np.int64)
                for k in range(LONGS):
                    x = s1[:, None, k] ^ s2[None, :, k]
                    x |= x >> np.uint64(1)
                    x |= x >> np.uint64(2)
                    equal += np.bitwise_count(~x & np.uint64(0x1111111111111111))
                may = 100 * np.minimum(n1[:, None], n2[None, :]) >= percent * np.maximum(n1[:, None], n2[None, :])
                if b.column(1)[i].as_py():
                    may &= c1[:, None] < c2[None, :]
                u, v = np.nonzero((equal >= need) & (p1[:, None] != p2[None, :]) & may)
                first = (m1[u] == m2[v]).argmax(axis=1)
                here = m1[u, first] == b.column(0)[i].as_py()
                u, v = c1[u[here]], c2[v[here]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

        return step

    return map_batches(met, "u long, v long", make).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """key, n_shingles, component_id and kept for every row.

    Rows are linked when ``100 * |A ∩ B| >= percent * |A ∪ B|``; component_id is the least key reachable and
    kept says a row's key is that. Null, empty and wordless texts have no shingles and are linked with nothing.
    Rows that repeat a key share it in the outcome. A null key is never the least; a row with one is kept only
    if nothing with a key is in its component. No rows give no rows; other columns are ignored.
    """
    rows = written(signatures(docs, key, text), "signatures")
    some = rows.where(F.col("n_shingles") > 0)
    classes = some.groupBy("s1", "s2").agg(F.min("row").alias("c"), F.min("doc_id").alias("least_key"))
    classes = written(classes, "classes")
    of_class = some.join(classes.select(F.col("c").alias("row")), "row", "left_semi")
    sigs = written(of_class.select(F.col("row").alias("c"), "k1", "k2", F.col("n_shingles").alias("size"), "sig", "bands"), "class-signatures")
    entries = sigs.select("c", F.explode("bands").alias("h"))
    shared = entries.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    buckets = written(entries.join(shared, "h"), "buckets")
    # The texts of all classes that have a candidate at all, once.
    wanted = buckets.select("c").distinct().join(sigs.select("c", "k1", "k2"), "c")
    # Copies of a text are one row of their map task before they meet.
    bodies = docs.select(*text_key(F.col(text)), F.col(text).alias("text")).groupBy("k1", "k2").agg(F.first("text").alias("text"))
    texts = written(bodies.join(wanted, ["k1", "k2"]).select("c", "text"), "texts")

    # What meets most others is near the middle of its group, and so near to most of it.
    weights = buckets.groupBy("c").agg(F.sum("n").alias("weight"))
    weighed = buckets.select("h", "c").join(weights, "c")
    hubs = weighed.groupBy("h").agg(F.max(F.struct("weight", "c"))["c"].alias("hub"))
    star = weighed.join(hubs, "h").where(F.col("c") != F.col("hub")).groupBy("c", "hub").agg(F.count("*").alias("n"))
    star = star.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("n", F.col("hub").alias("v"))), asc=False).alias("v"))
    star = star.select(F.col("c").alias("u"), F.explode(F.slice("v", 1, HUBS)["v"]).alias("v"))
    links = written(confirmed(estimates(star, sigs), texts, percent), "links")
    rest = across(buckets.select("h", "n", "c"), _hung(links, weights), sigs, percent)
    more = written(confirmed(rest, texts, percent), "links")
    label = components(links.union(more))

    named = classes.join(label.select(F.col("u").alias("c"), F.col("v").alias("least")), "c", "left").select("s1", "s2", "least_key", F.coalesce("least", "c").alias("comp"))
    lowest = named.groupBy("comp").agg(F.min("least_key").alias("component"))
    named = named.join(lowest, "comp").select("s1", "s2", "component")
    out = rows.select("doc_id", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    return out.select(F.col("doc_id").alias(key), "n_shingles", component.alias("component_id"), kept.alias("kept"))


def _hung(links: DataFrame, weights: DataFrame) -> DataFrame:
    """(u, v): a class and a heavier one that it is surely connected with, some steps up its links."""
    heavy = F.max(F.struct("weight", "v"))["v"].alias("v")
    up = written(links.join(weights.withColumnRenamed("c", "v"), "v").groupBy("u").agg(heavy), "hung")
    for _ in range(2):
        above = up.select(F.col("u").alias("v"), F.col("v").alias("w"))
        up = up.join(above, "v", "left").select("u", F.coalesce("w", "v").alias("v"))
    return up
