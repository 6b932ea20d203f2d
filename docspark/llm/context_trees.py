"""Language by prediction by partial matching: the tree of a language that codes a text's bytes shortest.

A tree counts, for every context of up to ``ORDER`` bytes, which bytes follow it. A byte is coded in the longest
context that its tree has seen: with a share c / (n + q) if it followed there (c of n times, beside q different bytes), else with
an escape of q / (n + q) to the context one byte shorter, where bytes of the longer one are excluded from the counts; a byte
that followed nothing is one of those left out of 256. All that follows a context follows the shorter ones too, so what
is excluded is known for every context beforehand and the statistics stay frozen. Shares add up to one everywhere: what is
compared are code lengths, kept as whole numbers of 2**-20 bits, so sums don't depend on how texts are cut.

Trees are grown from a bounded sample (``SAMPLE`` texts and about ``BYTES`` bytes, shared by the languages); every text is scored
whole. The code length of a byte depends on it and the ``ORDER`` bytes before it alone, so a task keeps the lengths
of the windows it has met.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.line_quality import text_key
from docspark.llm.tables import fields, map_batches, written
from docspark.llm.textbytes import joined

ORDER = 4
# Texts and bytes that trees are grown from at most, over all languages; the text that passes the bytes is the last.
SAMPLE, BYTES = 4000, 4 << 20
UNIT = float(1 << 20)
UNKNOWN = "und"
# Windows whose lengths a task keeps, as a power of two, and bytes coded at a time.
KEPT, SLICE = 20, 1 << 20


def mask(n: int) -> np.uint64:
    return np.uint64((1 << 8 * n) - 1)


def windows(data: np.ndarray, offsets: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, window) for bytes ``begin`` to ``end``: a byte and the ``ORDER`` before it in its text, or zeros."""
    text = np.searchsorted(offsets, np.arange(begin, end), "right") - 1
    since = np.arange(begin, end) - offsets[text]
    out = data[begin:end].astype(np.uint64)
    for k in range(1, ORDER + 1):
        before = np.zeros(end - begin, np.uint64)
        skip = max(0, k - begin)
        before[skip:] = data[begin + skip - k : end - k]
        out |= np.where(since >= k, before, np.uint64(0)) << np.uint64(8 * k)
    return text, out


class Tree:
    """The counts of one language: by order, sorted contexts and sorted contexts with a byte."""

    def __init__(self, found: np.ndarray, counts: np.ndarray):
        self.contexts, self.follow = [], []
        below = None
        for j in range(ORDER + 1):
            key, inverse = np.unique(found & mask(j + 1), return_inverse=True)
            count = np.bincount(inverse, counts, len(key)).astype(np.int64)
            context, at = np.unique(key >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(at, count).astype(np.int64), np.bincount(at)
            # What a shorter context's counts lose when this one was left by an escape.
            lost = np.zeros(len(context), np.int64)
            if below is not None:
                np.add.at(lost, at, below[1][np.searchsorted(below[0], key & mask(j))])
            self.contexts.append((context, total, kinds, lost))
            self.follow.append((key, count))
            below = key, count

    def lengths(self, w: np.ndarray) -> np.ndarray:
        """Code lengths of the last bytes of windows, in units."""
        bits, open_ = np.zeros(len(w)), np.ones(len(w), bool)
        kinds_above, lost_above = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
        for j in range(ORDER, -1, -1):
            (context, total, kinds, lost), (key, count) = self.contexts[j], self.follow[j]
            of, sure = _found(context, (w >> np.uint64(8)) & mask(j))
            at, follows = _found(key, w & mask(j + 1))
            here = open_ & sure
            new = kinds[of] - kinds_above
            all_ = np.maximum(total[of] - lost_above + new, 1)
            coded = here & follows
            bits[coded] += np.log2(all_[coded] / count[at[coded]])
            left = here & ~follows & (new > 0)
            bits[left] += np.log2(all_[left] / new[left])
            kinds_above, lost_above = np.where(here, kinds[of], kinds_above), np.where(here, lost[of], lost_above)
            open_ &= ~coded
        bits[open_] += np.log2(np.maximum(256 - kinds_above[open_], 1))
        return np.round(bits * UNIT).astype(np.int64)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Coder:
    """Code lengths of texts in every language, with the lengths of windows met before kept by their hash."""

    def __init__(self, trees: list[Tree]):
        self.trees = trees
        self.keys = np.full(1 << KEPT, np.uint64((1 << 64) - 1))  # no window
        self.known = np.zeros((len(trees), 1 << KEPT), np.int64)

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Languages by texts."""
        out = np.zeros((len(self.trees), len(offsets) - 1), np.int64)
        for begin in range(0, len(data), SLICE):
            end = min(begin + SLICE, len(data))
            text, w = windows(data, offsets, begin, end)
            slot = (w * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - KEPT)
            hit = self.keys[slot] == w
            first = np.flatnonzero(np.diff(text, prepend=-1))
            costs = [np.where(hit, known[slot], 0) for known in self.known]
            if not hit.all():
                miss = np.flatnonzero(~hit)
                new, inverse = np.unique(w[miss], return_inverse=True)
                at = (new * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - KEPT)
                self.keys[at] = new
                stays = self.keys[at] == new  # of several windows in one place the last stays
                for tree, known, cost in zip(self.trees, self.known, costs, strict=True):
                    length = tree.lengths(new)
                    known[at[stays]] = length[stays]
                    cost[miss] = length[inverse]
            for row, cost in zip(out, costs, strict=True):
                row[text[first]] += np.add.reduceat(cost, first)
        return out


def held_out(key: Column) -> Column:
    """Rows that are never learned from: a checksum of the key leaves 1 when divided by 3. A null key isn't held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Languages:
    """The trees of the languages, names in order."""

    def __init__(self, names: list[str], trees: list[Tree]):
        self.names, self.trees = names, trees


def sampled(docs: DataFrame, key: str, text: str, lang: str, sample: int, size: int) -> DataFrame:
    """(lang, text): different texts of least hash, of each language an equal part of ``sample`` and ``size``."""
    rows = docs.where(F.col(key).isNotNull() & F.col(lang).isNotNull() & ~held_out(F.col(key)) & (F.octet_length(text) > 0))
    rows = rows.select(F.col(lang).alias("lang"), *text_key(F.col(text)), F.col(text).alias("text"))
    hashes = written(rows.select("lang", "k1", "k2", F.octet_length("text").alias("size")).distinct(), "learned")
    counts = hashes.groupBy("lang").agg(F.count("*").alias("n"))
    names = max(1, counts.count())
    part = max(1, sample // names)
    # As many rows as the model has trees, so they may be broadcast. Twice the wanted share of the hashes holds enough:
    # what is ranked is as large as the sample, and the rest of a language stays where it is.
    near = hashes.join(F.broadcast(counts), "lang").where(F.col("k1") / F.lit(2.0**64) + 0.5 <= F.lit(2.0 * part) / F.col("n"))
    by = Window.partitionBy("lang").orderBy("k1", "k2")
    near = near.withColumns({"nth": F.row_number().over(by), "before": F.sum("size").over(by) - F.col("size")})
    near = near.where((F.col("nth") <= part) & (F.col("before") < size / names)).select("lang", "k1", "k2")
    # Bounded by the sample, so it may be broadcast: only its texts leave the scan.
    return rows.join(F.broadcast(near), ["lang", "k1", "k2"]).dropDuplicates(["lang", "k1", "k2"]).select("lang", "text")


def grow(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, size: int = BYTES) -> Languages:
    """Trees of the languages of ``docs``, from at most ``sample`` texts and about ``size`` bytes outside the held-out part.

    Equal texts of a language count once; rows with a null key, language or text, or an empty text, aren't learned from.
    """
    out = T.StructType.fromDDL("lang string, w long, n long")

    def make():
        def step(b: pa.RecordBatch):
            data, offsets = joined(b.column(1))
            names = b.column(0).dictionary_encode()
            which = names.indices.to_numpy()
            for begin in range(0, len(data), SLICE):
                of, w = windows(data, offsets, begin, min(begin + SLICE, len(data)))
                for i, name in enumerate(names.dictionary.to_pylist()):
                    found, n = np.unique(w[which[of] == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n)], names=out.names)

        return step

    rows = sampled(docs, key, text, lang, sample, size).select(F.col("lang").cast("string").alias("lang"), "text")
    counted = map_batches(rows, out, make).groupBy("lang", "w").agg(F.sum("n").alias("n")).toArrow()
    by = counted.column("lang").to_numpy()
    w, n = counted.column("w").to_numpy().view(np.uint64), counted.column("n").to_numpy()
    names = sorted(set(by.tolist()), key=str.encode)
    return Languages(names, [Tree(w[by == x], n[by == x]) for x in names])


def languages(docs: DataFrame, model: Languages, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with held_out, lang_pred and score of every row.

    ``lang_pred`` is the language whose tree codes the text shortest, of equal ones the first by name, and ``score`` its
    share when every language weighs 2 to the power of minus its code length. A null text, one without a letter, or no
    language learned: ``und`` with score 0. Equal texts have equal results; other columns are ignored.
    """
    keep = [key] if keep is None else keep
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    row = F.struct(*(F.col(c) for c in keep))
    cols = docs.select(row.alias("row"), held_out(F.col(key)).alias("held_out"), F.when(lettered, F.col(text)).alias("body"))
    out = fields(docs, keep, ("held_out", T.BooleanType()), ("lang_pred", T.StringType()), ("score", T.DoubleType()))
    names = [*model.names, UNKNOWN]

    def make():
        coder = Coder(model.trees)

        def step(b: pa.RecordBatch):
            body = b.column(2)
            none = body.is_null().to_numpy(zero_copy_only=False)
            best, score = np.full(b.num_rows, len(names) - 1), np.zeros(b.num_rows)
            if coder.trees:
                lengths = coder.lengths(*joined(body))
                pick = lengths.argmin(axis=0)
                share = 1 / np.exp2((lengths.min(axis=0) - lengths) / UNIT).sum(axis=0)
                best, score = np.where(none, best, pick), np.where(none, 0.0, share)
            made = [pa.array(names).take(pa.array(best)), pa.array(score)]
            yield pa.RecordBatch.from_arrays([*b.column(0).flatten(), b.column(1), *made], names=out.names)

        return step

    return map_batches(cols, out, make)
