"""Removal of repeated byte strings and passages of words with sharded suffix arrays.

Two equal strings of ``length`` bytes must meet in one shard. Each window of that length is owned by the least
hashed ``GRAM``-byte string inside it, so equal windows have equal owners, and neighbouring windows with the same
owner form a run: a segment of text that a shard can take whole. Runs whose owner occurs once in the corpus
can't repeat and go no further. Equal segments are counted before anything moves; owners with different
segments go to shards of bounded size, where the suffix array of the segments is induced and common prefixes
of neighbouring suffixes tell which windows start elsewhere too. An owner with more bytes than a shard should
hold is dealt anew: its segments are searched as texts of their own, with owners by another hash, so that what they have
in common no longer decides. What that doesn't part is counted by 128-bit hashes of its windows.

Passages are measured in words: a text of words is a text of ``CODE`` bytes for each word, searched in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.line_quality import text_key
from docspark.llm.suffix_arrays import common_prefixes, suffix_array
from docspark.llm.tables import fields, map_batches, release, written
from docspark.llm.textbytes import Spans, binary, chunks, joined, mixed, ranges, windows_of, words

GRAM_BITS = 5
GRAM = 1 << GRAM_BITS
# Bytes of a text looked at together; places inside take this many bits beside a hash.
SLICE, PLACE_BITS = 1 << 18, 20
# Segment bytes aimed at in a shard, those of one owner beyond which it is dealt anew, and how often that is done.
SHARD, HEAVY, ROUNDS = 600_000, 1_200_000, 1
RUN = "array<struct<a:bigint,b:bigint,owner:bigint,segment:bigint>>"
SPANS = "array<struct<s:bigint,e:bigint>>"
# Bytes that stand for a word where passages are measured in words, and what parts words.
CODE = 3


def runs(data: np.ndarray, offsets: np.ndarray, length: int, deal: int = 0) -> tuple[np.ndarray, ...]:
    """(text, a, b, owner, segment) of each run: windows start at a … b of that text, in order.

    Every ``deal`` orders the strings that may own a window by a hash of its own.
    """
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    grams = windows_of(data, GRAM_BITS)
    grams = mixed(grams + np.uint64(deal)) if deal else grams
    low = np.uint64((1 << PLACE_BITS) - 1)
    value = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    w = length - GRAM + 1
    rows = np.full(-(-len(value) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    rows[: len(value)] = value
    rows = rows.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - length + 1
    owner = (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & low).astype(np.int64)
    valid = np.ones(m + 1, np.int64)
    stop = np.zeros(m + 1, np.int64)
    ends = offsets[1:]
    np.add.at(stop, np.clip(np.maximum(ends - length + 1, offsets[:-1]), 0, m), 1)
    np.add.at(stop, np.clip(ends, 0, m), -1)
    valid = np.cumsum(stop)[:m] == 0
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (owner[1:] != owner[:-1])
    finish = valid.copy()
    finish[:-1] &= ~valid[1:] | (owner[1:] != owner[:-1])
    a, b = np.flatnonzero(begin), np.flatnonzero(finish)
    text = np.searchsorted(offsets, a, "right") - 1
    return text, a - offsets[text], b - offsets[text], grams[owner[a]].view(np.int64), Spans(data).of(a, b + length).view(np.int64)


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, after the last, begin, end): several short texts, or slices of one with a shared edge."""
    for i, j in chunks(offsets, SLICE):
        if offsets[j] - offsets[i] <= SLICE:
            yield i, j, int(offsets[i]), int(offsets[j])
            continue
        for s in range(int(offsets[i]), int(offsets[j]), SLICE):
            yield i, j, s, min(s + SLICE + length - 1, int(offsets[j]))


def plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as they are."""
    return data, offsets


def coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of ``CODE`` bytes below 128 for each word, so that n words have one length; white space doesn't count."""
    parts, sizes = [np.zeros(0, np.uint8)], []
    for i, j in chunks(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = words(part, at)
        hashes = Spans(part).of(starts, ends)
        code = np.empty((len(starts), CODE), np.uint8)
        for k in range(CODE):
            code[:, k] = (hashes >> np.uint64(57 - 7 * k)).astype(np.uint8) & 127
        parts.append(code.ravel())
        sizes.append(CODE * np.diff(first))
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes) if sizes else [])]).astype(np.int64)


Reading = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def text_runs(texts: DataFrame, length: int, reading: Reading = plain, deal: int = 0) -> DataFrame:
    """(k1, k2, copies, runs) of every row of (k1, k2, copies, text) whose text, as it is read, has a window."""
    out = fields(texts, ["k1", "k2", "copies"], ("runs", T._parse_datatype_string(RUN)))

    def make():
        def step(b: pa.RecordBatch):
            data, offsets = reading(*joined(b.column(3)))
            found = [tuple(np.zeros(0, np.int64) for _ in range(5))]
            for i, j, s, e in _pieces(data, offsets, length):
                at = np.clip(offsets[i : j + 1] - s, 0, e - s)
                t, x, y, owner, segment = runs(data[s:e], at, length, deal)
                back = np.where(j - i == 1, s - offsets[i], 0)
                found.append((t + i, x + back, y + back, owner, segment))
            t, *columns = (np.concatenate(c) for c in zip(*found, strict=True))
            at = np.searchsorted(t, np.arange(b.num_rows + 1))
            body = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["a", "b", "owner", "segment"])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), body)
            some = pa.array(np.diff(at) > 0)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], lists], names=out.names).filter(some)

        return step

    return map_batches(texts.select("k1", "k2", "copies", "text"), out, make)


def repeated_windows(bodies: np.ndarray, offsets: np.ndarray, owned: np.ndarray, copies: np.ndarray, length: int) -> np.ndarray:
    """Starts, in the joined segments, of owned windows that occur more than once."""
    count = len(offsets) - 1
    which = np.repeat(np.arange(count), np.diff(offsets))
    spread = np.full(len(bodies) + count, 0xFF, np.uint8)  # never a byte of UTF-8
    spread[np.arange(len(bodies)) + which] = bodies
    starts = offsets[:-1] + np.arange(count)
    order = suffix_array(spread)
    prefix, before = common_prefixes(spread, order)
    twice = np.zeros(len(spread), bool)
    far = np.flatnonzero(prefix >= length)
    twice[far] = True
    twice[before[far]] = True
    mine = np.zeros(len(spread) + 1, np.int64)
    np.add.at(mine, starts, 1)
    np.add.at(mine, starts + owned, -1)
    mine = np.cumsum(mine)[:-1] > 0
    again = copies > 1
    twice[ranges(starts[again], owned[again])] = True
    at = np.flatnonzero(twice & mine)
    return at - (np.searchsorted(starts, at, "right") - 1)


def covered(windows: np.ndarray, text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the maximal runs of bytes under windows sorted by text and start."""
    if len(windows) == 0:
        return text, windows, windows
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (windows[1:] - windows[:-1] > length)])
    last = np.concatenate([new[1:], [True]])
    return text[new], windows[new], windows[last] + length


def _lists(at: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(s), pa.array(e)], names=["s", "e"]))


def _in_shards(segments: DataFrame, length: int) -> DataFrame:
    """(owner, segment, spans) by suffix arrays; ``segments``: shard, owner, segment, copies, owned, body."""

    def solve(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns]
        _, owner, segment, copies, owned, body = columns
        data, offsets = joined(body)
        at = repeated_windows(data, offsets, owned.to_numpy(), copies.to_numpy(), length)
        which = np.searchsorted(offsets, at, "right") - 1
        which, s, e = covered(at, which, length)
        rows, first = np.unique(which, return_index=True)
        spans = _lists(np.append(first, len(s)), s - offsets[which], e - offsets[which])
        release()
        return pa.Table.from_arrays([owner.take(pa.array(rows)), segment.take(pa.array(rows)), spans], names=["owner", "segment", "spans"])

    return segments.groupBy("shard").applyInArrow(solve, f"owner bigint, segment bigint, spans {SPANS}")


def _by_windows(segments: DataFrame, length: int) -> DataFrame:
    """The same outcome by window hashes, for owners that no shard should hold."""

    def make():
        def step(b: pa.RecordBatch):
            data, offsets = joined(b.column(5))
            owned = b.column(4).to_numpy()
            for i, j in chunks(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts = ranges(at[:-1], owned[i:j])
                row = np.repeat(np.arange(i, j), owned[i:j])
                h1 = Spans(part).of(starts, starts + length).view(np.int64)
                h2 = Spans(part[::-1]).of(len(part) - starts - length, len(part) - starts).view(np.int64)
                named = [c.take(pa.array(row)) for c in b.columns[1:4]]
                yield pa.RecordBatch.from_arrays([*named, pa.array(starts - at[row - i]), pa.array(h1), pa.array(h2)], names=["owner", "segment", "copies", "at", "h1", "h2"])

        return step

    each = map_batches(segments, "owner bigint, segment bigint, copies bigint, at bigint, h1 bigint, h2 bigint", make)
    often = each.groupBy("h1", "h2").agg(F.sum("copies").alias("n")).where(F.col("n") > 1).select("h1", "h2")
    hit = each.join(often, ["h1", "h2"]).groupBy("owner", "segment").agg(F.sort_array(F.collect_list("at")).alias("at"))

    def merge():
        def step(b: pa.RecordBatch):
            lists = b.column(2)
            at, text = lists.flatten().to_numpy(), np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            which, s, e = covered(at, text, length)
            spans = _lists(np.searchsorted(which, np.arange(b.num_rows + 1)), s, e)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), spans], names=["owner", "segment", "spans"])

        return step

    return map_batches(hit, f"owner bigint, segment bigint, spans {SPANS}", merge)


def _cut(bodies: DataFrame, length: int, reading: Reading) -> DataFrame:
    """The segments that rows of (text, want) are asked for: owner, segment, copies, owned, size, body."""
    if reading is plain:
        w = bodies.select("text", F.explode("want").alias("w"))
        body = F.substring("text", (F.col("w.a") + 1).cast("int"), (F.col("w.b") - F.col("w.a") + length).cast("int"))
        return w.select("w.owner", "w.segment", "w.copies", (F.col("w.b") - F.col("w.a") + 1).alias("owned"), "w.size", body.alias("body"))
    out = T.StructType.fromDDL("owner bigint, segment bigint, copies bigint, owned bigint, size bigint, body binary")

    def make():
        def step(b: pa.RecordBatch):
            data, offsets = reading(*joined(b.column(0)))
            want = b.column(1)
            flat = want.flatten()
            row = np.repeat(np.arange(b.num_rows), np.diff(want.offsets.to_numpy()))
            first, last = (flat.field(flat.type.get_field_index(x)).to_numpy() for x in "ab")
            sizes = last - first + length
            body = data[ranges(offsets[row] + first, sizes)]
            made = [flat.field(flat.type.get_field_index(x)) for x in ("owner", "segment", "copies")]
            made += [pa.array(last - first + 1), flat.field(flat.type.get_field_index("size")), binary(body, np.concatenate([[0], np.cumsum(sizes)]))]
            yield pa.RecordBatch.from_arrays(made, names=out.names)

        return step

    return map_batches(bodies.select("text", "want"), out, make)


def _spans_of(texts: DataFrame, length: int, reading: Reading, shard: int, heavy: int, deal: int) -> DataFrame:
    """(k1, k2, spans) for every different text of (k1, k2, copies, text) with a covered byte, as it is read."""
    found = written(text_runs(texts, length, reading, deal), "runs")
    copies = found.groupBy("k1", "k2").agg(F.sum("copies").alias("copies"), F.max("runs").alias("runs"))
    each = written(copies.select("k1", "k2", "copies", F.explode("runs").alias("r")).select("k1", "k2", "copies", "r.*"), "distinct-runs")
    place = F.struct("k1", "k2", "a", "b")
    segments = each.groupBy("owner", "segment").agg(F.sum("copies").alias("copies"), F.min(place).alias("at"))
    bytes_of = F.col("at.b") - F.col("at.a") + F.lit(length)
    owners = segments.groupBy("owner").agg(F.sum("copies").alias("times"), F.count("*").alias("kinds"), F.sum(bytes_of).alias("size")).where(F.col("times") > 1)
    known = written(segments.join(owners, "owner").select("owner", "segment", "copies", "kinds", "size", "at.*"), "segments")

    alone = known.where(F.col("kinds") == 1)
    whole = F.struct(F.lit(0).cast("bigint").alias("s"), (F.col("b") - F.col("a") + F.lit(length)).alias("e"))
    whole = alone.select("owner", "segment", F.array(whole).alias("spans"))
    contested = known.where(F.col("kinds") > 1)
    sums = contested.agg(F.sum(F.when(F.col("size") <= heavy, F.col("b") - F.col("a") + length)).alias("some"), F.count(F.when(F.col("size") > heavy, 1)).alias("many")).first()
    wanted = contested.groupBy("k1", "k2").agg(F.collect_list(F.struct("owner", "segment", "copies", "a", "b", "size")).alias("want"))
    bodies = texts.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(wanted, ["k1", "k2"])
    cut = written(_cut(bodies.select(F.col("text").cast("binary").alias("text"), "want"), length, reading), "contested")
    shards = max(1, -(-(sums["some"] or 0) // shard))
    some = cut.where(F.col("size") <= heavy).select(F.pmod("owner", F.lit(shards)).alias("shard"), "owner", "segment", "copies", "owned", "body")
    spans = _in_shards(some, length).unionByName(whole)
    if sums["many"]:
        many = cut.where(F.col("size") > heavy)
        if deal < ROUNDS:
            parts = many.select(F.col("owner").alias("k1"), F.col("segment").alias("k2"), "copies", F.col("body").alias("text"))
            again = _spans_of(parts, length, plain, shard, heavy, deal + 1)
            again = again.select(F.col("k1").alias("owner"), F.col("k2").alias("segment"), "spans")
        else:
            again = _by_windows(many.select(F.lit(0).alias("shard"), "owner", "segment", "copies", "owned", "body"), length)
        spans = spans.unionByName(again)
    moved = F.transform("spans", lambda x: F.struct((x["s"] + F.col("a")).alias("s"), (x["e"] + F.col("a")).alias("e")))
    placed = each.join(spans, ["owner", "segment"]).select("k1", "k2", moved.alias("spans"))
    return placed.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def repeated_spans(docs: DataFrame, text: str = "text", length: int = 400, reading: Reading = plain, shard: int = SHARD, heavy: int = HEAVY) -> DataFrame:
    """(k1, k2, spans) for every distinct text with a covered byte: spans not yet merged across runs."""
    # A text of n coded words has at least 2n - 1 bytes.
    least = length if reading is plain else 2 * (length // CODE) - 1
    texts = docs.where(F.octet_length(F.col(f"`{text}`")) >= least)
    texts = texts.select(*text_key(F.col(f"`{text}`")), F.lit(1).cast("bigint").alias("copies"), F.col(f"`{text}`").alias("text"))
    return _spans_of(texts, length, reading, shard, heavy, 0)


def _covered_bytes(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``size`` bytes lie in a span."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def _flat_spans(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, s, e) of a batch's span lists; a null list has none."""
    offsets = lists.offsets.to_numpy()
    flat = lists.flatten()
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), np.where(valid, np.diff(offsets), 0))
    return row, flat.field(0).to_numpy(), flat.field(1).to_numpy()


def _runs_per_text(gone: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many maximal runs of marked bytes each text has."""
    begin = gone.copy()
    begin[1:] &= ~gone[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begin[edges] = gone[edges]
    return np.diff(np.concatenate([[0], np.cumsum(begin)])[offsets])


def _whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Marks widened to all bytes of a character that has one marked."""
    char = np.cumsum((data & 0xC0) != 0x80)
    hit = np.zeros(int(char[-1]) + 1 if len(char) else 1, bool)
    hit[char[gone]] = True
    return hit[char]


def _passage_bytes(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, s: np.ndarray, e: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(marked bytes, words in passages per text) for spans over coded words of at least ``least`` words."""
    starts, ends, first = words(data, offsets)
    i, j = -(-s // CODE), e // CODE
    long = j - i >= least
    row, i, j = row[long], i[long], j[long]
    gone = _covered_bytes(len(data), starts[first[row] + i], ends[first[row] + j - 1]) if len(row) else np.zeros(len(data), bool)
    in_passage = _covered_bytes(len(starts), first[row] + i, first[row] + j)
    return gone, np.diff(np.concatenate([[0], np.cumsum(in_passage)])[first])


def _with_spans(docs: DataFrame, keep: list[str], text: str, spans: DataFrame, *names: str) -> DataFrame:
    """(row, body, span lists) of every row; the spans are a written table, so a text with very many copies is split."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), *text_key(F.col(f"`{text}`")), F.col(f"`{text}`").alias("body"))
    return rows.join(spans, ["k1", "k2"], "left").select("row", F.col("body").cast("binary").alias("body"), *names)


def _digest(row: pa.StructArray, data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
    """Arrays of n_bytes, n_removed, n_spans and kept_sha256, and the remaining bytes with their offsets."""
    left = np.concatenate([[0], np.cumsum(~gone)])[offsets]
    rest = data[~gone]
    body = memoryview(np.ascontiguousarray(rest))
    hashes = [hashlib.sha256(body[a:b]).hexdigest() for a, b in zip(left[:-1], left[1:], strict=True)]
    size, stay = np.diff(offsets), np.diff(left)
    return [pa.array(size), pa.array(size - stay), pa.array(_runs_per_text(gone, offsets)), pa.array(hashes, pa.string())], rest, left


DIGEST = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType())]


def remove_repeats(docs: DataFrame, text: str = "text", keep: list[str] | None = None, length: int = 400, **sizes: int) -> DataFrame:
    """``keep`` columns with n_bytes, n_removed, n_spans, kept_sha256 and rest (the remaining bytes) per row.

    A byte goes when a string of ``length`` bytes over it also starts anywhere else, in the same text or another,
    overlaps included, judged on the input; matches never cross texts. Repeated rows are texts of their own, so
    each makes the other's bytes repeat. A null text is empty and loses nothing. ``rest`` may break a multi-byte
    character, as matches are of bytes. No rows give no rows; other columns are ignored.
    """
    keep = ["doc_id"] if keep is None else keep
    spans = written(repeated_spans(docs, text, length, plain, **sizes), "spans")
    out = fields(docs, keep, *DIGEST, ("rest", T.BinaryType()))

    def make():
        def step(b: pa.RecordBatch):
            data, offsets = joined(b.column(1))
            row, s, e = _flat_spans(b.column(2))
            made, rest, left = _digest(b.column(0), data, offsets, _covered_bytes(len(data), offsets[row] + s, offsets[row] + e))
            yield pa.RecordBatch.from_arrays([*b.column(0).flatten(), *made, binary(rest, left)], names=out.names)

        return step

    return map_batches(_with_spans(docs, keep, text, spans, "spans"), out, make)


def remove_passages(
    docs: DataFrame, text: str = "text", keep: list[str] | None = None, least: int = 51, length: int = 400, rest: bool = True, **sizes: int
) -> DataFrame:
    """What ``remove_repeats`` gives, by its rule of ``length`` bytes, then what the rule of passages gives.

    Passages are strings of ``length`` bytes or ``least`` words that start elsewhere too, both judged on the input. Words
    are what white space parts, whatever its amount, and are compared by 21-bit hashes; white space beside a
    passage of words stays. passage_words counts the words in repeated strings of ``least`` words, passage_bytes the bytes of
    all passages with whole characters, and rest, if wanted, is the text without them: a character cut in two goes, all
    others stay as they are. Nulls, copies and empty tables as in ``remove_repeats``.
    """
    keep = ["doc_id"] if keep is None else keep
    of_words = repeated_spans(docs, text, CODE * least, coded, **sizes).withColumnRenamed("spans", "of_words")
    of_words = written(of_words, "word-spans")
    of_bytes = written(repeated_spans(docs, text, length, plain, **sizes), "spans")
    spans = written(of_bytes.join(of_words, ["k1", "k2"], "full"), "all-spans")
    more = [("passage_words", T.LongType()), ("passage_bytes", T.LongType())] + ([("rest", T.StringType())] if rest else [])
    out = fields(docs, keep, *DIGEST, *more)

    def make():
        def step(b: pa.RecordBatch):
            data, offsets = joined(b.column(1))
            row, s, e = _flat_spans(b.column(2))
            gone = _covered_bytes(len(data), offsets[row] + s, offsets[row] + e)
            made, _, _ = _digest(b.column(0), data, offsets, gone)
            in_words, counts = _passage_bytes(data, offsets, *_flat_spans(b.column(3)), least)
            gone = _whole_characters(data, gone | in_words)
            left = np.concatenate([[0], np.cumsum(~gone)])[offsets]
            made += [pa.array(counts), pa.array(np.diff(offsets) - np.diff(left))]
            if rest:
                made.append(binary(data[~gone], left).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.column(0).flatten(), *made], names=out.names)

        return step

    return map_batches(_with_spans(docs, keep, text, spans, "spans", "of_words"), out, make)
