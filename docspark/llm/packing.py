"""Best-fit packing by bin completion.

Documents become token pieces of at most ``capacity`` tokens inside Spark. Full pieces fill a sequence alone.
How many shorter pieces there are of each length is a table of fewer than ``capacity`` rows, whatever the
input; over it a branch and bound builds sequences around the largest piece left: it enumerates fillings of
the room beside it that no other filling dominates, applies one as often as the counts allow, and prunes
by the waste a better result could still afford. The best-fit decreasing packing is the first incumbent. Its
outcome is a list of patterns with multiplicities; pieces are numbered within their length by distributed
counts, and look up their pattern by that number.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.pretokens import Encoder
from docspark.llm.tables import fields, map_batches, written
from docspark.llm.textbytes import chunks, joined

Pattern = tuple[int, ...]
# Search nodes after which the best packing so far is taken, and fillings tried at a node.
NODES, BREADTH = 20_000, 6


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over counts: a length goes to the bins with the least room that takes it."""
    rooms: list[dict[Pattern, int]] = [{} for _ in range(capacity + 1)]
    for size in sorted(counts, reverse=True):
        left = counts[size]
        for room in range(size, capacity):
            while left and rooms[room]:
                bins, n = rooms[room].popitem()
                k = min(room // size, left)
                take = min(n, left // k)
                if take < n:
                    rooms[room][bins] = n - take
                grown = bins + (size,) * k
                rooms[room - k * size][grown] = rooms[room - k * size].get(grown, 0) + take
                left -= take * k
        per = capacity // size
        for k, n in ((per, left // per), (left % per, 1)):
            if k and n:
                rooms[capacity - k * size][(size,) * k] = rooms[capacity - k * size].get((size,) * k, 0) + n
    return [(bins, n) for room in rooms for bins, n in room.items()]


def sums(sizes: list[int], capacity: int) -> int:
    """Bit s is set when some multiset of ``sizes`` adds up to s, for s up to ``capacity``."""
    reach, full = 1, (1 << capacity + 1) - 1
    for s in sizes:
        step = s
        while step <= capacity:
            reach |= reach << step & full
            step *= 2
    return reach


def dominates(a: Pattern, b: Pattern) -> bool:
    """Whether the items of ``b`` fit into the items of ``a``, taken as bins: then ``b`` is never better."""
    if len(b) > 8:
        return False

    def place(i: int, room: list[int]) -> bool:
        if i == len(b):
            return True
        for j, r in enumerate(room):
            if r >= b[i]:
                room[j] -= b[i]
                if place(i + 1, room):
                    return True
                room[j] += b[i]
        return False

    return place(0, list(a))


def fillings(room: int, sizes: list[int], counts: dict[int, int], reach: int, breadth: int = BREADTH) -> list[Pattern]:
    """Undominated fillings of ``room`` with the least waste found, those of few large items first."""
    found: list[Pattern] = []
    fit = reach & (1 << room + 1) - 1
    for waste in range(room + 1):
        target = room - waste
        if not fit >> target & 1:
            continue
        steps = 0

        def grow(rest: int, at: int, taken: Pattern) -> Iterator[Pattern]:
            nonlocal steps
            if rest == 0:
                yield taken
                return
            for i in range(at, len(sizes)):
                s = sizes[i]
                if s > rest or not reach >> rest - s & 1 or counts[s] <= taken.count(s):
                    continue
                steps += 1
                if steps > 4000:
                    return
                yield from grow(rest - s, i, (*taken, s))

        for f in grow(target, 0, ()):
            if not any(dominates(g, f) for g in found):
                found.append(f)
            if len(found) >= breadth:
                break
        if found:
            return found
    return [()]


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """Lower bound: for every small size, what must stand alone and what the room beside it can't take."""
    n = np.zeros(capacity + 1, np.int64)
    for s, k in counts.items():
        n[s] = k
    items, volume = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    half = capacity // 2
    bound = math.ceil(volume[-1] / capacity)
    for small in range(1, half + 1):
        alone = items[-1] - items[capacity - small]
        middle = items[capacity - small] - items[half]
        beside = middle * capacity - (volume[capacity - small] - volume[half])
        rest = volume[half] - volume[small - 1]
        bound = max(bound, int(alone + middle + max(0, math.ceil((rest - beside) / capacity))))
    return bound


def complete(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[tuple[Pattern, int]]:
    """Patterns with multiplicities that use every item, in as few bins as the search finds.

    Optimal when the bound ``ceil(total / capacity)`` is met or the search ends; else the best of ``nodes``.
    """
    counts = {s: n for s, n in counts.items() if n}
    best = best_fit(counts, capacity)
    bins = sum(n for _, n in best)
    total = sum(s * n for s, n in counts.items())
    least = least_bins(counts, capacity)
    left = dict(counts)
    known: dict[Pattern, int] = {}

    def options() -> Iterator[tuple[Pattern, int]]:
        sizes = sorted((s for s, n in left.items() if n), reverse=True)
        key = tuple(sizes)
        if key not in known:
            if len(known) > 64:
                known.clear()
            known[key] = sums(sizes, capacity)
        top = sizes[0]
        left[top] -= 1
        ways = fillings(capacity - top, sizes, left, known[key])
        left[top] += 1
        out = []
        for f in ways:
            pattern = (top, *f)
            out.append((pattern, min(left[s] // pattern.count(s) for s in set(pattern))))
        return iter(out)

    def apply(pattern: Pattern, times: int) -> None:
        for s in pattern:
            left[s] -= times

    stack: list[Iterator[tuple[Pattern, int]]] = [options()] if bins > least else []
    chosen: list[tuple[Pattern, int]] = []
    used = waste = seen = 0
    while stack and bins > least and seen < nodes:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if chosen:
                pattern, times = chosen.pop()
                apply(pattern, -times)
                used -= times
                waste -= times * (capacity - sum(pattern))
            continue
        pattern, times = step
        seen += 1
        more = times * (capacity - sum(pattern))
        # A better packing has at most ``bins - 1`` bins, so its waste is bounded.
        if waste + more > (bins - 1) * capacity - total:
            continue
        apply(pattern, times)
        chosen.append(step)
        used += times
        waste += more
        if any(left.values()):
            stack.append(options())
            continue
        if used < bins:
            best, bins = list(chosen), used
        chosen.pop()
        apply(pattern, -times)
        used -= times
        waste -= more
    return best


def lookup(patterns: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """Rows (length, first rank, copies in a bin, first sequence, place in it), sorted by length and rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        at = 0
        for s in sorted(set(pattern), reverse=True):
            k = pattern.count(s)
            rows.append((s, rank.get(s, 0), k, sequence, at))
            rank[s] = rank.get(s, 0) + k * times
            at += k * s
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "copies", "sequence", "at"), table.T, strict=True))


def cut(docs: DataFrame, path: str, capacity: int, end: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Token pieces: key, piece, start, length, ids_crc32, and the task and number within (task, length)."""
    encoder = Encoder(path)
    long = T.LongType()
    out = fields(docs, [key], ("piece", T.IntegerType()), ("start", long), ("length", long), ("ids_crc32", long), ("task", long), ("nth", long))
    stop = np.array([end], "<u4").tobytes()

    def make():
        memo = encoder.open()
        task = TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, np.int64)

        def step(b: pa.RecordBatch):
            data, offsets = joined(b.column(1))
            for i, j in chunks(offsets):
                ids, at = memo.encoded(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids = ids.astype("<u4")
                rows, piece, start, length, crc = [], [], [], [], []
                for d in range(j - i):
                    n = int(at[d + 1] - at[d]) + 1
                    first = n % capacity or capacity
                    cuts = [0, *range(first, n + 1, capacity)]
                    for p, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        body = zlib.crc32(ids[at[d] + x : at[d] + min(y, n - 1)])
                        rows.append(i + d)
                        piece.append(p)
                        start.append(x)
                        length.append(y - x)
                        crc.append(zlib.crc32(stop, body) if y == n else body)
                size = np.array(length, np.int64)
                order = np.argsort(size, kind="stable")
                ordered = size[order]
                nth = np.empty(len(size), np.int64)
                nth[order] = np.arange(len(size)) - np.searchsorted(ordered, ordered) + met[ordered]
                met[:] += np.bincount(size, minlength=capacity + 1)
                made = [piece, start, size, crc, np.full(len(size), task), nth]
                made = [pa.array(m, pa.int32() if k == 0 else pa.int64()) for k, m in enumerate(made)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), *made], names=out.names)

        return step

    return map_batches(docs.select(key, text), out, make)


def pack(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every piece of every document with its sequence_id and offset in that sequence.

    Columns: key, piece, start, length, ids_crc32, sequence_id, offset. A document's ids end with ``end``; a
    null or empty text is that one token. Documents over ``capacity`` are cut, the first piece taking the rest.
    Rows with equal or null keys are documents of their own. No rows give no rows; other columns are ignored.
    """
    pieces = written(cut(docs, path, capacity, end, text, key), "pieces")
    columns = [key, "piece", "start", "length", "ids_crc32"]
    full = pieces.where(F.col("length") == capacity).select(
        *columns, (-1 - (F.col("task") * F.lit(1 << 40) + F.col("nth"))).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    short = pieces.where(F.col("length") < capacity)
    # Fewer rows than ``capacity``, so the driver may hold them.
    counts = {r["length"]: r["n"] for r in short.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = lookup(complete(counts, capacity))
    by_task = short.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begin = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("begin"))
    ranked = short.join(begin, ["task", "length"]).select(*columns, (F.col("begin") + F.col("nth")).alias("rank"))
    out = fields(pieces, columns, ("sequence_id", T.LongType()), ("offset", T.LongType()))

    def make():
        wide = 1 << 44
        keys = plan["length"] * wide + plan["rank"]

        def step(b: pa.RecordBatch):
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            row = np.searchsorted(keys, length * wide + rank, "right") - 1
            nth = rank - plan["rank"][row]
            copies = plan["copies"][row]
            sequence = plan["sequence"][row] + nth // copies
            offset = plan["at"][row] + nth % copies * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=out.names)

        return step

    return map_batches(ranked, out, make).unionByName(full)
