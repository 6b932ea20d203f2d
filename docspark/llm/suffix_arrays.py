"""Suffix arrays by induced sorting and permuted common prefixes, as array operations.

Suffixes are classified as smaller (S) or larger (L) than the one after them. The leftmost-smaller substrings,
from one leftmost S suffix to the next, are sorted by one round of inducing and named in that order; while names
repeat, neighbouring names are paired and renamed, so that each round doubles what a name stands for. In the order
so found the leftmost-smaller suffixes are put into their first characters' buckets, and all others are
induced from them: L suffixes over ascending buckets, S suffixes over descending ones. Inside a bucket the
induced entries are taken in rounds, a round being those that the round before put there, which keeps the order of
a one-by-one scan; the work is linear, plus a round for each repetition of one character.
"""

from __future__ import annotations

import numpy as np

from docspark.llm.textbytes import Spans


def _classes(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next; the last, a lone least character, is."""
    step = np.zeros(len(t), np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1])
    step[-1] = 1
    at = np.where(step != 0, np.arange(len(t), dtype=np.int32), len(t) - 1)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _spread(found: np.ndarray, t: np.ndarray, free: np.ndarray, out: np.ndarray, way: int) -> None:
    """Puts positions at their buckets' free ends in the order given."""
    if len(found) == 0:
        return
    order = np.argsort(t[found], kind="stable")
    found = found[order]
    c = t[found]
    n = np.bincount(c, minlength=len(free))
    rank = np.arange(len(found)) - (np.cumsum(n) - n)[c]
    out[free[c] + way * rank] = found
    free += way * n


def _induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All suffixes in order, from leftmost-smaller ones in order."""
    first = np.cumsum(sizes) - sizes
    out = np.full(len(t), -1, np.int32)
    per = np.bincount(t[seeds], minlength=len(sizes))
    seed_at = np.concatenate([[0], np.cumsum(per)])
    head = first.copy()

    def before(positions: np.ndarray, kind: bool) -> np.ndarray:
        p = positions[positions > 0] - 1
        return p[small[p] == kind]

    for c in np.flatnonzero(sizes):
        done = first[c]
        while done < head[c]:
            here = out[done : head[c]]
            done = head[c]
            _spread(before(here, False), t, head, out, 1)
        _spread(before(seeds[seed_at[c] : seed_at[c + 1]], False), t, head, out, 1)
    tail = first + sizes - 1
    for c in np.flatnonzero(sizes)[::-1]:
        done = first[c] + sizes[c] - 1
        if c == 0:
            out[0] = len(t) - 1
            break
        while done > tail[c]:
            here = out[tail[c] + 1 : done + 1][::-1]
            done = tail[c]
            _spread(before(here, True), t, tail, out, -1)
        _spread(before(out[first[c] : head[c]][::-1], True), t, tail, out, -1)
    return out


def _ranked(names: np.ndarray) -> np.ndarray:
    """The suffixes of a string of names in order, by pairing and renaming until all differ."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    ordered = names[order]
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.searchsorted(ordered, ordered)
    rank[n] = -1
    size = np.bincount(rank[:n], minlength=n)
    open_ = np.flatnonzero(size[rank[:n]] > 1)
    reach = 1
    while len(open_):
        key = rank[open_] * (n + 1) + rank[np.minimum(open_ + reach, n)] + 1
        order = np.argsort(key, kind="stable")
        open_, key = open_[order], key[order]
        old = rank[open_]
        at = np.arange(len(open_))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.concatenate([[True], old[1:] != old[:-1]])
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank[open_] = old + start - np.maximum.accumulate(np.where(group, at, 0))
        last = np.concatenate([new[1:], [True]])
        open_ = open_[~(new & last)]
        reach *= 2
    out = np.empty(n, np.int64)
    out[rank[:n]] = np.arange(n)
    return out


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of a byte array in order."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int32)
    t = np.zeros(n + 1, np.int16)
    t[:-1] = data
    t[:-1] += 1
    small = _classes(t)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    sizes = np.bincount(t, minlength=257)
    seeds = leftmost[np.argsort(t[leftmost], kind="stable")]
    if len(leftmost) > 1:
        place = np.full(n + 1, -1, np.int32)
        place[leftmost] = np.arange(len(leftmost), dtype=np.int32)
        ordered = _induce(t, small, seeds, sizes)
        ordered = ordered[place[ordered] >= 0]
        ends = np.append(leftmost[1:], n)
        sums = Spans(np.append(data, np.uint8(0)))
        value = sums.of(leftmost, ends + 1)
        value[-1] = np.uint64(0)
        value = value[place[ordered]]
        names = np.empty(len(leftmost), np.int64)
        names[place[ordered]] = np.concatenate([[0], np.cumsum(value[1:] != value[:-1])])
        seeds = leftmost[_ranked(names)]
    return _induce(t, small, seeds, sizes)[1:]


def common_prefixes(data: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(common prefix of each suffix with the one before it in order, by text position; that suffix, or -1).

    Where the characters before both agree, the value is one less than at the position before; only the others
    are compared, eight bytes at a time.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(pad.view(np.uint8)[: n + 8], (n + 1, 8), (1, 1))
    at = np.arange(n)
    fresh = (before <= 0) | (at == 0)
    inner = np.flatnonzero(~fresh)
    fresh[inner] = data[inner - 1] != data[before[inner] - 1]
    fresh &= before >= 0
    i = np.flatnonzero(fresh)
    j = before[i]
    length = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    while len(live):
        a, b = i[live] + length[live], j[live] + length[live]
        most = n - np.maximum(a, b)
        a, b = np.minimum(a, n), np.minimum(b, n)
        same = eight[a] == eight[b]
        got = np.minimum(np.where(same.all(axis=1), 8, same.argmin(axis=1)), np.minimum(most, 8))
        length[live] += got
        live = live[got == 8]
    out = np.zeros(n, np.int64)
    out[i] = length + i
    # A suffix without one before it stops what the positions before it would pass on.
    none = before < 0
    out[none] = at[none]
    out = np.maximum.accumulate(np.where(fresh | none, out, 0))
    return np.maximum(out - at, 0), before
