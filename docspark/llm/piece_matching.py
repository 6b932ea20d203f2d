"""SentencePiece encoding and decoding by suffix-array matching.

The words of a batch that are new to the task are joined into one text and its suffix array is induced. A binary
search over it finds, for every piece of the vocabulary, the range of suffixes that start with it, and so all its
places: these are edges from a start to an end. Sorted by position, the edges are relaxed from left to right.

The model merges pairs by score, so its result isn't the path of best sum. But every beginning of a
word has one encoding, and a word's encoding is that of a beginning plus one piece that the merges would
have left apart from the piece before it. An edge relaxes its end when that holds, which is told from the
two pieces' own merges: the pieces along the cut, as they were merged, must never have met as a vocabulary
string that was due earlier than the merges that took them away from the cut. Characters without a piece are
bytes, and nothing merges across them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import sentencepiece

from docspark.llm.pretokens import Known
from docspark.llm.suffix_arrays import suffix_array
from docspark.llm.textbytes import ranges

BAR = "▁"
NONE, FREE = -1, -2
FAR = 1 << 40


class Pieces:
    """A merge-based SentencePiece model as arrays, made once on the driver; its size is the vocabulary's."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            self.digest = hashlib.sha256(f.read()).hexdigest()
        if sp.normalize(" a  ﬁ ") != f"{BAR}{BAR}a{BAR}{BAR}ﬁ{BAR}":
            raise ValueError("only models that leave text as it is, with a blank put before it, are supported")
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        texts = [sp.id_to_piece(i) for i in plain]
        if any(BAR in t.lstrip(BAR) for t in texts):
            raise ValueError("a piece goes on after a word's end")
        scores = {t: sp.get_score(i) for t, i in zip(texts, plain, strict=True)}
        due = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rank = {t: due[s] for t, s in scores.items()}
        own = [(t, i, *self._split(t, rank)) for t, i in zip(texts, plain, strict=True)]
        own = [x for x in own if x[2] is not None]
        number = {x[0]: k for k, x in enumerate(own)}
        self.bytes = [x[0].encode() for x in own]
        self.ids = np.array([x[1] for x in own], np.int64)
        self.rank = np.array([rank[x[0]] for x in own], np.int64)
        self.left = np.array([number.get(x[2], NONE) for x in own], np.int64)
        self.right = np.array([number.get(x[3], NONE) for x in own], np.int64)
        self.time = np.where(self.left < 0, -1, self.rank)
        pairs = {}
        for t in number:
            for i in range(1, len(t)):
                a, b = number.get(t[:i]), number.get(t[i:])
                if a is not None and b is not None:
                    pairs[a * len(own) + b] = rank[t]
        self.pairs = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        table = [b"" if sp.is_control(i) or sp.is_unknown(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).encode() for i in range(n)]
        self.text_size = np.array([len(x) for x in table], np.int64)
        self.text_at = np.cumsum(self.text_size) - self.text_size
        self.text = np.frombuffer(b"".join(table), np.uint8)

    @staticmethod
    def _split(text: str, rank: dict[str, int]) -> tuple[str | None, str | None]:
        """The last two parts that merging joins into ``text``; none if merging never gets there."""
        parts = list(text)
        if len(parts) == 1:
            return "", ""
        while len(parts) > 2:
            due = [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)) if a + b in rank]
            if not due:
                return None, None
            i = min(due)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def apart(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether merging leaves piece ``v`` apart from piece ``u`` before it."""
        n = len(self.ids)
        fine = np.ones(len(u), bool)
        at = np.arange(len(u))
        x, y = u.copy(), v.copy()
        x_ends, y_ends = np.full(len(u), FAR), np.full(len(u), FAR)
        while len(at):
            key = x * n + y
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            due = np.where(self.pairs[place] == key, self.pair_rank[place], FAR)
            # Of two merges due at once the left one goes first.
            met = (due < x_ends) & (due <= y_ends) & (due < FAR)
            fine[at[met]] = False
            back_x = self.time[x] > self.time[y]
            go = ~met & ((self.time[x] >= 0) | (self.time[y] >= 0))
            x_ends = np.where(back_x, self.time[x], x_ends)[go]
            y_ends = np.where(back_x, y_ends, self.time[y])[go]
            x, y = np.where(back_x, self.right[x], x)[go], np.where(back_x, y, self.left[y])[go]
            at = at[go]
        return fine

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, offsets): pieces and bytes joined, bars back to blanks, the first blank dropped."""
        size = self.text_size[ids]
        data = self.text[ranges(self.text_at[ids], size)]
        at = np.concatenate([[0], np.cumsum(size)])[offsets]
        bar = _bars(data)
        first = at[:-1][at[1:] > at[:-1]]
        keep = np.ones(len(data), bool)
        keep[bar + 1] = keep[bar + 2] = False
        keep[first[np.isin(first, bar)]] = False
        data = data.copy()
        data[bar] = 0x20
        return data[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def _bars(data: np.ndarray) -> np.ndarray:
    if len(data) < 3:
        return np.zeros(0, np.int64)
    return np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))


def _bars_written(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a bar for every blank and one before each text that isn't empty."""
    bar = np.frombuffer(BAR.encode(), np.uint8)
    blank = data == 0x20
    size = np.where(blank, 3, 1)
    length = np.diff(offsets)
    text = np.repeat(np.arange(len(length)), length)
    lead = 3 * np.cumsum(length > 0)
    place = np.cumsum(size) - size + lead[text]
    out = np.empty(int(size.sum()) + 3 * int((length > 0).sum()), np.uint8)
    out[place] = data
    total = np.concatenate([[0], np.cumsum(size)])[offsets] + np.concatenate([[0], lead])
    begin = np.concatenate([place[blank], total[:-1][length > 0]])
    for k in range(3):
        out[begin + k] = bar[k]
    return out, total


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one big-endian number, zeros past the end."""
    out = np.zeros(len(data) + 64, np.uint64)
    for k in range(8):
        out[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


class Matcher:
    """Words met so far with their ids, and the matching of new ones."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.known = Known(np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        self.length = np.array([len(b) for b in pieces.bytes], np.int64)
        width = -(-int(self.length.max()) // 8)
        body = np.frombuffer(b"".join(b.ljust(8 * width, b"\0") for b in pieces.bytes), ">u8").astype(np.uint64)
        self.want = body.reshape(-1, width)
        used = np.clip(self.length[:, None] - 8 * np.arange(width)[None, :], 0, 8).astype(np.uint64)
        every = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.mask = np.where(used == 0, np.uint64(0), every << ((np.uint64(8) - np.maximum(used, 1)) * np.uint64(8)))

    def _search(self, eights: np.ndarray, order: np.ndarray, past: bool) -> np.ndarray:
        """For every piece, how many suffixes, cut to its length, are less (or, ``past``, not greater)."""
        low, high = np.zeros(len(self.want), np.int64), np.full(len(self.want), len(order))
        for _ in range(int(len(order)).bit_length()):
            middle = np.minimum((low + high) // 2, len(order) - 1)
            at = order[middle]
            sign = np.zeros(len(self.want), np.int8)
            for k in range(self.want.shape[1]):
                have = eights[at + 8 * k] & self.mask[:, k]
                step = (have > self.want[:, k]).astype(np.int8) - (have < self.want[:, k]).astype(np.int8)
                sign = np.where(sign == 0, step, sign)
            go = (sign < 0) | (past & (sign == 0))
            go &= low < high
            low, high = np.where(go, middle + 1, low), np.where(go, high, middle)
        return low

    def _match(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words: spans of ``data``, all different."""
        size = ends - starts
        count = len(starts)
        begin = np.cumsum(size + 1) - size - 1
        text = np.full(int((size + 1).sum()), 0xFF, np.uint8)
        text[ranges(begin, size)] = data[ranges(starts, size)]
        order = suffix_array(text)
        eights = _eights(text)
        low, high = self._search(eights, order, False), self._search(eights, order, True)
        n = high - low
        at = order[ranges(low, n)]
        piece = np.repeat(np.arange(len(n), dtype=np.int32), n)
        # A character that is no piece stands for its bytes, as an edge of its own.
        sign = np.flatnonzero(((text & 0xC0) != 0x80) & (text != 0xFF))
        lead = text[sign]
        wide = np.where(lead >= 0xF0, 4, np.where(lead >= 0xE0, 3, np.where(lead >= 0xC0, 2, 1)))
        single = np.zeros(len(text), bool)
        lone = self.p.left < 0
        single[at[lone[piece]]] = True
        other = ~single[sign]
        end = np.concatenate([at + self.length[piece], sign[other] + wide[other]]).astype(np.int32)
        at = np.concatenate([at, sign[other]]).astype(np.int32)
        piece = np.concatenate([piece, np.full(int(other.sum()), FREE, np.int32)])
        by = np.argsort(at, kind="stable")
        at, end, piece = at[by], end[by], piece[by]
        depth = at - begin[np.searchsorted(begin, at, "right") - 1].astype(np.int32)
        by = np.argsort(depth.astype(np.uint16) if len(depth) and depth.max() < 65536 else depth, kind="stable")
        at, end, piece, depth = at[by], end[by], piece[by], depth[by]
        last = np.full(len(text) + 1, NONE, np.int32)
        origin = np.full(len(text) + 1, NONE, np.int32)
        last[begin] = FREE
        cuts = np.flatnonzero(np.diff(depth, prepend=-1)) if len(depth) else np.zeros(0, np.int64)
        for a, b in zip(cuts, np.append(cuts[1:], len(depth)), strict=True):
            u, v = last[at[a:b]], piece[a:b]
            live = np.flatnonzero(u != NONE)
            u, v = u[live], v[live]
            fine = (u == FREE) | (v == FREE)
            both = np.flatnonzero(~fine)
            if len(both):
                pair, inverse = np.unique(u[both].astype(np.int64) * len(self.length) + v[both], return_inverse=True)
                fine[both] = self.p.apart(pair // len(self.length), pair % len(self.length))[inverse]
            hit = a + live[fine]
            last[end[hit]] = piece[hit]
            origin[end[hit]] = at[hit]
        return self._paths(text, begin, size, last, origin, count)

    def _paths(self, text, begin, size, last, origin, count) -> tuple[np.ndarray, np.ndarray]:
        """Follows every word back from its end; ids in order, bytes for characters without a piece."""
        at, word, step = begin + size, np.arange(count), 0
        found = []
        while len(at):
            if (last[at] == NONE).any():
                raise ValueError("a word has no encoding")
            found.append((word, np.full(len(at), step), origin[at], at, last[at]))
            at = origin[at]
            live = at > begin[word]
            at, word, step = at[live], word[live], step + 1
        if not found:
            return np.zeros(0, np.uint32), np.zeros(count, np.int64)
        word, step, a, b, piece = (np.concatenate(c) for c in zip(*found, strict=True))
        by = np.lexsort((-step, word))
        word, a, b, piece = word[by], a[by], b[by], piece[by]
        raw = piece == FREE
        n = np.where(raw, b - a, 1)
        out = np.repeat(np.where(raw, 0, self.p.ids[np.maximum(piece, 0)]), n)
        where = np.cumsum(n) - n
        out[ranges(where[raw], n[raw])] = self.p.byte_ids[text[ranges(a[raw], n[raw])]]
        return out, np.bincount(word, n, count).astype(np.int64)

    def encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text in them)."""
        data, offsets = _bars_written(data, offsets)
        if len(data) == 0:
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        # Pieces never go on after a word's end, so a bar after anything else but a bar starts a new word.
        bar = np.zeros(len(data) + 3, bool)
        bar[_bars(data)] = True
        start = bar[: len(data)].copy()
        start[3:] &= ~bar[: len(data) - 3]
        start[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(data))
        place = self.known.find(data, starts, ends, lambda s, e: self._match(data, s, e))
        size = self.known.size[place]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.known.ids[ranges(self.known.at[place], size)].astype(np.int64), total[np.searchsorted(starts, offsets)]


_opened: dict[str, Matcher] = {}


def matcher(pieces: Pieces) -> Matcher:
    """One per worker, which keeps it from task to task."""
    if pieces.digest not in _opened:
        _opened.clear()
        _opened[pieces.digest] = Matcher(pieces)
    return _opened[pieces.digest]
