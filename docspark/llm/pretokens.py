"""Byte-level pre-tokens of many texts at once, and a memo of what each distinct pre-token encodes to.

The splitting rule is the public one of byte-level BPE (contractions; letters, digits or other signs with
one space before them; white space, whose last sign is left for what follows). It is applied to the bytes
of a whole batch with array operations. Which code points count as letter, digit or white space is asked
of the tokenizer itself, once for each code point met, so it agrees with the library at every version.
"""

from __future__ import annotations

import numpy as np
from tokenizers import Tokenizer, decoders, pre_tokenizers

from docspark.llm.tables import release
from docspark.llm.textbytes import Spans, ranges

LETTER, DIGIT, OTHER, WHITE, UNSEEN = 0, 1, 2, 3, 255
# Distinct pre-tokens kept in a task's memo before it starts afresh.
MEMO = 1_500_000


def byte_level(tok: Tokenizer) -> bool:
    """Whether the splitting below is this tokenizer's: byte level, nothing normalised, plain added tokens."""
    pre = tok.pre_tokenizer
    if not isinstance(pre, pre_tokenizers.ByteLevel) or not isinstance(tok.decoder, decoders.ByteLevel):
        return False
    plain = all(not (t.lstrip or t.rstrip or t.single_word or t.normalized) for t in tok.get_added_tokens_decoder().values())
    return tok.normalizer is None and pre.use_regex and not pre.add_prefix_space and plain and not tok.encode_special_tokens


class Splitter:
    """Pre-tokens of a byte array."""

    def __init__(self, tok: Tokenizer):
        self.pre = tok.pre_tokenizer
        self.special = [t.content.encode() for t in tok.get_added_tokens_decoder().values()]
        self.special.sort(key=len, reverse=True)
        self.table = np.full(0x110000, UNSEEN, np.uint8)
        self._learn(np.arange(128))

    def _learn(self, codes: np.ndarray) -> None:
        for c in codes.tolist():
            sign = chr(c)
            kinds = [k for k, probe in ((LETTER, "a"), (DIGIT, "1"), (OTHER, "!")) if len(self.pre.pre_tokenize_str(probe + sign)) == 1]
            self.table[c] = kinds[0] if kinds else WHITE

    def classes(self, data: np.ndarray) -> np.ndarray:
        """The class of the code point each byte belongs to."""
        out = self.table[:256][data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead) == 0:
            return out
        pad = np.concatenate([data, np.zeros(3, np.uint8)])
        b0, b1, b2, b3 = (pad[lead + i].astype(np.int64) for i in range(4))
        low = [b & 0x3F for b in (b1, b2, b3)]
        size = np.where(b0 >= 0xF0, 4, np.where(b0 >= 0xE0, 3, 2))
        code = np.select(
            [size == 2, size == 3],
            [(b0 & 0x1F) << 6 | low[0], (b0 & 0x0F) << 12 | low[0] << 6 | low[1]],
            (b0 & 0x07) << 18 | low[0] << 12 | low[1] << 6 | low[2],
        )
        kind = self.table[code]
        if (kind == UNSEEN).any():
            self._learn(np.unique(code[kind == UNSEEN]))
            kind = self.table[code]
        for i in range(4):
            has = size > i
            out[np.minimum(lead[has] + i, len(data) - 1)] = kind[has]
        return out

    def specials(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Spans of added tokens written out in a text, the leftmost and then the longest first."""
        raw, found, at = data.tobytes(), [], 0
        if not any(s in raw for s in self.special):
            return []
        while True:
            hits = [(p, -len(s)) for s in self.special if (p := raw.find(s, at)) >= 0]
            if not hits:
                return found
            p, size = min(hits)
            end = p - size
            doc = int(np.searchsorted(offsets, p, "right")) - 1
            if end <= offsets[doc + 1]:
                found.append((p, end))
                at = end
            else:
                at = p + 1

    def split(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sorted starts of all pre-tokens; each ends where the next one starts."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.int64)
        forced = np.zeros(n + 1, bool)
        forced[offsets] = True
        special = self.specials(data, offsets)
        for p, end in special:
            forced[p] = forced[end] = True
        kind = self.classes(data)
        start = forced.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        # White space before something leaves its last sign for it: a blank joins what follows.
        after = np.flatnonzero(start[1:n] & ~forced[1:n] & (kind[:-1] == WHITE)) + 1
        blank = data[after - 1] == 0x20
        start[after[blank]] = False
        start[after[blank] - 1] = True
        last = after[~blank] - 1
        for _ in range(3):
            last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
        start[last] = True
        # An apostrophe alone between what came before and letters opens a contraction.
        pad = np.concatenate([data, np.zeros(3, np.uint8)])
        mark = np.flatnonzero((data == 0x27) & start[:n])
        mark = mark[mark + 1 < n]
        mark = mark[start[mark + 1] & ~forced[mark + 1] & (kind[mark + 1] == LETTER)]
        one = mark[np.isin(pad[mark + 1], np.frombuffer(b"stmd", np.uint8))]
        pair = pad[mark + 1].astype(np.int64) << 8 | pad[mark + 2]
        two = mark[np.isin(pair, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")]) & ~forced[np.minimum(mark + 2, n)]]
        start[one + 1] = False
        start[one + 2] = True
        start[two + 1] = False
        start[two + 3] = True
        for p, end in special:
            start[p + 1 : end] = False
        return np.flatnonzero(start[:n])


def whole_tokens(tok: Tokenizer) -> list[tuple[str, int]]:
    """The vocabulary strings proved to encode alone as their one token: every one is encoded and compared."""
    ids = range(tok.get_vocab_size())
    texts = [tok.decode([i], skip_special_tokens=False) for i in ids]
    found = []
    # In parts, so that the library's results don't pile up.
    for at in range(0, len(texts), 1024):
        part = texts[at : at + 1024]
        for i, t, e in zip(ids[at : at + 1024], part, tok.encode_batch(part, add_special_tokens=False), strict=True):
            if e.ids == [i] and "�" not in t and t:
                found.append((t, i))
    release()
    return found


# Bits of a slot's number in the memo's first look-up.
SLOTS = 20
_BEYOND = np.array([(1 << 64) - (1 << 8 * k) for k in range(9)], np.uint64)


def keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What tells spans of UTF-8 bytes apart: up to 8 bytes are their own key, longer spans have a hash.

    Places beyond a short span's end hold 0xFF, which UTF-8 never has, so short spans never share a key.
    """
    size = ends - starts
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    out = eight[starts].view("<u8").ravel() | _BEYOND[np.minimum(size, 8)]
    long = np.flatnonzero(size > 8)
    if len(long):
        end = np.cumsum(size[long])
        out[long] = Spans(data[ranges(starts[long], size[long])]).of(end - size[long], end)
    return out


class Known:
    """Token ids by the key of what they encode; it starts from a base it may fall back to.

    Entries are numbered as they come. A table of slots finds those met of late, a sorted array all of them.
    """

    def __init__(self, hashes: np.ndarray, ids: np.ndarray):
        order = np.argsort(hashes)
        self.base = (hashes[order], order, ids.astype(np.uint32), np.arange(len(ids)), np.ones(len(ids), np.int64))
        self.slot_key = np.zeros(1 << SLOTS, np.uint64)
        self._restart()

    def _restart(self) -> None:
        self.keys, self.entry, self.ids, self.at, self.size = self.base
        self.slot_entry = np.full(1 << SLOTS, -1, np.int32)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode) -> np.ndarray:
        """Every span's entry; ``encode(starts, ends)`` gives (ids, sizes) of distinct spans met anew."""
        key = keys(data, starts, ends)
        slot = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)
        out = self.slot_entry[slot]
        rest = np.flatnonzero((out < 0) | (self.slot_key[slot] != key))
        distinct, first, inverse = np.unique(key[rest], return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > MEMO:
            self._restart()
            rest = np.arange(len(key))
            distinct, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        if len(rest) == 0:
            return out
        place = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        missing = self.keys[place] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        if missing.any():
            new = rest[first[missing]]
            self._add(distinct[missing], *encode(starts[new], ends[new]))
            place = np.searchsorted(self.keys, distinct)
        entry = self.entry[place]
        out[rest] = entry[inverse]
        slot = slot[rest[first]]
        self.slot_key[slot] = distinct
        self.slot_entry[slot] = entry
        return out

    def _add(self, hashes: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        keys = np.concatenate([self.keys, hashes])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.entry = np.concatenate([self.entry, len(self.at) + np.arange(len(hashes))])[order]
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(size) - size])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.size = np.concatenate([self.size, size])


class Memo:
    """A byte-level tokenizer: the proved whole tokens, then the rest as they are met and merged."""

    def __init__(self, tok: Tokenizer, whole: list[tuple[str, int]]):
        self.tok = tok
        self.splitter = Splitter(tok)
        raw = [t.encode() for t, _ in whole]
        at = np.cumsum([0, *map(len, raw)])
        flat = np.frombuffer(b"".join(raw), np.uint8)
        self.known = Known(keys(flat, at[:-1], at[1:]), np.array([i for _, i in whole], np.uint32))

    def _places(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        def merge(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            raw = data.tobytes()
            got: list[list[int]] = []
            for i in range(0, len(begin), 4096):
                texts = [raw[a:b].decode() for a, b in zip(begin[i : i + 4096].tolist(), end[i : i + 4096].tolist(), strict=True)]
                got += [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)]
            size = np.array([len(x) for x in got], np.int64)
            return np.fromiter((i for x in got for i in x), np.uint32, int(size.sum())), size

        return self.known.find(data, starts, np.append(starts[1:], len(data)), merge)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of every text."""
        starts = self.splitter.split(data, offsets)
        total = np.zeros(len(starts) + 1, np.int64)
        if len(starts):
            place = self._places(data, starts)
            np.cumsum(self.known.size[place], out=total[1:])
        text = np.searchsorted(starts, offsets)
        return total[text[1:]] - total[text[:-1]]

    def encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text in them)."""
        starts = self.splitter.split(data, offsets)
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        place = self._places(data, starts)
        size = self.known.size[place]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.known.ids[ranges(self.known.at[place], size)], total[np.searchsorted(starts, offsets)]


class Plain:
    """The same two calls for any other tokenizer: the library takes the texts whole."""

    def __init__(self, tok: Tokenizer):
        self.tok = tok

    def encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        got = [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        at = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)
        return np.fromiter((i for x in got for i in x), np.uint32, int(at[-1])), at

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.diff(self.encoded(data, offsets)[1])


_opened: dict[str, Memo | Plain] = {}


class Encoder:
    """What tasks receive: the tokenizer's file and the proved whole tokens, both of fixed size."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.body = f.read()
        tok = Tokenizer.from_str(self.body)
        self.whole = whole_tokens(tok) if byte_level(tok) else None

    def open(self) -> Memo | Plain:
        """One per worker, which keeps it from task to task: what it has merged, it knows (``MEMO`` at most)."""
        import os

        if self.body not in _opened:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            tok = Tokenizer.from_str(self.body)
            _opened.clear()
            _opened[self.body] = Plain(tok) if self.whole is None else Memo(tok, self.whole)
        return _opened[self.body]
