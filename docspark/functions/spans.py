"""Spans of a text in one linear pass each: pattern matches, merged token predictions, overlaps, first places.

All take and give Arrow arrays, a batch of documents at a time. Offsets count characters, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = "array<struct<text:string,label:string,start:int,end:int,confidence:double>>"
Span = tuple[str, str, int, int, float]
# Characters that a sentence is found by; a longer one is compared once its beginning has been found.
GRAM = 32
# Characters times sentences up to which every sentence is simply looked for.
SEARCHED = 1 << 20


def _spans(rows: list[list[Span] | None]) -> pa.Array:
    """A list array of spans; None is a null list."""
    flat = [s for r in rows if r for s in r]
    text, label, start, end, sure = zip(*flat, strict=True) if flat else ((), (), (), (), ())
    structs = pa.StructArray.from_arrays(
        [pa.array(text, pa.string()), pa.array(label, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(sure, pa.float64())],
        names=["text", "label", "start", "end", "confidence"],
    )
    at = np.cumsum([0, *(len(r or ()) for r in rows)])
    null = pa.array([r is None for r in rows], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), structs, mask=null if len(rows) else None)


def matches(text: str, patterns: Iterable[tuple[str, re.Pattern]]) -> list[Span]:
    return [(m.group(), label, m.start(), m.end(), 1.0) for label, p in patterns for m in p.finditer(text)]


def resolved(spans: list[Span]) -> list[Span]:
    """The surer, then longer, of overlapping spans, by start.

    Spans come by (start, longest first, place), each held against the first kept span it overlaps. Starts never
    fall, so a kept span that ends at or before one start is behind all that follow: one finger moves over the kept ones.
    """
    kept: list[Span] = []
    finger = 0
    for s in sorted(spans, key=lambda s: (s[2], s[2] - s[3])):
        while finger < len(kept) and kept[finger][3] <= s[2]:
            finger += 1
        if finger == len(kept) or s[3] <= s[2]:
            kept.append(s)
            continue
        rival = kept[finger]
        if s[4] > rival[4] or (s[4] == rival[4] and s[3] - s[2] > rival[3] - rival[2]):
            kept[finger] = s
    return sorted(kept, key=lambda s: s[2])


def merged(text: str, tokens: list[tuple[str, str, int, int, float]], names: dict[str, str]) -> list[Span]:
    """Token predictions (word, entity, start, end, score) joined to spans with their mean score."""
    out: list[list] = []
    is_open = False
    for word, entity, start, end, score in tokens:
        if entity == "O":
            is_open = False
            continue
        parts = entity.split("-")
        tag = parts[1] if len(parts) > 1 else entity
        label = names.get(tag, tag)
        extends = False
        if is_open:
            last = out[-1]
            touching = start == last[2] or (start == last[2] + 1 and text[last[2] : last[2] + 1] == " ")
            extends = word.startswith("##") or (parts[0] == "I" and touching and label == last[0])
        if extends:
            out[-1][2:] = [end, out[-1][3] + score, out[-1][4] + 1]
        else:
            out.append([label, start, end, score, 1])
        is_open = True
    return [(text[max(s, 0) : e], label, s, e, total / n) for label, s, e, total, n in out]


def pattern_spans(patterns: dict[str, str]):
    """Arrow UDF: text to the spans of all patterns, pattern by pattern; a null text has null."""
    compiled = [(label, re.compile(p)) for label, p in patterns.items()]

    @F.arrow_udf(SPAN)
    def find(text: pa.Array) -> pa.Array:
        return _spans([None if t is None else matches(t, compiled) for t in text.to_pylist()])

    # Its result is exploded; marked so, it runs once instead of again in an inferred filter.
    return find.asNondeterministic()


def _span_rows(spans: pa.Array) -> list[list[Span] | None]:
    flat = spans.flatten()
    columns = [flat.field(i).to_pylist() for i in range(5)]
    flat_rows = list(zip(*columns, strict=True))
    at = spans.offsets.to_numpy() - spans.offsets[0].as_py() if len(spans) else []
    valid = spans.is_valid().to_pylist()
    return [flat_rows[a:b] if v else None for a, b, v in zip(at[:-1], at[1:], valid, strict=True)]


def resolve_spans():
    """Arrow UDF: spans to those that remain of overlapping ones."""

    @F.arrow_udf(SPAN)
    def resolve(spans: pa.Array) -> pa.Array:
        return _spans([None if r is None else resolved(r) for r in _span_rows(spans)])

    return resolve.asNondeterministic()


def _token_rows(tokens: pa.Array) -> list[list[tuple]]:
    flat = tokens.flatten()
    fields = [flat.field(flat.type.get_field_index(n)).to_pylist() for n in ("word", "entity", "start", "end", "score")]
    rows = list(zip(*fields, strict=True))
    at = tokens.offsets.to_numpy() - tokens.offsets[0].as_py() if len(tokens) else []
    return [rows[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def token_spans(names: dict[str, str]):
    """Arrow UDF: text and its token predictions to spans; a null of either has null."""

    @F.arrow_udf(SPAN)
    def merge(text: pa.Array, tokens: pa.Array) -> pa.Array:
        rows = zip(text.to_pylist(), _token_rows(tokens), tokens.is_valid().to_pylist(), strict=True)
        return _spans([merged(t, k, names) if ok and t is not None else None for t, k, ok in rows])

    return merge.asNondeterministic()


def all_spans(patterns: dict[str, str], names: dict[str, str], with_tokens: bool, numeric: frozenset[str] = frozenset()):
    """Arrow UDF: text, and its token predictions if any, to the resolved spans; an empty or blank text has none.

    ``numeric``: patterns of which every match holds a digit, so that a text without one isn't searched for them.
    """
    compiled = [(label, re.compile(p)) for label, p in patterns.items()]
    wordy = [(label, p) for label, p in compiled if p.pattern not in numeric]
    digit = re.compile(r"\d")

    def one(text: str | None, tokens: list[tuple]) -> list[Span]:
        if not text or not text.strip():
            return []
        return resolved([*merged(text, tokens, names), *matches(text, compiled if digit.search(text) else wordy)])

    if with_tokens:

        @F.arrow_udf(SPAN)
        def found(text: pa.Array, tokens: pa.Array) -> pa.Array:
            return _spans([one(t, k) for t, k in zip(text.to_pylist(), _token_rows(tokens), strict=True)])
    else:

        @F.arrow_udf(SPAN)
        def found(text: pa.Array) -> pa.Array:
            return _spans([one(t, []) for t in text.to_pylist()])

    return found.asNondeterministic()


def first_places(text: str, parts: list[str | None]) -> list[int | None]:
    """Where every part occurs first in the text, -1 where it doesn't.

    Beginnings of up to ``GRAM`` characters are hashed at every place of the text, one length after another, and only
    places whose hash is wanted are compared; parts of one text are looked up once.
    """
    known: dict[str, int] = {"": 0}
    by_length: dict[int, list[str]] = {}
    for p in {p for p in parts if p}:
        by_length.setdefault(min(len(p), GRAM), []).append(p)
    if len(text) * sum(map(len, by_length.values())) < SEARCHED:
        known.update((p, text.find(p)) for ps in by_length.values() for p in ps)
        return [None if p is None else known[p] for p in parts]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(by_length) + 1):
        h = h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        wanted = by_length.get(n)
        if not wanted or not len(h):
            known.update((p, -1) for p in wanted or ())
            continue
        keys = np.zeros(len(wanted), np.uint64)
        for i in range(n):
            keys = keys * np.uint64(0x9E3779B97F4A7C15) + np.array([ord(p[i]) for p in wanted], np.uint64)
        at = np.flatnonzero(np.isin(h, keys))
        order = np.argsort(h[at], kind="stable")
        at, sorted_h = at[order], h[at][order]
        lo, hi = np.searchsorted(sorted_h, keys), np.searchsorted(sorted_h, keys, "right")
        for p, a, b in zip(wanted, lo, hi, strict=True):
            known[p] = next((int(x) for x in at[a:b] if text.startswith(p, int(x))), -1)
    return [None if p is None else known[p] for p in parts]


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def places(text: pa.Array, parts: pa.Array) -> pa.Array:
    """Arrow UDF of ``first_places``: a text and its parts; a null of either has null."""
    rows = ((t.as_py(), p.as_py()) for t, p in zip(text, parts, strict=True))  # one document's strings at a time
    return pa.array([None if t is None or p is None else first_places(t, p) for t, p in rows], pa.list_(pa.int32()))


places = places.asNondeterministic()
