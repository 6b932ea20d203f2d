"""What a text holds, counted in one Arrow pass over its characters: words, sentences, syllables, letters, keywords.

The patterns of ``functions/text.py`` say the same one count at a time; each of them reads the text again, and makes an
object of every match. Here a slice of a batch is one array of code points, and a count is a sum over it.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions.slices import row_slices
from docspark.functions.text import SPACES

NAMES = ("chars", "dense", "letters", "words", "sentences", "propers", "syllables")
# What a character is: white, a letter, upper case, the end of a sentence, part of a token.
WHITE, LETTER, UPPER, END, TOKEN = 1, 2, 4, 8, 16
# What it is among the letters a to z after lower-casing, where all but these and white space is dropped.
DROPPED, BLANK, CONSONANT, VOWEL, E = 0, 1, 2, 3, 4


@functools.cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """The two kinds of every code point, made once in a worker."""
    kind, sound = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        category = unicodedata.category(chr(i))
        if category[0] == "L":
            kind[i] = LETTER | UPPER if category == "Lu" else LETTER
        if chr(i).isalnum():
            kind[i] |= TOKEN
    white = [ord(c) for c in SPACES]
    kind[white], sound[white] = WHITE, BLANK
    kind[[ord(c) for c in ".!?"]] = END
    for low in "abcdefghijklmnopqrstuvwxyz":
        sound[[ord(low), ord(low.upper())]] = E if low == "e" else VOWEL if low in "aiouy" else CONSONANT
    # The two others whose lower case has one of these letters: the Kelvin sign, and the capital i with a dot.
    sound[0x212A], sound[0x130] = CONSONANT, VOWEL
    return kind, sound


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts with a line break behind each, and where every text begins."""
    joined = "\n".join([*texts, ""])
    codes = np.frombuffer(joined.encode("latin-1"), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return codes, np.cumsum(sizes) - sizes


def _per_text(mask: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(mask, starts, dtype=np.int64)


def _between(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values`` that end before the places ``at``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(total[at])


def _syllables(sound: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Vowel groups less a final e, at least one, of every run of letters; what is no letter and not white is dropped."""
    kept = sound != DROPPED
    sizes = _per_text(kept, starts)
    s = sound[kept]
    vowel, letter = s >= VOWEL, s >= CONSONANT
    opens = vowel.copy()
    opens[1:] &= ~vowel[:-1]
    ends = np.flatnonzero(letter[:-1] & ~letter[1:])
    groups = np.diff(np.cumsum(opens, dtype=np.int32)[ends], prepend=0)
    heard = np.maximum(groups - (s[ends] == E), 1)
    return _between(heard, np.searchsorted(ends, np.concatenate([[0], np.cumsum(sizes)])))


def word_places(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of all texts in a row: code points, where texts begin, where words begin and end (their last character), how many words are
    before each text and in all, and which words end a sentence."""
    codes, starts = _codes(texts)
    kind = _kinds()[0][codes]
    white = (kind & WHITE) != 0
    # A text's line break ends its last word, so words never cross texts.
    ends = np.flatnonzero(~white[:-1] & white[1:])
    firsts = np.flatnonzero(np.concatenate([~white[:1], white[:-1] & ~white[1:]]))
    return codes, starts, firsts, ends, np.searchsorted(ends, np.append(starts, len(codes))), (kind[ends] & END) != 0


def token_runs(texts: list[str]) -> tuple[np.ndarray, pa.Array]:
    """How many tokens every lower-cased text has, runs of letters and digits, and the tokens of all texts in a row."""
    codes, starts = _codes(texts)
    inside = (_kinds()[0][codes] & TOKEN) != 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    kept, firsts = codes[inside], np.flatnonzero(opens[inside])
    if kept.dtype == np.uint8:
        data, at, end = kept.tobytes(), firsts, len(kept)
    else:
        data = kept.tobytes().decode("utf-32-le").encode()
        total = np.concatenate([[0], np.cumsum(1 + (kept >= 0x80) + (kept >= 0x800) + (kept >= 0x10000))])
        at, end = total[firsts], total[-1]
    offsets = np.append(at, end).astype(np.int32)
    lens = _per_text(opens, starts) if texts else np.zeros(0, np.int64)
    return lens, pa.StringArray.from_buffers(len(firsts), pa.py_buffer(offsets), pa.py_buffer(data))


def counted(texts: list[str]) -> dict[str, np.ndarray]:
    """The counts of every text, by name."""
    codes, starts = _codes(texts)
    bounds = np.append(starts, len(codes))
    kinds, sounds = _kinds()
    kind = kinds[codes]
    white = (kind & WHITE) != 0
    # A text's line break ends its last word, so words never cross texts.
    ends = np.flatnonzero(~white[:-1] & white[1:])
    firsts = np.flatnonzero(np.concatenate([~white[:1], white[:-1] & ~white[1:]]))
    of = np.searchsorted(ends, bounds)
    words = np.diff(of)
    full = (kind[ends] & END) != 0
    some = words > 0
    closed = np.zeros(len(texts), np.int64)
    closed[some] = full[of[1:][some] - 1]
    # A word in upper case after one that ends no sentence; the first word of a text follows none.
    named = (kind[firsts] & UPPER) != 0
    named[1:] &= ~full[:-1]
    named[of[:-1][some]] = False
    chars = np.diff(bounds) - 1
    return {
        "chars": chars,
        "dense": chars + 1 - _per_text(white, starts),
        "letters": _per_text((kind & LETTER) != 0, starts),
        "words": words,
        "sentences": np.where(some, _between(full, of) - closed + 1, 0),
        "propers": _between(named, of),
        "syllables": _syllables(sounds[codes], starts),
    }


def _struct_type(families: dict[str, list[str]]) -> T.StructType:
    return T.StructType([T.StructField(n, T.IntegerType()) for n in (*NAMES, *families)])


def _found(texts: list[str | None], families: dict[str, list[str]], low: list[str | None] | None = None) -> list[pa.Array]:
    """A column for each count; ``low`` are the lower-cased texts, if they are known."""
    have = counted([t or "" for t in texts]) if texts else {n: np.zeros(0) for n in NAMES}
    columns = [pa.array(have[n].astype(np.int32)) for n in NAMES]
    if low is None:
        low = [(t or "").lower() for t in texts] if families else []
    return columns + [pa.array([sum(k in t for k in words) if t else 0 for t in low], pa.int32()) for words in families.values()]


def text_counts(**families: list[str]):
    """Arrow UDF: the counts of every text, and how many keywords of each family its lower case holds; a null text has null."""
    kind = _struct_type(families)

    def found(texts: list[str | None]) -> pa.Array:
        return pa.StructArray.from_arrays(_found(texts, families), names=kind.names, mask=pa.array([t is None for t in texts], pa.bool_()))

    @F.arrow_udf(kind)
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            for part in row_slices(b):
                yield found(part.to_pylist())

    # Marked so, it keeps its own step in the plan and runs once for all that is made of it.
    return counts.asNondeterministic()


def text_reading(table, **families: list[str]):
    """Arrow UDF of a text and its lower case: its counts as ``text_counts`` has them, and its language and how likely that is.

    ``table`` tells languages (``quality.LanguageTable``); without one they are null. A null text has null.
    """
    kind = _struct_type(families).add("detected", "string").add("prob", "double")

    def read(texts: pa.Array, low: pa.Array) -> pa.Array:
        told = (pa.nulls(len(texts), pa.string()), pa.nulls(len(texts), pa.float64())) if table is None or not len(texts) else table.tell(low)
        columns = _found(texts.to_pylist(), families, low.to_pylist())
        return pa.StructArray.from_arrays([*columns, *told], names=kind.names, mask=texts.is_null())

    @F.arrow_udf(kind)
    def reading(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, low in batches:
            at = 0
            for part in row_slices(texts):
                yield read(part, low.slice(at, len(part)))
                at += len(part)

    return reading.asNondeterministic()
