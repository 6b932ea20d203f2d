"""Text expressions. Character classes are explicit so they do not depend on engine defaults."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions.bind import let
from docspark.functions.slices import row_slices

# Unicode white space, as characters, as one character class, and its complement.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WS = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
NWS = r"[^\t-\r\x1c-\x1f\x{85}\p{Z}]"
CONTROL = r"[\x00-\x08\x0b-\x1f\x7f-\x{9f}\p{Cf}]"
INLINE_WS = r"[\x0b\x0c\x1c-\x1f\x{85}\p{Z}]"
SENTENCE_END = r"([.!?])" + WS + "+"
SENTENCE_GAP = r"(?<=[.!?])" + WS + "+"
PAGE_MARK = r"--- PAGE \d+ ---"
UNIT = "\x1f"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return ~c.rlike(NWS)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"{NWS}+"))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({NWS}+)"), F.lit(1))


def sentences(c: Column) -> Column:
    """Break after . ! or ? followed by white space; pieces are stripped and non-empty."""
    return F.filter(F.split(strip(c), SENTENCE_GAP), lambda s: s != "")


def sentence_count(c: Column) -> Column:
    """``size(sentences(c))`` without building the array."""
    s = strip(c)
    return F.when(s == "", 0).otherwise(F.regexp_count(s, F.lit(SENTENCE_END)) + 1)


@F.arrow_udf(T.StringType())
def nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The normal form of every text; runs of plain rows of a batch are passed on as they are."""
    for b in batches:
        for part in row_slices(b):
            if pc.all(pc.string_is_ascii(part), min_count=0).as_py():
                yield part
            else:
                yield pa.array((None if t is None else unicodedata.normalize("NFKC", t) for t in part.to_pylist()), part.type)


# Marked so, it keeps its own step in the plan: run once, and never nested below another UDF.
nfkc = nfkc.asNondeterministic()


# What ``CONTROL`` and ``INLINE_WS`` hold. Format characters are those of Java's tables (Unicode 13), Python's have newer ones.
_FORMAT = (
    "\xad\u0600-\u0605\u061c\u06dd\u070f\u08e2\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff\ufff9-\ufffb"
    "\U000110bd\U000110cd\U00013430-\U00013438\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0001\U000e0020-\U000e007f"
)
_CONTROLS = re.compile(f"[\x00-\x08\x0b-\x1f\x7f-\x9f{_FORMAT}]")
_ODD_SPACE = re.compile("[" + "".join(c for c in SPACES if c not in "\t\n\r ") + "]")
_INLINE_RUN = re.compile("[" + "".join(c for c in SPACES if c not in "\t\n\r") + "]+")
_PAGE_MARK = re.compile("--- PAGE [0-9]+ ---")
_ASCII_CONTROLS = bytes([*range(9), *range(11, 32), 127])


def _collapsed(t: str) -> str:
    """``collapse_whitespace`` of one text without control characters."""
    if not t.isascii() and _ODD_SPACE.search(t):
        t = _INLINE_RUN.sub(" ", t)
    elif "  " in t:
        t = re.sub("  +", " ", t)
    return (re.sub("\n{3,}", "\n\n", t) if "\n\n\n" in t else t).strip()


def _plain(t: str, marks: int) -> tuple[str, bool]:
    if t.isascii():
        t = t.encode().translate(None, _ASCII_CONTROLS).decode()
    else:
        t = _CONTROLS.sub("", unicodedata.normalize("NFKC", t))
    paged = t.count("--- PAGE ") >= marks and len(_PAGE_MARK.findall(t)) >= marks
    return (t, True) if paged else (_collapsed(t), False)


def plain(marks: int):
    """Arrow UDF: every text in its normal form and without control characters; ``paged`` where it has ``marks`` page marks or more.

    White space is collapsed as well, but not in paged texts, whose lines are to be compared before. It does in one
    reading what ``nfkc``, ``strip_controls`` and ``collapse_whitespace`` do one after another.
    """
    kind = T.StructType().add("text", "string").add("paged", "boolean")

    @F.arrow_udf(kind)
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            for part in row_slices(b):
                rows = [(None, None) if t is None else _plain(t, marks) for t in part.to_pylist()]
                texts, paged = zip(*rows, strict=True) if rows else ((), ())
                yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(paged, pa.bool_())], names=["text", "paged"])

    return made.asNondeterministic()


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def collapse_whitespace(c: Column) -> Column:
    """Runs of white space inside a line become a space, more than two line breaks two, and none is left at the ends."""
    # A run that is one space already is no match, or every word would be one.
    one_space = F.regexp_replace(c, f"{INLINE_WS}(?:{INLINE_WS}+|(?<! ))", " ")
    return strip(F.regexp_replace(one_space, r"\n{3,}", "\n\n"))


def is_table(c: Column) -> Column:
    """A line with two tabs or three pipes; a text with neither character is not searched for lines."""
    return (F.contains(c, F.lit("\t")) | F.contains(c, F.lit("|"))) & c.rlike(r"\t[^\n\t]*\t|\|[^\n|]*\|[^\n|]*\|")


def alpha_ratio(c: Column) -> Column:
    n = F.char_length(c)
    # Dropping the runs between letters takes far fewer matches than counting letters one by one.
    return F.when(n == 0, F.lit(0.0)).otherwise(F.char_length(F.regexp_replace(c, r"\P{L}+", "")) / n)


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits, the unit of keyword search."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def ascii_words(c: Column) -> Column:
    """Words after dropping everything but ASCII letters, digits and white space, lower-cased."""
    return words(F.lower(F.regexp_replace(c, "[^a-zA-Z0-9\t-\r\x1c-\x1f\\x{85}\\p{Z}]", "")))


def syllables(c: Column) -> Column:
    """Syllables over all words: vowel groups, less a final e, at least one per word.

    Four pattern counts over the whole text replace a loop over words: words whose only vowel
    group ends in a final e, and words without any vowel, are raised to one.
    """
    cons = "[b-df-hj-np-tv-xz]"

    def total(t: Column) -> Column:
        n = lambda p: F.regexp_count(t, F.lit(p))
        groups, final_e = n("[aeiouy]+"), n("e(?![a-z])")
        return groups - final_e + n(f"(?<![a-z]){cons}+(?![a-z])") + n(f"(?<![a-z]){cons}*[aeiouy]*e(?![a-z])")

    return let(F.regexp_replace(F.lower(c), "[^a-z\t-\r\x1c-\x1f\\x{85}\\p{Z}]", ""), total)


def proper_nouns(c: Column) -> Column:
    """Capitalised words that neither open the text nor follow a word ending a sentence."""
    t = F.regexp_replace(strip(c), f"{WS}+", " ")
    return F.regexp_count(t, F.lit(r"(?<=[^.?! ] )\p{Lu}"))


def count_contained(c: Column, keywords: list[str]) -> Column:
    total = F.lit(0)
    for k in keywords:
        total = total + F.contains(c, F.lit(k)).cast("int")
    return total


def python_bool(c: Column) -> Column:
    return F.when(c, F.lit("True")).otherwise(F.lit("False"))


def python_float(c: Column) -> Column:
    """A rounded double as plain decimal text, at least one digit after the point."""
    return F.regexp_replace(c.cast("decimal(28,6)").cast("string"), r"(\.\d+?)0+$", "$1")
