"""Entities, personal data and layout tokens. A document's spans live in its own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import spans
from docspark.functions import text as tx
from docspark.functions.bind import let
from docspark.functions.spans import SPAN  # noqa: F401

# Entity patterns in label order. Every match of them holds a digit.
ENTITY_PATTERNS = {
    "CONTRACT_ID": r"\bCON-\d{6}-\d{2}\b",
    "INVOICE_NO": r"\bINV-\d{6,8}\b",
    "MONEY": r"\$\d+(?:\.\d{2})?|\b\d+(?:\.\d{2})?\s?(?:USD|EUR|GBP|dollars|cents)\b",
    "DATE": r"\b\d{4}-\d{2}-\d{2}\b|\b\d{2}/\d{2}/\d{4}\b|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s\d{1,2},?\s\d{4}\b",
}
# Personal-data patterns in redaction order.
PII_PATTERNS = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "PHONE": r"\b(?:\+?\d{1,3}[-. ]?)?\(?\d{3}\)?[-. ]?\d{3}[-. ]?\d{4}\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CREDIT_CARD": r"\b(?:\d{4}[- ]?){3}\d{4}\b",
    "PASSPORT": r"\b[A-Z0-9]{9}\b",
}
# Names of model labels.
LABEL_NAMES = {"PER": "PERSON", "ORG": "ORG", "LOC": "LOCATION"}
TABLE_CONFIDENCE, TEXT_CONFIDENCE, EMPTY_CONFIDENCE = 0.88, 0.92, 0.5


def unicode_pattern(p: str) -> str:
    """Word boundaries and classes over all scripts."""
    return "(?U)" + p


def regex_spans(text: Column, label: str, pattern: str) -> Column:
    """Matches of one pattern with offsets, end exclusive (NER1)."""
    return spans.pattern_spans({label: pattern})(text)


def regex_entities(text: Column, patterns: dict[str, str] | None = None) -> Column:
    """Spans of all patterns, in label order; custom patterns extend or replace (NER1, UDF2)."""
    return spans.pattern_spans({**ENTITY_PATTERNS, **(patterns or {})})(text)


def merge_tokens(text: Column, tokens: Column) -> Column:
    """Token predictions (word, entity, start, end, score) to spans with their mean score (NER2)."""
    found = spans.token_spans(LABEL_NAMES)(text, tokens)
    return F.transform(found, lambda s: s.withField("confidence", F.round(s["confidence"], 4)))


def resolve_overlaps(found: Column) -> Column:
    """Keep the surer, then longer, of overlapping spans; sorted by start (NER3).

    Each span, in (start, longest first) order, is held against the first kept span it overlaps.
    """
    return spans.resolve_spans()(found)


def extract_entities(text: Column, tokens: Column | None = None, patterns: dict[str, str] | None = None) -> Column:
    """Model spans, if given, and pattern spans, overlaps resolved, in one pass over the text (NER4)."""
    find = spans.all_spans({**ENTITY_PATTERNS, **(patterns or {})}, LABEL_NAMES, tokens is not None, frozenset(ENTITY_PATTERNS.values()))
    return find(text) if tokens is None else find(text, tokens)


def redact(text: Column) -> Column:
    """Personal data replaced pattern by pattern; later patterns see earlier results (PII1)."""
    for label, p in PII_PATTERNS.items():
        text = F.regexp_replace(text, unicode_pattern(p), f"[REDACTED_{label}]")
    return text


def violation(text: Column) -> Column:
    """First label found, NULL when clean (PII2)."""
    out = F.lit(None).cast("string")
    for label, p in reversed(PII_PATTERNS.items()):
        out = F.when(text.rlike(unicode_pattern(p)), F.lit(label)).otherwise(out)
    return out


def pii_counts(text: Column) -> dict[str, Column]:
    """Matches per label on the text as redacted so far (PII4)."""
    out = {}
    for label, p in PII_PATTERNS.items():
        out[label] = F.regexp_count(text, F.lit(unicode_pattern(p)))
        text = F.regexp_replace(text, unicode_pattern(p), f"[REDACTED_{label}]")
    return out


def redact_spans(text: Column, found: Column) -> Column:
    """Persons and locations replaced right to left on redacted text (PII3)."""
    target = F.filter(found, lambda s: s["label"].isin("PERSON", "LOCATION"))
    keyed = F.transform(target, lambda s: F.struct((-s["start"]).alias("k"), s.alias("s")))
    return F.aggregate(
        F.array_sort(keyed),
        text,
        lambda acc, k: F.concat(
            F.substring(acc, F.lit(1), k["s"]["start"]),
            F.lit("[REDACTED_"), k["s"]["label"], F.lit("]"),
            F.substring(acc, k["s"]["end"] + 1, F.char_length(acc)),
        ),
    )


def key_values(words: Column) -> Column:
    """(key, value) of words ending in a colon, the last key of a name winning (LAY1).

    A value is the next word, even if that is a key itself, and all words up to the next key.
    """
    return let(words, _key_values)


def _key_values(words: Column) -> Column:
    idx = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    colon = F.transform(F.filter(idx, lambda e: F.endswith(e["w"], F.lit(":"))), lambda e: e["i"])

    def pair(i: Column, stops: Column) -> Column:
        end = F.coalesce(F.get(F.filter(stops, lambda j: j > i + 1), F.lit(0)), F.size(words))
        word = F.get(words, i)
        name = F.replace(F.lower(F.substring(word, F.lit(1), F.char_length(word) - 1)), F.lit(" "), F.lit("_"))
        return F.struct(name.alias("key"), F.array_join(F.slice(words, i + 2, end - i - 1), " ").alias("value"))

    def pairs(stops: Column) -> Column:
        usable = F.filter(stops, lambda i: i + 1 < F.size(words))
        return F.transform(usable, lambda i: pair(i, stops))

    def last(found: Column) -> Column:
        rest = lambda n: F.slice(found, n + 2, F.size(found))
        return F.filter(found, lambda p, n: ~F.exists(rest(n), lambda q: q["key"] == p["key"]))

    return let(let(colon, pairs), last)


def layout_regions(tokens: Column) -> Column:
    """Table and text regions with their boxes from (word, box) tokens (LAY2)."""
    low = lambda t: F.lower(t["word"])
    is_table = lambda t: (
        F.contains(t["word"], F.lit("|")) | F.contains(t["word"], F.lit("\t"))
        | F.contains(low(t), F.lit("total")) | F.contains(low(t), F.lit("price"))
    )

    def region(part: Column, label: str, conf: float) -> Column:
        edge = lambda n, pick: pick(F.transform(part, lambda t: t["box"][n]))
        lo = lambda n: F.least(edge(n, F.array_min), F.lit(1000))
        hi = lambda n: F.greatest(edge(n, F.array_max), F.lit(0))
        return F.struct(
            F.array(lo(0), lo(1), hi(2), hi(3)).alias("bbox"), F.lit(label).alias("label"),
            F.lit(conf).alias("confidence"), F.array_join(F.transform(part, lambda t: t["word"]), " ").alias("text"),
        )

    table = F.filter(tokens, is_table)
    text = F.filter(tokens, lambda t: ~is_table(t))
    none = F.array(
        F.struct(
            F.array(F.lit(0), F.lit(0), F.lit(1000), F.lit(1000)).alias("bbox"), F.lit("text").alias("label"),
            F.lit(EMPTY_CONFIDENCE).alias("confidence"), F.lit("").alias("text"),
        )
    )
    t_reg, x_reg = region(table, "table", TABLE_CONFIDENCE), region(text, "text", TEXT_CONFIDENCE)
    found = F.filter(
        F.array(F.when(F.size(table) > 0, t_reg), F.when(F.size(text) > 0, x_reg)), lambda r: r.isNotNull()
    )
    return F.when(F.size(tokens) == 0, none).otherwise(found)


def scale_box(box: list[Column], width: Column, height: Column) -> Column:
    """Pixel corners to the 0..1000 grid, truncated and clamped (LAY3)."""
    def one(v: Column, size: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(1000), (v * 1000 / size).cast("int")))

    return F.array(one(box[0], width), one(box[1], height), one(box[2], width), one(box[3], height))


def page_tokens(words: Column, width: Column, height: Column) -> Column:
    """(word, box) of the words read off a page, (text, left, top, width, height) in pixels; blank ones go (LAY3)."""
    read = F.filter(F.transform(words, lambda w: w.withField("text", tx.strip(w["text"]))), lambda w: w["text"] != "")

    def token(w: Column) -> Column:
        box = scale_box([w["left"], w["top"], w["left"] + w["width"], w["top"] + w["height"]], width, height)
        return F.struct(w["text"].alias("word"), box.alias("box"))

    return F.transform(read, token)


def structure(regions: Column) -> Column:
    """Markup of the regions in order (LAY4)."""
    def one(r: Column) -> Column:
        box = F.concat(F.lit("["), F.array_join(r["bbox"].cast("array<string>"), ","), F.lit("]"))
        body = F.when(r["text"] != "", F.concat(F.lit("    "), r["text"], F.lit("\n"))).otherwise("")
        return F.concat(
            F.lit("  <"), r["label"], F.lit(" bbox='"), box, F.lit("' confidence='"), r["confidence"].cast("string"),
            F.lit("'>\n"), body, F.lit("  </"), r["label"], F.lit(">\n"),
        )

    return F.concat(F.lit("<document>\n"), F.array_join(F.transform(regions, one), ""), F.lit("</document>"))
