"""Quality rules from cross-document line frequency, in DataFrame expressions only.

Each non-blank line is normalised (lower case, white space runs as one blank) and hashed. The distinct
documents of a host that carry a line are counted; lines above the limits are removed, and a document of
which too little is left is rejected. Verdicts depend on (host, text) alone, so exact copies are one document:
a widely copied page doesn't condemn its own lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.bind import let
from docspark.llm.tables import written

BLANKS = " \t\n\x0b\x0c\r"
SPACE = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
# A line goes when at least ``MIN_DOCS`` of its host's distinct documents carry it, however large the host is; a document
# goes when fewer than ``MIN_WORDS`` words stay or over ``DEPLETED`` percent of them went.
MIN_DOCS, DEPLETED = 10, 70


def _words(c: Column) -> Column:
    return F.array_remove(F.split(c, SPACE), "")


def _repeated_words(words: Column) -> Column:
    """Words covered by ``WINDOW``-word windows that occur twice or more, by 64-bit window hashes."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        none = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(none, F.lit(0).cast("long")).otherwise(let(let(pairs, positions), total))

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))

    each = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(let(each, windows), covered))


def base_rules(text: Column) -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text; null is empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    return [
        let(_words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ]


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a text; null is empty."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2")]


KEY = ["k1", "k2"]


def frequent_lines(docs: DataFrame, text: str, host: str, min_docs: int) -> DataFrame:
    """(host, k1, k2, removed_words, lines) of the distinct texts with a line that ``min_docs`` documents of its host carry."""
    d = docs.select(F.col(host).alias("host"), *text_key(F.col(text)), F.coalesce(F.col(text), F.lit("")).alias("t"))
    copies = d.groupBy("host", *KEY).agg(F.count("*").alias("copies"))
    line = F.transform(F.split("t", "\n"), lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.size(_words(x)).alias("words")))
    rows = d.select("host", *KEY, F.explode(F.filter(line, lambda x: x["words"] > 0)).alias("l")).select("host", *KEY, "l.line", "l.words")
    # A text's lines of one hash have the same words; its copies multiply the count alike. Counted from and looked up in,
    # so lines are cut and hashed once.
    carried = written(rows.groupBy("host", "line", *KEY).agg(F.count("*").alias("n"), F.max("words").alias("words")), "lines")
    often = carried.groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("host", "line").alias("o")
    c = carried.alias("c")
    hit = c.join(often, F.col("c.host").eqNullSafe(F.col("o.host")) & (F.col("c.line") == F.col("o.line")))
    hit = hit.groupBy("c.host", *KEY).agg(F.sum(F.col("n") * F.col("words")).alias("removed"), F.collect_list("c.line").alias("lines"))
    hit, k = hit.alias("v"), copies.alias("k")
    same = F.col("v.host").eqNullSafe(F.col("k.host")) & (F.col("v.k1") == F.col("k.k1")) & (F.col("v.k2") == F.col("k.k2"))
    removed = (F.col("removed") / F.col("copies")).cast("long").alias("removed_words")
    return hit.join(k, same).select("v.host", "v.k1", "v.k2", removed, "v.lines")


def _judged(docs: DataFrame, text: str, host: str, min_docs: int, depleted: int) -> DataFrame:
    """Every row as a struct, with its rules' values, verdict and frequent lines."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(host).alias("host"), *text_key(F.col(text)), *base_rules(F.col(text)))
    found = frequent_lines(docs, text, host, min_docs)
    r, f = rows.alias("r"), found.alias("f")
    same = F.col("r.host").eqNullSafe(F.col("f.host")) & (F.col("r.k1") == F.col("f.k1")) & (F.col("r.k2") == F.col("f.k2"))
    n, repeat = F.col("r.w.n_words"), F.col("r.w.n_repeat_words")
    removed = F.coalesce(F.col("f.removed_words"), F.lit(0).cast("long"))
    failed = (n < MIN_WORDS) | (100 * repeat > 30 * n)
    gone = (removed > 0) & ((n - removed < MIN_WORDS) | (100 * removed > depleted * n))
    return r.join(f, same, "left").select(
        "r.row", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeat.alias("n_repeat_words"),
        failed.alias("base_failed"), removed.alias("removed_words"), F.col("f.lines").alias("removed_lines"), (~failed & ~gone).alias("kept"),
    )


def line_quality(
    docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None, min_docs: int = MIN_DOCS, depleted: int = DEPLETED
) -> DataFrame:
    """``keep`` columns and, for every row, the base rules, the line rule and the verdict.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, removed_words (in
    frequent lines), removed_lines (their hashes, null if none) and kept. A null text is empty and fails the
    base rules; a null host is a host of its own; equal rows get equal verdicts; no rows give no rows.
    Columns of other names, such as k1, may be present and are ignored unless kept.
    """
    keep = ["doc_id"] if keep is None else keep
    judged = _judged(docs, text, host, min_docs, depleted)
    return judged.select(*(F.col("row").getField(c).alias(c) for c in keep), *judged.columns[1:])


def cleaned(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, depleted: int = DEPLETED) -> DataFrame:
    """The kept rows with all their columns, their texts without the frequent lines."""
    kept = _judged(docs, text, host, min_docs, depleted).where("kept")
    shorter = without_lines(F.col("row").getField(text), F.col("removed_lines"))
    return kept.select(*((shorter if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns))


def without_lines(text: Column, lines: Column) -> Column:
    """``text`` without its lines whose hashes are in ``lines``; unchanged where that is null."""
    stay = F.filter(F.split(text, "\n"), lambda x: (F.length(F.translate(x, BLANKS, "")) == 0) | ~F.array_contains(lines, F.xxhash64(normalised(x))))
    return F.when(lines.isNull(), text).otherwise(F.array_join(stay, "\n"))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)),
hits AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words FROM hits GROUP BY doc_id),
raw_lines AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (
  SELECT doc_id, source, t, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
         lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS norm
  FROM raw_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM lines GROUP BY doc_id),
often AS (SELECT source, norm FROM lines GROUP BY source, norm HAVING count(DISTINCT t) >= 10),
gone AS (
  SELECT doc_id, sum(words)::BIGINT AS removed_words FROM lines l JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.norm = o.norm
  GROUP BY doc_id),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < 20 OR 100 * removed_words > 70 * n_words)) AS kept FROM v
"""
