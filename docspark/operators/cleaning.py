"""Text cleaning over tables of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import text as tx
from docspark.functions.bind import let

BOILERPLATE_SHARE = 0.8
MIN_PAGES = 3
MIN_LINE = 4


def pages(c: Column) -> Column:
    """Page texts that hold something, in order."""
    return F.filter(F.split(c, tx.PAGE_MARK + r"\n?"), lambda p: ~tx.is_blank(p))


def page_lines(c: Column) -> Column:
    """Stripped non-empty lines of every page."""
    lines = lambda p: F.filter(F.transform(F.split(p, "\n"), tx.strip), lambda s: s != "")
    return F.transform(pages(c), lines)


def boilerplate(c: Column, share: float = BOILERPLATE_SHARE) -> Column:
    """Lines of a text found on more than ``share`` of its pages (CLN3).

    One document is one row, so the count runs inside the row: lines are made distinct per page,
    and sorted runs of equal lines are as long as the pages holding them.
    """
    return let(page_lines(c), lambda per_page: repeated_lines(per_page, share))


def repeated_lines(per_page: Column, share: float) -> Column:
    flat = F.filter(F.flatten(F.transform(per_page, F.array_distinct)), lambda s: F.char_length(s) >= MIN_LINE)
    need = F.floor(F.size(per_page) * share).cast("int") + 1
    # After sorting, a line that occurs ``need`` times equals the one ``need - 1`` places on.
    hits = let(F.array_sort(flat), lambda o: let(need, lambda k: F.filter(o, lambda s, i: F.get(o, i + k - 1) == s)))
    return F.when(F.size(per_page) >= MIN_PAGES, F.array_distinct(hits)).otherwise(F.array().cast("array<string>"))


def without_boilerplate(text: Column, share: float = BOILERPLATE_SHARE) -> Column:
    """The text without boilerplate lines, or as it is when there are none (CLN3)."""
    marks = F.regexp_extract_all(text, F.lit(f"({tx.PAGE_MARK}\\n?)"), F.lit(1))

    def without(lines: Column, bad: Column) -> Column:
        pages_left = F.transform(lines, lambda ls: F.array_join(F.filter(ls, lambda s: ~F.array_contains(bad, s)), "\n"))
        return let(pages_left, lambda p: let(marks, lambda m: rejoin(m, p)))

    def rejoin(m: Column, p: Column) -> Column:
        marked = F.zip_with(m, p, lambda a, b: F.concat(a, b))
        return F.array_join(F.when(F.size(m) == F.size(p), marked).otherwise(p), "\n\n")

    return let(
        page_lines(text),
        lambda lines: let(
            repeated_lines(lines, share), lambda bad: F.when(F.size(bad) == 0, text).otherwise(without(lines, bad))
        ),
    )


def remove_boilerplate(df: DataFrame, text: str, out: str, share: float = BOILERPLATE_SHARE) -> DataFrame:
    """Adds ``out``: the text without boilerplate lines, or unchanged when there are none (CLN3)."""
    # Fewer marks leave fewer pages than a repeated line needs, so the text stands without its lines being made.
    paged = F.regexp_count(text, F.lit(tx.PAGE_MARK)) >= MIN_PAGES - 1
    return df.withColumn(out, F.when(paged, without_boilerplate(F.col(text), share)).otherwise(F.col(text)))


def clean(df: DataFrame, text: str, out: str = "clean_text") -> DataFrame:
    """NFKC, control characters, boilerplate, white space, in this order (CLN1-4, CLN6); only texts of several pages are read again."""
    made = df.withColumn("_c", tx.plain(MIN_PAGES - 1)(F.coalesce(text, F.lit("")))).withColumns({"_n": F.col("_c.text"), "_p": F.col("_c.paged")})
    paged = tx.collapse_whitespace(without_boilerplate(F.col("_n")))
    return made.withColumn(out, F.when(F.col("_p"), paged).otherwise(F.col("_n"))).drop("_c", "_n", "_p")
