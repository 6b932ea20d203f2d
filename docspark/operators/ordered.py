"""Running counts and exact order statistics without sorting a whole group in one task."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICES = 64


def running_counts(df: DataFrame, keys: list[str], x: str, counts: list[str]) -> DataFrame:
    """Per distinct (keys, x): each count, its running sum ``cum_*`` and its total ``all_*``.

    Equal values are combined first. Each key's value range is then cut at sketched quantiles; the
    slices' totals (at most ``SLICES`` + 1 rows per key) give the offsets, and only the rows of one
    slice are sorted together, so a key holding most rows spreads over that many tasks. The sketch
    decides balance only; the result is exact. AQE turns the joins with cuts and offsets into
    broadcasts when they come out small.
    """
    per_value = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(*(F.sum(c).alias(c) for c in counts))
    marks = F.array(*(F.lit(i / SLICES) for i in range(1, SLICES)))
    cuts = per_value.groupBy(*keys).agg(F.percentile_approx(x, marks, 1000).alias("_cuts"))
    if keys:
        sliced = per_value.join(cuts, keys)
    else:
        sliced = per_value.withColumn("_cuts", F.lit(cuts.scalar()))
    sliced = sliced.withColumn("_slice", F.size(F.filter("_cuts", lambda b: b < F.col(x)))).drop("_cuts")
    parts = sliced.groupBy(*keys, "_slice").agg(*(F.sum(c).alias(f"_p_{c}") for c in counts))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    parts = parts.select(
        *keys, "_slice",
        *(F.coalesce(F.sum(f"_p_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in counts),
        *(F.sum(f"_p_{c}").over(whole).alias(f"all_{c}") for c in counts),
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    joined = sliced.join(parts, [*keys, "_slice"])
    return joined.select(
        *keys, x, *counts,
        *((F.sum(c).over(inside) + F.col(f"_b_{c}")).alias(f"cum_{c}") for c in counts),
        *(f"all_{c}" for c in counts),
    )


def percentiles(df: DataFrame, keys: list[str], columns: dict[str, dict[str, float]]) -> DataFrame:
    """Linear-interpolated percentiles per key: ``{column: {output name: p}}``.

    The built-in exact percentile holds every distinct value of a group in one task; this picks
    the two neighbouring order statistics from running counts instead.
    """
    rows = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in columns))).alias("_e"))
    flat = rows.select(*keys, F.col("_e.c").alias("_c"), F.col("_e.x").alias("_x"), F.lit(1).alias("_n"))
    run = running_counts(flat, [*keys, "_c"], "_x", ["_n"])
    aggs = []
    for c, wanted in columns.items():
        for name, p in wanted.items():
            h = F.when(F.col("_c") == c, (F.col("all__n") - 1) * F.lit(p))
            for side, at in (("lo", F.floor(h)), ("hi", F.ceil(h))):
                aggs.append(F.min(F.when(F.col("cum__n") > at, F.col("_x"))).alias(f"{name}_{side}"))
            aggs.append(F.max(h - F.floor(h)).alias(f"{name}_f"))
    got = run.groupBy(*keys).agg(*aggs)
    between = lambda n: F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_f")
    return got.select(*keys, *(between(n).alias(n) for wanted in columns.values() for n in wanted))


def counted_percentile(counts: DataFrame, keys: list[str], value: str, n: str, p: Decimal, out: str) -> DataFrame:
    """The least value that a share ``p`` of a key's rows doesn't exceed, from rows counted by value.

    Null values don't count; a key with no others has null.
    """
    # As one struct, so that a null among the keys is a key like any other in the joins.
    flat = counts.select(F.struct(*keys).alias("_k"), F.col(value).alias("_x"), F.col(n).alias("_n"))
    run = running_counts(flat, ["_k"], "_x", ["_n"])
    reached = F.col("cum__n") >= F.ceil(F.col("all__n") * F.lit(p))
    picked = run.groupBy("_k").agg(F.min(F.when(reached, F.col("_x"))).alias(out))
    return flat.select("_k").distinct().join(picked, "_k", "left").select("_k.*", out)
