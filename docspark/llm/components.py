"""Connected components by alternating star steps on edge tables; a node's label is the least id reachable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.tables import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v) pairs: neighbours are hung on the least id near them."""
    if large:
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = near.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node that isn't the least of its component, with that least id. Edges are (u, v) longs.

    The rounds grow with the logarithm of the number of nodes; each is written to the shared folder. Loops
    and repeated edges do no harm; no edges give no rows.
    """
    now = written(edges.where(F.col("u") != F.col("v")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or state["n"] == 0:
            return now
        before = state
        # Each step reads its edges twice, so steps kept in one plan would double it every time.
        for large in (True, False):
            now = written(_star(now, large), "edges")
