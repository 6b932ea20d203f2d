"""Joining rows block by block: packs of rows meet on an equi-join and are scored as matrices.

A similarity search has no equality to join on. Instead of emitting row pairs, each side is
packed into rows that hold whole Arrow batches (bounded by ``arrow.maxRecordsPerBatch`` and
``arrow.maxBytesPerBatch``), the packs are joined, and a scorer cuts every pack pair to the few
rows it needs before anything is shuffled. A hot key simply has more packs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.session import cut_lineage

Columns = dict[str, pa.Array]
# A score matrix of one tile pair has at most 32 MB.
LEFT_TILE, RIGHT_TILE = 4096, 1024
# Packs of the right side that a column of the grid takes; left packs are dealt over its rows.
COLUMN_PACKS = 16


def pack(df: DataFrame, key: str | None = None, order: list[str] | None = None, prefix: str = "") -> DataFrame:
    """One row per Arrow batch, or per run of ``key`` in a batch, columns wrapped in arrays.

    With a key, rows are first range-partitioned by (key, order), so one hot key spreads over
    many partitions. Without one nothing is shuffled.
    """
    cols = [c for c in df.columns if c != key]
    if key is not None:
        by = [key, *(order or [])]
        df = df.where(F.col(key).isNotNull()).repartitionByRange(*by).sortWithinPartitions(*by)
    key_type = df.schema[key].dataType if key else T.IntegerType()
    schema = T.StructType(
        [T.StructField("pack_key", key_type)]
        + [T.StructField(prefix + c, T.ArrayType(df.schema[c].dataType)) for c in cols]
    )

    def wrap(batches):
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            if key is None:
                starts = [0]
                keys = pa.array([0], pa.int32())
            else:
                k = b.column(b.schema.get_field_index(key))
                seen = np.asarray(k.to_pandas())
                starts = [0, *(np.flatnonzero(seen[1:] != seen[:-1]) + 1)]
                keys = k.take(pa.array(starts))
            offsets = pa.array([*starts, n], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, b.column(b.schema.get_field_index(c))) for c in cols]
            yield pa.RecordBatch.from_arrays([keys, *lists], names=["pack_key", *(prefix + c for c in cols)])

    return df.mapInArrow(wrap, schema)


def block_join(
    left: DataFrame,
    right: DataFrame,
    score: Callable[[Columns, Columns], pa.RecordBatch | None],
    schema: str,
    key: str | None = None,
    left_order: list[str] | None = None,
    right_order: list[str] | None = None,
    left_salts: int = 64,
    few: bool = False,
) -> DataFrame:
    """Score every pack of ``left`` against every pack of ``right`` with the same key.

    Unkeyed, both sides are laid on a grid of cells: right packs over columns of ``COLUMN_PACKS``
    packs, left packs over ``left_salts`` rows. A cell is an ordinary equi-join partition, and
    adaptive execution broadcasts the right side where its measured bytes allow. That it does after the left
    side has been dealt, to one task if there is one cell; a right side that is ``few`` rows whatever the
    input is broadcast from the start and the left side stays where it is.
    """
    lp = pack(left, key, left_order, "l_")
    rp = pack(right, key, right_order, "r_")
    on = ["pack_key"]
    if few and key is None:
        rp = F.broadcast(rp)
    elif key is None:
        # Written down once: it is counted here and read by the join.
        rp = cut_lineage(rp)
        columns = math.ceil(max(1, rp.count()) / COLUMN_PACKS)
        rows = left_salts if columns > 1 else 1
        first_l, first_r = f"l_{left.columns[0]}", f"r_{right.columns[0]}"
        lp = lp.withColumn("cell_row", F.pmod(F.xxhash64(F.col(first_l)[0]), F.lit(rows)))
        lp = lp.withColumn("cell_col", F.explode(_upto(columns)))
        rp = rp.withColumn("cell_col", F.pmod(F.xxhash64(F.col(first_r)[0]), F.lit(columns)))
        rp = rp.withColumn("cell_row", F.explode(_upto(rows)))
        on = ["cell_row", "cell_col"]
    lcols = [c for c in left.columns if c != key]
    rcols = [c for c in right.columns if c != key]

    def run(batches):
        for b in batches:
            at = {name: i for i, name in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                lv = {c: b.column(at["l_" + c])[i].values for c in lcols}
                rv = {c: b.column(at["r_" + c])[i].values for c in rcols}
                for lt in _tiles(lv, LEFT_TILE):
                    for rt in _tiles(rv, RIGHT_TILE):
                        out = score(lt, rt)
                        if out is not None and out.num_rows:
                            yield out

    joined = lp.join(rp, on).select(*(f"l_{c}" for c in lcols), *(f"r_{c}" for c in rcols))
    return joined.mapInArrow(run, schema)


def _tiles(columns: Columns, rows: int):
    """Slices of the columns, without copies; a score matrix is never larger than two of them."""
    n = len(next(iter(columns.values())))
    for s in range(0, n, rows):
        yield {c: v.slice(s, rows) for c, v in columns.items()}


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def matrix(v: pa.Array) -> np.ndarray:
    """A list array of equal-length vectors as a float64 matrix."""
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(v), -1) if len(v) else flat.reshape(0, 0)


def unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def top_rows(scores: np.ndarray, k: int, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) positions holding each column's k best finite scores, and all within ``slack`` of the k-th.

    The k-th best of the maxima of runs of rows is at most the k-th best score, so one comparison with it leaves few to sort.
    """
    n = scores.shape[0]
    run = min(64, n // (4 * k))
    if run < 2:
        row, column = np.nonzero(np.isfinite(scores))
    else:
        runs = n // run
        best = np.fmax.reduce(scores[: runs * run].reshape(runs, run, -1), axis=1)
        best[np.isnan(best)] = -np.inf
        least = np.partition(best, runs - k, axis=0)[runs - k]
        row, column = np.nonzero(scores >= least - slack)
        fine = np.isfinite(scores[row, column])
        row, column = row[fine], column[fine]
    value = scores[row, column]
    order = np.lexsort((-value, column))
    first = np.searchsorted(column[order], np.arange(scores.shape[1]))
    last = np.searchsorted(column[order], np.arange(scores.shape[1]), "right")
    kth = np.full(scores.shape[1], -np.inf)
    full = last - first >= k
    kth[full] = value[order][first[full] + k - 1]
    keep = value >= kth[column] - slack
    return row[keep], column[keep]
