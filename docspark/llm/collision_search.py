"""Nearest neighbours by query-aware collision counting.

Unit vectors are laid in blocks. A block's index is one sorted array for each of ``LINES`` random projections. A
query opens a window around its own place in every array and widens all of them round by round (virtual
rehashing: a radius grows, the index stays); a vector's collisions are the windows that hold it. Those with
``NEEDED`` collisions or more are verified by their cosine. At a round's radius a vector within that radius lies in
a window with a chance of 0.68, and misses ``NEEDED`` of ``LINES`` with one of about 0.01; the search of a block
ends when as many verified vectors as asked for lie within the radius, so nearer ones were seen too.

Every row is indexed. Blocks of rows are dealt to the rows of a grid, blocks of queries to its columns. A cell is one
partition: it takes the queries of its column first and keeps each one's best rows, then one block of rows after
another. Blocks meet in no join, so none is sent to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.tables import map_batches, release, written

LINES, NEEDED = 64, 34
# Half a window, in radii; radii of the rounds.
HALF = 1.0
RADII = 0.15 * 1.25 ** np.arange(13)
ROWS = 4096
# Queries whose places are looked up together; numbers of the queries of a column.
LOOKED_UP, COLUMN = 512, 1 << 22


def usable(v: Column) -> Column:
    """Vectors with components, all finite, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def blocks(rows: DataFrame) -> DataFrame:
    """Rows of (id, vector) as blocks of one length of vector: part and place in it, width, ids and values flat, of the vector's type."""
    number = T.FloatType() if isinstance(rows.schema["v"].dataType.elementType, T.FloatType) else T.DoubleType()
    kind = pa.float32() if isinstance(number, T.FloatType) else pa.float64()
    names = ["part", "at", "width", "ids", "values"]

    def make():
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0

        def step(b: pa.RecordBatch):
            nonlocal at
            lists = b.column(1)
            width = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind.to_pandas_dtype())
            begin = np.cumsum(width) - width
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for w in np.unique(width):
                mine = np.flatnonzero(width == w)
                for i in range(0, len(mine), ROWS):
                    m = mine[i : i + ROWS]
                    values = flat[(begin[m][:, None] + np.arange(w)).ravel()]
                    row = [[part], [at], [int(w)], [ids[m]], [values]]
                    yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1], pa.int64()), pa.array(row[2], pa.int32()), pa.array(row[3], pa.list_(pa.int64())), pa.array(row[4], pa.list_(kind))], names=names)
                    at += 1

        return step

    return map_batches(rows, f"part long, at long, width int, ids array<long>, values array<{number.simpleString()}>", make)


class Index:
    """The sorted projections of a block."""

    def __init__(self, ids: np.ndarray, m: np.ndarray):
        self.ids, self.m = ids, m
        self.size = np.sqrt((m * m).sum(axis=1))
        self.lines = np.random.default_rng(8).standard_normal((m.shape[1], LINES))
        placed = (m / self.size[:, None]) @ self.lines
        order = np.argsort(placed, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(placed.T, order, axis=1)
        self.rank = np.empty(order.shape, np.uint16)
        np.put_along_axis(self.rank, order, np.arange(len(ids), dtype=np.uint16)[None, :], axis=1)
        self._off, self._in = np.empty_like(self.rank), np.empty(self.rank.shape, bool)

    def windows(self, own: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows of queries at the places ``own`` begin in every array, and how many vectors they hold."""
        low, high = np.empty(own.shape, np.uint16), np.empty(own.shape, np.uint16)
        for line in range(LINES):
            low[:, line] = np.searchsorted(self.sorted[line], own[:, line] - HALF * radius, "left")
            high[:, line] = np.searchsorted(self.sorted[line], own[:, line] + HALF * radius, "right")
        return low[:, :, None], (high - low)[:, :, None]

    def hits(self, low: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Collisions of every vector with one query: the arrays in which its rank is in the window (below ``low`` it wraps around)."""
        np.subtract(self.rank, low, out=self._off)
        np.less(self._off, held, out=self._in)
        return np.add.reduce(self._in.view(np.uint8), axis=0, dtype=np.uint8)


def search(index: Index, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores, a row for each query, of its ``k`` best rows of a block; minus infinity where there are fewer.

    The search of a query ends at the first radius that has as many verified vectors within it as asked for. Windows
    only grow, so a round can't be that one if too few of what a later round verifies lie within its radius: the first
    round looked at is where most queries ended, and earlier ones only if they can be the end.
    """
    ids, n = index.ids, len(index.ids)
    sizes = np.sqrt((queries * queries).sum(axis=1))
    places = (queries / sizes[:, None]) @ index.lines
    out_ids, out_scores = np.zeros((len(queries), k), np.int64), np.full((len(queries), k), -np.inf)
    last = len(RADII)
    ended = np.bincount([last - 1], minlength=last)
    for start in range(0, len(queries), LOOKED_UP):
        own, known = places[start : start + LOOKED_UP], {}
        for q in range(len(own)):
            query, size = queries[start + q], sizes[start + q]
            fresh = ids != query_ids[start + q]
            cosine, done = np.full(n, -np.inf), np.zeros(n, bool)

            def verified(r, q=q, query=query, size=size, fresh=fresh, own=own, known=known, cosine=cosine, done=done):
                seen = fresh
                if r < last:
                    if r not in known:
                        known[r] = index.windows(own, RADII[r])
                    seen = fresh & (index.hits(known[r][0][q], known[r][1][q]) >= NEEDED)
                new = np.flatnonzero(seen & ~done)
                if 2 * len(new) > n:  # the block as it lies is read faster than most of its rows are gathered
                    np.divide(index.m @ query, index.size * size, out=cosine)
                    done[:] = True
                elif len(new):
                    cosine[new] = index.m[new] @ query / (index.size[new] * size)
                    done[new] = True
                return np.where(seen, cosine, -np.inf)

            def within(score, r):
                return r == last or np.count_nonzero(score >= 1 - RADII[r] ** 2 / 2) >= k

            end, low = (int(ended.argmax()) if np.count_nonzero(fresh) >= k else last), 0
            score = verified(end)
            while end < last and not within(score, end):
                low, end = end + 1, end + 1
                score = verified(end)
            if end < last:
                for r in range(low, end):
                    if within(score, r):
                        less = verified(r)
                        if within(less, r):
                            end, score = r, less
                            break
                ended[end] += 1
            seen = np.flatnonzero(score > -np.inf)
            if len(seen) > k:
                seen = seen[score[seen] >= np.partition(score[seen], -k)[-k] - 1e-9]
            exact = (index.m[seen] * query).sum(axis=1) / (index.size[seen] * size)
            best = np.lexsort((ids[seen], -exact))[:k]
            out_ids[start + q, : len(best)], out_scores[start + q, : len(best)] = ids[seen[best]], exact[best]
    return out_ids, out_scores


class Queries:
    """Queries of one width and the ``k`` best rows of each so far."""

    def __init__(self, width: int, k: int):
        self.width, self.k, self.parts = width, k, []

    def add(self, ids: np.ndarray, values: np.ndarray) -> None:
        self.parts.append((ids, values))

    def meet(self, ids: np.ndarray, values: np.ndarray) -> None:
        if self.parts:
            self.ids, self.values = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            self.parts = []
            self.best, self.score = np.zeros((len(self.ids), self.k), np.int64), np.full((len(self.ids), self.k), -np.inf)
        index = Index(ids, values.reshape(-1, self.width).astype(np.float64))
        for i in range(0, len(self.ids), ROWS):
            at = slice(i, i + ROWS)
            more, score = search(index, self.ids[at], self.values.reshape(-1, self.width)[at].astype(np.float64), self.k)
            more, score = np.hstack([self.best[at], more]), np.hstack([self.score[at], score])
            order = np.lexsort((more, -score), axis=1)[:, : self.k]
            self.best[at], self.score[at] = np.take_along_axis(more, order, axis=1), np.take_along_axis(score, order, axis=1)

    def rows(self):
        for i in range(0, 0 if self.parts else len(self.ids), ROWS):
            query, there = np.nonzero(self.score[i : i + ROWS] > -np.inf)
            columns = (self.ids[i + query], self.best[i + query, there], self.score[i + query, there])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["query_id", "vec_id", "score"])


def best_of_cell(batches, k: int):
    """Best rows of a cell's queries: of each width its blocks of queries come first, then its blocks of rows."""
    queries = None
    for b in batches:
        for i in range(b.num_rows):
            width, asks = (b.column(c)[i].as_py() for c in range(2))
            ids, values = (b.column(c)[i].values.to_numpy() for c in range(2, 4))
            if queries is None or queries.width != width:
                if queries is not None:
                    yield from queries.rows()
                queries = Queries(width, k) if asks else None
            if asks:
                queries.add(ids, values)
            elif queries is not None:
                queries.meet(ids, values)
    if queries is not None:
        yield from queries.rows()
    release()


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest found, ties to the smaller id.

    Both sides are (id, vector). Rows with the query's id are no candidates; of rows that repeat a query's id one is
    the query. A pair needs vectors of one length. Vectors that are null, empty, zero or hold a null or a
    non-finite component take no part, nor do null ids. Nothing usable gives no rows.
    """

    def side(df: DataFrame) -> DataFrame:
        a, b = df.columns
        return df.select(F.col(a).alias("id"), F.col(b).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))

    data = written(blocks(side(rows)), "vector-blocks")
    asked = written(blocks(side(queries).groupBy("id").agg(F.min("v").alias("v")).repartition(F.xxhash64("id"))), "query-blocks")
    (n_blocks, n_data, _, most), (n_asked_blocks, n_asked, numbers, most_asked) = (
        x.agg(F.count("at"), F.sum(F.size("ids")), F.sum(F.size("ids") * (F.col("width") + 2 * k).cast("long")), F.max("at")).first() for x in (data, asked)
    )
    # With so many columns and rows what is copied of either side takes as many bytes, and there are cells for all cores.
    cells = 2 * rows.sparkSession.sparkContext.defaultParallelism
    share = (n_asked or 1) / (n_data or 1)
    n_columns = max(1, min(n_asked_blocks, max(math.ceil((numbers or 1) / COLUMN), min(cells, math.ceil(math.sqrt(cells * share))))))
    n_rows = max(1, min(n_blocks, max(math.ceil(cells / n_columns), int(n_columns / share))))

    def dealt(most: int | None, n: int) -> Column:
        step = (most or 0) + 1
        while math.gcd(step, n) > 1:  # else blocks of one place in many parts could meet in few cells
            step += 1
        return F.pmod(F.col("part") * step + F.col("at"), F.lit(n))

    def copied(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    kinds = [x.schema["values"].dataType for x in (data, asked)]
    values = F.col("values").cast(kinds[0] if kinds[0] == kinds[1] else T.ArrayType(T.DoubleType()))
    left = data.withColumns({"values": values, "row": dealt(most, n_rows), "column": copied(n_columns), "asks": F.lit(False)})
    right = asked.withColumns({"values": values, "row": copied(n_rows), "column": dealt(most_asked, n_columns), "asks": F.lit(True)})
    cell = (F.col("row") * n_columns + F.col("column")).cast("int")
    met = left.unionByName(right).repartitionById(n_rows * n_columns, cell).sortWithinPartitions("width", F.desc("asks"), "part", "at")

    found = met.select("width", "asks", "ids", "values").mapInArrow(lambda b: best_of_cell(b, k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
