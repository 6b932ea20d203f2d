"""Embeddings, vector tables and search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions import vectors as vx
from docspark.operators import blocks
from docspark.sources import log

QUERY_PREFIX = "Represent this sentence: "


def encode(df: DataFrame, text: Column, dim: int = 64, out: str = "embedding") -> DataFrame:
    """Default encoder: signed token hashing to unit vectors (EMB1, EMB3)."""
    return df.withColumn(out, vx.hash_embed_text(dim)(F.lower(text)))


def encode_queries(df: DataFrame, text: Column, dim: int = 64, out: str = "embedding") -> DataFrame:
    """Queries get the instruction prefix before encoding (EMB2)."""
    return encode(df, F.concat(F.lit(QUERY_PREFIX), text), dim, out)


def embed_with_cache(
    chunks: DataFrame, cache: DataFrame, now: Column, encoder=encode, ttl_seconds: int = 86_400
) -> tuple[DataFrame, DataFrame]:
    """Vectors for (chunk_id, text), encoding each text missing from the unexpired cache once.

    ``cache`` holds (text_key, embedding, expires_at). Returns (chunk_id, text_key, from_cache,
    embedding) and the rows to append to the cache. The cache is keyed by text, so a text shared
    by a third of all chunks is encoded and stored once, and joined back as one row.
    """
    keyed = chunks.select("chunk_id", "text", F.sha2("text", 256).alias("text_key"))
    live = (
        cache.where(F.col("expires_at") > now)
        .groupBy("text_key")
        .agg(F.max_by("embedding", "expires_at").alias("embedding"))
    )
    # Keys alone are compared with the cache; then one row of each missing key brings its text.
    unseen = keyed.groupBy("text_key").agg(F.min("chunk_id").alias("chunk_id")).join(live, "text_key", "left_anti")
    texts = keyed.join(unseen, ["chunk_id", "text_key"], "left_semi").dropDuplicates(["text_key"])
    missing = encoder(texts.select("text_key", "text"), F.col("text"))
    fresh = missing.select("text_key", "embedding")
    vectors = live.select("text_key", "embedding", F.lit(True).alias("from_cache")).unionByName(
        fresh.select("text_key", "embedding", F.lit(False).alias("from_cache"))
    )
    out = keyed.select("chunk_id", "text_key").join(vectors, "text_key")
    append = fresh.withColumn("expires_at", now + F.make_dt_interval(secs=F.lit(ttl_seconds)))
    return out.select("chunk_id", "text_key", "from_cache", "embedding"), append


def mean_pool(df: DataFrame, by: list[str], vec: str = "embedding") -> DataFrame:
    """Mean of the vectors per group, unit length (EMB5).

    Each dimension is its own average, so groups of any size combine map-side; nothing is
    collected per group beyond one number per dimension.
    """
    per_dim = df.select(*by, F.posexplode(vec).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("x"))
    packed = per_dim.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return packed.select(*by, vx.l2_normalize(F.transform("v", lambda e: e["x"])).alias(vec))


def upsert(store: DataFrame, updates: DataFrame) -> DataFrame:
    """Replace by chunk_id, the update winning; vectors unit length, metadata defaulted (VEC1)."""
    prepared = updates.select(
        "chunk_id",
        "doc_id",
        "text",
        F.coalesce("source_type", F.lit("default")).alias("source_type"),
        F.coalesce("language", F.lit("en")).alias("language"),
        F.coalesce("doc_type_signal", F.lit("other")).alias("doc_type_signal"),
        vx.l2_normalize(F.col("embedding")).alias("embedding"),
    )
    both = store.select(*prepared.columns, F.lit(0).alias("generation")).unionByName(
        prepared.withColumn("generation", F.lit(1))
    )
    fields = [c for c in prepared.columns if c != "chunk_id"]
    latest = both.groupBy("chunk_id").agg(F.max_by(F.struct(*fields), "generation").alias("r"))
    return latest.select("chunk_id", "r.*")


def with_filters(df: DataFrame, filters: dict[str, object], metadata: str | None = "metadata") -> DataFrame:
    """Equality filters on columns, then on the JSON metadata; an unknown key matches nothing."""
    for k, v in filters.items():
        if k in df.columns:
            df = df.where(F.col(k) == F.lit(v))
        elif metadata and metadata in df.columns:
            df = df.where(F.get_json_object(metadata, f"$.{k}") == F.lit(str(v)))
        else:
            df = df.where(F.lit(False))
    return df


def _ranked(candidates: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, filters: dict[str, object] | None = None) -> DataFrame:
    """Exact cosine search: (query_id, chunk_id, score, rank), rank from 1 (VEC2).

    ``vectors`` has (chunk_id, embedding, …), ``queries`` (query_id, embedding). Filters run
    before scoring and reach the scan. Each pack pair keeps its k best and ties, so the shuffle
    carries k rows per pack and query; scores are rounded before ranking to keep ties stable.
    """
    if filters:
        vectors = with_filters(vectors, filters)
    chunk_type = vectors.schema["chunk_id"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()

    def score(v: blocks.Columns, q: blocks.Columns) -> pa.RecordBatch:
        s = blocks.unit_rows(blocks.matrix(v["embedding"])) @ blocks.unit_rows(blocks.matrix(q["embedding"])).T
        # Those that rounding may tie with the k-th come along; few enough to be rounded alone.
        i, j = blocks.top_rows(s, k, 1e-8)
        return pa.RecordBatch.from_arrays(
            [q["query_id"].take(pa.array(j)), v["chunk_id"].take(pa.array(i)), pa.array(np.round(s[i, j], 9))],
            names=["query_id", "chunk_id", "score"],
        )

    found = blocks.block_join(
        vectors.select("chunk_id", "embedding"),
        queries.select("query_id", "embedding"),
        score,
        f"query_id {query_type}, chunk_id {chunk_type}, score double",
    )
    return _ranked(found, k)


# Vectors that the centres of cells are found from at most, and that are searched exactly to learn how many cells a
# search must open; those of least key hash.
CELL_SAMPLE, PROBE_SAMPLE = 65_536, 128
CENTRES = "cell int, centre array<double>, probes int"


def write_cells(
    vectors: DataFrame, path: str, cells: int | None = None, sample: int = CELL_SAMPLE, target: float = 0.95, nearest: int = 10, seed: int = 7
) -> None:
    """An inverted index on disk (VEC3): vectors in folders by the nearest centre, and the centres.

    Every vector is stored; centres, about the square root of the number of vectors, come from a k-means over a sample
    of at most ``sample`` of them. How many cells a search opens is measured: the fewest in which ``PROBE_SAMPLE``
    vectors find the ``target`` share of their ``nearest``. Folders of large cells hold several files, those of small
    ones one. Vectors null or empty are left out.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    known = vectors.where(F.size("embedding") > 0)
    n = known.count()
    cells = cells or max(1, round(n**0.5))
    train = known.select(vx.as_double(F.col("embedding")).alias("e"), F.xxhash64("chunk_id").alias("h"))
    if n > sample:
        # A share of the hashes that holds the sample and little more.
        train = train.where(F.col("h") / F.lit(2.0**64) + 0.5 <= 1.2 * sample / n).orderBy("h").limit(sample)
    centres = np.zeros((0, 1))
    if n:
        unit = train.select(array_to_vector(vx.l2_normalize(F.col("e"))).alias("features"))
        centres = np.vstack(KMeans(k=min(cells, n), seed=seed, maxIter=8, initMode="random").fit(unit).clusterCenters())
    placed = known.withColumn("cell", _nearest_cells(centres, 1)("embedding")[0])
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/vectors")
    asked = stored.select(F.col("chunk_id").alias("query_id"), "embedding", F.xxhash64("chunk_id").alias("h"))
    asked = asked.where(F.col("h") / F.lit(2.0**64) + 0.5 <= 2 * PROBE_SAMPLE / max(n, 1)).orderBy("h").limit(PROBE_SAMPLE)
    order = asked.select("query_id", _nearest_cells(centres, len(centres))("embedding").alias("order"))
    found = exact_topk(stored, asked, nearest).join(stored.select("chunk_id", "cell"), "chunk_id").join(order, "query_id")
    turns = found.groupBy(F.array_position("order", F.col("cell")).alias("turn")).agg(F.count("*").alias("n")).orderBy("turn").collect()
    total, probes, sofar = sum(r["n"] for r in turns), 1, 0
    for r in turns:
        probes, sofar = r["turn"], sofar + r["n"]
        if sofar >= target * total:
            break
    rows = [(i, c.tolist(), int(probes)) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, CENTRES).coalesce(1).write.parquet(f"{path}/centres")


def _nearest_cells(centres: np.ndarray, n: int):
    @F.pandas_udf("array<int>")
    def cells_of(v):
        import pandas as pd

        if not len(centres):
            return pd.Series([[]] * len(v))
        m = blocks.unit_rows(np.vstack(v.map(np.asarray).to_list()).astype(float))
        far = (centres**2).sum(1)[None, :] - 2 * m @ centres.T
        return pd.Series(list(np.argsort(far, axis=1, kind="stable")[:, :n].astype("int32")))

    return cells_of


def probed_cells(spark, path: str, queries: DataFrame, probes: int | None = None) -> DataFrame:
    """(query_id, embedding, cell): every query with the nearest cells, as many as the index asks for by default."""
    rows = spark.read.schema(CENTRES).parquet(f"{path}/centres").orderBy("cell").collect()
    centres = np.array([r["centre"] for r in rows])
    n = probes or (rows[0]["probes"] if rows else 1)
    found = queries.where(F.size("embedding") > 0)
    return found.select("query_id", "embedding", F.explode(_nearest_cells(centres, n)("embedding")).alias("cell"))


def opened(spark, path: str, schema, probed: DataFrame) -> DataFrame:
    """The stored vectors of probed cells: the cells are a filter on folders, so the others are not listed or read."""
    wanted = [r[0] for r in probed.select("cell").distinct().collect()]
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("cell", T.IntegerType())])).parquet(f"{path}/vectors").where(F.col("cell").isin(wanted))


def cell_topk(spark, path: str, schema, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """Approximate search of the index (VEC3): each query scans its nearest cells, by exact cosine.

    Cells are matched by an equi-join of packs, so a cell holding a third of all vectors is just more packs. ``schema`` is
    that of the indexed rows. Report recall against ``exact_topk``; this never replaces it silently.
    """
    q = probed_cells(spark, path, queries, probes)
    v = opened(spark, path, schema, q).select("chunk_id", "embedding", "cell")
    chunk_type = v.schema["chunk_id"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()

    def score(lv: blocks.Columns, rv: blocks.Columns) -> pa.RecordBatch:
        s = blocks.unit_rows(blocks.matrix(lv["embedding"])) @ blocks.unit_rows(blocks.matrix(rv["embedding"])).T
        s = np.round(s, 9)
        i, j = blocks.top_rows(s, k)
        return pa.RecordBatch.from_arrays(
            [rv["query_id"].take(pa.array(j)), lv["chunk_id"].take(pa.array(i)), pa.array(s[i, j])],
            names=["query_id", "chunk_id", "score"],
        )

    found = blocks.block_join(
        v, q, score, f"query_id {query_type}, chunk_id {chunk_type}, score double",
        key="cell", left_order=["chunk_id"], right_order=["query_id"],
    )
    return _ranked(found, k)


def recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    hits = exact.select("query_id", "chunk_id").join(
        approx.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left"
    )
    return hits.groupBy("query_id").agg(
        F.count("*").alias("expected"), F.count("hit").alias("found"), (F.count("hit") / F.count("*")).alias("recall")
    )


def namespace(vectors: DataFrame, value: str | None, column: str = "source_type", default: str = "default") -> DataFrame:
    """One namespace or tenant: a partition filter when the table is partitioned by it (VEC5)."""
    return vectors.where(F.col(column) == F.lit(value or default))


def delete_documents(vectors: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """All chunks of the listed documents go (VEC6)."""
    return vectors.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")


def stats(vectors: DataFrame, *by: str) -> DataFrame:
    """Row and document counts (VEC7)."""
    return vectors.groupBy(*by).agg(F.count("*").alias("total_vectors"), F.countDistinct("doc_id").alias("total_documents"))


def save_version(updates: DataFrame, root: str, replace: bool = False) -> int:
    """Updates of a stored vector table as a new version, upserted by chunk_id or in place of what was there (VEC8).

    Only the namespaces (source types) that the updates are of are written again.
    """
    return log.write_version(updates, root, "source_type", None if replace else _newer)


def _newer(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows by chunk_id, the new one winning."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    fields = [c for c in new.columns if c != "chunk_id"]
    return both.groupBy("chunk_id").agg(F.max_by(F.struct(*fields), "_turn").alias("r")).select("chunk_id", "r.*")


def load_version(spark, root: str, schema, version: int | None = None, as_of=None, tenant: str | None = None) -> DataFrame:
    """A version of a stored vector table, the newest by default; one tenant opens one folder (VEC5, VEC8)."""
    return log.read_version(spark, root, schema, version, as_of, None if tenant is None else [tenant])


class VectorStore:
    """One way into a stored vector table: exact, by cells, or mixed with keywords (VEC1-8).

    ``mode`` is ``exact``, ``cells`` or ``hybrid``. Writes make a version; searches see the newest one, and the cells
    that were built for it.
    """

    def __init__(self, spark, root: str, schema, mode: str = "exact"):
        if mode not in ("exact", "cells", "hybrid"):
            raise ValueError(f"unknown mode {mode}")
        self.spark, self.root, self.schema, self.mode = spark, root.rstrip("/"), schema, mode

    def upsert(self, updates: DataFrame) -> int:
        version = save_version(updates, f"{self.root}/rows")
        if self.mode == "cells":
            write_cells(self.rows(), self._cells(version))
        return version

    def delete(self, doc_ids: DataFrame) -> int:
        """A version without the documents' chunks; namespaces that hold none of them keep their folders."""
        rows, ids = self.rows(), doc_ids.select("doc_id").distinct()
        hit = [r[0] for r in rows.join(ids, "doc_id", "left_semi").select("source_type").distinct().collect()]
        left = delete_documents(rows.where(F.col("source_type").isin(hit)), ids)
        version = log.write_version(left, f"{self.root}/rows", "source_type", drop=hit)
        if self.mode == "cells":
            write_cells(self.rows(), self._cells(version))
        return version

    def rows(self, tenant: str | None = None) -> DataFrame:
        return load_version(self.spark, f"{self.root}/rows", self.schema, tenant=tenant)

    def _cells(self, version: int) -> str:
        return f"{self.root}/cells/{version:012d}"

    def search(self, queries: DataFrame, k: int, filters: dict[str, object] | None = None, tenant: str | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank); ``queries`` has query_id and embedding, and text for ``hybrid``.

        Filters and tenants are answered exactly, so that a filter never empties a probed cell.
        """
        if self.mode == "hybrid":
            from docspark.operators import retrieval

            rows = with_filters(self.rows(tenant), filters or {})
            return retrieval.hybrid_topk(rows, queries, k)
        if self.mode == "cells" and not filters and tenant is None:
            version = log.version_of(self.spark, f"{self.root}/rows")
            if version is not None:
                return cell_topk(self.spark, self._cells(version), self.schema, queries, k)
        return exact_topk(self.rows(tenant), queries, k, filters)

    def stats(self) -> DataFrame:
        return stats(self.rows(), "source_type")
