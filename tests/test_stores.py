"""Logs of batches and versions, the ingest into them, and vector stores on them."""

import datetime
import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from docspark.operators import quality
from docspark.operators import vectors as vec
from docspark.sources import log
from docspark.streaming import ingest

ENVELOPE = "doc_id long, ingestion_ts timestamp, source_type string, source_uri string, raw_text string, raw_bytes binary, byte_size long, checksum string, language string, page_count int, metadata string"
ENGLISH = "The quarterly report shows that invoice INV-123456 was paid on 2024-01-05 for $99.50 and the rest follows. "
FRENCH = "Le rapport trimestriel montre que la facture a été payée et que le reste du montant suivra bientôt. "
DUTCH = "Het rapport laat zien dat de rekening is betaald en dat de rest van het bedrag spoedig zal volgen. "


def doc(i, text, uri=None, minute=None, language="en", checksum=None):
    raw = None if text is None else text.encode()
    when = datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i if minute is None else minute)
    sha = hashlib.sha256(raw or b"").hexdigest() if checksum is None else checksum
    return (i, when, "pdf", uri or f"s3://raw/{i}.pdf", text, raw and bytearray(raw), len(raw or b""), sha, language, None, "{}")


@pytest.fixture(scope="module")
def model(spark):
    rows = [(ENGLISH * 3, "en"), (FRENCH * 3, "fr"), (DUTCH * 3, "nl")]
    return quality.train_language_model(spark.createDataFrame(rows, "text string, lang string"))


def batches(spark):
    first = [
        doc(1, ENGLISH * 3), doc(2, ENGLISH * 3, "s3://raw/1.pdf", 9), doc(3, FRENCH * 3), doc(4, DUTCH * 3), doc(5, "short"), doc(6, None),
        doc(7, ENGLISH * 2, checksum="wrong"), doc(8, ENGLISH * 4, language="pt"),
    ]
    second = [doc(11, ENGLISH * 3, "s3://raw/1.pdf"), doc(12, ENGLISH * 5), doc(13, DUTCH * 3, "s3://raw/4.pdf"), doc(14, "1234 5678 | " * 20), doc(15, ENGLISH * 6, None, 20)]
    return spark.createDataFrame(first, ENVELOPE), spark.createDataFrame(second, ENVELOPE)


def held(spark, root):
    return sorted(tuple(r) for r in ingest.records(spark, root).collect())


def test_gate_order_and_keys_of_earlier_batches(spark, tmp_path, model):
    root = f"{tmp_path}/r"
    first, second = batches(spark)
    assert ingest.ingest_batch(first, root, 0, model) and ingest.ingest_batch(second, root, 1, model)
    got = held(spark, root)
    letters = {int(d): why for sink, d, why in got if sink == "letters"}
    assert letters == {
        4: "detected_language_not_allowed", 5: "text_too_short", 6: "missing_text", 7: "checksum_mismatch", 8: "language_not_allowed", 14: "low_alphabetic_ratio",
    }
    assert {(d, o) for sink, d, o in got if sink == "duplicates"} == {("2", "1"), ("11", "1"), ("13", "4")}  # a rejected text keeps its key
    assert {(d, v) for sink, d, v in got if sink == "documents"} == {("1", "en:false"), ("3", "fr:false"), ("12", "en:false"), ("15", "en:false")}
    events = [d for sink, d, _ in got if sink == "events"]
    assert sorted(events) == ["1", "12", "15", "3"]
    assert {d: v for sink, d, v in got if sink == "catalogue"}["4"] == "failed:detected_language_not_allowed"


def test_a_killed_batch_is_unseen_and_a_rerun_adds_nothing(spark, tmp_path, model):
    root = f"{tmp_path}/r"
    first, second = batches(spark)
    ingest.ingest_batch(first, root, 0, model)
    before = held(spark, root)

    def breaks(rows, text):
        return rows.withColumn("embedding", F.raise_error(F.lit("killed")).cast("array<double>"))

    with pytest.raises(Exception, match="killed"):
        ingest.ingest_batch(second, root, 1, model, breaks)
    assert held(spark, root) == before and not log.committed(spark, root, 1)
    assert ingest.ingest_batch(second, root, 1, model)
    after = held(spark, root)
    assert len(after) > len(before)
    assert not ingest.ingest_batch(second, root, 1, model) and not ingest.ingest_batch(first, root, 0, model)
    assert held(spark, root) == after
    counts = {r["name"]: r["row_count"] for r in log.manifests(spark, root).where("entry = 1").collect()}
    assert counts["duplicates"] == 2 and counts["letters"] == 1 and counts["documents"] == 2


def test_an_empty_batch(spark, tmp_path, model):
    root = f"{tmp_path}/r"
    none = spark.createDataFrame([], ENVELOPE)
    assert held(spark, root) == []
    assert ingest.ingest_batch(none, root, 0, model) and held(spark, root) == [] and log.committed(spark, root, 0)


def test_versions_are_read_replaced_and_rolled_back(spark, tmp_path):
    root, schema = f"{tmp_path}/v", "id long, space string, n long"
    assert log.read_version(spark, root, schema).count() == 0 and log.version_of(spark, root) is None
    log.write_version(spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, None, 1)], schema), root, "space", tag="v1.0.0-dev")
    time.sleep(1.1)
    between = datetime.datetime.now(datetime.timezone.utc).isoformat()
    folders = {r["name"]: r["folder"] for r in log.manifests(spark, root).collect()}
    time.sleep(1.1)
    log.write_version(spark.createDataFrame([(2, "b", 5), (4, "b", 5)], schema), root, "space")
    newest = {r["name"]: r["folder"] for r in log.manifests(spark, root).where("entry = 2").collect()}
    assert newest["a"] == folders["a"] and newest["default"] == folders["default"] and newest["b"] != folders["b"]

    def rows(**how):
        return sorted((r["id"], r["n"]) for r in log.read_version(spark, root, schema, **how).collect())

    assert rows() == [(1, 1), (2, 5), (3, 1), (4, 5)] and rows(version=1) == rows(version="v1.0.0-dev") == rows(as_of=between) == [(1, 1), (2, 1), (3, 1)]
    assert rows(namespaces=["b"]) == [(2, 5), (4, 5)]
    assert log.roll_back(spark, root, 1) == 3 and rows() == rows(version=1) and rows(version=2) == [(1, 1), (2, 5), (3, 1), (4, 5)]
    log.write_version(spark.createDataFrame([], schema), root, "space", drop=["a"])
    assert rows() == [(2, 1), (3, 1)]
    with pytest.raises(ValueError):
        log.read_version(spark, root, schema, version=9)
    tags = [log.tag_version(spark.createDataFrame([(1, "a", 1)], schema), root, "dev", "space", *want)[1] for want in ((), ("v3.1.0",), ())]
    assert tags == ["v1.0.1-dev", "v3.1.0-dev", "v3.1.1-dev"]
    assert log.versions(spark, root).count() == 7


def test_a_version_is_published_once(spark, tmp_path):
    root, df = f"{tmp_path}/v", spark.createDataFrame([(1, "a")], "id long, space string")
    log.write_version(df, root, "space")
    with pytest.raises(Exception):
        log._publish(spark, root, 1, None, [])
    assert log.versions(spark, root).count() == 1


def test_reports_are_there_once(spark, tmp_path):
    root = f"{tmp_path}/r"
    one = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "report_id string, score int")
    assert log.append_reports(one, root) == 0 and log.append_reports(one, root) is None
    assert log.append_reports(one.unionByName(spark.createDataFrame([("c", 3)], one.schema)), root) == 1
    assert sorted(tuple(r) for r in log.read_table(spark, root, "reports", one.schema).collect()) == [("a", 1), ("b", 2), ("c", 3)]


VECTORS = "chunk_id long, doc_id long, embedding array<double>, label string, source_type string, metadata string"


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors around forty middles, some null and empty ones, and one middle that holds a third."""
    rng = random.Random(3)
    middles = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    rows = []
    for i in range(3000):
        m = middles[0 if i % 3 == 0 else rng.randrange(40)]
        rows.append((i, i // 5, [x + rng.gauss(0, 0.25) for x in m], str(i % 7), rng.choice(["pdf", "api"]), "{}"))
    rows += [(9001, 1, None, None, "pdf", None), (9002, 1, [], None, "pdf", None)]
    return spark.createDataFrame(rows, VECTORS)


def test_cells_on_disk_are_pruned_and_find_enough(spark, tmp_path, clustered):
    path = f"{tmp_path}/cells"
    vec.write_cells(clustered, path)
    q = clustered.where("chunk_id % 97 = 0 AND chunk_id < 9000").select(F.col("chunk_id").alias("query_id"), "embedding")
    some = q.where("query_id < 500")
    opened = vec.opened(spark, path, clustered.schema, vec.probed_cells(spark, path, some))
    plan = opened._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert 0 < opened.count() < 3000 and spark.read.parquet(f"{path}/vectors").count() == 3000
    exact = vec.exact_topk(clustered.where(F.size("embedding") > 0), q, 10)
    share = vec.recall(vec.cell_topk(spark, path, clustered.schema, q, 10), exact).agg(F.avg("recall")).first()[0]
    probes = vec.probed_cells(spark, path, q).groupBy("query_id").count().first()["count"]
    assert share >= 0.9 and probes <= spark.read.parquet(f"{path}/centres").count() / 3


def test_cells_of_nothing(spark, tmp_path, clustered):
    path = f"{tmp_path}/cells"
    vec.write_cells(clustered.limit(0), path)
    q = clustered.limit(2).select(F.col("chunk_id").alias("query_id"), "embedding")
    assert vec.cell_topk(spark, path, clustered.schema, q, 3).count() == 0


@pytest.mark.parametrize("mode", ["exact", "cells"])
def test_a_store_upserts_deletes_and_searches(spark, tmp_path, clustered, mode):
    store = vec.VectorStore(spark, f"{tmp_path}/s", clustered.schema, mode)
    rows = clustered.where("chunk_id < 600")
    q = rows.where("chunk_id IN (3, 4)").select(F.col("chunk_id").alias("query_id"), "embedding")
    store.upsert(rows)
    assert {(r.query_id, r.chunk_id) for r in store.search(q, 1).collect()} == {(3, 3), (4, 4)}
    assert store.search(q, 5, {"source_type": "api"}).join(rows.where("source_type = 'pdf'"), "chunk_id").count() == 0
    assert store.search(q, 5, tenant="pdf").join(rows.where("source_type = 'api'"), "chunk_id").count() == 0
    store.delete(spark.createDataFrame([(0,)], "doc_id long"))
    assert store.rows().count() == 595 and {r.chunk_id for r in store.search(q, 3).collect()}.isdisjoint({0, 1, 2, 3, 4})
    store.upsert(rows.where("chunk_id = 3").withColumn("doc_id", F.lit(77).cast("long")))
    assert store.rows().where("chunk_id = 3").first()["doc_id"] == 77 and store.rows().count() == 596
    with pytest.raises(ValueError):
        vec.VectorStore(spark, f"{tmp_path}/s", clustered.schema, "other")
