"""Session settings and the shared folder used for checkpoints and written tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# What results and memory use rely on; all can be set on a running session.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def prepare(spark: SparkSession) -> None:
    """The settings above on a session made elsewhere."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    find_package(spark)


def get_spark(app: str = "docspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator relies on; size settings stay the caller's."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    find_package(spark)
    return spark


def find_package(spark: SparkSession) -> None:
    """Lets Python workers of a local run import this package from its folder.

    On a cluster ship it with ``--py-files`` instead.
    """
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
        if root not in paths:
            sc.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def keyed_state(spark: SparkSession) -> None:
    """The state store that keeps keyed states on disk, beside memory, for streams with states of their own."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path on any file system Spark reads is a folder; false where there is nothing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(at) and files.getFileStatus(at).isDirectory()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only for local runs."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is not None:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="docspark-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, unlike a local one."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
