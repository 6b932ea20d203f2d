"""Tables as logs of written folders: several sinks that appear together, and versions of a store.

Data goes to fresh folders first; a manifest, one small file that names them, is written last. Readers follow
manifests, so what a killed attempt left behind is never read, and a manifest that is there already makes a
retry do nothing. Folders are never changed: a version is a choice of folders, an older one stays readable and rolling
back is writing the old choice again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.session import is_folder
from docspark.sources import documents

MANIFEST = (
    T.StructType().add("entry", "long").add("parent", "long").add("name", "string").add("folder", "string").add("row_count", "long").add("tag", "string")
    .add("written_at", "timestamp")
)


def _at(root: str, entry: int) -> str:
    return f"{root.rstrip('/')}/manifests/{entry:012d}"


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """One row per entry and name (a table or a namespace), entries without any folder included."""
    if not is_folder(spark, f"{root.rstrip('/')}/manifests"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{root.rstrip('/')}/manifests")


def _publish(spark: SparkSession, root: str, entry: int, parent: int | None, rows: list[tuple], tag: str | None = None) -> None:
    """The manifest as one file; fails where another writer has been first."""
    made = spark.createDataFrame([(entry, parent, *r, tag) for r in rows or [(None, None, None)]], T.StructType(MANIFEST.fields[:-1]))
    made.withColumn("written_at", F.current_timestamp()).coalesce(1).write.mode("errorifexists").parquet(_at(root, entry))


def _write(df: DataFrame, folder: str) -> int:
    """Writes a folder and counts its rows on the way."""
    seen = Observation()
    df.observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(folder)
    return seen.get["n"]


# Batches: every entry adds rows to each of its tables.


def committed(spark: SparkSession, root: str, batch: int) -> bool:
    return is_folder(spark, f"{_at(root, batch)}") and not spark.read.schema(MANIFEST).parquet(_at(root, batch)).isEmpty()


def commit(spark: SparkSession, root: str, batch: int, sinks: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]]) -> bool:
    """Adds one batch to several tables at once; false, with nothing written, when the batch is there already.

    A sink may be a function of the tables written before it, so what they hold isn't computed again.
    """
    if committed(spark, root, batch):
        return False
    attempt, done, rows = uuid.uuid4().hex[:12], {}, []
    for name, sink in sinks.items():
        df = sink(done) if callable(sink) else sink
        folder = f"{name}/{batch:012d}-{attempt}"
        n = _write(df, f"{root.rstrip('/')}/{folder}")
        rows.append((name, folder, n))
        done[name] = spark.read.schema(df.schema).parquet(f"{root.rstrip('/')}/{folder}")
    _publish(spark, root, batch, None, rows)
    return True


def read_table(spark: SparkSession, root: str, name: str, schema: T.StructType | str, below: int | None = None) -> DataFrame:
    """The rows of a table that committed batches have added, or those before batch ``below``."""
    found = manifests(spark, root).where((F.col("name") == name) & (F.col("row_count") > 0))
    if below is not None:
        found = found.where(F.col("entry") < below)
    folders = [f"{root.rstrip('/')}/{r['folder']}" for r in found.select("folder").collect()]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


# Versions: every entry says for each namespace which folder holds it.


def versions(spark: SparkSession, root: str) -> DataFrame:
    """(version, parent, tag, namespaces, row_count, written_at), a row per version."""
    m = manifests(spark, root)
    per = m.groupBy(F.col("entry").alias("version"), "parent", "tag").agg(
        F.count("name").alias("namespaces"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"), F.max("written_at").alias("written_at")
    )
    return per


def version_of(spark: SparkSession, root: str, version: int | str | None = None, as_of=None) -> int | None:
    """The number or tag asked for, the newest one written by ``as_of``, or the newest; None where there is none."""
    m = manifests(spark, root)
    if version is not None:
        found = m.where(F.col("tag" if isinstance(version, str) else "entry") == version).agg(F.max("entry")).first()[0]
        if found is None:
            raise ValueError(f"no version {version} in {root}")
        return found
    if as_of is not None:
        m = m.where(F.col("written_at") <= F.lit(as_of).cast("timestamp"))
    return m.agg(F.max("entry")).first()[0]


def _choice(spark: SparkSession, root: str, version: int | None) -> dict[str, tuple[str, int]]:
    if version is None:
        return {}
    rows = manifests(spark, root).where((F.col("entry") == version) & F.col("name").isNotNull()).collect()
    return {r["name"]: (r["folder"], r["row_count"]) for r in rows}


def write_version(
    df: DataFrame, root: str, namespace: str, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, drop: list[str] | None = None,
    tag: str | None = None,
) -> int:
    """A new version in which the namespaces that ``df`` has rows of are replaced, or merged with what was there.

    All others keep their folders: an update costs what it touches. ``merge(old, new)`` gives a namespace's rows;
    namespaces of ``drop`` are gone. Namespaces are few (their names come to the driver); a null one is ``default``.
    """
    spark = df.sparkSession
    parent = version_of(spark, root)
    choice = _choice(spark, root, parent)
    version = 1 if parent is None else parent + 1
    df = df.withColumn(namespace, F.coalesce(F.col(namespace).cast("string"), F.lit("default")))
    for name in drop or []:
        choice.pop(name, None)
    names = sorted(r[0] for r in df.select(namespace).distinct().collect())
    attempt = uuid.uuid4().hex[:12]
    for name in names:
        rows = df.where(F.col(namespace) == name)
        if merge is not None and name in choice:
            old = spark.read.schema(df.schema).parquet(f"{root.rstrip('/')}/{choice[name][0]}")
            rows = merge(old, rows).select(*df.columns)
        folder = f"data/{version:012d}-{uuid.uuid5(uuid.NAMESPACE_URL, name).hex[:12]}-{attempt}"
        choice[name] = (folder, _write(rows, f"{root.rstrip('/')}/{folder}"))
    _publish(spark, root, version, parent, [(n, *c) for n, c in sorted(choice.items())], tag)
    return version


def read_version(spark: SparkSession, root: str, schema: T.StructType | str, version: int | str | None = None, as_of=None, namespaces: list[str] | None = None) -> DataFrame:
    """A version's rows, the newest by default; with ``namespaces`` only their folders are opened."""
    choice = _choice(spark, root, version_of(spark, root, version, as_of))
    folders = [f"{root.rstrip('/')}/{f}" for n, (f, k) in sorted(choice.items()) if k and (namespaces is None or n in namespaces)]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def roll_back(spark: SparkSession, root: str, to: int | str) -> int:
    """A new version with the choice of an older one; nothing is copied and nothing is lost."""
    to = version_of(spark, root, to)
    newest = version_of(spark, root)
    _publish(spark, root, newest + 1, newest, [(n, *c) for n, c in sorted(_choice(spark, root, to).items())])
    return newest + 1


def tag_version(df: DataFrame, root: str, env: str, namespace: str, requested: str | None = None, **how) -> tuple[int, str]:
    """A version under a tag, the requested one or the newest tag with its patch number raised (SNK6)."""
    spark = df.sparkSession
    newest = manifests(spark, root).where(F.col("tag").isNotNull()).agg(F.max_by("tag", "entry").alias("latest"))
    wanted = None if requested is None else F.lit(requested)
    tag = newest.select(documents.next_version(F.col("latest"), env, wanted)).first()[0]
    return write_version(df, root, namespace, tag=tag, **how), tag


# Reports: every report has an id and is there once.


def append_reports(reports: DataFrame, root: str, report_id: str = "report_id") -> int | None:
    """Appends reports whose id the table doesn't have yet, of repeated ids one; the entry, or None when all are there (SNK5)."""
    spark = reports.sparkSession
    schema = reports.schema
    known = read_table(spark, root, "reports", schema).select(report_id).distinct()
    new = reports.dropDuplicates([report_id]).join(known, report_id, "left_anti").select(*reports.columns)
    last = manifests(spark, root).agg(F.max("entry")).first()[0]
    entry = 0 if last is None else last + 1
    if new.isEmpty():
        return None
    commit(spark, root, entry, {"reports": new})
    return entry
