"""Sessions, table reading and the cutting of lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Spark's setting by which shuffle files end with the query that wrote them.
_SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str = "local[*]", app: str = "cinegrain", **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword arguments use ``__`` for the dots of a key."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is what ``spark.checkpoint.dir`` names. Only where that is unset and all runs on one machine, as in tests, a
    folder is made and set; on a cluster each executor would write to a disk of its own, so there it is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="cinegrain-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and end its lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df``, marked for broadcast where it is counted to have ``most`` rows at most; else left to a join by shuffle."""
    kept = cut(df)
    return F.broadcast(kept) if kept.count() <= most else kept


def _scratch(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), f"cinegrain-{spark.sparkContext.applicationId}")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for a written table in the application's part of the shared folder."""
    return os.path.join(_scratch(spark), f"{label}-{uuid.uuid4().hex}")


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables this application has written there; call it when no result is read any more."""
    files, at = hadoop_path(spark, _scratch(spark))
    files.delete(at, True)


def written(df: DataFrame, label: str, lean: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, and later scans prune columns.

    A ``lean`` table is packed tighter, and the shuffle files of its query are deleted as soon as it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if lean:
        kept = spark.conf.get(_SHUFFLES_END)
        spark.conf.set(_SHUFFLES_END, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(_SHUFFLES_END, kept)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the written tables that ``df`` reads, and nothing outside the scratch folder; nothing may read them any more."""
    spark = df.sparkSession
    scratch = hadoop_path(spark, _scratch(spark))[1].toUri().getPath()
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        files, at = hadoop_path(spark, folder)
        if at.toUri().getPath().startswith(scratch + "/"):
            files.delete(at, True)


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as an object of it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application: a zip of it, served by the driver."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="cinegrain-py-"), "cinegrain_package.zip")
    with zipfile.ZipFile(base, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("cinegrain", os.path.relpath(path, root)))
    context.addPyFile(base)
    _SHIPPED.add(context.applicationId)
