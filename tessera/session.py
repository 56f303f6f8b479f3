"""Session defaults and the shared work folder.

Every intermediate table that must survive executor loss (fitted vocabularies,
PCA factors, staged ordinals) is written under the folder the cluster names in
``spark.checkpoint.dir``. Only when that setting is missing (local tests) do we
pick a fresh folder of our own.
"""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", app: str = "tessera",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    workdir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not find it in their working folder."""
    package = os.path.dirname(os.path.abspath(__file__))
    place = os.path.join(tempfile.mkdtemp(prefix="tessera-package-"), os.path.basename(package))
    spark.sparkContext.addPyFile(shutil.make_archive(place, "zip", os.path.dirname(package), os.path.basename(package)))


def workdir(spark: SparkSession) -> str:
    """The shared checkpoint folder; set a private one only if none is configured."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            d = tempfile.mkdtemp(prefix="tessera-ckpt-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new, never-reused location under the work folder."""
    base = workdir(spark)
    sep = "" if base.endswith("/") else "/"
    return f"{base}{sep}{tag}-{uuid.uuid4().hex[:12]}"


def default_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "8"))


def spread(df):
    """``df`` over all task slots where its scan has fewer splits than that (one small file).

    Larger inputs keep the partitions of their scan: their texts are not shuffled. Rows that come out of
    a shuffle stay as it spreads them: to ask for their partitions would run that shuffle once more.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of the session."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if fs.exists(p):
        fs.delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now; it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# Largest row count we broadcast for per-job metadata tables (stats, offsets).
BROADCAST_MAX_ROWS = 200_000


def broadcast_if_small(df, max_rows: int = BROADCAST_MAX_ROWS):
    """Broadcast ``df`` only after counting it below ``max_rows``; otherwise a shuffled join.

    Use on small, already materialised tables (written stats, fitted models):
    the count is the proof of the size bound.
    """
    from pyspark.sql import functions as F
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def list_partitions(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of a partition column present under ``path`` (directory listing only), decoded."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return []
    prefix = f"{column}="
    return [unquote(st.getPath().getName()[len(prefix):]) for st in fs.listStatus(p)
            if st.isDirectory() and st.getPath().getName().startswith(prefix)]


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in ``path`` (none if it does not exist)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []


def create_marker(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it exists already."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).createNewFile(p)


def partition_path(spark: SparkSession, path: str, column: str, value: str) -> str:
    """Folder of one partition value, escaped as Spark's writer does."""
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return f"{path}/{column}={escape(value)}"
