"""Session, table loading and the shared working folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def local_session(cores: int | str = "*", app: str = "sievework", memory: str = "8g") -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own."""
    parts = str(os.cpu_count() if cores == "*" else cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and all of it runs in one JVM (tests) a temporary folder is made and set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='sievework-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


@lru_cache(maxsize=8)
def _own_dir(app_id: str) -> str:
    """The application's own folder of the shared one, deleted when the driver ends."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    path = f"{shared_dir(spark)}/sievework/{app_id}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def new_path(spark: SparkSession, label: str) -> str:
    """A new place for a table that lives as long as the application."""
    return f"{_own_dir(spark.sparkContext.applicationId)}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Writes ``df`` as Parquet and reads it again; the shuffle files of the write go as soon as it ends."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends, lost executors cost nothing."""
    return written(df, new_path(df.sparkSession, label))


def bound_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Arrow batches of at most ``size`` bytes from now on (lower limits of the session stay).

    Long texts make the usual 10,000 rows a batch too large for a small executor's Python workers.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.rstrip("bB").isdigit() or int(now.rstrip("bB")) > size:
        spark.conf.set(key, str(size))
