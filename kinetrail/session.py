"""Session settings, table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Scratch tables of this driver, deleted when it ends.
_written: list[tuple[SparkSession, str]] = []
#: Whether shuffle files are deleted at the end of the execution that wrote them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and local runs; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("kinetrail")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` as the cluster names it.

    Only where no folder is named, as in tests on one machine, a temporary one is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kinetrail-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, deleted when this driver ends."""
    path = f"{scratch_dir(spark)}/kinetrail-{name}-{os.getpid()}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The table survives the loss of executors, is computed once however often
    it is read, and is columnar, so that later scans prune. The shuffle files of the
    write go with its end, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    # the schema is given: an empty directory could not tell it
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` that no plan needs any more."""
    for name in df.inputFiles()[:1]:
        for entry in list(_written):
            if entry[1].rpartition("/")[2] in name:
                _delete(*entry)
                _written.remove(entry)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended first
        pass


@atexit.register
def _clean() -> None:
    for entry in _written:
        _delete(*entry)
