"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}
_HOME = str(Path(__file__).resolve().parent.parent)


def local_session(cores: int | str = "*", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks, with adaptive execution and Arrow on."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("matchloom")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_importable(spark: SparkSession) -> None:
    """Python workers on this machine find the package even if the driver was started in another folder.

    On a cluster the package is shipped as usual (``--py-files`` or installed on the nodes).
    """
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _HOME not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_HOME, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where it is unset a temporary folder serves in local mode (tests); on a cluster that is an error, as executors would write to
    folders that nobody else sees.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        folder = _FOLDERS.get(application)
        if folder is None:
            folder = _FOLDERS[application] = tempfile.mkdtemp(prefix="matchloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back: lineage ends at files that survive a lost executor.

    The files stay until ``release_tables`` or ``only_last_table`` deletes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release_tables(spark: SparkSession) -> None:
    """Delete all tables that this application has materialised; frames that still read them fail from then on."""
    _delete(spark, _WRITTEN.pop(spark.sparkContext.applicationId, []))


@contextmanager
def only_last_table(spark: SparkSession) -> Iterator[None]:
    """Delete what is materialised inside the block, but for the table written last, which must not read the others any more."""
    written = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    before = len(written)
    yield
    inside = written[before:]
    del written[before:]
    written += inside[-1:]
    _delete(spark, inside[:-1])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A table in fewer splits than there are cores, dealt out by keys; larger ones as they are.

    A table of so few splits is small, so moving it once is cheap beside reading it in one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df._jdf.rdd().getNumPartitions() < cores else df
