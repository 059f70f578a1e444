"""Spark sessions and durable intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own configuration."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lectern")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; where none is set, a temporary one if all runs on this machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        master = spark.sparkContext.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def _own_folder(spark: SparkSession) -> str:
    return os.path.join(checkpoint_dir(spark), "lectern", spark.sparkContext.applicationId)


def forget(spark: SparkSession) -> None:
    """Delete the durable tables of this application; results that were made from them can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_CLEANED: set[str] = set()


def _forget_at_exit(spark: SparkSession) -> None:
    def clean() -> None:
        with contextlib.suppress(Exception):  # the session may be gone before
            forget(spark)

    if spark.sparkContext.applicationId not in _CLEANED:
        _CLEANED.add(spark.sparkContext.applicationId)
        atexit.register(clean)


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    It cuts the lineage so that a lost executor never repeats the work before it, and, unlike a row-wise
    checkpoint, the reader still prunes columns and pushes filters.  The table goes when the application ends.
    """
    spark = df.sparkSession
    _forget_at_exit(spark)
    path = os.path.join(_own_folder(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._durable_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a durable table once nothing will read it again."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._durable_path)
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors' Python, once for each application.

    Executors need no installation of it; the archive is staged on the driver, from where Spark serves it.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lectern-")) / "lectern-package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
