"""Session for tests, benches and scripts; a cluster brings its own."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", app: str = "plumbline", partitions: int = 8) -> SparkSession:
    """A single-machine session with the settings the operators are written for."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PLUMBLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; only where none is named (one machine) a folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    named = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


_FOLDERS: dict[str, object] = {}  # folders of this process, each with the Hadoop settings it was made under


def _remove(jvm, path: str, settings: object) -> None:
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(settings).delete(p, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for a table that cuts lineage. What is left is removed when the driver's process ends; drop() removes one earlier."""
    base = shared_folder(spark).rstrip("/")
    top = f"{base}/plumbline-{spark.sparkContext.applicationId}"
    if not _FOLDERS:
        atexit.register(_leave, spark._jvm)
    _FOLDERS.setdefault(top, spark._jsc.hadoopConfiguration())
    if base.startswith("file:///tmp/plumbline-"):
        _FOLDERS.setdefault(base, spark._jsc.hadoopConfiguration())
    return f"{top}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    _remove(spark._jvm, path, spark._jsc.hadoopConfiguration())


def _leave(jvm) -> None:
    for path, settings in _FOLDERS.items():
        try:
            _remove(jvm, path, settings)
        except Exception:  # noqa: BLE001 - the gateway may be gone; files are all that is left behind
            pass
    _FOLDERS.clear()
