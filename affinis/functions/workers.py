"""Python workers need this package: it is sent to them once for each Spark context."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path
from threading import Lock

from pyspark import SparkContext
from pyspark.sql import SparkSession

SENDING = Lock()


def send_package(spark: SparkSession) -> None:
    with SENDING:  # plans may be made in several threads
        _send(spark.sparkContext)


def _send(context: SparkContext) -> None:
    if getattr(context, "_affinis_sent", None):
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/affinis_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(path)  # the driver's file server hands it to the executors
    context._affinis_sent = True


def bound_batches(spark: SparkSession, most: int = 1 << 26) -> None:
    """Send this package to the workers, and bound the bytes of an Arrow batch that goes there."""
    send_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, str(1 << 30))
    if not now.isdigit() or int(now) > most:  # smaller batches of the caller's stay
        spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or one beside the warehouse where that is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
