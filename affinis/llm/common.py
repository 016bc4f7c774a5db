"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.functions.workers import send_package

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch that goes to a worker, if one text has not more.
BATCH_BYTES = 1 << 26

#: Paths of the tables that this process has cut and not deleted.
_TABLES: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: what the session names, else (with a warning, on a cluster) one beside the warehouse."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        warnings.warn("spark.checkpoint.dir is unset: tables are cut beside the warehouse, which all executors must share", stacklevel=2)
    chosen = named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    context.setCheckpointDir(chosen)
    return chosen


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor loses nothing of it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame) -> DataFrame:
    """As ``cut``, by a Parquet table in that folder: smaller, and later reads take only the columns they use."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    _TABLES.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut meanwhile are deleted at the end; whatever is made of them must have been written by then."""
    begun = len(_TABLES)
    try:
        yield
    finally:
        for path in _TABLES[begun:]:
            delete(spark, path)
        del _TABLES[begun:]


def ready_workers(spark: SparkSession, rows: int = 1000) -> None:
    """Send this package to the workers, and bound what an Arrow batch of whole texts holds there."""
    send_package(spark)
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, str(1 << 30))
        if not now.isdigit() or int(now) > most:  # smaller batches of the caller's stay
            spark.conf.set(key, str(most))


def full_text(column: str | Column = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of the documents whose labels no model may learn from."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def unit_hash(*columns: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the columns and the seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11)
    return bits.cast("double") / F.lit(float(1 << 53))
