"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: ASCII space and the controls 9 to 13.
BLANKS = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach.

    ``spark.checkpoint.dir`` names it. Only where that is unset is another one
    chosen: a temporary folder in local mode, the warehouse on a cluster.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return _local.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="tessella-"))
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tessella"


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop(spark: SparkSession, named: str) -> None:
    with contextlib.suppress(Exception):
        spark.sql(f"DROP TABLE IF EXISTS {named}")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/tessella-{uuid.uuid4().hex}-{name}"
    atexit.register(_delete, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """written(), and the path, for drop_path() once nothing reads it any more."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    _delete(spark, path)


def lean(run):
    """An Arrow function that gives its memory back at its end: idle Python workers live on for a while."""

    def go(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return go


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``df`` written in buckets of ``key``, so that a join or group on it needs no shuffle of this side."""
    path, named = new_path(df.sparkSession, name), f"tessella_{uuid.uuid4().hex}"
    atexit.register(_drop, df.sparkSession, named)
    df.write.format("parquet").bucketBy(buckets, key).option("compression", "zstd").option("path", path).saveAsTable(named)
    return df.sparkSession.table(named)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` does just that where all is ASCII, and faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column, separators: str = BLANKS) -> Column:
    """The runs between separators, in order; none for null."""
    return F.coalesce(F.array_remove(F.split(text, separators), ""), F.array().cast("array<string>"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with so many more underscores before them that ``df`` has no such column."""
    own, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in own:
            name = "_" + name
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
