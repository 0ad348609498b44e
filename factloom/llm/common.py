"""Shared helpers: table reading, materialisation in the cluster's shared folder, text primitives."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a broadcast side may have; its rows are fixed-width (at most a few longs each).
BROADCAST_ROWS = 1_000_000

#: ASCII white space, as the contracts define words.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session has none and runs on one machine a temporary folder is made and set; on a cluster that
    would be a folder that other machines do not see, so it raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="factloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/factloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages and retries start from files."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for t in tables:
        drop_dir(t.sparkSession, t.folder)


def small_batches(spark: SparkSession) -> None:
    """Texts are large: Arrow batches of fewer rows than Spark's default, unless the session has a number of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def trim() -> None:
    """Give freed memory of a Python worker back, at the end of a task: workers are kept, and others need it."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a folder that Spark names, for executors that read and write parts of files."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever characters their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def packed(df: DataFrame) -> DataFrame:
    """Every row as one struct ``row``, so that columns added beside it clash with none of its own; undone by ``unpacked``."""
    return df.select(F.struct(*columns(df)).alias("row"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` (already materialised) has at most ``limit`` rows."""
    return df.limit(limit + 1).count() <= limit


def sized_join(left: DataFrame, right: DataFrame, on, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a materialised ``right`` only when its counted rows allow it, else shuffle."""
    return left.join(F.broadcast(right) if bounded(right, limit) else right, on, how)


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids`` (materialised, column doc_id); null ids stay."""
    gone = ids.select(F.col("doc_id").alias("gone")).distinct()
    return unpacked(sized_join(packed(docs), gone, F.col("row.doc_id") == F.col("gone"), "left_anti"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def single_spaced(text: Column) -> Column:
    """Each run of ASCII white space as one space; single spaces, the usual case, are not matched."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")
