"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import string
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="leadloom-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_dir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later steps neither recompute it nor need the executors that made it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@functools.cache
def _trim():
    """The C library's call that gives freed memory back; None where there is none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def release() -> None:
    """At the end of a task that took much memory: a worker that waits for its next task should not hold it."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Column names like these that df does not have: underscores are put before the ones that clash."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return tuple(out)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else. Texts without other letters take the cheap built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    )


#: bytes.translate tables: lower-case A-Z; the second also turns ASCII other than letters and digits into spaces.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
