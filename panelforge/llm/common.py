"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import _MADE, remove_stored, shared_dir, stored  # noqa: F401 (the operators take them from here)
from ..session import ship

#: The white space of the text contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """The library's code on the executors, and smaller batches for Python workers: ten thousand
    long texts, Arrow's default, may not fit in one. A setting other than the default stays."""
    ship(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, 1000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have yet."""
    name, taken = base, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def release() -> None:
    """Gives memory that a Python worker has freed back to the machine: workers live on after a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return
