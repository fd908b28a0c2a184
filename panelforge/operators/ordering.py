"""Row numbers and running sums over whole keys without a task for each key.

Rows are dealt by key and chunk, where chunks follow the order of the rows; windows run inside a
chunk, and only one row a chunk meets in a window over the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, keys: list[str], chunk: Column, order: list[str | Column], values: dict[str, Column]) -> DataFrame:
    """Adds, for each name, the sum of its value over the key's rows up to this one. chunk: never
    falls in the order of the rows; null values count as 0, null keys and chunks are groups."""
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_chunk", chunk).withColumns({f"_value_{c}": F.coalesce(v, F.lit(0)) for c, v in values.items()})
    sums = rows.groupBy(*keys, "_chunk").agg(*[F.sum(f"_value_{c}").alias(f"_sum_{c}") for c in values])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_chunk").alias("_of_chunk"), *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_offset_{c}") for c in values])
    met = F.col("_chunk").eqNullSafe(F.col("_of_chunk"))
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    out = rows.withColumns({f"_upto_{c}": F.sum(f"_value_{c}").over(inside) for c in values}).join(offsets, met)
    out = out.withColumns({c: F.col(f"_offset_{c}") + F.col(f"_upto_{c}") for c in values})
    return out.drop("_chunk", "_of_chunk", *[f"_of_{k}" for k in keys], *[f"_{part}_{c}" for c in values for part in ("value", "upto", "offset")])


def running(df: DataFrame, keys: list[str], chunk: Column, order: list[str | Column], value: Column, name: str) -> DataFrame:
    """Adds name: the sum of value over the key's rows up to this one."""
    return running_sums(df, keys, chunk, order, {name: value})


def numbered(df: DataFrame, keys: list[str], chunk: Column, order: list[str | Column], name: str) -> DataFrame:
    """Adds name: the row's number in its key, from 1."""
    return running(df, keys, chunk, order, F.lit(1), name)
