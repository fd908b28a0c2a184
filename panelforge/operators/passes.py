"""Satellite passes: granules in sessions, passes per period, runs of visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered, running


def sessions(granules: DataFrame, gap_minutes: float, key: str = "s") -> DataFrame:
    """Granules (start, end, night, units array) of a key into passes: a new one begins when the
    start is more than the gap after the end of the granule before. Time is the middle of the
    first granule (whole minutes), night its flag, units all that any granule touches."""
    # Granules are dealt by key and day; only one row a day meets in a window over the key.
    order = F.struct("start", "end", "id")
    days = granules.withColumn("_day", F.to_date("start"))
    ends = days.groupBy(key, "_day").agg(F.max_by("end", order).alias("_last"), F.min(order).alias("_first"))
    before = ends.select(F.col(key).alias("_key"), F.col("_day").alias("_of"), "_first", F.lag("_last").over(Window.partitionBy(key).orderBy("_day")).alias("_carried"))
    w = Window.partitionBy(key, "_day").orderBy("start", "end", "id")
    days = days.withColumn("_before", F.lag("end").over(w)).join(before, F.col(key).eqNullSafe(F.col("_key")) & F.col("_day").eqNullSafe(F.col("_of")))
    previous = F.when(order == F.col("_first"), F.col("_carried")).otherwise(F.col("_before"))
    opens = F.coalesce((F.unix_timestamp("start") - F.unix_timestamp(previous)) / 60 > gap_minutes, F.lit(True))
    opened = days.withColumn("_opens", opens.cast("int")).drop("_key", "_of", "_first", "_carried", "_before")
    counted = running(opened, [key], F.col("_day"), ["start", "end", "id"], F.col("_opens"), "pass")
    middle = F.timestamp_seconds(F.floor((F.unix_timestamp("start") + F.floor((F.unix_timestamp("end") - F.unix_timestamp("start")) / 2)) / 60) * 60)
    first = F.struct("start", "end", "id")
    return counted.groupBy(key, "pass").agg(
        F.min_by(middle, first).alias("t"),
        F.min_by("night", first).alias("night"),
        F.count(F.lit(1)).alias("n_granules"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("units")))).alias("units"),
    )


def unit_bits(units):
    """Hexadecimal bit set of an array of unit numbers, of any size."""
    last = F.coalesce(F.floor(F.array_max(units) / 4).cast("int"), F.lit(0))
    nibble = lambda k: F.lower(F.hex(F.aggregate(F.filter(units, lambda u: F.floor(u / 4) == k), F.lit(0), lambda a, u: a + F.pow(F.lit(2), u % 4).cast("int"))))
    return F.array_join(F.transform(F.sequence(last, F.lit(0), F.lit(-1)), nibble), "")


def runs(samples: DataFrame, key: list[str], at: str, inside: str, margin: str, chunk: int = 10_000) -> DataFrame:
    """Runs of consecutive samples (at = 0, 1, ...) that are inside; best is the first sample of largest margin."""
    on = numbered(samples.where(F.col(inside)), key, F.floor(F.col(at) / chunk), [at], "_rank")
    on = on.withColumn("island", F.col(at) - F.col("_rank"))
    return on.groupBy(*key, "island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.max_by(at, F.struct(F.col(margin), -F.col(at))).alias("best")).drop("island")
