"""Near-real-time ingestion as a stream: exact de-duplication, period counts, passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods
from ..operators import passes
from ..operators.panel import counts


def detections_stream(spark: SparkSession, path: str, schema: str, late: str = "5 days") -> DataFrame:
    """Parquet files of detections as they arrive, each (s, t, lat, lon) once within the allowed delay."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withWatermark("t", late).dropDuplicatesWithinWatermark(["s", "t", "lat", "lon"])


def period_counts(rows: DataFrame) -> DataFrame:
    """Kept detections of each cell. Periods begin anew on 1 January, so they are grouped as
    columns, not as windows of fixed length."""
    placed = rows.withColumns({"year": F.year("t"), "p": periods.period(F.col("t"))})
    return counts(placed)


def replace_provisional(provisional: DataFrame, final: DataFrame) -> DataFrame:
    """Final rows and those provisional rows whose day and sensor have none: for foreachBatch."""
    key = [F.to_date("t").alias("_day"), F.col("s").alias("_s")]
    days = final.select(*key).distinct()
    rest = provisional.join(days, (F.to_date("t") == F.col("_day")) & (F.col("s") == F.col("_s")), "left_anti")
    return final.unionByName(rest)


def _rewrite(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces the partitions that df has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _once(writer, once: bool):
    return (writer.trigger(availableNow=True) if once else writer).start()


def start(rows: DataFrame, detections: str, counted: str, checkpoint: str, once: bool = True):
    """Appends each batch's detections to their table (partitioned by year and p) and counts the
    touched periods anew from it. The stream's only state is the de-duplication's, which ends with
    the watermark; a batch that runs twice after a failure replaces its own file and counts."""

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        placed = batch.withColumns({"year": F.year("t"), "p": periods.period(F.col("t")), "batch": F.lit(number)})
        _rewrite(placed, detections, ["year", "p", "batch"])
        touched = placed.select("year", "p").distinct()
        whole = spark.read.parquet(detections).join(F.broadcast(touched), ["year", "p"], "left_semi")  # 46 periods a year
        _rewrite(counts(whole), counted, ["year", "p"])

    return _once(rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(save), once)


def granules_stream(spark: SparkSession, path: str, schema: str, late: str = "1 day") -> DataFrame:
    """Granules as they arrive, each id once within the allowed delay."""
    return spark.readStream.schema(schema).parquet(path).withWatermark("start", late).dropDuplicatesWithinWatermark(["id"])


def start_passes(granules: DataFrame, stored: str, path: str, checkpoint: str, gap_minutes: float, once: bool = True):
    """Passes of the days that a batch touches, from all their granules and those of the day
    before and after, with which a pass at midnight is one. A pass belongs to the day of its first
    granule; its number counts within the sensor and day."""

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        days = batch.withColumns({"day": F.to_date("start"), "batch": F.lit(number)})
        _rewrite(days, stored, ["day", "batch"])
        touched = days.select(F.explode(F.sequence(F.date_sub("day", 1), F.date_add("day", 1))).alias("day")).distinct()
        around = days.select(F.explode(F.sequence(F.date_sub("day", 2), F.date_add("day", 2))).alias("day")).distinct()
        known = spark.read.parquet(stored).join(F.broadcast(around), "day", "left_semi").drop("day", "batch")  # days of a batch
        found = passes.sessions(known, gap_minutes).withColumn("day", F.to_date("t"))
        _rewrite(found.join(F.broadcast(touched), "day", "left_semi").select("s", "t", "night", "n_granules", "units", "day"), path, ["day"])

    return _once(granules.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(save), once)
