"""Readers: detection files of two sensor families, user CSV, model JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C

RAW_SCHEMA = "latitude string, longitude string, acq_date string, acq_time string, satellite string, confidence string, frp string, daynight string, type string, instrument string"
REQUIRED = ("latitude", "longitude", "acq_date", "satellite")


def read_detections(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Raw detection CSVs by header name, as text, with the file each row is from."""
    raw = spark.read.option("header", True).csv(paths)
    have = {c.lower(): c for c in raw.columns}
    names = [f.split()[0] for f in RAW_SCHEMA.split(", ")]
    return raw.select(*[(F.col(have[n]) if n in have else F.lit(None)).cast("string").alias(n) for n in names], F.col("_metadata.file_path").alias("file"))


def normalize(raw: DataFrame, kind: str, src: int = 0) -> DataFrame:
    """Internal detections: t, lat, lon, frp, night, s, conf, type, src. kind: "T+A" for the MODIS
    family, else the sensor that unknown satellite names stand for."""
    t = F.try_to_timestamp(F.concat_ws(" ", "acq_date", F.lpad(F.coalesce("acq_time", F.lit("0")), 4, "0")), F.lit("yyyy-MM-dd HHmm"))
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    finite = lambda c: F.when(~F.isnan(number(c)), number(c))
    if kind == "T+A":
        s = F.when(F.lower("satellite").startswith("t"), 0).otherwise(1)
        level = F.coalesce(finite("confidence"), F.lit(0.0))
        conf = F.when(level < 30, 0).when(level < 80, 1).otherwise(2)
    else:
        s = F.when(F.col("satellite") == "N", 2).when(F.col("satellite") == "N20", 3).when(F.col("satellite") == "N21", 4).otherwise(C.SENSORS.index(kind))
        first = F.lower(F.substring("confidence", 1, 1))
        conf = F.when(first == "l", 0).when(first == "h", 2).otherwise(1)
    return raw.select(
        t.alias("t"),
        finite("latitude").alias("lat"),
        finite("longitude").alias("lon"),
        F.coalesce(finite("frp"), F.lit(0.0)).alias("frp"),
        F.coalesce(F.col("daynight") == "N", F.lit(False)).alias("night"),
        s.cast("tinyint").alias("s"),
        conf.cast("tinyint").alias("conf"),
        F.coalesce(finite("type").cast("tinyint"), F.lit(-1)).cast("tinyint").alias("type"),
        F.lit(src).cast("tinyint").alias("src"),
    )


def in_box(points: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    return points.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def satellite_name(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in C.ALIASES.items() for x in pair])
    return F.try_element_at(known, F.upper(name))


def observations(rows: DataFrame) -> DataFrame:
    """Checked observations from text columns; rejected says why a row isn't one (null: accepted)."""
    have = set(rows.columns)
    text = lambda c: F.trim(F.col(c).cast("string")) if c in have else F.lit(None).cast("string")
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    r = rows.withColumns({f"_{c}": text(c) for c in ("latitude", "longitude", "acq_date", "acq_time", "satellite", "confidence", "frp", "district", "excluded")})
    lat, lon, frp = number("_latitude"), number("_longitude"), number("_frp")
    known = F.coalesce(F.col("_acq_time") != "", F.lit(False))
    time = F.lpad(F.when(known, F.col("_acq_time")).otherwise("0000"), 4, "0")
    day = F.when(F.col("_acq_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr("try_cast(_acq_date AS DATE)"))
    name = satellite_name(F.col("_satellite"))
    confidence = F.lower(F.coalesce("_confidence", F.lit("")))
    clock = time.rlike(r"^([01]\d|2[0-3])[0-5]\d$") & (F.length(F.coalesce("_acq_time", F.lit(""))) <= 4)
    reason = (
        F.when(F.coalesce((F.abs(lat) > 90) | (F.abs(lon) > 180) | F.isnan(lat) | F.isnan(lon), F.lit(True)), "coordinates")
        .when(name.isNull(), "satellite")
        .when(day.isNull(), "date")
        .when(~clock, "time")
    )
    at = F.try_to_timestamp(F.concat_ws(" ", F.col("_acq_date"), time), F.lit("yyyy-MM-dd HHmm"))
    low = confidence.isin("l", "low") | F.coalesce(confidence.rlike(r"^\d+$") & (F.expr("try_cast(_confidence AS DOUBLE)") < 30), F.lit(False))
    return r.select(
        reason.alias("rejected"),
        lat.alias("latitude"),
        lon.alias("longitude"),
        name.alias("satellite"),
        F.when(name.isin("Terra", "Aqua"), "MODIS").otherwise("VIIRS").alias("sensor"),
        at.alias("date"),
        day.alias("day"),
        time.alias("time"),
        known.alias("time_known"),
        F.when(~F.isnan(frp), frp).alias("frp"),
        confidence.alias("confidence"),
        low.alias("low_confidence"),
        F.coalesce("_district", F.lit("")).alias("district"),
        F.coalesce(F.lower("_excluded") == "true", F.lit(False)).alias("excluded"),
        F.year(day).alias("year"),
        F.least(F.lit(45), F.floor((F.dayofyear(day) - 1) / 8)).cast("int").alias("period"),
    )


def import_csv(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Accepted observations of a user's CSV (the last of equal place, satellite and time) and how
    many rows were rejected."""
    from ..operators.dedupe import keep_last

    raw = spark.read.options(header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE").csv(path)
    raw = raw.toDF(*[c.strip().lstrip("﻿").lower() for c in raw.columns])
    lacking = [c for c in REQUIRED if c not in raw.columns]
    if lacking:
        raise ValueError(f"the CSV has no column {lacking[0]}")
    checked = observations(raw).withColumn("line", F.monotonically_increasing_id()).persist()
    rejected = checked.where(F.col("rejected").isNotNull()).count()
    good = checked.where(F.col("rejected").isNull()).drop("rejected")
    if rejected and good.limit(1).count() == 0:
        raise ValueError("no row of the CSV is a valid observation")
    return keep_last(good, ["latitude", "longitude", "satellite", "date"], "line"), rejected


ESTIMATE = "district string, year int, period int, value double, lower double, upper double, probability double, coverage double, baselineMedian double, grounded struct<value:double,lower:double,upper:double,probability:double>"


def bad_estimates(estimates: DataFrame) -> DataFrame:
    """Estimates that break a range; a model with any of them is refused."""
    e = F.col
    ranges = (
        (F.length("district") > 0) & e("year").between(2003, 2100) & e("period").between(0, 45) & (e("lower") >= 0) & (e("lower") <= e("value")) & (e("value") <= e("upper"))
        & e("probability").between(0, 1) & e("coverage").between(0, 100) & (e("baselineMedian") >= 0)
    )
    g = lambda c: F.col(f"grounded.{c}")
    overlay = e("grounded").isNull() | F.coalesce((g("lower") >= 0) & (g("lower") <= g("value")) & (g("value") <= g("upper")) & g("probability").between(0, 1), F.lit(False))
    return estimates.where(~F.coalesce(ranges, F.lit(False)) | ~overlay)


def import_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Observations and estimates of a model file (version 1); any bad estimate refuses it."""
    schema = f"version int, observations array<struct<latitude:string,longitude:string,acq_date:string,acq_time:string,satellite:string,confidence:string,frp:string,district:string,excluded:string>>, estimates array<struct<{ESTIMATE.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double').replace(' struct', ':struct').replace(', ', ',')}>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    if doc.where((F.col("version") == 1) & F.col("observations").isNotNull()).limit(1).count() == 0:
        raise ValueError("a model needs version 1 and observations")
    seen = observations(doc.select(F.explode("observations").alias("o")).select("o.*"))
    estimates = doc.select(F.explode("estimates").alias("e")).select("e.*")
    if seen.where(F.col("rejected").isNotNull()).limit(1).count() or bad_estimates(estimates).limit(1).count():
        raise ValueError("an observation or estimate is out of range")
    return seen.drop("rejected"), estimates
