"""Feeds of many files: pages with their own headers, live feeds of which some may fail, orbits as
text, regions from configuration, and limits of uploads."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .observations import RAW_SCHEMA, in_box

NAMES = [f.split()[0] for f in RAW_SCHEMA.split(", ")]
MAX_UPLOAD = 50 * 1024 * 1024  # fixed value


@dataclass(frozen=True)
class Region:
    """A region's fixed facts, as its configuration names them."""

    id: str
    name: str
    zone: str
    west: float
    south: float
    east: float
    north: float

    @classmethod
    def parse(cls, text: str, region: str) -> Region:
        """From a JSON object of regions; raises ValueError for an unknown region or a wrong box."""
        found = json.loads(text).get(region)
        if not isinstance(found, dict):
            raise ValueError(f"no region {region}")
        west, south, east, north = map(float, found["bbox"])
        if not (-180 <= west < east <= 180 and -90 <= south < north <= 90):
            raise ValueError(f"the box of {region} is not west, south, east, north")
        return cls(region, str(found["name"]), str(found["tz"]), west, south, east, north)

    def inside(self, points: DataFrame) -> DataFrame:
        return in_box(points, self.west, self.south, self.east, self.north)

    def local(self, time: Column) -> Column:
        """UTC as the region's wall clock."""
        return F.from_utc_timestamp(time, self.zone)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw detections of all pages below a path, whatever the order of each page's columns. A page
    is a CSV whose first line names latitude; other pages (an error text, an empty answer) have no
    rows. Pages are split where they are read, one task for many of them."""
    pages = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r\n?", "\n").alias("page"), F.col("_metadata.file_path").alias("file"))
    lines = pages.select("file", F.split(F.ltrim(F.col("page")), "\n").alias("lines"))
    names = F.transform(F.split(F.get("lines", F.lit(0)), ","), lambda c: F.lower(F.trim(c)))
    rows = lines.withColumn("names", names).where(F.array_contains("names", "latitude"))
    rows = rows.select("file", "names", F.explode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line")).where(F.trim("line") != "")
    cells = F.map_from_arrays(F.col("names"), F.transform(F.slice(F.concat(F.split("line", ",", -1), F.array_repeat(F.lit(""), F.size("names"))), F.lit(1), F.size("names")), lambda c: F.nullif(F.trim(c), F.lit(""))))
    named = rows.select("file", cells.alias("cells"))
    return named.select(*[F.try_element_at("cells", F.lit(n)).alias(n) for n in NAMES], "file")


def union_of(spark: SparkSession, feeds: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """Rows of all feeds (name: path) that can be read, and a warning for each that can't; raises
    ValueError if none can. A feed is read when its first row is."""
    parts, warnings = [], []
    for name, path in feeds.items():
        try:
            part = read_pages(spark, path)
            if part.limit(1).count() == 0:
                raise ValueError("no rows")
            parts.append(part.withColumn("feed", F.lit(name)))
        except (PySparkException, Py4JJavaError, ValueError) as broken:
            warnings.append(f"{name} unavailable: {str(broken).splitlines()[0][:200]}")
    if not parts:
        raise ValueError("no feed could be read")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, warnings


def orbits(lines: DataFrame) -> DataFrame:
    """Orbital elements from three-line records. lines: file, place (from 0), value. Columns: name,
    number, epoch (UTC), inclination, eccentricity, mean motion (turns a day)."""
    records = lines.where(F.trim("value") != "").groupBy("file", F.floor(F.col("place") / 3).alias("record")).agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("r"))
    line = lambda k: F.get("r", F.lit(k))["value"]
    part = lambda k, a, n: F.trim(F.substring(line(k), a, n))
    number = lambda c: c.try_cast("double")
    short = number(part(1, 19, 2))
    year = F.when(short < 57, short + 2000).otherwise(short + 1900)
    start = F.unix_micros(F.make_timestamp(year.cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    epoch = F.timestamp_micros((start + F.round((number(part(1, 21, 12)) - 1) * 86_400_000_000)).cast("long"))
    out = records.where((F.size("r") == 3) & line(1).startswith("1 ") & line(2).startswith("2 "))
    return out.select(F.trim(line(0)).alias("name"), part(1, 3, 5).try_cast("int").alias("number"), epoch.alias("epoch"), number(part(2, 9, 8)).alias("inclination"), (number(part(2, 27, 7)) / 1e7).alias("eccentricity"), number(part(2, 53, 11)).alias("mean_motion"))


def check_upload(spark: SparkSession, path: str, limit: int = MAX_UPLOAD) -> int:
    """Bytes of an uploaded file; raises ValueError above the limit, before its content is read."""
    size = spark.read.format("binaryFile").load(path).select(F.sum("length").alias("n")).first()["n"] or 0
    if size > limit:
        raise ValueError(f"the file has {size} bytes, {limit} are allowed")
    return size


def kind_of(name: str) -> str:
    """csv, model or boundaries by a file's name; raises ValueError for others."""
    found = re.search(r"\.(csv|json|geojson)$", name.lower())
    if not found:
        raise ValueError("a CSV, a model JSON or a district GeoJSON is expected")
    return {"csv": "csv", "json": "model", "geojson": "boundaries"}[found[1]]
