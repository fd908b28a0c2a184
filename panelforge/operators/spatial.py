"""Points, tiles and rasters over districts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

#: A collection as rows see it; coordinates stay text until their depth is known.
_COLLECTION = "type string, features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
_POLYGON, _MULTI = "array<array<array<double>>>", "array<array<array<array<double>>>>"


def districts(texts: DataFrame, column: str = "value") -> DataFrame:
    """place, name, rings (all shells and holes, as points x and y), polygons (the same rings, shell
    first in each) and wrong (null: usable) of each feature of collections given as JSON texts, by functions of the JVM alone."""
    features = texts.select(F.from_json(column, _COLLECTION).alias("c")).select(F.col("c.type").alias("kind"), F.posexplode_outer("c.features").alias("place", "f"))
    shape, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    # one polygon is a list of one polygon
    nested = F.when(shape == "Polygon", F.from_json(F.concat(F.lit("["), text, F.lit("]")), _MULTI)).when(shape == "MultiPolygon", F.from_json(text, _MULTI))
    rows = features.withColumn("polygons", nested).withColumn("flat", F.flatten("polygons"))
    usable = lambda q: (F.size(q) >= 2) & F.coalesce(~F.isnan(q[0]) & ~F.isnan(q[1]) & (F.abs(q[0]) <= 180) & (F.abs(q[1]) <= 90), F.lit(False))
    closed = lambda r: F.slice(F.get(r, F.lit(0)), 1, 2) == F.slice(F.get(r, F.size(r) - 1), 1, 2)
    wrong = (
        F.when(F.coalesce(F.col("kind") != "FeatureCollection", F.lit(True)) | F.col("place").isNull(), "no feature collection")
        .when(F.col("polygons").isNull() | (F.size("polygons") == 0), "no polygon")
        .when(F.exists("polygons", lambda p: F.coalesce(F.size(p) < 1, F.lit(True))), "a polygon without rings")
        .when(F.exists("flat", lambda r: F.coalesce((F.size(r) < 4) | F.exists(r, lambda q: ~usable(q)), F.lit(True))), "a ring out of range")
        .when(F.exists("flat", lambda r: ~F.coalesce(closed(r), F.lit(False))), "an open ring")
    )
    named = F.coalesce(*[F.nullif(F.try_element_at("f.properties", F.lit(k)), F.lit("")) for k in ("shapeName", "name", "district")], F.lit("Unnamed area"))
    ring = lambda r: F.transform(r, lambda q: F.struct(q[0].alias("x"), q[1].alias("y")))
    points, nested = F.transform("flat", ring), F.transform("polygons", lambda p: F.transform(p, ring))
    return rows.select("place", named.alias("name"), points.alias("rings"), nested.alias("polygons"), wrong.alias("wrong"))


def units_from_geojson(spark: SparkSession, text: str) -> DataFrame:
    """Districts of a FeatureCollection: unit_idx in order, name, rings; raises ValueError if any
    isn't made of closed rings of four points or more within range."""
    rows = districts(spark.createDataFrame([(text,)], "value string"))
    bad = rows.where(F.col("wrong").isNotNull()).select("wrong").first()
    if bad:
        raise ValueError(f"boundaries: {bad['wrong']}")
    return rows.select(F.col("place").cast("int").alias("unit_idx"), "name", "rings")


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Districts of the GeoJSON files below a path; those that aren't usable are left out."""
    rows = districts(spark.read.text(path, wholetext=True))
    return rows.where(F.col("wrong").isNull()).select(F.col("place").cast("int").alias("unit_idx"), "name", "rings")


def geometry_text(polygons: Column) -> Column:
    """Polygons (arrays of closed rings of x and y) as GeoJSON geometry."""
    pairs = F.transform(polygons, lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.array(q["x"], q["y"]))))
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get(pairs, F.lit(0)).alias("coordinates")))
    return F.when(F.size(polygons) == 1, one).otherwise(F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), pairs.alias("coordinates"))))


def feature_collection(units: DataFrame, properties: list[str]) -> DataFrame:
    """One row: a GeoJSON collection of the units of a region in order of unit_idx. units: unit_idx,
    polygons and the properties."""
    named = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    feature = F.concat(F.lit('{"type":"Feature","properties":'), named, F.lit(',"geometry":'), geometry_text(F.col("polygons")), F.lit("}"))
    rows = units.agg(F.array_sort(F.collect_list(F.struct("unit_idx", feature.alias("f")))).alias("r"))
    return rows.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("r.f", ","), F.lit("]}")).alias("value"))


def parent_by_cells(units: DataFrame, parents: DataFrame, cell: float) -> DataFrame:
    """unit_idx and the parent that most of the unit's cell centres are in (the first on ties):
    the parent of largest overlap, to the size of a cell."""
    boxes = with_boxes(units)
    low = lambda c: F.floor(F.col(c) / cell)
    centres = boxes.withColumn("gx", F.explode(F.sequence(low("west"), low("east")))).withColumn("gy", F.explode(F.sequence(low("south"), low("north"))))
    centres = centres.withColumns({"lon": (F.col("gx") + 0.5) * cell, "lat": (F.col("gy") + 0.5) * cell}).where(geo.in_rings(F.col("lon"), F.col("lat"), F.col("rings")))
    placed = assign(centres.select(F.col("unit_idx").alias("unit"), "lon", "lat"), parents)
    votes = placed.where(F.col("unit_idx").isNotNull()).groupBy("unit", "unit_idx", "unit_name").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("unit").agg(F.max_by("unit_name", F.struct("n", -F.col("unit_idx"))).alias("parent"))
    return units.select("unit_idx").join(best, F.col("unit_idx") == F.col("unit"), "left").select("unit_idx", "parent")


def with_boxes(units: DataFrame) -> DataFrame:
    flat = units.withColumn("_q", F.flatten("rings"))
    edges = {"west": F.array_min("_q.x"), "east": F.array_max("_q.x"), "south": F.array_min("_q.y"), "north": F.array_max("_q.y")}
    return flat.withColumns(edges).drop("_q")


def assign(points: DataFrame, units: DataFrame, lon: str = "lon", lat: str = "lat", cell: float = 0.5) -> DataFrame:
    """Adds unit_idx and unit_name of the first district that holds a point, null outside all.

    Districts are laid on a grid; points meet only those whose box touches their cell, so the
    join has equality keys and districts need no broadcast.
    """
    boxes = with_boxes(units)
    low = lambda c: F.floor(F.col(c) / cell)
    tiled = boxes.withColumn("gx", F.explode(F.sequence(low("west"), low("east")))).withColumn("gy", F.explode(F.sequence(low("south"), low("north"))))
    tiled = tiled.select("gx", "gy", F.struct("unit_idx", "name", "rings", "west", "east", "south", "north").alias("unit"))
    by_cell = tiled.groupBy("gx", "gy").agg(F.array_sort(F.collect_list("unit"), lambda a, b: a["unit_idx"] - b["unit_idx"]).alias("near"))
    placed = points.withColumns({"gx": F.floor(F.col(lon) / cell), "gy": F.floor(F.col(lat) / cell)}).join(by_cell, ["gx", "gy"], "left")
    x, y = F.col(lon), F.col(lat)
    hits = F.filter("near", lambda u: x.between(u["west"], u["east"]) & y.between(u["south"], u["north"]) & geo.in_rings(x, y, u["rings"]))
    return placed.withColumn("_hit", F.get(hits, F.lit(0))).withColumns({"unit_idx": F.col("_hit.unit_idx"), "unit_name": F.col("_hit.name")}).drop("gx", "gy", "near", "_hit")


def touching(footprints: DataFrame, units: DataFrame, cell: float = 1.0) -> DataFrame:
    """Pairs id, unit_idx whose polygons share a point: a vertex of one in the other, or edges that
    cross. footprints: id, ring."""
    a = footprints.withColumns({"west": F.array_min("ring.x"), "east": F.array_max("ring.x"), "south": F.array_min("ring.y"), "north": F.array_max("ring.y")})
    grid = lambda d: d.withColumn("gx", F.explode(F.sequence(F.floor(F.col("west") / cell), F.floor(F.col("east") / cell)))).withColumn("gy", F.explode(F.sequence(F.floor(F.col("south") / cell), F.floor(F.col("north") / cell))))
    b = grid(with_boxes(units)).select("gx", "gy", "unit_idx", "rings")
    near = grid(a).select("gx", "gy", "id", "ring").join(b, ["gx", "gy"]).dropDuplicates(["id", "unit_idx"])
    edges = lambda r: F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    def side(p, q, r):
        return (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])

    def cross(e, f):
        return (side(e["p"], e["q"], f["p"]) * side(e["p"], e["q"], f["q"]) <= 0) & (side(f["p"], f["q"], e["p"]) * side(f["p"], f["q"], e["q"]) <= 0) & ~((side(e["p"], e["q"], f["p"]) == 0) & (side(e["p"], e["q"], f["q"]) == 0))

    ring_in = F.exists("ring", lambda q: geo.in_rings(q["x"], q["y"], F.col("rings")))
    unit_in = F.exists(F.flatten("rings"), lambda q: geo.in_rings(q["x"], q["y"], F.array("ring")))
    cut = F.exists(edges(F.col("ring")), lambda e: F.exists("rings", lambda r: F.exists(edges(r), lambda f: cross(e, f))))
    return near.where(ring_in | unit_in | cut).select("id", "unit_idx")


def grid_runs(grids: DataFrame) -> DataFrame:
    """tile and its stretches of pixels of one district on land, as arrays start, length and unit. grids:
    tile, unit (little-endian int16 of each pixel, negative outside), land (bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for tile, units, land in zip(batch["tile"], batch["unit"], batch["land"]):
                unit = np.frombuffer(units, "<i2").astype(np.int32)
                unit = np.where((np.frombuffer(land, np.uint8) > 0) & (unit >= 0), unit, -1)
                edge = np.flatnonzero(np.diff(unit, prepend=-2, append=-2))
                start, size, inside = edge[:-1], np.diff(edge), unit[edge[:-1]] >= 0
                out.append((tile, start[inside], size[inside], unit[start[inside]]))
            yield pd.DataFrame(out, columns=["tile", "start", "length", "unit"])

    return grids.select("tile", "unit", "land").mapInPandas(run, "tile int, start array<int>, length array<int>, unit array<int>")


def raster_counts(masks: DataFrame, grids: DataFrame, clear: tuple[int, ...] = (5, 7, 8, 9), cloud: tuple[int, ...] = (4,)) -> DataFrame:
    """Clear, cloudy and land pixels of every mask and unit. masks: sat, tile, date, pixels
    (bytes); grids: as for grid_runs.

    Each grid is read once and meets the masks as runs, a small part of its size; a run's pixels are
    counted as a difference of the mask's running sums."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = np.zeros((2, 256), np.int32)
        wanted[0, list(clear)], wanted[1, list(cloud)] = 1, 1
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                pixel = np.frombuffer(row.pixels, np.uint8)
                units, of = np.unique(row.unit, return_inverse=True)
                sums = [np.bincount(of, row.length, len(units))]
                for kind in wanted:
                    total = np.concatenate(([0], np.cumsum(kind[pixel])))
                    sums.append(np.bincount(of, total[row.start + row.length] - total[row.start], len(units)))
                land, seen, hidden = (s.astype(np.int64) for s in sums)
                out.append(pd.DataFrame({"sat": row.sat, "tile": row.tile, "date": row.date, "unit": units, "clear": seen, "cloud": hidden, "land": land}))
            if out:
                yield pd.concat(out)

    met = masks.join(grid_runs(grids), "tile").select("sat", "tile", "date", "pixels", "start", "length", "unit")
    return met.mapInPandas(count, "sat string, tile int, date date, unit int, clear long, cloud long, land long")


def land_strata(pixels: DataFrame) -> DataFrame:
    """Class shares and majority stratum of each unit; water and snow aren't land, and forest goes
    before cropland before other on ties. pixels: unit, klass (cover code)."""
    k = F.col("klass")
    stratum = F.when(k == 10, "forest").when(k == 40, "cropland").otherwise("other")
    order = F.when(F.col("stratum") == "forest", 3).when(F.col("stratum") == "cropland", 2).otherwise(1)
    n = pixels.groupBy("unit").agg(F.count(F.lit(1)).alias("pixels"))
    by = pixels.where(~k.isin(0, 70, 80)).groupBy("unit", stratum.alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    best = by.groupBy("unit").agg(F.max_by("stratum", F.struct("n", order)).alias("stratum"), F.sum("n").alias("land"))
    return n.join(best, "unit", "left").select("unit", "pixels", F.coalesce("land", F.lit(0)).alias("land"), F.coalesce("stratum", F.lit("other")).alias("stratum"))
