"""Saved workspaces: imports by kind, kept as Parquet below one folder, found by their id."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import feeds, observations
from . import spatial

_ID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}")


def folder(root: str, workspace: str) -> str:
    """The folder of a workspace; an id that isn't one of ours never becomes a path."""
    if not _ID.fullmatch(workspace):
        raise ValueError("unknown workspace")
    return f"{root.rstrip('/')}/{workspace}"


def save(root: str, seen: DataFrame, estimates: DataFrame | None = None, boundaries: DataFrame | None = None) -> str:
    """Writes a new workspace and returns its id."""
    workspace = str(uuid.uuid4())
    path = folder(root, workspace)
    seen.write.parquet(f"{path}/observations")
    if estimates is not None:
        estimates.write.parquet(f"{path}/estimates")
    if boundaries is not None:
        boundaries.write.parquet(f"{path}/boundaries")
    return workspace


def load(spark: SparkSession, root: str, workspace: str, part: str = "observations") -> DataFrame:
    return spark.read.parquet(f"{folder(root, workspace)}/{part}")


def assigned(seen: DataFrame, boundaries: DataFrame | None) -> DataFrame:
    """Observations with the district that holds them; those outside all keep their own name."""
    if boundaries is None:
        return seen
    placed = spatial.assign(seen, boundaries, "longitude", "latitude")
    return placed.withColumn("district", F.coalesce("unit_name", "district")).drop("unit_idx", "unit_name")


def import_file(spark: SparkSession, root: str, path: str, active: DataFrame | None = None, boundaries: DataFrame | None = None) -> str:
    """A new workspace from a file: observations of a CSV or a model, or the active observations
    with other boundaries."""
    feeds.check_upload(spark, path)
    kind = feeds.kind_of(path)
    if kind == "boundaries":
        if active is None:
            raise ValueError("boundaries need observations to assign")
        text = spark.read.text(path, wholetext=True).first()["value"]  # one file within the upload's limit
        units = spatial.units_from_geojson(spark, text)
        return save(root, assigned(active, units), boundaries=units)
    if kind == "csv":
        seen, _ = observations.import_csv(spark, path)
        return save(root, assigned(seen.drop("line", "place"), boundaries), boundaries=boundaries)
    seen, estimates = observations.import_model(spark, path)
    return save(root, assigned(seen, boundaries), estimates, boundaries)


def refresh(spark: SparkSession, root: str, paths: dict[str, str], boundaries: DataFrame | None = None) -> tuple[str, list[str]]:
    """A new workspace from all feeds that can be read, and warnings for the others."""
    raw, warnings = feeds.union_of(spark, paths)
    seen = observations.observations(raw).where(F.col("rejected").isNull()).drop("rejected")
    return save(root, assigned(seen.dropDuplicates(["latitude", "longitude", "satellite", "date"]), boundaries), boundaries=boundaries), warnings
