"""Static heat sources: cells learned from repeated, long-season activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C


def with_cell(points: DataFrame, grid: float = C.STATIC_GRID) -> DataFrame:
    return points.withColumns({"cx": F.floor(F.col("lon") / grid).cast("int"), "cy": F.floor(F.col("lat") / grid).cast("int")})


def learn(cells: DataFrame, train: tuple[int, int] = C.STATIC_TRAIN, detections: int = C.STATIC_DETECTIONS, days: int = C.STATIC_DAYS, months: int = C.STATIC_MONTHS, years: int = C.STATIC_YEARS) -> DataFrame:
    """cx, cy of the mask and n_years that passed. cells: cx, cy, t."""
    year = F.year("t")
    seen = cells.where(year.between(*train)).groupBy("cx", "cy", year.alias("year"))
    stats = seen.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.to_date("t")).alias("days"), F.count_distinct(F.month("t")).alias("months"))
    good = stats.where((F.col("n") >= detections) & (F.col("days") >= days) & (F.col("months") >= months))
    return good.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n_years")).where(F.col("n_years") >= years)


def apply(cells: DataFrame, mask: DataFrame, wide: str) -> DataFrame:
    """Adds static: the cell is masked or, where column `wide` is true (coarse pixels), one of its
    neighbours is. The mask side is widened, so detections are never multiplied."""
    exact = mask.select("cx", "cy").withColumn("w", F.lit(False))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = mask.withColumn("d", F.explode(steps)).select((F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy")).distinct().withColumn("w", F.lit(True))
    marks = exact.unionByName(around).withColumn("static", F.lit(True)).withColumnRenamed("w", wide)
    return cells.join(marks, ["cx", "cy", wide], "left").withColumn("static", F.coalesce("static", F.lit(False)))
