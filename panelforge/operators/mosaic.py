"""Pixels of a mosaic at several levels: each cell has the class that most of its pixels have.

Levels are a quad-tree: a cell of level k covers 2**k by 2**k pixels and its class counts are the sums
of the four cells below, so every level's class is that of the pixels themselves, and each level
shuffles the counts of the one before. Pixels without data (class 0) count only where nothing else
does; ties go to the smallest class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_DATA = 0


def pyramid(pixels: DataFrame, levels: int) -> DataFrame:
    """level (0 to levels), x, y, klass of all cells that have pixels. pixels: x, y, klass."""
    counts = pixels.groupBy("x", "y", F.coalesce("klass", F.lit(NO_DATA)).alias("klass")).agg(F.count(F.lit(1)).alias("n"))
    out = None
    for level in range(levels + 1):
        if level:
            counts = counts.groupBy(F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"), "klass").agg(F.sum("n").alias("n"))
        most = F.max_by("klass", F.struct((F.col("klass") != NO_DATA).alias("data"), "n", -F.col("klass")))
        cells = counts.groupBy("x", "y").agg(most.alias("klass")).select(F.lit(level).alias("level"), "x", "y", "klass")
        out = cells if out is None else out.unionByName(cells)
    return out


def _range(low: str, high: str) -> Column:
    return F.explode(F.sequence(low, high))


def tiles(cells: DataFrame, size: int) -> DataFrame:
    """level, tx, ty and pixels (classes by row, then column) of all tiles of size x size cells in the
    box of each level; cells and whole tiles that are missing are 0."""
    corner = cells.groupBy("level").agg(*[f(F.floor(F.col(c) / size)).alias(n + c) for c in "xy" for f, n in ((F.min, "low_"), (F.max, "high_"))])
    frame = corner.withColumn("tx", _range("low_x", "high_x")).withColumn("ty", _range("low_y", "high_y")).select("level", "tx", "ty", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("at"))
    placed = cells.select("level", F.floor(F.col("x") / size).alias("tx"), F.floor(F.col("y") / size).alias("ty"), (F.pmod("y", F.lit(size)) * size + F.pmod("x", F.lit(size))).cast("int").alias("at"), "klass")
    filled = frame.join(placed, ["level", "tx", "ty", "at"], "left")
    rows = filled.groupBy("level", "tx", "ty").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("klass", F.lit(NO_DATA)).alias("klass")))).alias("_p"))
    return rows.select("level", "tx", "ty", F.col("_p.klass").alias("pixels"))
