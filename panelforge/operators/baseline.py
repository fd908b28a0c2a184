"""Leave-one-out seasonal baselines, annual totals and ranks, peak seasons, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import periods, scores


def neighbours(h: DataFrame, window: tuple[int, int]) -> DataFrame:
    """unit, p and, for each centre year of the window, its value and those one period before and
    after on the continuous timeline. h: unit, year, p, v on a complete spine."""
    w = Window.partitionBy("unit").orderBy(periods.timeline(F.col("year"), F.col("p")))
    near = h.select("unit", "year", "p", F.array(F.lag("v").over(w), F.col("v"), F.lead("v").over(w)).alias("near"))
    return near.where(F.col("year").between(*window)).select("unit", F.col("year").alias("centre"), "p", F.explode("near").alias("v")).where(F.col("v").isNotNull())


def leave_one_out(h: DataFrame, window: tuple[int, int]) -> DataFrame:
    """Quantiles of each cell's baseline. Only the centre year is left out, so at the first and
    last period a neighbour of the year before or after may be from the cell's own year."""
    pool = neighbours(h, window).groupBy("unit", "p").agg(F.collect_list(F.struct("centre", "v")).alias("pool"))
    own = F.array_sort(F.transform(F.filter("pool", lambda e: e["centre"] != F.col("year")), lambda e: e["v"]))
    cells = h.join(pool, ["unit", "p"], "left").withColumn("base", own).drop("pool")
    return cells.select("unit", "year", "p", "v", *_quantiles())


def _quantiles() -> list:
    """q10, q50, q90 (linear between neighbours), top and n of the sorted array `base`."""
    n = F.size("base")

    def at(q: float):
        place = (n - 1) * q
        low = F.get("base", F.floor(place).cast("int"))
        high = F.get("base", F.ceil(place).cast("int"))
        return F.when(n > 0, low + (high - low) * (place - F.floor(place)))

    return [at(0.1).alias("q10"), at(0.5).alias("q50"), at(0.9).alias("q90"), F.when(n > 0, F.get("base", n - 1)).alias("top"), F.when(n > 0, n).otherwise(0).alias("n")]


def whole_window(h: DataFrame, window: tuple[int, int]) -> DataFrame:
    """The same for unit and period with all years of the window."""
    return neighbours(h, window).groupBy("unit", "p").agg(F.array_sort(F.collect_list("v")).alias("base")).select("unit", "p", *_quantiles())


def annual(cells: DataFrame) -> DataFrame:
    """Yearly total of judged cells, its 80 % range and the judged share of land. cells: unit,
    year, p, code, h, sigma, land."""
    ok = scores.judged(F.col("code"))
    part = F.when(ok, F.col("h") * F.col("land") / 1000)
    out = cells.groupBy("unit", "year").agg(
        F.sum(part).alias("total"),
        F.sqrt(F.sum(F.when(ok, F.pow(F.col("h") * F.col("land") / 1000 * F.col("sigma"), 2)).otherwise(0.0))).alias("sd"),
        F.coalesce(F.try_divide(F.sum(F.when(ok, F.col("land")).otherwise(0.0)), F.sum("land")), F.lit(0.0)).alias("complete"),
    )
    return out.withColumns({"lo80": F.greatest(F.lit(0.0), F.col("total") - C.Z80 * F.col("sd")), "hi80": F.col("total") + C.Z80 * F.col("sd")})


def rank(years: DataFrame, least: float = 0.8) -> DataFrame:
    """Adds rank: 1 for a unit's largest total among complete years, the earlier year on ties."""
    full = F.col("complete") >= least
    w = Window.partitionBy("unit", full).orderBy(F.col("total").desc_nulls_last(), "year")
    return years.withColumn("rank", F.when(full, F.row_number().over(w)))


def peak_window(medians: DataFrame, least: int = 20) -> DataFrame:
    """Longest run of periods whose median is above the unit's 75th percentile of medians, the
    first on ties; -1 where fewer than `least` periods have a median. medians: unit, p, q50."""
    known = medians.where(F.col("q50").isNotNull())
    marks = known.groupBy("unit").agg(F.percentile("q50", F.lit(0.75)).alias("mark"), F.count(F.lit(1)).alias("known"))
    high = known.join(marks, "unit").where((F.col("q50") > F.col("mark")) & (F.col("known") >= least))
    island = F.col("p") - F.row_number().over(Window.partitionBy("unit").orderBy("p"))
    runs = high.withColumn("island", island).groupBy("unit", "island").agg(F.min("p").alias("first"), F.max("p").alias("last"), F.count(F.lit(1)).alias("n"))
    best = runs.groupBy("unit").agg(F.max_by(F.struct("first", "last"), F.struct("n", -F.col("first"))).alias("run"))
    return medians.select("unit").distinct().join(best, "unit", "left").select("unit", F.coalesce("run.first", F.lit(-1)).alias("first_p"), F.coalesce("run.last", F.lit(-1)).alias("last_p"))


def flags(cells: DataFrame, held_out_from: int) -> DataFrame:
    """Bit flags of (unit, year, p) from its sensors' cells (n_days, active, optionally proxy)."""
    short = F.bool_or((F.col("n_days") < periods.days_in_period(F.col("year"), F.col("p"))) & F.col("active"))
    proxy = F.bool_or(F.col("proxy")) if "proxy" in cells.columns else F.lit(False)
    era = F.when(F.col("year") >= held_out_from, C.FLAG_HELD_OUT).otherwise(C.FLAG_CALIBRATION)
    out = cells.groupBy("unit", "year", "p").agg(short.alias("short"), proxy.alias("lent"))
    bits = era.bitwiseOR(F.when(F.col("short"), C.FLAG_PARTIAL).otherwise(0)).bitwiseOR(F.when(F.col("lent"), C.FLAG_PROXY).otherwise(0))
    return out.select("unit", "year", "p", bits.alias("flags"))
