"""Panels: sensor x unit x year x period from detections and daily coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import periods, scores

CELL = ["s", "unit", "year", "p"]
COUNTRY = -1


def spine(units: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Every unit, year and period; the frame on which missing rows become visible."""
    times = units.sparkSession.range((last_year - first_year + 1) * C.PERIODS).select((F.lit(first_year) + F.floor(F.col("id") / C.PERIODS)).cast("int").alias("year"), (F.col("id") % C.PERIODS + 1).cast("int").alias("p"))
    return units.select("unit").distinct().crossJoin(F.broadcast(times))


def counts(detections: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Kept detections d, those at night dn, static and low-confidence ones apart."""
    x = F.col("x")
    return detections.groupBy(*keys).agg(
        F.count_if(x == 0).alias("d"),
        F.count_if((x == 0) & F.col("night")).alias("dn"),
        F.count_if(x == 1).alias("ex_static"),
        F.count_if(x == 2).alias("ex_low"),
    )


def with_country(cells: DataFrame, sums: list[str], keys: list[str] = CELL, least: tuple[str, ...] = (), units: DataFrame | None = None) -> DataFrame:
    """Adds the country as unit -1: sums of the units, null where all are null. least: counts of which
    the country has the smallest of all units, 0 where a unit (of units) has no row."""
    rest = [k for k in keys if k != "unit"]
    whole = cells.groupBy(*rest).agg(*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in least], F.count_distinct("unit").alias("_units"))
    if least:
        n = units.select(F.count_distinct("unit").alias("_all"))  # one row
        whole = whole.crossJoin(F.broadcast(n)).withColumns({c: F.when(F.col("_units") < F.col("_all"), 0).otherwise(F.col(c)) for c in least})
    return cells.select(*keys, *sums, *least).unionByName(whole.withColumn("unit", F.lit(COUNTRY)).select(*keys, *sums, *least))


def power(detections: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Sum and exact median of the power of kept detections."""
    return detections.where(F.col("x") == 0).groupBy(*keys).agg(F.sum("frp").alias("frp_sum"), F.median("frp").alias("frp_p50"))


def coverage_cells(daily: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Clear, cloudy and missing area of a cell, days seen and coverage share."""
    out = daily.groupBy(*keys).agg(F.sum("clear").alias("clear"), F.sum("cloud").alias("cloud"), F.sum("land").alias("land"), F.count_distinct("date").alias("n_days"))
    missing = F.col("land") - F.col("clear") - F.col("cloud")
    return out.withColumns({"missing": missing, "coverage": F.try_divide("clear", "land")})


def unit_land(daily: DataFrame) -> DataFrame:
    """Largest land area that any sensor saw of a unit on a day."""
    per_day = daily.groupBy("s", "unit", "date").agg(F.sum("land").alias("land"))
    return per_day.groupBy("unit").agg(F.max("land").alias("land"))


def period_land(daily: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Land area times days of every unit's periods, the same for all sensors."""
    frame = spine(daily, first_year, last_year)
    days = periods.days_in_period(F.col("year"), F.col("p"))
    return frame.join(unit_land(daily), "unit").select("unit", "year", "p", (F.col("land") * days).alias("land_days"))


def daily_coverage(parts: DataFrame, order: list[Column]) -> DataFrame:
    """One row for each satellite, day and unit: repeated (sat, tile, date, unit) rows count once, tiles are added."""
    first = parts.withColumn("_n", F.row_number().over(Window.partitionBy("sat", "tile", "date", "unit").orderBy(*order))).where(F.col("_n") == 1)
    return first.groupBy("sat", "date", "unit").agg(F.sum("clear").alias("clear"), F.sum("cloud").alias("cloud"), F.sum("land").alias("land"))


def seen_percent(daily: DataFrame) -> DataFrame:
    """Whole percent of clear land, half to even; -1 where there is no land."""
    return daily.withColumn("seen", F.coalesce(F.bround(F.try_divide(100 * F.col("clear"), F.col("land"))).cast("int"), F.lit(-1)))


def with_proxy(native: DataFrame, sensors: list[int], reference: int = C.REFERENCE_SENSOR) -> DataFrame:
    """Adds the reference sensor's coverage for sensors without any of their own (proxy = true)."""
    own = native.select("s").distinct()
    wanted = native.sparkSession.createDataFrame([(s,) for s in sensors], "s int")
    lacking = wanted.join(own, "s", "left_anti").withColumnRenamed("s", "to")
    lent = native.where(F.col("s") == reference).crossJoin(F.broadcast(lacking)).withColumn("s", F.col("to")).drop("to")
    return native.withColumn("proxy", F.lit(False)).unionByName(lent.withColumn("proxy", F.lit(True)))


def sensor_windows(detections: DataFrame, daily: DataFrame, first_year: int) -> DataFrame:
    """First and last day of each sensor's series: coverage decides for sensors 0 and 1, the
    first detection for the others; the end is the last day of the last year."""
    d = detections.groupBy("s").agg(F.to_date(F.min("t")).alias("first_seen"), F.max("year").alias("last_year"))
    c = daily.groupBy("s").agg(F.min("date").alias("first_covered"))
    begin = F.greatest(F.make_date(F.lit(first_year), F.lit(1), F.lit(1)), F.coalesce("first_covered", F.to_date(F.lit("2100-01-01"))))
    return d.join(c, "s", "left").select("s", F.when(F.col("s") < 2, begin).otherwise(F.col("first_seen")).alias("start"), F.make_date("last_year", F.lit(12), F.lit(31)).alias("end"))


def active(cells: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds active: the whole period lies in the sensor's window and some day was seen."""
    joined = cells.join(F.broadcast(windows), "s", "left")
    start, end = periods.period_start(F.col("year"), F.col("p")), periods.period_end(F.col("year"), F.col("p"))
    return joined.withColumn("active", F.coalesce((start >= F.col("start")) & (end <= F.col("end")) & (F.col("n_days") > 0), F.lit(False))).drop("start", "end")


def rates(cells: DataFrame, min_coverage: float = C.MIN_COVERAGE, min_land: float = C.MIN_LAND) -> DataFrame:
    """Valid cells with rate rho, night share ns and season terms."""
    valid = scores.valid_cell(F.lit(True), F.col("coverage"), F.col("land"), F.col("d"), min_coverage, min_land)
    sn, cs = periods.season(F.col("p"))
    return cells.where(valid).withColumns({"rho": scores.rate(F.col("d"), F.col("clear")), "ns": scores.night_share(F.col("dn"), F.col("d")), "sn": sn, "cs": cs})


def sensor_pairs(cells: DataFrame, frm: int, to: int) -> DataFrame:
    """Cells that are valid for both sensors, side by side."""
    key = ["unit", "year", "p"]
    a = cells.where(F.col("s") == frm).select(*key, F.col("d").alias("d_from"), F.col("rho").alias("rho_from"), F.col("ns").alias("ns_from"), "sn", "cs")
    b = cells.where(F.col("s") == to).select(*key, F.col("d").alias("d_to"), F.col("rho").alias("rho_to"), F.col("clear").alias("clear_to"))
    return a.join(b, key)


def estimates(detections: DataFrame) -> DataFrame:
    """Log estimate and its spread for each observed cell, from its count alone."""
    return counts(detections).where(F.col("d") > 0).select(*CELL, "d", F.ln(1 + F.col("d")).alias("mu"), F.try_divide(F.lit(1.0), F.sqrt(F.col("d") + 0.5)).alias("sigma"))


def combine(cells: DataFrame, r: float, disabled: tuple[int, ...] = (), keys: tuple[str, ...] = ("unit", "year", "p")) -> DataFrame:
    """Inverse-variance mean over sensors, widened for their common correlation r."""
    usable = cells.where(F.col("mu").isNotNull() & (F.col("sigma") > 0) & ~F.isnan("mu") & ~F.isnan("sigma"))
    if disabled:
        usable = usable.where(~F.col("s").isin(*disabled))
    w = 1 / (F.col("sigma") * F.col("sigma"))
    sums = usable.groupBy(*keys).agg(F.sum(w).alias("w"), F.sum(w * F.col("mu")).alias("wm"), F.count(F.lit(1)).alias("n_used"))
    return sums.select(*keys, (F.col("wm") / F.col("w")).alias("mu"), F.sqrt((1 + (F.col("n_used") - 1) * r) / F.col("w")).alias("sigma"), "n_used")
