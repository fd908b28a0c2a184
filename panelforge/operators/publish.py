"""Published shapes: nested arrays and documents for each year, period, unit or region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scores
from .ordering import numbered

#: Fields and their kinds that a document of each shape must have.
REQUIRED = {
    "snapshot": {"year": "int", "units": "array", "verdict": "array", "raw": "array"},
    "detections": {"year": "int", "period": "int", "s": "array", "t": "array", "frp": "array", "x": "array", "u": "array"},
    "daily": {"year": "int", "days": "int", "seen": "array"},
    "health": {"stages": "map", "ok": "boolean"},
    "provenance": {"datasets": "array"},
}
MAX_DROPPED = 0.15


def check_shape(df: DataFrame, kind: str) -> DataFrame:
    """df, if its columns have the fields of a shape; raises ValueError before any job runs."""
    have = {name: dtype.split("<")[0] for name, dtype in df.dtypes}
    for name, dtype in REQUIRED[kind].items():
        if have.get(name, "").replace("bigint", "int").replace("smallint", "int") != dtype:
            raise ValueError(f"{kind} needs {name} as {dtype}")
    return df


def grid(cells: DataFrame, outer: list[str], unit: str, at: str, values: dict[str, Column]) -> DataFrame:
    """For each outer key: unit as an array, and each value as an array [unit][at], nulls kept.
    cells must have every unit and place once, so that arrays are parallel."""
    rows = cells.groupBy(*outer, unit).agg(F.array_sort(F.collect_list(F.struct(at, *[v.alias(c) for c, v in values.items()]))).alias("_r"))
    rows = rows.select(*outer, unit, *[F.col(f"_r.{c}").alias(c) for c in values])
    whole = rows.groupBy(*outer).agg(F.array_sort(F.collect_list(F.struct(unit, *values))).alias("_u"))
    return whole.select(*outer, F.col(f"_u.{unit}").alias("units"), *[F.col(f"_u.{c}").alias(c) for c in values])


def snapshots(cells: DataFrame) -> DataFrame:
    """One row a year: verdicts, counts and estimates (thousandths) as [unit][period]. cells:
    unit, year, p, code, d, mu, sigma on the complete frame."""
    thousandths = lambda c: F.bround(F.col(c) * 1000).cast("long")
    out = grid(cells, ["year"], "unit", "p", {"verdict": F.col("code"), "raw": F.col("d"), "mu": thousandths("mu"), "sigma": thousandths("sigma")})
    return check_shape(out, "snapshot")


def sensor_grid(cells: DataFrame, units: DataFrame, sensors: int, values: dict[str, Column]) -> DataFrame:
    """year and each value as an array [sensor][unit][period], null where there is no cell. cells: s, unit,
    year, p; units: unit. The frame of a year has every sensor, unit and period."""
    years = cells.select("year").distinct()
    frame = years.crossJoin(F.broadcast(units.select("unit").distinct()))  # the units of a region
    frame = frame.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(sensors - 1)))).withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(C.PERIODS))))
    full = frame.join(cells.select("s", "unit", "year", "p", *[v.alias(c) for c, v in values.items()]), ["s", "unit", "year", "p"], "left")
    planes = grid(full, ["year", "s"], "unit", "p", {c: F.col(c) for c in values})
    cubes = planes.groupBy("year").agg(F.array_sort(F.collect_list(F.struct("s", "units", *values))).alias("_s"))
    return cubes.select("year", F.get("_s.units", F.lit(0)).alias("units"), *[F.col(f"_s.{c}").alias(c) for c in values])


def sensor_snapshots(judged: DataFrame, cells: DataFrame, units: DataFrame, raw_base: DataFrame) -> DataFrame:
    """One row a year with the whole snapshot: comb, verdict, p_hi, p_lo, base and raw_base as
    [unit][period]; raw, cov, excl, per, clear_km2d and n_passes as [sensor][unit][period].

    judged: every unit, year and p with mu, sigma, code, p_hi, p_lo, q10, q50, q90, top and n; cells: s,
    unit, year, p, d, ex_static, ex_low, coverage, clear, n_passes, mu, sigma; raw_base: unit, year, p, q10, q90."""
    to = lambda c, places: F.bround(F.col(c), places)
    whole = judged.join(raw_base.select("unit", "year", "p", F.col("q10").alias("_low"), F.col("q90").alias("_high")), ["unit", "year", "p"], "left")
    flat = grid(whole, ["year"], "unit", "p", {
        "mu": to("mu", 3), "sigma": to("sigma", 3), "verdict": F.col("code"), "p_hi": to("p_hi", 3), "p_lo": to("p_lo", 3), "q10": to("q10", 3), "q50": to("q50", 3), "q90": to("q90", 3), "top": to("top", 3), "n": F.col("n"), "raw_low": to("_low", 1), "raw_high": to("_high", 1),
    })
    cubes = sensor_grid(cells, units, len(C.SENSORS), {"raw": F.col("d"), "cov": to("coverage", 2), "static": F.col("ex_static"), "lowconf": F.col("ex_low"), "clear_km2d": to("clear", 0), "n_passes": F.col("n_passes"), "per_mu": to("mu", 3), "per_sigma": to("sigma", 3)})
    both = flat.join(cubes.drop("units"), "year")
    pick = lambda **names: F.struct(*[F.col(c).alias(n) for n, c in names.items()])
    return both.select(
        "year", "units", pick(mu="mu", sigma="sigma").alias("comb"), "verdict", "p_hi", "p_lo", "cov", "raw", pick(static="static", lowconf="lowconf").alias("excl"), pick(mu="per_mu", sigma="per_sigma").alias("per"),
        pick(q10="q10", q50="q50", q90="q90", max="top", n="n").alias("base"), pick(q10="raw_low", q90="raw_high").alias("raw_base"), "clear_km2d", "n_passes",
    )


def detections(rows: DataFrame, most: int | None = None) -> DataFrame:
    """One row for each year and period with parallel arrays in order of time. rows: id, s, t,
    frp, x, unit, year, p; t becomes minutes since 2000. most: with a limit, a period is so many
    documents (part from 0, in order of time) of at most that many detections, and none is gathered whole."""
    minutes = F.floor((F.unix_timestamp("t") - F.unix_timestamp(F.lit("2000-01-01").cast("timestamp"))) / 60)
    one = F.struct(minutes.alias("t"), "id", F.col("s").cast("int").alias("s"), F.bround(F.col("frp")).cast("long").alias("frp"), F.col("x").cast("int").alias("x"), F.col("unit").cast("int").alias("u"))
    keys, names = ["year", F.col("p").alias("period")], ("s", "t", "frp", "x", "u")
    if most:
        placed = numbered(rows, ["year", "p"], F.to_date("t"), ["t", "id"], "_place")
        rows, keys = placed.withColumn("part", F.floor((F.col("_place") - 1) / most).cast("int")), [*keys, "part"]
    out = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("_r"))
    return check_shape(out.select(*[k for k in out.columns if k != "_r"], *[F.col(f"_r.{c}").alias(c) for c in names]), "detections")


def daily(seen: DataFrame, units: DataFrame) -> DataFrame:
    """One row a year: percent seen as [unit][day], -1 where there is no row. seen: date, unit,
    seen; units: unit. The frame of units and days of a year is small and exact."""
    spans = seen.groupBy(F.year("date").alias("year")).agg(F.lit(1).alias("_"))
    days = spans.select("year", F.explode(F.sequence(F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31)))).alias("date"))
    frame = days.crossJoin(F.broadcast(units.select("unit").distinct()))  # the units of a region
    full = frame.join(seen.select("date", "unit", "seen"), ["date", "unit"], "left").withColumn("day", F.dayofyear("date"))
    out = grid(full, ["year"], "unit", "day", {"seen": F.coalesce(F.col("seen"), F.lit(-1))})
    return check_shape(out.withColumn("days", F.size(F.get("seen", F.lit(0)))), "daily")


def published_codes(cells: DataFrame, active: DataFrame) -> DataFrame:
    """Codes with -1 where no sensor was active in the period. active: unit, year, p, active."""
    some = active.groupBy("unit", "year", "p").agg(F.bool_or("active").alias("_some"))
    return cells.join(some, ["unit", "year", "p"], "left").withColumn("code", F.when(F.coalesce("_some", F.lit(False)), F.col("code")).otherwise(C.NOT_ACTIVE)).drop("_some")


def dropped_gate(reconciled: DataFrame, most: float = MAX_DROPPED) -> DataFrame:
    """Adds refused: more rows of the key were dropped than a publication allows."""
    return reconciled.withColumn("refused", F.col("dropped") > most)


def eligible(cells: DataFrame, first_year: int = 2003) -> DataFrame:
    """Estimates that may leave: judged ones with ordered limits, unobserved ones as zeros, from
    the first year on, where some coverage is known. cells: mu, sigma, p_hi, code, coverage, q50."""
    ok = (F.col("code").between(C.NOT_OBSERVED, C.RECORD)) & (F.col("year") >= first_year) & F.col("coverage").isNotNull()
    judged = scores.judged(F.col("code"))
    limits = scores.intervals(F.col("mu"), F.col("sigma"))
    shown = lambda v, places: F.when(judged, F.round(v, places)).otherwise(0.0)
    return cells.where(ok).select(
        "unit", "year", (F.col("p") - 1).alias("period"), shown(limits["h"], 5).alias("value"), shown(F.least(limits["lo80"], limits["h"]), 5).alias("lower"), shown(F.greatest(limits["hi80"], limits["h"]), 5).alias("upper"),
        shown(F.col("p_hi"), 4).alias("probability"), F.round(F.col("coverage") * 100, 1).alias("coverage"), F.coalesce(F.round("q50", 5), F.lit(0.0)).alias("baselineMedian"),
    )


def provenance_text(windows: DataFrame, proxied: bool, train: tuple[int, int]) -> DataFrame:
    """One row: where the data end, what coverage is from, and which years trained the model."""
    through = F.date_format(F.max("end"), "yyyy-MM-dd")
    source = "proxied from the reference sensor" if proxied else "native"
    return windows.agg(F.concat(F.lit("detections through "), through, F.lit(f"; coverage {source}; trained on {train[0]}-{train[1]}")).alias("provenance"))


def health(stages: DataFrame) -> DataFrame:
    """One row: each stage's state, and whether all are well. stages: stage, ok, at."""
    out = stages.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", F.struct("ok", "at"))))).alias("stages"), F.bool_and("ok").alias("ok"))
    return check_shape(out, "health")


def meta(units: DataFrame, windows: DataFrame) -> DataFrame:
    """One row: constants of the model, sensors with their windows, units in order of parent and name."""
    sensors = windows.agg(F.array_sort(F.collect_list(F.struct("s", "start", "end"))).alias("sensors"))
    names = units_in_order(units).agg(F.array_sort(F.collect_list(F.struct("idx", "name", "parent"))).alias("units"))
    fixed = [F.lit(C.PERIODS).alias("periods"), F.lit(C.MIN_COVERAGE).alias("min_coverage"), F.lit(C.P_SURE).alias("p_sure"), F.lit(C.P_MAYBE).alias("p_maybe"), F.lit(C.MIN_BASELINE_N).alias("min_baseline_n")]
    return sensors.crossJoin(names).select("sensors", "units", *fixed)  # one row each


def units_in_order(units: DataFrame) -> DataFrame:
    """Adds idx: the place in order of parent and name, from 0. A region's units are few."""
    from pyspark.sql import Window

    return units.withColumn("idx", F.row_number().over(Window.orderBy("parent", "name")) - 1)


def latest_feed(rows: DataFrame, days: int = 7) -> DataFrame:
    """The live shape: detections of the last days before the newest one, counted by sensor and day."""
    newest = rows.agg(F.to_date(F.max("t")).alias("_newest"))  # one row
    recent = rows.crossJoin(F.broadcast(newest)).where(F.datediff("_newest", F.to_date("t")) < days)
    return recent.groupBy("s", F.to_date("t").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("through"))
