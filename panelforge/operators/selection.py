"""The interactive half: validated selections, area statistics, calendar, passes, manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scores

WHOLE = "Bangladesh"
RETIRING = [name for name, retiring in C.SATELLITES.items() if retiring]


@dataclass(frozen=True)
class Selection:
    year: int
    period: int
    area: str = WHOLE
    satellite: str | None = None
    grounded: bool = False
    include_low: bool = False
    include_excluded: bool = False

    @classmethod
    def parse(cls, params: dict[str, str], areas: list[str]) -> Selection:
        """A selection from query parameters; raises ValueError before any job runs."""

        def whole(name: str, low: int, high: int) -> int:
            text = params.get(name, "")
            if not text.lstrip("-").isdigit() or not low <= int(text) <= high:
                raise ValueError(f"{name} must be a whole number from {low} to {high}")
            return int(text)

        def flag(name: str) -> bool:
            if params.get(name) not in (None, "true", "false"):
                raise ValueError(f"{name} must be true or false")
            return params.get(name) == "true"

        area, satellite = params.get("area") or WHOLE, params.get("satellite") or None
        if area not in areas:
            raise ValueError("unknown area")
        if satellite and satellite not in C.SATELLITES:
            raise ValueError("unknown satellite")
        return cls(whole("year", 2003, 2100), whole("period", 0, 45), area, satellite, flag("grounded"), flag("includeLow"), flag("includeExcluded"))


def matches(s: Selection, any_satellite: bool = False, keep_retiring: bool = False, any_area: bool = False) -> Column:
    """All filters of a selection but its time, as one condition."""
    out = F.lit(True)
    if s.area != WHOLE and not any_area:
        out = out & (F.col("district") == s.area)
    if s.satellite and not any_satellite:
        out = out & (F.col("satellite") == s.satellite)
    if s.grounded and not keep_retiring:
        out = out & ~F.col("satellite").isin(RETIRING)
    if not s.include_low:
        out = out & ~F.col("low_confidence")
    if not s.include_excluded:
        out = out & ~F.col("excluded")
    return out


def in_period(rows: DataFrame, s: Selection) -> DataFrame:
    return rows.where((F.col("year") == s.year) & (F.col("period") == s.period))


def observations(rows: DataFrame, s: Selection) -> DataFrame:
    return in_period(rows, s).where(matches(s))


def overlaid(estimates: DataFrame, grounded: bool) -> DataFrame:
    """Estimates as they are, or with their grounded values; those without are dropped then."""
    if not grounded:
        return estimates
    parts = {c: F.col(f"grounded.{c}") for c in ("value", "lower", "upper", "probability")}
    return estimates.where(F.col("grounded").isNotNull()).withColumns(parts)


def area_stats(rows: DataFrame, estimates: DataFrame, areas: DataFrame, s: Selection) -> DataFrame:
    """Every area with its count, 0 where there is none, and its estimate. areas: name, place."""
    counts = in_period(rows, s).where(matches(s, any_area=True)).groupBy(F.col("district").alias("name")).agg(F.count(F.lit(1)).alias("count"))
    out = areas.join(counts, "name", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    if s.satellite:
        return out.withColumns({c: F.lit(None).cast("double") for c in ("value", "probability", "coverage")})
    e = overlaid(in_period(estimates, s), s.grounded).select(F.col("district").alias("name"), "value", "probability", "coverage")
    return out.join(e, "name", "left")


def hot_list(stats: DataFrame, adjusted: bool) -> DataFrame:
    """Areas in order of probability (unknown last) or of count, then in their own order."""
    first = F.coalesce("probability", F.lit(-1.0)) if adjusted else F.col("count")
    return stats.withColumn("position", F.row_number().over(Window.orderBy(first.desc(), "place")))


def calendar(rows: DataFrame, s: Selection) -> DataFrame:
    return rows.where(matches(s)).groupBy("year", "period").agg(F.count(F.lit(1)).alias("count"))


def calendar_models(estimates: DataFrame, s: Selection) -> DataFrame:
    """Periods with a model for the area; none when one satellite is isolated."""
    if s.satellite:
        return estimates.select("year", "period").limit(0)
    return overlaid(estimates, s.grounded).where(F.col("district") == s.area).select("year", "period").distinct()


def pass_board(rows: DataFrame) -> DataFrame:
    """Per satellite: count, days, local times of day in order, the first of them, summed power."""
    local = F.date_format(F.from_utc_timestamp("date", "Asia/Dhaka"), "HH:mm")
    seen = rows.groupBy("satellite").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_distinct(F.to_date("date")).alias("days"),
        F.array_sort(F.collect_set(F.when(F.col("time_known"), local))).alias("times"),
        F.sum(F.coalesce("frp", F.lit(0.0))).alias("frp"),
    )
    fleet = rows.sparkSession.createDataFrame([(n, r) for n, r in C.SATELLITES.items()], "satellite string, retiring boolean")
    board = fleet.join(seen, "satellite", "left")
    none = F.array().cast("array<string>")
    return board.select("satellite", "retiring", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("days", F.lit(0)).alias("days"), F.coalesce("times", none).alias("times"), F.coalesce(F.get("times", F.lit(0)), F.lit("-")).alias("time"), F.coalesce("frp", F.lit(0.0)).alias("frp"))


def fleet(rows: DataFrame, s: Selection) -> DataFrame:
    """Evidence counts and how many rows the grounded selection keeps, in one pass."""
    from dataclasses import replace

    free = replace(s, satellite=None)
    kept, total = matches(free), matches(replace(free, grounded=False))
    seen = matches(replace(s, include_low=True, include_excluded=True), keep_retiring=True)
    out = in_period(rows, s).agg(F.count_if(kept).alias("kept"), F.count_if(total).alias("total"), F.count_if(seen & F.col("low_confidence")).alias("low"), F.count_if(seen & F.col("excluded")).alias("excluded"))
    return out.withColumn("raw_retention", F.when(F.col("total") > 0, scores.round_half_up(100 * F.try_divide(F.col("kept"), F.col("total")))))


def adjusted_retention(estimates: DataFrame, first: int = 2023, last: int = 2026) -> DataFrame:
    """Share of assessed estimates whose label the grounded values leave unchanged, in whole percent."""
    held = estimates.where(F.col("year").between(first, last) & F.col("grounded").isNotNull() & (F.col("coverage") >= 30))
    same = scores.query_verdict(F.col("coverage"), F.col("probability")) == scores.query_verdict(F.col("coverage"), F.col("grounded.probability"))
    out = held.agg(F.count(F.lit(1)).alias("held"), F.count_if(same).alias("same"))
    return out.select("held", F.when(F.col("held") > 0, scores.round_half_up(100 * F.try_divide(F.col("same"), F.col("held")))).alias("adjusted_retention"))


def manifest(rows: DataFrame) -> DataFrame:
    """One row: years from the latest, latest period, count, areas in order."""
    latest = F.max_by(F.struct("year", "period"), F.col("year") * C.PERIODS + F.col("period"))
    out = rows.agg(F.sort_array(F.collect_set("year"), False).alias("years"), latest.alias("latest"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("district")).alias("areas"))
    return out.select("years", F.col("latest.year").alias("year"), F.col("latest.period").alias("period"), "n", "areas")


def full_manifest(rows: DataFrame, estimates: DataFrame, areas: DataFrame, whole: str, this_year: int | None = None) -> DataFrame:
    """One row: years of rows and estimates from the latest, the latest period of both, counts, whether
    there are estimates, the latest year that may be asked for, and the names of all areas (name of
    areas, district of rows and estimates): the whole area first, the others as a reader's language
    orders them, with accents after plain letters and capitals after small ones only on ties."""
    both = rows.select("year", "period", "district").withColumn("_e", F.lit(0)).unionByName(estimates.select("year", "period", "district").withColumn("_e", F.lit(1)))
    at = both.groupBy("year", "period").agg(F.sum("_e").alias("e"), F.count(F.lit(1)).alias("n"))  # 46 rows a year
    latest = F.max_by(F.struct("year", "period"), F.col("year") * C.PERIODS + F.col("period"))
    now = F.lit(this_year) if this_year is not None else F.year(F.current_date())
    out = at.agg(F.sort_array(F.collect_set("year"), False).alias("years"), latest.alias("latest"), F.coalesce(F.sum(F.col("n") - F.col("e")), F.lit(0)).alias("observation_count"), F.coalesce(F.sum("e"), F.lit(0)).alias("estimate_count"), F.greatest(F.max("year"), now).alias("max_year"))
    names = both.select(F.col("district").alias("name")).unionByName(areas.select("name")).where((F.col("name") != "") & (F.col("name") != whole)).distinct()
    ordered = names.agg(F.array_sort(F.collect_list(F.struct(F.collate("name", "UNICODE").alias("k"), "name"))).alias("names")).select(F.concat(F.array(F.lit(whole)), F.col("names.name")).alias("areas"))
    return out.crossJoin(ordered).select("years", "latest", "observation_count", "estimate_count", (F.col("estimate_count") > 0).alias("has_estimates"), "max_year", "areas")  # one row each


def answer(rows: DataFrame, estimates: DataFrame, areas: DataFrame, s: Selection) -> DataFrame:
    """One row that answers a selection: its rows, the area's estimate, every area's count and
    estimate in order, passes by satellite, evidence by satellite, and the fleet's retention."""
    from dataclasses import replace

    chosen = observations(rows, s).agg(F.array_sort(F.collect_list(F.struct("id", "district", "satellite", "frp"))).alias("rows"))
    models = overlaid(in_period(estimates, s), s.grounded).where(F.col("district") == s.area)
    estimate = models.agg(F.first(F.struct("value", "lower", "upper", "probability", "coverage")).alias("estimate"))
    stats = area_stats(rows, estimates, areas, s).agg(F.array_sort(F.collect_list(F.struct("place", "name", "count", "probability", "coverage"))).alias("stats"))
    order = F.create_map(*[F.lit(x) for pair in ((n, k) for k, n in enumerate(C.SATELLITES)) for x in pair])
    seen = in_period(rows, s).where(matches(replace(s, include_low=True, include_excluded=True), any_satellite=True, keep_retiring=True))
    board = pass_board(seen).withColumns({"k": F.try_element_at(order, F.col("satellite")), "off": F.col("retiring") & F.lit(s.grounded)})
    passes = board.agg(F.array_sort(F.collect_list(F.struct("k", "satellite", "count", "days", "times", "off"))).alias("passes"))
    evidence_rows = in_period(rows, s).where(matches(replace(s, include_low=True, include_excluded=True), keep_retiring=True))
    counts = pass_board(evidence_rows).withColumn("k", F.try_element_at(order, F.col("satellite")))
    by_satellite = counts.agg(F.array_sort(F.collect_list(F.struct("k", "satellite", "count"))).alias("by_satellite"))
    out = fleet(rows, s)
    for part in (chosen, estimate, stats, passes, by_satellite):  # one row each
        out = out.crossJoin(part)
    return out


def evidence(rows: DataFrame, s: Selection) -> DataFrame:
    """One JSON document: the selection's parameters and its observations in order of id."""
    chosen = F.struct(*[F.lit(v).cast("string" if k == "satellite" else "string" if isinstance(v, str) else "boolean" if isinstance(v, bool) else "int").alias(k) for k, v in vars(s).items()])
    seen = observations(rows, s).agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("observations"))
    return seen.select(F.to_json(F.struct(F.lit(1).alias("version"), chosen.alias("selection"), "observations"), {"ignoreNullFields": "false"}).alias("value"))


def full_evidence(rows: DataFrame, estimates: DataFrame, s: Selection, provenance: str, fetched_at: str, warnings: tuple[str, ...] = ()) -> DataFrame:
    """One JSON document: the selection, where its data are from and when they were fetched, its
    observations in order of id, the area's estimate if there is one, and warnings."""
    chosen = F.struct(*[F.lit(v).cast("string" if v is None or isinstance(v, str) else "boolean" if isinstance(v, bool) else "int").alias(k) for k, v in vars(s).items()])
    seen = observations(rows, s).agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("observations"))
    models = overlaid(in_period(estimates, s), s.grounded).where(F.col("district") == s.area)
    estimate = models.agg(F.collect_list(F.struct("district", "value", "lower", "upper", "probability", "coverage")).alias("estimates"))  # one at most
    said = F.array(*map(F.lit, warnings)) if warnings else F.array().cast("array<string>")
    facts = [F.lit(1).alias("version"), chosen.alias("selection"), F.lit(provenance).alias("provenance"), F.lit(fetched_at).alias("fetched_at"), "observations", "estimates", said.alias("warnings")]
    return seen.crossJoin(estimate).select(F.to_json(F.struct(*facts), {"ignoreNullFields": "false"}).alias("value"))  # one row each


def table_rows(rows: DataFrame, most: int = 500) -> DataFrame:
    """The rows that a table shows: the first in order of time, then id."""
    return rows.orderBy("date", "id").limit(most)
