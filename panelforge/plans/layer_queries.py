"""The interactive half, imports, exports and geometry on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import geo, periods, scores
from ..operators import export, ordering, passes, selection, spatial
from ..sources import fixtures as fx
from ..sources import observations as obs_source
from ..sources.fixtures import SQL_DETECTIONS as DET
from ..sources.fixtures import SQL_FEED as FEED
from ..operators.selection import Selection
from . import panel_queries

AREA = "NATION_7"
CHOICE = Selection(1997, 12, grounded=True)
NAMES = ("Terra", "Aqua", "S-NPP", "NOAA-20", "NOAA-21")

SQUARE = '{"type":"FeatureCollection","features":[%s]}' % ",".join(
    '{"type":"Feature","properties":{"shapeName":"%s"},"geometry":{"type":"%s","coordinates":%s}}' % f
    for f in (
        ("ring", "Polygon", "[[[88.05,20.65],[90.05,20.65],[90.05,22.65],[88.05,22.65],[88.05,20.65]],[[88.55,21.15],[89.55,21.15],[89.55,22.15],[88.55,22.15],[88.55,21.15]]]"),
        ("pair", "MultiPolygon", "[[[[90.15,20.65],[91.15,20.65],[91.15,21.65],[90.15,21.65],[90.15,20.65]]],[[[91.55,22.65],[92.55,22.65],[92.55,23.65],[91.55,23.65],[91.55,22.65]]]]"),
        ("wide", "Polygon", "[[[88.05,22.75],[92.55,22.75],[92.55,26.65],[88.05,26.65],[88.05,22.75]]]"),
    )
)


def observations(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.detections(spark, sf).join(fx.units(spark, sf).select("unit", F.col("name").alias("district")), "unit")
    return d.select(
        "id", "district", F.element_at(F.array(*map(F.lit, NAMES)), F.col("s") + 1).alias("satellite"), F.col("t").alias("date"), "year", (F.col("p") - 1).alias("period"), "frp",
        (F.col("x") == 2).alias("low_confidence"), (F.col("x") == 1).alias("excluded"), (F.col("id") % 10 != 0).alias("time_known"),
    )


def estimates(spark: SparkSession, sf: str) -> DataFrame:
    n = observations(spark, sf).groupBy("district", "year", "period").agg(F.count(F.lit(1)).cast("double").alias("n"))
    k = F.col("n")
    grounded = F.when((F.col("year") + F.col("period")) % 3 != 0, F.struct((k * 0.8).alias("value"), (k * 0.4).alias("lower"), (k * 1.6).alias("upper"), (k / (k + 2)).alias("probability")))
    return n.select("district", "year", "period", k.alias("value"), (k * 0.5).alias("lower"), (k * 2).alias("upper"), (k / (k + 1)).alias("probability"), ((F.col("year") * 7 + F.col("period") * 3) % 101).cast("double").alias("coverage"), k.alias("baselineMedian"), grounded.alias("grounded"))


OBS = f"""{DET}, obs AS (SELECT id, n_name AS district, CASE s WHEN 0 THEN 'Terra' WHEN 1 THEN 'Aqua' WHEN 2 THEN 'S-NPP' WHEN 3 THEN 'NOAA-20' ELSE 'NOAA-21' END AS satellite,
  t AS date, year, p - 1 AS period, frp, x = 2 AS low_confidence, x = 1 AS excluded, id % 10 <> 0 AS time_known FROM det JOIN nation ON unit = n_nationkey),
nc AS (SELECT district, year, period, count(*)::DOUBLE AS n FROM obs GROUP BY ALL),
est AS (SELECT district, year, period, n AS value, n / (n + 1) AS probability, ((year * 7 + period * 3) % 101)::DOUBLE AS coverage, (year + period) % 3 <> 0 AS g, n * 0.8 AS gvalue, n / (n + 2) AS gprobability FROM nc)"""
KEPT = "NOT low_confidence AND NOT excluded"
NEWER = "satellite NOT IN ('Terra', 'Aqua', 'S-NPP')"


def select_observations(spark: SparkSession, sf: str) -> DataFrame:
    chosen = selection.observations(observations(spark, sf), CHOICE)
    return chosen.select("id", "district", "satellite", "frp")


def area_stats(spark: SparkSession, sf: str) -> DataFrame:
    areas = fx.units(spark, sf).select("name", F.col("unit").alias("place"))
    out = selection.hot_list(selection.area_stats(observations(spark, sf), estimates(spark, sf), areas, CHOICE), adjusted=True)
    label = scores.query_verdict(F.col("coverage"), F.col("probability"))
    return out.select("name", "count", F.round("probability", 6).alias("probability"), label.alias("label"), F.col("position").cast("int"))


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    o, e = observations(spark, sf), estimates(spark, sf)
    s = Selection(1997, 0, area=AREA, include_low=True)
    counts = selection.calendar(o, s)
    models = selection.calendar_models(e, s).withColumn("model", F.lit(True))
    return counts.join(models, ["year", "period"], "full").select("year", "period", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("model", F.lit(False)).alias("model"))


def calendar_all(spark: SparkSession, sf: str) -> DataFrame:
    """Counts for every district, satellite and flag at once: the table that calendars are read from."""
    return observations(spark, sf).groupBy("year", "period", "district", "satellite", "low_confidence", "excluded").agg(F.count(F.lit(1)).alias("count"))


def pass_board(spark: SparkSession, sf: str) -> DataFrame:
    board = selection.pass_board(selection.in_period(observations(spark, sf), CHOICE))
    return board.select("satellite", "retiring", "count", "days", F.array_join("times", ",").alias("times"), "time", F.round("frp", 4).alias("frp"))


def fleet_retention(spark: SparkSession, sf: str) -> DataFrame:
    return selection.fleet(observations(spark, sf), CHOICE)


def adjusted_retention(spark: SparkSession, sf: str) -> DataFrame:
    return selection.adjusted_retention(estimates(spark, sf), 1998, 2001)


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    m = selection.manifest(observations(spark, sf))
    return m.select(F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"), "year", "period", "n", F.array_join("areas", ",").alias("areas"))


def _accented(name, k):
    """Names with accents and small letters in places."""
    return F.when(k % 4 == 0, F.lower(name)).when(k % 4 == 1, F.concat(F.lit("\u00e9"), name)).when(k % 4 == 2, F.concat(F.lit("Zo\u00eb "), name)).otherwise(name)


def full_manifest(spark: SparkSession, sf: str) -> DataFrame:
    rows, models = observations(spark, sf), estimates(spark, sf).where("year < 2000").withColumn("year", F.col("year") + 3)
    k = F.substring_index("district", "_", -1).cast("int")
    accented = lambda d: d.withColumn("district", _accented(F.col("district"), k))
    m = selection.full_manifest(accented(rows), accented(models), fx.units(spark, sf).select(F.col("parent").alias("name")), "Whole land", 2026)
    text = lambda c: F.array_join(F.transform(c, lambda y: y.cast("string")), ",")
    return m.select(text("years").alias("years"), F.col("latest.year").alias("year"), F.col("latest.period").alias("period"), "observation_count", "estimate_count", "has_estimates", "max_year", text("areas").alias("areas"))


def model_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Estimates that an import would refuse, after spoiling every seventh district and year."""
    e = estimates(spark, sf).withColumn("lower", F.when((F.length("district") + F.col("year")) % 7 == 0, F.col("value") + 1).otherwise(F.col("lower")))
    e = e.withColumn("year", F.col("year") + 10)
    return obs_source.bad_estimates(e).select("district", "year", "period")


def import_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Feed rows as the text of a user's file, some of them spoiled, through the import's checks."""
    f = fx.feed(spark, sf)
    k = F.col("id") % 11
    rows = f.select(
        "id",
        F.when(k == 0, "abc").otherwise(F.format_number("lat", 1)).alias("latitude"),
        F.when(k == 1, "999").otherwise(F.format_number("lon", 1)).alias("longitude"),
        F.when(k == 2, "2024-02-30").otherwise(F.date_format("t", "yyyy-MM-dd")).alias("acq_date"),
        F.when(k == 3, "2561").when(k == 4, "").otherwise(F.date_format("t", "HHmm")).alias("acq_time"),
        F.when(k == 5, "X9").when(k == 6, "suomi npp").otherwise("n20").alias("satellite"),
        F.when(k == 7, "low").otherwise((F.col("k") % 101).cast("string")).alias("confidence"),
        F.lit("1.5").alias("frp"),
        F.when(k == 8, "TRUE").otherwise("no").alias("excluded"),
    )
    seen = obs_source.observations(rows)
    return seen.groupBy("rejected", "satellite", "low_confidence", "excluded", "time_known", "year", "period").agg(F.count(F.lit(1)).alias("n"))


def normalized_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Feed rows in the raw files' form through the reader's normalisation, both families."""
    f = fx.feed(spark, sf)
    raw = f.select(
        "id", F.lit("23.5").alias("latitude"), F.lit("90.1").alias("longitude"), F.date_format("t", "yyyy-MM-dd").alias("acq_date"), F.date_format("t", "Hmm").alias("acq_time"),
        F.when(F.col("id") % 3 == 0, "Terra").when(F.col("id") % 3 == 1, "N20").otherwise("N21").alias("satellite"), F.when(F.col("k") % 4 == 0, "high").otherwise((F.col("k") % 101).cast("string")).alias("confidence"),
        F.when(F.col("id") % 5 == 0, "n/a").otherwise("2.5").alias("frp"), F.when(F.col("id") % 2 == 0, "N").otherwise("D").alias("daynight"), F.when(F.col("id") % 7 == 0, None).otherwise("2").alias("type"),
    )
    parts = [obs_source.normalize(raw, kind).withColumn("kind", F.lit(kind)) for kind in ("T+A", "N")]
    both = parts[0].unionByName(parts[1])
    both = both.withColumns({"s": F.col("s").cast("int"), "conf": F.col("conf").cast("int"), "type": F.col("type").cast("int")})
    return both.groupBy("kind", "s", "conf", "type", "night", F.to_date("t").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("frp").alias("frp"), F.max(F.unix_timestamp("t")).alias("last"))


def reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.detections(spark, sf)
    return export.reconcile(d, d.where(F.col("x") == 0), ["s", "year"])


def pip_assign(spark: SparkSession, sf: str) -> DataFrame:
    units = spatial.units_from_geojson(spark, SQUARE)
    return spatial.assign(fx.feed(spark, sf), units).select("id", "unit_idx", "unit_name")


def mercator_tiles(spark: SparkSession, sf: str) -> DataFrame:
    x, y = geo.mercator_tile(F.col("lat"), F.col("lon"), 9)
    h, v = geo.sinusoidal_tile(F.col("lat"), F.col("lon"))
    return fx.feed(spark, sf).groupBy(x.alias("x"), y.alias("y"), h.alias("h"), v.alias("v")).agg(F.count(F.lit(1)).alias("n"))


def haversine_in_view(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of events within 220 km of a point, in order of arrival for each sensor, with the closest."""
    far = geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(23.7), F.lit(90.4))
    f = fx.feed(spark, sf).select("s", "id", F.round(220 - far, 6).alias("margin"))
    numbered = ordering.numbered(f, ["s"], F.floor(F.col("id") / 10_000), ["id"], "at").withColumn("at", F.col("at") - 1).withColumn("inside", F.col("margin") >= 0)
    out = passes.runs(numbered, ["s"], "at", "inside", "margin")
    return out.select("s", *[F.col(c).cast("long").alias(c) for c in ("first", "last", "best")])


def terrarium(spark: SparkSession, sf: str) -> DataFrame:
    f = fx.feed(spark, sf).withColumn("height", F.col("frp") * 10 - 400)
    r, g, b = geo.terrarium_encode(F.col("height"))
    coded = f.select("id", r.alias("red"), g.alias("green"), b.alias("blue"))
    return coded.withColumn("height", geo.terrarium_decode(F.col("red"), F.col("green"), F.col("blue")))


def solar_zenith(spark: SparkSession, sf: str) -> DataFrame:
    f = fx.feed(spark, sf)
    return f.select("id", F.round(geo.solar_zenith_deg(F.col("t"), F.col("lat"), F.col("lon")), 4).alias("zenith"))


def land_strata(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as pixels: cover code from the size, unit from the key."""
    codes = F.array(*map(F.lit, (10, 40, 80, 20, 10, 70, 40)))
    pixels = fx.table(spark, sf, "part").select((F.col("p_partkey") % 60).cast("int").alias("unit"), F.element_at(codes, (F.col("p_size") % 7 + 1).cast("int")).alias("klass"))
    return spatial.land_strata(pixels)


def export_series(spark: SparkSession, sf: str) -> DataFrame:
    d = panel_queries.period_counts(spark, sf).where(F.col("s") == 0).withColumn("at", periods.timeline(F.col("year"), F.col("p")))
    s = export.series(d, "unit", ["at"], {"d": None, "dn": None})
    return s.select("unit", F.array_join(F.transform("d", lambda x: x.cast("string")), ",").alias("d"), F.array_join(F.transform("dn", lambda x: x.cast("string")), ",").alias("dn"))


def gates(spark: SparkSession, sf: str) -> DataFrame:
    v = panel_queries.period_verdicts(spark, sf).withColumns({"coverage": F.col("n") / 20.0, "h": F.exp("mu")})
    return export.gate_counts(v)


def csv_export(spark: SparkSession, sf: str) -> DataFrame:
    o = selection.observations(observations(spark, sf), CHOICE)
    # whole numbers only: engines print fractions in their own ways
    rows = o.select("id", F.lit(24).alias("latitude"), F.lit(90).alias("longitude"), F.to_date("date").alias("day"), F.date_format("date", "HHmm").alias("time"), "time_known", "satellite", F.lit('=S"x').alias("sensor"), F.lit("n").alias("confidence"), F.round("frp").cast("long").alias("frp"), "district", "excluded")
    return export.csv_lines(rows)


def period_labels(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.detections(spark, sf).select("year", "p").distinct()
    y, p = F.col("year"), F.col("p")
    return d.select("year", "p", periods.period_start(y, p).alias("first_day"), periods.period_end(y, p).alias("last_day"), periods.days_in_period(y, p).alias("days"))


def raster_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Masks of 100 pixels made of line items over one grid: a binary column per tile, as many
    masks of a tile and date as its line items fill."""
    from pyspark.sql import Window

    lines = fx.table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("tile"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").cast("int").alias("quantity"))
    place = F.row_number().over(Window.partitionBy("tile", "date").orderBy("quantity")) - 1  # equal quantities are equal pixels
    lines = lines.withColumn("mask", F.floor(place / 100).cast("int"))
    masks = lines.groupBy("tile", "date", "mask").agg(F.sort_array(F.collect_list("quantity")).alias("q"))
    pixel = lambda k: F.chr((F.coalesce(F.get("q", F.pmod(k, F.size("q"))), F.lit(0)) % 10).cast("long"))
    sat = F.when(F.col("mask") == 0, "T").otherwise(F.concat(F.lit("T"), F.col("mask")))
    masks = masks.select(sat.alias("sat"), "tile", "date", F.encode(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), pixel), ""), "UTF-8").alias("pixels"))
    half = "0000" * 50 + "0100" * 50
    grids = masks.select("tile").distinct().select("tile", F.unhex(F.lit(half)).alias("unit"), F.unhex(F.lit("01" * 100)).alias("land"))
    return spatial.raster_counts(masks, grids)


QUERIES = {f.__name__: f for f in (select_observations, area_stats, calendar, calendar_all, pass_board, fleet_retention, adjusted_retention, manifest, full_manifest, model_checks, import_observations, normalized_feed, reconciliation, pip_assign, mercator_tiles, haversine_in_view, terrarium, solar_zenith, land_strata, export_series, gates, csv_export, period_labels, raster_counts)}

_HERE = f"year = {CHOICE.year} AND period = {CHOICE.period}"
ORACLE_SQL = {
    "select_observations": f"WITH {OBS} SELECT id, district, satellite, frp FROM obs WHERE {_HERE} AND {KEPT} AND {NEWER}",
    "area_stats": f"""WITH {OBS}, c AS (SELECT district AS name, count(*) AS n FROM obs WHERE {_HERE} AND {KEPT} AND {NEWER} GROUP BY district),
e AS (SELECT district AS name, gprobability AS probability, coverage FROM est WHERE {_HERE} AND g)
SELECT n_name AS name, coalesce(n, 0) AS count, round(probability, 6) AS probability,
  CASE WHEN coverage IS NULL THEN 'Not assessed' WHEN coverage < 30 THEN 'Not observed' WHEN probability >= 0.8 THEN 'Unusually high' WHEN probability >= 0.6 THEN 'Possibly unusual' ELSE 'Within usual range' END AS label,
  row_number() OVER (ORDER BY coalesce(probability, -1) DESC, n_nationkey)::INT AS position
FROM nation LEFT JOIN c ON c.name = n_name LEFT JOIN e ON e.name = n_name""",
    "calendar": f"""WITH {OBS}, c AS (SELECT year, period, count(*) AS count FROM obs WHERE district = '{AREA}' AND NOT excluded GROUP BY ALL), m AS (SELECT DISTINCT year, period, true AS model FROM est WHERE district = '{AREA}')
SELECT year, period, coalesce(count, 0) AS count, coalesce(model, false) AS model FROM c FULL JOIN m USING (year, period)""",
    "calendar_all": f"WITH {OBS} SELECT year, period, district, satellite, low_confidence, excluded, count(*) AS count FROM obs GROUP BY ALL",
    "pass_board": f"""WITH {OBS}, f(satellite, retiring) AS (VALUES ('Terra', true), ('NOAA-21', false), ('NOAA-20', false), ('S-NPP', true), ('Aqua', true)),
b AS (SELECT satellite, count(*) AS count, count(DISTINCT date::DATE) AS days, list_sort(list(DISTINCT strftime(date + INTERVAL 6 HOUR, '%H:%M')) FILTER (time_known)) AS times, sum(frp) AS frp FROM obs WHERE {_HERE} GROUP BY satellite)
SELECT satellite, retiring, coalesce(count, 0) AS count, coalesce(days, 0) AS days, coalesce(array_to_string(times, ','), '') AS times, coalesce(times[1], '-') AS time, round(coalesce(frp, 0.0), 4) AS frp FROM f LEFT JOIN b USING (satellite)""",
    "fleet_retention": f"""WITH {OBS}, a AS (SELECT count(*) FILTER ({KEPT} AND {NEWER}) AS kept, count(*) FILTER ({KEPT}) AS total, count(*) FILTER (low_confidence) AS low, count(*) FILTER (excluded) AS excluded FROM obs WHERE {_HERE})
SELECT *, CASE WHEN total > 0 THEN floor(100 * kept / total + 0.5)::BIGINT END AS raw_retention FROM a""",
    "adjusted_retention": f"""WITH {OBS}, h AS (SELECT CASE WHEN probability >= 0.8 THEN 2 WHEN probability >= 0.6 THEN 1 ELSE 0 END = CASE WHEN gprobability >= 0.8 THEN 2 WHEN gprobability >= 0.6 THEN 1 ELSE 0 END AS same FROM est WHERE year BETWEEN 1998 AND 2001 AND g AND coverage >= 30)
SELECT count(*) AS held, CASE WHEN count(*) > 0 THEN floor(100 * count(*) FILTER (same) / count(*) + 0.5)::BIGINT END AS adjusted_retention FROM h""",
    "manifest": f"WITH {OBS} SELECT array_to_string(list_reverse_sort(list(DISTINCT year)), ',') AS years, arg_max(year, year * 46 + period) AS year, arg_max(period, year * 46 + period) AS period, count(*) AS n, array_to_string(list_sort(list(DISTINCT district)), ',') AS areas FROM obs",
    "full_manifest": f"""WITH {OBS}, na AS (SELECT n_name, CASE n_nationkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN '\u00e9' || n_name WHEN 2 THEN 'Zo\u00eb ' || n_name ELSE n_name END AS name FROM nation),
e AS (SELECT year + 3 AS year, period, district FROM est WHERE year < 2000), b AS (SELECT year, period, district, 0 AS e FROM obs UNION ALL SELECT year, period, district, 1 FROM e),
a AS (SELECT DISTINCT coalesce(na.name, b.district) AS name FROM b LEFT JOIN na ON n_name = district UNION SELECT r_name FROM region)
SELECT array_to_string(list_reverse_sort(list(DISTINCT year)), ',') AS years, arg_max(year, year * 46 + period) AS year, arg_max(period, year * 46 + period) AS period, count_if(e = 0)::BIGINT AS observation_count, sum(e)::BIGINT AS estimate_count,
  sum(e) > 0 AS has_estimates, greatest(max(year), 2026) AS max_year, (SELECT 'Whole land,' || string_agg(name, ',' ORDER BY name COLLATE en) FROM a) AS areas FROM b""",
    "model_checks": f"WITH {OBS} SELECT district, (year + 10)::INT AS year, period FROM est WHERE (length(district) + year) % 7 = 0",
    "import_observations": f"""WITH {FEED}, r AS (SELECT CASE WHEN id % 11 IN (0, 1) THEN 'coordinates' WHEN id % 11 = 5 THEN 'satellite' WHEN id % 11 = 2 THEN 'date' WHEN id % 11 = 3 THEN 'time' END AS rejected,
  CASE id % 11 WHEN 5 THEN NULL WHEN 6 THEN 'S-NPP' ELSE 'NOAA-20' END AS satellite, id % 11 = 7 OR k % 101 < 30 AS low_confidence, id % 11 = 8 AS excluded, id % 11 <> 4 AS time_known,
  CASE WHEN id % 11 <> 2 THEN year(t)::INT END AS year, least(45, CASE WHEN id % 11 <> 2 THEN (dayofyear(t) - 1) // 8 END)::INT AS period FROM feed)
SELECT rejected, satellite, low_confidence, excluded, time_known, CASE WHEN rejected = 'date' THEN NULL ELSE year END AS year, CASE WHEN year IS NULL THEN 45 ELSE period END::INT AS period, count(*) AS n FROM r GROUP BY ALL""",
    "normalized_feed": f"""WITH {FEED}, k AS (SELECT v.kind, f.* FROM feed f CROSS JOIN (VALUES ('T+A'), ('N')) v(kind)),
r AS (SELECT kind, CASE WHEN kind = 'T+A' THEN CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END ELSE CASE id % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 4 END END AS s,
  CASE WHEN kind = 'T+A' THEN CASE WHEN k % 4 = 0 OR k % 101 < 30 THEN 0 WHEN k % 101 < 80 THEN 1 ELSE 2 END ELSE CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END END AS conf,
  CASE WHEN id % 7 = 0 THEN -1 ELSE 2 END AS type, id % 2 = 0 AS night, t, CASE WHEN id % 5 = 0 THEN 0.0 ELSE 2.5 END::DOUBLE AS frp FROM k)
SELECT kind, s, conf, type, night, t::DATE AS day, count(*) AS n, sum(frp) AS frp, epoch(date_trunc('minute', max(t)))::BIGINT AS last FROM r GROUP BY ALL""",
    "reconciliation": f"WITH {DET} SELECT s, year, count(*) AS raw, count(*) FILTER (x = 0) AS kept, round(1 - count(*) FILTER (x = 0) / count(*), 4) AS dropped FROM det GROUP BY ALL",
    "pip_assign": f"""WITH {FEED} SELECT id, CASE WHEN lon BETWEEN 88.05 AND 90.05 AND lat BETWEEN 20.65 AND 22.65 AND NOT (lon BETWEEN 88.55 AND 89.55 AND lat BETWEEN 21.15 AND 22.15) THEN 0
  WHEN (lon BETWEEN 90.15 AND 91.15 AND lat BETWEEN 20.65 AND 21.65) OR (lon BETWEEN 91.55 AND 92.55 AND lat BETWEEN 22.65 AND 23.65) THEN 1 WHEN lon BETWEEN 88.05 AND 92.55 AND lat BETWEEN 22.75 AND 26.65 THEN 2 END AS unit_idx,
  CASE WHEN unit_idx = 0 THEN 'ring' WHEN unit_idx = 1 THEN 'pair' WHEN unit_idx = 2 THEN 'wide' END AS unit_name FROM feed""",
    "mercator_tiles": f"""WITH {FEED} SELECT floor((lon + 180) / 360 * 512)::INT AS x, floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 512)::INT AS y,
  (floor({C.SPHERE_M!r} * radians(lon) * cos(radians(lat)) / {C.TILE_M!r}) + 18)::INT AS h, (8 - floor({C.SPHERE_M!r} * radians(lat) / {C.TILE_M!r}))::INT AS v, count(*) AS n FROM feed GROUP BY ALL""",
    "haversine_in_view": f"""WITH {FEED}, m AS (SELECT s, id, round(220 - 2 * 6371.0 * asin(least(1.0, sqrt(sin((radians(23.7) - radians(lat)) / 2) ** 2 + cos(radians(lat)) * cos(radians(23.7)) * sin(radians(90.4 - lon) / 2) ** 2))), 6) AS margin, row_number() OVER (PARTITION BY s ORDER BY id) - 1 AS pos FROM feed),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY s ORDER BY pos) AS island FROM m WHERE margin >= 0)
SELECT s, min(pos) AS first, max(pos) AS last, arg_max(pos, (margin, -pos)) AS best FROM i GROUP BY s, island""",
    "terrarium": f"WITH {FEED}, h AS (SELECT id, frp * 10 - 400 + 32768 AS v FROM feed), c AS (SELECT id, floor(v / 256)::INT AS red, floor(v - floor(v / 256) * 256)::INT AS green, floor((v - floor(v)) * 256)::INT AS blue FROM h) SELECT *, red * 256.0::DOUBLE + green + blue / 256.0::DOUBLE - 32768 AS height FROM c",
    "solar_zenith": f"""WITH {FEED}, a AS (SELECT *, epoch_us(t) / 86400000000.0::DOUBLE + 2440587.5 - 2451545.0 AS d FROM feed),
b AS (SELECT *, radians(357.529 + 0.98560028 * d) AS g FROM a), c AS (SELECT *, radians(280.459 + 0.98564736 * d + 1.915 * sin(g) + 0.020 * sin(2 * g)) AS l, radians(23.439 - 0.00000036 * d) AS e FROM b),
h AS (SELECT *, asin(sin(e) * sin(l)) AS dec, radians((280.46061837 + 360.98564736629 * d) % 360.0) + radians(lon) - atan2(cos(e) * sin(l), cos(l)) AS ha FROM c)
SELECT id, round(degrees(acos(greatest(-1.0, least(1.0, sin(radians(lat)) * sin(dec) + cos(radians(lat)) * cos(dec) * cos(ha))))), 4) AS zenith FROM h""",
    "land_strata": """WITH x AS (SELECT (p_partkey % 60)::INT AS unit, [10, 40, 80, 20, 10, 70, 40][p_size % 7 + 1] AS klass FROM part), n AS (SELECT unit, count(*) AS pixels, count(*) FILTER (klass NOT IN (0, 70, 80)) AS land FROM x GROUP BY unit),
b AS (SELECT * FROM (SELECT unit, CASE klass WHEN 10 THEN 'forest' WHEN 40 THEN 'cropland' ELSE 'other' END AS stratum, count(*) AS n FROM x WHERE klass NOT IN (0, 70, 80) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY unit ORDER BY n DESC, CASE stratum WHEN 'forest' THEN 1 WHEN 'cropland' THEN 2 ELSE 3 END) = 1)
SELECT unit, pixels, land, coalesce(stratum, 'other') AS stratum FROM n LEFT JOIN b USING (unit)""",
    "export_series": f"WITH {DET}, a AS (SELECT unit, year * 46 + p AS pos, count(*) FILTER (x = 0) AS d, count(*) FILTER (x = 0 AND night) AS dn FROM det WHERE s = 0 GROUP BY ALL) SELECT unit, string_agg(d::VARCHAR, ',' ORDER BY pos) AS d, string_agg(dn::VARCHAR, ',' ORDER BY pos) AS dn FROM a GROUP BY unit",
    "gates": f"WITH {panel_queries.VERDICTS} SELECT count(*) FILTER (n / 20.0 NOT BETWEEN 0 AND 1.0001) AS bad_coverage, count(*) FILTER (p_hi NOT BETWEEN 0 AND 1) AS bad_p_hi, count(*) FILTER (p_lo NOT BETWEEN 0 AND 1) AS bad_p_lo, count(*) FILTER (code NOT BETWEEN -1 AND 8) AS bad_code, count(mu) AS n_harmonized FROM vd",
    "csv_export": f"""WITH {OBS} SELECT '"24","90","' || strftime(date, '%Y-%m-%d') || '","' || CASE WHEN time_known THEN strftime(date, '%H%M') ELSE '' END || '","' || satellite || '","''=S""x","n","' || round(frp)::BIGINT || '","' || district || '","' || excluded || '"' AS value FROM obs WHERE {_HERE} AND {KEPT} AND {NEWER}""",
    "period_labels": f"WITH {DET} SELECT DISTINCT year, p, make_date(year, 1, 1) + (p - 1) * 8 AS first_day, least(make_date(year, 1, 1) + (p - 1) * 8 + 7, make_date(year, 12, 31)) AS last_day, (CASE WHEN p < 46 THEN 8 ELSE dayofyear(make_date(year, 12, 31)) - 360 END)::INT AS days FROM det",
    "raster_counts": """WITH l AS (SELECT l_linenumber AS tile, l_shipdate::DATE AS date, l_quantity::INT AS q, row_number() OVER (PARTITION BY l_linenumber, l_shipdate::DATE ORDER BY l_quantity::INT) - 1 AS pos FROM lineitem),
m AS (SELECT tile, date, pos // 100 AS mask, list(q ORDER BY q) AS qs FROM l GROUP BY ALL),
x AS (SELECT tile, date, mask, i, coalesce(qs[i % len(qs) + 1], 0) % 10 AS v FROM m, range(100) AS r(i))
SELECT CASE WHEN mask = 0 THEN 'T' ELSE 'T' || mask END AS sat, tile::INT AS tile, date, (CASE WHEN i < 50 THEN 0 ELSE 1 END)::INT AS unit, count(*) FILTER (v IN (5, 7, 8, 9)) AS clear, count(*) FILTER (v = 4) AS cloud, count(*) AS land FROM x GROUP BY ALL""",
}
