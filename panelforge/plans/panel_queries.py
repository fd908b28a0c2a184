"""The batch half on the driver's tables, with the SQL each query must equal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import periods, scores
from ..operators import baseline, bridge, dedupe, graph, harmonize, panel, passes, staticmask, validation
from ..sources import fixtures as fx
from ..sources.fixtures import SQL_COVERAGE as COV
from ..sources.fixtures import SQL_DETECTIONS as DET
from ..sources.fixtures import SQL_FEED as FEED

FIRST, LAST, WINDOW = 1995, 2001, (1995, 1999)
MIN_N, MIN_LAND = 10, 20.0


def _round(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


def _cdf(x: str) -> str:
    """The normal distribution function as SQL text, by the same approximation as the library's."""
    poly = lambda cs: reduce(lambda t, c: f"({t} * abs({x}) + {c!r})", cs[1:], repr(cs[0]))
    fraction = reduce(lambda t, k: f"(abs({x}) + {k} / {t})", ("4.0", "3.0", "2.0", "1.0"), f"(abs({x}) + 0.65)")
    near = f"exp(-abs({x}) * abs({x}) / 2) * {poly(C.NORMAL_TOP)} / {poly(C.NORMAL_BOTTOM)}"
    far = f"exp(-abs({x}) * abs({x}) / 2) / {fraction} / {C.NORMAL_ROOT!r}"
    tail = f"(CASE WHEN abs({x}) > 37 THEN 0.0 WHEN abs({x}) < {C.NORMAL_SWITCH!r} THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


# counts and power


def period_counts(spark: SparkSession, sf: str) -> DataFrame:
    return panel.counts(fx.detections(spark, sf))


COUNTS = "count(*) FILTER (x = 0) AS d, count(*) FILTER (x = 0 AND night) AS dn, count(*) FILTER (x = 1) AS ex_static, count(*) FILTER (x = 2) AS ex_low"


def period_counts_country(spark: SparkSession, sf: str) -> DataFrame:
    return panel.with_country(period_counts(spark, sf), ["d", "dn", "ex_static", "ex_low"])


def frp_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _round(panel.power(fx.detections(spark, sf)), "frp_sum", "frp_p50", places=4)


def kept_vs_excluded(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.detections(spark, sf)
    return d.groupBy("s", "year").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("x") == 0).cast("double")), 6).alias("kept_share"))


# repeated detections


def exact_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    lines = fx.table(spark, sf, "lineitem")
    first = dedupe.keep_first(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"])
    return first.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def import_dedupe_last(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.feed(spark, sf).withColumns({"day": F.to_date("t"), "k": F.col("k") % 61})
    return dedupe.keep_last(rows.select("id", "s", "day", "k", "frp"), ["s", "day", "k"], "id")


def _lattice(spark: SparkSession, sf: str) -> DataFrame:
    """Feed points on a lattice of about 100 m with times cut to the hour, so that clusters form."""
    f = fx.feed(spark, sf)
    return f.select("id", "s", F.date_trunc("hour", "t").alias("t"), (20.6 + (F.col("k") % 61) * 0.001).alias("lat"), (88.0 + F.pmod(F.round((F.col("lon") - 88.0) * 10).cast("int"), F.lit(47)) * 0.001).alias("lon"), F.col("frp"))


def proximity_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.proximity(_lattice(spark, sf), radius_km=0.2).select("id", "s", "frp", "group_root", "group_size")


def proximity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs within 200 m of points spread finely over places at 24 N 90 E, 60 N 25 E and 35 S 150 W."""
    f, k = fx.feed(spark, sf), F.col("id")
    south, west = (F.element_at(F.array(*map(F.lit, at)), (k % 3 + 1).cast("int")) for at in ((24.0, 60.0, -35.0), (90.0, 25.0, -150.0)))
    points = f.select("id", "s", F.date_trunc("month", "t").alias("t"), (south + k * 7919 % 401 * 0.0001).alias("lat"), (west + k * 5381 % 397 * 0.0001).alias("lon"))
    return dedupe.close_pairs(points)


def static_mask_learn(spark: SparkSession, sf: str) -> DataFrame:
    return staticmask.learn(_static_cells(spark, sf), (1995, 2000))


def _static_cells(spark: SparkSession, sf: str) -> DataFrame:
    orders, customers = fx.table(spark, sf, "orders"), fx.table(spark, sf, "customer")
    d = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return d.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).cast("int").alias("cx"), F.col("c_nationkey").alias("cy"), F.col("o_orderdate").alias("t"), (F.col("o_orderkey") % 3 == 0).alias("coarse"))


def static_mask_apply(spark: SparkSession, sf: str) -> DataFrame:
    cells = _static_cells(spark, sf)
    return staticmask.apply(cells, staticmask.learn(cells, (1995, 2000), years=4), "coarse").select("id", "static")


STATIC = """c AS (SELECT o_orderkey AS id, (o_custkey % 20)::INT AS cx, c_nationkey AS cy, o_orderdate AS t, o_orderkey % 3 = 0 AS coarse FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT cx, cy, year(t) AS y FROM c WHERE year(t) BETWEEN 1995 AND 2000 GROUP BY cx, cy, y HAVING count(*) >= 5 AND count(DISTINCT t::DATE) >= 5 AND count(DISTINCT month(t)) >= 3),
m AS (SELECT cx, cy, count(*) AS n_years FROM g GROUP BY cx, cy HAVING count(*) >= {years})"""


# coverage


def coverage_period(spark: SparkSession, sf: str) -> DataFrame:
    cells = _round(panel.coverage_cells(fx.coverage(spark, sf)), "clear", "cloud", "land", "missing", places=4)
    return cells.withColumn("coverage", F.round(F.try_divide("clear", "land"), 6))


AREAS = "round(sum(clear), 4) AS clear, round(sum(cloud), 4) AS cloud, round(sum(land), 4) AS land, count(DISTINCT date) AS n_days, round(sum(land) - sum(clear) - sum(cloud), 4) AS missing, round(CASE WHEN sum(land) <> 0 THEN round(sum(clear), 4) / round(sum(land), 4) END, 6) AS coverage"


def coverage_country(spark: SparkSession, sf: str) -> DataFrame:
    return _round(panel.with_country(panel.coverage_cells(fx.coverage(spark, sf)), ["clear", "cloud", "land"]), "clear", "cloud", "land", places=4)


def daily_coverage(spark: SparkSession, sf: str) -> DataFrame:
    d = panel.daily_coverage(fx.coverage(spark, sf), [F.col("land"), F.col("clear")])
    return _round(d, "clear", "cloud", "land")


def seen_pct(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.coverage(spark, sf).groupBy("sat", "date", "unit").agg(F.round(F.sum("clear"), 4).alias("clear"), F.sum("land").alias("land"))
    return panel.seen_percent(d).select("sat", "date", "unit", "seen")


def proxy_coverage(spark: SparkSession, sf: str) -> DataFrame:
    native = fx.coverage(spark, sf).where(F.col("s") < 3)
    lent = panel.with_proxy(native, [0, 1, 2, 3, 4])
    return lent.groupBy("s", "proxy", "year").agg(F.round(F.sum("land"), 4).alias("land"), F.count(F.lit(1)).alias("n"))


def sensor_windows(spark: SparkSession, sf: str) -> DataFrame:
    return panel.sensor_windows(fx.detections(spark, sf), fx.coverage(spark, sf), FIRST)


WINDOWS = f"""{DET}, {COV},
w AS (SELECT s, CASE WHEN s < 2 THEN greatest(make_date({FIRST}, 1, 1), coalesce(fc, DATE '2100-01-01')) ELSE fd END AS start, make_date(ly, 12, 31) AS "end"
      FROM (SELECT s, min(t)::DATE AS fd, max(year) AS ly FROM det GROUP BY s) LEFT JOIN (SELECT s, min(date) AS fc FROM cov GROUP BY s) USING (s))"""


def country_activity(spark: SparkSession, sf: str) -> DataFrame:
    """Units of the first region and their country, which is active where all of its units are seen."""
    units = fx.units(spark, sf).where("unit < 3")
    cells = panel.coverage_cells(fx.coverage(spark, sf).join(F.broadcast(units.select("unit")), "unit"))
    whole = panel.with_country(cells, ["clear", "land"], least=("n_days",), units=units)
    return _round(panel.active(whole, sensor_windows(spark, sf)), "clear", "land", places=4)


def activity_mask(spark: SparkSession, sf: str) -> DataFrame:
    cells = panel.coverage_cells(fx.coverage(spark, sf)).select(*panel.CELL, "n_days")
    return panel.active(cells, sensor_windows(spark, sf))


# cells, bridges, combination


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return panel.counts(fx.detections(spark, sf)).join(panel.coverage_cells(fx.coverage(spark, sf)), panel.CELL)


def _rates(spark: SparkSession, sf: str) -> DataFrame:
    return panel.rates(_cells(spark, sf), 0.3, MIN_LAND)


RATES = f"""{DET}, {COV},
dc AS (SELECT s, unit, year, p, {COUNTS} FROM det GROUP BY ALL),
cc AS (SELECT s, unit, year, p, sum(clear) AS clear, sum(cloud) AS cloud, sum(land) AS land FROM cov GROUP BY ALL),
ra AS (SELECT s, unit, year, p, d, dn, clear, land, d / (clear / 1000) + 0.01 AS rho, CASE WHEN d = 0 THEN 0.5 ELSE dn / d END AS ns,
              sin(p * (2 * pi() / 46)) AS sn, cos(p * (2 * pi() / 46)) AS cs
       FROM dc JOIN cc USING (s, unit, year, p) WHERE clear / land >= 0.3 AND land >= {MIN_LAND})"""


def valid_rates(spark: SparkSession, sf: str) -> DataFrame:
    return _round(_rates(spark, sf).select(*panel.CELL, "d", "rho", "ns", "sn", "cs"), "rho", "ns", "sn", "cs")


def sensor_pair_join(spark: SparkSession, sf: str) -> DataFrame:
    return _round(panel.sensor_pairs(_rates(spark, sf), 0, 1).select("unit", "year", "p", "d_from", "d_to", "rho_from", "rho_to"), "rho_from", "rho_to")


def ratio_bridge(spark: SparkSession, sf: str) -> DataFrame:
    r = _rates(spark, sf)
    parts = [panel.sensor_pairs(r, a, b).select(F.lit(a).alias("frm"), F.lit(b).alias("to"), "d_to", "rho_from", "clear_to") for a, b in ((0, 1), (2, 1), (3, 2), (4, 3))]
    both = reduce(DataFrame.unionByName, parts)
    ratio = F.sum("d_to") / F.greatest(F.lit(1e-9), F.sum(F.col("rho_from") * F.col("clear_to") / 1000))
    return both.groupBy("frm", "to").agg(F.round(F.ln(F.greatest(ratio, F.lit(1e-6))), 6).alias("log_ratio"), F.count(F.lit(1)).alias("n"))


def combine(spark: SparkSession, sf: str) -> DataFrame:
    return _round(panel.combine(panel.estimates(fx.detections(spark, sf)), 0.3), "mu", "sigma")


def combine_grounded(spark: SparkSession, sf: str) -> DataFrame:
    return _round(panel.combine(panel.estimates(fx.detections(spark, sf)), 0.3, disabled=(0, 1, 2)), "mu", "sigma")


ESTIMATES = f"""{DET},
e AS (SELECT s, unit, year, p, ln(1 + d) AS mu, 1 / sqrt(d + 0.5) AS sigma FROM (SELECT s, unit, year, p, count(*) FILTER (x = 0) AS d FROM det GROUP BY ALL) WHERE d > 0),
k AS (SELECT unit, year, p, sum(mu / (sigma * sigma)) / sum(1 / (sigma * sigma)) AS mu, sqrt((1 + (count(*) - 1) * 0.3) / sum(1 / (sigma * sigma))) AS sigma, count(*) AS n_used
      FROM e WHERE s NOT IN ({{off}}) GROUP BY ALL)"""


def raw_total(spark: SparkSession, sf: str) -> DataFrame:
    valid = _rates(spark, sf)
    return valid.groupBy("unit", "year", "p").agg(F.sum("d").alias("total"), F.count(F.lit(1)).alias("n_sensors"))


# baselines and verdicts


def _history(spark: SparkSession, sf: str) -> DataFrame:
    """Kept detections of a unit, year and period on the complete spine, above the floor."""
    d = fx.detections(spark, sf).where(F.col("x") == 0).groupBy("unit", "year", "p").agg(F.count(F.lit(1)).alias("n"))
    frame = panel.spine(fx.units(spark, sf), FIRST, LAST)
    return frame.join(d, ["unit", "year", "p"], "left").select("unit", "year", "p", (F.coalesce("n", F.lit(0)) + 0.01).alias("v"))


HISTORY = f"""{DET},
h AS (SELECT n_nationkey AS unit, y::INT AS year, q::INT AS p, coalesce(n, 0) + 0.01::DOUBLE AS v
      FROM nation CROSS JOIN range({FIRST}, {LAST + 1}) AS a(y) CROSS JOIN range(1, 47) AS b(q)
      LEFT JOIN (SELECT unit, year, p, count(*) AS n FROM det WHERE x = 0 GROUP BY ALL) d ON d.unit = n_nationkey AND d.year = y AND d.p = q),
nb AS (SELECT unit, year, p, v, lag(v) OVER w AS vl, lead(v) OVER w AS vr FROM h WINDOW w AS (PARTITION BY unit ORDER BY year * 46 + p)),
ex AS (SELECT unit, year AS centre, p, unnest([vl, v, vr]) AS b FROM nb WHERE year BETWEEN {WINDOW[0]} AND {WINDOW[1]}),
bl AS (SELECT h.unit, h.year, h.p, h.v, quantile_cont(b, 0.1) AS q10, quantile_cont(b, 0.5) AS q50, quantile_cont(b, 0.9) AS q90, max(b) AS top, count(b) AS n
       FROM h LEFT JOIN ex ON ex.unit = h.unit AND ex.p = h.p AND ex.centre <> h.year AND b IS NOT NULL GROUP BY ALL)"""


def baseline_loo(spark: SparkSession, sf: str) -> DataFrame:
    out = baseline.leave_one_out(_history(spark, sf), WINDOW)
    return _round(out, "v", "q10", "q50", "q90", "top").withColumn("n", F.col("n").cast("long"))


def baseline_all(spark: SparkSession, sf: str) -> DataFrame:
    out = baseline.whole_window(_history(spark, sf), WINDOW)
    return _round(out, "q10", "q50", "q90", "top").withColumn("n", F.col("n").cast("long"))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """Combined estimates with baseline and verdict code; unobserved cells have no estimate."""
    est = panel.combine(panel.estimates(fx.detections(spark, sf)), 0.3)
    b = baseline.leave_one_out(_history(spark, sf), WINDOW).join(est, ["unit", "year", "p"], "left")
    b = b.withColumns({"p_hi": scores.p_above(F.col("mu"), F.col("sigma"), F.col("q90")), "p_lo": scores.p_below(F.col("mu"), F.col("sigma"), F.col("q10"))})
    return b.withColumn("code", scores.verdict(F.col("mu"), F.col("sigma"), F.col("p_hi"), F.col("p_lo"), F.col("q10"), F.col("top"), F.col("n"), MIN_N))


def period_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    out = _judged(spark, sf).select("unit", "year", "p", "mu", "sigma", "q10", "q90", F.col("n").cast("long").alias("n"), "p_hi", "p_lo", "code")
    return _round(out, "mu", "sigma", "q10", "q90", "p_hi", "p_lo")


VERDICTS = f"""{HISTORY}, {ESTIMATES.format(off='-1').removeprefix(DET + ',').lstrip()},
z AS (SELECT bl.*, k.mu, k.sigma, (ln(q90) - mu) / sigma AS zh, (ln(q10) - mu) / sigma AS zl FROM bl LEFT JOIN k USING (unit, year, p)),
pr AS (SELECT *, 1 - {_cdf('zh')} AS p_hi0, {_cdf('zl')} AS p_lo0 FROM z),
vd AS (SELECT *, CASE WHEN mu IS NOT NULL THEN p_hi0 END AS p_hi, CASE WHEN mu IS NOT NULL THEN p_lo0 END AS p_lo,
         CASE WHEN mu IS NULL OR sigma IS NULL THEN 0 WHEN n < {MIN_N} THEN 7 WHEN exp(mu - {C.Z80!r} * sigma) > top THEN 6 WHEN p_hi0 >= 0.9 THEN 5 WHEN p_hi0 >= 0.6 THEN 4
              WHEN p_lo0 >= 0.9 AND q10 >= {C.Q_MIN} THEN 1 WHEN p_lo0 >= 0.6 AND q10 >= {C.Q_MIN} THEN 2 ELSE 3 END AS code
       FROM pr)"""


def raw_class(spark: SparkSession, sf: str) -> DataFrame:
    b = baseline.leave_one_out(_history(spark, sf), WINDOW)
    return b.select("unit", "year", "p", scores.raw_class(F.col("v"), F.col("q10"), F.col("q90"), F.col("n"), MIN_N).alias("code"))


def verdict_histogram(spark: SparkSession, sf: str) -> DataFrame:
    c = _judged(spark, sf).select("code", scores.class3(F.col("code")).alias("class3"), scores.judged(F.col("code")).alias("judged"))
    return c.groupBy("code", "class3", "judged").agg(F.count(F.lit(1)).alias("n"))


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    c = panel.combine(panel.estimates(fx.detections(spark, sf)), 0.3).withColumns(scores.intervals(F.col("mu"), F.col("sigma")))
    return _round(c.drop("mu", "sigma", "n_used"), "h", "lo80", "hi80", "lo95", "hi95")


def _annual(spark: SparkSession, sf: str) -> DataFrame:
    land = panel.coverage_cells(fx.coverage(spark, sf), ["unit", "year", "p"]).select("unit", "year", "p", "land")
    cells = _judged(spark, sf).join(land, ["unit", "year", "p"]).withColumn("h", F.exp("mu"))
    return baseline.annual(cells)


def annual_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _round(_annual(spark, sf), "total", "sd", "complete", "lo80", "hi80", places=5)


def annual_rank(spark: SparkSession, sf: str) -> DataFrame:
    years = _annual(spark, sf).withColumns({"complete": F.round("complete", 6), "total": F.round("total", 5)})
    return baseline.rank(years, 0.3).select("unit", "year", "rank")


ANNUAL = f"""{VERDICTS}, {COV}, la AS (SELECT unit, year, p, sum(land) AS land FROM cov GROUP BY ALL),
an AS (SELECT unit, year, sum(exp(mu) * land / 1000) FILTER (code BETWEEN 1 AND 6) AS total,
         sqrt(sum(CASE WHEN code BETWEEN 1 AND 6 THEN (exp(mu) * land / 1000 * sigma) ** 2 ELSE 0.0 END)) AS sd,
         coalesce(sum(CASE WHEN code BETWEEN 1 AND 6 THEN land ELSE 0.0 END) / sum(land), 0.0) AS complete
       FROM vd JOIN la USING (unit, year, p) GROUP BY ALL)"""


def peak_window(spark: SparkSession, sf: str) -> DataFrame:
    return baseline.peak_window(_round(baseline.whole_window(_history(spark, sf), WINDOW), "q50")).withColumns({"first_p": F.col("first_p").cast("int"), "last_p": F.col("last_p").cast("int")})


def flags(spark: SparkSession, sf: str) -> DataFrame:
    return baseline.flags(activity_mask(spark, sf), 2000).withColumn("flags", F.col("flags").cast("int"))


# passes


def pass_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = passes.sessions(_granules(spark, sf), 30)
    return out.select("s", F.col("pass").cast("long"), "t", "night", "n_granules", passes.unit_bits(F.col("units")).alias("bits"))


def _granules(spark: SparkSession, sf: str) -> DataFrame:
    f = fx.feed(spark, sf)
    return f.select("id", "s", F.col("t").alias("start"), (F.col("t") + F.expr("INTERVAL 5 MINUTES")).alias("end"), (F.col("id") % 2 == 0).alias("night"), F.array((F.col("k") % 70).cast("int")).alias("units"))


SESSIONS = f"""{FEED},
g AS (SELECT id, s, t AS start, t + INTERVAL 5 MINUTE AS "end", id % 2 = 0 AS night, (k % 70)::INT AS unit FROM feed),
o AS (SELECT *, CASE WHEN (epoch(date_trunc('second', start)) - epoch(date_trunc('second', lag("end") OVER w))) / 60 > 30 THEN 1 WHEN lag("end") OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM g WINDOW w AS (PARTITION BY s ORDER BY start, "end", id)),
ps AS (SELECT *, sum(opens) OVER (PARTITION BY s ORDER BY start, "end", id) AS pass FROM o),
pt AS (SELECT s, pass::BIGINT AS pass, make_timestamp((floor((epoch(date_trunc('second', arg_min(start, (start, "end", id)))) + 150) / 60) * 60 * 1000000)::BIGINT) AS t, arg_min(night, (start, "end", id)) AS night, count(*) AS n_granules, list_sort(list(DISTINCT unit)) AS units FROM ps GROUP BY s, pass)"""


def passes_per_period(spark: SparkSession, sf: str) -> DataFrame:
    p = passes.sessions(_granules(spark, sf), 30).withColumns({"year": F.year("t"), "p": periods.period(F.col("t"))})
    own = p.select("s", "year", "p", F.explode("units").alias("unit")).groupBy("s", "unit", "year", "p").agg(F.count(F.lit(1)).alias("n_passes"))
    whole = p.groupBy("s", "year", "p").agg(F.count(F.lit(1)).alias("n_passes")).withColumn("unit", F.lit(panel.COUNTRY))
    return own.unionByName(whole)


# agreement


def kappa(spark: SparkSession, sf: str) -> DataFrame:
    return _round(validation.kappa(fx.table(spark, sf, "labels"), "quality", "toxic"), "po", "pe", "kappa")


def _monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Log rates of two sensors side by side."""
    return panel.sensor_pairs(_rates(spark, sf), 0, 1).select("unit", "year", "p", F.round(F.ln("rho_from"), 6).alias("a"), F.round(F.ln("rho_to"), 6).alias("b"), "d_from", "d_to")


MONTHLY = f"{RATES}, mo AS (SELECT unit, year, p, round(ln(x.rho), 6) AS a, round(ln(y.rho), 6) AS b, x.d AS d_from, y.d AS d_to FROM ra x JOIN ra y USING (unit, year, p) WHERE x.s = 0 AND y.s = 1)"


def spearman(spark: SparkSession, sf: str) -> DataFrame:
    return _round(validation.spearman(_monthly(spark, sf), "a", "b", "year"), "rho")


def pearson_bias(spark: SparkSession, sf: str) -> DataFrame:
    return _round(validation.agreement(_monthly(spark, sf), "a", "b", "year"), "pearson", "bias")


def coverage80(spark: SparkSession, sf: str) -> DataFrame:
    z = F.round((F.col("a") - F.col("b")) / F.sqrt(1 / (F.col("d_from") + 0.5) + 1 / (F.col("d_to") + 0.5)), 6)
    return _round(validation.interval_shares(_monthly(spark, sf), z, "year"), "share80", "share95")


def calibrate_r(spark: SparkSession, sf: str) -> DataFrame:
    e = panel.estimates(fx.detections(spark, sf))
    side = lambda s, k: e.where(F.col("s") == s).select("unit", "year", "p", F.col("mu").alias(f"mu{k}"), F.col("sigma").alias(f"sigma{k}"))
    truth = e.where(F.col("s") == 1).select("unit", "year", "p", F.col("mu").alias("truth"), (F.col("sigma") * F.col("sigma") / 8).alias("truth_var"))
    key = ["unit", "year", "p"]
    return validation.calibrate_r(side(0, 1).join(side(2, 2), key).join(truth, key), least=10).withColumn("r", F.col("r").cast("double"))


# fitted models (no SQL form)


def _strata(spark: SparkSession, sf: str) -> DataFrame:
    return fx.units(spark, sf).select("unit", F.element_at(F.array(*map(F.lit, ("forest", "cropland", "other"))), (F.col("unit") % 3 + 1).cast("int")).alias("stratum"))


BRIDGES = ((0, 1), (2, 1), (3, 2), (4, 3))


#: Cells' sums and models by application and tables: queries that need them share one reading and one fit.
_FITTED: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def _fitted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Sums of all sensors' cells, written once, as every side of every bridge and link reads them, and the
    models of all four bridges, with the operator's own draws and least rows."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _FITTED:
        sums = graph.settled(_cells(spark, sf))
        cells = panel.rates(sums, 0.1, 0.0)
        pairs = [panel.sensor_pairs(cells, a, b).withColumn("bridge", F.lit(f"{C.SENSORS[a]}-{C.SENSORS[b]}")) for a, b in BRIDGES]
        _FITTED[at] = sums, bridge.fit_bridges(reduce(DataFrame.unionByName, pairs), _strata(spark, sf))
    return _FITTED[at]


def _bridges(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Rates of all sensors and the models of all four bridges."""
    sums, models = _fitted(spark, sf)
    return panel.rates(sums, 0.1, 0.0), models


def nb_bridge(spark: SparkSession, sf: str) -> DataFrame:
    out = _bridges(spark, sf)[1]
    return out.select("bridge", "key", "draw", "level", "n", F.round("alpha", 6).alias("alpha"), *[F.round(F.get("beta", F.lit(k)), 6).alias(f"b{k}") for k in range(5)])


def chain_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Every sensor on the reference's scale, along its whole chain."""
    cells, models = _bridges(spark, sf)
    out = bridge.predict(cells.join(_strata(spark, sf), "unit"), models)
    return _round(out.select("s", "unit", "year", "p", "d", "mu", "sigma"), "mu", "sigma")


def harmonized_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of the fleet's estimates, each sensor's brought to the reference's scale by its bridges."""
    cells, models = _bridges(spark, sf)
    spine = panel.spine(fx.units(spark, sf), FIRST, LAST)
    out = harmonize.verdicts(cells.join(_strata(spark, sf), "unit"), models, spine, WINDOW, (1993, 1997), min_n=MIN_N)
    out = out.select("unit", "year", "p", "mu", "sigma", "n_used", "q10", "q50", "q90", "top", F.col("n").cast("long").alias("n"), "p_hi", "p_lo", "code")
    return _round(out, "mu", "sigma", "q10", "q50", "q90", "top", "p_hi", "p_lo")


def _classes(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _judged(spark, sf).join(raw_class(spark, sf).withColumnRenamed("code", "raw"), ["unit", "year", "p"]).where(scores.judged(F.col("code")))
    return pairs.select("unit", "year", scores.class3(F.col("code")).alias("a"), scores.class3(F.col("raw")).alias("b"))


def kappa_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals over blocks of years and of units."""
    pairs = _classes(spark, sf).persist()
    parts = [_round(validation.kappa_interval(pairs, "a", "b", block), "lo", "hi", places=5).withColumn("block", F.lit(block)) for block in ("year", "unit")]
    return parts[0].unionByName(parts[1])


QUERIES = {f.__name__: f for f in (period_counts, period_counts_country, frp_stats, kept_vs_excluded, exact_dedupe, import_dedupe_last, proximity_dedupe, proximity_pairs, static_mask_learn, static_mask_apply, coverage_period, coverage_country, daily_coverage, seen_pct, proxy_coverage, sensor_windows, country_activity, activity_mask, valid_rates, sensor_pair_join, ratio_bridge, combine, combine_grounded, raw_total, baseline_loo, baseline_all, period_verdicts, raw_class, verdict_histogram, intervals, annual_totals, annual_rank, peak_window, flags, pass_sessions, passes_per_period, kappa, spearman, pearson_bias, coverage80, calibrate_r, nb_bridge, chain_predict, harmonized_verdicts, kappa_interval)}

_K = "round(mu, 6) AS mu, round(sigma, 6) AS sigma"
ORACLE_SQL = {
    "period_counts": f"WITH {DET} SELECT s, unit, year, p, {COUNTS} FROM det GROUP BY ALL",
    "period_counts_country": f"WITH {DET}, a AS (SELECT s, unit, year, p, {COUNTS} FROM det GROUP BY ALL) SELECT * FROM a UNION ALL SELECT s, -1, year, p, sum(d)::BIGINT, sum(dn)::BIGINT, sum(ex_static)::BIGINT, sum(ex_low)::BIGINT FROM a GROUP BY s, year, p",
    "frp_stats": f"WITH {DET} SELECT s, unit, year, p, round(sum(frp), 4) AS frp_sum, round(median(frp), 4) AS frp_p50 FROM det WHERE x = 0 GROUP BY ALL",
    "kept_vs_excluded": f"WITH {DET} SELECT s, year, count(*) AS n, round(avg((x = 0)::INT::DOUBLE), 6) AS kept_share FROM det GROUP BY ALL",
    "exact_dedupe": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) = 1",
    "import_dedupe_last": f"WITH {FEED} SELECT s, t::DATE AS day, (k % 61)::INT AS k, max(id) AS id, arg_max(frp, id) AS frp, min(id) AS place FROM feed GROUP BY s, t::DATE, k % 61",
    "proximity_dedupe": f"""WITH RECURSIVE {FEED},
pt AS (SELECT id, s, frp, date_trunc('hour', t) AS h, 20.6 + (k % 61) * 0.001::DOUBLE AS lat, 88.0 + (round((lon - 88.0) * 10)::INT % 47) * 0.001::DOUBLE AS lon FROM feed),
xy AS (SELECT id, s, frp, h, lon * 111.32 * cos(radians(lat)) AS x, lat * 111.32 AS y FROM pt),
ed AS (SELECT a.id AS a, b.id AS b FROM xy a JOIN xy b ON a.s = b.s AND a.h = b.h AND a.id <> b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.2),
re AS (SELECT id AS n, id AS m FROM xy UNION SELECT re.n, ed.b FROM re JOIN ed ON ed.a = re.m),
ro AS (SELECT n AS id, min(m) AS group_root FROM re GROUP BY n)
SELECT id, s, frp, group_root, count(*) OVER (PARTITION BY group_root) AS group_size FROM xy JOIN ro USING (id) QUALIFY row_number() OVER (PARTITION BY group_root ORDER BY frp DESC, id) = 1""",
    "proximity_pairs": f"""WITH {FEED},
pt AS (SELECT id, s, date_trunc('month', t) AS m, [24.0, 60.0, -35.0][id % 3 + 1] + id * 7919 % 401 * 0.0001::DOUBLE AS lat, [90.0, 25.0, -150.0][id % 3 + 1] + id * 5381 % 397 * 0.0001::DOUBLE AS lon FROM feed),
xy AS (SELECT id, s, m, lon * 111.32 * cos(radians(lat)) AS x, lat * 111.32 AS y FROM pt)
SELECT a.id AS a, b.id AS b FROM xy a JOIN xy b ON a.s = b.s AND a.m = b.m AND a.id < b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.2""",
    "static_mask_learn": f"WITH {STATIC.format(years=2)} SELECT * FROM m",
    "static_mask_apply": f"WITH {STATIC.format(years=4)} SELECT id, EXISTS (SELECT 1 FROM m WHERE (m.cx = c.cx AND m.cy = c.cy) OR (coarse AND abs(m.cx - c.cx) <= 1 AND abs(m.cy - c.cy) <= 1)) AS static FROM c",
    "coverage_period": f"WITH {COV} SELECT s, unit, year, p, {AREAS} FROM cov GROUP BY ALL",
    "coverage_country": f"WITH {COV}, a AS (SELECT s, unit, year, p, sum(clear) AS clear, sum(cloud) AS cloud, sum(land) AS land FROM cov GROUP BY ALL), b AS (SELECT * FROM a UNION ALL SELECT s, -1, year, p, sum(clear), sum(cloud), sum(land) FROM a GROUP BY s, year, p) SELECT s, unit, year, p, round(clear, 4) AS clear, round(cloud, 4) AS cloud, round(land, 4) AS land FROM b",
    "daily_coverage": f"WITH {COV}, f AS (SELECT * FROM cov QUALIFY row_number() OVER (PARTITION BY sat, tile, date, unit ORDER BY land, clear) = 1) SELECT sat, date, unit, round(sum(clear), 6) AS clear, round(sum(cloud), 6) AS cloud, round(sum(land), 6) AS land FROM f GROUP BY ALL",
    "seen_pct": f"WITH {COV}, a AS (SELECT sat, date, unit, round(sum(clear), 4) AS clear, sum(land) AS land FROM cov GROUP BY ALL) SELECT sat, date, unit, coalesce(CASE WHEN land <> 0 THEN round_even(100 * clear / land, 0)::INT END, -1) AS seen FROM a",
    "proxy_coverage": f"WITH {COV}, n AS (SELECT s, false AS proxy, year, land FROM cov WHERE s < 3), a AS (SELECT * FROM n UNION ALL SELECT v.s, true, year, land FROM n CROSS JOIN (VALUES (3), (4)) v(s) WHERE n.s = 1) SELECT s, proxy, year, round(sum(land), 4) AS land, count(*) AS n FROM a GROUP BY ALL",
    "sensor_windows": f"WITH {WINDOWS} SELECT * FROM w",
    "country_activity": f"""WITH {WINDOWS}, c AS (SELECT s, unit, year, p, sum(clear) AS clear, sum(land) AS land, count(DISTINCT date) AS n_days FROM cov WHERE unit < 3 GROUP BY ALL),
k AS (SELECT * FROM c UNION ALL SELECT s, -1, year, p, sum(clear), sum(land), CASE WHEN count(*) < 3 THEN 0 ELSE min(n_days) END FROM c GROUP BY s, year, p)
SELECT s, unit, year, p, round(clear, 4) AS clear, round(land, 4) AS land, n_days, coalesce(make_date(year, 1, 1) + (p - 1) * 8 >= start AND least(make_date(year, 1, 1) + (p - 1) * 8 + 7, make_date(year, 12, 31)) <= "end" AND n_days > 0, false) AS active FROM k LEFT JOIN w USING (s)""",
    "activity_mask": f"""WITH {WINDOWS}, c AS (SELECT s, unit, year, p, count(DISTINCT date) AS n_days FROM cov GROUP BY ALL)
SELECT c.*, coalesce(make_date(year, 1, 1) + (p - 1) * 8 >= start AND least(make_date(year, 1, 1) + (p - 1) * 8 + 7, make_date(year, 12, 31)) <= "end" AND n_days > 0, false) AS active FROM c LEFT JOIN w USING (s)""",
    "valid_rates": f"WITH {RATES} SELECT s, unit, year, p, d, round(rho, 6) AS rho, round(ns, 6) AS ns, round(sn, 6) AS sn, round(cs, 6) AS cs FROM ra",
    "sensor_pair_join": f"WITH {RATES} SELECT unit, year, p, x.d AS d_from, y.d AS d_to, round(x.rho, 6) AS rho_from, round(y.rho, 6) AS rho_to FROM ra x JOIN ra y USING (unit, year, p) WHERE x.s = 0 AND y.s = 1",
    "ratio_bridge": f"WITH {RATES} SELECT x.s AS frm, y.s AS to, round(ln(greatest(sum(y.d) / greatest(1e-9, sum(x.rho * y.clear / 1000)), 1e-6)), 6) AS log_ratio, count(*) AS n FROM ra x JOIN ra y USING (unit, year, p) WHERE (x.s, y.s) IN ((0, 1), (2, 1), (3, 2), (4, 3)) GROUP BY ALL",
    "combine": f"WITH {ESTIMATES.format(off='-1')} SELECT unit, year, p, {_K}, n_used FROM k",
    "combine_grounded": f"WITH {ESTIMATES.format(off='0, 1, 2')} SELECT unit, year, p, {_K}, n_used FROM k",
    "raw_total": f"WITH {RATES} SELECT unit, year, p, sum(d)::BIGINT AS total, count(*) AS n_sensors FROM ra GROUP BY ALL",
    "baseline_loo": f"WITH {HISTORY} SELECT unit, year, p, round(v, 6) AS v, round(q10, 6) AS q10, round(q50, 6) AS q50, round(q90, 6) AS q90, round(top, 6) AS top, n FROM bl",
    "baseline_all": f"WITH {HISTORY} SELECT unit, p, round(quantile_cont(b, 0.1), 6) AS q10, round(quantile_cont(b, 0.5), 6) AS q50, round(quantile_cont(b, 0.9), 6) AS q90, round(max(b), 6) AS top, count(b) AS n FROM ex WHERE b IS NOT NULL GROUP BY ALL",
    "period_verdicts": f"WITH {VERDICTS} SELECT unit, year, p, {_K}, round(q10, 6) AS q10, round(q90, 6) AS q90, n, round(p_hi, 6) AS p_hi, round(p_lo, 6) AS p_lo, code FROM vd",
    "raw_class": f"WITH {HISTORY} SELECT unit, year, p, CASE WHEN n < {MIN_N} THEN 7 WHEN v > q90 THEN 5 WHEN v < q10 THEN 1 ELSE 3 END AS code FROM bl",
    "verdict_histogram": f"WITH {VERDICTS} SELECT code, CASE WHEN code = 1 THEN 0 WHEN code IN (5, 6) THEN 2 ELSE 1 END AS class3, code BETWEEN 1 AND 6 AS judged, count(*) AS n FROM vd GROUP BY ALL",
    "intervals": f"WITH {ESTIMATES.format(off='-1')} SELECT unit, year, p, round(exp(mu), 6) AS h, round(exp(mu - {C.Z80!r} * sigma), 6) AS lo80, round(exp(mu + {C.Z80!r} * sigma), 6) AS hi80, round(exp(mu - {C.Z95!r} * sigma), 6) AS lo95, round(exp(mu + {C.Z95!r} * sigma), 6) AS hi95 FROM k",
    "annual_totals": f"WITH {ANNUAL} SELECT unit, year, round(total, 5) AS total, round(sd, 5) AS sd, round(complete, 5) AS complete, round(greatest(0.0, total - {C.Z80!r} * sd), 5) AS lo80, round(total + {C.Z80!r} * sd, 5) AS hi80 FROM an",
    "annual_rank": f"WITH {ANNUAL}, f AS (SELECT unit, year, round(total, 5) AS total, round(complete, 6) >= 0.3 AS ok FROM an) SELECT unit, year, CASE WHEN ok THEN row_number() OVER (PARTITION BY unit, ok ORDER BY total DESC NULLS LAST, year)::INT END AS rank FROM f",
    "peak_window": f"""WITH {HISTORY}, q AS (SELECT unit, p, round(quantile_cont(b, 0.5), 6) AS m FROM ex WHERE b IS NOT NULL GROUP BY ALL),
t AS (SELECT unit, quantile_cont(m, 0.75) AS mark, count(*) AS known FROM q GROUP BY unit),
i AS (SELECT q.unit, p, p - row_number() OVER (PARTITION BY q.unit ORDER BY p) AS island FROM q JOIN t USING (unit) WHERE m > mark AND known >= 20),
r AS (SELECT unit, min(p) AS a, max(p) AS b, count(*) AS n FROM i GROUP BY unit, island)
SELECT n_nationkey AS unit, coalesce(a, -1)::INT AS first_p, coalesce(b, -1)::INT AS last_p FROM nation LEFT JOIN (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY unit ORDER BY n DESC, a) = 1) x ON x.unit = n_nationkey""",
    "flags": f"""WITH {WINDOWS}, c AS (SELECT s, unit, year, p, count(DISTINCT date) AS n_days FROM cov GROUP BY ALL),
a AS (SELECT c.*, coalesce(make_date(year, 1, 1) + (p - 1) * 8 >= start AND least(make_date(year, 1, 1) + (p - 1) * 8 + 7, make_date(year, 12, 31)) <= "end", false) AS active FROM c LEFT JOIN w USING (s))
SELECT unit, year, p, ((CASE WHEN any_value(year) >= 2000 THEN 2 ELSE 4 END) | CASE WHEN bool_or(active AND n_days < CASE WHEN p < 46 THEN 8 ELSE dayofyear(make_date(year, 12, 31)) - 360 END) THEN 8 ELSE 0 END)::INT AS flags FROM a GROUP BY unit, year, p""",
    "pass_sessions": f"WITH {SESSIONS} SELECT s, pass, t, night, n_granules, lower(list_aggregate([printf('%x', coalesce(list_sum([1 << (u % 4) FOR u IN units IF u // 4 = n]), 0)::INT) FOR n IN range(list_max(units) // 4, -1, -1)], 'string_agg', '')) AS bits FROM pt",
    "passes_per_period": f"WITH {SESSIONS}, q AS (SELECT *, year(t)::INT AS year, least(46, (dayofyear(t) - 1) // 8 + 1)::INT AS p FROM pt) SELECT s, unit, year, p, count(*) AS n_passes FROM (SELECT s, year, p, unnest(units) AS unit FROM q) GROUP BY ALL UNION ALL SELECT s, -1, year, p, count(*) FROM q GROUP BY s, year, p",
    "kappa": """WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL), t AS (SELECT sum(n)::DOUBLE AS n, sum(n) FILTER (a = b) AS same FROM c),
m AS (SELECT sum(r * k)::DOUBLE AS rk FROM (SELECT a AS x, sum(n) AS r FROM c GROUP BY a) JOIN (SELECT b AS x, sum(n) AS k FROM c GROUP BY b) USING (x))
SELECT n::BIGINT AS n, round(same / n, 6) AS po, round(rk / (n * n), 6) AS pe, round((same / n - rk / (n * n)) / (1 - rk / (n * n)), 6) AS kappa FROM t, m""",
    "spearman": f"WITH {MONTHLY}, r AS (SELECT year, rank() OVER (PARTITION BY year ORDER BY a) + (count(*) OVER (PARTITION BY year, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY year ORDER BY b) + (count(*) OVER (PARTITION BY year, b) - 1) / 2.0::DOUBLE AS rb FROM mo) SELECT year, round(corr(ra, rb), 6) AS rho, count(*) AS n FROM r GROUP BY year",
    "pearson_bias": f"WITH {MONTHLY} SELECT year, round(corr(a, b), 6) AS pearson, round(avg(a - b), 6) AS bias, count(*) AS n FROM mo GROUP BY year",
    "coverage80": f"WITH {MONTHLY}, z AS (SELECT year, round((a - b) / sqrt(1 / (d_from + 0.5) + 1 / (d_to + 0.5)), 6) AS z FROM mo) SELECT year, round(avg((abs(z) <= {C.Z80!r})::INT::DOUBLE), 6) AS share80, round(avg((abs(z) <= {C.Z95!r})::INT::DOUBLE), 6) AS share95, count(*) AS n FROM z GROUP BY year",
    "kappa_interval": f"""WITH {VERDICTS}, pa AS (SELECT unit, year, CASE WHEN code = 1 THEN 0 WHEN code IN (5, 6) THEN 2 ELSE 1 END AS a, CASE WHEN n < {MIN_N} THEN 1 WHEN v > q90 THEN 2 WHEN v < q10 THEN 0 ELSE 1 END AS b FROM vd WHERE code BETWEEN 1 AND 6),
co AS (SELECT 'year' AS block, year AS k, a, b, count(*) AS n FROM pa GROUP BY ALL UNION ALL SELECT 'unit', unit, a, b, count(*) FROM pa GROUP BY ALL),
bk AS (SELECT block, k, row_number() OVER (PARTITION BY block ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY block) AS blocks FROM (SELECT DISTINCT block, k FROM co)),
pk AS (SELECT s.block, d, floor(('0x' || substr(md5('7:' || d || ':' || j), 1, 13))::UBIGINT / 4503599627370496.0::DOUBLE * s.blocks)::INT AS i FROM (SELECT DISTINCT block, blocks FROM bk) s CROSS JOIN range(1000) AS t(d), LATERAL range(s.blocks) AS u(j)),
dr AS (SELECT pk.block, d, a, b, sum(n)::DOUBLE AS n FROM pk JOIN bk ON bk.block = pk.block AND bk.i = pk.i JOIN co ON co.block = bk.block AND co.k = bk.k GROUP BY ALL),
tt AS (SELECT block, d, sum(n) AS t, sum(n) FILTER (a = b) AS same FROM dr GROUP BY ALL),
mg AS (SELECT block, d, sum(r * c) AS rc FROM (SELECT block, d, a AS x, sum(n) AS r FROM dr GROUP BY ALL) JOIN (SELECT block, d, b AS x, sum(n) AS c FROM dr GROUP BY ALL) USING (block, d, x) GROUP BY ALL),
ka AS (SELECT block, CASE WHEN coalesce(rc, 0) / (t * t) < 1 THEN (coalesce(same, 0) / t - coalesce(rc, 0) / (t * t)) / (1 - coalesce(rc, 0) / (t * t)) END AS kappa FROM tt LEFT JOIN mg USING (block, d))
SELECT block, round(quantile_cont(kappa, 0.025), 5) AS lo, round(quantile_cont(kappa, 0.975), 5) AS hi, count(kappa)::INT AS draws FROM ka GROUP BY block""",
    "calibrate_r": f"""WITH {ESTIMATES.format(off='-1')}, j AS (SELECT a.mu AS m1, a.sigma AS s1, b.mu AS m2, b.sigma AS s2, c.mu AS t, c.sigma ** 2 / 8 AS tv FROM e a JOIN e b USING (unit, year, p) JOIN e c USING (unit, year, p) WHERE a.s = 0 AND b.s = 2 AND c.s = 1),
h AS (SELECT k, avg((abs(t - (m1 / s1 ** 2 + m2 / s2 ** 2) / (1 / s1 ** 2 + 1 / s2 ** 2)) <= {C.Z80!r} * sqrt((1 + k / 10) / (1 / s1 ** 2 + 1 / s2 ** 2) + tv))::INT::DOUBLE) AS share, count(*) AS n FROM j CROSS JOIN range(10) AS r(k) GROUP BY k)
SELECT CASE WHEN coalesce(max(n), 0) < 10 THEN 0.3 ELSE coalesce((min(k) FILTER (share >= 0.8)) / 10, 0.9) END::DOUBLE AS r, coalesce(max(n), 0) AS n FROM h""",
}
