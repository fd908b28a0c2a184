"""The validation suite and the published shapes on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import geo, scores
from ..operators import baseline, evaluation, export, panel, publish, selection, validation
from ..sources import fixtures as fx
from . import layer_queries as layer
from . import panel_queries as pq
from .panel_queries import COV, DET, HISTORY, MIN_N

CELL = evaluation.CELL
TRAINED = 1998


def _own(spark: SparkSession, sf: str, s: int) -> DataFrame:
    return panel.estimates(fx.detections(spark, sf)).where(F.col("s") == s).select(*CELL, "d", "mu", "sigma")


def _base(spark: SparkSession, sf: str) -> DataFrame:
    return baseline.leave_one_out(pq._history(spark, sf), pq.WINDOW)


def _fleet(spark: SparkSession, sf: str, *off: int) -> DataFrame:
    return panel.combine(panel.estimates(fx.detections(spark, sf)), 0.3, disabled=off)


def continuity(spark: SparkSession, sf: str) -> DataFrame:
    """Sensor 3 in four ways against the reference sensor's verdicts."""
    base, own, ref = _base(spark, sf).persist(), _own(spark, sf, 3), _own(spark, sf, 1)
    train = F.col("year") <= TRAINED
    raw = base.join(own.select(*CELL, "d"), CELL, "left").withColumn("code", scores.raw_class(F.col("d"), F.col("q10"), F.col("q90"), F.col("n"), MIN_N))
    candidates = {
        "own_rate": evaluation.judge(own, base, MIN_N),
        "raw_counts": raw,
        "constant_ratio": evaluation.judge(evaluation.constant_ratio(own, ref, train), base, MIN_N),
        "month_ratio": evaluation.judge(evaluation.month_ratio(own, ref, train, 5), base, MIN_N),
    }
    out = evaluation.continuity(evaluation.judge(ref, base, MIN_N), candidates, 5)
    return out.withColumns({"judged_share": F.round("judged_share", 6), "kappa": F.round("kappa", 6)})


def reference_control(spark: SparkSession, sf: str) -> DataFrame:
    """Sensor 0 against the reference: classes and limits together."""
    base, own, ref = _base(spark, sf).persist(), _own(spark, sf, 0), _own(spark, sf, 1)
    row = evaluation.continuity(evaluation.judge(ref, base, MIN_N), {"control": evaluation.judge(own, base, MIN_N)}, 5)
    both = own.join(ref.select(*CELL, F.col("mu").alias("m"), F.col("sigma").alias("s")), CELL)
    z = (F.col("mu") - F.col("m")) / F.sqrt(F.col("sigma") * F.col("sigma") + F.col("s") * F.col("s"))
    shares = validation.interval_shares(both, F.round(z, 6)).select("share80", F.col("n").alias("cells"))
    return row.crossJoin(shares).select("n", F.round("kappa", 6).alias("kappa"), F.round("share80", 6).alias("share80"), "cells")  # one row each


def national_series(spark: SparkSession, sf: str) -> DataFrame:
    """Country sums of each sensor against the reference: correlation and mean difference of log counts."""
    counts = panel.with_country(panel.counts(fx.detections(spark, sf)), ["d"]).where((F.col("unit") == panel.COUNTRY) & (F.col("d") > 0))
    rate = counts.select("s", "year", "p", F.round(F.ln(F.col("d") + 0.5), 6).alias("a"))
    ref = rate.where(F.col("s") == C.REFERENCE_SENSOR).select("year", "p", F.col("a").alias("b"))
    out = validation.agreement(rate.where(F.col("s") != C.REFERENCE_SENSOR).join(ref, ["year", "p"]), "a", "b", "s")
    return out.withColumns({"pearson": F.round("pearson", 6), "bias": F.round("bias", 6)})


def _against(spark: SparkSession, sf: str) -> DataFrame:
    e = panel.estimates(fx.detections(spark, sf))
    ref = _own(spark, sf, 1).select(*CELL, F.col("mu").alias("truth"), F.col("sigma").alias("truth_sigma"))
    return e.where(F.col("s") != 1).join(ref, CELL)


def sigma_scale(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.sigma_scale(_against(spark, sf), "s", least=10)
    return out.withColumn("factor", F.round("factor", 6))


def rescaled_sigmas(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _against(spark, sf)
    scaled = pairs.join(F.broadcast(evaluation.sigma_scale(pairs, "s", least=10).drop("n")), "s")  # one row a sensor
    return scaled.select("s", *CELL, F.round(evaluation.rescaled(F.col("sigma"), F.col("truth_sigma"), F.col("factor")), 5).alias("sigma"))


def interval_split(spark: SparkSession, sf: str) -> DataFrame:
    m = pq._monthly(spark, sf)
    z = F.round((F.col("a") - F.col("b")) / F.sqrt(1 / (F.col("d_from") + 0.5) + 1 / (F.col("d_to") + 0.5)), 6)
    out = evaluation.interval_split(m, z, F.col("d_from").cast("double"), 1.0)
    return out.withColumns({"share80": F.round("share80", 6), "share95": F.round("share95", 6)})


def step_change(spark: SparkSession, sf: str) -> DataFrame:
    """What sensor 2 changes beside sensors 0 and 1, over blocks of units."""
    out = evaluation.step_change(_fleet(spark, sf, 3, 4), _fleet(spark, sf, 2, 3, 4))
    return out.select("n", *[F.round(c, 5).alias(c) for c in ("mean", "lo", "hi")])


def quiet_cells(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.quiet(_base(spark, sf).where(F.col("q50").isNotNull()).withColumn("q50", F.round("q50", 6))).select(*CELL)


def cloud_artifact(spark: SparkSession, sf: str) -> DataFrame:
    """Rank correlation of anomaly and coverage in quiet cells, which should be near 0."""
    quiet = evaluation.quiet(_base(spark, sf).where(F.col("q50").isNotNull()).withColumn("q50", F.round("q50", 6)))
    cover = panel.coverage_cells(fx.coverage(spark, sf), CELL).select(*CELL, F.round("coverage", 6).alias("coverage"))
    z = F.round((F.col("mu") - F.ln(F.greatest(F.col("q50"), F.lit(1e-6)))) / F.col("sigma"), 6)
    rows = quiet.join(_fleet(spark, sf), CELL).join(cover, CELL).select(z.alias("z"), "coverage")
    return validation.spearman(rows, "z", "coverage").withColumn("rho", F.round("rho", 6))


def verdicts_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Classes that stay when sensors 0, 1 and 2 are switched off."""
    base = _base(spark, sf).persist()
    return evaluation.kept(evaluation.judge(_fleet(spark, sf), base, MIN_N), evaluation.judge(_fleet(spark, sf, 0, 1, 2), base, MIN_N))


# shapes


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    d = panel.counts(fx.detections(spark, sf), CELL).select(*CELL, "d")
    return evaluation.judge(_fleet(spark, sf), _base(spark, sf), MIN_N).join(d, CELL, "left")


def _text(c: str) -> F.Column:
    """A nested array of whole numbers as text."""
    inner = lambda row: F.concat(F.lit("["), F.array_join(row, ",", "null"), F.lit("]"))
    return F.concat(F.lit("["), F.array_join(F.transform(c, inner), ","), F.lit("]")).alias(c)


def snapshot_shape(spark: SparkSession, sf: str) -> DataFrame:
    out = publish.snapshots(_cells(spark, sf))
    return out.select("year", F.array_join("units", ",").alias("units"), *map(_text, ("verdict", "raw", "mu")))


def detections_shape(spark: SparkSession, sf: str) -> DataFrame:
    out = publish.detections(fx.detections(spark, sf))
    return out.select("year", "period", *[F.array_join(c, ",").alias(c) for c in ("s", "t", "frp", "x", "u")])


def daily_shape(spark: SparkSession, sf: str) -> DataFrame:
    cover = fx.coverage(spark, sf).groupBy("date", "unit").agg(F.round(F.sum("clear"), 4).alias("clear"), F.sum("land").alias("land"))
    out = publish.daily(panel.seen_percent(cover), fx.units(spark, sf))
    return out.select("year", "days", _text("seen"))


def meta_document(spark: SparkSession, sf: str) -> DataFrame:
    windows = pq.sensor_windows(spark, sf)
    out = publish.meta(fx.units(spark, sf), windows)
    sensors = F.array_join(F.transform("sensors", lambda x: F.concat_ws(":", x["s"].cast("string"), x["start"].cast("string"), x["end"].cast("string"))), ",")
    units = F.array_join(F.transform("units", lambda x: F.concat_ws(":", x["idx"].cast("string"), x["name"], x["parent"])), ",")
    return out.select(sensors.alias("sensors"), units.alias("units"), "periods", "min_baseline_n")


def published_codes(spark: SparkSession, sf: str) -> DataFrame:
    cells = evaluation.judge(_fleet(spark, sf), _base(spark, sf), MIN_N)
    return publish.published_codes(cells.select(*CELL, "code"), pq.activity_mask(spark, sf))


def period_land(spark: SparkSession, sf: str) -> DataFrame:
    out = panel.period_land(fx.coverage(spark, sf), pq.FIRST, pq.LAST)
    return out.withColumn("land_days", F.round("land_days", 4))


def dropped_gate(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.detections(spark, sf)
    return publish.dropped_gate(export.reconcile(d, d.where(F.col("x") != 2), ["s", "year"]))


def export_eligible(spark: SparkSession, sf: str) -> DataFrame:
    cover = panel.coverage_cells(fx.coverage(spark, sf), CELL).select(*CELL, scores.rounded(F.round("coverage", 6), 3).alias("coverage"))
    cells = evaluation.judge(_fleet(spark, sf), _base(spark, sf), MIN_N).join(cover, CELL, "left")
    return publish.eligible(cells, 1997)


def provenance_text(spark: SparkSession, sf: str) -> DataFrame:
    return publish.provenance_text(pq.sensor_windows(spark, sf), True, (pq.FIRST, TRAINED))


def units_order(spark: SparkSession, sf: str) -> DataFrame:
    return publish.units_in_order(fx.units(spark, sf)).select("idx", "name", "parent")


def latest_feed(spark: SparkSession, sf: str) -> DataFrame:
    return publish.latest_feed(fx.feed(spark, sf))


def tile_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles that cover the feed, by zoom."""
    return geo.covering_tiles(fx.feed(spark, sf), 5, 11).groupBy("zoom").agg(F.count(F.lit(1)).alias("tiles"), F.min("x").alias("x"), F.min("y").alias("y"))


# one answer


def selection_answer(spark: SparkSession, sf: str) -> DataFrame:
    areas = fx.units(spark, sf).select("name", F.col("unit").alias("place"))
    a = selection.answer(layer.observations(spark, sf), layer.estimates(spark, sf), areas, layer.CHOICE)
    join = lambda c, f: F.array_join(F.transform(c, f), ",").alias(c)
    text = lambda x: x.cast("string")
    return a.select(
        F.size("rows").alias("rows"), join("stats", lambda x: F.concat_ws(":", x["name"], text(x["count"]))), join("passes", lambda x: F.concat_ws(":", x["satellite"], text(x["count"]), text(x["days"]), text(x["off"]))),
        join("by_satellite", lambda x: F.concat_ws(":", x["satellite"], text(x["count"]))), "kept", "total", "low", "excluded", "raw_retention",
    )


def evidence_document(spark: SparkSession, sf: str) -> DataFrame:
    return selection.evidence(layer.observations(spark, sf).select("id", "district", "satellite", "year", "period", "low_confidence", "excluded"), layer.CHOICE)


def table_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The first 500 rows of a selection's table, as it shows them."""
    return selection.table_rows(layer.observations(spark, sf).where(F.col("year") == layer.CHOICE.year)).select("id", "district", "satellite", "date")


QUERIES = {f.__name__: f for f in (continuity, reference_control, national_series, sigma_scale, rescaled_sigmas, interval_split, step_change, quiet_cells, cloud_artifact, verdicts_kept, snapshot_shape, detections_shape, daily_shape, meta_document, published_codes, period_land, dropped_gate, export_eligible, provenance_text, units_order, latest_feed, tile_cover, selection_answer, evidence_document, table_rows)}


def _verdicts(source: str, more: str = "") -> str:
    """SELECT of the verdict of a table's mu and sigma against bl."""
    return f"""SELECT *, CASE WHEN mu IS NULL OR sigma IS NULL THEN 0 WHEN n < {MIN_N} THEN 7 WHEN exp(mu - {C.Z80!r} * sigma) > top THEN 6 WHEN ph >= {C.P_SURE} THEN 5 WHEN ph >= {C.P_MAYBE} THEN 4
  WHEN pl >= {C.P_SURE} AND q10 >= {C.Q_MIN} THEN 1 WHEN pl >= {C.P_MAYBE} AND q10 >= {C.Q_MIN} THEN 2 ELSE 3 END AS code
FROM (SELECT *, 1 - {pq._cdf('zh')} AS ph, {pq._cdf('zl')} AS pl FROM (SELECT bl.*, mu, sigma, (ln(q90) - mu) / sigma AS zh, (ln(q10) - mu) / sigma AS zl FROM bl LEFT JOIN {source} USING (unit, year, p)))"""


CLASS3 = "CASE WHEN code = 1 THEN 0 WHEN code IN (5, 6) THEN 2 ELSE 1 END"
DD = "dd AS (SELECT s, unit, year, p, d, ln(1 + d) AS mu, 1 / sqrt(d + 0.5) AS sigma FROM (SELECT s, unit, year, p, count(*) FILTER (x = 0) AS d FROM det GROUP BY ALL) WHERE d > 0)"


def _fleet_sql(name: str, off: str) -> str:
    return f"{name} AS (SELECT unit, year, p, sum(mu / (sigma * sigma)) / sum(1 / (sigma * sigma)) AS mu, sqrt((1 + (count(*) - 1) * 0.3) / sum(1 / (sigma * sigma))) AS sigma FROM dd WHERE s NOT IN ({off}) GROUP BY ALL)"


def _kappa_sql(table: str) -> str:
    """One row n, kappa of a table with a and b."""
    return f"""SELECT t.n, CASE WHEN e.rc / (t.n * t.n) < 1 THEN (t.same / t.n - e.rc / (t.n * t.n)) / (1 - e.rc / (t.n * t.n)) END AS kappa
FROM (SELECT count(*)::DOUBLE AS n, count(*) FILTER (a = b)::DOUBLE AS same FROM {table}) t,
     (SELECT coalesce(sum(r * c), 0)::DOUBLE AS rc FROM (SELECT a AS x, count(*) AS r FROM {table} GROUP BY a) JOIN (SELECT b AS x, count(*) AS c FROM {table} GROUP BY b) USING (x)) e"""


def _candidate(name: str, table: str) -> tuple[str, str]:
    pairs = f"p_{name} AS (SELECT a, {CLASS3} AS b FROM ref JOIN {table} USING (unit, year, p) WHERE code BETWEEN 1 AND 6), k_{name} AS ({_kappa_sql('p_' + name)})"
    return pairs, f"SELECT '{name}' AS candidate, n::BIGINT AS n, round(coalesce(n / nullif((SELECT count(*) FROM ref), 0), 0), 6) AS judged_share, CASE WHEN n >= 5 THEN round(kappa, 6) END AS kappa FROM k_{name}"


_C = [_candidate(n, f"v_{n}") for n in ("own_rate", "raw_counts", "constant_ratio", "month_ratio")]
_BOTH = f"j AS (SELECT x.*, y.d AS rd FROM dd x JOIN dd y USING (unit, year, p) WHERE x.s = 3 AND y.s = 1 AND x.year <= {TRAINED})"
_MONTH = "least(floor((p - 1) * 8 / 30.5::DOUBLE), 11)::INT"
_REF = f"ref AS (SELECT unit, year, p, {CLASS3} AS a FROM ({_verdicts('(SELECT * FROM dd WHERE s = 1)')}) WHERE code BETWEEN 1 AND 6)"
_COVER = "cv AS (SELECT unit, year, p, round(sum(clear) / nullif(sum(land), 0), 6) AS coverage FROM cov GROUP BY ALL)"
_QUIET = "qb AS (SELECT unit, year, p, round(q50, 6) AS q50 FROM bl WHERE q50 IS NOT NULL), qc AS (SELECT * FROM qb WHERE q50 < (SELECT quantile_cont(q50, 0.5) FROM qb))"
_RANKS = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE"
_HERE = layer._HERE
_ALLOWED = f"{layer.KEPT} AND {layer.NEWER}"
_FIXED = [f"('{n}', {str(r).lower()}, {k})" for k, (n, r) in enumerate(C.SATELLITES.items())]

ORACLE_SQL = {
    "continuity": f"""WITH {HISTORY}, {DD}, {_REF}, {_BOTH},
r1 AS (SELECT ln(sum(rd) / greatest(sum(d), 1)) AS shift FROM j), r2 AS (SELECT {_MONTH} AS m, ln(greatest(sum(rd), 1) / greatest(sum(d), 1)) AS shift FROM j GROUP BY 1 HAVING count(*) >= 5),
v_own_rate AS ({_verdicts('(SELECT * FROM dd WHERE s = 3)')}),
v_raw_counts AS (SELECT bl.unit, bl.year, bl.p, CASE WHEN d IS NULL THEN 0 WHEN n < {MIN_N} THEN 7 WHEN d > q90 THEN 5 WHEN d < q10 THEN 1 ELSE 3 END AS code FROM bl LEFT JOIN (SELECT * FROM dd WHERE s = 3) USING (unit, year, p)),
v_constant_ratio AS ({_verdicts('(SELECT unit, year, p, mu + shift AS mu, sigma FROM dd, r1 WHERE s = 3)')}),
v_month_ratio AS ({_verdicts(f'(SELECT unit, year, p, mu + shift AS mu, sigma FROM dd JOIN r2 ON r2.m = {_MONTH} WHERE s = 3)')}),
{', '.join(p for p, _ in _C)} {' UNION ALL '.join(q for _, q in _C)}""",
    "reference_control": f"""WITH {HISTORY}, {DD}, {_REF}, v AS ({_verdicts('(SELECT * FROM dd WHERE s = 0)')}), pr AS (SELECT a, {CLASS3} AS b FROM ref JOIN v USING (unit, year, p) WHERE code BETWEEN 1 AND 6), k AS ({_kappa_sql('pr')}),
z AS (SELECT round((x.mu - y.mu) / sqrt(x.sigma * x.sigma + y.sigma * y.sigma), 6) AS z FROM dd x JOIN dd y USING (unit, year, p) WHERE x.s = 0 AND y.s = 1)
SELECT n::BIGINT AS n, CASE WHEN n >= 5 THEN round(kappa, 6) END AS kappa, round(share80, 6) AS share80, cells FROM k, (SELECT avg((abs(z) <= {C.Z80!r})::INT::DOUBLE) AS share80, count(*) AS cells FROM z)""",
    "national_series": f"WITH {DET}, a AS (SELECT s, year, p, round(ln(count(*) FILTER (x = 0) + 0.5), 6) AS a FROM det GROUP BY ALL HAVING count(*) FILTER (x = 0) > 0) SELECT x.s, round(corr(x.a, y.a), 6) AS pearson, round(avg(x.a - y.a), 6) AS bias, count(*) AS n FROM a x JOIN a y USING (year, p) WHERE x.s <> 1 AND y.s = 1 GROUP BY x.s",
    "sigma_scale": f"WITH {DET}, {DD}, z AS (SELECT x.s, abs(x.mu - y.mu) / sqrt(x.sigma * x.sigma + y.sigma * y.sigma) AS z FROM dd x JOIN dd y USING (unit, year, p) WHERE x.s <> 1 AND y.s = 1) SELECT s, CASE WHEN count(*) >= 10 THEN round(quantile_cont(z, 0.8) / {C.Z80!r}, 6) ELSE 1.0 END::DOUBLE AS factor, count(*) AS n FROM z GROUP BY s",
    "rescaled_sigmas": f"""WITH {DET}, {DD}, z AS (SELECT x.s, unit, year, p, x.sigma AS sx, y.sigma AS sy, abs(x.mu - y.mu) / sqrt(x.sigma * x.sigma + y.sigma * y.sigma) AS z FROM dd x JOIN dd y USING (unit, year, p) WHERE x.s <> 1 AND y.s = 1),
f AS (SELECT s, CASE WHEN count(*) >= 10 THEN quantile_cont(z, 0.8) / {C.Z80!r} ELSE 1.0 END AS f FROM z GROUP BY s)
SELECT s, unit, year, p, round(sqrt(greatest(f * f * (sx * sx + sy * sy) - sy * sy, 0.04 * sx * sx)), 5) AS sigma FROM z JOIN f USING (s)""",
    "interval_split": f"WITH {pq.MONTHLY}, z AS (SELECT d_from, round((a - b) / sqrt(1 / (d_from + 0.5) + 1 / (d_to + 0.5)), 6) AS z FROM mo), x AS (SELECT 'all' AS cells, z FROM z UNION ALL SELECT 'informative', z FROM z WHERE d_from >= 1) SELECT cells, round(avg((abs(z) <= {C.Z80!r})::INT::DOUBLE), 6) AS share80, round(avg((abs(z) <= {C.Z95!r})::INT::DOUBLE), 6) AS share95, count(*) AS n FROM x GROUP BY cells",
    "step_change": f"""WITH {DET}, {DD}, {_fleet_sql('f3', '3, 4')}, {_fleet_sql('f2', '2, 3, 4')}, st AS (SELECT unit, sum(f3.mu - f2.mu) AS total, count(*) AS n FROM f3 JOIN f2 USING (unit, year, p) GROUP BY unit),
bk AS (SELECT *, row_number() OVER (ORDER BY unit) - 1 AS i, count(*) OVER () AS blocks FROM st),
pk AS (SELECT d, floor(('0x' || substr(md5('11:' || d || ':' || j), 1, 13))::UBIGINT / 4503599627370496.0::DOUBLE * s.blocks)::INT AS i FROM (SELECT DISTINCT blocks FROM bk) s CROSS JOIN range(500) AS t(d), LATERAL range(s.blocks) AS u(j)),
dm AS (SELECT d, sum(total) / sum(n) AS mean FROM pk JOIN bk USING (i) GROUP BY d)
SELECT (SELECT sum(n)::BIGINT FROM st) AS n, round((SELECT sum(total) / sum(n) FROM st), 5) AS mean, round(quantile_cont(mean, 0.025), 5) AS lo, round(quantile_cont(mean, 0.975), 5) AS hi FROM dm""",
    "quiet_cells": f"WITH {HISTORY}, {_QUIET} SELECT unit, year, p FROM qc",
    "cloud_artifact": f"""WITH {HISTORY}, {DD}, {_fleet_sql('fl', '-1')}, {COV}, {_COVER}, {_QUIET},
r AS (SELECT round((mu - ln(greatest(q50, 1e-6))) / sigma, 6) AS z, coverage FROM qc JOIN fl USING (unit, year, p) JOIN cv USING (unit, year, p) WHERE coverage IS NOT NULL),
k AS (SELECT {_RANKS.format('z')} AS ra, {_RANKS.format('coverage')} AS rb FROM r) SELECT round(corr(ra, rb), 6) AS rho, count(*) AS n FROM k""",
    "verdicts_kept": f"""WITH {HISTORY}, {DD}, {_fleet_sql('fa', '-1')}, {_fleet_sql('fb', '0, 1, 2')}, va AS ({_verdicts('fa')}), vb AS ({_verdicts('fb')}),
ab AS (SELECT unit, {CLASS3.replace('code', 'va.code')} = {CLASS3.replace('code', 'vb.code')} AS same FROM va JOIN vb USING (unit, year, p) WHERE va.code BETWEEN 1 AND 6), g AS (SELECT unit, count(*) AS n, count(*) FILTER (same) AS k FROM ab GROUP BY unit)
SELECT unit, n, round(k / n, 4) AS kept FROM g UNION ALL SELECT -1, sum(n)::BIGINT, round(sum(k) / sum(n), 4) FROM g""",
    "snapshot_shape": f"""WITH {HISTORY}, {DD}, {_fleet_sql('fa', '-1')}, dc AS (SELECT unit, year, p, count(*) FILTER (x = 0) AS d FROM det GROUP BY ALL), v AS (SELECT * FROM ({_verdicts('fa')}) LEFT JOIN dc USING (unit, year, p)),
u AS (SELECT year, unit, '[' || string_agg(code::VARCHAR, ',' ORDER BY p) || ']' AS verdict, '[' || string_agg(coalesce(d::VARCHAR, 'null'), ',' ORDER BY p) || ']' AS raw, '[' || string_agg(coalesce(round_even(mu * 1000, 0)::BIGINT::VARCHAR, 'null'), ',' ORDER BY p) || ']' AS mu FROM v GROUP BY year, unit)
SELECT year, string_agg(unit::VARCHAR, ',' ORDER BY unit) AS units, '[' || string_agg(verdict, ',' ORDER BY unit) || ']' AS verdict, '[' || string_agg(raw, ',' ORDER BY unit) || ']' AS raw, '[' || string_agg(mu, ',' ORDER BY unit) || ']' AS mu FROM u GROUP BY year""",
    "detections_shape": f"""WITH {DET}, r AS (SELECT *, floor((epoch(t) - epoch(TIMESTAMP '2000-01-01')) / 60)::BIGINT AS m FROM det)
SELECT year, p AS period, string_agg(s::VARCHAR, ',' ORDER BY m, id) AS s, string_agg(m::VARCHAR, ',' ORDER BY m, id) AS t, string_agg(round_even(frp, 0)::BIGINT::VARCHAR, ',' ORDER BY m, id) AS frp, string_agg(x::VARCHAR, ',' ORDER BY m, id) AS x, string_agg(unit::VARCHAR, ',' ORDER BY m, id) AS u FROM r GROUP BY ALL""",
    "daily_shape": f"""WITH {COV}, a AS (SELECT date, unit, round(sum(clear), 4) AS clear, sum(land) AS land FROM cov GROUP BY ALL), sn AS (SELECT date, unit, coalesce(CASE WHEN land <> 0 THEN round_even(100 * clear / land, 0)::INT END, -1) AS seen FROM a),
y AS (SELECT DISTINCT year(date)::INT AS year FROM a), f AS (SELECT year, (make_date(year, 1, 1) + k::INT)::DATE AS date, n_nationkey AS unit FROM y CROSS JOIN nation, LATERAL range(dayofyear(make_date(year, 12, 31))) AS t(k)),
g AS (SELECT year, unit, '[' || string_agg(coalesce(seen, -1)::VARCHAR, ',' ORDER BY f.date) || ']' AS seen FROM f LEFT JOIN sn USING (date, unit) GROUP BY year, unit)
SELECT year, dayofyear(make_date(year, 12, 31))::INT AS days, '[' || string_agg(seen, ',' ORDER BY unit) || ']' AS seen FROM g GROUP BY year""",
    "meta_document": f"""WITH {pq.WINDOWS}, u AS (SELECT row_number() OVER (ORDER BY r_name, n_name) - 1 AS idx, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT (SELECT string_agg(concat_ws(':', s, start::DATE, "end"::DATE), ',' ORDER BY s) FROM w) AS sensors, (SELECT string_agg(concat_ws(':', idx, n_name, r_name), ',' ORDER BY idx) FROM u) AS units, {C.PERIODS} AS periods, {C.MIN_BASELINE_N} AS min_baseline_n""",
    "published_codes": f"""WITH {HISTORY}, {DD}, {_fleet_sql('fa', '-1')}, {pq.WINDOWS.removeprefix(DET + ',').lstrip()}, c AS (SELECT s, unit, year, p, count(DISTINCT date) AS n_days FROM cov GROUP BY ALL),
ac AS (SELECT unit, year, p, bool_or(coalesce(make_date(year, 1, 1) + (p - 1) * 8 >= start AND least(make_date(year, 1, 1) + (p - 1) * 8 + 7, make_date(year, 12, 31)) <= "end" AND n_days > 0, false)) AS any_one FROM c LEFT JOIN w USING (s) GROUP BY ALL)
SELECT v.unit, v.year, v.p, CASE WHEN coalesce(any_one, false) THEN code ELSE -1 END AS code FROM ({_verdicts('fa')}) v LEFT JOIN ac USING (unit, year, p)""",
    "period_land": f"""WITH {COV}, d AS (SELECT s, unit, date, sum(land) AS land FROM cov GROUP BY ALL), u AS (SELECT unit, max(land) AS land FROM d GROUP BY unit)
SELECT unit, y::INT AS year, q::INT AS p, round(land * CASE WHEN q < 46 THEN 8 ELSE dayofyear(make_date(y::INT, 12, 31)) - 360 END, 4) AS land_days FROM u CROSS JOIN range({pq.FIRST}, {pq.LAST + 1}) AS a(y) CROSS JOIN range(1, 47) AS b(q)""",
    "dropped_gate": f"WITH {DET} SELECT s, year, count(*) AS raw, count(*) FILTER (x <> 2) AS kept, round(1 - count(*) FILTER (x <> 2) / count(*), 4) AS dropped, round(1 - count(*) FILTER (x <> 2) / count(*), 4) > {publish.MAX_DROPPED} AS refused FROM det GROUP BY ALL",
    "export_eligible": f"""WITH {HISTORY}, {DD}, {_fleet_sql('fa', '-1')}, {COV}, {_COVER}, v AS (SELECT * FROM ({_verdicts('fa')}) JOIN cv USING (unit, year, p) WHERE code BETWEEN 0 AND 6 AND year >= 1997 AND coverage IS NOT NULL), j AS (SELECT *, code BETWEEN 1 AND 6 AS ok FROM v)
SELECT unit, year, p - 1 AS period, CASE WHEN ok THEN round(exp(mu), 5) ELSE 0.0 END::DOUBLE AS value, CASE WHEN ok THEN round(exp(mu - {C.Z80!r} * sigma), 5) ELSE 0.0 END::DOUBLE AS lower, CASE WHEN ok THEN round(exp(mu + {C.Z80!r} * sigma), 5) ELSE 0.0 END::DOUBLE AS upper,
  CASE WHEN ok THEN round(ph, 4) ELSE 0.0 END::DOUBLE AS probability, round(round(coverage, 3) * 100, 1) AS coverage, coalesce(round(q50, 5), 0.0)::DOUBLE AS "baselineMedian" FROM j""",
    "provenance_text": f"""WITH {pq.WINDOWS} SELECT 'detections through ' || strftime(max("end"), '%Y-%m-%d') || '; coverage proxied from the reference sensor; trained on {pq.FIRST}-{TRAINED}' AS provenance FROM w""",
    "units_order": "SELECT (row_number() OVER (ORDER BY r_name, n_name) - 1)::INT AS idx, n_name AS name, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey",
    "latest_feed": f"WITH {pq.FEED}, m AS (SELECT max(t)::DATE AS newest FROM feed) SELECT s, t::DATE AS day, count(*) AS n, max(t) AS through FROM feed, m WHERE newest - t::DATE < 7 GROUP BY ALL",
    "tile_cover": f"""WITH {pq.FEED}, b AS (SELECT min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM feed), z AS (SELECT z::INT AS zoom, floor((w + 180) / 360 * pow(2, z))::BIGINT AS x0, floor((e + 180) / 360 * pow(2, z))::BIGINT AS x1,
  floor((1 - asinh(tan(radians(n))) / pi()) / 2 * pow(2, z))::BIGINT AS y0, floor((1 - asinh(tan(radians(s))) / pi()) / 2 * pow(2, z))::BIGINT AS y1 FROM b, range(5, 12) AS t(z))
SELECT zoom, (x1 - x0 + 1) * (y1 - y0 + 1) AS tiles, x0 AS x, y0 AS y FROM z""",
    "selection_answer": f"""WITH {layer.OBS}, h AS (SELECT * FROM obs WHERE {_HERE}), c AS (SELECT n_name AS name, n_nationkey AS k, count(h.id) FILTER ({_ALLOWED}) AS n FROM nation LEFT JOIN h ON h.district = n_name GROUP BY ALL), f(satellite, retiring, k) AS (VALUES {', '.join(_FIXED)}),
b AS (SELECT f.satellite, k, retiring, count(h.id) AS n, count(DISTINCT date::DATE) AS days FROM f LEFT JOIN h ON h.satellite = f.satellite GROUP BY ALL)
SELECT (SELECT count(*)::INT FROM h WHERE {_ALLOWED}) AS rows, (SELECT string_agg(name || ':' || n, ',' ORDER BY k) FROM c) AS stats, (SELECT string_agg(satellite || ':' || n || ':' || days || ':' || retiring, ',' ORDER BY k) FROM b) AS passes,
  (SELECT string_agg(satellite || ':' || n, ',' ORDER BY k) FROM b) AS by_satellite, count(*) FILTER ({_ALLOWED}) AS kept, count(*) FILTER ({layer.KEPT}) AS total, count(*) FILTER (low_confidence) AS low, count(*) FILTER (excluded) AS excluded,
  CASE WHEN count(*) FILTER ({layer.KEPT}) > 0 THEN floor(100 * count(*) FILTER ({_ALLOWED}) / count(*) FILTER ({layer.KEPT}) + 0.5)::BIGINT END AS raw_retention FROM h""",
    "evidence_document": f"""WITH {layer.OBS}, h AS (SELECT * FROM obs WHERE {_HERE} AND {_ALLOWED})
SELECT '{{"version":1,"selection":{{"year":{layer.CHOICE.year},"period":{layer.CHOICE.period},"area":"{layer.CHOICE.area}","satellite":null,"grounded":true,"include_low":false,"include_excluded":false}},"observations":[' || coalesce(string_agg('{{"id":' || id || ',"district":"' || district || '","satellite":"' || satellite || '","year":' || year || ',"period":' || period || ',"low_confidence":' || low_confidence || ',"excluded":' || excluded || '}}', ',' ORDER BY id), '') || ']}}' AS value FROM h""",
    "table_rows": f"WITH {layer.OBS} SELECT id, district, satellite, date FROM obs WHERE year = {layer.CHOICE.year} ORDER BY date, id LIMIT 500",
}
