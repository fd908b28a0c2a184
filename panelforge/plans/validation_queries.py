"""Candidates and counter-checks of the validation on the driver's tables, with SQL from their formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import continuity, panel, validation
from ..sources import fixtures as fx
from . import panel_queries as pq
from . import report_queries as rq
from .panel_queries import HISTORY, MIN_N, RATES, WINDOW

KEY = continuity.KEY
TRAINED, NOISE = 1996, 0.3


def _alpha(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(NOISE).alias("alpha"))


def _of(spark: SparkSession, sf: str, s: int) -> DataFrame:
    return pq._rates(spark, sf).where(F.col("s") == s)


def _spine(spark: SparkSession, sf: str) -> DataFrame:
    return panel.spine(fx.units(spark, sf), pq.FIRST, pq.LAST)


def constant_rate(spark: SparkSession, sf: str) -> DataFrame:
    out = continuity.constant_rate(_of(spark, sf, 3), _of(spark, sf, 1), F.col("year") <= TRAINED, _alpha(spark))
    return pq._round(out.select(*KEY, "mu", "sigma"), "mu", "sigma")


def month_rate(spark: SparkSession, sf: str) -> DataFrame:
    out = continuity.month_rate(_of(spark, sf, 3), _of(spark, sf, 1), F.col("year") <= TRAINED, _alpha(spark), 3)
    return pq._round(out.select(*KEY, "mu", "sigma"), "mu", "sigma")


def own_record(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of sensor 3 against its own record."""
    out = continuity.own_record(_of(spark, sf, 3), _spine(spark, sf), WINDOW, _alpha(spark), least=5, min_n=MIN_N)
    return out.select(*KEY, F.round("mu", 6).alias("mu"), F.round("q50", 6).alias("q50"), F.col("n").cast("long").alias("n"), "code")


def _raw(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    cells = pq._rates(spark, sf)
    return cells, continuity.raw_base(cells, _spine(spark, sf), WINDOW)


def raw_codes_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Raw classes that stay when only sensors 3 and 4 are on, in later years in which sensor 3 is valid,
    and the same for the adjusted ones."""
    cells, raw = _raw(spark, sf)
    base = rq._base(spark, sf)
    codes = lambda *on: continuity.raw_codes(continuity.raw_totals(cells, on or None), raw, MIN_N)
    judged = lambda *off: rq.evaluation.judge(rq._fleet(spark, sf, *off), base, MIN_N)
    where = cells.where((F.col("s") == 3) & (F.col("year") > TRAINED)).select(*KEY)
    return continuity.kept_shares(judged(), judged(0, 1, 2), codes(), codes(3, 4), where)


def raw_step(spark: SparkSession, sf: str) -> DataFrame:
    out = continuity.raw_step(pq._rates(spark, sf), (pq.FIRST, pq.LAST))
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("step"), 6).alias("mean"), F.round(F.min("step"), 6).alias("low"), F.round(F.max("step"), 6).alias("high"))


def raw_cloud_artifact(spark: SparkSession, sf: str) -> DataFrame:
    cells, raw = _raw(spark, sf)
    cover = panel.coverage_cells(fx.coverage(spark, sf), KEY).select(*KEY, F.round("coverage", 6).alias("coverage"))
    base = rq._base(spark, sf).withColumn("q50", F.round("q50", 6))
    rows = continuity.raw_anomalies(cells, raw, base, cover).withColumn("z", F.round("z", 6))
    return validation.spearman(rows, "z", "coverage").withColumn("rho", F.round("rho", 6))


def validation_document(spark: SparkSession, sf: str) -> DataFrame:
    """The report over all sensors' cells and the country's, with the bridges' models."""
    sums, models = pq._fitted(spark, sf)
    sums = panel.with_country(sums, ["d", "dn", "clear", "cloud", "land"])
    cells = panel.rates(sums.withColumn("coverage", F.try_divide("clear", "land")), 0.1, 0.0)
    spine = _spine(spark, sf)
    spine = spine.unionByName(spine.select("year", "p").distinct().withColumn("unit", F.lit(panel.COUNTRY)), allowMissingColumns=True)
    parts = continuity.report(cells.join(pq._strata(spark, sf), "unit", "left"), models, spine, WINDOW, (1993, 1997), (pq.FIRST, TRAINED), TRAINED + 1, min_n=MIN_N, least=5)
    return continuity.document(parts, {"baseline": f"{WINDOW[0]}-{WINDOW[1]}", "reference": C.SENSORS[C.REFERENCE_SENSOR]}, TRAINED + 1)


QUERIES = {f.__name__: f for f in (constant_rate, month_rate, own_record, raw_codes_kept, raw_step, raw_cloud_artifact, validation_document)}

_TAIL = HISTORY[HISTORY.index("nb AS") :]
_PAIR = f"j AS (SELECT x.*, y.d AS rd, y.clear AS rclear FROM ra x JOIN ra y USING (unit, year, p) WHERE x.s = 3 AND y.s = 1 AND x.year <= {TRAINED})"
_SPINE = f"nation CROSS JOIN range({pq.FIRST}, {pq.LAST + 1}) AS a(y) CROSS JOIN range(1, 47) AS b(q)"
_SIGMA = f"sqrt(1 / (d + 0.5) + {NOISE})"
_RAW_H = f"tt AS (SELECT unit, year, p, sum(d)::DOUBLE AS v FROM ra GROUP BY ALL), h AS (SELECT n_nationkey AS unit, y::INT AS year, q::INT AS p, v FROM {_SPINE} LEFT JOIN tt ON tt.unit = n_nationkey AND tt.year = y AND tt.p = q), {_TAIL}"
_RAW_CODE = f"CASE WHEN w IS NULL THEN 0 WHEN n < {MIN_N} THEN 7 WHEN w > q90 THEN 5 WHEN w < q10 THEN 1 ELSE 3 END"
_RENAMED = _RAW_H.replace("h AS", "rh AS").replace("FROM h ", "FROM rh ").replace("nb AS", "rnb AS").replace("FROM nb", "FROM rnb").replace("ex AS", "rex AS").replace("bl AS", "rbl AS").replace("LEFT JOIN ex ON ex.", "LEFT JOIN rex AS ex ON ex.").replace("SELECT h.", "SELECT rh.").replace(" h.", " rh.")
_AFTER_DET = RATES[RATES.index("cov AS") :]

ORACLE_SQL = {
    "constant_rate": f"WITH {RATES}, {_PAIR}, k AS (SELECT ln(sum(rd) / greatest(sum(rho * rclear / 1000), 1e-9)) AS shift FROM j) SELECT unit, year, p, round(shift + ln(rho), 6) AS mu, round({_SIGMA}, 6) AS sigma FROM ra, k WHERE s = 3",
    "month_rate": f"""WITH {RATES}, {_PAIR}, k AS (SELECT {rq._MONTH} AS m, sum(rd) / greatest(sum(d), 1) AS ratio FROM j GROUP BY 1 HAVING count(*) >= 3),
x AS (SELECT unit, year, p, d * ratio / (land / 1000) + 0.01 AS rate, land FROM ra JOIN k ON k.m = {rq._MONTH} WHERE s = 3) SELECT unit, year, p, round(ln(rate), 6) AS mu, round(sqrt(1 / (rate * land / 1000) + {NOISE}), 6) AS sigma FROM x""",
    "own_record": f"""WITH {RATES}, h AS (SELECT n_nationkey AS unit, y::INT AS year, q::INT AS p, rho AS v FROM {_SPINE} LEFT JOIN (SELECT * FROM ra WHERE s = 3) r ON r.unit = n_nationkey AND r.year = y AND r.p = q),
{_TAIL.replace("count(b) AS n", "CASE WHEN count(b) >= 5 THEN 100 ELSE count(b) END AS n")}, o AS (SELECT unit, year, p, ln(rho) AS mu, {_SIGMA} AS sigma FROM ra WHERE s = 3)
SELECT unit, year, p, round(mu, 6) AS mu, round(q50, 6) AS q50, n, code FROM ({rq._verdicts('o')})""",
    "raw_codes_kept": f"""WITH {HISTORY}, {rq.DD}, {rq._fleet_sql('fa', '-1')}, {rq._fleet_sql('fb', '0, 1, 2')}, {_AFTER_DET}, {_RENAMED},
va AS ({rq._verdicts('fa')}), vb AS ({rq._verdicts('fb')}), wh AS (SELECT unit, year, p FROM ra WHERE s = 3 AND year > {TRAINED}),
ab AS (SELECT unit, {rq.CLASS3.replace('code', 'va.code')} = {rq.CLASS3.replace('code', 'vb.code')} AS same FROM va JOIN vb USING (unit, year, p) JOIN wh USING (unit, year, p) WHERE va.code BETWEEN 1 AND 6),
w1 AS (SELECT unit, year, p, v AS w FROM tt), w2 AS (SELECT unit, year, p, sum(d)::DOUBLE AS w FROM ra WHERE s IN (3, 4) GROUP BY ALL),
ra1 AS (SELECT unit, year, p, {_RAW_CODE} AS code FROM rbl LEFT JOIN w1 USING (unit, year, p)), ra2 AS (SELECT unit, year, p, {_RAW_CODE} AS code FROM rbl LEFT JOIN w2 USING (unit, year, p)),
rb AS (SELECT unit, {rq.CLASS3.replace('code', 'ra1.code')} = {rq.CLASS3.replace('code', 'ra2.code')} AS same FROM ra1 JOIN ra2 USING (unit, year, p) JOIN wh USING (unit, year, p) WHERE ra1.code BETWEEN 1 AND 6),
g AS (SELECT unit, count(*) AS n, count(*) FILTER (same) AS k FROM ab GROUP BY unit), rg AS (SELECT unit, count(*) AS n, count(*) FILTER (same) AS k FROM rb GROUP BY unit),
ga AS (SELECT unit, n, round(k / n, 4) AS adjusted FROM g UNION ALL SELECT -1, sum(n)::BIGINT, round(sum(k) / sum(n), 4) FROM g), gr AS (SELECT unit, n AS raw_n, round(k / n, 4) AS raw FROM rg UNION ALL SELECT -1, sum(n)::BIGINT, round(sum(k) / sum(n), 4) FROM rg)
SELECT unit, coalesce(n, 0) AS n, adjusted, coalesce(raw_n, 0) AS raw_n, raw FROM ga FULL JOIN gr USING (unit)""",
    "raw_step": f"""WITH {RATES}, a AS (SELECT unit, year, p, sum(d) AS every, sum(d) FILTER (s < 2) AS old FROM ra WHERE s < 3 GROUP BY ALL HAVING count(*) = 3), z AS (SELECT ln((every + 0.5) / (old + 0.5)) AS z FROM a)
SELECT count(*) AS n, round(avg(z), 6) AS mean, round(min(z), 6) AS low, round(max(z), 6) AS high FROM z""",
    "raw_cloud_artifact": f"""WITH {HISTORY}, {_AFTER_DET}, {rq._COVER}, {rq._QUIET}, {_RENAMED},
r AS (SELECT round(ln(tt.v + 0.5) - ln(greatest(rbl.q50, 0.5)), 6) AS z, coverage FROM tt JOIN qc USING (unit, year, p) JOIN rbl USING (unit, year, p) JOIN cv USING (unit, year, p) WHERE coverage > 0.02 AND rbl.q50 IS NOT NULL),
k AS (SELECT {rq._RANKS.format('z')} AS ra, {rq._RANKS.format('coverage')} AS rb FROM r) SELECT round(corr(ra, rb), 6) AS rho, count(*) AS n FROM k""",
}
