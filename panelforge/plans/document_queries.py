"""Published documents and their checks on the driver's tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baseline, evaluation, panel, publish, selection
from ..operators import schemas as S
from ..sources import fixtures as fx
from . import layer_queries as layer
from . import panel_queries as pq
from . import report_queries as rq

ORDER = S.fields(
    {
        "schema": S.const("order"), "year": S.whole(1990, 2000), "period": S.whole(1, 46), "note": S.text(null=True), "open": S.flag(),
        "cells": S.items(S.fields({"s": S.whole(0, 4), "d": S.number(0, 100), "tags": S.items(S.text(("a", "b")), 1, 2), "limits": S.fields({"low": S.number(null=True), "high": S.number()}, others=False)}, optional=("limits",)), 1, 7),
    }
)


def order_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON text for each order, spoiled in one way or another by its number."""
    way = F.col("o_orderkey") % 16
    lines = fx.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q")))).alias("lines"))
    o = fx.table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))

    def cell(x, i):
        first, last = i == 0, i == F.size("lines") - 1
        d = F.when((way == 1) & last, F.concat(F.lit('"'), x["q"], F.lit('"'))).when((way == 2) & first, "-1").when((way == 3) & first, "null").otherwise(x["q"].cast("string"))
        tags = F.when((way == 4) & last, '["a","b","a"]').when((way == 5) & last, '["a","c"]').when((way == 6) & first, "[]").otherwise('["a"]')
        s = F.when((way == 7) & last, "5").when((way == 8) & last, "1.5").otherwise((x["n"] % 5).cast("string"))
        limits = F.when((way == 9) & first, ',"limits":{"low":null,"high":1,"far":2}').when((way == 10) & last, ',"limits":{"low":1}').when(way == 11, ',"limits":{"low":null,"high":1}').otherwise("")
        return F.concat(F.lit('{"s":'), s, F.lit(',"d":'), d, F.lit(',"tags":'), tags, limits, F.lit("}"))

    cells = F.array_join(F.transform("lines", cell), ",")
    body = F.concat(
        F.lit('{"schema":"'), F.when(way == 12, "other").otherwise("order"), F.lit('","year":'), F.year("o_orderdate").cast("string"), F.when(way == 13, "").otherwise(',"period":4'), F.lit(',"note":'), F.when(way.isin(2, 14), "7").otherwise("null"),
        F.lit(',"open":true,"cells":['), cells, F.lit("]"), F.when(way == 15, "").otherwise("}"),
    )
    return o.select("o_orderkey", body.alias("value"))


def schema_violations(spark: SparkSession, sf: str) -> DataFrame:
    return S.violations(order_documents(spark, sf), ORDER).select("o_orderkey", "violation")


def _cube(c: str) -> F.Column:
    """A cube of numbers as text."""
    row = lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, lambda x: F.coalesce(x.cast("string"), F.lit("null"))), ","), F.lit("]"))
    plane = lambda p: F.concat(F.lit("["), F.array_join(F.transform(p, row), ","), F.lit("]"))
    return F.concat(F.lit("["), F.array_join(F.transform(c, plane), ","), F.lit("]"))


def _sensor_cells(spark: SparkSession, sf: str) -> DataFrame:
    d = panel.counts(fx.detections(spark, sf))
    c = panel.coverage_cells(fx.coverage(spark, sf)).select(*panel.CELL, F.round("clear", 4).alias("clear"), F.round("coverage", 6).alias("coverage"))
    return d.join(c, panel.CELL, "full")


def sensor_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, exclusions, coverage and clear area of each year as [sensor][unit][period]."""
    values = {"raw": F.col("d"), "static": F.col("ex_static"), "cov": F.bround(F.col("coverage") * 100).cast("long"), "clear": F.bround("clear").cast("long")}
    cubes = publish.sensor_grid(_sensor_cells(spark, sf), fx.units(spark, sf), 5, values)
    return cubes.select("year", F.array_join("units", ",").alias("units"), *[F.sha2(_cube(c).cast("binary"), 256).alias(c) for c in values], F.length(_cube("raw")).cast("long").alias("size"))


def whole_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots with every field, a JSON text for each year, and their first violation (none)."""
    base = rq._base(spark, sf)
    judged = evaluation.judge(rq._fleet(spark, sf), base, pq.MIN_N)
    estimates = panel.estimates(fx.detections(spark, sf)).select(*panel.CELL, "mu", "sigma")
    cells = _sensor_cells(spark, sf).join(estimates, panel.CELL, "left").withColumn("n_passes", F.lit(None).cast("int"))
    raw = baseline.leave_one_out(pq._history(spark, sf), pq.WINDOW)
    rows = publish.sensor_snapshots(judged, cells, fx.units(spark, sf), raw)
    text = rows.select("year", F.to_json(F.struct(F.lit("snapshot").alias("schema"), *rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    return S.violations(text, SNAPSHOT).select("year", F.length("value").alias("size"), "violation", F.get_json_object("value", "$.comb.mu[3][10]").alias("mu"), F.get_json_object("value", "$.raw[2][3][10]").alias("raw"))


def _plane(node, depth: int = 2):
    return S.items(node, 46, 46, depth=depth)


SNAPSHOT = S.fields({
    "schema": S.const("snapshot"), "year": S.whole(1990, 2100), "units": S.items(S.whole()), "comb": S.fields({"mu": _plane(S.number(null=True)), "sigma": _plane(S.number(0, null=True))}), "verdict": _plane(S.whole(-1, 8)), "p_hi": _plane(S.number(0, 1, null=True)), "p_lo": _plane(S.number(0, 1, null=True)),
    "cov": _plane(S.number(null=True), 3), "raw": _plane(S.whole(0, null=True), 3), "excl": S.fields({"static": _plane(S.whole(0, null=True), 3), "lowconf": _plane(S.whole(0, null=True), 3)}), "per": S.fields({"mu": _plane(S.number(null=True), 3), "sigma": _plane(S.number(0, null=True), 3)}),
    "base": S.fields({**{q: _plane(S.number(null=True)) for q in ("q10", "q50", "q90", "max")}, "n": _plane(S.whole(0))}), "raw_base": S.fields({"q10": _plane(S.number(null=True)), "q90": _plane(S.number(null=True))}), "clear_km2d": _plane(S.number(null=True), 3), "n_passes": _plane(S.whole(null=True), 3),
})


def full_evidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = layer.observations(spark, sf).select("id", "district", "satellite", "year", "period", "low_confidence", "excluded")
    return selection.full_evidence(rows, layer.estimates(spark, sf), replace(layer.CHOICE, area=layer.AREA), "orders as detections", "2026-01-01T00:00:00Z", ("coverage is partial",))


QUERIES = {f.__name__: f for f in (schema_violations, sensor_snapshot, whole_snapshots, full_evidence)}
_PLANES = ", ".join(f"'[' || string_agg(coalesce({e}::VARCHAR, 'null'), ',' ORDER BY p) || ']' AS {c}" for c, e in (("raw", "d"), ("static", "ex_static"), ("cov", "round_even(coverage * 100, 0)::BIGINT"), ("clear", "round_even(clear, 0)::BIGINT")))
_NEST = lambda by: ", ".join(f"'[' || string_agg({c}, ',' ORDER BY {by}) || ']' AS {c}" for c in ("raw", "static", "cov", "clear"))
ORACLE_SQL = {
    "sensor_snapshot": f"""WITH {pq.DET}, {pq.COV}, d AS (SELECT s, unit, year, p, {pq.COUNTS} FROM det GROUP BY ALL), c AS (SELECT s, unit, year, p, round(sum(clear), 4) AS clear, round(sum(clear) / nullif(sum(land), 0), 6) AS coverage FROM cov GROUP BY ALL),
x AS (SELECT * FROM d FULL JOIN c USING (s, unit, year, p)), f AS (SELECT year, s::INT AS s, n_nationkey AS unit, p::INT AS p FROM (SELECT DISTINCT year FROM x), nation, range(5) a(s), range(1, 47) b(p)),
u AS (SELECT year, s, unit, {_PLANES} FROM f LEFT JOIN x USING (s, unit, year, p) GROUP BY year, s, unit), v AS (SELECT year, s, string_agg(unit::VARCHAR, ',' ORDER BY unit) AS units, {_NEST('unit')} FROM u GROUP BY year, s),
w AS (SELECT year, any_value(units) AS units, {_NEST('s')} FROM v GROUP BY year) SELECT year, units, sha256(raw) AS raw, sha256(static) AS static, sha256(cov) AS cov, sha256(clear) AS clear, length(raw) AS size FROM w""",
    "full_evidence": rq.ORACLE_SQL["evidence_document"].replace(layer.CHOICE.area, layer.AREA).replace(f"AND {rq._ALLOWED})", f"AND {rq._ALLOWED} AND district = '{layer.AREA}')").replace(',"observations":[', ',"provenance":"orders as detections","fetched_at":"2026-01-01T00:00:00Z","observations":[').replace("|| ']}' AS value FROM h", """|| '],"estimates":[' || coalesce((SELECT '{"district":"' || district || '","value":' || CASE WHEN g THEN gvalue ELSE value END || ',"lower":' || CASE WHEN g THEN n * 0.4 ELSE n * 0.5 END || ',"upper":' || CASE WHEN g THEN n * 1.6 ELSE n * 2 END
  || ',"probability":' || CASE WHEN g THEN gprobability ELSE probability END || ',"coverage":' || coverage || '}' FROM (SELECT est.*, value AS n FROM est) WHERE district = '%s' AND year = %d AND period = %d), '') || '],"warnings":["coverage is partial"]}' AS value FROM h""" % (layer.AREA, layer.CHOICE.year, layer.CHOICE.period)),
    "schema_violations": """WITH l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN way = 15 THEN ': not JSON' WHEN way = 13 THEN ': period is missing'
  WHEN n > 7 THEN 'cells: more than 7 items'
  WHEN way = 1 THEN 'cells/' || (n - 1) || '/d: not a number' WHEN way = 2 THEN 'cells/0/d: below 0' WHEN way = 3 THEN 'cells/0/d: not a number'
  WHEN way = 4 THEN 'cells/' || (n - 1) || '/tags: more than 2 items' WHEN way = 5 THEN 'cells/' || (n - 1) || '/tags/1: not one of a, b' WHEN way = 6 THEN 'cells/0/tags: fewer than 1 items'
  WHEN way = 7 THEN 'cells/' || (n - 1) || '/s: above 4' WHEN way = 8 THEN 'cells/' || (n - 1) || '/s: not a whole number'
  WHEN way = 9 THEN 'cells/0/limits: a name that isn''t known' WHEN way = 10 THEN 'cells/' || (n - 1) || '/limits: high is missing'
  WHEN way = 14 THEN 'note: not a text' WHEN way = 12 THEN 'schema: not one of order' WHEN y > 2000 THEN 'year: above 2000' WHEN y < 1990 THEN 'year: below 1990' END AS violation
FROM (SELECT o_orderkey, o_orderkey % 16 AS way, year(o_orderdate) AS y, n FROM orders JOIN l ON o_orderkey = k)""",
}
