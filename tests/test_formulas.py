import math
import random

from pyspark.sql import functions as F

from panelforge.functions import constants as C
from panelforge.functions import geo, periods, scores
from panelforge.operators import panel, validation


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_normal_cdf_equals_erfc(spark):
    xs = [x / 8 for x in range(-160, 161)] + [40.0, -40.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", scores.normal_cdf(F.col("x")).alias("y")).collect()
    assert all(abs(r["y"] - 0.5 * math.erfc(-r["x"] / math.sqrt(2))) < 1e-14 for r in got)


def test_periods(spark):
    days = [("2023-01-01", 1), ("2023-01-08", 1), ("2023-01-09", 2), ("2023-12-31", 46), ("2024-12-31", 46), ("2024-02-29", 8)]
    got = spark.createDataFrame(days, "d string, p int").select("p", periods.period(F.to_date("d")).alias("q")).collect()
    assert all(r["p"] == r["q"] for r in got)
    assert one(spark, periods.days_in_period(F.lit(2023), F.lit(46)), periods.days_in_period(F.lit(2024), F.lit(46)), periods.days_in_period(F.lit(2024), F.lit(3))) == (5, 6, 8)


def test_tiles_and_elevation(spark):
    lat, lon = F.lit(23.8), F.lit(90.4)
    assert one(spark, *geo.sinusoidal_tile(lat, lon), *geo.sinusoidal_tile(F.lit(25.9), F.lit(88.1)), *geo.mercator_tile(lat, lon, 6)) == (26, 6, 25, 6, 48, 27)
    heights = spark.createDataFrame([(h,) for h in (-430.25, 0.0, 3.999, 8848.86)], "h double")
    back = heights.select("h", geo.terrarium_decode(*geo.terrarium_encode(F.col("h"))).alias("b")).collect()
    assert all(abs(r["h"] - r["b"]) < 0.01 for r in back)
    assert abs(one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)))[0] - 6371 * math.pi / 2) < 1e-6
    noon = one(spark, geo.solar_zenith_deg(F.lit("2024-03-20 12:07:00").cast("timestamp"), F.lit(0.0), F.lit(0.0)))[0]
    assert noon < 1.0


def combine_one(mu, sigma, enabled, r):
    ok = [(m, s) for m, s, e in zip(mu, sigma, enabled) if e and m is not None and s is not None and s > 0]
    if not ok:
        return None, None, 0
    w = [1 / s**2 for _, s in ok]
    return sum(a * m for a, (m, _) in zip(w, ok)) / sum(w), math.sqrt((1 + (len(ok) - 1) * r) / sum(w)), len(ok)


def verdict_one(mu, sigma, q10, q90, top, n):
    if mu is None:
        return C.NOT_OBSERVED
    phi = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    hi = 1.0 if q90 <= 0 else 1 - phi((math.log(q90) - mu) / sigma)
    lo = 0.0 if q10 <= 0 else phi((math.log(q10) - mu) / sigma)
    code = C.TYPICAL
    for rule, value in ((lo >= 0.6 and q10 >= 0.5, C.MAYBE_LOW), (lo >= 0.9 and q10 >= 0.5, C.LOW), (hi >= 0.6, C.MAYBE_HIGH), (hi >= 0.9, C.HIGH), (math.exp(mu - C.Z80 * sigma) > top, C.RECORD), (n < 20, C.INSUFFICIENT)):
        code = value if rule else code
    return code


def test_combination_and_verdicts_of_random_cases(spark):
    rng, rows, expected = random.Random(3), [], {}
    for case in range(200):
        r = rng.choice([0.0, 0.3])
        mu = [rng.uniform(-2, 3) if rng.random() < 0.7 else None for _ in range(5)]
        sigma = [rng.uniform(0.05, 1.2) if m is not None else None for m in mu]
        q10 = rng.choice([0.0, 0.3, 1.0, 2.0])
        q90 = q10 + rng.uniform(0, 5)
        top, n = q90 + rng.uniform(0, 5), rng.choice([5, 40])
        expected[case] = (*combine_one(mu, sigma, [True] * 5, r), q10, q90, top, n, r)
        rows += [(case, s, m, g, r) for s, (m, g) in enumerate(zip(mu, sigma))]
    cells = spark.createDataFrame(rows, "case int, s int, mu double, sigma double, r double")
    base = spark.createDataFrame([(k, *v[3:7]) for k, v in expected.items()], "case int, q10 double, q90 double, top double, n int")
    for r in (0.0, 0.3):
        est = panel.combine(cells.where(F.col("r") == r), r, keys=("case",))
        j = base.join(cells.where(F.col("r") == r).select("case").distinct(), "case").join(est, "case", "left")
        j = j.withColumns({"hi": scores.p_above(F.col("mu"), F.col("sigma"), F.col("q90")), "lo": scores.p_below(F.col("mu"), F.col("sigma"), F.col("q10"))})
        code = scores.verdict(F.col("mu"), F.col("sigma"), F.col("hi"), F.col("lo"), F.col("q10"), F.col("top"), F.col("n"))
        for row in j.withColumn("code", code).collect():
            mu, sigma, used, q10, q90, top, n, _ = expected[row["case"]]
            assert row["code"] == verdict_one(mu, sigma, q10, q90, top, n)
            if mu is not None:
                assert abs(row["mu"] - mu) < 1e-9 and abs(row["sigma"] - sigma) < 1e-9 and row["n_used"] == used


def test_kappa_and_ranks(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 0), (2, 2)], "a int, b int")
    k = validation.kappa(pairs, "a", "b").first()
    assert abs(k["kappa"] - (0.8 - 0.36) / (1 - 0.36)) < 1e-12
    assert validation.kappa(spark.createDataFrame([(1, 1)], "a int, b int"), "a", "b").first()["kappa"] is None
    ranks = validation.average_ranks(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "v double"), "v", [])
    assert sorted((r["v"], r["rank_v"]) for r in ranks.collect()) == [(1.0, 1.0), (2.0, 2.5), (5.0, 4.0)]
