import datetime as dt
import json
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import constants as C
from panelforge.operators import baseline, bridge, dedupe, evaluation, export, graph, ordering, panel, passes, publish, selection, spatial, staticmask, validation, workspace
from panelforge.operators.selection import Selection
from panelforge.plans import layer_queries
from panelforge.sources import feeds
from panelforge.sources import observations as source
from panelforge.streaming import ingest


def test_normalise_both_families(spark):
    names = "latitude string, longitude string, acq_date string, acq_time string, satellite string, confidence string, frp string, daynight string, type string"
    modis = [("21.55", "88.9", "2011-07-19", "5", "terra", "29.9", "x", "N", "2"), ("-3", "91", "2011-07-19", "2359", "A", "30", "12.25", "D", ""), ("0", "0", "2011-07-20", None, "?", "80", "0", "", "3")]
    got = source.normalize(spark.createDataFrame(modis, names), "T+A").collect()
    assert [(r["s"], r["conf"], r["night"], r["frp"], r["type"]) for r in got] == [(0, 0, True, 0.0, 2), (1, 1, False, 12.25, -1), (1, 2, False, 0.0, 3)]
    assert [r["t"] for r in got] == [dt.datetime(2011, 7, 19, 0, 5), dt.datetime(2011, 7, 19, 23, 59), dt.datetime(2011, 7, 20)]
    viirs = [("1", "2", "2022-12-31", "10", sat, conf, "1e2", "D", None) for sat, conf in (("N", "nominal"), ("N20", "L"), ("N21", "h"), ("other", ""))]
    got = source.normalize(spark.createDataFrame(viirs, names), "J1").collect()
    assert [(r["s"], r["conf"], r["frp"], r["type"]) for r in got] == [(2, 1, 100.0, -1), (3, 0, 100.0, -1), (4, 2, 100.0, -1), (3, 1, 100.0, -1)]


def test_proximity_keeps_the_strongest_of_a_chain(spark):
    t = dt.datetime(2024, 1, 1, 5, 30)
    points = [(1, "N", t, 24.0, 90.0, 1.0), (2, "N", t, 24.0005, 90.0, 5.0), (3, "N", t, 24.002, 90.0, 2.0), (4, "N", t, 24.1, 90.0, 1.0), (5, "N", t + dt.timedelta(minutes=1), 24.0, 90.0, 1.0)]
    got = dedupe.proximity(spark.createDataFrame(points, "id long, s string, t timestamp, lat double, lon double, frp double")).collect()
    assert {(r["id"], r["group_root"], r["group_size"]) for r in got} == {(2, 1, 3), (4, 4, 1), (5, 5, 1)}


def test_static_mask(spark):
    days = [dt.datetime(y, 1, 1, 6) + dt.timedelta(days=3 * k) for y in (2015, 2016) for k in range(40)]
    rows = [(24.0001, 90.0001, d) for d in days] + [(23.0001, 90.0001, dt.datetime(2015, 5, 1, h)) for h in range(8)]
    cells = staticmask.with_cell(spark.createDataFrame(rows, "lat double, lon double, t timestamp"))
    mask = staticmask.learn(cells)
    assert mask.count() == 1
    near = spark.createDataFrame([(24.0001, 90.0001, False), (24.004, 90.0001, False), (24.004, 90.0001, True), (24.02, 90.0001, True)], "lat double, lon double, coarse boolean")
    got = staticmask.apply(staticmask.with_cell(near), mask, "coarse").collect()
    assert sorted((r["lat"], r["coarse"], r["static"]) for r in got) == [(24.0001, False, True), (24.004, False, False), (24.004, True, True), (24.02, True, False)]


def test_leave_one_out_against_brute_force(spark):
    rng = np.random.default_rng(1)
    years, window = range(2001, 2008), (2002, 2006)
    v = {(y, p): float(rng.integers(0, 9)) for y in years for p in range(1, 47)}
    h = spark.createDataFrame([(0, y, p, x) for (y, p), x in v.items()], "unit int, year int, p int, v double")
    line = {y * 46 + p: x for (y, p), x in v.items()}
    for r in baseline.leave_one_out(h, window).collect():
        pool = [line[y * 46 + r["p"] + k] for y in range(window[0], window[1] + 1) if y != r["year"] for k in (-1, 0, 1) if y * 46 + r["p"] + k in line]
        assert r["n"] == len(pool) and r["top"] == max(pool)
        assert np.allclose([r["q10"], r["q50"], r["q90"]], np.percentile(pool, [10, 50, 90]))


def test_peak_and_rank(spark):
    medians = [(0, p, 9.0 if p in (5, 6, 20, 21, 22, 40, 41) else 1.0) for p in range(1, 47)] + [(1, 1, 2.0)]
    got = {r["unit"]: (r["first_p"], r["last_p"]) for r in baseline.peak_window(spark.createDataFrame(medians, "unit int, p int, q50 double")).collect()}
    assert got == {0: (20, 22), 1: (-1, -1)}
    years = spark.createDataFrame([(0, 2001, 5.0, 1.0), (0, 2002, 9.0, 0.5), (0, 2003, 5.0, 0.9), (0, 2004, 7.0, 0.8)], "unit int, year int, total double, complete double")
    assert {r["year"]: r["rank"] for r in baseline.rank(years).collect()} == {2001: 2, 2002: None, 2003: 3, 2004: 1}


def bridge_pairs(rng, n, years=range(2001, 2007), slope=0.8, level=0.3, shape=2.0):
    rows = []
    for k in range(n):
        rho, clear, ns, angle = float(np.exp(rng.normal())), float(rng.uniform(500, 4000)), float(rng.uniform()), float(rng.uniform(0, 6))
        mean = clear / 1000 * np.exp(level) * rho**slope
        rows.append(("A-B", k % 40, int(rng.choice(list(years))), int(rng.poisson(mean * rng.gamma(shape, 1 / shape))), clear, rho, ns, float(np.sin(angle)), float(np.cos(angle))))
    return rows


PAIRS = "bridge string, unit int, year int, d_to int, clear_to double, rho_from double, ns_from double, sn double, cs double"


def test_bridges_are_posterior_modes(spark):
    """Brute force over the gathered rows: the gradient of the posterior is 0 at every draw's fit."""
    rows = bridge_pairs(np.random.default_rng(0), 3000) + [("B-C", *r[1:]) for r in bridge_pairs(np.random.default_rng(1), 100)]
    strata = spark.createDataFrame([(u, "forest" if u < 20 else None) for u in range(40)], "unit int, stratum string")
    got = bridge.fit_bridges(spark.createDataFrame(rows, PAIRS).repartition(5), strata, draws=4).collect()
    assert {(r["bridge"], r["key"], r["level"]) for r in got} == {("A-B", "pool", 1), ("A-B", "forest", 0)} and len(got) == 8
    for r in got:
        own = [x for x in rows[:3000] if r["key"] == "pool" or x[1] < 20]
        assert r["n"] == len(own)
        years = bridge.year_draws(sorted({x[2] for x in own}), 4, [bridge.SEED, *f"A-B|{r['key']}".encode()])
        assert all(sum(w[d] for w in years.values()) == 6 for d in range(4))
        y, clear, rho, ns, sn, cs = (np.array([x[k] for x in own], float) for k in range(3, 9))
        x, w = np.column_stack([np.ones(len(y)), np.log(rho), ns, sn, cs]), np.array([years[row[2]][r["draw"]] for row in own], float)
        beta, mean = np.array(r["beta"]), clear / 1000 * np.exp(x @ np.array(r["beta"]))
        gradient = x.T @ (w * (y - mean) / (1 + r["alpha"] * mean)) - bridge.PRIOR_PRECISION * (beta - bridge.PRIOR_MEAN)
        assert np.abs(gradient).max() < 1e-3
        if r["draw"] == 0 and r["key"] == "pool":
            assert abs(beta[0] - 0.3) < 0.2 and abs(beta[1] - 0.8) < 0.1 and abs(r["alpha"] - 0.5) < 0.2


def test_a_bridge_without_a_fit_takes_the_ratio():
    draws = bridge.Draws(bridge.year_draws([2001, 2002], 3, [1]), 200)
    draws.failed[1] = True
    assert draws.settle(np.array([2.0, 3.0, 4.0]), 0) == 0 and np.allclose(draws.beta[1], [np.log(3), 1, 0, 0, 0]) and draws.alpha[1] == 0.1
    draws.failed[0] = True
    assert draws.settle(np.array([2.0, 3.0, 4.0]), 0) == 3 and np.allclose(draws.beta[:, 0], np.log([2, 3, 4]))


def test_chain_of_one_link(spark):
    cells = spark.createDataFrame([(0, 4, 2.0, 0.5, 0.1, 0.2, "forest")], "unit int, d int, rho double, ns double, sn double, cs double, stratum string")
    models = spark.createDataFrame([("A-B", "pool", b, [0.0, 1.0, 0.0, 0.0, 0.0], 0.2, 1, 200) for b in range(5)], bridge.SCHEMA)
    r = bridge.finish_chain(bridge.apply_link(bridge.start_chain(cells, 5), models)).first()
    assert abs(r["mu"] - np.log(2.01)) < 1e-12 and abs(r["sigma"] - np.sqrt(1 / 4.5 + 0.2)) < 1e-12


def test_sessions_use_the_end_before_and_any_size_of_bits(spark):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(1, "A", t(0), t(20), True, [3]), (2, "A", t(5), t(6), False, [68]), (3, "A", t(19), t(24), False, [0]), (4, "A", t(30), t(35), False, [])]
    got = passes.sessions(spark.createDataFrame(rows, "id int, s string, start timestamp, end timestamp, night boolean, units array<int>"), 12)
    got = got.withColumn("bits", passes.unit_bits(F.col("units"))).orderBy("pass").collect()
    assert [(r["n_granules"], r["night"], r["bits"]) for r in got] == [(2, True, format(1 << 3 | 1 << 68, "x")), (2, False, "1")]
    assert got[0]["t"] == t(10)


def test_points_footprints_and_rasters(spark):
    units = spatial.units_from_geojson(spark, layer_queries.SQUARE)
    points = [(1, 88.1, 20.7), (2, 89.0, 21.5), (3, 92.0, 23.0), (4, 90.1, 24.0), (5, 80.0, 10.0)]
    got = {r["id"]: r["unit_name"] for r in spatial.assign(spark.createDataFrame(points, "id int, lon double, lat double"), units).collect()}
    assert got == {1: "ring", 2: None, 3: "pair", 4: "wide", 5: None}
    square = lambda x, y, d: [(x, y), (x + d, y), (x + d, y + d), (x, y + d), (x, y)]
    prints = spark.createDataFrame([(1, square(87.0, 20.0, 30.0)), (2, square(88.9, 21.4, 0.1)), (3, square(90.0, 21.0, 0.5))], "id int, ring array<struct<x:double,y:double>>")
    assert {(r["id"], r["unit_idx"]) for r in spatial.touching(prints, units).collect()} == {(1, 0), (1, 1), (1, 2), (3, 0), (3, 1)}
    grid = np.repeat(np.array([0, 1, -1], "<i2"), 4)
    mask = bytes([5, 7, 4, 3, 8, 8, 4, 4, 5, 5, 5, 5])
    masks = spark.createDataFrame([("T", 1, dt.date(2020, 1, 1), bytearray(mask))], "sat string, tile int, date date, pixels binary")
    grids = spark.createDataFrame([(1, bytearray(grid.tobytes()), bytearray([1] * 11 + [0]))], "tile int, unit binary, land binary")
    assert {(r["unit"], r["clear"], r["cloud"], r["land"]) for r in spatial.raster_counts(masks, grids).collect()} == {(0, 2, 1, 4), (1, 2, 2, 4)}
    one = '{"type":"FeatureCollection","features":[{"properties":{},"geometry":{"type":"%s","coordinates":%s}}]}'
    for kind, ring in (("Polygon", "[[[0,0],[1,1],[0,0]]]"), ("Polygon", "[[[0,0],[1,1],[1,0],[0,9]]]"), ("Polygon", "[[[0,0],[1,91],[1,0],[0,0]]]"), ("Polygon", "[]"), ("Point", "[0,0]"), ("MultiPolygon", "[[]]")):
        with pytest.raises(ValueError):
            spatial.units_from_geojson(spark, one % (kind, ring))
    with pytest.raises(ValueError):
        spatial.units_from_geojson(spark, '{"type":"Feature"}')
    assert spatial.units_from_geojson(spark, one % ("Polygon", "[[[0,0],[1,1],[1,0],[0,0]]]")).first()["name"] == "Unnamed area"


def test_parent_of_largest_overlap(spark):
    box = lambda w, s, e, n: [[(w, s), (e, s), (e, n), (w, n), (w, s)]]
    schema = "unit_idx int, name string, rings array<array<struct<x:double,y:double>>>"
    units = spark.createDataFrame([(0, "a", box(0.0, 0.0, 3.0, 1.0)), (1, "b", box(5.0, 0.0, 6.0, 1.0))], schema)
    parents = spark.createDataFrame([(0, "left", box(-1.0, -1.0, 1.0, 2.0)), (1, "right", box(1.0, -1.0, 4.0, 2.0))], schema)
    assert {(r["unit_idx"], r["parent"]) for r in spatial.parent_by_cells(units, parents, 0.25).collect()} == {(0, "right"), (1, None)}


def test_every_filter_combination(spark, data):
    obs = layer_queries.observations(spark, data).persist()
    plain = obs.collect()
    calendar = {}
    for area, satellite, grounded, low, excluded in product(("Bangladesh", "NATION_3"), (None, "Aqua", "NOAA-20"), (False, True), (False, True), (False, True)):
        s = Selection(1997, 3, area, satellite, grounded, low, excluded)
        expected = [
            r for r in plain
            if (area == "Bangladesh" or r["district"] == area) and (satellite is None or r["satellite"] == satellite) and not (grounded and C.SATELLITES[r["satellite"]])
            and (low or not r["low_confidence"]) and (excluded or not r["excluded"])
        ]
        calendar[s] = sum(r["year"] == 1997 and r["period"] == 3 for r in expected)
    flags = obs.agg(*[F.count_if(selection.matches(s) & (F.col("year") == 1997) & (F.col("period") == 3)).alias(f"c{k}") for k, s in enumerate(calendar)]).first()
    assert list(flags) == list(calendar.values())


def test_selection_parameters():
    good = {"year": "2024", "period": "0", "grounded": "true"}
    assert Selection.parse(good, ["Bangladesh"]) == Selection(2024, 0, grounded=True)
    for bad in ({"year": "1999"}, {"period": "46"}, {"period": "x"}, {"area": "?"}, {"satellite": "X"}, {"includeLow": "yes"}):
        with pytest.raises(ValueError):
            Selection.parse(good | bad, ["Bangladesh"])


def test_imports(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿Latitude,longitude, acq_date,acq_time,satellite,district,frp\r\n24,90,2024-01-09,730,N,"a, ""b""",1\r\n24,90,2024-01-09,0730,npp,late,2\r\n99,90,2024-01-09,1,N,,\r\n', encoding="utf-8")
    rows, rejected = source.import_csv(spark, str(path))
    got = rows.collect()
    assert rejected == 1 and [(r["satellite"], r["district"], r["frp"], r["period"]) for r in got] == [("S-NPP", "late", 2.0, 1)]
    path.write_text("latitude,longitude,acq_date\n1,2,2024-01-01\n")
    with pytest.raises(ValueError):
        source.import_csv(spark, str(path))
    model = {"version": 1, "observations": [{"latitude": 24, "longitude": 90, "acq_date": "2024-01-01", "satellite": "T"}], "estimates": [{"district": "x", "year": 2024, "period": 0, "value": 2, "lower": 1, "upper": 3, "probability": 0.5, "coverage": 50, "baselineMedian": 1}]}
    file = tmp_path / "m.json"
    file.write_text(json.dumps(model))
    seen, estimates = source.import_model(spark, str(file))
    assert seen.count() == 1 and estimates.count() == 1
    model["estimates"][0]["lower"] = 2.5
    file.write_text(json.dumps(model))
    with pytest.raises(ValueError):
        source.import_model(spark, str(file))


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([(24.0, 90.0, dt.date(2024, 1, 1), "0730", False, "=cmd", "VIIRS", "n", 1.5, 'a "b"', False)], "latitude double, longitude double, day date, time string, time_known boolean, satellite string, sensor string, confidence string, frp double, district string, excluded boolean")
    assert export.csv_lines(rows).first()["value"] == '"24.0","90.0","2024-01-01","","\'=cmd","VIIRS","n","1.5","a ""b""","false"'
    cells = spark.createDataFrame([(0.5, 0.2, 0.3, 3, 1.0)], "coverage double, p_hi double, p_lo double, code int, h double")
    export.check_gates(cells)
    with pytest.raises(export.GateError):
        export.check_gates(cells.withColumn("code", F.lit(9)))
    many = spark.createDataFrame([(y, "x" * 50) for y in (2021, 2022, 2023) for _ in range(10)], "year int, t string")
    size = len(json.dumps({"year": 2021, "t": "x" * 50}, separators=(",", ":"))) + 1
    assert {r["year"] for r in export.newest_within(many, 20 * size).collect()} == {2022, 2023}


def test_panel_frame_and_proxy(spark):
    units = spark.createDataFrame([(1,), (2,)], "unit int")
    assert panel.spine(units, 2001, 2002).count() == 2 * 2 * 46
    native = spark.createDataFrame([(1, 5.0), (0, 2.0)], "s int, land double")
    assert {(r["s"], r["proxy"]) for r in panel.with_proxy(native, [0, 1, 2]).collect()} == {(0, False), (1, False), (2, True)}


def test_stream_counts_each_detection_once(spark, tmp_path):
    t = dt.datetime(2024, 1, 9, 12)
    schema = "s int, t timestamp, lat double, lon double, unit int, x int, night boolean"
    rows = [(0, t, 1.0, 1.0, 7, 0, False), (0, t, 1.0, 1.0, 7, 0, False), (0, t, 1.0, 2.0, 7, 1, True)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    folder = lambda n: str(tmp_path / n)
    run = lambda: ingest.start(ingest.detections_stream(spark, folder("in"), schema), folder("rows"), folder("out"), folder("cp")).awaitTermination(120)
    run()
    r = spark.read.parquet(folder("out")).first()
    assert (r["p"], r["d"], r["ex_static"]) == (2, 1, 1)
    later = [(0, t, 1.0, 3.0, 7, 0, False), (0, t + dt.timedelta(days=8), 1.0, 1.0, 7, 0, True)]
    spark.createDataFrame(later, schema).write.mode("append").parquet(folder("in"))
    run()
    assert {(r["p"], r["d"], r["dn"]) for r in spark.read.parquet(folder("out")).collect()} == {(2, 2, 0), (3, 1, 1)}
    old = spark.createDataFrame(rows[:1], schema)
    new = spark.createDataFrame([(0, t, 9.0, 9.0, 7, 0, False)], schema)
    assert [r["lat"] for r in ingest.replace_provisional(old, new).collect()] == [9.0]


def test_raster_counts_takes_every_line_item(spark, tmp_path):
    from panelforge.plans import layer_queries

    lines = spark.createDataFrame([(1, "1995-01-01", q) for q in [1] * 100 + [5] * 100 + [4] * 50], "l_linenumber int, l_shipdate string, l_quantity int")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r["sat"], r["unit"]): (r["clear"], r["cloud"]) for r in layer_queries.raster_counts(spark, str(tmp_path)).collect()}
    assert len({sat for sat, _ in got}) == 3
    # 100 of quantity 1, then 50 of 4 and 50 of 5, then 50 of 5 that fill their mask twice
    assert (sum(clear for clear, _ in got.values()), sum(cloud for _, cloud in got.values())) == (150, 50)


def test_passes_on_a_stream(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 23) + dt.timedelta(minutes=m)
    schema = "id int, s string, start timestamp, end timestamp, night boolean, units array<int>"
    first, second = [(1, "A", t(50), t(55), True, [3]), (2, "A", t(300), t(305), True, [4])], [(3, "A", t(62), t(67), True, [5])]
    for part in (first, second):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.start_passes(ingest.granules_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "rows"), str(tmp_path / "out"), str(tmp_path / "cp"), 10).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("t").collect()
    # the granule after midnight came later and belongs to the pass of the day before
    assert [(r["n_granules"], r["units"], r["day"].day) for r in got] == [(2, [3, 5], 1), (1, [4], 2)]


def test_long_chains_settle(spark):
    rng = np.random.default_rng(5)
    place = rng.permutation(1000).tolist()
    edges = spark.createDataFrame([(place[k], place[k + 1]) for k in range(999)] + [(5000, 5001)], "a long, b long")
    assert {r["root"] for r in graph.components(edges).collect()} == {0, 5000}
    t = dt.datetime(2024, 1, 1)
    points = [(k, "N", t, 24.0 + 0.001 * k, 90.0, 1.0) for k in range(200)] + [(200 + k, "N", t, 24.0, 90.0, 9.0) for k in range(50)] + [(300, "N", t, None, 90.0, 1.0)]
    got = dedupe.proximity(spark.createDataFrame(points, "id long, s string, t timestamp, lat double, lon double, frp double")).collect()
    assert {(r["id"], r["group_root"], r["group_size"]) for r in got} == {(200, 0, 250), (300, 300, 1)}


def test_running_sums_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(None if k % 7 == 0 else int(k % 3), int(rng.integers(0, 500)), k, int(rng.integers(0, 9))) for k in range(400)]
    df = spark.createDataFrame(rows, "g int, at int, id int, v int").repartition(7)
    got = {r["id"]: (r["n"], r["total"]) for r in ordering.running(ordering.numbered(df, ["g"], F.floor(F.col("at") / 50), ["at", "id"], "n"), ["g"], F.floor(F.col("at") / 50), ["at", "id"], F.col("v"), "total").collect()}
    for g in (None, 0, 1, 2):
        total = 0
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 1):
            total += r[3]
            assert got[r[2]] == (n, total)


def test_sessions_over_midnight_against_brute_force(spark):
    rng = np.random.default_rng(7)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for k in range(300):
        begin = start + dt.timedelta(minutes=int(rng.integers(0, 6000)))
        rows.append((k, "AB"[k % 2], begin, begin + dt.timedelta(minutes=int(rng.integers(0, 90))), bool(k % 3), [k % 5]))
    got = passes.sessions(spark.createDataFrame(rows, "id int, s string, start timestamp, end timestamp, night boolean, units array<int>"), 20).collect()
    for s in "AB":
        sizes, before = [], None
        for r in sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], r[3], r[0])):
            if before is None or (r[2] - before).total_seconds() > 20 * 60:
                sizes.append(0)
            sizes[-1] += 1
            before = r[3]
        assert [r["n_granules"] for r in sorted((r for r in got if r["s"] == s), key=lambda r: r["pass"])] == sizes


def test_kappa_interval_of_whole_blocks(spark):
    """Two blocks, one all alike and one all apart: a draw is one, the other, or both."""
    rows = [(1, a, a) for a in (0, 1) for _ in range(20)] + [(2, a, 1 - a) for a in (0, 1) for _ in range(20)]
    r = validation.kappa_interval(spark.createDataFrame(rows, "year int, a int, b int"), "a", "b", "year", draws=200).first()
    assert (r["lo"], r["hi"], r["draws"]) == (-1.0, 1.0, 200)
    assert validation.kappa_interval(spark.createDataFrame(rows[:40], "year int, a int, b int"), "a", "b", "year").first()["lo"] is None


def test_low_verdicts_need_a_meaningful_baseline(spark):
    cells = spark.createDataFrame([(1, 2000, 1, -3.0, 0.1), (2, 2000, 1, -3.0, 0.1)], "unit int, year int, p int, mu double, sigma double")
    base = spark.createDataFrame([(1, 2000, 1, 0.4, 1.0, 2.0, 3.0, 30), (2, 2000, 1, 0.6, 1.0, 2.0, 3.0, 30)], "unit int, year int, p int, q10 double, q50 double, q90 double, top double, n int")
    assert {r["unit"]: r["code"] for r in evaluation.judge(cells, base).collect()} == {1: C.TYPICAL, 2: C.LOW}


def test_pages_feeds_and_regions(spark, tmp_path):
    for name, text in {"a": "latitude,longitude,acq_date\n24,90,2024-01-01\n", "b": "acq_date, Longitude,latitude\r\n2024-01-02,91,25\r\n\r\n2024-01-03,92\r\n", "c": "Invalid key.", "d": ""}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    got = sorted((r["latitude"], r["longitude"], r["acq_date"], r["satellite"]) for r in feeds.read_pages(spark, str(tmp_path)).where("latitude is not null").collect())
    assert got == [("24", "90", "2024-01-01", None), ("25", "91", "2024-01-02", None)]
    rows, warnings = feeds.union_of(spark, {"one": str(tmp_path / "a.csv"), "two": str(tmp_path / "none.csv"), "three": str(tmp_path / "c.csv")})
    assert [r["feed"] for r in rows.collect()] == ["one"] and [w.split()[0] for w in warnings] == ["two", "three"]
    with pytest.raises(ValueError):
        feeds.union_of(spark, {"three": str(tmp_path / "c.csv")})
    config = json.dumps({"x": {"name": "X", "tz": "Asia/Dhaka", "bbox": [88, 20, 93, 27]}, "y": {"name": "Y", "tz": "UTC", "bbox": [9, 0, 1, 2]}})
    region = feeds.Region.parse(config, "x")
    assert region.inside(spark.createDataFrame([(90.0, 24.0), (80.0, 24.0)], "lon double, lat double")).count() == 1
    for bad in ("y", "z"):
        with pytest.raises(ValueError):
            feeds.Region.parse(config, bad)
    assert feeds.check_upload(spark, str(tmp_path / "c.csv")) == 12
    with pytest.raises(ValueError):
        feeds.check_upload(spark, str(tmp_path / "a.csv"), 10)


def test_orbits(spark):
    lines = ["AQUA", "1 27424U 02022A   24001.50000000  .00001000  00000-0  20000-3 0  9990", "2 27424  98.2000 100.0000 0001500  80.0000 280.0000 14.57100000100000"]
    r = feeds.orbits(spark.createDataFrame([("f", k, v) for k, v in enumerate([*lines, "BROKEN", "x", "y"])], "file string, place int, value string")).collect()
    assert [(x["name"], x["number"], x["inclination"], x["eccentricity"], x["mean_motion"]) for x in r] == [("AQUA", 27424, 98.2, 0.00015, 14.571)]
    assert r[0]["epoch"] == dt.datetime(2024, 1, 1, 12)


def test_workspaces(spark, tmp_path):
    root, file = str(tmp_path / "saved"), tmp_path / "up.csv"
    file.write_text("latitude,longitude,acq_date,satellite\n21,88.2,2024-01-01,N\n24,91,2024-01-01,N\n")
    units = spatial.units_from_geojson(spark, layer_queries.SQUARE)
    saved = workspace.import_file(spark, root, str(file), boundaries=units)
    assert {r["district"] for r in workspace.load(spark, root, saved).collect()} == {"ring", "wide"}
    other = workspace.save(root, workspace.load(spark, root, saved))
    assert other != saved
    for bad in ("../x", "default", saved.upper()):
        with pytest.raises(ValueError):
            workspace.load(spark, root, bad)
    with pytest.raises(ValueError):
        workspace.import_file(spark, root, str(tmp_path / "up.txt")) if (tmp_path / "up.txt").write_text("x") else None
    fresh, warnings = workspace.refresh(spark, root, {"a": str(file), "b": str(tmp_path / "none")})
    assert workspace.load(spark, root, fresh).count() == 2 and len(warnings) == 1


def test_shapes(spark):
    with pytest.raises(ValueError):
        publish.check_shape(spark.createDataFrame([(2001,)], "year int"), "daily")
    stages = spark.createDataFrame([("a", True, "t"), ("b", False, "t")], "stage string, ok boolean, at string")
    r = publish.health(stages).first()
    assert not r["ok"] and r["stages"]["b"]["ok"] is False
    seen = spark.createDataFrame([(dt.date(2024, 2, 29), 3, 50)], "date date, unit int, seen int")
    r = publish.daily(seen, spark.createDataFrame([(2,), (3,)], "unit int")).first()
    assert (r["year"], r["days"], r["units"]) == (2024, 366, [2, 3]) and r["seen"][1][59] == 50 and sum(map(sum, r["seen"])) == 50 - 731
