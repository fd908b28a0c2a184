"""Areas, overlaps, mosaics, simpler borders, schemas."""

import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import geo
from panelforge.operators import mosaic, overlay, schemas, simplify
from panelforge.plans import geometry_queries as Q

SHAPE = "k long, polygons array<array<array<struct<x: double, y: double>>>>"


def ring(points):
    return [*points, points[0]]


def test_known_areas_on_the_ellipsoid(spark):
    a, f = 6378.137, 1 / 298.257223563
    e = math.sqrt(f * (2 - f))
    surface = 2 * math.pi * a * a * (1 + (1 - e * e) / e * math.atanh(e))
    octant = ring([(0.0, 0.0), (90.0, 0.0), (90.0, 90.0), (0.0, 90.0)])
    # a thin wedge from the equator to the pole, and one over the date line
    wedge, dated = ring([(10.0, 0.0), (13.0, 0.0), (13.0, 90.0), (10.0, 90.0)]), ring([(179.0, 0.0), (-178.0, 0.0), (-178.0, 90.0), (179.0, 90.0)])
    rows = [(0, [[octant]]), (1, [[octant[::-1]]]), (2, [[wedge]]), (3, [[dated]]), (4, [[octant, wedge]]), (5, [[wedge], [dated]])]
    got = {r["k"]: r["area"] for r in spark.createDataFrame(rows, SHAPE).select("k", geo.area_km2(F.col("polygons")).alias("area")).collect()}
    eighth, narrow = surface / 8, surface / 2 * 3 / 360
    for k, want in enumerate((eighth, eighth, narrow, narrow, eighth - narrow, 2 * narrow)):
        assert abs(got[k] / want - 1) < 1e-9
    # a cell of a thousandth of a degree: meridian and parallel radii of curvature at 24 N
    lat, d = math.radians(24), math.radians(0.001)
    w = math.sqrt(1 - e * e * math.sin(lat) ** 2)
    flat = (a * (1 - e * e) / w**3 * d) * (a / w * math.cos(lat) * d)
    small = ring([(90.0, 23.9995), (90.001, 23.9995), (90.001, 24.0005), (90.0, 24.0005)])
    area = spark.createDataFrame([(0, [[small]])], SHAPE).select(geo.area_km2(F.col("polygons")).alias("area")).first()["area"]
    assert abs(area / flat - 1) < 1e-6


def _inside(p, polygons):
    n = 0
    for part in polygons:
        for r in part:
            for (x1, y1), (x2, y2) in zip(r, r[1:]):
                n += (y1 > p[1]) != (y2 > p[1]) and p[0] < x1 + (p[1] - y1) * (x2 - x1) / (y2 - y1)
    return n % 2 == 1


def _common(a, b):
    """Area of overlap by slabs between all heights at which edges end or cross."""
    edges = [[(r[k], r[k + 1]) for part in s for r in part for k in range(len(r) - 1)] for s in (a, b)]
    ys = {p[1] for side in edges for e in side for p in e}
    for (x1, y1), (x2, y2) in edges[0]:
        for (x3, y3), (x4, y4) in edges[1]:
            d = (x2 - x1) * (y4 - y3) - (y2 - y1) * (x4 - x3)
            if d:
                t = ((x3 - x1) * (y4 - y3) - (y3 - y1) * (x4 - x3)) / d
                ys.add(y1 + min(1, max(0, t)) * (y2 - y1))
    total, ys = 0.0, sorted(ys)
    for low, high in zip(ys, ys[1:]):
        y = (low + high) / 2
        at = [sorted(x1 + (y - y1) * (x2 - x1) / (y2 - y1) for (x1, y1), (x2, y2) in side if (y1 > y) != (y2 > y)) for side in edges]
        spans = [list(zip(s[::2], s[1::2])) for s in at]
        total += sum(max(0.0, min(p[1], q[1]) - max(p[0], q[0])) for p in spans[0] for q in spans[1]) * (high - low)
    return total


def _star(rng, x, y, size, corners):
    angles = np.sort(rng.uniform(0, 2 * math.pi, corners))
    while np.max(np.diff(np.append(angles, angles[0] + 2 * math.pi))) > 2.5:
        angles = np.sort(rng.uniform(0, 2 * math.pi, corners))
    radii = rng.uniform(0.4, 1, corners) * size
    return ring([(float(round(x + r * math.cos(t), 5)), float(round(y + r * math.sin(t), 5))) for t, r in zip(angles, radii)])


@pytest.mark.parametrize("place", [(90.0, 24.0), (-0.1, 0.1)])
def test_overlaps_of_random_shapes(spark, place):
    rng = np.random.default_rng(int(place[0]))
    shapes = []
    for k in range(12):
        x, y = place[0] + rng.uniform(-0.6, 0.6), place[1] + rng.uniform(-0.6, 0.6)
        shell = _star(rng, x, y, rng.uniform(0.1, 0.9), int(rng.integers(5, 14)))
        hole = [(x + (p[0] - x) * 0.3, y + (p[1] - y) * 0.3) for p in shell]
        part = [shell, [(float(round(a, 5)), float(round(b, 5))) for a, b in hole]] if k % 3 == 0 else [shell]
        shapes.append((k, [[r[::-1] if k % 2 else r for r in part]]))
    # borders in common: the same shape, one that touches along an edge, one that fills a hole
    box = lambda w, s, o, n: ring([(w, s), (o, s), (o, n), (w, n)])
    x, y = place[0] + 3, place[1]
    shapes += [(20, [[box(x, y, x + 1, y + 1)]]), (21, [[box(x, y, x + 1, y + 1)]]), (22, [[box(x + 1, y + 0.25, x + 2, y + 0.75)]]), (23, [[box(x - 1, y - 1, x + 2, y + 2), box(x, y, x + 1, y + 1)]]), (24, [[box(x + 0.5, y, x + 1, y + 0.5)], [box(x, y + 0.5, x + 0.25, y + 1)]])]
    df = spark.createDataFrame(shapes, SHAPE)
    got = {(r["k"], r["o"]): r["overlap"] for r in overlay.overlaps(df, df.withColumnRenamed("k", "o"), "k", "o").collect()}
    for a, p in shapes:
        for b, q in shapes:
            want = _common(p, q)
            assert abs(got.get((a, b), 0.0) - want) < 1e-9, (a, b)
    assert (20, 22) not in got and (20, 23) not in got and abs(got[20, 24] - 0.375) < 1e-9


def test_parent_ties_and_none(spark):
    box = lambda w, o: [[ring([(w, 0.0), (o, 0.0), (o, 1.0), (w, 1.0)])]]
    units = spark.createDataFrame([(1, box(0.0, 2.0)), (2, box(1.5, 3.0)), (3, box(9.0, 10.0))], SHAPE).withColumnRenamed("k", "unit_idx")
    parents = spark.createDataFrame([(7, box(1.0, 4.0)), (5, box(-1.0, 1.0))], SHAPE).withColumnRenamed("k", "parent_idx")
    got = {r["unit_idx"]: (r["parent_idx"], r["overlap"]) for r in overlay.overlap_parent(units, parents).collect()}
    assert got[1][0] == 5 and got[2] == (7, 1.5) and got[3] == (None, None)


def test_mosaic_of_modes(spark):
    rng = np.random.default_rng(2)
    pixels = [(int(x), int(y), int(rng.choice([0, 10, 20, 40]))) for x in range(-4, 12) for y in range(0, 8) if not (0 <= x < 4 and y < 4)]
    cells = mosaic.pyramid(spark.createDataFrame(pixels, "x int, y int, klass int"), 2)
    got = {(r["level"], r["x"], r["y"]): r["klass"] for r in cells.collect()}
    for level in range(3):
        below = {}
        for x, y, c in pixels:
            below.setdefault((level, x >> level, y >> level), Counter())[c] += 1
        for at, n in below.items():
            assert got.pop(at) == max(n, key=lambda c: (c != 0, n[c], -c))
    assert not got
    tiles = {(r["level"], r["tx"], r["ty"]): r["pixels"] for r in mosaic.tiles(cells, 4).collect()}
    assert tiles[0, 0, 0] == [0] * 16 and sorted({k[0]: 0 for k in tiles}) == [0, 1, 2] and sum(k[0] == 0 for k in tiles) == 8
    assert tiles[0, -1, 1] == [next(c for x, y, c in pixels if (x, y) == (k % 4 - 4, k // 4 + 4)) for k in range(16)]


def plain_thinned(points, least):
    """One point at a time, all areas anew, with the areas that went as floors."""
    points, floor = [(p, 0.0) for p in points], 0.0
    while len(points) > (4 if points[0][0] == points[-1][0] else 2):
        area = lambda k: max(points[k][1], abs((points[k][0][0] - points[k - 1][0][0]) * (points[k + 1][0][1] - points[k - 1][0][1]) - (points[k + 1][0][0] - points[k - 1][0][0]) * (points[k][0][1] - points[k - 1][0][1])) / 2)  # noqa: B023, E731
        a, _, k = min((area(k), points[k][0], k) for k in range(1, len(points) - 1))
        if a >= least:
            break
        floor = a
        points = [(p, max(f, floor) if j in (k - 1, k + 1) else f) for j, (p, f) in enumerate(points) if j != k]
    return [p for p, _ in points]


def test_effective_areas_against_plain_removal():
    rng = np.random.default_rng(3)
    for n in (2, 3, 5, 60):
        for least in (0.0, 0.01, 0.3):
            points = [(float(k), float(v)) for k, v in enumerate(rng.normal(0, 1, n).cumsum())]
            assert simplify.thinned(points, least) == plain_thinned(points, least)
            closed = [*points, points[0]]
            assert simplify.thinned(closed, least) == plain_thinned(closed, least)


def test_simpler_borders_stay_joined(spark, tmp_path):
    customers = spark.range(0, 160).select(F.col("id").alias("c_custkey"))
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    parcels = Q.land_parcels(spark, str(tmp_path))
    lone = [[ring([(10.0, 10.0), (11.0, 10.0), (11.0, 10.5), (11.00001, 10.5), (11.0, 10.6), (11.0, 11.0), (10.0, 11.0)]), ring([(10.2, 10.2), (10.20001, 10.2), (10.2, 10.20001)])]]
    tiny = [[ring([(0.0, 0.0), (0.00001, 0.0), (0.0, 0.00001)])]]
    parcels = parcels.unionByName(spark.createDataFrame([(900, lone), (901, tiny)], SHAPE.replace("k long", "unit_idx long")))
    before = {r["unit_idx"]: r["polygons"] for r in parcels.collect()}
    after = {r["unit_idx"]: r["polygons"] for r in simplify.simplified(parcels, least=4e-6).collect()}
    assert set(after) == set(before)
    points = lambda shapes: [[(q["x"], q["y"]) for q in r] for p in shapes for r in p]
    assert points(after[900]) == [[(10.0, 10.0), (11.0, 10.0), (11.0, 11.0), (10.0, 11.0), (10.0, 10.0)]]
    assert points(after[901])[0][0] == points(after[901])[0][-1] and len(points(after[901])[0]) == 4
    edges, total = Counter(), 0.0
    for k, shape in after.items():
        if k < 900:
            (r,) = points(shape)
            edges.update(zip(r, r[1:]))
            total += sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(r, r[1:])) / 2
    inner = [e for e in edges if e[::-1] in edges]
    outer = {a: b for a, b in edges if (b, a) not in edges}
    # every border is run along once each way, and the outer ones are one ring around the same area
    assert set(edges.values()) == {1} and len(inner) > 400
    start = at = next(iter(outer))
    around, steps = 0.0, 0
    while True:
        around += (at[0] * outer[at][1] - outer[at][0] * at[1]) / 2
        at, steps = outer[at], steps + 1
        if at == start:
            break
    assert steps == len(outer) and abs(around - total) < 1e-9
    sides = sum(len(plain_thinned(arc, 4e-6)) - 1 for arc in {tuple(a) if a < a[::-1] else tuple(a[::-1]) for shape in (before[k] for k in before if k < 900) for a in _arcs(points(shape)[0], before)} for arc in [list(arc)])
    assert len(inner) / 2 + len(outer) == sides


def _arcs(r, shapes):
    """A ring cut where more than two borders meet, by plain search."""
    near = _arcs.near = getattr(_arcs, "near", None) or {}
    if not near:
        for shape in shapes.values():
            for p in shape:
                for q in p:
                    w = [(a["x"], a["y"]) for a in q]
                    for a, b in zip(w, w[1:]):
                        near.setdefault(a, set()).add(b)
                        near.setdefault(b, set()).add(a)
    at = [k for k in range(len(r) - 1) if len(near[r[k]]) > 2]
    if not at:
        first = r.index(min(r))
        return [r[first:-1] + r[: first + 1]]
    w = r[at[0] : -1] + r[: at[0] + 1]
    cuts = [k - at[0] for k in at] + [len(w) - 1]
    return [w[a : b + 1] for a, b in zip(cuts, cuts[1:])]


def test_schemas_name_the_first_violation(spark):
    day = schemas.fields({"d": schemas.whole(0, 400), "u": schemas.text()})
    node = schemas.fields({"schema": schemas.const("daily"), "year": schemas.whole(), "seen": schemas.items(schemas.number(null=True), depth=3, least=2, most=2), "passes": schemas.items(day), "end": schemas.text(null=True), "ok": schemas.flag()}, optional=("ok",), others=False)
    good = {"schema": "daily", "year": 2024, "seen": [[[1, None], [0.5, -1]], []], "passes": [{"d": 1, "u": "f"}], "end": None}
    cases = [
        (good, None), (good | {"ok": True}, None), (good | {"ok": 1}, "ok: not true or false"), (good | {"year": 2024.0}, None), (good | {"year": 2024.5}, "year: not a whole number"), (good | {"schema": "nrt"}, "schema: not one of daily"),
        (good | {"seen": [[[1, None], [0.5]], [["a", 1]]]}, "seen/0/1: fewer than 2 items"), (good | {"seen": [[[1, None]], [["a", 1]]]}, "seen/1/0/0: not a number"), (good | {"seen": {"a": 1}}, "seen: not an array"),
        (good | {"passes": [{"d": 1, "u": "f"}, {"d": 401}], "year": "x"}, "passes/1: u is missing"), (good | {"passes": [{"d": 401, "u": 1}]}, "passes/0/d: above 400"), (good | {"far": 1}, ": a name that isn't known"), ([good], ": not an object"), (good | {"end": 3}, "end: not a text"),
    ]
    df = spark.createDataFrame([(k, json.dumps(c)) for k, (c, _) in enumerate(cases)] + [(99, "{"), (98, "null")], "k int, value string")
    got = {r["k"]: r["violation"] for r in schemas.violations(df, node).collect()}
    assert [got[k] for k in range(len(cases))] == [want for _, want in cases]
    assert got[99] == ": not JSON" and got[98] == ": not an object"
    with pytest.raises(ValueError, match="documents break their schema, first at : a name"):
        schemas.check(df, node)
    assert schemas.check(df.where("k < 2"), node).count() == 2


def test_detections_in_parts(spark):
    import datetime as dt

    from panelforge.operators import publish

    rng = np.random.default_rng(6)
    rows = [(k, k % 5, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(rng.integers(0, 11_000))), 1.0, 0, 3, 2024, 1) for k in range(95)]
    df = spark.createDataFrame(rows, "id long, s int, t timestamp, frp double, x int, unit int, year int, p int").repartition(4)
    whole, parts = publish.detections(df).first(), sorted(publish.detections(df, 30).collect(), key=lambda r: r["part"])
    assert [(r["part"], len(r["t"])) for r in parts] == [(0, 30), (1, 30), (2, 30), (3, 5)]
    assert sum((r["t"] for r in parts), []) == whole["t"] and sum((r["s"] for r in parts), []) == whole["s"]
