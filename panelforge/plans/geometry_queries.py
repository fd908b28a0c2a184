"""Shapes, areas and overlaps on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import graph, mosaic, overlay, simplify, spatial
from ..sources import fixtures as fx

#: Corners of a district and of a parent as multiples of its size (thousandths), and holes of some.
DISTRICT = ((1000, 400), (400, 1000), (0, 300), (-400, 1000), (-1000, 400), (-1000, -400), (-400, -1000), (400, -1000), (1000, -400))
DISTRICT_HOLE = ((-200, -100), (-200, -500), (300, -500), (100, -100))
PARENT = ((1000, 1000), (200, 1000), (0, 600), (-1000, 1000), (-1000, -1000), (1000, -1000))
PARENT_HOLE = ((-300, -300), (300, -300), (300, 100), (-300, 100))


def _ring(corners) -> F.Column:
    point = lambda c: F.struct(((F.col("cx") + c[0] * F.col("r")) / 1e6).alias("x"), ((F.col("cy") + c[1] * F.col("r")) / 1e6).alias("y"))
    return F.array(*map(point, (*corners, corners[0])))


def _shapes(centres: DataFrame, key: str, corners, hole, every: int) -> DataFrame:
    """key and polygons round centres (cx, cy in millionths of a degree, r in thousandths)."""
    return centres.select(key, F.when(F.col(key) % every == 0, F.array(F.array(_ring(corners), _ring(hole)))).otherwise(F.array(F.array(_ring(corners)))).alias("polygons"))


def districts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    centres = fx.table(spark, sf, "supplier").select(k.alias("unit_idx"), (88_000_000 + k * 37 % 470 * 10_000).alias("cx"), (20_600_000 + k * 53 % 600 * 10_000).alias("cy"), (100 + k % 7 * 50).alias("r"))
    return _shapes(centres, "unit_idx", DISTRICT, DISTRICT_HOLE, 3)


def parents(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    centres = fx.table(spark, sf, "nation").select(k.alias("parent_idx"), (88_500_000 + k % 5 * 900_000).alias("cx"), (21_200_000 + F.floor(k / 5) * 1_200_000).alias("cy"), F.lit(600).alias("r"))
    return _shapes(centres, "parent_idx", PARENT, PARENT_HOLE, 2)


def polygon_area(spark: SparkSession, sf: str) -> DataFrame:
    both = districts(spark, sf).withColumn("kind", F.lit("district")).unionByName(parents(spark, sf).withColumnRenamed("parent_idx", "unit_idx").withColumn("kind", F.lit("parent")))
    return both.select("kind", F.col("unit_idx").alias("idx"), F.round(geo.area_km2(F.col("polygons")), 4).alias("area_km2"))


def overlap_parent(spark: SparkSession, sf: str) -> DataFrame:
    return overlay.overlap_parent(districts(spark, sf), parents(spark, sf)).select("unit_idx", "parent_idx", F.round("overlap", 8).alias("overlap"))


def overlap_areas(spark: SparkSession, sf: str) -> DataFrame:
    """All overlaps of districts with each other, which have the same shape and often cross."""
    d = districts(spark, sf)
    both = overlay.overlaps(d, d.withColumnRenamed("unit_idx", "other"), parent="other", ordered=True)
    return both.select("unit_idx", "other", F.round("overlap", 8).alias("overlap")).where(F.col("overlap") > 0)


def land_parcels(spark: SparkSession, sf: str) -> DataFrame:
    """A parcel for each customer on a grid forty wide, with winding borders that neighbours share."""
    k, customers = F.col("c_custkey"), fx.table(spark, sf, "customer").select("c_custkey")
    # few files hold many parcels, of 33 points each
    cells = customers.repartition(simplify.tasks(customers, 33), "c_custkey").select(k.alias("unit_idx"), (k % 40).cast("int").alias("i"), F.floor(k / 40).cast("int").alias("j"))
    bend = lambda i, j, s: ((i * 31 + j * 17 + s * s * 7) % 11 - 5) * 0.002

    def side(i, j, across: bool, back: bool):
        """Eight points from the corner (i, j) to the next one, without the last."""
        def point(s):
            off = F.when(s == 0, 0.0).otherwise(bend(i, j, s if across else s + 3))
            x, y = (i + s / 8, j + off) if across else (i + off, j + s / 8)
            return F.struct((88 + x * 0.1).alias("x"), (20 + y * 0.1).alias("y"))

        steps = F.sequence(F.lit(8), F.lit(1), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(7))
        corner = lambda s: F.when(s == 8, point_at(i + (1 if across else 0), j + (0 if across else 1))).otherwise(point(s))
        return F.transform(steps, corner)

    point_at = lambda i, j: F.struct((88 + i * 0.1).alias("x"), (20 + j * 0.1).alias("y"))
    i, j = F.col("i"), F.col("j")
    ring = F.concat(side(i, j, True, False), side(i + 1, j, False, False), side(i, j + 1, True, True), side(i, j, False, True), F.array(point_at(i, j)))
    return cells.select("unit_idx", F.array(F.array(ring)).alias("polygons"))


def simplified_borders(spark: SparkSession, sf: str) -> DataFrame:
    """Points and area of each parcel before and after its borders are simplified."""
    parcels = land_parcels(spark, sf)
    count = lambda c: F.size(F.flatten(F.flatten(c)))
    sized = lambda d, s: d.select("unit_idx", count("polygons").cast("long").alias(f"points_{s}"), F.round(geo.area_km2(F.col("polygons")), 4).alias(f"area_{s}"))
    return sized(parcels, "before").join(graph.shuffled(sized(simplify.simplified(parcels, least=4e-6), "after")), "unit_idx")


def footprint_units(spark: SparkSession, sf: str) -> DataFrame:
    """Districts' outlines, as footprints, and the parents that they meet: those whose hole they are in aren't among them."""
    outlines = districts(spark, sf).select(F.col("unit_idx").alias("id"), F.get(F.get("polygons", F.lit(0)), F.lit(0)).alias("ring"))
    return spatial.touching(outlines, parents(spark, sf).select(F.col("parent_idx").alias("unit_idx"), F.flatten("polygons").alias("rings")))


def boundary_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Districts as GeoJSON geometry, read back: the text, and how many points its rings have."""
    texts = districts(spark, sf).select("unit_idx", spatial.geometry_text(F.col("polygons")).alias("geometry"))
    whole = texts.select("unit_idx", "geometry", F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"'), F.col("unit_idx"), F.lit('"},"geometry":'), F.col("geometry"), F.lit("}]}")).alias("value"))
    back = spatial.districts(whole).select(F.col("name").cast("long").alias("unit_idx"), F.size(F.flatten("rings")).cast("long").alias("points"), F.col("wrong").isNull().alias("usable"))
    return texts.join(back, "unit_idx")


def _pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as pixels: some have no data, and some blocks are missing."""
    x, y = (F.col("l_partkey") % 96).cast("int"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 64).cast("int")
    klass = F.element_at(F.array(*map(F.lit, (0, 10, 10, 40, 80, 95))), (F.col("l_quantity").cast("int") % 6 + 1))
    return fx.table(spark, sf, "lineitem").select(x.alias("x"), y.alias("y"), klass.alias("klass")).where((F.shiftright("x", 4) + F.shiftright("y", 4)) % 5 != 0)


def mosaic_mode(spark: SparkSession, sf: str) -> DataFrame:
    return mosaic.pyramid(_pixels(spark, sf), 4)


def mosaic_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return mosaic.tiles(mosaic.pyramid(_pixels(spark, sf), 3).where("level > 0"), 8).select("level", "tx", "ty", F.array_join(F.transform("pixels", lambda p: p.cast("string")), ",").alias("pixels"))


def _corners(name: str, corners) -> str:
    rows = [f"('{name}', {k}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for k, (a, b) in enumerate(zip(corners, (*corners[1:], corners[0])))]
    return ", ".join(rows)


#: Edges of all shapes.
SHAPES = f"""corners(part, place, px, py, qx, qy) AS (VALUES {_corners("d", DISTRICT)}, {_corners("dh", DISTRICT_HOLE)}, {_corners("p", PARENT)}, {_corners("ph", PARENT_HOLE)}),
centres AS (
  SELECT 'd' AS kind, s_suppkey AS idx, 88000000 + s_suppkey * 37 % 470 * 10000 AS cx, 20600000 + s_suppkey * 53 % 600 * 10000 AS cy, 100 + s_suppkey % 7 * 50 AS r, 3 AS every FROM supplier
  UNION ALL SELECT 'p', n_nationkey, 88500000 + n_nationkey % 5 * 900000, 21200000 + n_nationkey // 5 * 1200000, 600, 2 FROM nation
), e AS (
  SELECT kind, idx, part, (cx + px * r) / 1e6 AS x1, (cy + py * r) / 1e6 AS y1, (cx + qx * r) / 1e6 AS x2, (cy + qy * r) / 1e6 AS y2
  FROM centres JOIN corners ON part = kind OR (part = kind || 'h' AND idx % every = 0)
)"""
#: The excess of each edge on the sphere of equal areas.
AREA_SQL = f"""WITH {SHAPES},
k AS (SELECT sqrt(f * (2 - f)) AS ec, 6378.137 AS a FROM (SELECT 1 / 298.257223563 AS f)),
q AS (SELECT *, (1 - ec * ec) * (1 / (1 - ec * ec) - ln((1 - ec) / (1 + ec)) / (2 * ec)) AS qp FROM k),
s AS (SELECT kind, idx, part, radians(x2 - x1) AS across, sin(radians(y1)) AS s1, sin(radians(y2)) AS s2, ec, qp, a FROM e, q),
t AS (
  SELECT *, tan(asin((1 - ec * ec) * (s1 / (1 - ec * ec * s1 * s1) - ln((1 - ec * s1) / (1 + ec * s1)) / (2 * ec)) / qp) / 2) AS t1,
    tan(asin((1 - ec * ec) * (s2 / (1 - ec * ec * s2 * s2) - ln((1 - ec * s2) / (1 + ec * s2)) / (2 * ec)) / qp) / 2) AS t2 FROM s
), rings AS (SELECT kind, idx, part, abs(sum(2 * atan(tan(across / 2) * (t1 + t2) / (1 + t1 * t2)))) * any_value(a * a * qp / 2) AS area FROM t GROUP BY ALL)
SELECT CASE kind WHEN 'd' THEN 'district' ELSE 'parent' END AS kind, idx, round(sum(CASE WHEN part = kind THEN area ELSE -area END), 4) AS area_km2 FROM rings GROUP BY kind, rings.kind, idx"""
#: Slabs between all heights at which edges end or cross: the common length half way up, times the height.
OVERLAP_SQL = f"""{SHAPES},
box AS (SELECT kind, idx, min(least(x1, x2)) AS w, max(greatest(x1, x2)) AS o, min(least(y1, y2)) AS s, max(greatest(y1, y2)) AS n FROM e GROUP BY ALL),
pairs AS (SELECT a.idx AS a, b.idx AS b FROM box a JOIN box b ON a.kind = 'd' AND {{match}} AND a.w < b.o AND b.w < a.o AND a.s < b.n AND b.s < a.n),
pe AS (SELECT a, b, 0 AS side, e.* FROM pairs JOIN e ON kind = 'd' AND idx = a UNION ALL SELECT a, b, 1, e.* FROM pairs JOIN e ON kind = '{{kind}}' AND idx = b),
x AS (
  SELECT p.a, p.b, p.y1 + t * (p.y2 - p.y1) AS y FROM (
    SELECT p.a, p.b, p.y1, p.y2, ((q.x1 - p.x1) * (q.y2 - q.y1) - (q.y1 - p.y1) * (q.x2 - q.x1)) / nullif((p.x2 - p.x1) * (q.y2 - q.y1) - (p.y2 - p.y1) * (q.x2 - q.x1), 0) AS t,
      ((q.x1 - p.x1) * (p.y2 - p.y1) - (q.y1 - p.y1) * (p.x2 - p.x1)) / nullif((p.x2 - p.x1) * (q.y2 - q.y1) - (p.y2 - p.y1) * (q.x2 - q.x1), 0) AS u
    FROM pe p JOIN pe q ON p.a = q.a AND p.b = q.b AND p.side = 0 AND q.side = 1) p WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1
), ys AS (SELECT a, b, y1 AS y FROM pe UNION SELECT a, b, y FROM x), slabs AS (SELECT a, b, y, lead(y) OVER (PARTITION BY a, b ORDER BY y) AS top FROM ys),
ev AS (
  SELECT a, b, y, top, side, x1 + ((y + top) / 2 - y1) * (x2 - x1) / (y2 - y1) AS x FROM slabs JOIN pe USING (a, b)
  WHERE top > y AND (y1 > (y + top) / 2) <> (y2 > (y + top) / 2)
), par AS (
  SELECT a, b, y, top, x, sum(1 - side) OVER w AS na, sum(side) OVER w AS nb FROM ev WINDOW w AS (PARTITION BY a, b, y, top ORDER BY x, side ROWS UNBOUNDED PRECEDING)
), par2 AS (SELECT a, b, y, top, x, na, nb, lead(x) OVER (PARTITION BY a, b, y, top ORDER BY x, na + nb) AS next FROM par),
area AS (SELECT a, b, sum((next - x) * (top - y)) AS overlap FROM par2 WHERE na % 2 = 1 AND nb % 2 = 1 GROUP BY a, b)"""

#: The class of each cell from its pixels, level by level on its own.
MOSAIC_SQL = """px AS (
  SELECT (l_partkey % 96)::INT AS x, ((l_suppkey * 7 + l_linenumber) % 64)::INT AS y, [0, 10, 10, 40, 80, 95][l_quantity::INT % 6 + 1] AS klass FROM lineitem WHERE ((l_partkey % 96) // 16 + ((l_suppkey * 7 + l_linenumber) % 64) // 16) % 5 <> 0
), n AS (SELECT level, x >> level AS x, y >> level AS y, klass, count(*) AS n FROM px, (SELECT unnest(range(5))::INT AS level) GROUP BY ALL),
m AS (SELECT level, x, y, klass FROM n QUALIFY row_number() OVER (PARTITION BY level, x, y ORDER BY klass = 0, n DESC, klass) = 1)"""

QUERIES = {"footprint_units": footprint_units, "boundary_texts": boundary_texts, "mosaic_mode": mosaic_mode, "mosaic_tiles": mosaic_tiles, "simplified_borders": simplified_borders, "polygon_area": polygon_area, "overlap_parent": overlap_parent, "overlap_areas": overlap_areas}
#: Edges that share a point, or a corner of one in the other by the even-odd rule.
TOUCH_SQL = f"""WITH {SHAPES}, f AS (SELECT * FROM e WHERE part = 'd'), g AS (SELECT * FROM e WHERE kind = 'p'),
s AS (
  SELECT f.idx AS a, g.idx AS b, f.x1, f.y1, f.x2, f.y2, g.x1 AS u1, g.y1 AS v1, g.x2 AS u2, g.y2 AS v2 FROM f JOIN g ON true
), cut AS (
  SELECT DISTINCT a, b FROM s WHERE ((x2 - x1) * (v1 - y1) - (y2 - y1) * (u1 - x1)) * ((x2 - x1) * (v2 - y1) - (y2 - y1) * (u2 - x1)) <= 0
    AND ((u2 - u1) * (y1 - v1) - (v2 - v1) * (x1 - u1)) * ((u2 - u1) * (y2 - v1) - (v2 - v1) * (x2 - u1)) <= 0
    AND NOT ((x2 - x1) * (v1 - y1) - (y2 - y1) * (u1 - x1) = 0 AND (x2 - x1) * (v2 - y1) - (y2 - y1) * (u2 - x1) = 0)
), a_in AS (SELECT a, b FROM s WHERE (v1 > y1) <> (v2 > y1) AND x1 < u1 + (u2 - u1) * (y1 - v1) / (v2 - v1) GROUP BY a, b, x1, y1 HAVING count(*) % 2 = 1),
b_in AS (SELECT a, b FROM s WHERE (y1 > v1) <> (y2 > v1) AND u1 < x1 + (x2 - x1) * (v1 - y1) / (y2 - y1) GROUP BY a, b, u1, v1 HAVING count(*) % 2 = 1)
SELECT DISTINCT a AS id, b::BIGINT AS unit_idx FROM (SELECT a, b FROM cut UNION SELECT a, b FROM a_in UNION SELECT a, b FROM b_in)"""

ORACLE_SQL = {
    "footprint_units": TOUCH_SQL,
    "boundary_texts": f"""WITH {SHAPES}, c AS (SELECT idx, part, place, e.x1, e.y1 FROM (SELECT kind, idx, part, place, (cx + px * r) / 1e6 AS x1, (cy + py * r) / 1e6 AS y1 FROM centres JOIN corners ON part = kind OR (part = kind || 'h' AND idx % every = 0)) e WHERE kind = 'd'),
r AS (SELECT idx, part, '[' || string_agg('[' || x1 || ',' || y1 || ']', ',' ORDER BY place) || ',[' || first(x1 ORDER BY place) || ',' || first(y1 ORDER BY place) || ']]' AS ring, count(*) + 1 AS n FROM c GROUP BY idx, part)
SELECT idx AS unit_idx, '{{"type":"Polygon","coordinates":[' || string_agg(ring, ',' ORDER BY part) || ']}}' AS geometry, sum(n)::BIGINT AS points, true AS usable FROM r GROUP BY idx""",
    "mosaic_mode": f"WITH {MOSAIC_SQL} SELECT * FROM m",
    "mosaic_tiles": f"""WITH {MOSAIC_SQL}, b AS (SELECT level, min(x // 8) AS x0, max(x // 8) AS x1, min(y // 8) AS y0, max(y // 8) AS y1 FROM m WHERE level BETWEEN 1 AND 3 GROUP BY level),
f AS (SELECT level, tx, ty, c.at FROM (SELECT level, unnest(range(x0, x1 + 1)) AS tx, y0, y1 FROM b) JOIN LATERAL (SELECT unnest(range(y0, y1 + 1)) AS ty) ON true, (SELECT unnest(range(64)) AS at) c)
SELECT f.level, tx, ty, string_agg(coalesce(klass, 0), ',' ORDER BY f.at) AS pixels FROM f LEFT JOIN m ON m.level = f.level AND m.x = tx * 8 + f.at % 8 AND m.y = ty * 8 + f.at // 8 GROUP BY ALL""",
    "polygon_area": AREA_SQL,
    "overlap_parent": "WITH " + OVERLAP_SQL.format(match="b.kind = 'p'", kind="p")
    + """, best AS (SELECT a, max_by({'b': b, 'o': overlap}, {'o': round(overlap, 12), 'k': -b}) AS m FROM area WHERE overlap > 1e-12 GROUP BY a)
SELECT idx AS unit_idx, m.b::BIGINT AS parent_idx, round(m.o, 8) AS overlap FROM centres LEFT JOIN best ON a = idx WHERE kind = 'd'""",
    "overlap_areas": "WITH " + OVERLAP_SQL.format(match="b.kind = 'd' AND a.idx < b.idx", kind="d")
    + " SELECT a AS unit_idx, b AS other, round(overlap, 8) AS overlap FROM area WHERE round(overlap, 8) > 0",
}
