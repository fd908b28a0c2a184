"""Polygons over polygons: areas of overlap and the parent that holds most of a district.

No intersection is built. The border of what two shapes share consists of the stretches of either
border that lie inside the other, so its area is the sum of their cross products: edges that come
near each other are cut where they meet, each stretch is placed inside or outside by the edges of
the other shape in its band of latitude, and what lies on both borders counts once. Edges meet in
joins on grid cells and bands, so a shape with many edges is spread over tasks.

Pairs of shapes with few edges, of which there may be very many, don't shuffle their edges one by one:
shapes go to the cells that their boxes touch, dealt into blocks, and two blocks of a cell meet in a task
in batches of pairs. There a shape is the signed sum of the strips under its edges, so an overlap is the
sum over pairs of edges of the integral of the lower one, over the longitudes that both have.

Coordinates are put on a grid of 1e-7 degrees (a centimetre). Whether edges meet or lie on each other is
decided in whole numbers, so borders that two shapes share are found to be the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

GRID = 10_000_000
_EDGE = ("x1", "y1", "x2", "y2")
#: Shapes with more edges, or boxes over more cells, take the way of single edges; shapes in a block; pairs of edges at a time.
FEW_EDGES, FEW_CELLS, BLOCK, AT_ONCE = 256, 1000, 2000, 200_000


def edges(shapes: DataFrame, key: str) -> DataFrame:
    """key, x1, y1, x2, y2 (whole steps of the grid) of all edges, the inside to their left.
    shapes: key, polygons (arrays of closed rings, shell first)."""
    rings = shapes.select(key, F.explode("polygons").alias("_p")).select(key, F.posexplode("_p").alias("_at", "_r"))
    fixed = lambda v: F.bround(v * GRID).cast("long")
    rings = rings.withColumn("_r", F.transform("_r", lambda q: F.struct(fixed(q["x"]).alias("x"), fixed(q["y"]).alias("y"))))
    wrong = (geo.turn(F.col("_r")) > 0) != (F.col("_at") == 0)
    rings = rings.withColumn("_r", F.when(wrong, F.reverse("_r")).otherwise(F.col("_r")))
    each = rings.select(key, F.explode(geo._edges(F.col("_r"))).alias("e"))
    return each.select(key, F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2")).where("x1 != x2 OR y1 != y2")


def _cells(low: Column, high: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def _boxed(e: DataFrame, size: int) -> DataFrame:
    """Edges in all cells that their boxes touch."""
    x = e.withColumn("gx", _cells(F.least("x1", "x2"), F.greatest("x1", "x2"), size))
    return x.withColumn("gy", _cells(F.least("y1", "y2"), F.greatest("y1", "y2"), size))


def _meetings(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """For edges e of a and f of b that meet: cuts, the shares of e at which they do, and along (low,
    high, same direction) if they lie on each other."""
    left = _boxed(a, size).select("gx", "gy", "a", F.struct(*_EDGE).alias("e"))
    right = _boxed(b, size).select("gx", "gy", "b", F.struct(*_EDGE).alias("f"))
    e, f = F.col("e"), F.col("f")
    apart = [F.greatest(e[c + "1"], e[c + "2"]) < F.least(f[c + "1"], f[c + "2"]) for c in "xy"] + [F.greatest(f[c + "1"], f[c + "2"]) < F.least(e[c + "1"], e[c + "2"]) for c in "xy"]
    near = left.join(right, ["gx", "gy"]).where(~(apart[0] | apart[1] | apart[2] | apart[3])).select("a", "b", "e", "f").distinct()

    def side(s: Column, x: Column, y: Column) -> Column:
        return (s["x2"] - s["x1"]) * (y - s["y1"]) - (s["y2"] - s["y1"]) * (x - s["x1"])

    sides = {"s1": side(f, e["x1"], e["y1"]), "s2": side(f, e["x2"], e["y2"]), "s3": side(e, f["x1"], f["y1"]), "s4": side(e, f["x2"], f["y2"])}
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    share = lambda x, y: ((x - e["x1"]).cast("double") * dx + (y - e["y1"]).cast("double") * dy) / (dx.cast("double") * dx + dy.cast("double") * dy)
    t1, t2 = share(f["x1"], f["y1"]), share(f["x2"], f["y2"])
    low, high = F.greatest(F.lit(0.0), F.least(t1, t2)), F.least(F.lit(1.0), F.greatest(t1, t2))
    level = (F.col("s1") == 0) & (F.col("s2") == 0)
    across = (F.signum("s1") * F.signum("s2") <= 0) & (F.signum("s3") * F.signum("s4") <= 0)
    same = (f["x2"] - f["x1"]).cast("double") * dx + (f["y2"] - f["y1"]).cast("double") * dy > 0
    cuts = F.when(level, F.array(low, high)).otherwise(F.array(F.col("s1").cast("double") / (F.col("s1").cast("double") - F.col("s2").cast("double"))))
    along = F.when(level, F.struct(low.alias("low"), high.alias("high"), same.alias("same")))
    return near.withColumns(sides).where(F.when(level, low < high).otherwise(across)).select("a", "b", "e.*", cuts.alias("cuts"), along.alias("along"))


def _pairs(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """a and b of shapes whose boxes share a cell, with b's box."""
    box = lambda e, k: e.groupBy(k).agg(*[f(g(c + "1", c + "2")).alias(n + c) for c in "xy" for f, g, n in ((F.min, F.least, "low_"), (F.max, F.greatest, "high_"))])
    grid = lambda d: d.withColumn("gx", _cells(F.col("low_x"), F.col("high_x"), size)).withColumn("gy", _cells(F.col("low_y"), F.col("high_y"), size))
    return grid(box(a, "a")).select("a", "gx", "gy").join(grid(box(b, "b")), ["gx", "gy"]).drop("gx", "gy").dropDuplicates(["a", "b"])


def _inner(a: DataFrame, b: DataFrame, shared: bool, size: int) -> DataFrame:
    """a, b and the cross products of the stretches of a's border inside b. shared: with stretches
    that lie on b's border, where both shapes are on the same side."""
    box_cell = 10 * size
    in_box = [F.greatest(c + "1", c + "2") < F.col("low_" + c) for c in "xy"] + [F.least(c + "1", c + "2") > F.col("high_" + c) for c in "xy"]
    lines = a.join(_pairs(a, b, box_cell), "a").where(~(in_box[0] | in_box[1] | in_box[2] | in_box[3])).select("a", "b", *_EDGE)
    met = _meetings(a, b, size).groupBy("a", "b", *_EDGE).agg(F.flatten(F.collect_list("cuts")).alias("cuts"), F.collect_list("along").alias("along"))
    lines = lines.join(met, ["a", "b", *_EDGE], "left")
    at = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.coalesce("cuts", F.array().cast("array<double>")))))
    parts = lines.withColumn("at", at).withColumn("t", F.explode(F.zip_with(F.slice("at", F.lit(1), F.size("at") - 1), F.slice("at", F.lit(2), F.size("at") - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))))
    middle = (F.col("t.p") + F.col("t.q")) / 2
    on = F.get(F.filter("along", lambda s: (s["low"] <= middle) & (middle <= s["high"])), F.lit(0))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    x, y = (lambda t: F.col("x1") + t * dx), (lambda t: F.col("y1") + t * dy)
    product = (x(F.col("t.p")) * y(F.col("t.q")) - x(F.col("t.q")) * y(F.col("t.p"))) / float(GRID) ** 2
    parts = parts.select("a", "b", x(middle).alias("x"), y(middle).alias("y"), product.alias("product"), on["same"].alias("same"))
    border = parts.where(F.col("same")).groupBy("a", "b").agg(F.sum("product").alias("product")) if shared else None
    # even-odd rule, by the edges of b in the band of the stretch
    free = parts.where(F.col("same").isNull()).withColumn("band", F.floor(F.col("y") / size))
    bands = b.withColumn("band", _cells(F.least("y1", "y2"), F.greatest("y1", "y2"), size)).select("b", "band", *[F.col(c).alias("_" + c) for c in _EDGE])
    hit = ((F.col("_y1") > F.col("y")) != (F.col("_y2") > F.col("y"))) & (F.col("x") < F.col("_x1") + (F.col("y") - F.col("_y1")) * F.try_divide(F.col("_x2") - F.col("_x1"), F.col("_y2") - F.col("_y1")))
    crossed = free.join(bands, ["b", "band"]).groupBy("a", "b", "x", "y", "product").agg(F.count_if(hit).alias("n")).where(F.col("n") % 2 == 1)
    inside = crossed.groupBy("a", "b").agg(F.sum("product").alias("product"))
    return inside.unionByName(border) if shared else inside


def _boxes(shapes: DataFrame, key: str, size: int) -> DataFrame:
    """key, its edges as four arrays, the cells low_x to high_y that its box touches, and few: whether pairs of
    it are settled in batches."""
    sides = edges(shapes, key).groupBy(key).agg(F.collect_list(F.struct(*_EDGE)).alias("e"))
    cell = lambda end, c: F.floor(getattr(F, f"array_{end}")(F.concat(F.col(c + "1"), F.col(c + "2"))) / size)
    out = sides.select(key, *[F.col("e")[c].alias(c) for c in _EDGE])
    out = out.withColumns({f"{name}_{c}": cell(end, c) for c in "xy" for name, end in (("low", "min"), ("high", "max"))})
    cells = (F.col("high_x") - F.col("low_x") + 1) * (F.col("high_y") - F.col("low_y") + 1)
    return out.withColumn("few", (F.size("x1") <= FEW_EDGES) & (cells <= FEW_CELLS))


class _Strips:
    """The strips under the edges of a block's shapes, in degrees from the corner of a cell; upright edges have none."""

    def __init__(self, block: pa.Table, gx: int, gy: int, size: int):
        x1, y1, x2, y2 = ((np.asarray(block[c].combine_chunks().flatten()) - g * size) / GRID for c, g in zip(_EDGE, (gx, gy) * 2))
        owner = np.repeat(np.arange(len(block)), np.asarray(block["x1"].combine_chunks().value_lengths()))
        self.boxes = {c: np.asarray(block[c]) for c in ("low_x", "low_y")}
        self.ends = [f(np.concatenate(v), np.concatenate([owner, owner]), len(block)) for v in ((x1, x2), (y1, y2)) for f in (_least, _most)]
        lies = x1 != x2
        x1, y1, x2, y2, owner = (v[lies] for v in (x1, y1, x2, y2, owner))
        back = x2 < x1
        self.left, self.right, self.height = np.where(back, x2, x1), np.where(back, x1, x2), np.where(back, y2, y1)
        self.slope, self.sign = (y2 - y1) / (x2 - x1), np.where(back, 1.0, -1.0)
        self.n = np.bincount(owner, minlength=len(block))
        self.first = np.cumsum(self.n) - self.n

    def of(self, shapes: np.ndarray, wide: int) -> list[np.ndarray]:
        """left, right, height, slope and sign of the shapes' edges, wide of them each (sign 0 where there are fewer)."""
        step = np.arange(wide)
        there = step < self.n[shapes, None]
        at = np.where(there, self.first[shapes, None] + step, 0)
        return [self.left[at], self.right[at], self.height[at], self.slope[at], np.where(there, self.sign[at], 0.0)]


def _least(v: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, np.inf)
    np.minimum.at(out, owner, v)
    return out


def _most(v: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return -_least(-v, owner, n)


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Areas that pairs of shapes share, from their strips: pairs x edges each."""
    left_a, right_a, height_a, slope_a, sign_a = (v[:, :, None] for v in a)
    left_b, right_b, height_b, slope_b, sign_b = (v[:, None, :] for v in b)
    left = np.maximum(left_a, left_b)
    wide = np.maximum(np.minimum(right_a, right_b) - left, 0.0)
    ya, yb = height_a + slope_a * (left - left_a), height_b + slope_b * (left - left_b)
    d1 = ya - yb
    d2 = d1 + (slope_a - slope_b) * wide
    p, q = np.abs(d1), np.abs(d2)
    apart = np.where(d1 * d2 < 0, (d1 * d1 + d2 * d2) / np.maximum(p + q, 1e-300), p + q)
    under = wide * ((ya + yb) / 2 + (slope_a + slope_b) * wide / 4 - apart / 4)
    return (under * sign_a * sign_b).sum(axis=(1, 2))


def _batches(size: int, ordered: bool) -> Callable:
    """Overlaps of the pairs of two blocks whose first common cell is this one."""

    def run(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(group))
        gx, gy = key[0].as_py(), key[1].as_py()
        mine = np.asarray(whole["side"])
        one, two = whole.filter(pa.array(mine == 0)), whole.filter(pa.array(mine == 1))
        if not len(one) or not len(two):
            return
        a, b = _Strips(one, gx, gy, size), _Strips(two, gx, gy, size)
        id_a, id_b = (t[c].combine_chunks() for t, c in ((one, "a"), (two, "b")))
        val_a, val_b = (v.to_numpy(zero_copy_only=False) for v in (id_a, id_b))
        for start in range(0, len(one), 256):
            rows = slice(start, start + 256)
            meet = (a.ends[0][rows, None] < b.ends[1]) & (b.ends[0] < a.ends[1][rows, None]) & (a.ends[2][rows, None] < b.ends[3]) & (b.ends[2] < a.ends[3][rows, None])
            meet &= (np.maximum(a.boxes["low_x"][rows, None], b.boxes["low_x"]) == gx) & (np.maximum(a.boxes["low_y"][rows, None], b.boxes["low_y"]) == gy)
            if ordered:
                meet &= val_a[rows, None] < val_b
            i, j = np.nonzero(meet)
            i += start
            area = np.zeros(len(i))
            # pairs of shapes with about as many edges go together
            kinds = np.ceil(np.log2(np.maximum(a.n[i], 1))) * 16 + np.ceil(np.log2(np.maximum(b.n[j], 1)))
            for kind in np.unique(kinds):
                same = np.flatnonzero(kinds == kind)
                wide_a, wide_b = int(a.n[i[same]].max()), int(b.n[j[same]].max())
                for part in np.array_split(same, max(1, len(same) * wide_a * wide_b // AT_ONCE)):
                    area[part] = _common(a.of(i[part], wide_a), b.of(j[part], wide_b))
            there = area > 1e-12
            yield pa.RecordBatch.from_arrays([id_a.take(pa.array(i[there])), id_b.take(pa.array(j[there])), pa.array(area[there])], ["a", "b", "overlap"])

    return run


def _in_batches(a: DataFrame, b: DataFrame, size: int, ordered: bool) -> DataFrame:
    """a, b and overlap of shapes with few edges. a, b: as from _boxes."""
    cells = lambda d: d.withColumn("gx", F.explode(F.sequence("low_x", "high_x"))).withColumn("gy", F.explode(F.sequence("low_y", "high_y")))
    blocks = lambda d, n: cells(d).groupBy("gx", "gy").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(n))
    both = blocks(a, "_na").join(blocks(b, "_nb"), ["gx", "gy"])

    def dealt(d: DataFrame, key: str, own: str, other: str, side: int) -> DataFrame:
        met = cells(d).join(both, ["gx", "gy"])
        place, every = F.pmod(F.xxhash64(key), F.col("_n" + key)), F.sequence(F.lit(0).cast("long"), F.col("_n" + ("b" if key == "a" else "a")) - 1)
        met = met.withColumn(own, place).withColumn(other, F.explode(every))
        ids = [F.col(k) if k == key else F.lit(None).cast((b if k == "b" else a).schema[k].dataType).alias(k) for k in ("a", "b")]
        return met.select("gx", "gy", "p", "q", F.lit(side).alias("side"), *ids, *_EDGE, "low_x", "low_y")

    rows = dealt(a, "a", "p", "q", 0).unionByName(dealt(b, "b", "q", "p", 1))
    # a number of its own: partitions are merged by their bytes, and these few bytes are much work
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "gx", "gy", "p", "q")
    kinds = {"a": a.schema["a"].dataType.simpleString(), "b": b.schema["b"].dataType.simpleString()}
    return rows.groupBy("gx", "gy", "p", "q").applyInArrow(_batches(size, ordered), f"a {kinds['a']}, b {kinds['b']}, overlap double")


def _by_edges(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """a, b and overlap from their edges, which are spread over tasks."""
    turned = _inner(b.withColumnRenamed("b", "a"), a.withColumnRenamed("a", "b"), False, size).select(F.col("b").alias("a"), F.col("a").alias("b"), "product")
    found = _inner(a, b, True, size).unionByName(turned).groupBy("a", "b").agg((F.sum("product") / 2).alias("overlap"))
    return found.where(F.col("overlap") > 1e-12)


def overlaps(units: DataFrame, parents: DataFrame, key: str = "unit_idx", parent: str = "parent_idx", cell: float = 0.25, ordered: bool = False) -> DataFrame:
    """key, parent and overlap (square degrees) of all shapes that share an area.

    units: key, polygons; parents: parent, polygons. Shapes must be valid: rings don't cross.
    cell: degrees of the grid on which edges meet, some times the length of an edge. ordered: only pairs
    in which key is less than parent.
    """
    size = int(cell * GRID)
    boxes = [_boxes(d.withColumnRenamed(k, n), n, 2 * size) for d, k, n in ((units, key, "a"), (parents, parent, "b"))]
    few = [d.where("few") for d in boxes]
    out = _in_batches(*few, 2 * size, ordered)
    many = [d.where("NOT few") for d in boxes]
    one = lambda d, k: d.select(k, F.explode(F.arrays_zip(*_EDGE)).alias("e")).select(k, "e.*")
    for left, right in ((many[0], boxes[1]), (few[0], many[1])):
        if (many[0] if left is many[0] else many[1]).limit(1).count():
            found = _by_edges(one(left, "a"), one(right, "b"), size)
            out = out.unionByName(found.where(F.col("a") < F.col("b")) if ordered else found)
    return out.select(F.col("a").alias(key), F.col("b").alias(parent), "overlap")


def overlap_parent(units: DataFrame, parents: DataFrame, cell: float = 0.25) -> DataFrame:
    """unit_idx with the parent that most of its area is in (the first on ties, null if none):
    parent_idx and overlap. units: unit_idx, polygons; parents: parent_idx, polygons."""
    # areas equal to a millionth of a square metre or so are a tie
    best = overlaps(units, parents, cell=cell).groupBy("unit_idx").agg(F.max_by(F.struct("parent_idx", "overlap"), F.struct(F.round("overlap", 12), -F.col("parent_idx"))).alias("_best"))
    return units.select("unit_idx").join(best, "unit_idx", "left").select("unit_idx", "_best.parent_idx", "_best.overlap")
