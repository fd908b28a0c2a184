"""Cases that only larger or odd tables show."""

import datetime as dt
import math
import os
import random
from itertools import groupby

from helpers import rows_of, sql_rows
from pyspark.sql import functions as F

from panelforge.operators import dedupe, graph, overlay, schemas, simplify
from panelforge.plans import catalogue, geometry_queries, panel_queries


def changed_tables(duck, data, folder, **tables):
    """A folder with the given tables replaced by the results of SQL, and a connection that reads it."""
    other = duck.cursor()
    other.execute("CREATE SCHEMA IF NOT EXISTS changed; USE changed")
    for name in sorted(os.listdir(data)):
        table = name.removesuffix(".parquet")
        if table in tables:
            duck.execute(f"COPY ({tables[table]}) TO '{folder}/{name}' (FORMAT parquet)")
        else:
            os.symlink(f"{data}/{name}", f"{folder}/{name}")
        other.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{folder}/{name}'")
    return other


def test_coverage_half_way_between_two_steps(spark, duck, data, tmp_path):
    """A cover of 0.5045 is a little less than half way, and becomes 50.4."""
    other = changed_tables(duck, data, str(tmp_path), lineitem="SELECT * REPLACE (1.0 AS l_quantity, 0.04955 AS l_discount) FROM lineitem")
    got = rows_of(catalogue.QUERIES["export_eligible"](spark, str(tmp_path)))
    assert got == sql_rows(other, catalogue.ORACLE_SQL["export_eligible"])
    assert {50.4} == {r["coverage"] for r in catalogue.QUERIES["export_eligible"](spark, str(tmp_path)).collect()}


def test_pairs_of_shapes_in_blocks_and_by_edges(spark, monkeypatch):
    """Crowded cells are dealt into blocks, large shapes go by edges; all ways find the same pairs, each once."""
    shapes = geometry_queries.districts(spark, "/root/testdata/sf0.01")
    found = {}
    for name, few, block in (("blocks", 256, 3), ("whole", 256, 2000), ("mixed", 10, 2000), ("edges", 0, 2000)):
        monkeypatch.setattr(overlay, "FEW_EDGES", few)
        monkeypatch.setattr(overlay, "BLOCK", block)
        rows = overlay.overlaps(shapes, shapes.withColumnRenamed("unit_idx", "other"), parent="other", ordered=True).collect()
        found[name] = {(r["unit_idx"], r["other"]): r["overlap"] for r in rows}
        assert len(rows) == len(found[name]) and all(a < b for a, b in found[name])
    assert len(found["whole"]) > 80
    for name, pairs in found.items():
        assert pairs.keys() == found["whole"].keys(), name
        assert all(abs(v - found["whole"][k]) < 1e-9 for k, v in pairs.items())


def test_tables_of_nodes_are_not_broadcast(spark):
    """Neither the rounds of components nor the joins with rows send a table of nodes through the driver."""
    plans = []

    def store(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.checkpoint()

    graph.components(spark.range(20).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), store)
    points = spark.range(2000).select("id", F.lit("N").alias("s"), F.lit("2020-02-01 07:30:00").cast("timestamp").alias("t"), (20 + F.col("id") % 50 * 0.001).alias("lat"), (90 + F.col("id") % 40 * 0.001).alias("lon"), F.lit(1.0).alias("frp"))
    plans.append(dedupe.proximity(points)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 3 and any("SortMergeJoin" in p for p in plans)
    assert not any("BroadcastExchange" in p for p in plans)


def test_bridges_read_the_tables_once(spark):
    """Cells that all bridges and links read are stored: no file of the tables is in the plan of what follows."""
    cells, models = panel_queries._bridges(spark, "/root/testdata/sf0.01")
    assert not cells.inputFiles() and not models.inputFiles()
    assert cells.count() > 1000 and models.select("bridge").distinct().count() == 4


def test_schemas_ask_single_values_only_for_their_kind(spark):
    """Containers aren't read whole at each depth, and a kind that differs still is the first violation."""
    node = schemas.fields({"cells": schemas.items(schemas.fields({"d": schemas.number(0)}), 1)})
    texts = ['{"cells":[{"d":1},{"d":-1}]}', '{"cells":[null]}', '{"cells":null}', '{"cells":{"d":1}}', '[1]', 'null', '{"cells":[{"d":1}]}', '{"cells":[{"d":"1"}]}']
    df = schemas.violations(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, value string"), node)
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "").count("schemaofvariant") <= 2  # a call is printed twice
    got = [r["violation"] for r in df.orderBy("k").collect()]
    assert got == ["cells/1/d: below 0", "cells/0: not an object", "cells: not an array", "cells: not an array", ": not an object", ": not an object", None, "cells/0/d: not a number"]


def test_borders_are_dealt_by_their_points(spark, tmp_path, monkeypatch):
    """Parcels of one file go to as many tasks as their points need, with the same borders, also where zeros differ in sign."""
    spark.range(160).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    borders = lambda shapes: sorted((r["unit_idx"], r["polygons"]) for r in simplify.simplified(shapes, least=4e-6).collect())
    whole = borders(geometry_queries.land_parcels(spark, str(tmp_path)))
    monkeypatch.setattr(simplify, "TASK_POINTS", 400, raising=False)
    parcels = geometry_queries.land_parcels(spark, str(tmp_path))
    assert len(whole) == 160 and borders(parcels) == whole
    # 160 parcels of 33 points each, 400 a task on average
    assert simplify.arcs(parcels.coalesce(1), "unit_idx").rdd.getNumPartitions() == 14
    assert "hashpartitioning" in (plan := simplify.simplified(parcels)._jdf.queryExecution().executedPlan().toString())
    assert "Broadcast" not in plan and not [x for x in plan.splitlines() if "hashpartitioning" in x and ", 14)" not in x]
    box = lambda w, o, zero: [[[(w, zero), (o, zero), (o, 1.0), (w, 1.0), (w, zero)]]]
    below = [[[(0.0, -1.0), (2.0, -1.0), (2.0, 0.0), (1.0, 0.0), (0.0, 0.0), (0.0, -1.0)]]]
    schema = "unit_idx long, polygons array<array<array<struct<x: double, y: double>>>>"
    cut = [simplify.arcs(spark.createDataFrame([(0, box(0.0, 1.0, z)), (1, box(1.0, 2.0, z)), (2, below)], schema), "unit_idx").count() for z in (0.0, -0.0)]
    assert cut == [9, 9]


def test_close_pairs_meet_by_places(spark, monkeypatch):
    """Crowded places are cut into blocks, no pair is lost or twice, and all pairs of an a follow one another."""
    monkeypatch.setattr(dedupe, "BLOCK", 4, raising=False)
    places = [(20.0 + k % 7 * 0.0009, 90.0 - k % 5 * 0.0011) for k in range(35)] + [(-0.0, 0.0), (0.0, -0.0), (None, 1.0), (float("nan"), 1.0)]
    points = [(i, "NT"[i % 2], places[i * 11 % 39] if i % 3 else places[i % 2 * 35]) for i in range(240)]
    rows = spark.createDataFrame([(i, s, *at) for i, s, at in points], "id long, s string, lat double, lon double").withColumn("t", F.lit("2020-02-01 07:30:00").cast("timestamp"))
    xy = {i: (lon * 111.32 * math.cos(math.radians(lat)), lat * 111.32) for i, _, (lat, lon) in points if lat is not None}
    wanted = [(a, b) for a, s, _ in points for b, z, _ in points if a < b and s == z and a in xy and b in xy and math.dist(xy[a], xy[b]) <= 0.2]
    got = dedupe.close_pairs(rows, 0.2).select(F.spark_partition_id(), "a", "b").collect()
    assert sorted((a, b) for _, a, b in got) == wanted and len(wanted) > 2000
    assert len([a for a, _ in groupby(a for _, a, _ in got)]) == len({a for a, _ in wanted})


def test_rounds_of_components_do_not_pile_up(spark):
    """A round hands on a table of known size, not the product that a join is taken to have: its digits would double each round."""
    place = random.Random(5).sample(range(150), 150)
    found = graph.components(spark.createDataFrame(list(zip(place, place[1:], strict=False)), "a long, b long"))
    assert found.select("root").distinct().collect() == [(0,)]
    leaves = found._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert max(leaves.apply(k).stats().sizeInBytes() for k in range(leaves.size())) < 1 << 60


def test_components_of_parts(spark):
    """Parts and batches cut components anywhere; nodes that several of them share tie them together again."""
    rng = random.Random(3)
    edges = [(k, k + rng.choice([1, 1, 2, 7]), k // 50) for k in range(600) if k % 45] + [(900, 901, p) for p in range(5)] + [(901, 850, 9)]
    rng.shuffle(edges)
    root = {n: n for a, b, _ in edges for n in (a, b)}
    for _ in range(600):
        for a, b, _ in edges:
            root[a] = root[b] = min(root[a], root[b])
    table = spark.createDataFrame(edges, "a long, b long, part int")
    for batch in (1, 40, 1 << 20):
        got = graph.parted_components(table.coalesce(1), batch).collect()
        assert len(got) == len(root) and {r["node"]: r["root"] for r in got} == root
    assert graph.parted_components(table.where("a < 0")).collect() == []


def test_proximity_over_tiles_and_gaps(spark, monkeypatch):
    """A chain over many tiles is one group; rows that lack a place, sensor or time are alone."""
    monkeypatch.setattr(dedupe, "TILE", 2, raising=False)
    t = dt.datetime(2024, 1, 1)
    points = [(k, "N", t, 24.0 + 0.001 * (k % 60), 90.0 + 0.0005 * (k % 60), float(k % 7)) for k in range(150)]
    points += [(200, None, t, 24.0, 90.0, 1.0), (201, None, t, 24.0, 90.0, 1.0), (202, "N", None, 24.0, 90.0, 1.0), (203, "N", t, None, 90.0, 9.0), (204, "N", t, 10.0, 90.0, None), (205, "N", t, 10.0, 90.0, None)]
    got = dedupe.proximity(spark.createDataFrame(points, "id long, s string, t timestamp, lat double, lon double, frp double"))
    assert got.columns == ["id", "s", "t", "lat", "lon", "frp", "group_root", "group_size"]
    assert {(r["id"], r["group_root"], r["group_size"]) for r in got.collect()} == {(6, 0, 150), (200, 200, 1), (201, 201, 1), (202, 202, 1), (203, 203, 1), (204, 204, 2)}


def test_pairs_of_a_crowded_cell_are_dealt(spark, monkeypatch):
    """Points of one cell go to several tasks, each pair is found once, and cells with few points aren't dealt."""
    monkeypatch.setattr(dedupe, "SLICE", 40, raising=False)
    known = lambda value: F.when(F.col("id") >= 0, value)
    spread = spark.range(330).select("id", known("N").alias("s"), known(F.lit("2020-02-01 07:30:00").cast("timestamp")).alias("t"), (24.0 + F.when(F.col("id") < 300, F.col("id") % 5 * 0.0001).otherwise(F.col("id") * 0.01)).alias("lat"), F.lit(90.0).alias("lon"))
    got = dedupe.close_pairs(spread, 0.2).select("a", "b", F.spark_partition_id().alias("at")).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(a, b) for a in range(300) for b in range(a + 1, 300)]
    assert len({r["at"] for r in got}) > 2
