"""Keyed passes, versioned tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import passes, spatial, versions
from panelforge.sources import rasters
from panelforge.streaming import keyed_passes

GRANULE = "id long, s string, start timestamp, end timestamp, night boolean, units array<int>"


@pytest.mark.parametrize("batches", [1, 6])
def test_keyed_passes_equal_passes_of_the_whole_feed(spark, tmp_path, batches):
    rng = np.random.default_rng(batches)
    begin, rows = dt.datetime(2024, 1, 1), []
    for k in range(240):
        start = begin + dt.timedelta(seconds=int(rng.integers(0, 5 * 86_400)))
        rows.append((k, "AB"[k % 2], start, start + dt.timedelta(seconds=int(rng.integers(0, 5400))), bool(k % 3), [k % 5, k % 7]))
    # nearly in order of arrival: late by up to ten hours, and some come twice
    arrive = sorted(rows, key=lambda r: (r[2] + dt.timedelta(hours=float(rng.uniform(0, 10))), r[0]))
    arrive += [arrive[-3]]
    parts = [list(p) for p in np.array_split(np.arange(len(arrive)), batches)]
    parts[-1] += [int(parts[-1][0])]
    last = begin + dt.timedelta(days=30)
    schema = GRANULE
    for k, part in enumerate([[arrive[i] for i in p] for p in parts] + [[(1000, "Z", last, last, False, [])]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        keyed_passes.start(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 20, late="12 hours").awaitTermination(240)
    got = sorted((r["s"], r["t"], r["night"], r["n_granules"], r["units"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((r["s"], r["t"], r["night"], r["n_granules"], r["units"]) for r in passes.sessions(spark.createDataFrame(rows, schema), 20).collect())
    assert got == want


ROWS = "date date, s int, id long, frp double"


def _table(spark, tmp_path):
    return versions.VersionedTable(spark, str(tmp_path / "t"), ROWS, ["date", "s"])


def _ids(table):
    return sorted((r["date"].day, r["s"], r["id"]) for r in table.read().collect())


def test_final_rows_replace_provisional_ones_in_streams(spark, tmp_path):
    table = _table(spark, tmp_path)
    day = lambda k: dt.date(2024, 5, k)
    feeds = {"nrt": [(day(1), 0, 1, 1.0), (day(1), 1, 2, 1.0), (day(2), 0, 3, 1.0)], "sp": [(day(1), 0, 11, 1.0), (day(1), 0, 12, 1.0)]}
    for name, rank in (("nrt", versions.PROVISIONAL), ("sp", versions.FINAL)):
        spark.createDataFrame(feeds[name], ROWS).write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema(ROWS).parquet(str(tmp_path / name))
        versions.start_replacing(stream, table, str(tmp_path / f"cp-{name}"), name, rank).awaitTermination(120)
    assert _ids(table) == [(1, 0, 11), (1, 0, 12), (1, 1, 2), (2, 0, 3)]
    # provisional rows that come later don't replace final ones, and a day of another sensor is new
    table.commit(spark.createDataFrame([(day(1), 0, 21, 1.0), (day(1), 1, 22, 1.0)], ROWS), "late", versions.PROVISIONAL)
    assert _ids(table) == [(1, 0, 11), (1, 0, 12), (1, 1, 22), (2, 0, 3)]
    assert sorted((r["date"].day, r["id"]) for r in table.read(1).collect()) == [(1, 1), (1, 2), (2, 3)]
    assert {r["_batch"] for r in table.done().collect()} == {"nrt-0", "sp-0", "late"} and table.vacuum() == []
    table.commit(spark.createDataFrame([(day(2), 0, 31, 1.0), (day(1), 1, 32, 1.0)], ROWS), "all", versions.FINAL)
    assert table.vacuum() == ["late", "nrt-0"] and _ids(table) == [(1, 0, 11), (1, 0, 12), (1, 1, 32), (2, 0, 31)]


def test_a_write_that_stops_before_its_manifest_is_never_seen(spark, tmp_path, monkeypatch):
    table = _table(spark, tmp_path)
    rows = lambda k: spark.createDataFrame([(dt.date(2024, 5, 1), 0, k, 1.0)], ROWS)
    table.commit(rows(1), "a")
    with monkeypatch.context() as m:
        m.setattr(versions.VersionedTable, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.commit(rows(2), "b")
    assert _ids(table) == [(1, 0, 1)] and table.done().count() == 1
    assert table.commit(rows(2), "b") == 2 and table.commit(rows(9), "b") == 2 and _ids(table) == [(1, 0, 2)]
    # another writer publishes the next version in between: both are kept in order
    publish, other = versions.VersionedTable._publish, _table(spark, tmp_path)

    def late(self, entries, version):
        monkeypatch.setattr(versions.VersionedTable, "_publish", publish)
        other.commit(rows(3), "c")
        return publish(self, entries, version)

    monkeypatch.setattr(versions.VersionedTable, "_publish", late)
    assert table.commit(rows(4), "d") == 4 and _ids(table) == [(1, 0, 4)]


def test_a_stage_goes_on_where_it_stopped(spark, tmp_path):
    table = versions.VersionedTable(spark, str(tmp_path / "t"), "item long, twice long", ["item"])
    items, seen = spark.range(10).withColumnRenamed("id", "item"), []

    def work(rows):
        seen.append(rows.count())
        if len(seen) == 2:
            raise OSError("lost")
        return rows.select("item", (F.col("item") * 2).alias("twice"))

    with pytest.raises(OSError):
        versions.run_stage(items, table, "item", work, at_once=4)
    assert table.read().count() == 4
    assert versions.run_stage(items, table, "item", work, at_once=4) == 2 and seen == [4, 4, 4, 2]
    assert sorted((r["item"], r["twice"]) for r in table.read().collect()) == [(k, 2 * k) for k in range(10)]
    assert versions.run_stage(items, table, "item", work, at_once=4) == 0


def test_rasters_read_wanted_bands_only(spark, tmp_path):
    rng = np.random.default_rng(9)
    bands = {}
    for sat, tile, first in (("MOD", 2606, 1), ("MOD", 2506, 1), ("MYD", 2606, 9)):
        days = [dt.date(2024, 3, first + k) for k in range(8)]
        for day in days:
            bands[sat, tile, day] = rng.integers(0, 10, 12, dtype=np.uint8).tobytes()
        rasters.write_file(str(tmp_path / sat / f"{tile}.bands") if (tmp_path / sat).mkdir(exist_ok=True) is None else "", sat, tile, days[0], [bands[sat, tile, d] for d in days], 4)
    # a file whose bands don't fit its days is refused, others aren't read as rasters
    rasters.write_file(str(tmp_path / "MYD" / "wrong.bands"), "MYD", 2506, dt.date(2024, 3, 9), [b"\0" * 12] * 7, 4, last=dt.date(2024, 3, 16))
    (tmp_path / "MYD" / "notes.txt").write_text("none")
    rasters.register(spark)
    whole = spark.read.format("rasters").load(str(tmp_path))
    assert {(r["sat"], r["tile"], r["date"]): r["pixels"] for r in whole.collect()} == {k: bytearray(v) for k, v in bands.items()}
    some = whole.where("sat = 'MOD' AND tile IN (2606, 2607) AND date >= DATE '2024-03-05' AND date < DATE '2024-03-07' AND length(pixels) > 3")
    plan = some._jdf.queryExecution().executedPlan().toString()
    # only what the source can't judge is left to Spark
    assert "2606" not in plan.split("BatchScan")[0] and "length" in plan and some.rdd.getNumPartitions() == 1
    assert sorted(r["date"].day for r in some.collect()) == [5, 6]
    reader = rasters.RasterReader(str(tmp_path))
    rest = list(reader.pushFilters([rasters.EqualTo(("sat",), "MOD"), rasters.GreaterThan(("date",), dt.date(2024, 3, 7)), rasters.GreaterThan(("width",), 3)]))
    assert [p.bands for p in reader.partitions()] == [[7], [7]] and len(rest) == 1
    assert whole.where("sat = 'none'").count() == 0
    grids = spark.createDataFrame([(2606, np.array([0] * 6 + [1] * 4 + [-1] * 2, "<i2").tobytes(), bytes([1] * 11 + [0]))], "tile int, unit binary, land binary")
    got = {(r["sat"], r["date"], r["unit"]): (r["clear"], r["cloud"], r["land"]) for r in spatial.raster_counts(whole.select("sat", "tile", "date", "pixels"), grids).collect()}
    assert len(got) == 32 and all(got[s, d, 0] == (sum(p in (5, 7, 8, 9) for p in v[:6]), sum(p == 4 for p in v[:6]), 6) for (s, t, d), v in bands.items() if t == 2606)
