"""Passes as keyed state: a sensor's granules wait until their order is certain, then join a pass.

The watermark settles the order: no granule may come that starts before it. Granules that start
earlier leave the waiting ones in order of start, end and id, and either go on with the open pass
of their sensor or close it. A pass is also closed once the watermark is more than the gap after
its last end, as no later granule can belong to it. A sensor's state is thus the granules of the
allowed delay and one open pass, whatever the length of the feed, and the passes are those that a
run over the whole feed finds, however it is split into batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COLUMNS = ["s", "seconds", "night", "n_granules", "units"]


class PassProcessor(StatefulProcessor):
    """Times are microseconds. waiting: (start, end, id) to night and units, so a granule that comes
    again is there once; open: start, end and night of the first granule, end of the last one,
    number of granules, units."""

    def __init__(self, gap_minutes: float):
        self.gap = int(gap_minutes * 60_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "start long, end long, id long", "night boolean, units array<int>")
        self.open = handle.getValueState("open", "start long, end long, night boolean, last long, n long, units array<int>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for r in batch.itertuples(index=False):
                self.waiting.updateValue((int(r.begins), int(r.ends), int(r.id)), (bool(r.night), [int(u) for u in r.units]))
                self.handle.registerTimer(int(r.begins) // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        found = []
        at = tuple(self.open.get()) if self.open.exists() else None
        ready = sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator() if k[0] < now)
        for (start, end, number), (night, units) in ready:
            self.waiting.removeKey((start, end, number))
            if at is not None and start - at[3] <= self.gap:
                at = (*at[:3], end, at[4] + 1, sorted({*at[5], *units}))
            else:
                found += [at] if at is not None else []
                at = (start, end, night, end, 1, sorted(set(units)))
        if at is not None and now - at[3] > self.gap:
            found.append(at)
            at = None
        if at is None:
            self.open.clear()
        else:
            self.open.update(at)
            self.handle.registerTimer((at[3] + self.gap) // 1000 + 1)
        if found:
            yield pd.DataFrame([(key[0], (f[0] // 1_000_000 + (f[1] // 1_000_000 - f[0] // 1_000_000) // 2) // 60 * 60, f[2], f[4], f[5]) for f in found], columns=_COLUMNS)

    def close(self) -> None:
        pass


def passes(granules: DataFrame, gap_minutes: float, late: str = "1 day") -> DataFrame:
    """s, t, night, n_granules, units of each pass, once it is closed. granules: a stream of id, s,
    start, end, night, units that are at most `late` behind the latest start."""
    granules.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    rows = granules.withWatermark("start", late).select("id", "s", "start", F.unix_micros("start").alias("begins"), F.unix_micros("end").alias("ends"), "night", F.coalesce("units", F.array().cast("array<int>")).alias("units"))
    found = rows.groupBy("s").transformWithStateInPandas(
        statefulProcessor=PassProcessor(gap_minutes), outputStructType="s string, seconds long, night boolean, n_granules long, units array<int>", outputMode="Append", timeMode="EventTime"
    )
    return found.select("s", F.timestamp_seconds("seconds").alias("t"), "night", "n_granules", "units")


def start(granules: DataFrame, path: str, checkpoint: str, gap_minutes: float, late: str = "1 day", once: bool = True):
    """Appends closed passes to a table; a batch that runs again after a failure writes it once."""
    writer = passes(granules, gap_minutes, late).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
