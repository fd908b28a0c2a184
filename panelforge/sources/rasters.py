"""Rasters as a data source: files of daily bands, one partition a file, bands read only where wanted.

A file is a line of JSON (satellite, tile, first and last day, width, height, where each band begins) and
the bands after it, compressed one by one. Filters on satellite, tile and day go to the source: files
whose header doesn't match have no partition, and of the others only the bands of wanted days are
read. A file with another number of bands than days is refused as a whole: which day a band is of
would be a guess.

    spark.dataSource.register(RasterSource)
    spark.read.format("rasters").load(folder)
"""

from __future__ import annotations

import datetime as dt
import json
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "sat string, tile int, date date, width int, height int, pixels binary"
_ARROW = pa.schema([("sat", pa.string()), ("tile", pa.int32()), ("date", pa.date32()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())])
SUFFIX = ".bands"


def write_file(path: str, sat: str, tile: int, first: dt.date, bands: list[bytes], width: int, last: dt.date | None = None) -> None:
    """One file; last is by default the day of the last band."""
    packed = [zlib.compress(b) for b in bands]
    at = [sum(map(len, packed[:k])) for k in range(len(packed) + 1)]
    last = last or first + dt.timedelta(days=len(bands) - 1)
    header = {"sat": sat, "tile": tile, "first": first.isoformat(), "last": last.isoformat(), "width": width, "height": len(bands[0]) // width if bands else 0, "at": at}
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_output_stream(inner, compression=None) as out:
        out.write(json.dumps(header).encode() + b"\n")
        out.write(b"".join(packed))


@dataclass
class FilePart(InputPartition):
    """A file, and the places of the bands that are wanted."""

    path: str
    base: int
    header: dict
    bands: list[int]

    def __post_init__(self) -> None:
        super().__init__(self.path)


class RasterReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.tests = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of sat, tile and date with values; the rest stays with Spark."""
        compare = {EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, In: lambda x, v: x in v}
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if type(f) in compare and name in ("sat", "tile", "date"):
                self.tests.append((name, compare[type(f)], f.value))
            else:
                yield f

    def _wanted(self, header: dict) -> list[int]:
        first, last = (dt.date.fromisoformat(header[k]) for k in ("first", "last"))
        if (last - first).days + 1 != len(header["at"]) - 1:
            return []
        if not all(test(header[name], value) for name, test, value in self.tests if name != "date"):
            return []
        days = [test for test in self.tests if test[0] == "date"]
        return [k for k in range(len(header["at"]) - 1) if all(test(first + dt.timedelta(days=k), value) for _, test, value in days)]

    def partitions(self) -> list[FilePart]:
        system, inner = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        parts = []
        for info in sorted(system.get_file_info(fs.FileSelector(inner, recursive=True)), key=lambda i: i.path):
            if info.is_file and info.path.endswith(SUFFIX):
                with system.open_input_file(info.path) as f:
                    line = b""
                    while not line.endswith(b"\n"):
                        more = f.read(4096)
                        if not more:
                            break
                        end = more.find(b"\n")
                        line += more if end < 0 else more[: end + 1]
                header = json.loads(line)
                bands = self._wanted(header)
                if bands:
                    parts.append(FilePart(info.path, len(line), header, bands))
        return parts

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, FilePart):  # no file matches
            return
        h, system = partition.header, (fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem())
        first = dt.date.fromisoformat(h["first"])
        with system.open_input_file(partition.path) as f:
            for k in partition.bands:
                f.seek(partition.base + h["at"][k])
                pixels = zlib.decompress(f.read(h["at"][k + 1] - h["at"][k]))
                if len(pixels) != h["width"] * h["height"]:
                    raise ValueError(f"{partition.path}: band {k} has {len(pixels)} pixels")
                row = {"sat": [h["sat"]], "tile": [h["tile"]], "date": [first + dt.timedelta(days=k)], "width": [h["width"]], "height": [h["height"]], "pixels": [pixels]}
                yield pa.RecordBatch.from_pydict(row, schema=_ARROW)


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rasters"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known, with filters that go to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)
