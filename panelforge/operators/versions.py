"""Tables whose parts are replaced as a whole: data first, then a manifest that readers resolve.

A write puts its rows into a folder of its own below data/, which no reader looks at yet, and then
publishes the next manifest by a rename that fails if another writer was first. A manifest lists, for
each key (a day and sensor, say), the batch that holds its rows and that batch's rank, and all
batches that were ever done. Readers join the data with the newest manifest, so they see all of a
write or nothing, and a stage that stopped half-way leaves the table as it was. Data and key columns
are partition columns: the join prunes files that the manifest doesn't name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import numbered


class ConflictError(RuntimeError):
    """Another writer published first, more often than a commit tries again."""


class VersionedTable:
    """schema: of the rows, with the keys. keys: columns whose values are replaced together."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        kinds = {f.name: f.dataType for f in self.schema.fields}
        self.entry = T.StructType([T.StructField("_batch", T.StringType()), T.StructField("rank", T.IntegerType()), *[T.StructField(k, kinds[k]) for k in keys]])

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """Number of the newest manifest, 0 before the first."""
        fs, folder = self._fs(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n[1:]) for n in names if n.startswith("v")), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """_batch, rank and keys of all current parts; with null rank and keys: batches that are done."""
        n = self.version() if version is None else version
        if not n:
            return self.spark.createDataFrame([], self.entry)
        return self.spark.read.schema(self.entry).parquet(f"{self.path}/manifest/v{n}")

    def done(self) -> DataFrame:
        """Batches that are part of the table, or were until others replaced them."""
        return self.manifest().where(F.col("rank").isNull()).select("_batch")

    def read(self, version: int | None = None) -> DataFrame:
        current = self.manifest(version).where(F.col("rank").isNotNull()).drop("rank")
        fs, folder = self._fs(f"{self.path}/data")
        if not fs.exists(folder):
            return self.spark.createDataFrame([], self.schema)
        stored = T.StructType([*self.schema.fields, T.StructField("_batch", T.StringType())])
        rows = self.spark.read.schema(stored).parquet(f"{self.path}/data")
        for k in self.keys:
            rows = rows.withColumn(f"_{k}", F.col(k))
        same = [F.col(f"_{k}").eqNullSafe(current[k]) for k in self.keys]
        return rows.join(current.withColumnRenamed("_batch", "_of"), [F.col("_batch") == F.col("_of"), *same]).select(*[rows[f.name] for f in self.schema.fields])

    def commit(self, rows: DataFrame, batch: str | None = None, rank: int = 0, tries: int = 5) -> int:
        """Replaces all keys that rows have, but those whose rows are of a higher rank; returns the
        version that has them. A batch that is done already isn't written again."""
        batch = batch or uuid.uuid4().hex
        if self.done().where(F.col("_batch") == batch).limit(1).count():
            return self.version()
        folder = f"{self.path}/data/_batch={batch}"
        rows.select(*self.schema.names).write.mode("overwrite").partitionBy(*self.keys).parquet(folder)
        stored = self.spark.read.schema(self.schema).parquet(folder) if self._any(folder) else self.spark.createDataFrame([], self.schema)
        new = stored.select(F.lit(batch).alias("_batch"), F.lit(rank).alias("rank"), *self.keys).distinct()
        for _ in range(tries):
            before = self.version()
            if self._publish(self._merged(self.manifest(before), new, batch), before + 1):
                return before + 1
        raise ConflictError(f"{self.path}: {tries} other commits were first")

    def _any(self, folder: str) -> bool:
        fs, p = self._fs(folder)
        return any(s.isDirectory() for s in fs.listStatus(p))

    def _merged(self, old: DataFrame, new: DataFrame, batch: str) -> DataFrame:
        both = old.where(F.col("rank").isNotNull()).withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
        best = both.groupBy(*self.keys).agg(F.max(F.struct("rank", "_age", "_batch")).alias("_b")).select("_b._batch", "_b.rank", *self.keys)
        done = old.where(F.col("rank").isNull()).unionByName(self.spark.createDataFrame([(batch, None, *[None] * len(self.keys))], self.entry))
        return best.unionByName(done)

    def _publish(self, entries: DataFrame, version: int) -> bool:
        """False if the version exists already."""
        draft = f"{self.path}/manifest/.draft-{uuid.uuid4().hex}"
        entries.write.parquet(draft)
        jvm = self.spark._jvm
        hadoop = jvm.org.apache.hadoop.fs
        files = hadoop.FileContext.getFileContext(hadoop.Path(self.path).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            files.rename(hadoop.Path(draft), hadoop.Path(f"{self.path}/manifest/v{version}"), self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            fs, p = self._fs(draft)
            fs.delete(p, True)
            return False
        return True

    def vacuum(self) -> list[str]:
        """Deletes the data of batches that no key of the newest manifest is in; for when no reader of
        an older version and no writer is left. Returns their names."""
        current = {r["_batch"] for r in self.manifest().where(F.col("rank").isNotNull()).select("_batch").distinct().collect()}  # names of batches
        fs, folder = self._fs(f"{self.path}/data")
        gone = []
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            name = status.getPath().getName()
            if name.startswith("_batch=") and name[7:] not in current:
                fs.delete(status.getPath(), True)
                gone.append(name[7:])
        return sorted(gone)


PROVISIONAL, FINAL = 0, 1


def start_replacing(rows: DataFrame, table: VersionedTable, checkpoint: str, name: str, rank: int, once: bool = True):
    """A stream whose batches replace the keys they have rows of (days and sensors): final rows take
    the place of provisional ones, which never replace final ones. A batch that runs again after a
    failure has the same name, so it is written once."""

    def save(batch: DataFrame, number: int) -> None:
        table.commit(batch, f"{name}-{number}", rank)

    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if once else writer).start()


def run_stage(items: DataFrame, table: VersionedTable, key: str, work, at_once: int = 1000) -> int:
    """Works on the items that the table's manifest doesn't have as done, `at_once` at a time, each
    lot a commit; returns how many lots. work takes the rows of items and returns rows of the table. A
    stage that is started again after a stop goes on after the last commit."""
    lot = F.floor(F.col("_place") / at_once)
    placed = numbered(items.withColumn("_all", F.lit(0)), ["_all"], F.pmod(F.xxhash64(key), F.lit(64)), [key], "_place").withColumn("_place", F.col("_place") - 1).drop("_all")
    lots = placed.withColumn("_lot", F.concat(F.lit("lot-"), lot.cast("string")))
    done = table.done()
    todo = [r["_lot"] for r in lots.select("_lot").distinct().join(done, F.col("_lot") == F.col("_batch"), "left_anti").orderBy(F.length("_lot"), "_lot").collect()]  # one row a lot
    for name in todo:
        table.commit(work(lots.where(F.col("_lot") == name).drop("_lot", "_place")), name, FINAL)
    return len(todo)
