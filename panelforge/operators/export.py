"""Export: gates that stop it, nested JSON shapes, CSV that spreadsheets can't run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class GateError(ValueError):
    """A table that must not be published."""


def gate_counts(cells: DataFrame, allowed: tuple[int, ...] = tuple(range(-1, 9))) -> DataFrame:
    """One row with how many cells break each rule. cells: coverage, p_hi, p_lo, code, h."""
    wrong = lambda c, low, high: F.count_if(F.col(c).isNotNull() & ~F.col(c).between(low, high))
    return cells.agg(
        wrong("coverage", 0, 1.0001).alias("bad_coverage"),
        wrong("p_hi", 0, 1).alias("bad_p_hi"),
        wrong("p_lo", 0, 1).alias("bad_p_lo"),
        F.count_if(~F.col("code").isin(*allowed)).alias("bad_code"),
        F.count("h").alias("n_harmonized"),
    )


def check_gates(cells: DataFrame) -> None:
    row = gate_counts(cells).first().asDict()
    if row.pop("n_harmonized") == 0:
        raise GateError("no harmonized cell")
    broken = {k: n for k, n in row.items() if n}
    if broken:
        raise GateError(f"cells out of range: {broken}")


def reconcile(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows before and after a step and the share dropped, to four places."""
    a = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("raw"))
    b = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("kept"))
    out = a.join(b, keys, "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return out.withColumn("dropped", F.round(1 - F.col("kept") / F.col("raw"), 4))


def series(cells: DataFrame, key: str, order: list[str], values: dict[str, int | None]) -> DataFrame:
    """One row for each key with parallel arrays in order; numbers half to even at the given places."""
    shown = lambda c, places: F.bround(F.col(c), places) if places is not None else F.col(c)
    rows = F.array_sort(F.collect_list(F.struct(*order, *[shown(c, p).alias(c) for c, p in values.items()])))
    return cells.groupBy(key).agg(rows.alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in values])


def as_json(df: DataFrame, kind: str) -> DataFrame:
    """One JSON text for each row, tagged with its kind and version; nulls are written."""
    row = F.struct(F.lit(kind).alias("schema"), *df.columns)
    return df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))


def csv_field(value: Column) -> Column:
    """A quoted field; text that a spreadsheet would run as a formula gets a leading apostrophe."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(rows: DataFrame) -> DataFrame:
    """One CSV line for each observation, columns in fixed order, unknown times blank."""
    def safe(name: str) -> Column:
        return F.when(F.col(name).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), F.col(name))).otherwise(F.col(name))

    columns = [F.col("latitude"), F.col("longitude"), F.date_format("day", "yyyy-MM-dd"), F.when(F.col("time_known"), F.col("time")), safe("satellite"), safe("sensor"), safe("confidence"), F.col("frp"), safe("district"), F.col("excluded")]
    return rows.select(F.concat_ws(",", *map(csv_field, columns)).alias("value"))


CSV_HEADER = "latitude,longitude,acq_date,acq_time,satellite,instrument,confidence,frp,district,excluded"


def write_csv(rows: DataFrame, path: str) -> None:
    header = rows.sparkSession.createDataFrame([(CSV_HEADER,)], "value string")
    header.unionByName(csv_lines(rows)).write.option("lineSep", "\r\n").text(path)


def newest_within(rows: DataFrame, limit_bytes: int, year: str = "year") -> DataFrame:
    """Rows of the latest years whose JSON fits into limit_bytes together; whole years only."""
    sized = rows.groupBy(year).agg(F.sum(F.octet_length(F.to_json(F.struct(*rows.columns))) + 1).alias("bytes"))
    total = F.sum("bytes").over(Window.orderBy(F.desc(year)))
    fitting = sized.withColumn("total", total).where(F.col("total") <= limit_bytes).select(year)  # one row a year
    return rows.join(fitting, year, "left_semi")


def write_partitioned(df: DataFrame, path: str, by: list[str], sort: list[str]) -> None:
    """Appends a table partitioned by few columns, in ranges of the sort columns: a large
    partition is written by several tasks, each with sorted rows."""
    df.repartitionByRange(*by, *sort).sortWithinPartitions(*by, *sort).write.mode("append").partitionBy(*by).parquet(path)


def only_new(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return items.join(done.select(key).distinct(), key, "left_anti")
