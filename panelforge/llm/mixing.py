"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its share of the target over its share of the rows. A
document's number of copies is the Poisson quantile of a uniform number hashed from seed and
doc_id, so it doesn't depend on partitions, order or retries. Rates over 16 are split into equal
parts with a hash each (a sum of Poisson numbers is Poisson), so no table of probabilities
grows. Copies are in the global order of a hash of document and copy.

Defined results: a null source is a source of its own; rows with one doc_id get the same number
of copies; a null doc_id hashes as the text "null"; sources without a target weight get none of
it and are left out; very long texts are moved once; an empty table gives an empty table. Added columns get a leading underscore
if the table has their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, stored, table

PART_RATE, PART_TABLE = 16, 100


def _uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 over the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(df: DataFrame, source: str, weights: dict[str, float] | None, size: float | None) -> DataFrame:
    """One row for each source: n parts of rate mu each, and the Poisson distribution of mu.

    weights: target share by source, in any unit; None for equal shares. size: rows to make, None
    for as many as there are.
    """
    counts = df.groupBy(F.col(source).alias("of")).agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        counts = counts.withColumn("share", F.lit(1.0))
    else:
        wanted = df.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], "name string, share double")
        counts = counts.join(wanted, F.col("of").cast("string").eqNullSafe(F.col("name")), "left").select("of", "rows", F.coalesce("share", F.lit(0.0)).alias("share"))
    counts, share = stored(counts), F.col("share")
    total = counts.agg(F.sum("rows").alias("rows"), F.sum(share).alias("shares")).first()
    made, shares = size if size is not None else (total["rows"] or 0), total["shares"] or 1.0
    out = counts.withColumn("rate", share / F.lit(float(shares)) * F.lit(float(made)) / F.col("rows")).where(F.col("rate") > 0)
    out = out.withColumn("parts", F.ceil(F.col("rate") / PART_RATE).cast("int")).withColumn("mu", F.col("rate") / F.col("parts"))
    start = F.struct((-F.col("mu")).alias("log_p"), F.exp(-F.col("mu")).alias("sum"), F.array(F.exp(-F.col("mu"))).alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        log_p = s["log_p"] + F.log(F.col("mu")) - F.log(k.cast("double"))
        return F.struct(log_p.alias("log_p"), (s["sum"] + F.exp(log_p)).alias("sum"), F.concat(s["cdf"], F.array(s["sum"] + F.exp(log_p))).alias("cdf"))

    return out.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), F.lit(PART_TABLE)), start, step, lambda s: s["cdf"]))


def mix(df: DataFrame, source: str = "source", key: str = "doc_id", weights: dict[str, float] | None = None, size: float | None = None, seed: int = 7, most_sources: int = 10_000) -> DataFrame:
    """df's rows, each as often as drawn, in a global random order; adds copy (from 1) and order_key.

    The rates are broadcast if there are at most most_sources of them, else joined by a shuffle.
    """
    table_of = stored(rates(df, source, weights, size).select("of", "parts", "cdf"))
    small = table_of.count() <= most_sources
    rate = {c: free_name(df, f"rate_{c}") for c in table_of.columns}
    table_of = table_of.select([F.col(a).alias(b) for a, b in rate.items()])
    copy, order_key = free_name(df, "copy"), free_name(df, "order_key")
    joined = df.join(F.broadcast(table_of) if small else table_of, F.col(source).eqNullSafe(F.col(rate["of"])))
    # The hashes come first, as inside the search they would be worked out for each entry.
    uniforms = F.transform(F.sequence(F.lit(1), F.col(rate["parts"])), lambda j: _uniform(str(seed), F.col(key), j))
    drawn = F.aggregate(uniforms, F.lit(0), lambda n, u: n + F.size(F.filter(F.col(rate["cdf"]), lambda c: c <= u)))
    copies = joined.withColumn(copy, drawn).drop(*rate.values()).where(F.col(copy) > 0)
    copies = copies.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy))))
    copies = copies.withColumn(order_key, F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col(copy).cast("string"))))
    # The hash is uniform, so equal ranges of it are equal parts of the rows: a global order without
    # the sample of the rows that a sort would take.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = F.floor(F.conv(F.substring(order_key, 1, 8), 16, 10).cast("double") / float(1 << 32) * parts).cast("int")
    return copies.repartitionById(parts, ranged).sortWithinPartitions(order_key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents, the sources in equal shares."""
    return mix(table(spark, sf_dir, "documents"))


SQL = """
WITH n AS (SELECT source, count(*) AS rows FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(rows) FROM n) / (SELECT count(*) FROM n)::DOUBLE / rows AS rate FROM n),
p AS (SELECT source, ceil(rate / 16)::INT AS parts, rate / ceil(rate / 16) AS mu FROM r),
c AS (SELECT source, parts, sum(exp(k * ln(mu) - mu - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
      FROM p, range(0, 101) AS t(k)),
u AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, j,
             ('0x' || substr(md5('7:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || j), 1, 13))::UBIGINT / 4503599627370496.0::DOUBLE AS u,
             row_number() OVER () AS id
      FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source, LATERAL range(1, p.parts + 1) AS t(j)),
k AS (SELECT u.id, any_value(u.doc_id) AS doc_id, any_value(u.text) AS text, any_value(u.lang) AS lang, any_value(u.source) AS source, any_value(u.n_chars) AS n_chars, count(*) AS k
      FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf <= u.u GROUP BY u.id)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, md5('7/order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy) AS order_key
FROM k, LATERAL range(1, k.k + 1) AS t(copy)
"""
