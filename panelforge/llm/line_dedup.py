"""Cross-site removal of boilerplate lines by distinct-site spread.

Every line (white space runs as one space, trimmed) is hashed to 128 bits. A HyperLogLog sketch
of its sites is built for each hash and merged by aggregation, so a line that every document has
costs one sketch a task. Lines whose estimate is near the threshold get an exact distinct count;
the others are decided by the sketch. A line on min_sites sites or more is boilerplate: it stays
in the document with the smallest id that has it and goes from all others.

Defined results: a null text counts as empty and stays empty; null sites count as one site;
lines of any length count, blank ones never; rows that repeat a document get equal results, so
all rows of the smallest id keep a line; a null id is larger than any other, and if only null
ids have a line they all keep it; a document that had words and has none left is not kept; very
long texts are split once and travel as line hashes; an empty table gives an empty table; added
columns get a leading underscore if the table has their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, free_name, stored, table, text_or_empty


def _lines(df: DataFrame, text: str, key: str, site: str) -> DataFrame:
    """id, row hash, place, 128-bit hash and site of each line that can be boilerplate."""
    body = text_or_empty(text)
    plain = F.trim(F.regexp_replace(F.col("line"), SPACE, " "))
    rows = df.select(F.col(key).alias("id"), F.xxhash64(body).alias("row"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(body, "\n")).alias("place", "line"))
    rows = rows.withColumn("plain", plain).where(F.col("plain") != "")
    return rows.select("id", "row", "place", "site", F.xxhash64("plain").alias("h1"), F.xxhash64(F.lit(1), "plain").alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int, band: float, lg_k: int = 12) -> DataFrame:
    """h1, h2 and the smallest id of each line on min_sites sites or more."""
    spread = stored(
        lines.groupBy("h1", "h2")
        .agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min("id").alias("first"))
        .withColumn("sites", F.hll_sketch_estimate("sketch"))
        .where(F.col("sites") >= min_sites * (1 - band))
        .select("h1", "h2", "first", "sites")
    )
    near = F.col("sites") <= min_sites * (1 + band)
    exact = lines.join(spread.where(near).select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").count().where(F.col("count") >= min_sites)
    return spread.where(~near).select("h1", "h2", "first").unionByName(spread.where(near).select("h1", "h2", "first").join(exact.select("h1", "h2"), ["h1", "h2"], "left_semi"))


def without(text: Column, places: Column) -> Column:
    """The text without the lines at these places."""
    lines = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
    return F.array_join(F.transform(stay, lambda k: F.get(lines, k)), "\n")


def deduplicate(df: DataFrame, text: str = "text", key: str = "doc_id", site: str = "source", min_sites: int = 5, band: float = 0.25) -> DataFrame:
    """df's rows with cleaned text; adds n_lines, n_removed and kept."""
    # Hashes are about a tenth of the texts, which would else be split once for each use.
    lines = stored(_lines(df, text, key, site))
    found = stored(boilerplate(lines, min_sites, band))
    places = lines.join(found, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("first"))).groupBy("id", "row").agg(F.collect_set("place").alias("places"))
    own = {c: free_name(df, f"cut_{c}") for c in ("id", "row", "places")}
    places = places.select([F.col(a).alias(b) for a, b in own.items()])
    n_lines, n_removed, kept = (free_name(df, c) for c in ("n_lines", "n_removed", "kept"))
    body = text_or_empty(text)
    joined = df.join(places, F.col(key).eqNullSafe(F.col(own["id"])) & (F.xxhash64(body) == F.col(own["row"])), "left")
    cut = F.col(own["places"])
    clean = F.when(cut.isNull(), F.col(text)).otherwise(without(body, cut))
    out = joined.withColumns({n_lines: F.size(F.split(body, "\n")).cast("long"), n_removed: F.coalesce(F.size(cut), F.lit(0)).cast("long"), text: clean})
    out = out.withColumn(kept, (F.col(n_removed) == 0) | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    return out.drop(*own.values())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all documents, with sources as sites."""
    return deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_lines", "n_removed", "kept", "text")


SQL = """
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents
), p AS (SELECT *, trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS plain FROM l),
b AS (
  SELECT plain, min(doc_id) AS first FROM p WHERE plain <> ''
  GROUP BY plain HAVING count(DISTINCT site) >= 5
), c AS (
  SELECT p.doc_id, place, line, b.plain IS NOT NULL AND p.doc_id <> b.first AS cut FROM p LEFT JOIN b ON p.plain = b.plain
), g AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (cut) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT cut), '') AS text
  FROM c GROUP BY doc_id
)
SELECT d.doc_id, d.source, n_lines, n_removed, n_removed = 0 OR regexp_matches(g.text, '[^\\x20\\x09-\\x0D]') AS kept, g.text
FROM documents d JOIN g USING (doc_id)
"""
