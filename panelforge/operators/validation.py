"""Agreement and calibration statistics, with block-bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from .ordering import running


def confusion(pairs: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def kappa_of(counts: DataFrame, *by: str) -> DataFrame:
    """Cohen's kappa, observed and expected agreement; null if the expectation is 1. counts: a, b, n."""
    rows = counts.groupBy(*by, F.col("a").alias("k")).agg(F.sum("n").alias("r"), F.lit(0).cast("long").alias("c"))
    columns = counts.groupBy(*by, F.col("b").alias("k")).agg(F.lit(0).cast("long").alias("r"), F.sum("n").alias("c"))
    expected = rows.unionByName(columns).groupBy(*by, "k").agg(F.sum("r").alias("r"), F.sum("c").alias("c")).groupBy(*by).agg(F.sum(F.col("r").cast("double") * F.col("c")).alias("rc"), F.sum("r").alias("total"))
    observed = counts.groupBy(*by).agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    both = expected.join(observed, list(by)) if by else expected.crossJoin(observed)
    po, pe = F.col("same") / F.col("total"), F.col("rc") / (F.col("total").cast("double") * F.col("total"))
    return both.select(*by, F.col("total").alias("n"), po.alias("po"), pe.alias("pe"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def kappa(pairs: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    return kappa_of(confusion(pairs, a, b, *by), *by)


def _uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 over the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])), 1, 13), 16, 10).cast("double") / float(1 << 52)


def block_draws(blocks: DataFrame, block: str, draws: int, seed: int) -> DataFrame:
    """draw, block, m: how often each draw takes each block; a draw takes as many blocks as there
    are, with replacement. The picks are hashes of draw and place, made where they are counted."""
    numbered_blocks = blocks.select(block).distinct().withColumn("_k", F.row_number().over(Window.orderBy(block)) - 1)  # units or years
    n = numbered_blocks.count()
    picks = blocks.sparkSession.range(draws * n).select(F.floor(F.col("id") / n).cast("int").alias("draw"), (F.col("id") % n).alias("j"))
    picks = picks.withColumn("_k", F.floor(_uniform(str(seed), F.col("draw"), F.col("j")) * n).cast("int"))
    return picks.groupBy("draw", "_k").agg(F.count(F.lit(1)).alias("m")).join(numbered_blocks, "_k").drop("_k")


def kappa_interval(pairs: DataFrame, a: str, b: str, block: str, draws: int = 1000, seed: int = 7, least_rows: int = 20) -> DataFrame:
    """2.5 and 97.5 % quantiles of kappa over draws of whole blocks with replacement; null below
    two blocks or least_rows rows."""
    counts = confusion(pairs, a, b, block)
    size = counts.agg(F.count_distinct(block).alias("blocks"), F.sum("n").alias("n")).first()
    if size["blocks"] < 2 or (size["n"] or 0) < least_rows:
        return pairs.sparkSession.createDataFrame([(None, None, 0)], "lo double, hi double, draws int")
    drawn = block_draws(counts, block, draws, seed).join(counts, block).groupBy("draw", "a", "b").agg(F.sum(F.col("n") * F.col("m")).alias("n"))
    k = kappa_of(drawn, "draw").where(F.col("kappa").isNotNull())
    return k.agg(F.percentile("kappa", F.lit(0.025)).alias("lo"), F.percentile("kappa", F.lit(0.975)).alias("hi"), F.count(F.lit(1)).cast("int").alias("draws"))


def mean_interval(rows: DataFrame, value: str, block: str, draws: int = 500, seed: int = 11) -> DataFrame:
    """Mean of value and the 2.5 and 97.5 % quantiles of the means of draws of whole blocks."""
    sums = rows.where(F.col(value).isNotNull()).groupBy(block).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    means = block_draws(sums, block, draws, seed).join(sums, block).groupBy("draw").agg((F.sum(F.col("total") * F.col("m")) / F.sum(F.col("n") * F.col("m"))).alias("mean"))
    whole = sums.agg(F.sum("n").alias("n"), F.try_divide(F.sum("total"), F.sum("n")).alias("mean"))
    return whole.crossJoin(means.agg(F.percentile("mean", F.lit(0.025)).alias("lo"), F.percentile("mean", F.lit(0.975)).alias("hi")))  # one row each


_SLICES = 128


def average_ranks(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """keys, column, and rank of each distinct value: from 1, the mean rank on ties. Values are
    counted first; the counts are added up in slices between quantiles of the key's distinct values,
    so that an outlier doesn't put all others into one."""
    counts = rows.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    shares = [k / _SLICES for k in range(1, _SLICES)]
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(column, shares, 10_000).alias("_cuts"))
    placed = counts.join(cuts, keys) if keys else counts.crossJoin(F.broadcast(cuts))  # one row
    slices = F.size(F.filter("_cuts", lambda c: c < F.col(column)))
    upto = running(placed, keys, slices, [column], F.col("_n"), "upto")
    return upto.select(*keys, column, (F.col("upto") - (F.col("_n") - 1) / 2).alias(f"rank_{column}"))


def spearman(rows: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    keys = list(by)
    known = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    ranked = known.join(average_ranks(known, "a", keys), [*keys, "a"]).join(average_ranks(known, "b", keys), [*keys, "b"])
    return ranked.groupBy(*keys).agg(F.corr("rank_a", "rank_b").alias("rho"), F.count(F.lit(1)).alias("n"))


def agreement(rows: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Pearson correlation and mean difference of two log rates."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy(*by).agg(F.corr(a, b).alias("pearson"), F.avg(F.col(a) - F.col(b)).alias("bias"), F.count(F.lit(1)).alias("n"))


def interval_shares(rows: DataFrame, z: Column, *by: str) -> DataFrame:
    """Share of standardised errors within the 80 % and 95 % limits."""
    return rows.groupBy(*by).agg(F.avg((F.abs(z) <= C.Z80).cast("double")).alias("share80"), F.avg((F.abs(z) <= C.Z95).cast("double")).alias("share95"), F.count(F.lit(1)).alias("n"))


def calibrate_r(pairs: DataFrame, steps: int = 10, goal: float = 0.8, least: int = 100, default: float = 0.3, otherwise: float = 0.9) -> DataFrame:
    """Smallest correlation r = 0, 0.1, ... at which combined intervals hold the truth often
    enough. pairs: mu1, sigma1, mu2, sigma2, truth, truth_var."""
    r = pairs.sparkSession.range(steps).select(F.col("id").cast("int").alias("step"))
    w1, w2 = 1 / (F.col("sigma1") * F.col("sigma1")), 1 / (F.col("sigma2") * F.col("sigma2"))
    mu, var = (w1 * F.col("mu1") + w2 * F.col("mu2")) / (w1 + w2), (1 + F.col("step") / 10) / (w1 + w2)
    hits = pairs.crossJoin(F.broadcast(r)).groupBy("step").agg(F.avg((F.abs(F.col("truth") - mu) <= C.Z80 * F.sqrt(var + F.col("truth_var"))).cast("double")).alias("share"), F.count(F.lit(1)).alias("n"))
    best = hits.agg(F.max("n").alias("n"), F.min(F.when(F.col("share") >= goal, F.col("step"))).alias("step"))
    return best.select(F.when(F.coalesce("n", F.lit(0)) < least, default).otherwise(F.coalesce(F.col("step") / 10, F.lit(otherwise))).alias("r"), F.coalesce("n", F.lit(0)).alias("n"))
