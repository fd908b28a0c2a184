"""The validation suite: continuity of candidates with a reference, calibration of spreads, step
changes, cloud artifacts, and what stays when sensors are switched off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scores
from . import graph, validation

CELL = ["unit", "year", "p"]


def judge(cells: DataFrame, base: DataFrame, min_n: int = C.MIN_BASELINE_N, q_min: float = C.Q_MIN) -> DataFrame:
    """Every cell of the baseline with the verdict code of its estimate mu, sigma, if it has one."""
    b = base.join(cells.select(*CELL, "mu", "sigma"), CELL, "left")
    b = b.withColumns({"p_hi": scores.p_above(F.col("mu"), F.col("sigma"), F.col("q90")), "p_lo": scores.p_below(F.col("mu"), F.col("sigma"), F.col("q10"))})
    return b.withColumn("code", scores.verdict(F.col("mu"), F.col("sigma"), F.col("p_hi"), F.col("p_lo"), F.col("q10"), F.col("top"), F.col("n"), min_n, q_min))


def constant_ratio(own: DataFrame, reference: DataFrame, train: Column) -> DataFrame:
    """own's cells with mu moved by one ratio of summed counts over the training cells of both."""
    both = own.where(train).join(reference.select(*CELL, F.col("d").alias("_r")), CELL)
    ratio = both.agg(F.ln(F.sum("_r") / F.greatest(F.sum("d"), F.lit(1))).alias("_shift"))  # one row
    return own.crossJoin(F.broadcast(ratio)).withColumn("mu", F.col("mu") + F.col("_shift")).drop("_shift")


def month_ratio(own: DataFrame, reference: DataFrame, train: Column, least: int = 30) -> DataFrame:
    """The same with a ratio for each month of the periods; months with fewer training cells have none."""
    month = F.least(F.floor((F.col("p") - 1) * 8 / F.lit(30.5)), F.lit(11)).cast("int")
    both = own.where(train).join(reference.select(*CELL, F.col("d").alias("_r")), CELL)
    ratios = both.groupBy(month.alias("_month")).agg(F.ln(F.greatest(F.sum("_r"), F.lit(1)) / F.greatest(F.sum("d"), F.lit(1))).alias("_shift"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return own.withColumn("_month", month).join(F.broadcast(ratios.drop("_n")), "_month").withColumn("mu", F.col("mu") + F.col("_shift")).drop("_month", "_shift")  # twelve rows


def continuity(reference: DataFrame, candidates: dict[str, DataFrame], least: int = 20) -> DataFrame:
    """How far each candidate's classes agree with the reference's judged ones: cells judged by
    both, their share, and kappa where there are enough. All: unit, year, p, code."""
    ref = reference.where(scores.judged(F.col("code"))).select(*CELL, scores.class3(F.col("code")).alias("a"))
    own = None
    for name, cells in candidates.items():
        part = cells.where(scores.judged(F.col("code"))).select(F.lit(name).alias("candidate"), *CELL, scores.class3(F.col("code")).alias("b"))
        own = part if own is None else own.unionByName(part)
    # Nine counts a candidate, which kappa reads several times.
    counts = graph.settled(validation.confusion(ref.join(own, CELL), "a", "b", "candidate"))
    names = ref.sparkSession.createDataFrame([(name,) for name in candidates], "candidate string")
    total = ref.agg(F.count(F.lit(1)).alias("_total"))
    out = names.join(validation.kappa_of(counts, "candidate"), "candidate", "left").crossJoin(total)  # one row each
    share = F.coalesce(F.try_divide(F.col("n"), F.col("_total")), F.lit(0.0))
    return out.select("candidate", F.coalesce("n", F.lit(0)).alias("n"), share.alias("judged_share"), F.when(F.col("n") >= least, F.col("kappa")).alias("kappa"))


def sigma_scale(pairs: DataFrame, *by: str, least: int = 200) -> DataFrame:
    """Factor by which spreads must grow so that the 80 % limits hold 80 % of the differences; 1
    where there are fewer than least. pairs: mu, sigma, truth, truth_sigma."""
    z = F.abs(F.col("mu") - F.col("truth")) / F.sqrt(F.col("sigma") * F.col("sigma") + F.col("truth_sigma") * F.col("truth_sigma"))
    out = pairs.groupBy(*by).agg(F.percentile(z, F.lit(0.8)).alias("q"), F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.when(F.col("n") >= least, F.col("q") / C.Z80).otherwise(1.0).alias("factor"), "n")


def rescaled(sigma: Column, truth_sigma: Column, factor: Column) -> Column:
    """The spread that a factor asks for, at least a fifth of what it was."""
    wide = factor * factor * (sigma * sigma + truth_sigma * truth_sigma) - truth_sigma * truth_sigma
    return F.sqrt(F.greatest(wide, F.lit(0.04) * sigma * sigma))


def interval_split(rows: DataFrame, z: Column, expected: Column, least_expected: float = 3.0) -> DataFrame:
    """Shares within the limits over all cells, and over those that expect some detections."""
    parts = rows.withColumns({"_z": z, "cells": F.explode(F.when(expected >= least_expected, F.array(F.lit("all"), F.lit("informative"))).otherwise(F.array(F.lit("all"))))})
    return validation.interval_shares(parts, F.col("_z"), "cells")


def quiet(cells: DataFrame, level: str = "q50") -> DataFrame:
    """Cells of units whose usual level is below the median of all cells' levels."""
    mark = cells.agg(F.percentile(level, F.lit(0.5)).alias("_mark"))  # one row
    return cells.crossJoin(F.broadcast(mark)).where(F.col(level) < F.col("_mark")).drop("_mark")


def step_change(with_new: DataFrame, without: DataFrame, block: str = "unit", draws: int = 500, seed: int = 11) -> DataFrame:
    """Mean log step that a new sensor brings, with an interval over blocks. Both: unit, year, p, mu."""
    diff = with_new.select(*CELL, F.col("mu").alias("_new")).join(without.select(*CELL, F.col("mu").alias("_old")), CELL)
    return validation.mean_interval(diff.withColumn("_step", F.col("_new") - F.col("_old")), "_step", block, draws, seed)


def kept(full: DataFrame, reduced: DataFrame) -> DataFrame:
    """Of each unit's judged cells (unit -1: all units), how many keep their class in the reduced fleet."""
    judged = full.where(scores.judged(F.col("code"))).select(*CELL, scores.class3(F.col("code")).alias("a"))
    both = judged.join(reduced.select(*CELL, scores.class3(F.col("code")).alias("b")), CELL)
    own = both.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))
    whole = own.agg(F.sum("n").alias("n"), F.sum("same").alias("same")).select(F.lit(-1).alias("unit"), "n", "same")
    return own.unionByName(whole).select("unit", "n", F.round(F.col("same") / F.col("n"), 4).alias("kept"))
