"""From sensors' cells to one verdict: estimates along the chains of bridges, combined, judged.

Every sensor's cells are put on the reference sensor's scale by the fitted bridges. How far errors of
sensors go together is calibrated on the reference sensor's own rates in training years; the fleet's
estimate is the inverse-variance mean, widened by that correlation; its history is the baseline that
each cell is judged against, the cell's own year left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scores
from . import baseline, bridge, graph, panel, validation

KEY = ["unit", "year", "p"]


def correlation(estimates: DataFrame, train: tuple[int, int], pair: tuple[int, int] = (0, 2), least: int = 100) -> DataFrame:
    """One row, r and n: the smallest correlation at which the pair's combination holds the reference
    sensor's own log rate often enough. estimates: s, unit, year, p, mu, sigma, observed in training years."""
    years = estimates.where(F.col("year").between(*train))
    side = lambda s, k: years.where(F.col("s") == s).select(*KEY, F.col("mu").alias(f"mu{k}"), F.col("sigma").alias(f"sigma{k}"))
    truth = years.where(F.col("s") == C.REFERENCE_SENSOR).select(*KEY, F.col("mu").alias("truth"), (F.col("sigma") * F.col("sigma")).alias("truth_var"))
    return validation.calibrate_r(side(pair[0], 1).join(side(pair[1], 2), KEY).join(truth, KEY), least=least)


def fleet(estimates: DataFrame, r: DataFrame, disabled: tuple[int, ...] = ()) -> DataFrame:
    """unit, year, p, mu, sigma, n_used of the sensors together. r: as from correlation, one row."""
    sums = panel.combine(estimates, 0.0, disabled)
    wide = F.sqrt(1 + (F.col("n_used") - 1) * F.col("r"))
    return sums.crossJoin(F.broadcast(r.select(F.col("r").cast("double").alias("r")))).withColumn("sigma", F.col("sigma") * wide).drop("r")


def judged(combined: DataFrame, spine: DataFrame, window: tuple[int, int], min_n: int = C.MIN_BASELINE_N, q_min: float = C.Q_MIN) -> DataFrame:
    """Every cell of the spine (unit, year, p) with its estimate, its baseline with the cell's year left
    out, p_hi, p_lo and code; cells without an estimate have the code of unobserved ones."""
    h = spine.select(*KEY).join(combined, KEY, "left")
    base = baseline.leave_one_out(h.select(*KEY, F.exp("mu").alias("v")), window)
    out = base.join(combined, KEY, "left")
    out = out.withColumns({"p_hi": scores.p_above(F.col("mu"), F.col("sigma"), F.col("q90")), "p_lo": scores.p_below(F.col("mu"), F.col("sigma"), F.col("q10"))})
    return out.withColumn("code", scores.verdict(F.col("mu"), F.col("sigma"), F.col("p_hi"), F.col("p_lo"), F.col("q10"), F.col("top"), F.col("n"), min_n, q_min))


def verdicts(cells: DataFrame, models: DataFrame, spine: DataFrame, window: tuple[int, int], train: tuple[int, int], draws: int = bridge.DRAWS, disabled: tuple[int, ...] = (), min_n: int = C.MIN_BASELINE_N, least: int = 100) -> DataFrame:
    """The whole way. cells: valid ones, as bridge.predict takes them; models: as bridge.fit_bridges
    gives them; spine: all units, years and periods."""
    # read several times, by the calibration, the mean and the baseline
    per_sensor = graph.settled(bridge.predict(cells, models, draws))
    return judged(graph.settled(fleet(per_sensor, correlation(per_sensor, train, least=least), disabled)), spine, window, min_n)
