"""Does a new sensor go on where the reference ends? Candidates, calibration and counter-checks.

Cells are valid ones of one sensor (unit, year, p, d, clear, land, rho); estimates have mu and sigma on
the reference's scale. alpha is one row: the reference's overdispersion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scores
from . import baseline, bridge, evaluation, graph, harmonize, panel, validation

KEY = ["unit", "year", "p"]


def _noisy(cells: DataFrame, mu: Column, count: Column, alpha: DataFrame) -> DataFrame:
    """Cells with mu and the spread of a count, widened by the overdispersion."""
    joined = cells.crossJoin(F.broadcast(alpha.select(F.col("alpha").alias("_alpha"))))  # one row
    return joined.withColumns({"mu": mu, "sigma": F.sqrt(1 / count + F.col("_alpha"))}).drop("_alpha")


def constant_rate(new: DataFrame, reference: DataFrame, train: Column, alpha: DataFrame) -> DataFrame:
    """new's rates times one ratio: the reference's detections in training cells of both, to what new's
    rates would give in the area that the reference saw clear."""
    both = new.where(train).join(reference.select(*KEY, F.col("d").alias("_d"), F.col("clear").alias("_clear")), KEY)
    expected = F.sum(F.col("rho") * F.col("_clear") / 1000)
    ratio = both.agg(F.ln(F.sum("_d") / F.greatest(expected, F.lit(1e-9))).alias("_shift"))  # one row
    moved = new.crossJoin(F.broadcast(ratio)).withColumn("_mu", F.col("_shift") + F.ln("rho"))
    return _noisy(moved, F.col("_mu"), F.col("d") + 0.5, alpha).drop("_shift", "_mu")


def month_rate(new: DataFrame, reference: DataFrame, train: Column, alpha: DataFrame, least: int = 30) -> DataFrame:
    """new's counts times a ratio of counts for each month, over the whole land whatever was seen of it;
    months with fewer training cells than `least` have no estimate."""
    month = F.least(F.floor((F.col("p") - 1) * 8 / F.lit(30.5)), F.lit(11)).cast("int")
    both = new.where(train).join(reference.select(*KEY, F.col("d").alias("_d")), KEY)
    ratios = both.groupBy(month.alias("_month")).agg((F.sum("_d") / F.greatest(F.sum("d"), F.lit(1))).alias("_ratio"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    joined = new.withColumn("_month", month).join(F.broadcast(ratios), "_month")  # twelve rows
    joined = joined.withColumn("_rate", F.col("d") * F.col("_ratio") / (F.col("land") / 1000) + C.RATE_FLOOR)
    return _noisy(joined, F.ln("_rate"), F.col("_rate") * F.col("land") / 1000, alpha).drop("_month", "_ratio", "_rate")


def own_record(new: DataFrame, spine: DataFrame, window: tuple[int, int], alpha: DataFrame, least: int = 10, enough: int = 100, min_n: int = C.MIN_BASELINE_N) -> DataFrame:
    """Codes of new's own rates against new's own record: no bridge, and a record of `least` values is
    enough."""
    own = _noisy(new, F.ln("rho"), F.col("d") + 0.5, alpha)
    record = baseline.leave_one_out(spine.select(*KEY).join(new.select(*KEY, F.col("rho").alias("v")), KEY, "left"), window)
    record = record.withColumn("n", F.when(F.col("n") >= least, enough).otherwise(F.col("n")))
    return evaluation.judge(own, record, min_n)


def raw_totals(cells: DataFrame, sensors: tuple[int, ...] | None = None) -> DataFrame:
    """v: detections of all valid sensors' cells together, without any correction."""
    used = cells if sensors is None else cells.where(F.col("s").isin(*sensors))
    return used.groupBy(*KEY).agg(F.sum("d").cast("double").alias("v"))


def raw_codes(totals: DataFrame, base: DataFrame, min_n: int = C.MIN_BASELINE_N) -> DataFrame:
    """Classes of raw totals against the raw baseline of the whole fleet."""
    out = base.drop("v").join(totals, KEY, "left")
    return out.withColumn("code", scores.raw_class(F.col("v"), F.col("q10"), F.col("q90"), F.col("n"), min_n))


def raw_base(cells: DataFrame, spine: DataFrame, window: tuple[int, int]) -> DataFrame:
    return baseline.leave_one_out(spine.select(*KEY).join(raw_totals(cells), KEY, "left"), window)


def kept_shares(full: DataFrame, reduced: DataFrame, raw_full: DataFrame, raw_reduced: DataFrame, where: DataFrame) -> DataFrame:
    """unit (-1: all), n, adjusted, raw_n and raw: of the judged cells in `where` (unit, year, p: held-out
    years in which the new sensor is valid), the share whose class stays when sensors are off."""
    adjusted = evaluation.kept(full.join(where, KEY, "left_semi"), reduced).withColumnRenamed("kept", "adjusted")
    raw = evaluation.kept(raw_full.join(where, KEY, "left_semi"), raw_reduced).select("unit", F.col("n").alias("raw_n"), F.col("kept").alias("raw"))
    return adjusted.join(raw, "unit", "full").select("unit", F.coalesce("n", F.lit(0)).alias("n"), "adjusted", F.coalesce("raw_n", F.lit(0)).alias("raw_n"), "raw")


def raw_step(cells: DataFrame, years: tuple[int, int], old: tuple[int, ...] = (0, 1), new: int = 2) -> DataFrame:
    """step: log of raw counts with the new sensor to those without, of cells valid for all of them."""
    some = cells.where(F.col("year").between(*years) & F.col("s").isin(*old, new))
    sums = some.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"), F.sum("d").alias("_all"), F.sum(F.when(F.col("s") != new, F.col("d")).otherwise(0)).alias("_old")).where(F.col("_n") == len(old) + 1)
    return sums.select(*KEY, F.ln((F.col("_all") + 0.5) / (F.col("_old") + 0.5)).alias("step"))


def raw_anomalies(cells: DataFrame, raw: DataFrame, base: DataFrame, cover: DataFrame, least: float = 0.02) -> DataFrame:
    """z and coverage of quiet units' cells: raw totals against the raw median, by how much was seen.
    base: the judged baseline, which says where it is quiet; raw: the raw one; cover: coverage."""
    quiet = evaluation.quiet(base.where(F.col("q50").isNotNull())).select(*KEY)
    rows = raw_totals(cells).join(quiet, KEY).join(raw.select(*KEY, "q50"), KEY).where(F.col("q50").isNotNull()).join(cover.where(F.col("coverage") > least), KEY)
    return rows.select((F.ln(F.col("v") + 0.5) - F.ln(F.greatest(F.col("q50"), F.lit(0.5)))).alias("z"), "coverage")


def calibration(bridged: DataFrame, reference: DataFrame, fleet_without: DataFrame, reference_estimates: DataFrame, least_expected: float = 3.0) -> DataFrame:
    """cells (all or informative of the bridged sensor, fleet), n and shares within the 80 and 95 % limits.

    The bridged sensor's spread holds the overdispersion of its chain already, so only the reference's count
    noise is added; informative cells are those in which the reference is expected to see a few."""
    truth = reference.select(*KEY, F.ln("rho").alias("_truth"), F.col("d").alias("_d"), F.col("clear").alias("_clear"))
    both = bridged.select(*KEY, "mu", "sigma").join(truth, KEY)
    z = (F.col("mu") - F.col("_truth")) / F.sqrt(F.col("sigma") * F.col("sigma") + 1 / (F.col("_d") + 0.5))
    one = evaluation.interval_split(both, z, F.exp("mu") * F.col("_clear") / 1000, least_expected)
    noise = reference_estimates.select(*KEY, F.col("sigma").alias("_s"))
    others = fleet_without.select(*KEY, "mu", "sigma").join(truth, KEY).join(noise, KEY)
    all_z = (F.col("mu") - F.col("_truth")) / F.sqrt(F.col("sigma") * F.col("sigma") + F.col("_s") * F.col("_s"))
    fleet = validation.interval_shares(others, all_z).withColumn("cells", F.lit("fleet without reference"))
    return one.unionByName(fleet)


def national(bridged: DataFrame, reference: DataFrame, country: DataFrame) -> DataFrame:
    """One row for the country's series: n, correlation of the bridged log rate with the reference's, and
    their mean difference. country: unit, year, p of the cells of both."""
    truth = reference.select(*KEY, F.ln("rho").alias("_truth"))
    both = bridged.select(*KEY, "mu").join(truth, KEY).join(country, KEY, "left_semi")
    return validation.agreement(both.withColumn("_all", F.lit(0)), "mu", "_truth", "_all").drop("_all")


def report(cells: DataFrame, models: DataFrame, spine: DataFrame, window: tuple[int, int], train: tuple[int, int], overlap: tuple[int, int], held_out: int, new: int = 3, draws: int = bridge.DRAWS, min_n: int = C.MIN_BASELINE_N, least: int = 20, least_pairs: int = 100) -> dict[str, DataFrame]:
    """The parts of the validation document, each with a few rows: continuity (candidates: n, judged share,
    kappa), calibration, kept (units), step of raw counts, and national (the country's cells, unit -1, which no
    other part looks at).

    cells: valid ones of all sensors, as bridge.predict takes them; overlap: years in which ratios are
    learned; held_out: the first year that no model has seen.
    """
    # what several parts read is worked out once
    per = graph.settled(bridge.predict(cells, models, draws))
    r = graph.settled(harmonize.correlation(per, train, least=least_pairs))
    alpha = graph.settled(bridge.reference_alpha(models))
    full = graph.settled(harmonize.judged(harmonize.fleet(per, r), spine, window, min_n))
    base = full.select(*KEY, "q10", "q50", "q90", "top", "n")
    of = lambda d, s: d.where(F.col("s") == s)
    cells = graph.settled(cells)
    own, ref = of(cells, new), of(cells, C.REFERENCE_SENSOR)
    late = own.where(F.col("year") >= held_out).select(*KEY)
    here = late.where(F.col("unit") != panel.COUNTRY)
    both = here.join(ref.select(*KEY), KEY)
    in_overlap = F.col("year").between(*overlap) & (F.col("unit") != panel.COUNTRY)
    judged = lambda d: evaluation.judge(d, base, min_n)
    raw = graph.settled(raw_base(cells, spine, window))
    candidates = {
        "bridges": judged(of(per, new)),
        "raw_counts": raw_codes(own.select(*KEY, F.col("d").cast("double").alias("v")), raw, min_n),
        "constant_ratio": judged(constant_rate(own, ref, in_overlap, alpha)),
        "month_ratio": judged(month_rate(own, ref, in_overlap, alpha)),
        "own_record": own_record(own, spine, overlap, alpha, min_n=min_n),
    }
    reference = judged(of(per, C.REFERENCE_SENSOR)).join(both, KEY, "left_semi")
    off = tuple(s for s in range(len(C.SENSORS)) if s < new)
    held = lambda d: d.join(both, KEY, "left_semi")
    shares = kept_shares(full, judged(harmonize.fleet(per, r, off)), raw_codes(raw_totals(cells), raw, min_n), raw_codes(raw_totals(cells, tuple(s for s in range(len(C.SENSORS)) if s not in off)), raw, min_n), here)
    return {
        "continuity": evaluation.continuity(reference, candidates, least),
        "calibration": calibration(held(of(per, new)), held(ref), held(harmonize.fleet(per, r, (C.REFERENCE_SENSOR,))), of(per, C.REFERENCE_SENSOR)),
        "kept": shares,
        "national": national(of(per, new), ref, late.where(F.col("unit") == panel.COUNTRY)),
        "step": raw_step(cells.where(F.col("unit") != panel.COUNTRY), (window[0], held_out)).agg(F.count(F.lit(1)).alias("n"), F.avg("step").alias("raw")),
    }


def document(parts: dict[str, DataFrame], facts: dict[str, str], held_out: int) -> DataFrame:
    """One JSON text with the parts of a report, facts about the run, and a warning for each part that
    has nothing to say."""
    out, warnings = None, []
    for name, rows in sorted(parts.items()):
        row = rows.agg(F.array_sort(F.collect_list(F.struct(*sorted(rows.columns)))).alias(name))  # a few rows
        out = row if out is None else out.crossJoin(row)
        number = "n" if "n" in rows.columns else None
        if number:
            warnings.append(F.when(F.coalesce(F.aggregate(F.transform(name, lambda x: x["n"].cast("long")), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)) == 0, F.lit(f"{name} has no held-out cells from {held_out} on")))
    fixed = [F.lit(v).alias(k) for k, v in sorted(facts.items())]
    said = F.array_compact(F.array(*warnings)).alias("warnings")
    return out.select(F.to_json(F.struct(F.lit("validation").alias("schema"), *fixed, F.lit(held_out).alias("held_out_from"), *sorted(parts), said), {"ignoreNullFields": "false"}).alias("value"))
