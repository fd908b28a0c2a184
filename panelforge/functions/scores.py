"""Formulas shared by all panels: normal distribution, combination, verdicts, intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    return reduce(lambda total, c: total * x + c, coefficients[1:], F.lit(coefficients[0]))


def rounded(x: Column, places: int) -> Column:
    """x to so many places by its scaled double, as SQL engines do: 0.5045, which is a little less than
    that, becomes 0.504, where Spark's own round goes by the printed digits and gives 0.505."""
    scale = float(10**places)
    return F.round(x * scale) / scale


def normal_cdf(x: Column) -> Column:
    """Distribution function of the standard normal, to about 1e-15; null for null."""
    z = F.abs(x)
    density = F.exp(-z * z / 2)
    near = density * _polynomial(z, C.NORMAL_TOP) / _polynomial(z, C.NORMAL_BOTTOM)
    fraction = reduce(lambda below, k: z + k / below, (4.0, 3.0, 2.0, 1.0), z + 0.65)
    far = density / fraction / C.NORMAL_ROOT
    tail = F.when(z > 37, 0.0).when(z < C.NORMAL_SWITCH, near).otherwise(far)
    return F.when(x.isNull(), None).when(x > 0, 1 - tail).otherwise(tail)


def rate(detections: Column, clear: Column) -> Column:
    """Detections per 1000 km2-days of clear view, above a floor; null without clear view."""
    return F.try_divide(detections, clear / 1000) + C.RATE_FLOOR


def night_share(night: Column, detections: Column) -> Column:
    return F.when(detections == 0, 0.5).otherwise(F.try_divide(night, detections))


def valid_cell(active: Column, coverage: Column, land: Column, detections: Column, min_coverage: float = C.MIN_COVERAGE, min_land: float = C.MIN_LAND) -> Column:
    return F.coalesce(active & (coverage >= min_coverage) & (land >= min_land) & detections.isNotNull(), F.lit(False))


def p_above(mu: Column, sigma: Column, level: Column) -> Column:
    """Probability that the estimate exceeds a level given on the plain scale."""
    return F.when(mu.isNull() | sigma.isNull() | level.isNull(), None).when(level <= 0, 1.0).otherwise(1 - normal_cdf((F.ln(level) - mu) / sigma))


def p_below(mu: Column, sigma: Column, level: Column) -> Column:
    return F.when(mu.isNull() | sigma.isNull() | level.isNull(), None).when(level <= 0, 0.0).otherwise(normal_cdf((F.ln(level) - mu) / sigma))


def verdict(mu: Column, sigma: Column, p_hi: Column, p_lo: Column, q10: Column, top: Column, n: Column, min_n: int = C.MIN_BASELINE_N, q_min: float = C.Q_MIN) -> Column:
    """Code of an estimate against its baseline; the first matching rule wins. p_hi and p_lo (from
    p_above and p_below) are best columns already, as each is used several times."""
    return (
        F.when(mu.isNull() | sigma.isNull(), C.NOT_OBSERVED)
        .when(n < min_n, C.INSUFFICIENT)
        .when(F.exp(mu - C.Z80 * sigma) > top, C.RECORD)
        .when(p_hi >= C.P_SURE, C.HIGH)
        .when(p_hi >= C.P_MAYBE, C.MAYBE_HIGH)
        .when((p_lo >= C.P_SURE) & (q10 >= q_min), C.LOW)
        .when((p_lo >= C.P_MAYBE) & (q10 >= q_min), C.MAYBE_LOW)
        .otherwise(C.TYPICAL)
    )


def raw_class(value: Column, q10: Column, q90: Column, n: Column, min_n: int = C.MIN_BASELINE_N) -> Column:
    return F.when(value.isNull(), C.NOT_OBSERVED).when(n < min_n, C.INSUFFICIENT).when(value > q90, C.HIGH).when(value < q10, C.LOW).otherwise(C.TYPICAL)


def class3(code: Column) -> Column:
    return F.when(code == C.LOW, 0).when(code.isin(C.HIGH, C.RECORD), 2).otherwise(1)


def judged(code: Column) -> Column:
    return code.between(C.LOW, C.RECORD)


def intervals(mu: Column, sigma: Column) -> dict[str, Column]:
    return {"h": F.exp(mu), "lo80": F.exp(mu - C.Z80 * sigma), "hi80": F.exp(mu + C.Z80 * sigma), "lo95": F.exp(mu - C.Z95 * sigma), "hi95": F.exp(mu + C.Z95 * sigma)}


def query_verdict(coverage: Column, probability: Column) -> Column:
    """Label of the interactive half, which has no low side."""
    return (
        F.when(coverage.isNull(), "Not assessed")
        .when(coverage < 30, "Not observed")
        .when(probability >= 0.8, "Unusually high")
        .when(probability >= 0.6, "Possibly unusual")
        .otherwise("Within usual range")
    )


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")
