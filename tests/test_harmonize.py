"""Cells of five sensors to verdicts, against plain Python."""

import math

import numpy as np
import pytest

from panelforge.functions import constants as C
from panelforge.operators import bridge, harmonize

YEARS, WINDOW, TRAIN = range(2008, 2016), (2008, 2014), (2010, 2013)
Z80, FLOOR = 1.2815515655446004, 0.01


def _given(rng, years=YEARS):
    """Cells s, unit, year, p, d, rho, ns, sn, cs, stratum and models of all bridges but J2-J1."""
    cells = []
    for s in range(5):
        for unit in range(3):
            for year in years:
                for p in range(1, 47):
                    if rng.random() < 0.75 and (s, year) > (3, 2011) or s in (0, 1, 2) and rng.random() < 0.8:
                        d = int(rng.poisson(3 + 12 * (p in (10, 11, 12))))
                        angle = p * 2 * math.pi / 46
                        cells.append((s, unit, year, p, d, d / 1.5 + FLOOR, 0.25, math.sin(angle), math.cos(angle), ("forest", "cropland", None)[unit]))
    models = []
    for name in ("T-A", "N-A", "J1-N"):
        for key in ("pool", "forest"):
            models += [(name, key, k, [rng.normal(0, 0.1), rng.normal(0.9, 0.05), 0.05, 0.1, -0.1], float(rng.uniform(0.1, 0.3)), 1, 500) for k in range(4)]
    return cells, models


def _estimates(cells, models):
    by = {}
    for name, key, _, beta, alpha, *_ in models:
        by.setdefault((name, key), []).append((beta, alpha))
    noise = float(np.median([a for _, a in by["N-A", "pool"]])) if ("N-A", "pool") in by else 0.3
    chains = {0: ["T-A"], 1: [], 2: ["N-A"], 3: ["J1-N", "N-A"], 4: ["J2-J1", "J1-N", "N-A"]}
    out = {}
    for s, unit, year, p, d, rho, ns, sn, cs, stratum in cells:
        if not all((link, "pool") in by for link in chains[s]):
            continue
        if not chains[s]:
            out[s, unit, year, p] = math.log(rho), math.sqrt(1 / (d + 0.5) + noise)
            continue
        x, v = np.full(4, math.log(rho)), 1 / (d + 0.5)
        for link in chains[s]:
            draws = by.get((link, stratum)) or by[link, "pool"]
            b = np.array([beta for beta, _ in draws])
            x = np.log(np.exp(np.clip(b[:, 0] + b[:, 1] * x + b[:, 2] * ns + b[:, 3] * sn + b[:, 4] * cs, -20, 12)) + FLOOR)
            v = np.median(b[:, 1]) ** 2 * v + np.median([a for _, a in draws])
        out[s, unit, year, p] = x.mean(), math.sqrt(x.var(ddof=1) + v)
    return out


def _r(per, least):
    rows = [(per[0, u, y, p], per[2, u, y, p], per[1, u, y, p]) for (s, u, y, p) in per if s == 1 and TRAIN[0] <= y <= TRAIN[1] and (0, u, y, p) in per and (2, u, y, p) in per]
    if len(rows) < least:
        return 0.3
    for step in range(10):
        hits = 0
        for (m1, s1), (m2, s2), (truth, noise) in rows:
            w1, w2 = 1 / s1**2, 1 / s2**2
            sigma = math.sqrt((1 + step / 10) / (w1 + w2))
            hits += abs((w1 * m1 + w2 * m2) / (w1 + w2) - truth) <= Z80 * math.sqrt(sigma**2 + noise**2)
        if hits / len(rows) >= 0.8:
            return step / 10
    return 0.9


def _verdict(mu, sigma, base):
    cdf = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    if len(base) < 10:
        return C.INSUFFICIENT
    q10, q90 = np.percentile(base, [10, 90])
    high, low = 1 - cdf((math.log(q90) - mu) / sigma), cdf((math.log(q10) - mu) / sigma)
    if math.exp(mu - Z80 * sigma) > max(base):
        return C.RECORD
    if high >= 0.6:
        return C.HIGH if high >= 0.9 else C.MAYBE_HIGH
    if low >= 0.6 and q10 >= 0.5:
        return C.LOW if low >= 0.9 else C.MAYBE_LOW
    return C.TYPICAL


@pytest.mark.parametrize("with_reference_bridge,least", [(True, 100), (True, 10_000)])
def test_verdicts_against_plain_python(spark, with_reference_bridge, least):
    cells, models = _given(np.random.default_rng(11))
    df = spark.createDataFrame(cells, "s int, unit int, year int, p int, d long, rho double, ns double, sn double, cs double, stratum string")
    spine = spark.createDataFrame([(u, y, p) for u in range(3) for y in YEARS for p in range(1, 47)], "unit int, year int, p int")
    got = {(r["unit"], r["year"], r["p"]): r for r in harmonize.verdicts(df, spark.createDataFrame(models, bridge.SCHEMA), spine, WINDOW, TRAIN, draws=4, min_n=10, least=least).collect()}
    per = _estimates(cells, models)
    r = _r(per, least)
    combined = {}
    for key in got:
        found = [per[s, *key] for s in range(5) if (s, *key) in per]
        if found:
            w = [1 / sigma**2 for _, sigma in found]
            combined[key] = sum(a * m for a, (m, _) in zip(w, found)) / sum(w), math.sqrt((1 + (len(found) - 1) * r) / sum(w))
    line = {(u, y * 46 + p): math.exp(m) for (u, y, p), (m, _) in combined.items()}
    codes = []
    for (u, y, p), row in got.items():
        if (u, y, p) not in combined:
            assert row["mu"] is None and row["code"] == C.NOT_OBSERVED
            continue
        mu, sigma = combined[u, y, p]
        base = [line[u, k] for c in range(WINDOW[0], WINDOW[1] + 1) if c != y for k in (c * 46 + p - 1, c * 46 + p, c * 46 + p + 1) if (u, k) in line]
        assert abs(row["mu"] - mu) < 1e-9 and abs(row["sigma"] - sigma) < 1e-9 and row["n"] == len(base)
        codes.append((row["code"], _verdict(mu, sigma, base)))
    assert all(a == b for a, b in codes) and len({a for a, _ in codes}) >= 4
    assert len(got) == 3 * len(YEARS) * 46


def test_reference_noise_is_the_pools_median(spark):
    _, models = _given(np.random.default_rng(12))
    pool = [m[4] for m in models if m[:2] == ("N-A", "pool")]
    assert abs(bridge.reference_alpha(spark.createDataFrame(models, bridge.SCHEMA)).first()["alpha"] - np.median(pool)) < 1e-12
    assert bridge.reference_alpha(spark.createDataFrame([m for m in models if m[0] != "N-A"], bridge.SCHEMA)).first()["alpha"] == 0.3
