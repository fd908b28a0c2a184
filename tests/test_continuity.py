"""The validation report against plain Python."""

import json
import math

import numpy as np
from pyspark.sql import functions as F
from test_harmonize import FLOOR, TRAIN, WINDOW, Z80, _estimates, _given, _r, _verdict

from panelforge.functions import constants as C
from panelforge.operators import bridge, continuity

YEARS, HELD, OVERLAP, CLEAR, LAND = range(2008, 2019), 2016, (2012, 2017), 1500.0, 2000.0


def _class3(code):
    return 0 if code == C.LOW else 2 if code in (C.HIGH, C.RECORD) else 1


def _judged(code):
    return C.LOW <= code <= C.RECORD


def _kappa(pairs):
    n = len(pairs)
    same = sum(a == b for a, b in pairs) / n
    by_chance = sum(sum(a == c for a, _ in pairs) * sum(b == c for _, b in pairs) for c in range(3)) / n**2
    return (same - by_chance) / (1 - by_chance)


def _combined(per, r, off=()):
    out = {}
    for (s, *key), (mu, sigma) in per.items():
        if s not in off:
            w, m, n = out.get(tuple(key), (0, 0, 0))
            out[tuple(key)] = w + 1 / sigma**2, m + mu / sigma**2, n + 1
    return {k: (m / w, math.sqrt((1 + (n - 1) * r) / w)) for k, (w, m, n) in out.items()}


def _base(values, window, u, y, p):
    return [values[u, k] for c in range(window[0], window[1] + 1) if c != y for k in (c * 46 + p - 1, c * 46 + p, c * 46 + p + 1) if (u, k) in values]


def test_report_against_plain_python(spark):
    cells, models = _given(np.random.default_rng(21), YEARS)
    df = spark.createDataFrame(cells, "s int, unit int, year int, p int, d long, rho double, ns double, sn double, cs double, stratum string").withColumns({"clear": F.lit(CLEAR), "land": F.lit(LAND)})
    # the country: unit -1, by the pool, with a baseline of its own
    whole = [(s, -1, y, p, n * 3, n * 3 / 1.5 + FLOOR, 0.3, math.sin(p * 2 * math.pi / 46), math.cos(p * 2 * math.pi / 46), None) for s, u, y, p, n, *_ in cells if u == 0]
    df = df.unionByName(spark.createDataFrame(whole, "s int, unit int, year int, p int, d long, rho double, ns double, sn double, cs double, stratum string").withColumns({"clear": F.lit(CLEAR), "land": F.lit(LAND)}))
    spine = spark.createDataFrame([(u, y, p) for u in (-1, 0, 1, 2) for y in YEARS for p in range(1, 47)], "unit int, year int, p int")
    parts = continuity.report(df, spark.createDataFrame(models, bridge.SCHEMA), spine, WINDOW, TRAIN, OVERLAP, HELD, draws=4, min_n=10, least=5)
    got = {name: [r.asDict() for r in rows.collect()] for name, rows in parts.items()}

    per, d = _estimates(cells, models), {c[:4]: c[4] for c in cells}
    rho = {c[:4]: c[5] for c in cells}
    noise = float(np.median([m[4] for m in models if m[:2] == ("N-A", "pool")]))
    r = _r(per, 100)
    fleet = _combined(per, r)
    line = {(u, y * 46 + p): math.exp(m) for (u, y, p), (m, _) in fleet.items()}
    base = {k: _base(line, WINDOW, *k) for k in ((u, y, p) for u in range(3) for y in YEARS for p in range(1, 47))}
    both = [k for k in base if k[1] >= HELD and (3, *k) in rho and (1, *k) in rho]
    reference = {k: _verdict(*per[1, *k], base[k]) for k in both}
    reference = {k: c for k, c in reference.items() if _judged(c)}

    overlap = [(k, d[1, *k], d[3, *k], rho[3, *k]) for k in base if OVERLAP[0] <= k[1] <= OVERLAP[1] and (3, *k) in rho and (1, *k) in rho]
    shift = math.log(sum(x[1] for x in overlap) / sum(x[3] * CLEAR / 1000 for x in overlap))
    months = {}
    for k, a, b, _ in overlap:
        months.setdefault(min(int((k[2] - 1) * 8 // 30.5), 11), []).append((a, b))
    months = {m: sum(a for a, _ in x) / max(1, sum(b for _, b in x)) for m, x in months.items() if len(x) >= 30}
    total = {}
    for (s, u, y, p), n in d.items():
        total[u, y * 46 + p] = total.get((u, y * 46 + p), 0) + n
    raw_base = {k: _base(total, WINDOW, *k) for k in base}
    own = {(u, y * 46 + p): x for (s, u, y, p), x in rho.items() if s == 3}
    own_base = {k: _base(own, OVERLAP, *k) for k in base}

    def raw_code(value, b):
        if len(b) < 10:
            return C.INSUFFICIENT
        low, high = np.percentile(b, [10, 90])
        return C.HIGH if value > high else C.LOW if value < low else C.TYPICAL

    def by_month(k):
        ratio = months.get(min(int((k[2] - 1) * 8 // 30.5), 11))
        if ratio is None:
            return C.NOT_OBSERVED
        rate = d[3, *k] * ratio / (LAND / 1000) + FLOOR
        return _verdict(math.log(rate), math.sqrt(1 / (rate * LAND / 1000) + noise), base[k])

    spread = lambda k: math.sqrt(1 / (d[3, *k] + 0.5) + noise)
    codes = {
        "bridges": lambda k: _verdict(*per[3, *k], base[k]),
        "raw_counts": lambda k: raw_code(d[3, *k], raw_base[k]),
        "constant_ratio": lambda k: _verdict(shift + math.log(rho[3, *k]), spread(k), base[k]),
        "month_ratio": by_month,
        "own_record": lambda k: C.INSUFFICIENT if len(own_base[k]) < 10 else _verdict(math.log(rho[3, *k]), spread(k), own_base[k]),
    }
    for row in got["continuity"]:
        found = {k: codes[row["candidate"]](k) for k in reference}
        pairs = [(_class3(reference[k]), _class3(c)) for k, c in found.items() if _judged(c)]
        assert row["n"] == len(pairs) and abs(row["judged_share"] - len(pairs) / len(reference)) < 1e-9, row
        assert len(pairs) < 5 or abs(row["kappa"] - _kappa(pairs)) < 1e-9, row
    assert {r["candidate"]: r["n"] > 20 for r in got["continuity"]} == dict.fromkeys(codes, True)

    truth = lambda k: math.log(rho[1, *k])
    z = [((per[3, *k][0] - truth(k)) / math.sqrt(per[3, *k][1] ** 2 + 1 / (d[1, *k] + 0.5)), math.exp(per[3, *k][0]) * CLEAR / 1000) for k in both]
    without = _combined(per, r, (1,))
    fz = [(without[k][0] - truth(k)) / math.sqrt(without[k][1] ** 2 + per[1, *k][1] ** 2) for k in both if k in without]
    shares = {row["cells"]: (row["n"], row["share80"]) for row in got["calibration"]}
    for name, values in {"all": [x for x, _ in z], "informative": [x for x, e in z if e >= 3], "fleet without reference": fz}.items():
        assert shares[name][0] == len(values) and abs(shares[name][1] - sum(abs(x) <= Z80 for x in values) / len(values)) < 1e-9

    here = [k for k in base if k[1] >= HELD and (3, *k) in rho]
    few = _combined(per, r, (0, 1, 2))
    stays = {k: (_class3(_verdict(*fleet[k], base[k])), _class3(_verdict(*few[k], base[k]))) for k in here if _judged(_verdict(*fleet[k], base[k])) and k in few}
    late = {}
    for (s, u, y, p), n in d.items():
        if s >= 3:
            late[u, y, p] = late.get((u, y, p), 0) + n
    raws = {k: (_class3(raw_code(total[k[0], k[1] * 46 + k[2]], raw_base[k])), _class3(raw_code(late[k], raw_base[k]))) for k in here if len(raw_base[k]) >= 10}
    kept = {row["unit"]: row for row in got["kept"]}
    for unit in (-1, 0, 1, 2):
        a = [x == y for k, (x, y) in stays.items() if unit in (-1, k[0])]
        b = [x == y for k, (x, y) in raws.items() if unit in (-1, k[0])]
        row = kept[unit]
        assert (row["n"], row["raw_n"]) == (len(a), len(b)) and abs(row["adjusted"] - sum(a) / len(a)) < 6e-5 and abs(row["raw"] - sum(b) / len(b)) < 6e-5

    country = _estimates(whole, models)
    rates = {c[:4]: c[5] for c in whole}
    pairs = [(country[3, *k], math.log(rates[1, *k])) for (s, *k) in country if s == 3 and k[1] >= HELD and (1, *k) in rates]
    (row,) = got["national"]
    assert row["n"] == len(pairs) > 20 and abs(row["pearson"] - np.corrcoef([m for (m, _), _ in pairs], [t for _, t in pairs])[0, 1]) < 1e-9
    assert abs(row["bias"] - np.mean([m - t for (m, _), t in pairs])) < 1e-9

    steps = [math.log((sum(d[s, *k] for s in (0, 1, 2)) + 0.5) / (d[0, *k] + d[1, *k] + 0.5)) for k in base if k[1] <= HELD and all((s, *k) in d for s in (0, 1, 2))]
    assert got["step"][0]["n"] == len(steps) and abs(got["step"][0]["raw"] - np.mean(steps)) < 1e-9

    text = json.loads(continuity.document(parts, {"reference": "A"}, HELD).first()["value"])
    assert text["schema"] == "validation" and text["warnings"] == [] and text["held_out_from"] == HELD and len(text["continuity"]) == 5
    nothing = continuity.document({"continuity": parts["continuity"].withColumn("n", F.lit(0)), "step": parts["step"].limit(0)}, {}, HELD)
    assert len(json.loads(nothing.first()["value"])["warnings"]) == 2
