"""Profiles with fallback, distances with missing measures, document scores and trials against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliometry.operators import documents

DIMS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def pages():
    rng = np.random.default_rng(11)
    rows = []
    for paper in range(40):
        for page in range(1, 9):
            base = rng.standard_normal()
            x = [abs(base + 0.3 * rng.standard_normal()), abs(base * 0.5 + rng.standard_normal()), float(rng.random())]
            if rng.random() < 0.15:
                x[int(rng.integers(3))] = None
            rows.append((paper, page, paper % 5 if paper != 7 else 99, "body" if page > 2 else "front", "one" if paper % 2 else "two", *x))
    rows += [(100, 1, 1, "odd", "one", 1.0, 1.0, 0.5), (101, 1, None, "body", "one", None, None, None), (101, 2, None, "body", None, 0.5, None, 0.2)]
    return rows


def quantile(v, q):
    return float(np.quantile(np.array(v), q))


def strata_of(r):
    named = []
    for name, cols in documents.LEVELS:
        values = [{"venue": r[2], "role": r[3], "layout": r[4]}[c] for c in cols]
        named.append("|".join([name, *[str(v) for v in values if v is not None]]))
    return named


def chi2(x, k):
    """By numerical integration of the density."""
    if x <= 0:
        return 1.0
    t = np.linspace(0, math.sqrt(x), 200_001)
    y = 2 * t ** (k - 1) * np.exp(-(t**2) / 2) / (2 ** (k / 2) * math.gamma(k / 2))
    return 1 - np.trapezoid(y, t)


def fitted(pages, least):
    by = {}
    for r in pages:
        for s in strata_of(r):
            by.setdefault(s, []).append(r)
    out = {}
    for s, rows in by.items():
        b = {}
        for i, _ in enumerate(DIMS):
            v = [r[5 + i] for r in rows if r[5 + i] is not None]
            if v:
                p10, p25, p50, p75, p90 = (quantile(v, q) for q in (0.1, 0.25, 0.5, 0.75, 0.9))
                iqr, wide = p75 - p25, p90 - p10
                scale = iqr if iqr > 1e-9 else wide / 2.563 if wide > 1e-9 else 1e-6
                b[i] = (p50, scale, p10 if iqr < 0.1 * wide else p25, p90 if iqr < 0.1 * wide else p75)
        z = [[max(-4, min(4, (r[5 + i] - b[i][0]) / b[i][1])) if r[5 + i] is not None and i in b else None for i in range(3)] for r in rows]
        full = np.array([q for q in z if None not in q]).reshape(-1, 3)
        m = np.eye(3)
        if len(full):
            pairs = [(0, 1), (0, 2), (1, 2)]
            with np.errstate(all="ignore"):
                r_ = [np.corrcoef(full[:, i], full[:, j])[0, 1] if len(full) > 1 and full[:, i].std() and full[:, j].std() else float("nan") for i, j in pairs]
                v_ = [np.var(full[:, i] * full[:, j], ddof=1) if len(full) > 1 else float("nan") for i, j in pairs]
            total = sum(x * x for x in r_)
            delta = max(0.0, min(1.0, sum(v_) / len(full) / total)) if total == total and total else float("nan")
            for (i, j), r in zip(pairs, r_, strict=True):
                value = (1 - delta) * r
                m[i, j] = m[j, i] = value if np.isfinite(value) else 0.0
        out[s] = {"b": b, "m": m, "usable": len({r[0] for r in rows}) >= least, "rows": rows}
    for st in out.values():
        scored = [measure(r, st) for r in st["rows"]]
        d = [x["d2"] for x in scored if x["d2"] is not None]
        st["d2_ref"] = quantile(d, 0.9) if d else None
        st["loss_ref"] = [quantile(v, 0.9) if (v := [x["loss"][i] for x in scored if x["loss"][i] is not None]) else None for i in range(3)]
    return out


def measure(r, st):
    z, loss = [None] * 3, [None] * 3
    for i, (center, scale, lo, hi) in st["b"].items():
        x = r[5 + i]
        if x is not None:
            z[i] = max(-4, min(4, (x - center) / scale))
            loss[i] = (x - hi) / scale if x > hi else 1.2 * (lo - x) / scale if x < lo else 0.0
    own = [i for i in range(3) if z[i] is not None]
    d2 = None
    if own:
        part = st["m"][np.ix_(own, own)]
        inverse = np.linalg.inv(part) if np.linalg.cond(part) < 1e12 else np.eye(len(own))
        v = np.array([z[i] for i in own])
        d2 = max(0.0, float(v @ inverse @ v))
    return {"loss": loss, "d2": d2, "k": len(own), "p": chi2(d2, len(own)) if own else None}


def scored(pages, model):
    out = []
    for r in pages:
        s = next((s for s in strata_of(r) if model[s]["usable"]), None)
        x = measure(r, model[s]) if s else {"loss": [None] * 3, "d2": None, "k": 0, "p": None}
        ref = model[s]["loss_ref"] if s else [None] * 3
        x["norm"] = [None if v is None else min(20.0, v / (ref[i] or 1.0)) for i, v in enumerate(x["loss"])]
        x["norm_d2"] = None if x["d2"] is None else x["d2"] / (model[s]["d2_ref"] or 1.0)
        out.append({"paper": r[0], "page": r[1], "role": r[3], "stratum": s, **x})
    return out


def pooled(v, n_ok):
    v = sorted((x for x in v if x is not None), reverse=True)
    k = max(1, round(0.05 * n_ok))
    return 0.5 * np.mean(v[:k]) + 0.5 * np.mean(v) if v else None


def document(rows):
    ok = [r for r in rows if r["stratum"]]
    parts = {d: pooled([r["norm"][i] for r in ok], len(ok)) for i, d in enumerate(DIMS)} | {"d2": pooled([r["norm_d2"] for r in ok], len(ok))}
    found = [v for v in parts.values() if v is not None]
    return (sum(found) / len(found) if found else None), parts


@pytest.fixture(scope="module")
def both(spark, pages):
    df = spark.createDataFrame(pages, "paper long, page long, venue long, role string, layout string, a double, b double, c double")
    profile = documents.fit(df, DIMS, least_papers=9)
    model = fitted(pages, 9)
    return df, profile, documents.page_scores(df, profile), scored(pages, model)


def close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-6 * max(1, abs(b)))


def test_page_scores_match_numpy(both):
    _, _, scores, want = both
    got = {(r.paper, r.page): r for r in scores.collect()}
    assert len(got) == len(want)
    for w in want:
        r = got[w["paper"], w["page"]]
        assert r.stratum == w["stratum"] and close(r.d2, w["d2"]) and close(r.norm_d2, w["norm_d2"]), (r, w)
        assert (r.p is None) == (w["p"] is None) and (r.p is None or abs(r.p - w["p"]) < 1e-6)
        assert all(close(a, b) for a, b in zip(r.norm or [None] * 3, w["norm"], strict=True))


def test_reports_match_numpy(both):
    _, profile, scores, want = both
    got = {r.paper: r for r in documents.reports(scores, profile).collect()}
    for paper, r in got.items():
        rows = [w for w in want if w["paper"] == paper]
        assert close(r.a_profile, document(rows)[0]) and r.n_pages == len(rows) and r.n_scored == sum(w["stratum"] is not None for w in rows)
        assert r.n_anomalous == sum(w["p"] is not None and w["p"] < 0.05 for w in rows)
        d = [w for w in rows if w["d2"] is not None]
        assert (r.top_page is None) == (not d) and (not d or r.top_page == min(d, key=lambda w: (-round(w["d2"], 6), w["page"]))["page"])


def test_chi_square_tail_of_any_degree(spark):
    r = spark.range(1).select(*[documents.chi2_upper(F.lit(x), F.lit(k), 8) for x, k in ((3.841, 1), (9.488, 4), (13.362, 8), (7.815, 3), (300.0, 5))]).first()
    assert np.allclose(list(r), [0.05, 0.05, 0.1, 0.05, 0.0], atol=1e-3)


def test_ladders(spark):
    df = spark.createDataFrame([("u", 0.8, 0.05), ("u", 1.0, 0.05), ("n", 0.0, 2.0), ("x", 1.0, 2.0)], "dim string, v0 double, scale double")
    got = documents.ladder(df, ("u",), ("n",)).collect()
    up = sorted((r.step, r.v) for r in got if r.dim == "u" and r.v0 == 0.8 and r.sign == 1)
    assert [v for _, v in up] == [0.85, 0.9, 0.95, 1.0]
    assert not [r for r in got if (r.dim == "u" and r.v0 == 1.0 and r.sign == 1) or (r.dim == "n" and r.sign == -1)]
    assert sorted(r.v for r in got if r.dim == "x" and r.sign == -1) == [-7.0, -3.0, -1.0, 0.0]


def test_trials(both, pages):
    df, profile, scores, want = both
    trials = documents.injection_trials(scores, profile, ("c",), ("a", "b"), 12).collect()
    assert len({r.paper for r in trials}) == 12 and all(r.delta > 0 for r in trials if r.monotone)
    model = fitted(pages, 9)
    raw = {(r[0], r[1]): r for r in pages}
    steps = {(r.paper, r.dim): r for r in documents.degradations(scores, profile, ("c",), ("a", "b"), 12).where("step = 4").collect()}
    for t in trials[:20]:
        rows = [dict(w) for w in want if w["paper"] == t.paper]
        before = document(rows)[0]
        target = next(w for w in rows if w["page"] == t.page)
        moved = list(raw[t.paper, t.page])
        moved[5 + DIMS.index(t.dim)] = steps[t.paper, t.dim].v
        st = model[target["stratum"]]
        x = measure(moved, st)
        target["norm"] = [None if v is None else min(20.0, v / (st["loss_ref"][i] or 1.0)) for i, v in enumerate(x["loss"])]
        target["norm_d2"] = x["d2"] / (st["d2_ref"] or 1.0)
        assert close(t.delta, document(rows)[0] - before)
        assert t["rank"] == 1 + sum(w["d2"] is not None and w["d2"] > x["d2"] + 1e-9 for w in rows if w["page"] != t.page)


def test_weights_of_trials(both):
    _, profile, scores, _ = both
    trials = documents.ablation_trials(scores, profile, ("c",), ("a", "b"), 30)
    rows = trials.collect()
    assert len({r.paper for r in rows}) == 30 and all(r.delta >= -1e-9 for r in rows if r.measure == r.dim)
    raw = {}
    for d in DIMS:
        signal = sorted(r.delta for r in rows if r.measure == d == r.dim)
        noise = sorted(max(0.0, r.before) for r in rows if r.measure == d != r.dim)
        s, n = (signal[len(signal) // 2] if signal else None), (noise[round(0.9 * (len(noise) - 1))] if noise else 0.0)
        raw[d] = 4.0 if s is None else max(0.25, min(4.0, s / (n + 0.05)))
    mean = sum(raw.values()) / 3
    got = {r.dim: r.weight for r in documents.trial_weights(trials, DIMS).collect()}
    assert all(abs(got[d] - max(0.25, min(4.0, raw[d] / mean))) < 1e-3 for d in DIMS)
    ends = {r.dim: r for r in documents.weights_bootstrap(trials, DIMS, 20).collect()}
    assert set(ends) == set(DIMS) and all(0.25 <= r.low <= r.high <= 4 for r in ends.values())
