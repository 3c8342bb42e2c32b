"""Quantiles of numbers that tasks make, and what rests on them: whole trial sets, all roles, patterns that no training page has."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliometry.operators import documents, series, statistics
from foliometry.plans import all as plans
from foliometry.plans import registry
from conftest import DATA

DIMS = ["a", "b", "c"]


@pytest.mark.parametrize("most", [300_000, 3])
def test_quantiles_of_series(spark, monkeypatch, most):
    monkeypatch.setattr("foliometry.operators.quantiles.MOST", most)
    made = lambda batch: tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
    rng = np.random.default_rng(5)
    rows = [(int(p), float(v)) for p in range(4) for v in (rng.normal(0, 10.0**p, 500), np.zeros(300), 1000 + rng.random(50) * 1e-9)[p % 3 if p < 3 else 0]]
    rows += [(5, v) for v in (-0.0, 0.0, -1.5, math.inf, -math.inf, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "part long, value double").repartition(5)
    qs = (0.0, 0.1, 0.5, 0.9, 1.0)
    by = {p: np.array([v for k, v in rows if k == p]) for p in {k for k, _ in rows}}
    got = {r.series: r for r in series.quantiles(df, made, qs).collect()}
    assert set(got) == set(by)
    for p, v in by.items():
        assert got[p].n == len(v)
        with np.errstate(invalid="ignore"):
            want = np.quantile(v, qs, method="linear") if p != 5 else np.array([-math.inf, np.nan, 0.0, np.nan, math.inf])
        assert all(a == b or abs(a - b) <= 1e-12 * max(1, abs(b)) for a, b in zip(got[p].p, want, strict=True) if b == b), p
    deal = spark.createDataFrame([(p, s) for p in range(4) for s in (10, 20 + p % 2)], "part long, series long")
    both = {r.series: r for r in series.quantiles(df.where("part < 4"), made, (0.25,), deal).collect()}
    want = {10: (0, 1, 2, 3), 20: (0, 2), 21: (1, 3)}
    assert {s: both[s].n for s in both} == {s: sum(len(by[p]) for p in ps) for s, ps in want.items()}
    assert all(abs(both[s].p[0] - np.quantile(np.concatenate([by[p] for p in ps]), 0.25)) < 1e-9 for s, ps in want.items())
    assert series.quantiles(df.where("part < 0"), made, (0.5,)).collect() == []


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(3)
    rows = [(p, k, p % 4, "body" if k > 2 else "front", "one", *map(float, np.abs(rng.standard_normal(2))), float(rng.random())) for p in range(90) for k in range(1, 6)]
    df = spark.createDataFrame(rows, "paper long, page long, venue long, role string, layout string, a double, b double, c double")
    profile = documents.fit(df, DIMS, least_papers=9)
    return df, profile, documents.page_scores(df, profile).cache()


def test_trials_take_every_paper(fitted):
    """Round four took 40 and 60 papers, and one measure of each."""
    _, profile, scores = fitted
    ablated = {(r.paper, r.dim) for r in documents.ablation_trials(scores, profile, ("c",), ("a", "b")).select("paper", "dim").distinct().collect()}
    assert {p for p, _ in ablated} == set(range(90)) and {d for _, d in ablated} == set(DIMS) and len(ablated) > 200
    assert {r.paper for r in documents.injection_trials(scores, profile, ("c",), ("a", "b")).select("paper").collect()} == set(range(90))


def test_changed_values_are_pooled_as_if_sorted_anew(spark, fitted):
    _, profile, scores = fitted
    rng = np.random.default_rng(9)
    lists = [sorted(map(float, rng.integers(0, 5, int(rng.integers(1, 60)))), reverse=True) for _ in range(200)]
    rows = []
    for i, v in enumerate(lists):
        k = min(len(v), max(1, round(0.05 * 60)))
        rows.append((i, len(v), k, float(sum(v)), float(sum(v[:k])), v[k - 1], v[k] if k < len(v) else None, float(rng.choice(v)), float(rng.integers(0, 7))))
    df = spark.createDataFrame(rows, "i long, size int, k int, sum double, top double, last double, next double, old double, new double")
    for r in df.withColumn("p", documents.replaced(F.col("old"), F.col("new"))).collect():
        v = list(lists[r.i])
        v.remove(r.old)
        v = sorted([*v, r.new], reverse=True)
        assert abs(r.p - (0.5 * np.mean(v[: r.k]) + 0.5 * np.mean(v))) < 1e-12


def test_patterns_that_no_training_page_has(spark, fitted):
    """Such a page had distance 0: its inverse was missing."""
    df, profile, scores = fitted
    new = df.where("page = 3").withColumn("b", F.lit(None).cast("double"))
    got = {r.paper: r for r in documents.page_scores(new, profile).collect()}
    full = {r.stratum: np.array(r.inverse).reshape(3, 3) for r in profile.inverses.where("pattern = 7").collect()}
    bands = {r.stratum: r for r in profile.strata.collect()}
    for r in new.collect():
        found = got[r.paper]
        s = bands[found.stratum]
        z = np.array([max(-4, min(4, (x - c) / w)) for x, c, w in ((r.a, s.center[0], s.scale[0]), (r.c, s.center[2], s.scale[2]))])
        m = np.linalg.inv(np.linalg.inv(full[found.stratum])[np.ix_([0, 2], [0, 2])])
        assert found.k == 2 and abs(found.d2 - max(0.0, z @ m @ z)) < 1e-9


def test_page_losses_of_every_role(spark, duck):
    """Round four read role A alone."""
    plans.load()
    n = duck.execute("SELECT count(*) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey").fetchone()[0]
    assert registry.run("page_loss_rows")(spark, DATA).count() == n


def test_distances_look_no_cell_up_by_name(spark):
    z = spark.createDataFrame([(1, 1, "A", 1.0, 2.0), (1, 2, "A", -1.0, 0.5)], "paper long, page long, role string, a double, b double")
    m = spark.createDataFrame([("A", i, j, v) for i, j, v in (("a", "a", 2.0), ("a", "b", 0.5), ("b", "a", 0.5), ("b", "b", 1.0))], "role string, i string, j string, v double")
    out = statistics.mahalanobis(z, m, "role", ["a", "b"])
    assert sorted(r.d2 for r in out.collect()) == [1.75, 8.0]
    assert "map<" not in out._jdf.queryExecution().toString() and "entries" not in out._jdf.queryExecution().toString()
