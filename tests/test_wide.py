"""Quantiles of wide rows against sorted lists."""

import random

from pyspark.sql import functions as F

from foliometry.operators import quantiles
from foliometry.operators.flatten import to_long

QS = (0.0, 0.1, 0.5, 0.9, 1.0)
SCHEMA = "role string, a double, b double, c double, d double"


def wanted(values):
    values = sorted(values)
    at = [q * (len(values) - 1) for q in QS]
    return [values[int(x)] * (1 - x % 1) + values[min(int(x) + 1, len(values) - 1)] * (x % 1) for x in at]


def rows(n=3000):
    rnd = random.Random(5)
    outlier = lambda i: 1e12 if i == 7 else rnd.random()  # noqa: E731 (all but one value in one bin of each pass)
    return [(rnd.choice(["A", "B", None]), rnd.gauss(0, 1e5), float(rnd.randrange(4)), None if i % 3 else -rnd.random() * 1e-9, outlier(i)) for i in range(n)]


def test_wide_rows_are_searched_without_copies(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "MOST", 20)
    monkeypatch.setattr(quantiles, "percentiles", None)  # the long form is not taken
    data = [*rows(), ("C", 1.0, None, 2.0, 3.0)]
    got = {(r.role, r.dim): (r.n, r.p) for r in quantiles.wide_percentiles(spark.createDataFrame(data, SCHEMA), ["role"], ["a", "b", "c", "d"], QS).collect()}
    lists = {}
    for role, *values in data:
        for dim, v in zip("abcd", values, strict=True):
            if v is not None:
                lists.setdefault((role, dim), []).append(v)
    assert got.keys() == lists.keys() and ("C", "b") not in got
    for k, values in lists.items():
        assert got[k][0] == len(values) and all(abs(a - b) <= 1e-15 * abs(b) for a, b in zip(got[k][1], wanted(values), strict=True)), k


def test_wide_rows_that_are_not_finite_equal_the_long_form(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "MOST", 20)
    df = spark.createDataFrame([*rows(200), ("A", float("inf"), float("nan"), 1.0, 1.0)], SCHEMA)
    one = quantiles.wide_percentiles(df, ["role"], list("abcd"), (0.5,)).select("role", "dim", "n", F.col("p").cast("string").alias("p"))
    two = quantiles.percentiles(to_long(df, ["role"], list("abcd")), ["role", "dim"], (0.5,)).select("role", "dim", "n", F.col("p").cast("string").alias("p"))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_rollup_takes_wide_rows_and_null_roles(spark):
    from foliometry.operators import profiles

    df = spark.createDataFrame([(1, "A", 1.0, None), (1, "A", 2.0, None), (1, None, 6.0, 4.0), (2, "B", None, None)], "paper long, role string, a double, b double")
    got = {(r.paper, r.role, r.dim): (r.n, r.median, r["mean"], r.max, r.p90) for r in profiles.rollup(df, ["a", "b"]).collect()}
    assert got == {(1, "A", "a"): (2, 1.5, 1.5, 2.0, 1.9), (1, None, "a"): (1, 6.0, 6.0, 6.0, 6.0), (1, None, "b"): (1, 4.0, 4.0, 4.0, 4.0), (1, "all", "a"): (3, 2.0, 3.0, 6.0, 5.2), (1, "all", "b"): (1, 4.0, 4.0, 4.0, 4.0)}
