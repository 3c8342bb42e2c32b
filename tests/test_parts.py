"""Quantiles of strata made of parts, wide scores and rounding, against numpy and SQL."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliometry.operators import profiles, quantiles
from foliometry.operators.quantiles import Parts, percentiles
from foliometry.plans import all as plans
from foliometry.plans import registry

from helpers import same

plans.load()
QS = (0.0, 0.1, 0.5, 0.95, 1.0)


@pytest.mark.parametrize("kind", ["even", "skewed", "few", "far"])
def test_overlapping_strata_equal_numpy(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "MOST", 40)
    dice = random.Random(kind)
    draw = {"even": lambda: dice.random(), "skewed": lambda: dice.lognormvariate(0, 4), "few": lambda: float(dice.randrange(4)), "far": lambda: dice.choice([1e15, *[dice.random() * 1e-6] * 60])}[kind]
    rows = [(dice.randrange(3), dice.choice(["a", "b", None]), draw()) for _ in range(900)]
    deal = lambda df: df.withColumn("out", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)]))).where("out <> part").drop("part")
    df = spark.createDataFrame(rows, "part long, s string, value double")
    got = percentiles(df, ["out", "s"], QS, parts=Parts(["out", "s"], ["part", "s"], ["s"], deal)).collect()
    assert {(r.out, r.s) for r in got} == {(k, s) for k in range(3) for s in ("a", "b", None)}
    for r in got:
        own = [v for p, s, v in rows if p != r.out and s == r.s]
        assert r.n == len(own) and np.allclose(r.p, np.quantile(own, QS), rtol=1e-12)


def test_pooled_lists_equal_pooled(spark):
    dice = random.Random(2)
    rows = [(p, *[None if dice.random() < 0.2 else float(dice.randrange(9)) for _ in "ab"]) for p in range(6) for _ in range(p * 17 + 1)] + [(9, None, 1.0)]
    df = spark.createDataFrame(rows, "paper long, a double, b double")
    want = {(r.paper, r.dim): r.pooled for r in profiles.pooled(df.unpivot("paper", ["a", "b"], "dim", "v").where("v is not null"), ["paper", "dim"], "v").collect()}
    lists, value = profiles.pooled_lists(["a", "b"])
    got = {(r.paper, d): r[d] for r in df.groupBy("paper").agg(*lists).select("paper", *[c.alias(d) for d, c in value.items()]).collect() for d in "ab" if r[d] is not None}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_losses_of_arrivals_round_as_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE supplier AS SELECT range AS s_suppkey, 1 AS s_nationkey FROM range(2)")
    con.execute("""CREATE TABLE lineitem AS SELECT range % 2 AS l_suppkey, range AS l_orderkey, 1 AS l_linenumber, 1 AS l_partkey, (1 + range + CASE WHEN range > 7500 THEN 0.005 * (range % 9 + 0.5) ELSE 0 END)::DOUBLE AS l_quantity,
        (1 + range)::DOUBLE AS l_extendedprice, 0.01::DOUBLE AS l_discount, 0.01::DOUBLE AS l_tax, 'A' AS l_returnflag, 'F' AS l_linestatus FROM range(10001)""")
    for name in ("supplier", "lineitem"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    same(registry.run("incremental_scoring")(spark, str(tmp_path)), con, registry.SQL["incremental_scoring"])
