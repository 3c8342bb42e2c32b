"""Closed-form checks of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliometry.functions import scalar, text
from foliometry.operators import aggregates, evaluation, profiles, statistics, windows


def test_quantiles_of_one_to_hundred(spark):
    r = aggregates.quantiles(spark.range(1, 101).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("value")), ["k"]).first()
    assert (r.p50, r.p10, r.mean, r.n) == (50.5, 10.9, 50.5, 100)


@pytest.mark.parametrize(("rank", "want"), [(lambda: aggregates.floor_rank(0.5), 4.0), (lambda: aggregates.round_rank(0.5), 3.0), (aggregates.upper_median_rank, 4.0), (lambda: aggregates.truncated_rank(0.25), 2.0)])
def test_index_quantiles(spark, rank, want):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 5, 6)], "k string, value double")
    assert aggregates.at_ranks(df, ["k"], {"q": rank()}).first().q == want


def test_index_quantiles_count_repeats(spark):
    df = spark.createDataFrame([("a", 1.0)] * 9 + [("a", 5.0)], "k string, value double")
    assert aggregates.at_ranks(df, ["k"], {"q": aggregates.floor_rank(0.8)}).first().q == 1.0


def test_top_share_is_half_even_and_at_least_one(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(50)], "k string, value double")
    r = aggregates.top_share(df, ["k"]).first()
    assert (r.k, r.top_mean) == (2, 48.5)


@pytest.mark.parametrize(("series", "ok"), [([1, 1, 0.99999, 1.5], True), ([1, 0.9, 1.5], False), ([1, 1, 1], False)])
def test_monotone(spark, series, ok):
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(series)], "k string, seq int, v double")
    assert windows.monotone(df, ["k"], "seq", "v").first().ok is ok


def test_as_of_takes_the_last_anchor_at_or_before(spark):
    items = spark.createDataFrame([("d", 1), ("d", 5), ("d", 9), ("e", 3)], "doc string, line int")
    anchors = spark.createDataFrame([("d", 5, 1), ("d", 8, 2)], "doc string, line int, page int")
    got = {(r.doc, r.line): r.page for r in windows.as_of(items, anchors, "doc", "line", "page").collect()}
    assert got == {("d", 1): None, ("d", 5): 1, ("d", 9): 2, ("e", 3): None}


def test_longest_run_first_on_ties(spark):
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate([1, 0, 0, 1, 0, 0, 1])], "k string, r int, x int")
    r = windows.longest_run(df, ["k"], "r", F.col("x") == 0).first()
    assert (r["first"], r["last"], r["length"]) == (1, 2, 2)


def test_average_rank_shares_ties(spark):
    df = spark.createDataFrame([("a", x) for x in (3.0, 1.0, 1.0, 2.0)], "k string, v double")
    assert sorted(r.rank for r in windows.average_rank(df, ["k"], "v").collect()) == [1.5, 1.5, 3.0, 4.0]


def log_lines():
    """A line of each message, place and number form, with what it says."""
    for k, (word, unit) in enumerate((("Overfull", "pt too {}"), ("Underfull", "badness"))):
        for side, far, kind in (("hbox", "wide", ("overfull", "underfull")[k]), ("vbox", "high", ("vbox_over", "vbox_under")[k])):
            amount = 7.0 + k + 0.5 * (side == "vbox")
            said = f"{word} \\{side} ({amount}{unit.format(far)}) " if k == 0 else f"{word} \\{side} ({unit} {amount}) "
            yield said + f"detected at line {70 + k}", (kind, amount, 70 + k, None)
            if side == "hbox":
                yield said + f"in paragraph at lines {k + 31}--{k + 36}", (kind, amount, k + 31, k + 36)
                yield said + f"in alignment at lines {k + 6}--{k + 600}", (kind, amount, k + 6, k + 600)
                yield said + "has occurred while \\output is active", ("other", None, None, None)
            else:
                yield said + f"has occurred while \\output is active [{k + 4}]", (kind, amount, None, None)
                yield said + "in paragraph at lines 1--2", ("other", None, None, None)
            yield said + "somewhere", ("other", None, None, None)
    yield "LaTeX Warning: Too many Floats by 3.5pt.", ("floatwarn", None, None, None)
    yield "LaTeX Warning: Label `q' multiply defined.", ("warning", None, None, None)
    yield "! Missing $ inserted.", ("error", None, None, None)
    yield "Overfull \\hbox", ("other", None, None, None)
    yield "words! and no message", ("other", None, None, None)


LOG_LINES = list(log_lines())


def test_log_rules_read_every_form(spark):
    got = spark.createDataFrame([(t,) for t, _ in LOG_LINES], "t string").select(text.log_message(F.col("t")).alias("m")).select("m.*").collect()
    assert [tuple(r) for r in got] == [want for _, want in LOG_LINES]


def test_soft_loss_caps_the_loss_and_not_the_distance(spark):
    f = F.lit
    far = scalar.soft_loss(f(100.0), f(0.0), f(1.0), f(1.0), f(2.0))
    capped = scalar.soft_loss(f(100.0), f(0.0), f(1.0), f(1.0), f(5.0))
    clipped = scalar.soft_loss(f(0.0), f(2.0), f(0.8), f(1.5), f(1.0), log_space=True, clip=(0.25, 9.0))
    r = spark.range(1).select(far, capped, clipped, scalar.soft_loss(f(None).cast("double"), f(1.0), f(1.0), f(1.0), f(1.0))).first()
    d = np.log(2.0 / 0.25) / 0.8
    assert r[0] == 2.0 and r[1] == 3.0 and abs(r[2] - (1 - np.exp(-d * d / 2))) < 1e-12 and r[3] is None


def test_lengths_and_sizes(spark):
    texts = ["12", "2mu", " 1 in", "3 q", "x", "-.5cm"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scalar.length_in(F.col("t"), scalar.PT)).collect()]
    assert got[:4] == [12.0, 1.0, 72.27, None] and got[4] is None and abs(got[5] + 0.5 * 72.27 / 2.54) < 1e-12
    sizes = [r[0] for r in spark.createDataFrame([(v,) for v in (10.95, 6.5, 5.0, 14.44)], "v double").select(scalar.snap_size(F.col("v"))).collect()]
    assert sizes == [11.0, 7.0, 5.0, 14.4]


def test_html_text(spark):
    df = spark.createDataFrame([("<p>a &amp; b</p><script>x<1</script><style>q</style><noscript>n</noscript><div>c</div><table><tr><td>d</td><td>e&mdash;f</td></tr></table>",)], "h string")
    assert df.select(text.html_text(F.col("h"))).first()[0] == "a & b\n c\n d e—f"


def test_chi_square_tail(spark):
    r = spark.range(1).select(statistics.chi2_tail(F.lit(9.488), 4), statistics.chi2_tail(F.lit(13.362), 8)).first()
    assert abs(r[0] - 0.05) < 1e-3 and abs(r[1] - 0.1) < 1e-3


def test_soft_loss_one_side_costs_nothing(spark):
    r = spark.range(1).select(scalar.soft_loss(F.lit(1.0), F.lit(2.0), F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0)), scalar.soft_loss(F.lit(3.0), F.lit(2.0), F.lit(1.0), F.lit(1.0), F.lit(1.0))).first()
    assert r[0] == 0.0 and abs(r[1] - (1 - np.exp(-0.5))) < 1e-12


def test_strengths_recover_order(spark):
    df = spark.createDataFrame([("a", "b", 9.0, 1.0), ("b", "c", 8.0, 2.0), ("a", "c", 10.0, 0.0)], "a string, b string, wa double, wb double")
    s = {r.item: r.strength for r in statistics.strengths(df, "a", "b", "wa", "wb").collect()}
    assert s["a"] > s["b"] > s["c"] and abs(np.prod(list(s.values())) - 1) < 1e-3


def test_preference_weights_recover_order(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 3))
    sign = np.where(rng.random(300) < 1 / (1 + np.exp(-x @ [2.0, 1.0, 0.4])), 1, -1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x * sign[:, None]], "p double, q double, r double")
    w = {r.dim: r.weight for r in statistics.preference_weights(df, ["p", "q", "r"]).collect()}
    assert w["p"] > w["q"] > w["r"]


def test_folds_are_balanced_within_strata(spark):
    df = spark.range(100).select(F.col("id").alias("paper"), (F.col("id") % 4).alias("venue"))
    sizes = evaluation.folds(df, "paper", "venue", 5).groupBy("venue", "fold").count().collect()
    assert {r["count"] for r in sizes} == {5}


def test_band_loss_sides(spark):
    r = spark.range(1).select(*[scalar.band_loss(F.lit(v), F.lit(1.0), F.lit(2.0), F.lit(0.5)) for v in (0.5, 1.5, 3.0)]).first()
    assert tuple(r) == (1.2, 0.0, 2.0)


def test_thin_band_uses_wide_range(spark):
    df = spark.createDataFrame([("r", "d", float(v)) for v in [5] * 80 + list(range(20))], "role string, dim string, value double")
    r = profiles.robust_block(df, ["role"]).first()
    assert r["center"] == 5.0 and r["lo"] <= 5.0 <= r["hi"]


def test_percentiles_of_large_and_small_strata_agree(spark, monkeypatch):
    from foliometry.operators import aggregates, quantiles

    rng = np.random.default_rng(8)
    rows = [(g, float(v)) for g, n in ((None, 700), ("a", 5000), ("b", 1), ("c", 300)) for v in (rng.integers(0, 40, n) if g == "c" else rng.standard_normal(n))] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, value double")
    qs = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    want = {g: np.quantile([v for h, v in rows if h == g and v is not None], qs) for g in (None, "a", "b", "c")}
    for most in (quantiles.MOST, 10):
        monkeypatch.setattr(quantiles, "MOST", most)
        got = {r.g: r for r in quantiles.percentiles(df, ["g"], qs).collect()}
        assert set(got) == set(want)
        assert all(np.allclose(got[g].p, want[g], rtol=0, atol=1e-12) for g in want) and got["a"].n == 5000
    ranks = {r.g: r for r in aggregates.ranks_of(df, ["g"], {"median": aggregates.upper_median_rank()}).collect()}
    assert all(ranks[g].median == sorted(v for h, v in rows if h == g and v is not None)[ranks[g].n // 2] for g in want)


def test_large_strata_are_searched_exactly_whatever_their_shape(spark, monkeypatch):
    from foliometry.operators import quantiles

    rng = np.random.default_rng(3)
    shapes = {"even": rng.random(3000), "heavy": 10.0 ** rng.uniform(-200, 200, 3000), "few": rng.integers(0, 3, 3000) / 7, "one": np.full(3000, 2.5), "end": np.r_[rng.random(2999), np.inf], "small": rng.random(20)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in shapes.items() for v in vs], "g string, value double").repartition(7)
    monkeypatch.setattr(quantiles, "MOST", 25)
    monkeypatch.setattr(quantiles, "BINS", 16)
    qs = (0.05, 0.1, 0.5, 0.9, 0.97)
    twice = [{r.g: (r.n, r.p) for r in quantiles.percentiles(df, ["g"], qs).collect()} for _ in range(2)]
    assert twice[0] == twice[1]
    for g, vs in shapes.items():
        assert twice[0][g][0] == len(vs) and np.allclose(twice[0][g][1], np.quantile(vs, qs), rtol=1e-12, atol=0)


def test_running_counts_of_large_strata_need_no_array_on_the_rows(spark):
    from foliometry.operators import quantiles
    from foliometry.operators.lineage import cut

    df = spark.range(40_000).select((F.col("id") % 2).alias("g"), ((F.col("id") * 7919) % 40_009).cast("double").alias("value"))
    rows = quantiles.running(cut(quantiles.counted(df, ["g"], "value")), ["g"])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" not in plan and rows.where("n <> 20000").count() == 0
    for g in (0, 1):
        got = [r.upto for r in rows.where(F.col("g") == g).orderBy("value").collect()]
        assert got == list(range(1, 20_001))


def test_quantiles_at_a_half_millionth_round_as_sql_does(spark, duck):
    values = [1054.31325, 1054.319] + [1.0 + k / 8 for k in range(40)]
    df = spark.createDataFrame([("a", v + j * 1e-4) for v in values for j in range(3)], "k string, value double")
    duck.register("halves", df.toPandas())
    want = duck.execute("SELECT round(quantile_cont(value, 0.25), 6), round(quantile_cont(value, 0.9), 6), round(1053.1601875::DOUBLE, 6), round(4075.4659375::DOUBLE, 6) FROM (SELECT value FROM halves)").fetchone()
    got = aggregates.quantiles(df, ["k"]).select("p25", "p90", scalar.nearest6(F.lit(1053.1601875)), scalar.nearest6(F.lit(4075.4659375))).first()
    assert tuple(got) == want


def test_nearest_box_below_compares_places_not_boxes(spark):
    from foliometry.plans.join_queries import below

    rng = np.random.default_rng(5)
    boxes = [(int(d), i, float(x), float(y), float(x + 6), float(y + 2)) for i, (d, x, y) in enumerate(zip(rng.integers(0, 2, 200), rng.integers(0, 12, 200), rng.integers(0, 20, 200), strict=True))]
    want = {}
    for d, i, x0, _, x1, y1 in boxes:
        found = [(o[3] - y1, o[1]) for o in boxes if o[0] == d and o[1] != i and 0 <= o[3] - y1 <= 60 and x0 < o[4] and o[2] < x1]
        if found:
            want[d, i] = min(found)
    df = spark.createDataFrame(boxes, "doc long, id long, x0 double, y0 double, x1 double, y1 double")
    assert {(r.doc, r.id): (r.gap, r.below) for r in below(df).collect()} == want
    many = spark.range(40_000).select(F.lit(0).cast("long").alias("doc"), "id", F.lit(0.0).alias("x0"), ((F.col("id") % 2) * 30.0).alias("y0"), F.lit(9.0).alias("x1"), ((F.col("id") % 2) * 30.0 + 20).alias("y1"))
    assert below(many).agg(F.count("*"), F.max("below")).first() == (20_000, 1)  # 400 million pairs of boxes, one of places


def test_nearest_item_equals_all_pairs(spark):
    import random

    from foliometry.operators import evaluation

    rng = random.Random(5)
    rows = [(k, k % 3, rng.gauss(0, 1) * (50 if k % 40 == 0 else 1), rng.choice([rng.gauss(0, 0.1), 0.5])) for k in range(400)]
    rows += [(400 + k, 7, rows[k][2], rows[k][3]) for k in range(30)] + [(900, 1, 1e5, -1e5), (901, 2, None, 0.0)]
    best = {}
    for a, _, x, y in rows:
        others = [(round((((x - u) ** 2 + (y - v) ** 2) / 2) ** 0.5, 9), b, m) for b, m, u, v in rows if b != a and u is not None] if x is not None else [(None, 0, 0)]
        best[a] = min(others)
    for part in (rows, rows[:2], rows[-2:]):
        got = evaluation.nearest(spark.createDataFrame(part, "item long, label long, x double, y double"), "item", "label", ["x", "y"]).collect()
        assert len(got) == len(part)
        if part is rows:
            assert {r["item"]: (r["near_item"], r["near"]) for r in got} == {a: m[1:] for a, m in best.items()}
    assert {r["item"]: r["near_item"] for r in got} == {900: 901, 901: 900}
    assert evaluation.nearest(spark.createDataFrame(rows[:1], "item long, label long, x double, y double"), "item", "label", ["x", "y"]).count() == 0


def test_boxes_of_one_place_are_one_node(spark):
    from foliometry.operators import geometry

    places = [(0.0, 0.0, 10.0, 10.0), (15.0, 0.0, 25.0, 10.0), (100.0, 100.0, 110.0, 110.0)]
    rows = [(p, 10_000 * p + k, *places[k % 3]) for p in range(2) for k in range(9_000)]  # 36 million pairs of boxes
    got = geometry.merged_boxes(spark.createDataFrame(rows, "doc long, id long, x0 double, y0 double, x1 double, y1 double").repartition(4), "doc", 8.0).collect()
    want = {(p, 10_000 * p, 6_000, 0.0, 0.0, 25.0, 10.0) for p in range(2)} | {(p, 10_000 * p + 2, 3_000, 100.0, 100.0, 110.0, 110.0) for p in range(2)}
    assert {tuple(r) for r in got} == want


def test_scores_of_equal_papers_are_equal(spark):
    from foliometry.operators import profiles

    values = {"a": 0.1, "b": 0.7, "c": 1e9, "d": 0.3, "e": -1e9, "f": 0.2}
    rows = [(p, d, values[d]) for p in range(40) for d in sorted(values, key=lambda d, p=p: hash((p * 7919, ord(d) * 31)))] + [(99, "a", None)]
    got = profiles.weighted_score(spark.createDataFrame(rows, "paper long, dim string, v double").repartition(7), ["paper"], "v", {"a": 0.3, "d": 1.7}).collect()
    assert len({r["score"] for r in got if r["paper"] != 99}) == 1
    assert [(r["n_dims"], r["score"]) for r in got if r["paper"] == 99] == [(0, None)]


def test_rows_are_not_dealt_by_stratum(spark):
    """Tables of large strata are broadcast to the rows; z of wide rows need no shuffle."""
    from foliometry.operators import profiles, quantiles, statistics

    most, quantiles.MOST = quantiles.MOST, 50
    try:
        pages = spark.range(3000).select(F.col("id").alias("paper"), F.lit(1).alias("page"), F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("role"), (F.col("id") * 7 % 1000).cast("double").alias("x"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).cast("double").alias("y"))
        long = pages.unpivot(["paper", "page", "role"], ["x", "y"], "dim", "value").where("value is not null")
        block = profiles.robust_block(long, ["role"])
        for df in (profiles.page_losses(long, block, ["role"]), statistics.wide_z(pages, block, ["role"], ["x", "y"])):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        z = {r["paper"]: (r["x"], r["y"]) for r in statistics.wide_z(pages, block, ["role"], ["x", "y"]).collect()}
        want = {}
        for r in long.join(block, ["role", "dim"]).collect():
            want.setdefault(r["paper"], {})[r["dim"]] = max(-4.0, min(4.0, (r["value"] - r["center"]) / r["scale"]))
        assert z == {p: (m["x"], m["y"]) for p, m in want.items() if len(m) == 2}
    finally:
        quantiles.MOST = most


def test_bands_are_broadcast(spark):
    long = spark.range(100).select(F.when(F.col("id") >= 0, "x").alias("dim"), F.col("id").cast("double").alias("value"))
    got = aggregates.band_hits(long, spark.createDataFrame([("x", 9.5, 19.5)], "dim string, lo double, hi double"), ["dim"])
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [("x", 100, 0.1, 0.1, 0.8)]
