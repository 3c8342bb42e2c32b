"""Rules of page images and attribution of costs, on planted pages and against a loop."""

import random

from foliometry.operators import page_rules

PAGES = "doc string, page long, error string, ink_ratio double, band double, bottom_blank double, max_gap double, max_gap_at double"


def found(df):
    return {tuple(r)[:4] for r in df.collect()}


def test_each_rule_at_its_edge(spark):
    rows = [
        ("a", 1, None, 0.10, 0.40, 0.0, 0.0, 0.5), ("a", 2, None, 0.10, 0.39, 0.35, 0.0, 0.5), ("a", 3, None, 0.10, 0.0, 0.25, 0.28, 0.5), ("a", 4, None, 0.01, 0.0, 0.25, 0.50, 0.5),
        ("a", 5, None, 0.06, 0.05, 0.30, 0.9, 0.85), ("a", 6, None, 0.0, 0.3, 0.3, 0.9, 0.15), ("a", 7, "torn", 0.01, 0.9, 0.9, 0.9, 0.5), ("a", 8, None, None, None, None, None, None),
        ("b", 1, None, 0.31, 0.0, 0.0, 0.0, 0.5), ("b", 2, None, 0.10, 0.0, 0.0, 0.0, 0.5), ("c", 1, None, 0.1, 0.0, 0.0, 0.0, 0.5), ("c", 2, None, 0.2, 0.0, 0.0, 0.0, 0.5), ("c", 3, None, 0.39, 0.0, 0.0, 0.0, 0.5),
        ("d", 1, None, 0.005, 0.0, 0.0, 0.0, 0.5), ("d", 2, None, 0.004, 0.0, 0.0, 0.0, 0.5), ("d", 3, None, 0.0, 0.0, 0.0, 0.0, 0.5), ("e", 1, "torn", None, None, None, None, None),
    ]
    pages = spark.createDataFrame(rows, PAGES)
    assert found(page_rules.defects(pages)) == {
        ("a", 1, "giant_content", "high"), ("a", 2, "bottom_blank", "high"), ("a", 3, "bottom_blank", "moderate"), ("a", 3, "mid_gap", "moderate"), ("a", 4, "mid_gap", "high"),
        ("a", 4, "near_empty", "high"), ("a", 5, "stranded_block", "high"), ("a", 5, "bottom_blank", "moderate"), ("a", 0, "density_imbalance", "moderate"), ("d", 1, "near_empty", "high"), ("d", 2, "near_empty", "high"),
    }
    got = {r.doc: r for r in page_rules.summaries(pages).collect()}
    assert (got["a"].n, got["a"].n_defects, got["a"].severity_max, got["b"].severity_max, got["c"].n_defects) == (8, 9, "high", None, 0)
    assert (got["e"].n, got["e"].ink_mean, got["e"].n_defects) == (1, None, 0)


def test_attribution_equals_a_loop(spark):
    dice = random.Random(11)
    pages = [(d, p, None if dice.random() < 0.1 else dice.randrange(4) / 2) for d in range(6) for p in range(1, dice.choice([2, 5, 30, 150]))]
    items = [(dice.randrange(8), dice.choice([None, *range(40)]), float(dice.randrange(1, 4))) for _ in range(900)] + [(None, 3, 1.0)]
    rows, lost = page_rules.attributed(spark.createDataFrame(pages, "doc long, page long, a double"), spark.createDataFrame(items, "doc long, page long, w double"))
    p = {(d, g): sum(w for dd, gg, w in items if (dd, gg) == (d, g)) for d, g, _ in pages}
    a = {(d, g): x or 0.0 for d, g, x in pages}
    assert {(r.doc, r.page): (r.p, r.a) for r in rows.collect()} == {k: (p[k], a[k]) for k in p}
    out = [r for r in page_rules.attribution_summary(rows, lost).collect()]
    got = {r.doc: r for r in out}
    assert len(out) == len(got) == 9 and got[None].unattributed == 1.0
    for d in range(8):
        mine, total = [g for dd, g in p if dd == d], sum(w for dd, _, w in items if dd == d)
        r = got[d]
        assert (r.pages, r.total, r.unattributed) == (len(mine), total, total - sum(p[d, g] for g in mine))
        if mine:
            k = max(1, round(0.05 * len(mine)))
            assert abs(r.p_top - sum(sorted((p[d, g] for g in mine), reverse=True)[:k]) / k) < 1e-9 and r.p_peak == max(p[d, g] for g in mine)
            assert r.worst == sorted(mine, key=lambda g: (-p[d, g], -a[d, g], g))[:3]
        else:
            assert (r.p_mean, r.a_mean, r.worst) == (0.0, None, None)


def test_empty_tables(spark):
    none = spark.createDataFrame([], PAGES)
    rows, lost = page_rules.attributed(spark.createDataFrame([], "doc long, page long, a double"), spark.createDataFrame([], "doc long, page long, w double"))
    assert page_rules.defects(none).count() == page_rules.summaries(none).count() == page_rules.attribution_summary(rows, lost).count() == 0
