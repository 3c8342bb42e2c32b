"""Whole jobs: results over every page and row, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from foliometry.operators import geometry
from foliometry.plans import all as plans
from foliometry.plans import registry

from conftest import DATA

plans.load()


def flood(blank):
    """Connected cells of a set, by flood fill."""
    left, out = set(blank), []
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            i, j = todo.pop()
            part.add((i, j))
            near = {(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)} & left
            left -= near
            todo += near
        out.append(part)
    return out


def covered_cells(duck):
    from foliometry.plans.join_queries import ITEMS
    from foliometry.plans.layout_queries import CELLS

    docs = {d: set() for (d,) in duck.execute("SELECT DISTINCT o_custkey % 300 FROM orders").fetchall()}
    for d, i, j in duck.execute(f"WITH {ITEMS}, {CELLS} SELECT doc, i, j FROM cell_").fetchall():
        docs[d].add((i, j))
    return docs


def test_blank_regions_of_all_pages(spark, duck):
    want = set()
    for doc, covered in covered_cells(duck).items():
        blank = {(i, j) for i in range(29) for j in range(38)} - covered
        whole = {j for j in range(38) if all((i, j) in blank for i in range(29))}
        for part in flood(blank):
            js = sorted({j for _, j in part} & whole)
            runs = [[j for j in js if j - js.index(j) == k] for k in {j - js.index(j) for j in js}]
            band, last = max(map(len, runs), default=0), next((len(r) for r in runs if r[-1] == 37), 0)
            want.add((doc, min(i * 1000 + j for i, j in part), len(part), min(j for _, j in part), max(j for _, j in part), band, last, len(part) / (29 * 38) < 0.004))
    got = [tuple(r) for r in registry.run("blank_regions")(spark, DATA).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_regions_of_random_pages():
    grid, dice = geometry.Grid(9, 11, 20.0), random.Random(5)
    for _ in range(200):
        covered = [dice.getrandbits(9) for _ in range(11)]
        blank = {(i, j) for j, m in enumerate(covered) for i in range(9) if not m >> i & 1}
        got = [{(i, j) for j, m in p.items() for i in range(9) if m >> i & 1} for p in geometry.blank_parts(covered, grid)]
        assert sorted(map(sorted, got)) == sorted(map(sorted, flood(blank)))


def test_blank_shares_add_up(spark, duck):
    covered = covered_cells(duck)
    rows = registry.run("whitespace_ratios")(spark, DATA).collect()
    assert {r.doc for r in rows} == set(covered)
    for r in rows:
        assert abs(r.total - (1 - len(covered[r.doc]) / (29 * 38))) < 1e-6
        assert abs(r.total - sum(r[c] for c in geometry.CLASSES)) < 5e-6


def test_whitespace_rows_has_blank_rows(spark, duck):
    covered = covered_cells(duck)
    got = registry.run("whitespace_rows")(spark, DATA)
    bands = {(r.doc, r.j) for r in got.where("class = 'band'").collect()}
    assert got.count() == 38 * len(covered)
    assert bands == {(d, j) for d, c in covered.items() for j in range(38) if not any((i, j) in c for i in range(29))}


@pytest.mark.parametrize(("boxes", "want"), [
    ([("text", 0, 0, 580, 60)], "trailing anomalous"),
    ([("text", 0, 0, 580, 60), ("float", 0, 60, 580, 80)], "float"),
    ([("head", 0, 0, 580, 740)], "structural"),
    ([("text", 0, 0, 560, 760)], "boundary"),
    ([("text", 0, 0, 580, 760)], ""),
    ([("text", 5, 5, 5, 9)], "boundary"),
])
def test_region_classes(spark, boxes, want):
    df = spark.createDataFrame([(1, k, *map(float, b)) for k, *b in boxes], "doc long, kind string, x0 double, y0 double, x1 double, y1 double")
    got = geometry.blank_regions(df, "doc", "kind", geometry.Grid(29, 38, 20.0), 45.0).select(F.col("class")).collect()
    assert len(got) == (want != "") and all(r[0] in want.split() for r in got)


@pytest.mark.parametrize(("boxes", "first", "last", "want"), [
    ([("text", 0, 0, 580, 60)], True, False, ("trailing", 0.85)),  # a title page: its blank foot ends the text
    ([("text", 0, 0, 580, 60)], False, True, ("trailing", 0.85)),  # the last page
    ([("text", 0, 0, 580, 60)], False, False, ("anomalous", 0.7)),  # a full line, and then nothing
    ([("text", 0, 0, 200, 60)], False, False, ("trailing", 0.85)),  # a short last line
    ([("text", 0, 400, 580, 760)], True, False, ("structural", 0.7)),  # a title page begins further down
    ([("text", 0, 400, 580, 760)], False, False, ("boundary", 0.8)),
    ([("text", 0, 0, 580, 200), ("text", 0, 500, 580, 760)], False, False, ("anomalous", 0.75)),  # a hole
    ([("text", 0, 0, 580, 200), ("text", 0, 260, 580, 760)], False, False, ("structural", 0.8)),  # spacing
    ([("text", 0, 0, 580, 200), ("text", 0, 340, 580, 760)], False, False, ("structural", 0.7)),  # between paragraphs
    ([("float", 0, 0, 580, 200), ("text", 0, 700, 580, 760)], False, False, ("float", 0.6)),  # a large blank at a float
])
def test_region_classes_by_page(spark, boxes, first, last, want):
    df = spark.createDataFrame([(1, k, *map(float, b)) for k, *b in boxes], "doc long, kind string, x0 double, y0 double, x1 double, y1 double")
    context = spark.createDataFrame([(1, first, last)], "doc long, is_first boolean, is_last boolean")
    got = geometry.blank_regions(df, "doc", "kind", geometry.Grid(29, 38, 20.0), 45.0, context).orderBy(F.desc("n_cells")).first()
    assert (got["class"], got["confidence"]) == want


def all_losses(duck):
    return duck.execute("SELECT l_suppkey, l_linestatus, l_orderkey * 10 + l_linenumber AS page, round(sum(l_quantity), 6), round(sum(l_discount * 100), 6) FROM lineitem GROUP BY 1, 2, 3 ORDER BY 1, 3, 2").fetchall()


def test_pair_partners_of_all_pages(spark, duck):
    papers = {}
    for paper, col, page, a, b in all_losses(duck):
        papers.setdefault(paper, []).append((page, col, a, b))
    want = set()
    for paper, pages in papers.items():
        for page, col, a, b in pages:
            d = [(max(abs(a - x), abs(b - y)), -q, abs(a - x), abs(b - y)) for q, _, x, y in pages if q != page]
            lead_b, (far, q, _, _) = sum(r[3] > r[2] for r in d), max(d)
            want.add((paper, page, col, len(d), len(d) - lead_b, lead_b, -q, far))
    got = registry.run("pair_within_paper")(spark, DATA).collect()
    assert {(r.paper, r.page, r.col, r.n_pairs, r.lead_a, r.lead_b, r.partner, r.lead_delta) for r in got} == want and len(got) == len(want)


def test_pair_partners_of_lone_and_equal_pages(spark):
    from foliometry.operators.pairs import partners

    df = spark.createDataFrame([(1, 5, "F", 1.0, 2.0), (2, 3, "F", 4.0, 4.0), (2, 8, "F", 4.0, 4.0)], "paper long, page long, col string, a double, b double")
    got = {(r.paper, r.page): (r.n_pairs, r.partner, r.lead, r.lead_delta) for r in partners(df, "paper", "page", "col", "a", "b").collect()}
    assert got == {(1, 5): (0, None, None, None), (2, 3): (1, 8, "a", 0.0), (2, 8): (1, 3, "a", 0.0)}


def test_pair_theta_counts_of_all_pages(spark, duck):
    rows = all_losses(duck)
    hi, lo = [r for r in rows if r[3] + r[4] >= 58], [r for r in rows if r[3] + r[4] < 49.5]
    want = {(r[0], r[1], r[2], side): 0 for side, rs in (("hi", hi), ("lo", lo)) for r in rs}
    for x in hi:
        for y in lo:
            if x[1] == y[1] and x[0] != y[0] and x[4] - y[4] >= 0.5 * (x[3] + x[4] - y[3] - y[4]):
                want[*x[:3], "hi"] += 1
                want[*y[:3], "lo"] += 1
    got = {(r.paper, r.col, r.page, r.side): r.n_pairs for r in registry.run("pair_theta_join")(spark, DATA).collect()}
    assert got == want and sum(want.values()) > 0


def test_content_groups_cross_sources(spark, tmp_path):
    rows = [(1, "a", "x  y"), (2, "b", "xy"), (3, "c", "x y"), (4, "a", "z"), (5, "b", None), (6, "b", None), (7, "a", "w"), (8, "c", "w")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in registry.run("content_groups")(spark, str(tmp_path)).collect()}
    assert got == {(1, 1, 3), (2, 1, 3), (3, 1, 3), (7, 7, 2), (8, 7, 2)}


def test_bootstrap_interval_matches_resampling(spark):
    from foliometry.operators import evaluation, statistics

    dice = random.Random(3)
    rows = [(p, d, round(dice.gauss(p % 7, 2), 3)) for d in ("x", "y") for p in range(60) for _ in range(dice.randrange(1, 9))]
    df = spark.createDataFrame(rows, "paper long, dim string, value double")
    drawn = {}
    for r in evaluation.bootstrap_counts(df.select("paper").distinct(), "paper", 40).collect():
        drawn.setdefault(r.iter, {})[r.paper] = r.mult
    got = {r.dim: (r.ci_lo, r.ci_hi) for r in statistics.bootstrap_median(df, "paper", ["dim"], 40).collect()}
    for d in ("x", "y"):
        m = sorted(statistics.np.median([v for p, e, v in rows if e == d for _ in range(c.get(p, 0))]) for c in drawn.values())
        assert len(m) == 40 and all(abs(a - b) < 2e-6 for a, b in zip(got[d], (m[1], m[39]), strict=True))


def test_bootstrap_covers_all_dims(spark):
    from foliometry.plans.registry import DIMS

    rows = registry.run("cluster_bootstrap_ci")(spark, DATA).collect()
    assert {(r.role, r.dim) for r in rows} == {(r, d) for r in "ANR" for d in DIMS} and all(r.ci_lo <= r.p50 <= r.ci_hi for r in rows)


def test_separability_leaves_small_venues_out(spark):
    from foliometry.operators import statistics

    rows = [(i, i % 2, float(i % 2) * 100 + i * 0.01, 0.0) for i in range(60)] + [(100 + i, 2, 50.0 + i, 0.0) for i in range(19)]
    df = spark.createDataFrame(rows, "item long, label long, x double, y double")
    r = statistics.separability(df, "item", "label", ["x", "y"], 100).first()
    assert (r.accuracy, r.p_value, r.majority) == (1.0, round(1 / 101, 6), 0.5)
    assert tuple(statistics.separability(df.where("label = 2"), "item", "label", ["x", "y"], 5).first()) == (None, None, None)
