"""Templates: ordered picks against a loop, odd samples and constraints, projection by basis."""

import random

from pyspark.sql import functions as F

from foliometry.operators import templates

MEASURED = """struct<pdf_pages: double, content_pages: double, body_font_pt: double, text_width_pt: double, columns: double, column_gap_pt: double, figures: double, tables: double,
  equations: double, algorithms: double, refs: double, footnotes_est: double, caption_font_pt: double, lines_per_page: double,
  margins_mm: struct<left: double, right: double, top: double, bottom: double>, figure_geometry: struct<fig_width_frac_median: double, fig_height_frac_median: double, full_width_fig_frac: double>,
  full_width_float_pos: struct<top: double, mid: double, bottom: double>, ref_style: string, paper_size: string>"""
SAMPLES, CONSTRAINTS, RULES = f"sample long, venue string, measured {MEASURED}", "venue string, key string, edition long, value double, text string, basis string", "id long, applies_to string"


def measured(**given):
    plain = "pdf_pages content_pages body_font_pt text_width_pt columns column_gap_pt figures tables equations algorithms refs footnotes_est caption_font_pt lines_per_page".split()
    return tuple(given.get(c) for c in plain) + (given.get("margins"), given.get("geometry"), given.get("pos"), given.get("style"), given.get("paper"))


def pick(cands, least, most, free):
    ordered, got = sorted(cands, key=lambda c: -c[1]), []
    for c in ordered:
        if len(got) < most and (c[0] in free or all(g[0] != c[0] for g in got)):
            got.append(c)
    for c in ordered:
        if len(got) < least and c not in got:
            got.append(c)
    return got


def test_picks_equal_a_loop(spark):
    dice = random.Random(3)
    rows = [(i, [(dice.choice("abc") if i % 2 else dice.choice(["page", "a"]), float(dice.randrange(6)), j) for j in range(dice.randrange(9))]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, c array<struct<family: string, score: double, seq: int>>")
    for least, most in ((3, 5), (2, 2), (0, 4)):
        for i, got in df.select("i", templates.picked(F.col("c"), least, most)).collect():
            assert [tuple(g) for g in got] == pick(rows[i][1], least, most, ("page",)), rows[i]


def test_measures_guard_their_ratios(spark):
    rows = [(1, "a", measured(figures=6.0, content_pages=4.0, columns=2.0, column_gap_pt=18.0)), (2, "a", measured(figures=6.0, content_pages=0.0, columns=1.0, column_gap_pt=18.0)), (3, None, None)]
    long = templates.measured_long(spark.createDataFrame(rows, SAMPLES), ["sample"])
    got = {(r["sample"], r["metric"]): r["value"] for r in long.collect()}
    assert len(got) == 3 * 23
    assert (got[1, "figs_per_page"], got[1, "column_gap_pt"], got[1, "tables_per_page"]) == (1.5, 18.0, None)
    assert got[2, "figs_per_page"] is None and got[2, "column_gap_pt"] is None and got[3, "figures"] is None


def template(spark, samples, constraints, rules=()):
    out = templates.venue_templates(spark.createDataFrame(constraints, CONSTRAINTS), spark.createDataFrame(samples, SAMPLES), spark.createDataFrame(list(rules), RULES))
    return out, {r["venue"]: r.asDict(True) for r in out.collect()}


def test_official_values_come_first(spark):
    samples = [(i, "a", measured(body_font_pt=10.0, text_width_pt=400.0 + i, columns=1.0, content_pages=8.0, margins=(20.0, 20.0, 25.0, None), caption_font_pt=9.0)) for i in range(5)]
    samples += [(9, None, measured(body_font_pt=1.0)), (10, "b", None)]
    said = [
        ("a", "body_font_size_pt", 1, 12.0, None, "official"), ("a", "body_font_size_pt", 2, 10.5, None, "official"), ("a", "page_limit_content", 1, 9.0, None, "unknown"),
        ("a", "page_limit_total", 1, 20.0, None, "official"), ("c", "page_limit_total", 1, 12.0, None, None), ("c", "margin_left_mm", 1, 30.0, None, "official"),
        ("c", "margin_right_mm", 1, 25.9, None, "official"), (None, "columns", 1, 2.0, None, "official"), ("c", "columns", 3, None, None, "official"),
    ]
    rules = [(1, "All venues, a"), (2, "a and c"), (3, None), (4, "other")]
    out, got = template(spark, samples, said, rules)
    assert set(got) == {"a", "b", "c"}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a["body_font_pt"], a["body_font_basis"], a["body_font_agrees"]) == (10.5, "official", True)
    assert (a["text_width_mm"], a["text_width_basis"]) == (round(402 * 25.4 / 72, 1), "sample-stat")
    assert (a["margin_floor_mm"], a["margin_floor_basis"], a["caption_reliable"], a["page_slack"]) == (20.0, "sample-stat", True, 1.0)
    assert [p["family"] for p in a["priorities"]] == ["L", "page", "breaking", "float", "margin"]
    assert (b["n_samples"], b["level"], b["columns"], b["margin_floor_mm"]) == (1, "low", None, None)
    assert (c["n_samples"], c["text_width_mm"], c["text_width_basis"], c["columns"]) == (0, 160.0, "derived", None)
    assert (a["n_rules"], b["n_rules"], c["n_rules"]) == (2, 1, 2)

    fields = {(r["venue"], r["field"]): r for r in templates.projected(out).collect()}
    limit = fields["a", "page_limit"]
    assert (limit["value"], limit["accepted"], limit["reason"], limit["scope"]) == (None, False, "basis not permitted", "content")
    limit = fields["c", "page_limit"]
    assert (limit["value"], limit["path"], limit["basis"], limit["scope"]) == (12.0, "hard_constraints.page_limit_total", "official", "total")
    assert (fields["a", "font_pt"]["value"], fields["a", "margin_mm"]["reason"], fields["c", "font_pt"]["reason"]) == (10.5, "basis not permitted", "no value")
    assert fields["b", "float_spec"]["text"] == "tbp"


def test_nothing_gives_nothing(spark):
    out, got = template(spark, [], [])
    assert got == {} and templates.projected(out).count() == 0
