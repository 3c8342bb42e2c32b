"""Frames and margins of documents whose measures are known."""

import pytest

from foliometry.operators import frames

SCHEMA = "doc long, page long, x0 double, x1 double, y0 double, y1 double, size double, nchars long, fig boolean, text string"


def two_columns(doc, pages, skip=()):
    """Pages of 20 lines in each of two columns: 50 to 290 and 320 to 560, from 740 down."""
    return [(doc, p, x, x + 240.0, 730.0 - 12 * k, 740.0 - 12 * k, 10.0, 40, False, "words") for p in pages if p not in skip for x in (50.0, 320.0) for k in range(20)]


@pytest.fixture(scope="module")
def lines(spark):
    one = [(2, 1, 72.0, 540.0, 690.0 - 14 * k, 702.0 - 14 * k, 12.0, 60, False, "words") for k in range(10)]
    figures = [(3, 1, 100.0, 200.0, 300.0, 310.0, 9.0, 5, True, "1 x")]
    title = [(1, 1, 0.0, 600.0, 0.0, 790.0, 30.0, 500, False, "title")]  # the first page does not count
    captions = [(1, 2, 50.0, 560.0, 470.0, 478.0, 8.0, 20, False, "Table 1: across"), (1, 3, 60.0, 200.0, 460.0, 468.0, 8.0, 20, False, "Figure 2. left"), (1, 4, 400.0, 500.0, 460.0, 468.0, 8.0, 20, False, "fig 3 centred"), (1, 2, 50.0, 120.0, 100.0, 108.0, 8.0, 9, False, "1 a note")]
    rows = title + two_columns(1, range(2, 7)) + captions + one + figures + two_columns(4, range(1, 4))
    return spark.createDataFrame(rows, SCHEMA)


def test_frames(lines):
    got = {r.doc: r for r in frames.frames(lines, 612.0, 792.0).collect()}
    assert set(got) == {1, 2, 3, 4}
    r = got[1]
    assert (r.left, r.right, r.columns, r.gutter, r.col1_right, r.col_gap, r.col_width, r.body_pt, r.top, r.bottom, r.height_pt) == (50, 560, 2, 320, 290, 30, 240, 10, 740, 502, 238)
    assert r.usable_pt2 == 480 * 238
    assert (got[2].columns, got[2].left, got[2].right, got[2].body_pt, got[2].gutter) == (1, 72, 540, 12, None)
    assert (got[3].left, got[3].right, got[3].columns) == (100, 200, 1)  # nothing but figures
    assert got[4].columns == 1  # two pages count, and a vote needs three


def test_margins_and_alignment(lines):
    frame = frames.frames(lines, 612.0, 792.0)
    r = {r.doc: r for r in frames.margins(lines, frame, 612.0, 792.0).collect()}[1]
    assert (r.left_margin, r.right_margin, r.top_margin, r.bottom_margin, r.captions, r.caption_pt, r.captions_left, r.captions_center, r.footnotes) == (50, 52, 52, 460, 3, 8, 2, 1, 1)
    assert (r.across_top, r.across_mid, r.across_bottom) == (0, 1, 0)
    a = [r for r in frames.alignment(lines, frame).collect() if r.doc == 1 and r.page == 6][0]
    assert (a.left_var, a.right_var, a.center_var, a.n_full, a.n_short, a.n_lines) == (0, 0, None, 40, 0, 40)


def test_no_lines(spark, lines):
    assert frames.frames(lines.limit(0), 612.0, 792.0).collect() == []
