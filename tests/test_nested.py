"""Nested files as they lie on disk: damaged ones, drifting fields, missing names."""

import json
import re

import pytest
from pyspark.sql import functions as F

from foliometry.sources import nested


def cache_name(url):
    name = re.sub(r"[^A-Za-z0-9._-]", "_", url.split("//", 1)[-1])[-120:].strip("_")
    return name if name.lower().endswith(".pdf") else name + ".pdf"


def written(folder, **files):
    for name, content in files.items():
        (folder / f"{name.replace('__', '.')}").write_text(content if isinstance(content, str) else json.dumps(content, indent=1), encoding="utf-8")
    return str(folder)


def test_step_traces_of_files(spark, tmp_path):
    step = lambda a, **more: {"action": a, "accepted": True, "p": 0.5, **more}
    path = written(
        tmp_path, a__json={"doc": "a", "status": "done", "steps": [step("x", extra=[1]), {"action": "y"}]}, b__json={"status": "open", "steps": [step("z")]},
        c__json={"doc": "c", "steps": []}, d__json={"doc": "d"}, e__json='{"doc": "e", "steps": [{"action": "x"', f__json={"doc": "f", "steps": [step("x", p="much")]}, g__json="",
    )
    steps, bad = nested.step_traces(spark, path)
    got = {(r.doc.rsplit("/", 1)[-1], r.seq): (r.status, r.action, r.accepted, r.p) for r in steps.collect()}
    assert got == {("a", 0): ("done", "x", True, 0.5), ("a", 1): ("done", "y", None, None), ("b.json", 0): ("open", "z", True, 0.5)}
    assert sorted(r.file.rsplit("/", 1)[-1] for r in bad.select("file").collect()) == ["e.json", "f.json"]
    assert bad.count() == 2 and bad.select("text").where("text like '%much%'").count() == 1
    assert steps.select("seq").count() == 3


def test_sample_lists_of_files(spark, tmp_path):
    long, odd = "https://x.org/" + "ab/" * 60 + "é?q=1", "ftp://_a b_.PDF_"
    papers = [{"sample_id": "s1", "title": "t" * 130, "year": 2024, "pdf_url": long}, {"sample_id": "s2", "pdf_url": odd, "title": None}, {"sample_id": "s3", "year": 2020}, {"sample_id": "s4", "pdf_url": "plain.pdf"}]
    path = written(tmp_path, Conf_A__samples__json={"papers": papers}, two__json={"conference": "Two", "papers": []}, three__json={"conference": "THREE", "papers": None, "more": 1}, bad__json='{"papers": [')
    rows, bad = nested.sample_lists(spark, path)
    got = [tuple(r) for r in rows.orderBy("pos").collect()]
    assert got == [
        ("conf_a", 0, "s1", 2024, "t" * 120, long, cache_name(long)), ("conf_a", 1, "s2", None, "", odd, cache_name(odd)),
        ("conf_a", 2, "s3", 2020, "", "", None), ("conf_a", 3, "s4", None, "", "plain.pdf", "plain.pdf"),
    ]
    assert bad.count() == 1


@pytest.mark.parametrize("url", ["https://a/b.pdf", "//", "x", "a//b//c", "https://é/ü_", "https://h/" + "z_" * 70])
def test_cache_names(spark, url):
    assert spark.range(1).select(nested.cache_name(F.lit(url))).first()[0] == cache_name(url)


def test_json_lines_skip_blank_lines(spark, tmp_path):
    path = written(tmp_path, a__jsonl='{"k": 1, "v": "x"}\n\n   \n{"k": 2}\n{"k": "two", "v": "y"}\n{"k": 3, "v"\n{"v": "z", "w": [1]}\n')
    good, bad = nested.json_lines(spark, path, "k long, v string")
    assert sorted(map(tuple, good.collect()), key=str) == [(1, "x"), (2, None), (None, "z")]
    assert sorted(r.text for r in bad.select("text").collect()) == ['{"k": "two", "v": "y"}', '{"k": 3, "v"'] and good.select("v").count() == 3
