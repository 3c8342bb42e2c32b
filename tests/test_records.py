"""Requests against a rule table: each error alone, odd values, nulls."""

from foliometry.operators import records

RULES = [("a", "n", "int", True, None, 0.0, 9.0, None, None), ("a", "x", "float", False, "1.5", None, 2.0, None, None), ("a", "b", "bool", False, None, None, None, None, None), ("a", "s", "text", False, "q", None, None, "^[a-z]*$", 3), ("none",) + (None,) * 8]


def test_each_error(spark):
    cases = [
        ("a", {"n": " 7 ", "b": "True", "s": "ab"}, True, {"n": "7", "x": "1.5", "b": "true", "s": "ab"}, []),
        ("a", {"n": "1.0", "x": "1e1", "b": "1", "s": "abcd"}, False, {}, ["b: needs bool", "n: needs int", "s: too long", "x: above range"]),
        ("a", {"n": "-1", "x": "", "s": "A", "z": "1"}, False, {}, ["n: below range", "s: bad format", "x: needs float", "z: unknown"]),
        ("a", {"n": None, "x": ".5"}, False, {"x": ".5", "s": "q"}, ["n: missing"]), ("a", None, False, {"x": "1.5", "s": "q"}, ["n: missing"]), ("a", {"n": "9" * 40}, False, {"x": "1.5", "s": "q"}, ["n: above range"]),
        ("none", {}, True, {}, []), ("none", {"n": "1"}, False, {}, ["n: unknown"]), ("b", {"n": "1"}, False, {}, ["unknown action"]), (None, None, False, {}, ["unknown action"]),
    ]
    df = spark.createDataFrame([(i, a, p) for i, (a, p, *_) in enumerate(cases)], "i int, action string, params map<string, string>")
    out = {r.i: r for r in records.validated(df, spark.createDataFrame(RULES, records.RULES)).collect()}
    assert len(out) == len(cases)
    for i, (_, _, ok, clean, errors) in enumerate(cases):
        assert (out[i].ok, out[i].clean, out[i].errors) == (ok, clean, errors), cases[i]
