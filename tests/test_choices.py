"""Choice of measures, components, pairs by turns and acceptance folds against plain Python on random tables and edge cases."""

import random

import numpy as np
import pytest

from foliometry.operators import dims, matching, traces


def sequential(rows, pairs, quota):
    """Groups take turns; each takes its best pair of free members, one after the other."""
    by = {}
    for g, a, b, *key in rows:
        by.setdefault(g, []).append((tuple(key), a, b))
    order = sorted(by, key=lambda g: (len(by[g]), g))
    used, out, left, turn = set(), [], dict.fromkeys(order, quota), 0
    while len(out) < pairs:
        turn, moved = turn + 1, False
        for g in order:
            free = [x for x in by[g] if x[1] != x[2] and not {x[1], x[2]} & used]
            if left[g] and free and len(out) < pairs:
                _, a, b = min(free)
                used |= {a, b}
                left[g] -= 1
                moved = True
                out.append((g, a, b, turn, len(out) + 1))
        if not moved:
            break
    return out


@pytest.mark.parametrize(("seed", "papers", "n", "pairs", "quota"), [(1, 12, 80, 20, 3), (2, 200, 300, 12, 3), (3, 6, 40, 9, 2), (4, 30, 60, 100, 50)])
def test_pairs_by_turns_equal_a_sequential_pick(spark, seed, papers, n, pairs, quota):
    rng = random.Random(seed)
    rows = [(rng.randrange(4), rng.randrange(papers), rng.randrange(papers), rng.randrange(2), round(-rng.random(), 1)) for _ in range(n)]
    df = spark.createDataFrame(rows, "group long, a long, b long, other int, less double")
    got = matching.take_turns(df, ["other", "less"], pairs, quota).collect()
    assert sorted((r.group, r.a, r.b, r.turn, r.place) for r in got) == sorted(sequential(rows, pairs, quota))


def test_no_pairs(spark):
    df = spark.createDataFrame([(1, 5, 5, 0.0)], "group long, a long, b long, less double")
    assert matching.take_turns(df, ["less"], 3).collect() == [] and matching.take_turns(df.limit(0), ["less"], 3).collect() == []


NAMES = ["a", "b", "c", "d", "e"]


def holes(spark, seed, n, rates):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 2)) @ rng.standard_normal((2, 5)) + 0.3 * rng.standard_normal((n, 5))
    rows = [(f"s{int(rng.integers(3))}", *[None if rng.random() < r else float(v) for v, r in zip(row, rates, strict=True)]) for row in x]
    return rows, spark.createDataFrame(rows, "s string, a double, b double, c double, d double, e double")


@pytest.mark.parametrize("least", [5, 30, 60, 400])
def test_dropped_measures_equal_a_rescan(spark, least):
    rows, df = holes(spark, least, 300, (0.1, 0.5, 0.5, 0.0, 0.9))
    want = {}
    for s in {r[0] for r in rows}:
        own, held = [r[1:] for r in rows if r[0] == s], list(range(5))
        complete = lambda: sum(all(r[i] is not None for i in held) for r in own)  # noqa: B023, E731
        while len(held) > 1 and complete() < least:
            missing = [sum(r[i] is None for r in own) for i in held]
            held.pop(missing.index(max(missing)))
        if complete() >= max(5, least // 4):
            want[s] = ([NAMES[i] for i in held], complete())
    got = dims.complete_dims(dims.patterns(df, ["s"], NAMES), ["s"], NAMES, least).collect()
    assert {r.s: (r.dims, r.complete) for r in got} == want


def test_validity_notes(spark):
    rows = [("s", float(k % 7), 0.0 if k % 2 else float(k), 5.0, k * 1e-12, None) for k in range(100)]
    got = dims.validity(spark.createDataFrame(rows, "s string, a double, b double, c double, d double, e double"), ["s"], NAMES, 40)
    assert {r.dim: r.note for r in got.collect()} == {"a": None, "b": "mode", "c": "mode", "d": "constant"}


def test_components_equal_a_decomposition(spark):
    rows, df = holes(spark, 7, 400, (0.1, 0.0, 0.1, 0.0, 0.0))
    x = np.array([r[1:] for r in rows if None not in r])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    share = s**2 / (s**2).sum()
    got = dims.components(df, NAMES).collect()
    assert {r.n for r in got} == {len(x)} and {r.k_for_90 for r in got} == {int(np.argmax(np.cumsum(share) >= 0.9)) + 1} and len(got) == 25
    for r in got:
        w = v[r.pc - 1] * np.sign(v[r.pc - 1][np.argmax(np.abs(v[r.pc - 1]))])
        assert r.explained == pytest.approx(share[r.pc - 1], abs=1e-4) and r.loading == pytest.approx(w[NAMES.index(r.dim)], abs=2e-3)
        assert r.rank == 1 + sum(abs(w) > abs(w[NAMES.index(r.dim)]) + 1e-9)


def test_components_of_two_factors_and_errors(spark):
    rng = np.random.default_rng(3)
    f = rng.standard_normal((200, 2))
    rows = [(float(a), float(-a + 0.1 * e), float(b), float(b + 0.1 * g), 1.0) for (a, b), e, g in zip(f, rng.standard_normal(200), rng.standard_normal(200), strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    assert dims.components(df, NAMES[:4]).first().k_for_90 <= 3
    assert dims.components(df.limit(19), NAMES).first().error and dims.components(df, ["a"]).first().error
    assert all(r.loading == 0 for r in dims.components(df, NAMES).collect() if r.dim == "e" and r.pc == 1)  # a constant


@pytest.mark.parametrize("seed", range(4))
def test_choice_of_measures_equals_a_loop(spark, seed):
    rng = random.Random(seed)
    names = [f"{rng.choice('xyz')}.{k}" for k in range(20)]
    rows = [("s", d, rng.choice([0.2, 0.5, 0.7, 0.9]), rng.choice([None, "f1", "f2", "f3"])) for d in names]
    preferred, group = rng.sample(names, 4), {d: d[0] for d in names}
    coverage, family = {d: c for _, d, c, _ in rows}, {d: f or d for _, d, _, f in rows}
    out = []
    for d in [*preferred, *sorted((x for x in names if x not in preferred), key=lambda x: (-coverage[x], x))]:
        if coverage[d] >= 0.5 and family[d] not in {family[x] for x in out} and sum(group[x] == group[d] for x in out) < 2 and (d in preferred or len(out) < 5):
            out.append(d)
    got = dims.chosen(spark.createDataFrame(rows, "s string, dim string, coverage double, family string"), ["s"], preferred, group, most=5).orderBy("rank").collect()
    assert [r.dim for r in got] == out[:5]


def test_acceptance_against_the_last_accepted_version(spark):
    rows = [  # doc, seq, n_gate, long, pages, scored, m1, m2
        (1, 1, 2, True, 10, True, 5.0, 1.0), (1, 2, 2, True, 10, True, 9.0, 9.0), (1, 3, 2, True, 11, True, 1.0, 1.0), (1, 4, 2, True, None, True, 1.0, 1.0), (1, 5, 0, False, 8, True, 7.0, 3.0), (1, 6, 1, False, 8, True, 0.0, 0.0),
        (1, 7, 0, False, 8, False, 0.0, 0.0), (1, 8, 0, False, 8, True, 8.0, 0.0), (1, 9, 0, False, 8, True, 7.0 + 1e-12, 2.0), (1, 10, 0, False, 8, True, 7.0, 2.0), (1, 11, 0, False, 8, True, None, 0.0), (1, 12, 0, False, 8, True, 6.0, 9.0), (2, 1, 0, False, 3, True, None, None),
    ]
    df = spark.createDataFrame([(d, s, 100 + s, *rest) for d, s, *rest in rows], "doc long, seq long, version long, n_gate int, long boolean, pages int, scored boolean, m1 double, m2 double")
    got = {(r.doc, r.seq): (r.base, r.accepted, r.reason) for r in traces.judged(df).collect()}
    assert [got[1, s] for s in range(1, 13)] == [
        (None, True, "first"), (101, True, "compression, no more pages"), (102, False, "compression, more pages"), (102, False, "compression, more pages"), (102, True, "fewer broken rules"), (105, False, "more broken rules"),
        (105, False, "not scored"), (105, False, "higher m1"), (105, True, "lower m2"), (109, False, "no gain"), (109, False, "m1 missing"), (109, True, "lower m1"),
    ]
    assert got[2, 1] == (None, True, "first")
