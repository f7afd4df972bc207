"""Joins, roll-ups and survey statistics on small tables."""

from __future__ import annotations

import random

import pytest

from corvane.operators import joins as J
from corvane.operators import rollups as U
from corvane.operators import survey as V


def test_signed_ranks_over_bands_equal_plain_ranks(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([0.0, 1e-9, 3.0, 1e12, 1.0]) + rng.random() * 10 ** rng.randint(-6, 6), float(rng.randint(0, 4))) for g in ("x", None) for _ in range(400)]
    rows += [("x", 1.0, float(k % 5)) for k in range(50)] + [("y", None, 1.0)]
    got = {r.g: r for r in V.signed_ranks(spark.createDataFrame(rows, "g string, a double, b double"), "a", "b", ["g"]).collect() if r.n}
    for g in ("x", None):
        d = sorted((b - a for k, a, b in rows if k == g and a is not None and b != a), key=abs)
        plus = sum(sum(i + 1 for i, y in enumerate(d) if abs(y) == abs(z)) / sum(abs(y) == abs(z) for y in d) for z in d if z > 0)
        if g is not None:
            assert got[g].n == len(d) and got[g].w_plus == pytest.approx(plus, abs=1e-6)


def test_wilcoxon_p_known_values():
    assert V.wilcoxon_p(0, 5, 0, 0) == pytest.approx(0.0625)  # exact: 2 / 2**5
    assert V.wilcoxon_p(3, 6, 0, 0) == pytest.approx(10 / 64)  # five rank sets have a sum of three or less
    assert V.wilcoxon_p(0, 0, 0, 3) == 1.0
    assert V.wilcoxon_p(100, 30, 60, 0) == pytest.approx(0.00637, abs=2e-4)


def test_signed_ranks(spark):
    df = spark.createDataFrame([(1, 1.0, 3.0), (1, 2.0, 2.0), (1, 5.0, 4.0), (1, None, 4.0), (2, 1.0, 1.0), (2, 2.0, 2.0), (3, 1.0, 2.0)], "g int, a double, b double")
    r = {x.g: x for x in V.with_wilcoxon_p(V.signed_ranks(df, "a", "b", ["g"])).collect()}
    assert (r[1].n_pairs, r[1].n, r[1].w, round(r[1].r_rb, 6)) == (3, 2, 1.0, round(1 / 3, 6))
    assert (r[2].w, r[2].r_rb, r[2].p) == (0.0, 0.0, 1.0) and r[3].w is None and r[3].p is None


def test_krippendorff_edges(spark):
    rate = lambda rows: V.krippendorff(spark.createDataFrame(rows, "u int, v double"), "u", "v").first()
    assert rate([(1, 3.0), (1, 3.0), (2, 3.0), (2, 3.0)]).alpha == 1.0
    assert rate([(1, 3.0), (2, 4.0)]).n_units == 0 and rate([(1, 3.0), (2, 4.0)]).alpha is None
    assert rate([(1, 1.0), (1, 1.0), (2, 5.0), (2, 5.0), (3, None)]).alpha == 1.0


def test_guards_and_diffs(spark):
    a, b = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double"), spark.createDataFrame([(2, 2.0001), (3, None)], "k int, v double")
    with pytest.raises(ValueError, match="unknown"):
        J.guard_empty(J.outsiders(a, b, "k"), "unknown")
    J.guard_empty(J.outsiders(b.limit(0), a, "k"), "unknown")
    assert {(r.k, r.verdict) for r in J.diff_rows(a, b, ["k"], ["v"]).collect()} == {(1, "only_left"), (2, "conflict"), (3, "only_right")}
    assert [r.k for r in J.diff_cells(a, b, ["k"], ["v"], 1e-3).collect()] == [1]


def test_token_jaccard_equals_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = [(i, i % 3, [f"w{rng.randrange(12)}" for _ in range(rng.randint(0, 9))]) for i in range(80)]
    got = {(r.a, r.b): r.j for r in J.token_jaccard(spark.createDataFrame(rows, "k int, g int, t array<string>"), "k", "g", "t", 0.4).collect()}
    want = {}
    for i, g, t in rows:
        for k, h, u in rows:
            if i < k and g != h and t and u and len(set(t) & set(u)) / len(set(t) | set(u)) >= 0.4:
                want[i, k] = len(set(t) & set(u)) / len(set(t) | set(u))
    assert got == pytest.approx(want)


def test_sketch_jaccard_equals_brute_force_without_a_row_for_each_shared_token(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", (8, 16))
    rng = random.Random(3)
    sets = [rng.sample(range(900), rng.choice([1, 2, 5, 40, 64, 65, 130, 300])) for _ in range(60)]
    for s in sets[:40]:
        k = rng.randrange(len(s) + 1)
        sets += [s, s[:k] + rng.sample(range(900), len(s) - k), s[: max(1, 2 * len(s) // 5)], rng.sample(s, max(1, len(s) // 2))]
    rows = [(k, k % 3, [f"w{x}" for x in s]) for k, s in enumerate(sets)] + [(1000, 0, []), (1001, 1, None), (1002, None, ["w1"])]
    df = spark.createDataFrame(rows, "k int, g int, t array<string>")
    share = {(i, j): len(set(s) & set(sets[j])) / len(set(s) | set(sets[j])) for i, s in enumerate(sets) for j in range(i + 1, len(sets))}
    want = {(i, j): v for (i, j), v in share.items() if v >= 0.4}
    got = {(r.a, r.b): r.j for r in J.sketch_jaccard(df, "k", "g", "t", 0.4).collect()}
    assert got == pytest.approx({(i, j): v for (i, j), v in want.items() if i % 3 != j % 3})
    found = {tuple(r) for r in J.near_sets(df.selectExpr("k", "array_distinct(t) AS set").filter("size(set) > 0"), "k", 0.4).collect()}
    assert found >= set(want) and len(found) < 1.5 * len(want)
    assert J.sketch_jaccard(df.filter("k = 1000"), "k", "g", "t", 0.4).count() == 0


def test_missing_is_not_zero(spark):
    df = spark.createDataFrame([("m", 1.0), ("m", None), ("n", None)], "g string, v double")
    r = {x.g: x for x in df.groupBy("g").agg(*U.both_means(df.v, "v")).collect()}
    assert (r["m"].v_available, r["m"].v_all, r["m"].n_v) == (1.0, 0.5, 1) and (r["n"].v_available, r["n"].v_all, r["n"].n_v) == (None, 0.0, 0)


def test_greedy_match_walks_through_lists(spark):
    """One list a group instead of a frame a group; against the rule in plain Python, with ties, empty names and scores that are no number."""
    rng = random.Random(3)
    rows = [(g, rng.randrange(6), rng.choice([None, *range(6)]), rng.choice([0.4, 0.5, 0.75, 0.75, 1.0, float("nan"), None])) for g in range(60) for _ in range(25)]
    got = J.greedy_match(spark.createDataFrame(rows, "g long, a long, b long, s double"), "g", "a", "b", "s", 0.5)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
    want, taken, done = set(), set(), set()
    for g, a, b, s in sorted((r for r in rows if r[3] is not None and r[3] >= 0.5), key=lambda r: (r[0], r[1], -r[3], r[2] is None, r[2] or 0)):
        if (g, a) not in done and (g, b) not in taken:
            done.add((g, a))
            taken.add((g, b))
            want.add((g, a, b, s))
    assert set(map(tuple, got.collect())) == want
