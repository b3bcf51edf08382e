"""Rules of roll-ups, ranks, upserts, agreement and selection on hand-made rows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialmill.operators import agreement as ag
from trialmill.operators import audit, progress, ranks, rollup, strategy, timeseries, upsert
from trialmill.operators import selection as sel


def one(df):
    return df.first()[0]


def test_keep_best_keeps_the_first_on_ties_and_null_counts_as_zero(spark):
    df = spark.createDataFrame([("k", 0.5, 1), ("k", 0.5, 2), ("k", None, 3), ("n", None, 4), ("n", None, 5)], "k string, s double, seq int")
    assert {r["k"]: r["seq"] for r in ranks.keep_best(df, ["k"], "s", "seq").collect()} == {"k": 1, "n": 4}
    assert {r["k"]: r["seq"] for r in ranks.last_wins(df, ["k"], "seq").collect()} == {"k": 3, "n": 5}


def test_upserts_keep_places_and_are_idempotent(spark):
    old = spark.createDataFrame([("a", 0.5, 1), ("b", 0.9, 2)], "k string, s double, seq int")
    new = spark.createDataFrame([("b", 0.1, 10), ("a", 0.7, 11), ("c", None, 12)], "k string, s double, seq int")
    better = upsert.upsert_better(old, new, ["k"], "seq", "s")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(better) == [("a", 0.7, 1), ("b", 0.9, 2), ("c", None, 12)]
    assert rows(upsert.upsert_better(better, new, ["k"], "seq", "s")) == rows(better)
    assert rows(upsert.upsert_newer(old, new, ["k"], "seq")) == [("a", 0.7, 1), ("b", 0.1, 2), ("c", None, 12)]


def test_consensus_defaults(spark):
    results = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "k string, dnf boolean")
    ratings = spark.createDataFrame([("c", 3.0), ("c", 4.0), ("b", None)], "k string, score double")
    assert {r["k"]: r["consensus"] for r in upsert.consensus(results, ratings, ["k"]).collect()} == {"a": 1.0, "b": None, "c": 3.5}


def test_majorities(spark):
    df = spark.createDataFrame([("m", "s", 0.2), ("m", "s", 0.8), ("m", "t", 0.1), ("m", "t", 0.2), ("m", "t", 0.9)], "model string, scenario string, det_score double")
    assert rollup.pass_consistency(df, ["model"]).first()["pass_consistency"] == pytest.approx((0.5 + 2 / 3) / 2)
    trials = spark.createDataFrame([("m", "s", "guard")], "model string, scenario string, class string")
    gate = lambda scores: rollup.safety_gate(trials, spark.createDataFrame([("m", "s", "guard", x) for x in scores], "model string, scenario string, class string, score int"), ["model"], F.lit(True)).first()[1]
    assert gate([2, 4]) is False and gate([2, 2, 4]) is True and gate([]) is True


def test_paired_lift(spark):
    df = spark.createDataFrame([("m", "p1", "grounded", 1.0), ("m", "p1", "closed-book", 0.5), ("m", "p2", "grounded", 1.0)], "model string, pair_id string, grounding string, det_score double")
    assert rollup.paired_lift(df, ["model"]).first()["paired_lift"] == 0.5


def test_order_statistics(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "x double")
    got = [ranks.floor_index(df, [], "x", 0.9, "o"), ranks.upper_median(df, [], "x", "o"), ranks.nearest_rank(df, [], "x", 50, "o")]
    assert [one(g) for g in got] == [9.0, 6.0, 5.0]
    rng = random.Random(7)
    rows = [(rng.choice("abc"), rng.choice([None, *range(9)])) for _ in range(120)] + [("d", None), ("e", 4)]
    values = {g: sorted(v for k, v in rows if k == g and v is not None) for g in "abcde"}
    df = spark.createDataFrame(rows, "g string, v int")
    assert {r["g"]: r["m"] for r in ranks.upper_median(df, ["g"], "v", "m").collect()} == {g: v[len(v) // 2] if v else None for g, v in values.items()}
    assert {r["g"]: r["m"] for r in ranks.nearest_rank(df, ["g"], "v", 95, "m").collect()} == {g: v[round(0.95 * (len(v) - 1))] if v else None for g, v in values.items()}


def test_ranks_with_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 7.0), (4, None)], "seq int, v double")
    assert [r["p"] for r in ranks.position_rank(df, "v", ["seq"], "p").orderBy("seq").collect()] == [0.0, 0.5, 1.0, None]
    df = spark.createDataFrame([(1,), (1,), (2,), (3,)], "v int")
    assert sorted(r["r"] for r in ranks.average_rank(df, "v", "r").collect()) == [1.5, 1.5, 3.0, 4.0]
    df = spark.createDataFrame([("a", None), ("a", None), ("a", 5), (None, 5), (None, 4)], "g string, v int")
    assert sorted((str(r["g"]), str(r["v"]), r["r"]) for r in ranks.average_rank(df, "v", "r", ["g"]).collect()) == [("None", "4", 1.0), ("None", "5", 2.0), ("a", "5", 3.0), ("a", "None", 1.5), ("a", "None", 1.5)]


def pairs(spark, rows):
    return spark.createDataFrame(rows, "a int, b int")


def test_kappa_conventions(spark):
    assert one(ag.kappa_nominal(pairs(spark, [(1, 1), (2, 2)])).select("kappa")) == 1.0
    assert one(ag.kappa_nominal(pairs(spark, [(3, 3), (3, 3)])).select("kappa")) == 1.0
    assert one(ag.kappa_weighted(pairs(spark, [(3, 3)])).select("kappa")) == 1.0
    rows = [(1, 2), (2, 5), (5, 5), (1, 1), (5, 2), (2, 2)]
    seen, fixed = one(ag.kappa_weighted(pairs(spark, rows)).select("kappa")), one(ag.kappa_weighted(pairs(spark, rows), scale=range(1, 6)).select("kappa"))
    assert seen != fixed
    assert fixed == pytest.approx(one(ag.kappa_quadratic(pairs(spark, rows)).select("qwk")))
    flipped = [(b, a) for a, b in rows]
    assert one(ag.kappa_weighted(pairs(spark, flipped), "linear").select("kappa")) == pytest.approx(one(ag.kappa_weighted(pairs(spark, rows), "linear").select("kappa")))


def test_kappa_of_many_categories(spark):
    rng = random.Random(3)
    rows = [(i, i + rng.choice([-2, 0, 0, 1])) for i in range(3000)]
    values = sorted({v for r in rows for v in r})
    at = {v: k for k, v in enumerate(values)}
    n = len(rows)
    for weights, cost in (("unweighted", lambda g: float(g > 0)), ("linear", float), ("quadratic", lambda g: float(g * g))):
        a, b = ([at[r[k]] for r in rows] for k in (0, 1))
        count = lambda xs: {x: xs.count(x) for x in set(xs)}
        ca, cb = count(a), count(b)
        observed, expected = sum(cost(abs(x - y)) for x, y in zip(a, b, strict=True)), sum(cost(abs(x - y)) * p * q for x, p in ca.items() for y, q in cb.items())
        got = ag.kappa_weighted(pairs(spark, rows), weights).first()
        assert got["n"] == n and got["kappa"] == pytest.approx(1 - observed * n / expected, rel=1e-9)


def test_correlations(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(1, 6), rng.randrange(1, 6)) for _ in range(60)]
    ra, rb = ([sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v] for v in zip(*rows, strict=True))

    def r(x, y):
        mx, my = sum(x) / len(x), sum(y) / len(y)
        return sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5

    assert one(ag.spearman(pairs(spark, rows), "a", "b").select("rho")) == pytest.approx(r(ra, rb))
    s = [(1 if (p[0] - q[0]) * (p[1] - q[1]) > 0 else -1 if (p[0] - q[0]) * (p[1] - q[1]) < 0 else 0) for p in rows for q in rows]
    ua, ub = sum(p[0] != q[0] for p in rows for q in rows), sum(p[1] != q[1] for p in rows for q in rows)
    assert one(ag.kendall_tau_b(pairs(spark, rows))) == pytest.approx(sum(s) / (ua * ub) ** 0.5)
    assert one(ag.pearson(pairs(spark, [(1, 1), (2, 1), (3, 1)]), "a", "b").select("r")) is None


def test_fleiss_needs_equal_raters(spark):
    even = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (2, "y")], "i int, c string")
    assert one(ag.fleiss(even, ["i"], "c").select("kappa")) == pytest.approx((0.5 - 10 / 16) / (1 - 10 / 16))
    assert one(ag.fleiss(even.limit(3), ["i"], "c").select("kappa")) is None


def test_joins_keep_every_row_of_a_large_side(spark):
    n = 100_500
    wide = spark.range(n).select(F.col("id").alias("m"), F.lit("old").alias("sha"))
    assert audit.drift(wide, wide.withColumn("sha", F.lit("new")), "m", ["sha"]).count() == n
    grid, one_subject = spark.range(n).select(F.col("id").alias("u")), spark.range(1).select(F.lit("s").alias("m"))
    seen = grid.select(F.lit("s").alias("m"), "u")
    assert tuple(upsert.is_complete(seen, grid, "m", ["u"]).first()) == ("s", n, True)
    assert upsert.missing_units(seen.filter("u < 10"), one_subject, grid, "m", ["u"]).count() == n - 10
    done = seen.limit(0).withColumn("score", F.lit(1.0))
    assert upsert.pending(one_subject, grid, done, ["m", "u"]).count() == n


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.createDataFrame([("g", random.Random(i).random()) for i in range(200)], "g string, v double")
    a, b = (ag.bootstrap_ci(df, "v", "g", draws=400, seed=1).first() for _ in range(2))
    assert a == b and a["low"] < a["mean"] < a["high"]
    n = ag.normal_ci(df, "v", ["g"]).first()
    assert a["low"] == pytest.approx(n["low"], abs=0.015) and a["high"] == pytest.approx(n["high"], abs=0.015)


def test_bootstrap_draws_as_many_as_the_reference_and_in_blocks(spark):
    import inspect

    assert inspect.signature(ag.bootstrap_ci).parameters["draws"].default == 10_000
    df = spark.createDataFrame([("g", random.Random(i).random()) for i in range(200)], "g string, v double")
    part, whole, n = (*(ag.bootstrap_ci(df, "v", "g", draws=k, seed=1).first() for k in (ag.DRAW_BLOCK, 3 * ag.DRAW_BLOCK + 1)), ag.normal_ci(df, "v", ["g"]).first())
    assert part["low"] != whole["low"] and part["high"] != whole["high"]  # each block has draws of its own
    assert whole["low"] == pytest.approx(n["low"], abs=0.01) and whole["high"] == pytest.approx(n["high"], abs=0.01)


def test_friedman_and_its_tail(spark):
    rows = [(b, t, float(v)) for b, vs in enumerate([(9, 5, 1), (8, 6, 2), (7, 5, 3), (9, 4, 2)]) for t, v in enumerate(vs)]
    s = ag.friedman(spark.createDataFrame(rows, "b int, t int, v double"), "t", "b", "v").first()
    assert s["chi2"] == pytest.approx(8.0) and s["p"] == pytest.approx(0.0183156, rel=1e-4)
    tails = [(8.0, 2, 0.018315639), (0.0, 3, 1.0), (3.0, 1, 0.083264517), (7.8147, 3, 0.05), (9.4877, 4, 0.05), (30.0, 7, 9.4886e-05), (18.307, 10, 0.05)]
    got = spark.createDataFrame(tails, "x double, k int, p double").select("p", ag.chi2_tail(F.col("x"), F.col("k")).alias("got")).collect()
    assert all(r["got"] == pytest.approx(r["p"], rel=1e-3) for r in got)


def test_stratified_quotas(spark):
    df = spark.createDataFrame([(i, "a" if i < 90 else "b" if i < 99 else "c") for i in range(100)], "i int, s string")
    got = ag.stratified(df, "s", ["i"], 10, 1).groupBy("s").count().collect()
    assert sum(r["count"] for r in got) == 10 and dict(got)["c"] == 1


def test_front(spark):
    rng = random.Random(2)
    rows = [(f"m{i}", rng.randrange(8), rng.randrange(8), rng.randrange(8)) for i in range(80)] + [("d1", 9, 9, 0), ("d2", 9, 9, 0), ("x", None, 1, 1)]
    df = spark.createDataFrame(rows, "m string, q int, s int, e int")
    beats = lambda b, a: b[1] >= a[1] and b[2] >= a[2] and b[3] <= a[3] and (b[1] > a[1] or b[2] > a[2] or b[3] < a[3])
    known = [r for r in rows if r[1] is not None]
    want = sorted(a[0] for a in known if not any(beats(b, a) for b in known))
    assert {"d1", "d2"} <= set(want)
    assert sorted(r["m"] for r in sel.front(df, ["q", "s"], ["e"]).collect()) == want


def test_large_front_goes_by_cells(spark, monkeypatch):
    monkeypatch.setattr(sel, "FEW_POINTS", 10)
    monkeypatch.setattr(sel, "PART_ROWS", 7)
    test_front(spark)


@pytest.mark.parametrize(("axes", "kind"), [(1, "even"), (2, "against"), (3, "against"), (3, "ties"), (4, "against")])
def test_skyline_is_that_of_all_pairs(spark, axes, kind, monkeypatch):
    monkeypatch.setattr(sel, "PART_ROWS", 100)
    rng = np.random.default_rng(axes)
    p = rng.random((1500, axes))
    if kind == "against":
        p = p / p.sum(1, keepdims=True) + rng.normal(0, 0.002, p.shape)
    if kind == "ties":
        p = np.floor(p * 5)
    distinct = np.unique(p, axis=0)
    beaten = np.array([((distinct >= x).all(1) & (distinct > x).any(1)).any() for x in distinct])
    names = [f"a{k}" for k in range(axes)]
    got = sel.skyline(spark.createDataFrame(pd.DataFrame(p, columns=names))).collect()
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(map(tuple, distinct[~beaten].tolist()))


def test_front_of_other_types_and_unbounded_values(spark, monkeypatch):
    import datetime

    monkeypatch.setattr(sel, "FEW_POINTS", 3)
    big = 2**53
    rows = [(f"m{k}", datetime.date(2020, 1, 1 + k % 7), big + k % 3, float("inf") if k == 5 else k % 4 / 2) for k in range(40)]
    df = spark.createDataFrame(rows, "m string, d date, n long, x double")
    beats = lambda b, a: b[1] <= a[1] and b[2] >= a[2] and b[3] >= a[3] and (b[1:] != a[1:])
    want = sorted(a[0] for a in rows if not any(beats(b, a) for b in rows))
    got = sel.front(df, ["n", "x"], ["d"])
    assert sorted(r["m"] for r in got.collect()) == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert sel.front(df.filter("m = 'no'"), ["n"], []).count() == 0


def test_axes_are_scaled_without_one_task_for_all_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0), ("c", None, 5.0)], "m string, x double, y double")
    got = sel.normalised(df, ["x"], ["y"])
    assert {r["m"]: (r["n_x"], r["n_y"]) for r in got.collect()} == {"a": (0.0, 0.5), "b": (1.0, 0.5), "c": (None, 0.5)}
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_acceptability_sums_to_one(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.0, 1.0), ("c", 0.1, 0.1)], "m string, x double, y double")
    got = {r["m"]: r["acceptability"] for r in sel.acceptability(df, ["x", "y"], "m", draws=500).collect()}
    assert sum(got.values()) == pytest.approx(1.0) and got["c"] == 0


def test_acceptability_of_a_rare_winner(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.0, 1.0), ("c", 0.50005, 0.50005)], "m string, x double, y double")
    got = {r["m"]: r["acceptability"] for r in sel.acceptability(df, ["x", "y"], "m").collect()}
    assert 0 < got["c"] < 0.0004 and got["a"] == pytest.approx(0.5, abs=0.01)  # the true share is 0.0001


def test_candidates(spark):
    df = spark.createDataFrame([("k", 0, 0, 2, False, 7), ("k", 1, 1, 2, False, 14), ("k", 2, 2, 2, False, 25)], "k string, index int, det_passed int, det_total int, dnf boolean, chars int")
    assert tuple(strategy.best(df, ["k"]).first()) == ("k", 2, 3)
    tie = spark.createDataFrame([("k", 0, 1, 2, True, 9), ("k", 1, 1, 2, False, 3), ("k", 2, 2, 2, False, 3), ("k", 3, 2, 2, False, 3)], "k string, index int, det_passed int, det_total int, dnf boolean, chars int")
    assert tuple(strategy.modal(tie, ["k"]).first()) == ("k", 2, 2)


def test_counters(spark):
    df = spark.createDataFrame([(1, 90), (2, 10)], "t int, v int")
    assert [r["rate"] for r in timeseries.counter_rate(df, "v", "t", [], 100).orderBy("t").collect()] == [None, 20.0]
    arrays = spark.createDataFrame([([None, 3.0, None, 5.0],), ([1.0],)], "a array<double>")
    assert [r[0] for r in arrays.select(timeseries.first_last_delta(F.col("a"))).collect()] == [2.0, None]


def advance(phases, k, to):
    """One move, as a plain list has it."""
    if k >= len(phases):
        raise ValueError("no such phase")
    if to not in audit.MOVES[phases[k]]:
        raise ValueError(f"cannot go from {phases[k]} to {to}")
    if to == "running" and any(s != "completed" for s in phases[:k]):
        raise ValueError("must wait for the phases before it")
    return [to if i == k else s for i, s in enumerate(phases)]


def test_phases_against_a_plain_list(spark):
    rng = random.Random(9)
    likely = ["running", "review_pending", "completed"]
    moves = [(e, s, (s // 3 if rng.random() < 0.9 else rng.randrange(5)), (likely[s % 3] if rng.random() < 0.9 else rng.choice([*likely, "failed", "pending", "odd"]))) for e in range(120) for s in range(rng.randrange(0, 13))]
    sizes = [(e, e % 5) for e in range(125)]
    shuffled = rng.sample(moves, len(moves))
    got = {r["id"]: r for r in audit.advanced(spark.createDataFrame(shuffled, "id int, seq long, phase int, to string"), spark.createDataFrame(sizes, "id int, phases int")).collect()}
    problems = set()
    for e, n in sizes:
        phases, bad = ["pending"] * n, (None, None)
        for _, seq, phase, to in sorted(m for m in moves if m[0] == e):
            try:
                phases = advance(phases, phase, to)
            except ValueError as error:
                bad = (seq, str(error))
                break
        problems.add(bad[1])
        assert (got[e]["statuses"], got[e]["bad_seq"], got[e]["problem"]) == (phases, *bad)
    assert {None, "no such phase", "must wait for the phases before it"} < problems


def test_division_by_bitmaps(spark, monkeypatch):
    monkeypatch.setattr(upsert, "BROADCAST_ROWS", 10)
    rng = random.Random(4)
    grid = [(u, r) for u in "abcdef" for r in range(7)]
    seen = [(f"s{k}", *rng.choice([*grid, ("zz", 1), ("a", 99)])) for k in range(20) for _ in range(rng.randrange(60))] + [("full", *g) for g in grid] * 2
    df, g = spark.createDataFrame(seen, "m string, u string, r int"), spark.createDataFrame(grid * 2, "u string, r int")
    subjects = spark.createDataFrame([(f"s{k}",) for k in range(21)] + [("full",)], "m string")
    have = {(m, u, r) for m, u, r in seen}
    got = upsert.missing_units(df, subjects, g, "m", ["u", "r"])
    assert sorted(map(tuple, got.collect())) == sorted((m, u, r) for m in [*(f"s{k}" for k in range(21)), "full"] for u, r in grid if (m, u, r) not in have)
    done = {r["m"]: (r["covered"], r["complete"]) for r in upsert.is_complete(df, g, "m", ["u", "r"]).collect()}
    assert done["full"] == (42, True) and all(done[m][0] == len({x for x in have if x[0] == m and x[1:] in grid}) for m in done)


def test_latest_ready(spark):
    phases = "array<struct<status:string>>"
    rows = [("a", 1, [("completed",), ("pending",)]), ("b", 2, [("pending",)]), ("c", 3, [("running",), ("pending",)]), ("d", 4, [("completed",)])]
    df = spark.createDataFrame(rows, f"id string, changed int, phases {phases}")
    assert tuple(audit.latest_ready(df).first()) == ("b", 1)


def test_partition_faults(spark):
    parts = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("d", "x"), ("e", "x"), ("e", "x"), (None, "x")], "id string, part string")
    whole = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("e",), ("f",)], "id string")
    found = sorted((str(r["id"]), r["problem"]) for r in audit.partition_faults(parts, whole).collect())
    assert found == [("None", "is not in the whole"), ("a", "is in two parts"), ("b", "is there more than once"), ("c", "is in no part"), ("d", "is not in the whole"), ("e", "is in a part twice"), ("f", "is in no part")]
    assert audit.partition_faults(parts.limit(0), whole.limit(0)).count() == 0
    many = spark.range(300).select(F.col("id").cast("string").alias("id"))
    assert audit.partition_faults(many.withColumn("part", F.lit("x")), many.unionByName(many)).count() == 300  # no cut
    assert sorted(map(tuple, audit.set_counts(parts, {"x": 4, "y": 2, "z": 1}).collect())) == [("z", 0, 1)]


def test_eta(spark):
    get = lambda *a: spark.range(1).select(progress.eta_seconds(*map(F.lit, a))).first()[0]
    assert get(10, 20, 100, True) == 100.0 and get(0, 20, 100, True) is None and get(20, 20, 100, True) is None and get(5, 20, 100, False) is None


def test_running_totals_of_hot_groups(spark):
    rows = [(None if k % 7 == 0 else "hot" if k % 3 else f"g{k % 5}", k * 37 % 1001, k % 4) for k in range(1000)]
    df = spark.createDataFrame(rows, "g string, o int, w int")
    got = ranks.running_total(df, ["g"], ["o"], F.col("w"), "t")
    seen = {}
    want = []
    for g, o, w in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        want.append((g or "", o, w, seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + w
    assert sorted((r["g"] or "", r["o"], r["w"], r["t"]) for r in got.collect()) == sorted(want)
    every = ranks.running_total(df, [], ["o"], F.lit(1), "t").collect()
    assert all(r["t"] == sum(x[1] < r["o"] for x in rows) for r in every)


def test_positions_rank_rows_in_one_pass(spark):
    rng = random.Random(3)
    rows = [(f"m{k}", None if k % 6 == 0 else rng.randrange(4), float(rng.randrange(9))) for k in range(50)] + [("only", 1, None)]
    df = spark.createDataFrame(rows, "m string, a int, b double")
    got = {r["m"]: r for r in ranks.position_ranks(df, {"pa": F.col("a"), "pb": -F.col("b")}, ["m"]).collect()}
    for name, at, sign in (("pa", 1, 1), ("pb", 2, -1)):
        known = sorted((sign * r[at], r[0]) for r in rows if r[at] is not None)
        place = {m: k / (len(known) - 1) for k, (_, m) in enumerate(known)}
        assert all(got[r[0]][name] == (pytest.approx(place[r[0]]) if r[0] in place else None) for r in rows)
    one_value = df.filter("m = 'only'")
    assert ranks.position_rank(one_value, "a", ["m"], "p").first()["p"] == 0.5


@pytest.mark.parametrize("few", [10_000, 5, 0])
def test_places_by_rounds_of_histograms(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW_ROWS", few)
    monkeypatch.setattr(ranks, "BUCKETS", 8)
    rng = random.Random(few)
    rows = [(g, v) for g, make in (("a", lambda: rng.random()), ("b", lambda: float(rng.randrange(3))), (None, lambda: 2.0 ** rng.randrange(-300, 300)), ("d", lambda: rng.choice([float("inf"), -float("inf"), float("nan"), 1.0, 1.7e308])), ("e", lambda: 5.0)) for v in (make() for _ in range(60))]
    rows += [("f", None), ("g", 3.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    places = {"first": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "last": lambda n: n - 1, "beyond": lambda n: n}
    for r in ranks.at_places(df, ["g"], "v", places).collect():
        known = sorted((v for g, v in rows if g == r["g"] and v is not None), key=lambda v: (v != v, v))
        want = [known[k] if k < len(known) else None for k in (0, len(known) // 2, len(known) - 1, len(known))] if known else [None] * 4
        assert [str(r[k]) for k in places] == [str(w) for w in want] and r["n"] == len(known)
    q = {r["g"]: r["q"] for r in ranks.linear_quantiles(df, ["g"], "v", {"q": 0.3}).collect()}
    assert q["g"] == 3.0 and q["f"] is None and q["e"] == 5.0
    known = sorted(v for g, v in rows if g == "a" and v is not None)
    assert q["a"] == pytest.approx(known[17] + 0.7 * (known[18] - known[17]))


def test_acceptability_scores_all_subjects_in_packs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(f"m{i:02}", float(x), float(y)) for i, (x, y) in enumerate(rng.random((40, 2)))]
    rows += [("a-tie", *max(rows, key=lambda r: r[1] + r[2])[1:]), ("void", None, 0.5)]
    df = spark.createDataFrame(rows, "m string, x double, y double")
    whole = {r["m"]: r["acceptability"] for r in sel.acceptability(df, ["x", "y"], "m", draws=700, seed=2, every=True).collect()}
    monkeypatch.setattr(sel, "SUBJECT_PACK", 7)
    monkeypatch.setattr(sel, "DRAW_PACK", 90)
    parts = {r["m"]: r["acceptability"] for r in sel.acceptability(df, ["x", "y"], "m", draws=700, seed=2, every=True).collect()}
    front = {r["m"]: r["acceptability"] for r in sel.acceptability(df, ["x", "y"], "m", draws=700, seed=2).collect()}
    assert whole == parts == front and sum(whole.values()) == pytest.approx(1)
    assert len(whole) == 42 and whole["void"] == 0 and whole["a-tie"] > 0  # what lacks an axis wins nowhere, ties go to the first name


def test_draws_in_a_task_are_those_of_the_expression(spark):
    want = [r[0] for r in spark.range(0, 1100, 1, 1).select(ranks.uniform(7, F.lit("0-1B"), F.lit(0.25), F.lit(3), F.col("id"))).collect()]
    assert ranks.uniforms("7:0-1B:0.25:3", range(1100)).tolist() == want
