"""Order statistics, ranks, de-duplication and time-ordered picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialmill.operators import ranks, upsert
from trialmill.operators.rollup import mean
from trialmill.plans.base import judged, query, table, trials

C = F.col
KEY = ["model", "scenario", "rep"]


@query("a02_mean", "SELECT model, sum(energy_wh) / nullif(count(energy_wh), 0) AS m FROM trials GROUP BY 1")
def a02(spark, d):
    return trials(spark, d).groupBy("model").agg(mean(C("energy_wh")).alias("m"))


@query("a03_median", "SELECT model, median(tok_s) AS m FROM trials GROUP BY 1")
def a03(spark, d):
    return trials(spark, d).groupBy("model").agg(F.median("tok_s").alias("m"))


@query("a04_upper_median", "SELECT model, list_sort(list(tok_s))[count(*) // 2 + 1] AS m FROM trials GROUP BY 1")
def a04(spark, d):
    return ranks.upper_median(trials(spark, d), ["model"], "tok_s", "m")


@query("a05_p90_floor", "SELECT model, list_sort(list(tok_s))[floor(0.9 * (count(*) - 1))::INT + 1] AS p FROM trials GROUP BY 1")
def a05(spark, d):
    return ranks.floor_index(trials(spark, d), ["model"], "tok_s", 0.9, "p")


@query("a06_p95_nearest", "SELECT model, list_sort(list(tok_s))[round_even(0.95 * (count(*) - 1), 0)::INT + 1] AS p FROM trials GROUP BY 1")
def a06(spark, d):
    return ranks.nearest_rank(trials(spark, d), ["model"], "tok_s", 95, "p")


@query("a07_linear_quantile", "SELECT bracket, quantile_cont(tok_s, 0.25) AS q FROM trials GROUP BY 1")
def a07(spark, d):
    return ranks.linear_quantiles(trials(spark, d), ["bracket"], "tok_s", {"q": 0.25})


@query("a08_first_and_extremes", "SELECT model, max(coalesce(peak_swap_mb, 0)) AS swap, arg_min(energy_wh, seq) FILTER (energy_wh IS NOT NULL) AS first_wh, bool_or(dnf) AS any_dnf FROM trials GROUP BY 1")
def a08(spark, d):
    return trials(spark, d).groupBy("model").agg(
        F.max(F.coalesce("peak_swap_mb", F.lit(0))).alias("swap"), F.min_by("energy_wh", F.when(C("energy_wh").isNotNull(), C("seq"))).alias("first_wh"), F.bool_or("dnf").alias("any_dnf")
    )


SUBJECTS = ", s AS (SELECT model, median(tok_s) AS v FROM trials GROUP BY 1)"


def _subjects(spark, d):
    return trials(spark, d).groupBy("model").agg(F.median("tok_s").alias("v"))


@query("w01_position_rank", SUBJECTS + "SELECT model, (row_number() OVER (ORDER BY v, model) - 1)::DOUBLE / (count(*) OVER () - 1) AS p FROM s")
def w01(spark, d):
    return ranks.position_rank(_subjects(spark, d), "v", ["model"], "p").select("model", "p")


@query("w02_average_rank", "SELECT seq, rank() OVER (PARTITION BY scenario ORDER BY det_score) + (count(*) OVER (PARTITION BY scenario, det_score) - 1) / 2e0 AS r FROM trials")
def w02(spark, d):
    return ranks.average_rank(trials(spark, d), "det_score", "r", ["scenario"]).select("seq", "r")


@query("w03_bracket_steps", ", b AS (SELECT bracket_ord, bracket, sum(det_score) / count(*) AS q FROM trials GROUP BY 1, 2) SELECT bracket, q, q - lag(q) OVER (ORDER BY bracket_ord) AS step FROM b")
def w03(spark, d):
    cells = trials(spark, d).groupBy("bracket_ord", "bracket").agg(mean(C("det_score")).alias("q"))
    return ranks.step_between(cells, "q", "bracket_ord", "step").select("bracket", "q", "step")


@query("w04_keep_best", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, l_partkey, l_suppkey) = 1", views=False)
def w04(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    best = ranks.pick(lines, ["l_orderkey", "l_linenumber"], [-C("l_quantity"), C("l_partkey"), C("l_suppkey")])
    return best.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("w04_dedup_best", "SELECT model, scenario, memory, seq, det_score FROM trials WHERE fatal IS NULL QUALIFY row_number() OVER (PARTITION BY model, scenario, memory ORDER BY coalesce(det_score, 0) DESC, seq) = 1")
def w04b(spark, d):
    rows = trials(spark, d).select("model", "scenario", "memory", "seq", "det_score", "fatal")
    return upsert.dedup_best(rows, ["model", "scenario", "memory"], "det_score", "seq").select("model", "scenario", "memory", "seq", "det_score")


@query("w05_last_wins", "SELECT model, scenario, arg_max(det_score, seq) AS det_score, max(seq) AS seq FROM trials GROUP BY 1, 2")
def w05(spark, d):
    return ranks.last_wins(trials(spark, d).select("model", "scenario", "det_score", "seq"), ["model", "scenario"], "seq")


@query("w06_first_wins", "SELECT model, scenario, arg_min(det_score, seq) AS det_score, min(seq) AS seq FROM trials GROUP BY 1, 2")
def w06(spark, d):
    return ranks.first_wins(trials(spark, d).select("model", "scenario", "det_score", "seq"), ["model", "scenario"], "seq")


@query("a43_representative", "SELECT model, seq, peak_swap_mb FROM trials WHERE peak_swap_mb IS NOT NULL QUALIFY row_number() OVER (PARTITION BY model ORDER BY seq) = 1")
def a43(spark, d):
    return upsert.representative(trials(spark, d).select("model", "seq", "peak_swap_mb"), "model", "peak_swap_mb", "seq")


@query("w13_group_extreme", ", s AS (SELECT bracket, model, median(tok_s) AS v FROM trials GROUP BY 1, 2) SELECT model, v = min(v) OVER (PARTITION BY bracket) AS slowest FROM s")
def w13(spark, d):
    from pyspark.sql import Window

    cells = trials(spark, d).groupBy("bracket", "model").agg(F.median("tok_s").alias("v"))
    return cells.select("model", (C("v") == F.min("v").over(Window.partitionBy("bracket"))).alias("slowest"))


@query("a23_duplicates", "SELECT coalesce(sum(c - 1), 0)::BIGINT AS duplicates FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)", views=False)
def a23(spark, d):
    return upsert.duplicate_count(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("a41_completeness", "SELECT model, count(*) AS rows, count(*) >= 70 - 2 AS complete FROM trials GROUP BY 1")
def a41(spark, d):
    return upsert.completeness(trials(spark, d), "model", 70)


def _two_deliveries(spark, d):
    """All trials, and changed copies of all one repetition on: most keys are in both, first and last ones in one."""
    rows = trials(spark, d).select(*KEY, "det_score", "seq")
    return rows, rows.withColumn("rep", C("rep") + 1).withColumn("det_score", 1 - C("det_score"))


@query("t11_upsert_newer", ", c AS (SELECT model, scenario, rep, det_score, seq FROM trials), n AS (SELECT model, scenario, rep + 1 AS rep, 1 - det_score AS det_score, seq FROM trials) "
       "SELECT model, scenario, rep, coalesce(n.det_score, c.det_score) AS det_score, coalesce(c.seq, n.seq) AS seq FROM c FULL JOIN n USING (model, scenario, rep)")  # fmt: skip
def t11_newer(spark, d):
    return upsert.upsert_newer(*_two_deliveries(spark, d), KEY, "seq")


@query("t11_upsert_better", ", c AS (SELECT model, scenario, rep, det_score, seq FROM trials), n AS (SELECT model, scenario, rep + 1 AS rep, 1 - det_score AS det_score, seq FROM trials) "
       "SELECT model, scenario, rep, CASE WHEN c.seq IS NULL THEN n.det_score WHEN n.seq IS NULL THEN c.det_score ELSE greatest(n.det_score, c.det_score) END AS det_score, coalesce(c.seq, n.seq) AS seq "
       "FROM c FULL JOIN n USING (model, scenario, rep)")  # fmt: skip
def t11_better(spark, d):
    return upsert.upsert_better(*_two_deliveries(spark, d), KEY, "seq", "det_score")


@query("o09_seeded_shuffle", "SELECT model, scenario, rep, md5(concat_ws(':', 11, model, scenario, rep)) AS draw FROM trials ORDER BY draw, model, scenario, rep")
def o09(spark, d):
    return ranks.seeded_order(trials(spark, d).select(*KEY), KEY, 11, "draw")


@query("s14_tail", "SELECT seq, model FROM (SELECT * FROM trials ORDER BY seq DESC LIMIT 30) ORDER BY seq")
def s14(spark, d):
    return ranks.tail(trials(spark, d).select("seq", "model"), 30, "seq")


@query("o02_bracket_order", "SELECT * FROM (SELECT bracket, model, count(*) AS n FROM trials GROUP BY 1, 2) ORDER BY CASE bracket WHEN '0-1B' THEN 0 WHEN '1-2B' THEN 1 WHEN '2-3B' THEN 2 WHEN '3-4B' THEN 3 WHEN '4-5GB' THEN 4 ELSE 9 END, model")
def o02(spark, d):
    from trialmill.plans.base import BRACKETS

    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(b) for b in BRACKETS]), C("bracket")), F.lit(0)), F.lit(9))
    return trials(spark, d).groupBy("bracket", "model").agg(F.count("*").alias("n")).orderBy(place, "model")


@query("o04_top_k", "SELECT model, sum(energy_wh) AS wh FROM trials GROUP BY 1 ORDER BY wh DESC, model LIMIT 6")
def o04(spark, d):
    return trials(spark, d).groupBy("model").agg(F.sum("energy_wh").alias("wh")).orderBy(F.desc("wh"), "model").limit(6)


@query("a39_bracket_median_threshold", "SELECT bracket, median(tok_s) AS tok_s, median(tok_s) >= 8 AS interactive FROM trials GROUP BY 1")
def a39(spark, d):
    return ranks.linear_quantiles(trials(spark, d), ["bracket"], "tok_s", {"tok_s": 0.5}).withColumn("interactive", C("tok_s") >= 8)


@query("x_rollup_cube", "SELECT bracket, class, count(*) AS n, sum(det_score) AS s FROM trials GROUP BY CUBE (bracket, class)")
def x_cube(spark, d):
    """Extension: sub-totals over the two dimensions of the matrices."""
    return trials(spark, d).cube("bracket", "class").agg(F.count("*").alias("n"), F.sum("det_score").alias("s"))


@query("j01_mean_rating", ", j AS (SELECT model, scenario, rep, memory, sum(score)::DOUBLE / count(score) AS judge_score FROM judged GROUP BY ALL) SELECT model, scenario, rep, memory, judge_score FROM trials LEFT JOIN j USING (model, scenario, rep, memory)")
def j01(spark, d):
    key = [*KEY, "memory"]
    means = judged(spark, d).groupBy(*key).agg(mean(C("score")).alias("judge_score"))
    return trials(spark, d).select(*key).join(means, key, "left")
