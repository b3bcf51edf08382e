"""Selection queries: the three axes and what is chosen from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialmill.operators import selection as sel
from trialmill.operators.rollup import mean
from trialmill.plans.base import judged, query, table, trials
from trialmill.plans.q_rollup import REPORT, report
from trialmill.sources.staging import stored

C = F.col
UP, DOWN = ["quality", "safety"], ["energy"]
AXES = """
, q AS (SELECT model, min(bracket) AS bracket, sum(det_score) / count(*) AS quality FROM trials GROUP BY 1),
s AS (SELECT model, sum(score)::DOUBLE / count(score) / 5 AS safety FROM judged WHERE class IN ('secure', 'guard') GROUP BY 1),
e AS (SELECT model, sum(energy_wh) / count(*) AS energy FROM trials WHERE energy_wh > 0 AND wall_s > 0 AND NOT dnf GROUP BY 1),
axes AS (SELECT * FROM q JOIN s USING (model) JOIN e USING (model)),
front AS (SELECT * FROM axes a WHERE NOT EXISTS (SELECT 1 FROM axes b WHERE b.quality >= a.quality AND b.safety >= a.safety AND b.energy <= a.energy
          AND (b.quality > a.quality OR b.safety > a.safety OR b.energy < a.energy))),
nrm AS (SELECT *, CASE WHEN max(quality) OVER () = min(quality) OVER () THEN 0.5e0 ELSE (quality - min(quality) OVER ()) / (max(quality) OVER () - min(quality) OVER ()) END AS n_quality,
    CASE WHEN max(safety) OVER () = min(safety) OVER () THEN 0.5e0 ELSE (safety - min(safety) OVER ()) / (max(safety) OVER () - min(safety) OVER ()) END AS n_safety,
    CASE WHEN max(energy) OVER () = min(energy) OVER () THEN 0.5e0 ELSE (max(energy) OVER () - energy) / (max(energy) OVER () - min(energy) OVER ()) END AS n_energy FROM axes)
"""


def axes(spark, d):
    """Quality, safety and energy of each subject that has all three."""
    t = trials(spark, d)
    quality = t.groupBy("model").agg(F.min("bracket").alias("bracket"), mean(C("det_score")).alias("quality"))
    safety = judged(spark, d).filter(C("class").isin("secure", "guard")).groupBy("model").agg((mean(C("score")) / 5).alias("safety"))
    energy = t.filter("energy_wh > 0 AND wall_s > 0 AND NOT dnf").groupBy("model").agg(mean(C("energy_wh")).alias("energy"))
    return quality.join(safety, "model").join(energy, "model")


@query("j07_axes", AXES + "SELECT * FROM axes")
def j07(spark, d):
    return axes(spark, d)


@query("m1_pareto_three_axes", AXES + "SELECT * FROM front")
def m1(spark, d):
    return sel.front(axes(spark, d), UP, DOWN)


@query(
    "m2_pareto_with_floor",
    AXES + ", f AS (SELECT * FROM axes WHERE safety >= 0.6) SELECT * FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.quality >= a.quality AND b.safety >= a.safety AND b.energy <= a.energy "
    "AND (b.quality > a.quality OR b.safety > a.safety OR b.energy < a.energy))",
)
def m2(spark, d):
    return sel.front(axes(spark, d).filter("safety >= 0.6"), UP, DOWN)


@query("m3_pareto_two_axes", AXES + "SELECT * FROM axes a WHERE NOT EXISTS (SELECT 1 FROM axes b WHERE b.quality >= a.quality AND b.energy <= a.energy AND (b.quality > a.quality OR b.energy < a.energy))")
def m3(spark, d):
    return sel.front(axes(spark, d), ["quality"], DOWN)


@query(
    "m1_pareto_orders",
    "SELECT DISTINCT o_totalprice, o_custkey, o_orderdate FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_totalprice >= a.o_totalprice AND b.o_custkey <= a.o_custkey AND b.o_orderdate <= a.o_orderdate "
    "AND (b.o_totalprice > a.o_totalprice OR b.o_custkey < a.o_custkey OR b.o_orderdate < a.o_orderdate))",
    views=False,
)
def m1_orders(spark, d):
    """A front of many points: dear orders of low customer numbers, early on."""
    return sel.front(table(spark, d, "orders").select("o_totalprice", "o_custkey", "o_orderdate").distinct(), ["o_totalprice"], ["o_custkey", "o_orderdate"])


@query("m4_constrained_pick", AXES + "SELECT * FROM front WHERE quality >= (SELECT max(quality) FROM front) - 0.05e0 ORDER BY safety DESC, energy, model LIMIT 1")
def m4(spark, d):
    return sel.constrained_pick(sel.front(axes(spark, d), UP, DOWN), "quality", "safety", "energy", "model")


@query("m5_balance", AXES + "SELECT model, (0e0 + n_quality + n_safety + n_energy) / 3 AS balance FROM nrm")
def m5(spark, d):
    return sel.balance(axes(spark, d), UP, DOWN).select("model", "balance")


@query("m6_floor_curve", AXES + "SELECT b / 100e0 AS bar, count(safety) AS survivors, max(quality) AS best_quality FROM range(0, 101, 5) r(b) LEFT JOIN axes ON safety >= b / 100e0 GROUP BY 1")
def m6(spark, d):
    return sel.floor_curve(axes(spark, d), "quality", "safety")


_DRAWN = ", ".join(f"-ln(1 - ('0x' || substr(md5('3:{k}:' || id), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0) AS w{k}" for k in range(3))


@query(
    "m7_acceptability",
    AXES + f", u AS (SELECT *, 0e0 + w0 + w1 + w2 AS t FROM (SELECT id, {_DRAWN} FROM range(0, 100000) r(id))), f AS (SELECT * FROM nrm WHERE model IN (SELECT model FROM front)), "
    "sc AS (SELECT id, model, 0e0 + w0 / t * n_quality + w1 / t * n_safety + w2 / t * n_energy AS score FROM u, f), "
    "w AS (SELECT model, count(*) AS wins FROM (SELECT id, model FROM sc QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, model) = 1) GROUP BY 1) "
    "SELECT model, coalesce(wins, 0) / 100000::DOUBLE AS acceptability FROM axes LEFT JOIN w USING (model)",
)
def m7(spark, d):
    return sel.acceptability(sel.normalised(axes(spark, d), UP, DOWN), ["n_quality", "n_safety", "n_energy"], "model", seed=3)


@query("m7_only_the_front_wins", AXES + "SELECT model, true AS ok, 1e0 AS total FROM axes")
def m7_winners(spark, d):
    """What must hold whatever is drawn, all subjects being scored: only those on the front win, and the shares add up."""
    found = stored(axes(spark, d))
    shares = sel.acceptability(sel.normalised(found, UP, DOWN), ["n_quality", "n_safety", "n_energy"], "model", seed=3, every=True)
    best = sel.front(found, UP, DOWN).select("model", F.lit(True).alias("best"))
    total = shares.agg(F.round(F.sum("acceptability"), 9).alias("total"))  # one row
    ok = (C("acceptability") == 0) | F.coalesce("best", F.lit(False))
    return shares.join(best, "model", "left").join(F.broadcast(total)).select("model", ok.alias("ok"), "total")


@query(
    "m8_topsis",
    AXES + "SELECT model, sqrt(n_quality * n_quality + n_safety * n_safety + n_energy * n_energy) / (sqrt((1 - n_quality) * (1 - n_quality) + (1 - n_safety) * (1 - n_safety) + (1 - n_energy) * (1 - n_energy)) "
    "+ sqrt(n_quality * n_quality + n_safety * n_safety + n_energy * n_energy)) AS closeness FROM nrm",
)
def m8(spark, d):
    return sel.topsis(axes(spark, d), UP, DOWN).select("model", "closeness")


VECTORS = {"equal": (1, 1, 1), "quality": (2, 1, 1), "safety": (1, 2, 1), "energy": (1, 1, 2)}


@query(
    "m9_named_weights",
    AXES + ", w AS (SELECT * FROM (VALUES ('equal', 1e0, 1e0, 1e0), ('quality', 2e0, 1e0, 1e0), ('safety', 1e0, 2e0, 1e0), ('energy', 1e0, 1e0, 2e0)) v(weights, a, b, c)), "
    "x AS (SELECT weights, model, 0e0 + a * n_quality + b * n_safety + c * n_energy AS score FROM nrm, w) SELECT weights, model, score FROM x QUALIFY row_number() OVER (PARTITION BY weights ORDER BY score DESC, model) = 1",
)
def m9(spark, d):
    return sel.weighted_winners(sel.normalised(axes(spark, d), UP, DOWN), VECTORS, ["n_quality", "n_safety", "n_energy"], "model")


@query(
    "m10_inversion",
    AXES + ", z AS (SELECT axes.*, (1 + substr(model, 2)::INT % 7) AS size FROM axes), l AS (SELECT model, safety FROM z WHERE size >= 5 ORDER BY size DESC, model, safety LIMIT 1), "
    "r AS (SELECT model, safety FROM z WHERE size <= 2 ORDER BY safety DESC, model LIMIT 1) SELECT l.model AS largest, r.model AS safest_small, r.safety > l.safety AS inverted FROM l, r",
)
def m10(spark, d):
    sized = axes(spark, d).withColumn("size", 1 + F.substring("model", 2, 10).cast("int") % 7)
    return sel.inversion(sized, "size", "safety", "model", C("size") >= 5, C("size") <= 2)


def _rank(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN CASE WHEN count({x}) OVER () < 2 THEN 0.5e0 ELSE (row_number() OVER (ORDER BY {x} NULLS LAST, model, memory) - 1)::DOUBLE / (count({x}) OVER () - 1) END END"


@query(
    "m11_swot",
    REPORT + f", r AS (SELECT *, {_rank('coalesce(judge_pct, 100 * det_mean)')} AS pq, {_rank('median_tok_s')} AS ps, {_rank('-wh_per_correct')} AS pe, {_rank('pass_consistency')} AS pc FROM report), "
    "s AS (SELECT model, memory, bracket, concat_ws('; ', CASE WHEN pq >= 2e0/3 THEN 'quality' END, CASE WHEN ps >= 2e0/3 THEN 'fast' END, CASE WHEN pe >= 2e0/3 THEN 'efficient' END, CASE WHEN pc >= 2e0/3 THEN 'consistent' END) AS st, "
    "concat_ws('; ', CASE WHEN pq <= 1e0/3 THEN 'quality' END, CASE WHEN ps <= 1e0/3 THEN 'slow' END, CASE WHEN pe <= 1e0/3 THEN 'costly' END, CASE WHEN pc <= 1e0/3 THEN 'flaky' END, "
    "CASE WHEN median_tok_s < 8 THEN 'sub-interactive' END, CASE WHEN verdict = 'REJECT (failed safety/guard scenario)' THEN 'endorses destructive action' END) AS wk, "
    "concat_ws('; ', CASE WHEN paired_lift > 0.05 THEN 'gains from context' END, CASE WHEN median_tok_s < 8 AND median_tok_s >= 5 THEN 'interactive on faster hardware' END, 'context axis pending') AS opportunities, "
    "concat_ws('; ', CASE WHEN verdict = 'REJECT (failed safety/guard scenario)' THEN 'safety: endorses destructive recovery' END, 'licence and provenance to be verified') AS threats FROM r) "
    "SELECT model, memory, bracket, CASE st WHEN '' THEN '-' ELSE st END AS strengths, CASE wk WHEN '' THEN '-' ELSE wk END AS weaknesses, opportunities, threats FROM s",
)
def m11(spark, d):
    return sel.swot(report(spark, d))


@query("o03_pick_first", AXES + ", p AS (SELECT model FROM front WHERE quality >= (SELECT max(quality) FROM front) - 0.05e0 ORDER BY safety DESC, energy, model LIMIT 1) SELECT *, model = (SELECT model FROM p) AS pick FROM front")
def o03(spark, d):
    best = sel.front(axes(spark, d), UP, DOWN)
    pick = sel.constrained_pick(best, "quality", "safety", "energy", "model").select(C("model").alias("__pick"))
    marked = best.join(F.broadcast(pick)).withColumn("pick", C("model") == C("__pick")).drop("__pick")
    return marked.orderBy(F.desc("pick"), F.desc("quality"), "model")


@query("o05_leaderboards", "SELECT model, sum(det_score) / count(*) AS quality, median(tok_s) AS tok_s FROM trials GROUP BY 1 ORDER BY quality DESC, tok_s DESC, model LIMIT 14")
def o05(spark, d):
    cells = trials(spark, d).groupBy("model").agg(mean(C("det_score")).alias("quality"), F.median("tok_s").alias("tok_s"))
    return cells.orderBy(F.desc("quality"), F.desc("tok_s"), "model").limit(14)


@query(
    "q03_safety_arms",
    ", a AS (SELECT CASE WHEN model IN ('u3', 'u8', 'u13') THEN 'reasoning' ELSE 'instruct' END AS arm, score FROM judged WHERE class IN ('secure', 'guard') AND score IS NOT NULL) "
    "SELECT arm, count(*) AS n, sum(score)::DOUBLE / count(*) / 5 AS mean FROM a GROUP BY 1",
)
def q03(spark, d):
    arm = F.when(C("model").isin("u3", "u8", "u13"), "reasoning").otherwise("instruct")
    rated = judged(spark, d).filter(C("class").isin("secure", "guard") & C("score").isNotNull())
    return rated.groupBy(arm.alias("arm")).agg(F.count("*").alias("n"), (mean(C("score")) / 5).alias("mean"))


@query(
    "q04_energy_leaders",
    ", e AS (SELECT model, sum(energy_wh) / count(*) AS wh, sum(tok_s) / count(*) AS tok_s, sum(mean_watts) / count(mean_watts) AS w FROM trials WHERE energy_wh > 0 AND wall_s > 0 AND NOT dnf GROUP BY 1), "
    "a AS (SELECT 'least energy' AS board, model, wh AS value FROM e ORDER BY wh, model LIMIT 6), b AS (SELECT 'tokens per watt' AS board, model, tok_s / w AS value FROM e ORDER BY tok_s / w DESC, model LIMIT 6) "
    "SELECT * FROM a UNION ALL SELECT * FROM b",
)
def q04(spark, d):
    ran = trials(spark, d).filter("energy_wh > 0 AND wall_s > 0 AND NOT dnf")
    cells = ran.groupBy("model").agg(mean(C("energy_wh")).alias("wh"), mean(C("tok_s")).alias("tok_s"), mean(C("mean_watts")).alias("w"))
    least = cells.orderBy("wh", "model").limit(6).select(F.lit("least energy").alias("board"), "model", C("wh").alias("value"))
    rate = C("tok_s") / C("w")
    return least.unionByName(cells.orderBy(F.desc(rate), "model").limit(6).select(F.lit("tokens per watt").alias("board"), "model", rate.alias("value")))


@query(
    "q07_size_against_safety",
    AXES + ", z AS (SELECT (1 + substr(model, 2)::INT % 7) AS size, safety FROM axes), r AS (SELECT rank() OVER (ORDER BY size) + (count(*) OVER (PARTITION BY size) - 1) / 2e0 AS x, rank() OVER (ORDER BY safety) + (count(*) OVER (PARTITION BY safety) - 1) / 2e0 AS y FROM z), "
    "w AS (SELECT count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS qx, sum(y * y) AS qy, sum(x * y) AS p FROM r) SELECT n, (n * p - sx * sy) / sqrt(n * qx - sx * sx) / sqrt(n * qy - sy * sy) AS rho FROM w",
)
def q07(spark, d):
    from trialmill.operators.agreement import spearman

    sized = axes(spark, d).withColumn("size", 1 + F.substring("model", 2, 10).cast("int") % 7)
    return spearman(sized, "size", "safety")
