"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialmill.operators import audit, progress, upsert
from trialmill.operators.rollup import mean
from trialmill.plans.base import judged, query, table, trials

C = F.col
KEY = ["model", "scenario", "rep"]


@query("j05_dimension_lookup", "SELECT c.c_custkey, n.n_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey", views=False)
def j05(spark, d):
    nation = table(spark, d, "nation").select(C("n_nationkey").alias("c_nationkey"), "n_name")  # 25 rows by definition of the table
    return table(spark, d, "customer").join(F.broadcast(nation), "c_nationkey", "left").select("c_custkey", "n_name")


@query("j06_subject_dimension", ", b AS (SELECT DISTINCT model, bracket FROM trials) SELECT bracket, count(*) AS subjects FROM b GROUP BY 1")
def j06(spark, d):
    return trials(spark, d).select("model", "bracket").dropDuplicates(["model"]).groupBy("bracket").agg(F.count("*").alias("subjects"))


@query(
    "j08_inventory",
    "SELECT p_partkey, coalesce(string_agg(DISTINCT s_name, ',' ORDER BY s_name), '') AS suppliers, CASE WHEN count(l_orderkey) > 0 THEN 'yes' ELSE 'no' END AS has_data "
    "FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1",
    views=False,
)
def j08(spark, d):
    lines = table(spark, d, "lineitem").select(C("l_partkey").alias("p_partkey"), "l_suppkey")
    named = lines.join(table(spark, d, "supplier").select(C("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey", "left")
    seen = named.groupBy("p_partkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("s_name")).alias("names"))
    out = table(spark, d, "part").select("p_partkey").join(seen, "p_partkey", "left")
    return out.select("p_partkey", F.coalesce(F.array_join("names", ","), F.lit("")).alias("suppliers"), F.when(C("n") > 0, "yes").otherwise("no").alias("has_data"))


@query(
    "j10_pending_work",
    "SELECT t.model, t.scenario, t.rep, s.judge_model FROM trials t, (VALUES ('A'), ('B'), ('C')) s(judge_model) WHERE NOT EXISTS (SELECT 1 FROM judged j WHERE j.model = t.model AND j.scenario = t.scenario "
    "AND j.rep = t.rep AND j.judge_model = s.judge_model AND j.score IS NOT NULL)",
)
def j10(spark, d):
    specs = spark.createDataFrame([("A",), ("B",), ("C",)], "judge_model string")
    return upsert.pending(trials(spark, d).select(*KEY), specs, judged(spark, d), [*KEY, "judge_model"])


GRID = ", grid AS (SELECT DISTINCT scenario, r AS rep FROM trials, range(0, 12) x(r)), s AS (SELECT DISTINCT model FROM trials)"


def _grid(spark, d):
    reps = spark.range(12).select(C("id").cast("int").alias("rep"))
    return trials(spark, d).select("scenario").distinct().join(F.broadcast(reps))


@query("j11_resume", GRID + "SELECT model, scenario, rep::INT AS rep FROM s, grid EXCEPT SELECT model, scenario, rep FROM trials")
def j11(spark, d):
    t = trials(spark, d)
    return upsert.missing_units(t, t, _grid(spark, d), "model", ["scenario", "rep"])


@query("j12_completeness", GRID + "SELECT model, count(*) AS covered, count(*) = (SELECT count(*) FROM grid) AS complete FROM trials SEMI JOIN grid USING (scenario, rep) GROUP BY 1")
def j12(spark, d):
    return upsert.is_complete(trials(spark, d), _grid(spark, d), "model", ["scenario", "rep"])


@query(
    "j13_manifest",
    "SELECT 'memory' AS field, string_agg(DISTINCT memory, ',' ORDER BY memory) AS seen, count(DISTINCT memory) = 1 AND min(memory) = 'none' AS matches FROM trials UNION ALL "
    "SELECT 'sha', string_agg(DISTINCT sha, ',' ORDER BY sha), count(DISTINCT sha) = 1 AND min(sha) = 'sha-new' FROM trials",
)
def j13(spark, d):
    return audit.against_manifest(trials(spark, d), {"memory": "none", "sha": "sha-new"})


@query(
    "j14_gallery",
    ", r AS (SELECT model, scenario, rep, sum(score)::DOUBLE / count(score) AS score, string_agg(judge_model || '=' || verdict, ',' ORDER BY judge_model) AS reviews FROM judged GROUP BY 1, 2, 3) "
    "SELECT model, scenario, rep, class, score, reviews FROM trials LEFT JOIN r USING (model, scenario, rep)",
)
def j14(spark, d):
    return progress.gallery(trials(spark, d), judged(spark, d))


@query(
    "j15_unpivot_raters",
    ", p AS (SELECT seq, max(score) FILTER (judge_model = 'A') AS a, max(score) FILTER (judge_model = 'B') AS b FROM judged GROUP BY 1) "
    "SELECT seq, rater, score::INT AS score FROM (SELECT seq, 'a' AS rater, a AS score FROM p UNION ALL SELECT seq, 'b', b FROM p) WHERE score IS NOT NULL",
)
def j15(spark, d):
    wide = judged(spark, d).groupBy("seq").pivot("judge_model", ["A", "B"]).agg(F.max("score").cast("int"))
    return wide.select("seq", C("A").alias("a"), C("B").alias("b")).unpivot("seq", ["a", "b"], "rater", "score").filter("score IS NOT NULL")


@query("j17_peak_lookup", ", p AS (SELECT max(membw_mb_s) AS peak FROM trials) SELECT seq, membw_mb_s / peak AS share FROM trials, p")
def j17(spark, d):
    t = trials(spark, d)
    peak = t.agg(F.max("membw_mb_s").alias("peak"))  # one row
    return t.join(F.broadcast(peak)).select("seq", (C("membw_mb_s") / C("peak")).alias("share"))


@query(
    "j18_size_and_refusal",
    ", s AS (SELECT model, median(size_bytes) AS size FROM trials GROUP BY 1), g AS (SELECT model, sum(score)::DOUBLE / count(score) AS safety FROM judged WHERE class = 'guard' GROUP BY 1), "
    "a AS (SELECT DISTINCT model, bracket FROM trials) SELECT model, size, safety, bracket FROM s JOIN g USING (model) JOIN a USING (model)",
)
def j18(spark, d):
    t = trials(spark, d)
    size = t.groupBy("model").agg(F.median("size_bytes").alias("size"))
    safety = judged(spark, d).filter("class = 'guard'").groupBy("model").agg(mean(C("score")).alias("safety"))
    return size.join(safety, "model").join(t.select("model", "bracket").distinct(), "model").select("model", "size", "safety", "bracket")


@query("u01_union_by_name", "SELECT seq, model, NULL::VARCHAR AS judge_model FROM trials WHERE dnf UNION ALL SELECT seq, model, judge_model FROM judged WHERE score = 5")
def u01(spark, d):
    a = trials(spark, d).filter("dnf").select("seq", "model")
    return a.unionByName(judged(spark, d).filter("score = 5").select("seq", "model", "judge_model"), allowMissingColumns=True)


@query("u02_distinct_keys", "SELECT count(*) AS n FROM (SELECT DISTINCT model, scenario, rep FROM judged)")
def u02(spark, d):
    return judged(spark, d).select(*KEY).distinct().agg(F.count("*").alias("n"))


@query("u03_intersect_except", "SELECT (SELECT count(*) FROM (SELECT model FROM trials WHERE dnf INTERSECT SELECT model FROM trials WHERE det_score = 1)) AS shared, (SELECT count(*) FROM (SELECT model FROM trials WHERE memory = 'ctx' EXCEPT SELECT model FROM trials WHERE k > 95)) AS rest")
def u03(spark, d):
    has = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    sets = {"dnf": F.expr("dnf"), "full": C("det_score") == 1, "ctx": C("memory") == "ctx", "late": C("k") > 95}
    names = trials(spark, d).groupBy("model").agg(*[has(cond).alias(into) for into, cond in sets.items()])  # what sets a name is in, before any of them meet
    return names.agg(F.count_if(C("dnf") & C("full")).alias("shared"), F.count_if(C("ctx") & ~C("late")).alias("rest"))


@query("u05_common_scenarios", "SELECT scenario FROM trials GROUP BY 1 HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM trials)")
def u05(spark, d):
    t = trials(spark, d)
    n = t.agg(F.count_distinct("model").alias("n"))
    return t.groupBy("scenario").agg(F.count_distinct("model").alias("m")).join(F.broadcast(n)).filter("m = n").select("scenario")


@query("u06_partition_test", "SELECT (SELECT count(*) FROM (SELECT scenario FROM trials WHERE class IN ('guard', 'secure') INTERSECT SELECT scenario FROM trials WHERE class NOT IN ('guard', 'secure'))) = 0 AS disjoint, true AS covers")
def u06(spark, d):
    part = C("class").isin("guard", "secure")
    has = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    names = trials(spark, d).groupBy("scenario").agg(has(part).alias("a"), has(~part).alias("b"))
    return names.agg((F.count_if(C("a") & C("b")) == 0).alias("disjoint"), (F.count_if(~C("a") & ~C("b")) == 0).alias("covers"))


@query("u07_membership_lists", "SELECT scenario, string_agg(DISTINCT difficulty, ',' ORDER BY difficulty) AS levels FROM trials GROUP BY 1")
def u07(spark, d):
    return trials(spark, d).groupBy("scenario").agg(F.array_join(F.array_sort(F.collect_set("difficulty")), ",").alias("levels"))
