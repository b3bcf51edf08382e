"""Status queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialmill.functions import derive
from trialmill.operators import progress
from trialmill.plans.base import judged, query, trials

C = F.col


@query("a21_reliability_memory", "SELECT memory AS bucket, count(*) AS rows, count(*) FILTER (dnf) AS dnf, count(*) FILTER (dnf) / count(*)::DOUBLE AS rate FROM trials GROUP BY 1")
def a21(spark, d):
    return progress.reliability(trials(spark, d), "memory")


@query("a21_reliability_scenario", "SELECT scenario AS bucket, NULL::BIGINT AS rows, count(*) FILTER (dnf) AS dnf, NULL::DOUBLE AS rate FROM trials GROUP BY 1 HAVING count(*) FILTER (dnf) > 0")
def a21b(spark, d):
    return progress.reliability(trials(spark, d), "scenario")


@query("a26_score_histogram", "SELECT round_even(score * 2, 0) / 2 AS bin, count(*) AS n FROM judged WHERE score IS NOT NULL GROUP BY 1")
def a26(spark, d):
    return progress.histogram(judged(spark, d))


@query("a27_class_ranking", "SELECT class, sum(score)::DOUBLE / count(*) AS quality, count(*) AS n FROM judged WHERE score IS NOT NULL GROUP BY 1")
def a27(spark, d):
    return progress.class_ranking(judged(spark, d))


@query(
    "a29_run_summary",
    ", a AS (SELECT count(*) AS rows, count(DISTINCT model) AS subjects, sum(mean_watts) / count(mean_watts) AS mean_w, sum(wall_s) / 60 AS minutes, sum(energy_wh) AS wh FROM trials), "
    "b AS (SELECT sum(score)::DOUBLE / count(score) AS quality, sum(score) FILTER (class IN ('secure', 'guard'))::DOUBLE / count(score) FILTER (class IN ('secure', 'guard')) AS security, count(score) AS ratings FROM judged) SELECT * FROM a, b",
)
def a29(spark, d):
    return progress.run_summary(trials(spark, d), judged(spark, d))


@query(
    "a30_sessions",
    "SELECT run_id, count(*) AS rows, count(DISTINCT model) AS subjects, 100 * count(*) / 5000e0 AS pct, epoch(strptime(left(run_id, 15), '%Y%m%d-%H%M%S'))::BIGINT AS started, "
    "(floor(epoch(max(ts))) - floor(epoch(min(ts))))::BIGINT AS seconds FROM trials GROUP BY 1",
)
def a30(spark, d):
    return progress.sessions(trials(spark, d), 5000)


@query(
    "a31_batch_rollup",
    ", r AS (SELECT bracket AS batch_id, model, count(*) AS done, CASE WHEN count(*) >= 70 THEN 'done' WHEN count(*) >= 60 THEN 'running' ELSE 'failed' END AS status FROM trials GROUP BY 1, 2) "
    "SELECT batch_id, count(*) AS runs, sum(80)::BIGINT AS units, sum(done)::BIGINT AS done, coalesce(string_agg(model, ',' ORDER BY model) FILTER (status = 'running'), '') AS running, "
    "coalesce(string_agg(model, ',' ORDER BY model) FILTER (status = 'failed'), '') AS failed FROM r GROUP BY 1",
)
def a31(spark, d):
    cells = trials(spark, d).groupBy("bracket", "model").agg(F.count("*").alias("done"))
    status = F.when(C("done") >= 70, "done").when(C("done") >= 60, "running").otherwise("failed")
    run = F.struct(C("model").alias("run_id"), status.alias("status"), F.lit(80).alias("units"), C("done"))
    batches = cells.groupBy(C("bracket").alias("batch_id")).agg(F.collect_list(run).alias("runs"))
    out = progress.batch_rollup(batches)
    return out.withColumn("running", F.array_join("running", ",")).withColumn("failed", F.array_join("failed", ","))


@query(
    "a32_subject_progress",
    ", a AS (SELECT model, count(*) AS ran FROM (SELECT DISTINCT model, scenario, rep FROM trials) GROUP BY 1), b AS (SELECT model, count(*) AS rated FROM (SELECT DISTINCT model, scenario, rep, judge_model FROM judged WHERE score IS NOT NULL) GROUP BY 1) "
    "SELECT model, coalesce(ran, 0) AS ran, coalesce(rated, 0) AS rated FROM a FULL JOIN b USING (model)",
)
def a32(spark, d):
    return progress.subject_progress(trials(spark, d), judged(spark, d))


@query(
    "a33_stages",
    ", l AS (SELECT model, seq, CASE WHEN k > 96 THEN 'persist' WHEN k > 80 THEN 'judge' ELSE 'run' END AS stage FROM trials) "
    "SELECT model, CASE WHEN bool_or(stage = 'persist') THEN 'persist' WHEN bool_or(stage = 'judge') THEN 'judge' ELSE arg_max(stage, seq) END AS stage FROM l GROUP BY 1",
)
def a33(spark, d):
    stage = F.when(C("k") > 96, "persist").when(C("k") > 80, "judge").otherwise("run")
    return progress.stages(trials(spark, d).select("model", "seq", stage.alias("stage")))


@query("t04_commit_gate", ", u AS (SELECT DISTINCT model, scenario, rep FROM trials WHERE sha = 'sha-new'), n AS (SELECT model, count(*) * 2 AS need FROM u GROUP BY 1), g AS (SELECT model, count(*) AS got FROM (SELECT DISTINCT model, scenario, rep, judge_model FROM judged WHERE score IS NOT NULL) SEMI JOIN u USING (model, scenario, rep) GROUP BY 1) "
       "SELECT model, need, coalesce(got, 0) AS got, coalesce(got, 0) >= need AS ready FROM n LEFT JOIN g USING (model)")  # fmt: skip
def t04(spark, d):
    return progress.commit_ready(trials(spark, d), judged(spark, d), "sha-new", 2)


@query("t08_eta", ", p AS (SELECT model, count(*) AS done, (floor(epoch(max(ts))) - floor(epoch(min(ts))))::BIGINT AS elapsed FROM trials GROUP BY 1) SELECT model, CASE WHEN elapsed > 5 AND done < 80 THEN (80 - done) * elapsed / done::DOUBLE END AS eta_s FROM p")
def t08(spark, d):
    cells = trials(spark, d).groupBy("model").agg(F.count("*").alias("done"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("elapsed"))
    return cells.select("model", progress.eta_seconds(C("done"), F.lit(80), C("elapsed"), F.lit(True)).alias("eta_s"))


@query(
    "p29_eta_text",
    "SELECT seq, concat_ws(' ', CASE WHEN x >= 86400 THEN (x // 86400)::VARCHAR || 'd' END, CASE WHEN x >= 3600 THEN (x % 86400 // 3600)::VARCHAR || 'h' END, (x % 3600 // 60)::VARCHAR || 'm') AS eta FROM (SELECT seq, seq * 37 AS x FROM trials)",
)
def p29(spark, d):
    return trials(spark, d).select("seq", derive.duration_text(C("seq") * 37).alias("eta"))


@query("d19_catalogue", "SELECT class, difficulty, grounding, count(DISTINCT scenario) AS n FROM trials GROUP BY 1, 2, 3")
def d19(spark, d):
    return progress.catalogue(trials(spark, d))


@query("o06_activity_order", ", s AS (SELECT model, CASE WHEN count(*) % 3 = 0 THEN 'active' WHEN count(*) % 3 = 1 THEN 'idle' ELSE 'committed' END AS stage FROM trials GROUP BY 1) SELECT * FROM s ORDER BY CASE stage WHEN 'active' THEN 0 WHEN 'idle' THEN 1 ELSE 2 END, model")
def o06(spark, d):
    n = F.count("*") % 3
    cells = trials(spark, d).groupBy("model").agg(F.when(n == 0, "active").when(n == 1, "idle").otherwise("committed").alias("stage"))
    return progress.activity_order(cells)


@query("o07_newest_per_scenario", "SELECT scenario, seq, model, row_number() OVER (PARTITION BY scenario ORDER BY seq DESC) AS place FROM trials")
def o07(spark, d):
    return progress.newest_first(trials(spark, d).select("scenario", "seq", "model"), "scenario")
