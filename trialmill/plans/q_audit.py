"""Audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialmill.functions import predicates as pr
from trialmill.operators import audit, upsert
from trialmill.plans.base import BRACKETS, judged, query, table, trials

C = F.col


@query("d01_regimes", "SELECT memory, strategy, sha, count(*) AS n FROM trials GROUP BY 1, 2, 3")
def d01(spark, d):
    return audit.regimes(trials(spark, d), ["memory", "strategy", "sha"])


@query("d03_mixed_source", "SELECT count(DISTINCT memory) AS distinct_values, count(DISTINCT memory) > 1 AS mixed FROM trials")
def d03(spark, d):
    return audit.mixed(trials(spark, d), "memory")


@query("d04_fatal_rows", "SELECT fatal, count(*) AS n FROM trials WHERE fatal IS NOT NULL GROUP BY 1")
def d04(spark, d):
    return trials(spark, d).filter("fatal IS NOT NULL").groupBy("fatal").agg(F.count("*").alias("n"))


@query("d05_missing_telemetry", "SELECT count(*) AS n, count(*) FILTER (membw_mb_s IS NULL) AS missing, count(*) FILTER (membw_mb_s IS NULL) / count(*)::DOUBLE AS rate, count(*) FILTER (membw_mb_s IS NULL) / count(*)::DOUBLE > 0.03 AS over FROM trials")
def d05(spark, d):
    return audit.missing_rate(trials(spark, d), C("membw_mb_s").isNull())


@query("d07_protocol_values", "SELECT string_agg(DISTINCT strategy, ',' ORDER BY strategy) AS strategies FROM trials")
def d07(spark, d):
    return trials(spark, d).agg(F.array_join(F.array_sort(F.collect_set("strategy")), ",").alias("strategies"))


@query("d09_drift", ", e AS (SELECT model, arg_min(sha, seq) AS sha FROM trials GROUP BY 1) SELECT t.seq, t.model, t.sha FROM trials t JOIN e USING (model) WHERE t.sha IS DISTINCT FROM e.sha")
def d09(spark, d):
    rows = trials(spark, d).select("seq", "model", "sha")
    return audit.drift(rows, rows.groupBy("model").agg(F.min_by("sha", "seq").alias("sha")), "model", ["sha"]).select("seq", "model", "sha")


@query("d11_expected_units", "SELECT count(DISTINCT model) AS subjects, count(DISTINCT scenario) AS scenarios, 5 AS reps, 2 AS judges, count(DISTINCT model) * count(DISTINCT scenario) * 5 AS expected_rows, count(DISTINCT model) * count(DISTINCT scenario) * 10 AS expected_ratings FROM trials")
def d11(spark, d):
    meta = trials(spark, d).agg(F.count_distinct("model").alias("subjects"), F.count_distinct("scenario").alias("scenarios"))
    return audit.expected_units(meta.withColumn("reps", F.lit(5)).withColumn("judges", F.lit(2)))


@query("d12_rating_gaps", "SELECT judge_model, count(*) AS n, count(*) FILTER (evidence IS NULL) AS no_evidence, count(*) FILTER (score IS NULL) AS no_score, count(*) FILTER (verdict = 'empty') AS empty FROM judged GROUP BY 1")
def d12(spark, d):
    return audit.rating_gaps(judged(spark, d))


@query("d13_crowded_subjects", "SELECT model, count(*) AS n FROM trials GROUP BY 1 HAVING count(*) > 70")
def d13(spark, d):
    return audit.crowded(trials(spark, d), "model", 70)


@query("d13_unexpected_levels", "SELECT bracket, count(*) AS n FROM trials WHERE bracket NOT IN ('0-1B', '1-2B', '2-3B') GROUP BY 1")
def d13b(spark, d):
    return audit.unexpected_levels(trials(spark, d), "bracket", BRACKETS[:3])


@query("d14_trim_last", "SELECT seq, model FROM trials WHERE model <> (SELECT arg_max(model, seq) FROM trials)")
def d14(spark, d):
    rows = trials(spark, d).select("seq", "model")
    return upsert.trim_last_subject(rows, "model", "seq", rows.filter("false").select("model"))


@query("d17_identity_mismatch", ", o AS (SELECT run_id, min(memory) AS memory, max(sha) AS sha FROM trials GROUP BY 1) SELECT run_id, 'memory' AS field FROM o WHERE memory IS DISTINCT FROM 'none' UNION ALL SELECT run_id, 'sha' FROM o WHERE sha IS DISTINCT FROM 'sha-x'")
def d17(spark, d):
    seen = trials(spark, d).groupBy("run_id").agg(F.min("memory").alias("memory"), F.max("sha").alias("sha"))
    asked = seen.select("run_id", F.lit("none").alias("memory"), F.lit("sha-x").alias("sha"))
    return audit.identity_mismatches(seen, asked, "run_id", ["memory", "sha"])


@query("d20_flagged_reviews", ", r AS (SELECT seq, score >= 4 AS agree, CASE WHEN score <= 1 THEN 'major' WHEN score = 2 THEN 'minor' ELSE 'none' END AS severity FROM judged WHERE score IS NOT NULL) SELECT severity, count(*) AS n FROM r WHERE NOT agree OR severity IN ('minor', 'major') GROUP BY 1")
def d20(spark, d):
    severity = F.when(C("score") <= 1, "major").when(C("score") == 2, "minor").otherwise("none")
    reviews = judged(spark, d).filter("score IS NOT NULL").select("seq", (C("score") >= 4).alias("agree"), severity.alias("severity"))
    return audit.flagged_reviews(reviews).groupBy("severity").agg(F.count("*").alias("n"))


@query("a24_key_presence", "SELECT 'k' AS key, count(*) FILTER (json_exists(props, '$.k')) AS present, count(*) FILTER (NOT json_exists(props, '$.k')) AS missing FROM events", views=False)
def a24(spark, d):
    return audit.key_presence(table(spark, d, "events").select("props"), "props")


@query(
    "f01_predicates",
    "SELECT count(*) FILTER (peak_swap_mb IS NOT NULL AND peak_swap_mb <> 0) AS truthy, count(peak_swap_mb) AS known, count(*) FILTER (fatal IS NOT NULL) AS stubs, count(*) FILTER (dnf) AS dnf, "
    "count(*) FILTER (contains(finish_reason, 'length')) AS cut_short, count(*) FILTER (finish_reason = 'DNF:stall' AND out_tokens = 0) AS zero_stalls, count(*) FILTER (energy_wh > 0 AND NOT dnf) AS functional, "
    "count(*) FILTER (energy_wh > 0 AND wall_s > 10 AND NOT dnf) AS functional_long, count(*) FILTER (class IN ('guard', 'secure')) AS safety, count(*) FILTER (sha = 'sha-new') AS right_hash, count(*) FILTER (contains(model, 'u1')) AS named FROM trials",
)
def f01(spark, d):
    n = lambda cond, name: F.count_if(cond).alias(name)
    t = trials(spark, d)
    long_ones = pr.functional_energy(C("energy_wh"), C("dnf"), C("wall_s") - 10)
    return t.agg(
        n(pr.truthy(C("peak_swap_mb")), "truthy"), F.count("peak_swap_mb").alias("known"), n(pr.is_stub(C("fatal"), C("scenario"), C("rep")), "stubs"),
        n(pr.dnf_word(C("dnf"), C("finish_reason")), "dnf"), n(pr.cut_short(C("finish_reason")), "cut_short"), n(pr.zero_output_stall(C("finish_reason"), C("out_tokens"), F.lit(0)), "zero_stalls"),
        n(pr.functional_energy(C("energy_wh"), C("dnf")), "functional"), n(long_ones, "functional_long"), n(C("class").isin("guard", "secure"), "safety"), n(C("sha") == "sha-new", "right_hash"),
        n(pr.contains_ci(C("model"), "U1"), "named"),
    )


@query("f08_exclude", "SELECT model, count(*) AS n FROM trials WHERE model NOT IN ('u1', 'u2') GROUP BY 1")
def f08(spark, d):
    return pr.exclude(trials(spark, d), "model", ["u1", "u2"]).groupBy("model").agg(F.count("*").alias("n"))


@query("f12_hash_guard", "SELECT sha = 'sha-new' AS matches, count(*) AS n FROM trials GROUP BY 1")
def f12(spark, d):
    return audit.unit_guard(trials(spark, d), "sha", "sha-new")


@query("a48_top_warnings", "SELECT finish_reason, count(*) AS n FROM trials WHERE dnf GROUP BY 1 ORDER BY n DESC, finish_reason LIMIT 5")
def a48(spark, d):
    return trials(spark, d).filter("dnf").groupBy("finish_reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "finish_reason").limit(5)


@query("d16_latest_ready", ", s AS (SELECT bracket, max(ts) AS changed, count(*) FILTER (det_score = 1) % 3 AS n FROM trials GROUP BY 1) SELECT bracket AS id, (n + 1)::INT AS phase FROM s WHERE n < 2 ORDER BY changed DESC, bracket LIMIT 1")
def d16(spark, d):
    cells = trials(spark, d).groupBy("bracket").agg(F.max("ts").alias("changed"), (F.count_if(C("det_score") == 1) % 3).alias("n"))
    status = lambda k: F.struct(F.when(C("n") > k, "completed").otherwise("pending").alias("status"))
    return audit.latest_ready(cells.select(C("bracket").alias("id"), "changed", F.array(status(0), status(1)).alias("phases")))


_PARTS = (
    ", whole AS (SELECT seq AS id FROM trials WHERE seq % 97 <> 5 UNION ALL SELECT seq FROM trials WHERE seq % 101 = 7), "
    "parts AS (SELECT seq AS id, bracket AS part FROM trials WHERE seq % 83 <> 1 UNION ALL SELECT seq, 'extra' FROM trials WHERE seq % 89 = 3 UNION ALL SELECT seq, bracket FROM trials WHERE seq % 71 = 2), "
    "n AS (SELECT id, sum(w) AS w, count(part) AS p, min(part) AS a, max(part) AS b FROM (SELECT id, NULL AS part, 1 AS w FROM whole UNION ALL SELECT id, part, 0 FROM parts) GROUP BY 1) "
)


@query(
    "d10_partition",
    _PARTS + "SELECT id, 'is there more than once' AS problem FROM n WHERE w > 1 UNION ALL SELECT id, 'is in two parts' FROM n WHERE a < b UNION ALL SELECT id, 'is in a part twice' FROM n WHERE p > 1 AND a = b "
    "UNION ALL SELECT id, 'is in no part' FROM n WHERE w > 0 AND p = 0 UNION ALL SELECT id, 'is not in the whole' FROM n WHERE w = 0 AND p > 0",
)
def d10_partition(spark, d):
    """All trials as a catalogue, their brackets as its parts, with faults of every kind."""
    t = trials(spark, d).select(C("seq").alias("id"), C("bracket").alias("part"))
    whole = t.filter("id % 97 <> 5").select("id").unionByName(t.filter("id % 101 = 7").select("id"))
    parts = t.filter("id % 83 <> 1").unionByName(t.filter("id % 89 = 3").withColumn("part", F.lit("extra"))).unionByName(t.filter("id % 71 = 2"))
    return audit.partition_faults(parts, whole)


@query(
    "d15_phases",
    ", e AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY seq) - 1 AS r FROM trials), "
    "m AS (SELECT model, seq, r, CASE WHEN k % 20 = 9 THEN r // 3 + 1 ELSE r // 3 END AS phase, CASE WHEN k % 16 = 11 THEN 'completed' ELSE ['running', 'review_pending', 'completed'][r % 3 + 1] END AS go FROM e), "
    "n AS (SELECT model, ((count(*) + 2) // 3)::INT AS phases FROM e GROUP BY 1), "
    "f AS (WITH RECURSIVE f AS (SELECT model, 0::BIGINT AS r, list_transform(range(0, phases), lambda x: 'pending') AS st, NULL::BIGINT AS bad_seq, NULL::VARCHAR AS problem FROM n UNION ALL "
    "SELECT model, r + 1, CASE WHEN p IS NULL THEN list_transform(st, lambda x, i: CASE WHEN i = phase + 1 THEN go ELSE x END) ELSE st END, CASE WHEN p IS NOT NULL THEN seq END, p FROM ("
    "SELECT f.model, f.r, st, seq, phase, go, CASE WHEN phase >= len(st) THEN 'no such phase' "
    "WHEN concat(st[phase + 1], '>', go) NOT IN ('pending>running', 'running>review_pending', 'running>failed', 'review_pending>completed', 'review_pending>failed', 'failed>running') THEN concat('cannot go from ', st[phase + 1], ' to ', go) "
    "WHEN go = 'running' AND len(list_filter(st[1:phase], lambda x: x <> 'completed')) > 0 THEN 'must wait for the phases before it' END AS p "
    "FROM f JOIN m ON m.model = f.model AND m.r = f.r WHERE problem IS NULL)) SELECT * FROM f) "
    "SELECT model, array_to_string(st, ',') AS statuses, bad_seq, problem FROM f QUALIFY row_number() OVER (PARTITION BY model ORDER BY r DESC) = 1",
)
def d15(spark, d):
    """Each subject's trials as moves of its phases, three a phase, with some that break a rule."""
    from pyspark.sql import Window

    t = trials(spark, d).select("model", "seq", "k")
    place = F.row_number().over(Window.partitionBy("model").orderBy("seq")) - 1
    third = F.floor(C("r") / 3).cast("int")
    to = F.when(C("k") % 16 == 11, "completed").otherwise(F.element_at(F.array(F.lit("running"), F.lit("review_pending"), F.lit("completed")), C("r") % 3 + 1))
    moves = t.withColumn("r", place).select("model", C("seq").cast("long").alias("seq"), F.when(C("k") % 20 == 9, third + 1).otherwise(third).alias("phase"), to.alias("to"))
    sizes = t.groupBy("model").agg(F.ceil(F.count("*") / 3).cast("int").alias("phases"))
    return audit.advanced(moves, sizes, "model").withColumn("statuses", F.array_join("statuses", ","))
