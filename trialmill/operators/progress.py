"""Live progress and status views of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialmill.functions.predicates import dnf_prefix
from trialmill.operators.ranks import running_total, upper_median
from trialmill.operators.rollup import mean, mean_if

C = F.col


def live_axes(df: DataFrame, ratings: DataFrame) -> DataFrame:
    """Quality, security, speed, energy and power of each subject that has either kind of rows."""
    rated = ratings.groupBy("model").agg(mean(C("score")).alias("quality"), mean_if(C("score"), C("class").isin("secure", "guard")).alias("security"), F.count("score").alias("n"))
    ran = df.groupBy("model").agg(mean(C("energy_wh")).alias("wh"), mean(C("mean_watts")).alias("w"))
    ran = ran.join(upper_median(df, ["model"], F.when(C("tok_s") > 0, C("tok_s")), "tok_s"), "model")
    return rated.join(ran, "model", "full_outer")


def run_summary(df: DataFrame, ratings: DataFrame) -> DataFrame:
    """One row of totals."""
    a = df.agg(F.count("*").alias("rows"), F.count_distinct("model").alias("subjects"), mean(C("mean_watts")).alias("mean_w"), (F.sum("wall_s") / 60).alias("minutes"), F.sum("energy_wh").alias("wh"))
    b = ratings.agg(mean(C("score")).alias("quality"), mean_if(C("score"), C("class").isin("secure", "guard")).alias("security"), F.count("score").alias("ratings"))
    return a.crossJoin(b)


def histogram(ratings: DataFrame) -> DataFrame:
    """Ratings in bins of half a point, halves to even."""
    half = F.bround(C("score").cast("double") * 2) / 2
    return ratings.filter("score IS NOT NULL").groupBy(half.alias("bin")).agg(F.count("*").alias("n"))


def class_ranking(ratings: DataFrame) -> DataFrame:
    return ratings.filter("score IS NOT NULL").groupBy("class").agg(mean(C("score")).alias("quality"), F.count("*").alias("n")).orderBy(F.desc("quality"), "class")


def reliability(df: DataFrame, by: str) -> DataFrame:
    """Unfinished rows of each bucket. Buckets by subject or scenario know no total here, so their rate is null."""
    bad = dnf_prefix(C("dnf"), C("finish_reason"))
    cells = df.groupBy(C(by).alias("bucket")).agg(F.count("*").alias("rows"), F.count_if(bad).alias("dnf"))
    if by in ("model", "scenario"):
        cells = cells.filter("dnf > 0")
        return cells.select("bucket", F.lit(None).cast("long").alias("rows"), "dnf", F.lit(None).cast("double").alias("rate"))
    return cells.withColumn("rate", C("dnf") / C("rows"))


def sessions(df: DataFrame, expected_rows: int) -> DataFrame:
    """One row for each run: totals, share done, start from the run's name, seconds between its first and last record."""
    cells = df.groupBy("run_id").agg(
        F.count("*").alias("rows"), F.count_distinct("model").alias("subjects"), F.min("ts").alias("first"), F.max("ts").alias("last"),
    )
    started = F.unix_timestamp(F.to_timestamp(F.regexp_extract("run_id", r"^(\d{8}-\d{6})", 1), "yyyyMMdd-HHmmss"))
    seconds = F.unix_timestamp("last") - F.unix_timestamp("first")
    return cells.select("run_id", "rows", "subjects", (100 * C("rows") / expected_rows).alias("pct"), started.alias("started"), seconds.alias("seconds"))


def run_states(records: DataFrame, run: str = "run_id", order: str = "seq") -> DataFrame:
    """One row for each run folder's records: how many, how many subjects, and its newest record's state."""
    return records.groupBy(run).agg(F.count("*").alias("rows"), F.count_distinct("model").alias("subjects"), F.max_by("state", order).alias("state"))


def with_meta(runs: DataFrame, meta: DataFrame, defaults: dict[str, object], key: str = "run_id") -> DataFrame:
    """Runs with their metadata; a run without any, or a field that is null, gets the default."""
    joined = runs.join(meta.select(key, *defaults), key, "left")
    return joined.select(*[c for c in runs.columns], *[F.coalesce(C(f), F.lit(v)).alias(f) for f, v in defaults.items()])


def batch_rollup(batches: DataFrame) -> DataFrame:
    """Totals over a batch's runs, and its runs by status. batches: batch_id, runs (array of run_id, status, units, done)."""
    runs = batches.select("batch_id", F.explode("runs").alias("r"))
    names = lambda s: F.array_sort(F.collect_list(F.when(C("r.status") == s, C("r.run_id"))))
    return runs.groupBy("batch_id").agg(
        F.count("*").alias("runs"), F.sum("r.units").alias("units"), F.sum("r.done").alias("done"), names("running").alias("running"), names("failed").alias("failed")
    )


def subject_progress(df: DataFrame, ratings: DataFrame) -> DataFrame:
    """Distinct units that ran and that were rated, for subjects on either side."""
    unit = F.struct("scenario", "rep")
    ran = df.groupBy("model").agg(F.count_distinct(unit).alias("ran"))
    rated = ratings.filter("score IS NOT NULL").groupBy("model").agg(F.count_distinct(F.struct("scenario", "rep", "judge_model")).alias("rated"))
    both = ran.join(rated, "model", "full_outer")
    return both.select("model", F.coalesce("ran", F.lit(0)).alias("ran"), F.coalesce("rated", F.lit(0)).alias("rated"))


def stages(ledger: DataFrame) -> DataFrame:
    """The last stage of each subject in the ledger; persisted goes before judged, whatever came last."""
    last = ledger.groupBy("model").agg(F.max_by("stage", "seq").alias("last"), F.bool_or(C("stage") == "persist").alias("persisted"), F.bool_or(C("stage") == "judge").alias("judged"))
    return last.select("model", F.when(C("persisted"), "persist").when(C("judged"), "judge").otherwise(C("last")).alias("stage"))


def eta_seconds(done: Column, total: Column, elapsed: Column, active: Column) -> Column:
    """Seconds left at the rate so far; only of an active run that has begun and is not over."""
    return F.when(active & (elapsed > 5) & (done > 0) & (done < total), (total - done) * elapsed / done)


def catalogue(scenarios: DataFrame) -> DataFrame:
    """Counts by class, difficulty and grounding."""
    return scenarios.groupBy("class", "difficulty", "grounding").agg(F.count_distinct("scenario").alias("n"))


def commit_ready(df: DataFrame, ratings: DataFrame, sha: str, judges: int) -> DataFrame:
    """Subjects all of whose units, under one scenario hash, have their ratings."""
    units = df.filter(C("sha") == sha).select("model", "scenario", "rep").distinct()
    need = units.groupBy("model").agg((F.count("*") * judges).alias("need"))
    rated = ratings.filter("score IS NOT NULL").select("model", "scenario", "rep", "judge_model").distinct().join(units, ["model", "scenario", "rep"])
    got = rated.groupBy("model").agg(F.count("*").alias("got"))
    return need.join(got, "model", "left").select("model", "need", F.coalesce("got", F.lit(0)).alias("got"), (F.coalesce("got", F.lit(0)) >= C("need")).alias("ready"))


def activity_order(df: DataFrame) -> DataFrame:
    """Active first, then idle, then committed."""
    rank = F.when(C("stage") == "active", 0).when(C("stage") == "idle", 1).otherwise(2)
    return df.orderBy(rank, "model")


def gallery(df: DataFrame, ratings: DataFrame) -> DataFrame:
    """Trials with the mean rating and the list of reviews, in the order of judges."""
    key = ["model", "scenario", "rep"]
    reviews = ratings.groupBy(*key).agg(mean(C("score")).alias("score"), F.array_sort(F.collect_list(F.struct("judge_model", "verdict"))).alias("reviews"))
    joined = df.select(*key, "class").join(reviews, key, "left")
    return joined.select(*key, "class", "score", F.array_join(F.transform("reviews", lambda r: F.concat_ws("=", r["judge_model"], r["verdict"])), ",").alias("reviews"))


def newest_first(df: DataFrame, by: str, into: str = "place") -> DataFrame:
    """The place of each row in its group, the newest first."""
    ranked = running_total(df.withColumn("__back", -C("seq")), [by], ["__back"], F.lit(1), into)
    return ranked.withColumn(into, (C(into) + 1).cast("int")).drop("__back")
