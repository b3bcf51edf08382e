"""Data-quality and provenance checks over trial records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialmill.functions.checks import found_json, passed, prepared, run_checks

C = F.col


def regimes(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Distinct combinations of volatile fields with their rows; more than one is a problem."""
    return df.groupBy(*fields).agg(F.count("*").alias("n"))


def against_manifest(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """For each field: the values seen (sorted) and whether they are just the expected one."""
    out = None
    for field, value in expected.items():
        seen = df.agg(F.array_sort(F.collect_set(C(field).cast("string"))).alias("seen"))
        row = seen.select(F.lit(field).alias("field"), F.array_join("seen", ",").alias("seen"), (C("seen") == F.array(F.lit(str(value)))).alias("matches"))
        out = row if out is None else out.unionByName(row)
    return out


def version_of(text: Column) -> Column:
    """The first three-part number of a version text, else the trimmed text."""
    found = F.regexp_extract(text, r"\d+\.\d+\.\d+", 0)
    return F.when(found != "", found).otherwise(F.trim(text))


def version_pin(df: DataFrame, field: str, wanted: str | None = None) -> DataFrame:
    """One row: the versions seen (sorted, normalised), whether there is one, and whether it is the wanted one."""
    seen = df.agg(F.array_sort(F.collect_set(version_of(C(field)))).alias("seen"))
    pin = F.lit(None).cast("boolean") if wanted is None else C("seen") == F.array(version_of(F.lit(wanted)))
    return seen.select(F.array_join("seen", ",").alias("seen"), (F.size("seen") == 1).alias("consistent"), pin.alias("pinned"))


def preflight(
    nodes: DataFrame, key: str, equal: Mapping[str, object] | None = None, at_most: Mapping[str, float] | None = None, required: Sequence[str] = (),
    versions: Mapping[str, str] | None = None, one_of: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """(key, field, problem) for each way in which a node's fingerprint departs from a manifest.

    ``equal`` compares as text, and null departs; a bound says nothing about a value that is null or no number; ``required`` flags must
    hold; versions compare normalised; ``one_of`` is an allow-list (of hashes), and an empty one allows all.
    """
    found = []
    say = lambda field, wrong, text: found.append(F.when(F.coalesce(wrong, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(text).alias("problem"))))
    for f, wanted in (equal or {}).items():
        say(f, ~C(f).cast("string").eqNullSafe(F.lit(str(wanted))), f"should be {wanted}")
    for f, most in (at_most or {}).items():
        say(f, C(f).cast("string").try_cast("double") > most, f"over {most:g}")
    for f in required:
        say(f, ~F.coalesce(C(f).cast("boolean"), F.lit(False)), "required")
    for f, wanted in (versions or {}).items():
        say(f, F.coalesce(version_of(C(f)), F.lit("")) != version_of(F.lit(wanted)), f"should be version {wanted}")
    for f, allowed in (one_of or {}).items():
        if allowed:
            say(f, ~F.coalesce(C(f).isin(list(allowed)), F.lit(False)), "not approved")
    problems = F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<field:string,problem:string>>")
    return nodes.select(key, F.explode(problems).alias("p")).select(key, "p.*")


def file_hashes(files: DataFrame, approved: Sequence[str]) -> DataFrame:
    """(path, sha256, approved) of whole files (path, content)."""
    digest = F.sha2("content", 256)
    return files.select("path", digest.alias("sha256"), digest.isin(list(approved)).alias("approved"))


def catalogue_faults(scenarios: DataFrame) -> DataFrame:
    """(id, problem) of scenarios (id, gold, control, checks): ids that repeat, gold answers that fail, controls that pass.

    ``checks`` is an array as trialmill.functions.checks has it. A scenario without checks is not tried.
    """
    tried = scenarios.filter(F.size("checks") > 0).withColumn("checks", prepared(C("checks")))
    for name in ("gold", "control"):
        tried = tried.withColumn(f"__{name}", found_json(C(name)))
    outcome = lambda name: passed(run_checks(C(name), C(f"__{name}"), C("checks"), ready=True)) == F.size("checks")
    tried = tried.select("id", outcome("gold").alias("gold"), outcome("control").alias("control"))
    twice = scenarios.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("id is there more than once").alias("problem"))
    bad_gold = tried.filter(~C("gold")).select("id", F.lit("gold answer fails its checks").alias("problem"))
    bad_control = tried.filter("control").select("id", F.lit("control answer passes the checks").alias("problem"))
    return twice.unionByName(bad_gold).unionByName(bad_control)


def mixed(df: DataFrame, field: str) -> DataFrame:
    """One row: distinct values of a field, and whether there is more than one."""
    return df.agg(F.count_distinct(field).alias("distinct_values"), (F.count_distinct(field) > 1).alias("mixed"))


def missing_rate(df: DataFrame, missing: Column, limit: float = 0.03) -> DataFrame:
    """One row: share of rows without telemetry and whether it is over the limit."""
    s = df.agg(F.count("*").alias("n"), F.count_if(missing).alias("missing"))
    return s.select("n", "missing", (C("missing") / C("n")).alias("rate"), (C("missing") / C("n") > limit).alias("over"))


def drift(df: DataFrame, expected: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows of subjects whose observed fields differ from the expected ones (null-safe)."""
    joined = df.alias("o").join(expected.alias("e"), key)
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~C(f"o.{f}").eqNullSafe(C(f"e.{f}"))
    return joined.filter(differs).select("o.*")


def expected_units(meta: DataFrame) -> DataFrame:
    """Rows and ratings a run should have: subjects x scenarios x reps (x judges)."""
    return meta.withColumn("expected_rows", C("subjects") * C("scenarios") * C("reps")).withColumn("expected_ratings", C("expected_rows") * C("judges"))


def unit_guard(df: DataFrame, field: str, wanted: str) -> DataFrame:
    """Rows with the wanted hash; the rest are counted."""
    return df.groupBy((C(field) == wanted).alias("matches")).agg(F.count("*").alias("n"))


def rating_gaps(ratings: DataFrame) -> DataFrame:
    """For each judge: rows without evidence, without a score, and empty verdicts."""
    return ratings.groupBy("judge_model").agg(
        F.count("*").alias("n"), F.count_if(C("evidence").isNull()).alias("no_evidence"), F.count_if(C("score").isNull()).alias("no_score"), F.count_if(C("verdict") == "empty").alias("empty")
    )


def key_presence(raw: DataFrame, column: str) -> DataFrame:
    """For each key of JSON texts: rows that have it and rows that lack it. Presence, not null, counts."""
    n = raw.agg(F.count("*").alias("all"))
    keys = raw.select(F.explode(F.json_object_keys(column)).alias("key")).groupBy("key").agg(F.count("*").alias("present"))
    return keys.join(F.broadcast(n)).select("key", "present", (C("all") - C("present")).alias("missing"))


def unexpected_levels(df: DataFrame, field: str, levels: Sequence[str]) -> DataFrame:
    return df.filter(~C(field).isin(list(levels))).groupBy(field).agg(F.count("*").alias("n"))


def crowded(df: DataFrame, subject: str, limit: int) -> DataFrame:
    """Subjects with more rows than there should be."""
    return df.groupBy(subject).agg(F.count("*").alias("n")).filter(C("n") > limit)


def partition_faults(parts: DataFrame, whole: DataFrame) -> DataFrame:
    """(id, problem) for each way in which parts (part, id) are no partition of a whole (id): one aggregate over all ids.

    Ids that repeat in the whole or in a part, that are in two parts, in none, or in a part but not in the whole.
    """
    rows = parts.select("id", C("part").cast("string").alias("part"), F.lit(0).alias("whole")).unionByName(whole.select("id", F.lit(None).cast("string").alias("part"), F.lit(1).alias("whole")))
    n = rows.groupBy("id").agg(F.sum("whole").alias("n"), F.sum(1 - C("whole")).alias("parts"), F.min("part").alias("first"), F.max("part").alias("last"))
    say = lambda wrong, text: F.when(F.coalesce(wrong, F.lit(False)), F.lit(text))
    found = F.array_compact(
        F.array(
            say(C("n") > 1, "is there more than once"), say(C("first") < C("last"), "is in two parts"), say((C("parts") > 1) & (C("first") == C("last")), "is in a part twice"),
            say((C("n") > 0) & (C("parts") == 0), "is in no part"), say((C("n") == 0) & (C("parts") > 0), "is not in the whole"),
        )
    )
    return n.select("id", F.explode(found).alias("problem"))


def set_counts(parts: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """(part, n, wanted) of sets (part, id) that have another number of distinct ids than they should, those without any too."""
    wanted = parts.sparkSession.createDataFrame([(k, int(v)) for k, v in expected.items()], "part string, wanted long")
    got = parts.select(C("part").cast("string").alias("part"), "id").distinct().groupBy("part").agg(F.count("*").alias("n"))
    both = got.join(wanted, "part", "full_outer").select("part", F.coalesce("n", F.lit(0)).alias("n"), "wanted")
    return both.filter(~C("n").eqNullSafe(C("wanted")))


def identity_mismatches(observed: DataFrame, expected: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field) pairs in which a run's metadata differ from what was asked for; null equals null."""
    joined = observed.alias("o").join(expected.alias("e"), key)
    named = F.array_compact(F.array(*[F.when(~C(f"o.{f}").eqNullSafe(C(f"e.{f}")), f) for f in fields]))
    return joined.select(key, F.explode(named).alias("field"))


def latest_ready(states: DataFrame) -> DataFrame:
    """The newest experiment whose next phase may start: all phases before the first pending one are completed.

    states: id, changed, phases (array of structs with a status).
    """
    n_done = F.size(F.filter("phases", lambda p: p["status"] == "completed"))
    first = F.get(C("phases"), n_done)
    in_order = F.forall(F.slice("phases", F.lit(1), F.greatest(n_done, F.lit(1))), lambda p: p["status"] == "completed") | (n_done == 0)
    ready = states.filter(in_order & (first["status"] == "pending"))
    return ready.orderBy(F.desc("changed"), "id").limit(1).select("id", (n_done + 1).alias("phase"))


#: Allowed moves of a phase.
MOVES = {"pending": ("running",), "running": ("review_pending", "failed"), "review_pending": ("completed", "failed"), "failed": ("running",), "completed": ()}


def advanced(moves: DataFrame, experiments: DataFrame, key: str = "id") -> DataFrame:
    """(key, statuses, bad_seq, problem): each experiment's phases after its moves (key, seq, phase, to), in the order of seq.

    ``experiments`` (key, phases) says how many phases there are; all start as pending. A phase moves as MOVES allow, and starts only
    once those before it are completed. The first move that breaks a rule ends the fold; bad_seq and problem are null without one. The moves of one
    experiment, a handful, come together as one array.
    """
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, ends in MOVES.items() for b in ends])
    listed = moves.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "phase", "to"))).alias("moves"))
    start = F.struct(F.array_repeat(F.lit("pending"), C("phases")).alias("statuses"), F.lit(None).cast("long").alias("bad_seq"), F.lit(None).cast("string").alias("problem"))

    def step(s: Column, m: Column) -> Column:
        now = F.get(s["statuses"], m["phase"])
        wrong = (
            F.when(now.isNull(), "no such phase")
            .when(~F.array_contains(allowed, F.concat(now, F.lit(">"), m["to"])), F.concat(F.lit("cannot go from "), now, F.lit(" to "), m["to"]))
            .when((m["to"] == "running") & F.exists(F.slice(s["statuses"], F.lit(1), m["phase"]), lambda x: x != "completed"), "must wait for the phases before it")
        )
        moved = F.transform(s["statuses"], lambda x, i: F.when(i == m["phase"], m["to"]).otherwise(x))
        bad = F.struct(s["statuses"].alias("statuses"), m["seq"].cast("long").alias("bad_seq"), wrong.alias("problem"))
        good = F.struct(moved.alias("statuses"), s["bad_seq"].alias("bad_seq"), s["problem"].alias("problem"))
        return F.when(s["problem"].isNotNull(), s).when(wrong.isNotNull(), bad).otherwise(good)

    folded = experiments.join(listed, key, "left").select(key, F.aggregate(F.coalesce("moves", F.array().cast("array<struct<seq:long,phase:int,to:string>>")), start, step).alias("s"))
    return folded.select(key, "s.*")


def flagged_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews that disagree or find a minor or major fault."""
    return reviews.filter(~C("agree") | C("severity").isin("minor", "major"))
