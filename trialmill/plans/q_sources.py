"""Queries over sources and sinks that read back what they wrote."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialmill.functions import checks as ck
from trialmill.functions import derive, predicates
from trialmill.operators import agreement, audit, progress
from trialmill.plans.base import query, trials
from trialmill.plans.q_ingest import folder
from trialmill.sources import readers, sinks

C = F.col
LINE = T.StructType([T.StructField("seq", T.LongType()), T.StructField("model", T.StringType()), T.StructField("scenario", T.StringType())])
_ALL = "SELECT seq, model, scenario FROM trials"


def _rows(spark, d):
    return trials(spark, d).select("seq", "model", "scenario")


def _put(spark, path: str, text: str, time_ms: int | None = None) -> None:
    """A small file of a given name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(conf)
    out = fs.create(hadoop)
    out.write(bytearray(text.encode()))
    out.close()
    if time_ms is not None:
        fs.setTimes(hadoop, time_ms, -1)


@query("s01_jsonl_strict", _ALL)
def s01(spark, d):
    path = folder(spark)
    sinks.append_jsonl(_rows(spark, d), path)
    return readers.read_jsonl(spark, path, LINE)


@query("s05_many_files", _ALL + " UNION ALL " + _ALL)
def s05(spark, d):
    a, b = folder(spark), folder(spark)
    _rows(spark, d).write.json(f"{a}/x/one")
    _rows(spark, d).write.json(f"{b}/two")
    return readers.read_jsonl(spark, [f"{a}/*/one/*.json", f"{b}/two", f"{b}/none"], LINE)


@query("s06_source_preference", _ALL)
def s06(spark, d):
    """A missing and a blank candidate are passed over; the one after the full one is not read."""
    path = folder(spark)
    spark.createDataFrame([(" ",), ("",)], "value string").write.text(f"{path}/blank")
    _rows(spark, d).write.json(f"{path}/full")
    _rows(spark, d).limit(1).write.json(f"{path}/last")
    chosen = readers.first_nonempty(spark, [f"{path}/missing", f"{path}/blank", f"{path}/full", f"{path}/last"])
    return readers.read_jsonl(spark, chosen, LINE)


@query("s08_csv_columns", "SELECT seq, scenario FROM trials")
def s08(spark, d):
    path = folder(spark)
    sinks.write_snapshot(_rows(spark, d), path, ["seq", "model", "scenario"], ["seq"])
    return readers.read_csv(spark, path, LINE, ["seq", "scenario"])


@query("s09_roster", "SELECT DISTINCT model AS tag, bracket FROM trials")
def s09(spark, d):
    """A roster text with a header for each bracket, comments and blanks."""
    path = folder(spark)
    parts = trials(spark, d).groupBy("bracket").agg(F.array_join(F.array_sort(F.collect_set("model")), "\n# note\n\n").alias("tags"))
    text = parts.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("# bracket: "), "bracket", F.lit("\n"), "tags"))), "\n").alias("value"))
    text.coalesce(1).write.text(path)
    return readers.read_roster(spark, path).select("tag", "bracket")


@query("s10_scenarios", "SELECT DISTINCT scenario AS id, class FROM trials")
def s10(spark, d):
    path = folder(spark)
    listed = trials(spark, d).select(C("scenario").alias("id"), "class").distinct().agg(F.collect_list(F.struct("id", "class")).alias("scenarios"))
    listed.select(F.to_json(F.struct("scenarios")).alias("value")).coalesce(1).write.text(path)
    return readers.read_scenarios(spark, path).select("id", "class")


@query("s11_small_object", "SELECT max(seq) AS seq, count(*) AS n FROM trials")
def s11(spark, d):
    path, schema = folder(spark), T.StructType([T.StructField("seq", T.LongType()), T.StructField("n", T.LongType())])
    trials(spark, d).agg(F.max("seq").alias("seq"), F.count("*").alias("n")).coalesce(1).write.json(path)
    return readers.read_object(spark, path, schema)


@query("s12_answers", "SELECT model, scenario, rep, CASE WHEN model = 'u1' THEN CASE WHEN rep = 0 THEN concat('first', chr(10), scenario) ELSE concat('any ', scenario) END END AS text FROM trials")
def s12(spark, d):
    path = folder(spark)
    rows = trials(spark, d).select("model", "scenario", "rep")
    for (scenario,) in rows.select("scenario").distinct().collect():  # a handful of scenarios
        _put(spark, f"{path}/u1__{scenario}__r0.txt", f"first\n{scenario}")
        _put(spark, f"{path}/u1__{scenario}.txt", f"any {scenario}")
    return readers.with_answers(rows, readers.read_answers(spark, path)).select("model", "scenario", "rep", "text")


@query("s15_newest_run", "SELECT 'run-b' AS run_id", views=False)
def s15(spark, d):
    path = folder(spark)
    for k, run in enumerate(("run-c", "run-a", "run-b")):
        _put(spark, f"{path}/{run}/run-state.json", "{}", 1_700_000_000_000 + 5000 * k)
    return readers.newest_run(spark, f"{path}/*/run-state.json").select("run_id")


@query("s16_run_states", "SELECT run_id, count(*) AS rows, count(DISTINCT model) AS subjects, arg_max(scenario, seq) AS state FROM trials GROUP BY 1")
def s16(spark, d):
    path = folder(spark)
    sinks.write_slices(trials(spark, d).select("run_id", "seq", "model", C("scenario").alias("state")), path, "run_id", folders=None)
    schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField("model", T.StringType()), T.StructField("state", T.StringType())])
    return progress.run_states(readers.read_run_folders(spark, path, schema, r"run_id=([^/]+)/"))


@query("j16_run_meta", "SELECT run_id, count(*) AS rows, CASE WHEN contains(run_id, '20240611') THEN 'node-1' ELSE 'unknown' END AS host, CASE WHEN contains(run_id, '20240611') THEN 7 ELSE 0 END AS level FROM trials GROUP BY 1")
def j16(spark, d):
    runs = trials(spark, d).groupBy("run_id").agg(F.count("*").alias("rows"))
    meta = runs.filter(C("run_id").contains("20240611")).select("run_id", F.lit("node-1").alias("host"), F.lit(7).alias("level"))
    return progress.with_meta(runs, meta, {"host": "unknown", "level": 0})


@query("s_sequence", "SELECT seq, row_number() OVER (ORDER BY seq) AS place FROM trials")
def s_sequence(spark, d):
    """Places in files that were written in the order of seq."""
    path = folder(spark)
    _rows(spark, d).orderBy("seq").write.json(path)
    return readers.with_sequence(spark.read.schema(LINE).json(path), "place").select("seq", "place")


@query("k01_append", _ALL + " UNION ALL " + _ALL)
def k01(spark, d):
    path = folder(spark)
    for _ in range(2):
        sinks.append_jsonl(_rows(spark, d), path)
    return readers.read_jsonl(spark, path, LINE)


@query("k03_document", "SELECT model, count(*) AS n FROM trials GROUP BY 1 ORDER BY n DESC, model LIMIT 5")
def k03(spark, d):
    top = trials(spark, d).groupBy("model").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model").limit(5)
    text = spark.createDataFrame([(sinks.document(top),)], "value string")
    return text.select(F.explode(F.from_json("value", "array<struct<model:string,n:long>>")).alias("x")).select("x.*")


@query("k04_versions", "SELECT seq, model, concat(scenario, '!') AS scenario FROM trials")
def k04(spark, d):
    path = folder(spark)
    sinks.replace_table(_rows(spark, d), path, 1)
    newest = sinks.replace_table(_rows(spark, d).withColumn("scenario", F.concat("scenario", F.lit("!"))), path, 2)
    return spark.read.parquet(newest)


@query("k08_enriched", "SELECT count(*) AS rows, count(energy_wh) AS with_energy, count(pair_id) AS with_pair FROM trials")
def k08(spark, d):
    """Null fields are left out of the lines."""
    path = folder(spark)
    sinks.write_enriched(trials(spark, d).select("seq", "energy_wh", "pair_id"), path)
    keys = F.json_object_keys("value")
    return spark.read.text(path).agg(F.count("*").alias("rows"), F.count_if(F.array_contains(keys, "energy_wh")).alias("with_energy"), F.count_if(F.array_contains(keys, "pair_id")).alias("with_pair"))


@query("k07_markers", "SELECT model, count(*) AS units FROM trials GROUP BY 1 HAVING count(*) >= 60")
def k07(spark, d):
    path = folder(spark)
    done = trials(spark, d).groupBy("model").agg(F.min("bracket").alias("bracket"), F.max("ts").alias("ts"), F.count("*").alias("units"))
    for low, high in ((60, 65), (65, 10**9)):
        sinks.append_markers(done.filter((C("units") >= low) & (C("units") < high)), path)
    return spark.read.schema("model string, units long").json(path)


_ID = "CASE k % 6 WHEN 0 THEN concat('run-', k) WHEN 1 THEN concat('../', model) WHEN 2 THEN '' WHEN 3 THEN concat(model, '.x_1') WHEN 4 THEN '-a' ELSE 'a b' END"


@query("f13_safe_ids", f"SELECT seq, regexp_full_match({_ID}, '[A-Za-z0-9][A-Za-z0-9._-]{{0,127}}') AS safe FROM trials")
def f13(spark, d):
    return trials(spark, d).select("seq", predicates.safe_id(F.expr(_ID)).alias("safe"))


_JSON = "CASE k % 7 WHEN 0 THEN '12' WHEN 1 THEN '\"12\"' WHEN 2 THEN 'true' WHEN 3 THEN 'null' WHEN 4 THEN '-2.5e1' WHEN 5 THEN '[1]' ELSE 'false' END"


@query("f07_numbers", f"SELECT seq, CASE WHEN json_type(x) = 'BOOLEAN' THEN (x = 'true')::INT::DOUBLE WHEN json_type(x) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN x::DOUBLE END AS n FROM (SELECT seq, {_JSON} AS x FROM trials)")
def f07(spark, d):
    return trials(spark, d).select("seq", predicates.numeric(F.expr(_JSON)).alias("n"))


@query("p17_experts", "SELECT seq, CASE WHEN k % 3 = 2 THEN 1 ELSE 0 END AS is_moe, CASE WHEN starts_with(finish_reason, 'DNF') THEN finish_reason END AS dnf_type FROM trials")
def p17(spark, d):
    experts = F.when(C("k") % 3 == 1, 0).when(C("k") % 3 == 2, 8)
    return trials(spark, d).select("seq", derive.is_moe(experts).alias("is_moe"), derive.dnf_type(C("finish_reason")).alias("dnf_type"))


@query("e19_overhead", "SELECT seq, CASE WHEN k <> 0 THEN 100 * (k - tok_s) / k END AS pct FROM trials")
def e19(spark, d):
    return trials(spark, d).select("seq", agreement.overhead_pct(C("k").cast("double"), C("tok_s")).alias("pct"))


_VERSION = "CASE user_id % 4 WHEN 0 THEN 'tool version is 0.5.1' WHEN 1 THEN '0.5.1-rc' WHEN 2 THEN '0.6.0' ELSE ' nightly ' END"


@query("d06_version_pin", f", v AS (SELECT CASE WHEN regexp_extract(v, '[0-9]+\\.[0-9]+\\.[0-9]+') <> '' THEN regexp_extract(v, '[0-9]+\\.[0-9]+\\.[0-9]+') ELSE trim(v) END AS v FROM (SELECT {_VERSION} AS v FROM events)) "
       "SELECT string_agg(DISTINCT v, ',' ORDER BY v) AS seen, count(DISTINCT v) = 1 AS consistent, count(DISTINCT v) = 1 AND min(v) = '0.5.1' AS pinned FROM v")  # fmt: skip
def d06(spark, d):
    from trialmill.plans.base import table

    return audit.version_pin(table(spark, d, "events").select(F.expr(_VERSION).alias("v")), "v", "v0.5.1")


@query(
    "d08_preflight",
    ", n AS (SELECT model, min(memory) AS governor, max(peak_c)::BIGINT AS paranoid, min(strategy) AS strategy, bool_or(k = 3) AS membw, concat('is 0.', count(*) % 3, '.1 (x)') AS version, max(sha) AS sha FROM trials GROUP BY 1) "
    "SELECT model, 'governor' AS field, 'should be none' AS problem FROM n WHERE governor <> 'none' UNION ALL SELECT model, 'paranoid', 'over 93' FROM n WHERE paranoid > 93 "
    "UNION ALL SELECT model, 'membw', 'required' FROM n WHERE NOT membw UNION ALL SELECT model, 'version', 'should be version 0.1.1' FROM n WHERE version <> 'is 0.1.1 (x)' "
    "UNION ALL SELECT model, 'sha', 'not approved' FROM n WHERE sha NOT IN ('sha-new', 'sha-x')",
)
def d08(spark, d):
    nodes = trials(spark, d).groupBy("model").agg(
        F.min("memory").alias("governor"), F.max("peak_c").cast("long").alias("paranoid"), F.bool_or(C("k") == 3).alias("membw"),
        F.concat(F.lit("is 0."), (F.count("*") % 3).cast("string"), F.lit(".1 (x)")).alias("version"), F.max("sha").alias("sha"),
    )
    return audit.preflight(nodes, "model", {"governor": "none"}, {"paranoid": 93}, ["membw"], {"version": "0.1.1"}, {"sha": ["sha-new", "sha-x"]})


@query(
    "d10_catalogue",
    ", s AS (SELECT DISTINCT model AS id, substr(model, 2)::INT AS n FROM trials) SELECT id, 'id is there more than once' AS problem FROM s WHERE n % 5 = 0 "
    "UNION ALL SELECT id, 'gold answer fails its checks' FROM s, range(1, 3) r(i) WHERE n % 3 = 0 AND (i = 1 OR n % 5 = 0) UNION ALL SELECT id, 'control answer passes the checks' FROM s, range(1, 3) r(i) WHERE n % 4 = 0 AND (i = 1 OR n % 5 = 0)",
)
def d10(spark, d):
    n = F.substring("model", 2, 10).cast("int")
    spec = F.from_json(F.lit('[{"type": "must_include", "patterns": ["restart"]}, {"type": "must_exclude", "patterns": ["delete"]}]'), ck.CHECKS)
    one = trials(spark, d).select("model").distinct().select(
        C("model").alias("id"), F.when(n % 3 == 0, "restart, then delete it").otherwise("do not delete; restart").alias("gold"),
        F.when(n % 4 == 0, "restart").otherwise("delete").alias("control"), spec.alias("checks"), n.alias("n"),
    )
    return audit.catalogue_faults(one.unionByName(one.filter("n % 5 = 0")))


@query("d10_file_hash", "SELECT sha256(concat('a', chr(10))) AS sha256, true AS approved UNION ALL SELECT sha256('b'), false", views=False)
def d10_hash(spark, d):
    path = folder(spark)
    _put(spark, f"{path}/a.json", "a\n")
    _put(spark, f"{path}/b.json", "b")
    files = spark.read.format("binaryFile").load(path)
    return audit.file_hashes(files, ["87428fc522803d31065e7bce3cf03fe475096631e5e07bbd7a0fde60c4cf25c7"]).select("sha256", "approved")
