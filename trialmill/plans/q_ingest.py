"""Ingest queries: written and read back through the library's sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialmill.sources import readers, sinks
from trialmill.sources.staging import shared_folder, stored
from trialmill.plans.base import query, table, trials

C = F.col


def folder(spark) -> str:
    """A new folder in the cluster's shared place; where none is set (tests), a local one."""
    return shared_folder(spark, "ingest")


def _lines(spark, d):
    """Events as JSON lines, every 50th cut off."""
    line = F.to_json(F.struct("event_id", "user_id", "event_type"))
    return table(spark, d, "events").select(F.when(C("event_id") % 50 == 0, F.substring(line, 1, 15)).otherwise(line).alias("value"))


SCHEMA = "event_id long, user_id long, event_type string"


def _read(spark, d, bad):
    from pyspark.sql.types import _parse_datatype_string

    path = folder(spark)
    _lines(spark, d).write.option("compression", "gzip").text(path)
    return readers.read_jsonl(spark, path, _parse_datatype_string(SCHEMA), bad)


@query("s02_jsonl_skip_bad", "SELECT event_id, user_id, event_type FROM events WHERE event_id % 50 <> 0", views=False)
def s02(spark, d):
    return _read(spark, d, "skip")


@query("s03_jsonl_keep_bad", "SELECT count(*) FILTER (event_id % 50 = 0) AS bad, count(*) FILTER (event_id % 50 <> 0) AS good FROM events", views=False)
def s03(spark, d):
    rows = stored(_read(spark, d, "keep"))
    return rows.agg(F.count("parse_error").alias("bad"), F.count_if(C("parse_error").isNull()).alias("good"))


@query("s07_csv_snapshot", "SELECT model, scenario, rep, det_score, CASE WHEN dnf THEN 'True' ELSE 'False' END AS dnf, energy_wh FROM trials")
def s07(spark, d):
    from pyspark.sql.types import _parse_datatype_string

    path, columns = folder(spark), ["model", "scenario", "rep", "det_score", "dnf", "energy_wh"]
    sinks.write_snapshot(trials(spark, d), path, columns, ["model", "scenario", "rep"])
    return readers.read_csv(spark, path, _parse_datatype_string("model string, scenario string, rep int, det_score double, dnf string, energy_wh double"))


@query("s13_line_counts", "SELECT count(*) AS lines FROM events", views=False)
def s13(spark, d):
    path = folder(spark)
    _lines(spark, d).unionByName(spark.createDataFrame([(" ",), ("",)], "value string")).write.text(path)
    return readers.count_lines(spark, path).agg(F.sum("lines").alias("lines"))


@query("k06_subject_slices", "SELECT model, count(*) AS n, sum(k)::BIGINT AS k FROM trials GROUP BY 1")
def k06(spark, d):
    from pyspark.sql.types import _parse_datatype_string

    path = folder(spark)
    sinks.write_slices(trials(spark, d).select("model", "seq", "k"), path)
    rows = readers.read_slices(spark, path, _parse_datatype_string("seq long, k int, model string"))
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query("k05_markdown_rows", "SELECT concat('| ', scenario, ' | ', count(*), ' | - |') AS line FROM trials GROUP BY scenario")
def k05(spark, d):
    cells = trials(spark, d).groupBy("scenario").agg(F.count("*").alias("n")).withColumn("none", F.lit(None).cast("string"))
    return sinks.markdown_lines(cells, ["scenario", "n", "none"])


@query("p01_canonical_names", "SELECT seq, memory AS env_memory_context, finish_reason AS finish FROM trials")
def p01(spark, d):
    dotted = trials(spark, d).select("seq", C("memory").alias("env.memory_context"), C("finish_reason").alias("gen_ai.finish"))
    return readers.canonical_names(dotted, {"gen_ai.finish": "finish"})


@query("s17_perf_lines", "SELECT seq / 8e0 AS t, CASE WHEN seq % 2 = 0 THEN 'data_reads' ELSE 'data_writes' END AS event, seq * 1000e0 AS value FROM trials")
def s17(spark, d):
    event = F.when(C("seq") % 2 == 0, "data_reads").otherwise("data_writes")
    line = F.concat(F.lit("  "), (C("seq") / 8.0).cast("string"), F.lit("   "), F.format_number(C("seq") * 1000, 0), F.lit("  MiB  "), event)
    noise = spark.createDataFrame([("# started",), ("",)], "value string")
    return readers.parse_perf(trials(spark, d).select(line.alias("value")).unionByName(noise))


@query("s20_perplexity", "SELECT model, CASE WHEN substr(model, 2)::INT % 4 = 0 THEN NULL ELSE substr(model, 2)::INT / 8e0 END AS ppl FROM (SELECT DISTINCT model FROM trials)")
def s20(spark, d):
    n = F.substring("model", 2, 10).cast("int")
    text = F.when(n % 4 == 0, "failed").otherwise(F.concat(F.lit("done: PPL = "), (n / 8.0).cast("string"), F.lit(" +/- 0.1")))
    return readers.parse_perplexity(trials(spark, d).select("model").distinct().select("model", text.alias("text")))


@query("s21_skip_lines", ", l AS (SELECT seq AS n, CASE WHEN k % 3 = 0 THEN 'SKIP after 2' ELSE 'ok' END AS value FROM trials ORDER BY seq DESC LIMIT 400) SELECT n, value, (SELECT count(*) FROM l WHERE value <> 'ok') AS total FROM l WHERE value <> 'ok' ORDER BY n DESC LIMIT 30")
def s21(spark, d):
    return readers.skip_lines(trials(spark, d).select(C("seq").alias("n"), F.when(C("k") % 3 == 0, "SKIP after 2").otherwise("ok").alias("value")))
