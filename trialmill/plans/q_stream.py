"""Streaming queries, each run to its end over files that land in a folder; their results equal the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialmill.plans.base import judged, query, trials
from trialmill.plans.q_ingest import folder
from trialmill.sources.staging import stored
from trialmill.streaming import jobs

C = F.col


#: Rows of a file that lands, which one task writes and one reads.
FILE_ROWS = 500_000


def _dealt(rows, batches: int = 3):
    """Rows dealt out to files, and how many of these make one of so many batches."""
    rows = stored(rows)
    each = max(1, -(-rows.count() // (batches * FILE_ROWS)))
    return rows.repartition(batches * each), each


def _stream(spark, rows, batches: int = 3):
    """Rows as a stream of a few batches of files."""
    path = folder(spark)
    dealt, each = _dealt(rows, batches)
    dealt.write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(path)


@query("t02_idempotent_ratings", "SELECT DISTINCT model, scenario, rep, judge_model FROM judged WHERE score IS NOT NULL")
def t02(spark, d):
    rows = judged(spark, d).select("model", "scenario", "rep", "judge_model", "score")
    key = ["model", "scenario", "rep", "judge_model"]
    out, mark = folder(spark), folder(spark)
    once = jobs.once_per_key(_stream(spark, rows.unionByName(rows)), key)  # delivered twice
    with jobs.with_rocksdb(spark):  # a key of state for each rating
        once.select(*key).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("t03_stream_upsert", "SELECT model, scenario, arg_min(seq, (-det_score, seq)) AS seq, max(det_score) AS det_score FROM trials GROUP BY 1, 2")
def t03(spark, d):
    rows = trials(spark, d).select("model", "scenario", "seq", "det_score")
    path = folder(spark)
    jobs.upsert(_stream(spark, rows), path, folder(spark), ["model", "scenario"], ["-det_score", "seq"]).awaitTermination()
    return jobs.latest(spark, path)


@query("t03_stream_completeness", "SELECT model, true AS reached FROM (SELECT DISTINCT model, scenario, rep FROM trials) GROUP BY 1 HAVING count(*) >= 60")
def t03b(spark, d):
    rows = trials(spark, d).select("model", "scenario", "rep")
    path = folder(spark)
    jobs.completed(_stream(spark, rows), "model", ["scenario", "rep"], 60, path, folder(spark)).awaitTermination()
    marks = spark.read.schema("model string, units long").json(path)
    return marks.select("model", (C("units") >= 60).alias("reached"))


@query("t01_incremental_append", "SELECT seq, model, scenario FROM trials")
def t01(spark, d):
    """Lines that land in turn are read once each; a cut line is not."""
    path, out, mark = folder(spark), folder(spark), folder(spark)
    rows = trials(spark, d).select("seq", "model", "scenario")
    dealt, each = _dealt(rows)
    dealt.write.json(path)
    rows.limit(5).select(F.substring(F.to_json(F.struct("seq", "model", "scenario")), 1, 12).alias("value")).write.mode("append").text(path)
    stream = jobs.landed(spark, path, rows.schema, files_per_batch=each)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("t12_terminal_state", ", s AS (SELECT model, bool_or(k = 1) AS c, bool_or(k = 2) AS d FROM trials GROUP BY 1) SELECT model, CASE WHEN c THEN 'canceled' WHEN d THEN 'done' ELSE 'running' END AS state FROM s")
def t12(spark, d):
    t = trials(spark, d)
    markers = t.filter("k IN (1, 2)").select("model", F.when(C("k") == 1, "canceled").otherwise("done").alias("marker"))
    return jobs.terminal_state(t.select("model").distinct().withColumn("state", F.lit("running")), markers, "model")


def _slices(rows, by: str, n: int = 2):
    """Rows in n parts, in the order of a number."""
    cuts = rows.approxQuantile(by, [k / n for k in range(1, n)], 0.01)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows if low is None else rows.filter(C(by) > low)
        yield part if high is None else part.filter(C(by) <= high)


IDLE_MS, STOPS = 40 * 3_600_000, 10


@query(
    "t06_watchdog",
    f", e AS (SELECT model, seq, epoch_us(ts) // 1000 AS ms, class <> 'secure' AS stop FROM trials), l AS (SELECT *, lag(ms) OVER o AS last, row_number() OVER o AS r, sum((NOT stop)::INT) OVER o AS run FROM e WINDOW o AS (PARTITION BY model ORDER BY ms, seq)), "
    f"c AS (SELECT *, sum(stop::INT) OVER (PARTITION BY model, run ORDER BY r) AS stops FROM l), f AS (SELECT model AS subject, r, CASE WHEN ms - last > {IDLE_MS} THEN 'idle' ELSE 'stopped' END AS reason, CASE WHEN ms - last > {IDLE_MS} THEN last + {IDLE_MS} ELSE ms END AS ms "
    f'FROM c WHERE ms - last > {IDLE_MS} OR (stop AND stops >= {STOPS})) SELECT subject, reason, ms AS "at" FROM f QUALIFY row_number() OVER (PARTITION BY subject ORDER BY r) = 1',
)
def t06(spark, d):
    """Trials replayed in the order of their times: the first time each subject is idle too long or stops too often in a row."""
    rows = trials(spark, d).select("model", "seq", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("at"), (C("class") != "secure").alias("stop"))
    path, out, mark = folder(spark), folder(spark), folder(spark)
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number:010d}")
    with jobs.with_rocksdb(spark, partitions=spark.sparkContext.defaultParallelism):
        for part in _slices(rows, "at"):  # each lands, and the stream goes on where it was
            part.write.mode("append").parquet(path)
            stream = spark.readStream.schema(rows.schema).parquet(path)
            found = jobs.watchdog(stream, C("model"), C("at"), C("seq"), C("stop"), STOPS, IDLE_MS, 24 * 3_600_000)
            found.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(jobs.WATCH_OUT).parquet(f"{out}/batch=*")


@query(
    "t05_outbox",
    ", d AS (SELECT seq, (SELECT min(a) FROM range(0, 9) r(a) WHERE (seq + a) % 3 <> 0 AND a >= seq % 4)::INT AS attempt FROM trials) SELECT seq, attempt, 0::BIGINT AS pending FROM d",
)
def t05(spark, d):
    """Every trial is delivered once; every third delivery fails, and some keys fail their first ones."""
    rows = trials(spark, d).select("seq")

    def deliver(some):
        return some.withColumn("ok", ((C("seq") + C("attempt")) % 3 != 0) & (C("attempt") >= C("seq") % 4))

    box = jobs.Outbox(spark, folder(spark), "seq", deliver)
    box.start(_stream(spark, rows.unionByName(rows)), folder(spark)).awaitTermination()
    box.drain()
    return box.delivered().select("seq", "attempt").crossJoin(box.pending().agg(F.count("*").alias("pending")))  # one row
