"""Sources, sinks and streams over small files."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialmill.sources import readers, sinks
from trialmill.streaming import jobs

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def test_three_policies_for_bad_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "p"}\n\n{"a": 2}\n{"a": 3, "b": "cut')
    with gzip.open(tmp_path / "y.jsonl.gz", "wt") as f:
        f.write('{"a": 4, "b": "q"}\n')
    path = str(tmp_path / "*.jsonl*")
    assert sorted(r["a"] for r in readers.read_jsonl(spark, path, SCHEMA, "skip").collect()) == [1, 2, 4]
    kept = readers.read_jsonl(spark, path, SCHEMA, "keep").collect()
    assert len(kept) == 4 and [r["parse_error"] for r in kept if r["parse_error"]] == ['{"a": 3, "b": "cut']
    with pytest.raises(Exception, match="(?i)malformed|failed"):
        readers.read_jsonl(spark, path, SCHEMA).collect()
    assert readers.read_jsonl(spark, str(tmp_path / "none*"), SCHEMA).count() == 0


def test_roster_headers_carry(spark, tmp_path):
    (tmp_path / "r.txt").write_text("# bracket: A\nm1\n\n# x\nm2\n#Bracket: B\nm3\n")
    assert [(r["tag"], r["bracket"]) for r in readers.read_roster(spark, str(tmp_path / "r.txt")).orderBy("line").collect()] == [("m1", "A"), ("m2", "A"), ("m3", "B")]


@pytest.mark.parametrize("body", ['[{"id": "s1"}, {"id": "s2"}]', '{"scenarios": [{"id": "s1"}, {"id": "s2"}], "v": 1}', '{"x": {"id": "s1"}, "y": {"id": "s2"}}'])
def test_scenario_documents(spark, tmp_path, body):
    (tmp_path / "s.json").write_text(body)
    assert sorted(r["id"] for r in readers.read_scenarios(spark, str(tmp_path / "s.json")).collect()) == ["s1", "s2"]


def test_objects_and_answers(spark, tmp_path):
    assert readers.read_object(spark, str(tmp_path / "none.json"), SCHEMA).first()["a"] is None
    (tmp_path / "c.json").write_text('{"a": 7}')
    assert readers.read_object(spark, str(tmp_path / "c.json"), SCHEMA).first()["a"] == 7
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "org_m_1b__s__r1.txt").write_text("one\ntwo")
    (tmp_path / "o" / "org_m_1b__s.txt").write_text("any")
    rows = spark.createDataFrame([("org/m:1b", "s", 0), ("org/m:1b", "s", 1), ("z", "s", 0)], "model string, scenario string, rep int")
    out = readers.with_answers(rows, readers.read_answers(spark, str(tmp_path / "o"))).collect()
    assert {(r["model"], r["rep"]): r["text"] for r in out} == {("org/m:1b", 0): "any", ("org/m:1b", 1): "one\ntwo", ("z", 0): None}


def test_counts_and_newest(spark, tmp_path):
    for k, run in enumerate(("r1", "r2")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "done.txt").write_text("x\n\n \ny\n")


        os.utime(tmp_path / run / "done.txt", (1000 + k, 1000 + k))
    assert [r["lines"] for r in readers.count_lines(spark, str(tmp_path / "*" / "done.txt")).collect()] == [4]
    assert readers.newest_run(spark, str(tmp_path / "*" / "done.txt")).first()["run_id"] == "r2"
    assert readers.first_nonempty(spark, [str(tmp_path / "no"), str(tmp_path / "r1")]) == str(tmp_path / "r1")


def test_snapshot_text_and_markdown(spark, tmp_path):
    df = spark.createDataFrame([(2, True, None), (1, False, 0.5)], "k int, flag boolean, x double")
    sinks.write_snapshot(df, str(tmp_path / "s"), ["k", "flag", "x", "none"], ["k"])
    text = next((tmp_path / "s").glob("*.csv")).read_text().splitlines()
    assert text == ["k,flag,x,none", "1,False,0.5,", "2,True,,"]
    assert sinks.markdown(df.orderBy("k"), ["k", "x"]) == "| k | x |\n|---|---|\n| 1 | 0.5 |\n| 2 | - |"
    assert json.loads(sinks.document(df.orderBy("k")))[0] == {"k": 1, "flag": False, "x": 0.5}
    for write in (lambda n: sinks.markdown(df, ["k"], n), lambda n: sinks.document(df, n)):
        with pytest.raises(ValueError, match="at most"):
            write(1)
    many = spark.range(3000).select(F.col("id").alias("k"), F.lit(None).cast("string").alias("x"))
    sinks.write_markdown(many.repartition(5), str(tmp_path / "md"), ["k", "x"], ["k"])
    files = sorted((tmp_path / "md").glob("part-*"))
    lines = "".join(f.read_text() for f in files).splitlines()
    assert lines[:3] == ["| k | x |", "|---|---|", "| 0 | - |"] and lines[2:] == [f"| {k} | - |" for k in range(3000)]
    sinks.write_document(many, str(tmp_path / "doc"))
    assert spark.read.json(str(tmp_path / "doc")).count() == 3000


SLICE = T.StructType([T.StructField("n", T.LongType()), T.StructField("model", T.StringType())])


def test_many_subjects_share_folders_and_each_is_read_alone(spark, tmp_path):
    path = tmp_path / "s"
    df = spark.range(6000).select(F.col("id").alias("n"), F.when(F.col("id") % 1000 > 0, F.concat(F.lit("org/m:"), F.col("id") % 1000)).alias("model"))
    sinks.write_slices(df, str(path))
    files = list(path.rglob("part-*.json.gz"))
    assert 1 < len(files) <= 256
    assert sorted(readers.read_slices(spark, str(path), SLICE).collect(), key=lambda r: r["n"]) == df.orderBy("n").collect()
    for file in files:
        if "org/m:7" not in {json.loads(x).get("model") for x in gzip.open(file, "rt")}:
            file.write_bytes(b"none of that subject's folder")
    assert sorted(r["n"] for r in readers.read_slices(spark, str(path), SLICE, only="org/m:7").collect()) == [7 + 1000 * k for k in range(6)]


def test_few_subjects_or_all_on_request_have_folders(spark, tmp_path):
    df = spark.range(90).select(F.col("id").alias("n"), F.concat(F.lit("m"), F.col("id") % 30).alias("model"))
    for name, folders in (("few", 256), ("request", None)):
        sinks.write_slices(df, str(tmp_path / name), folders=folders)
        assert {p.name for p in (tmp_path / name).glob("*=*")} == {f"model=m{k}" for k in range(30)}
        assert readers.read_slices(spark, str(tmp_path / name), SLICE).count() == 90
        assert sorted(r["n"] for r in readers.read_slices(spark, str(tmp_path / name), SLICE, only="m7").collect()) == [7, 37, 67]
    sinks.write_slices(df, str(tmp_path / "shared"), folders=4)
    assert len(list((tmp_path / "shared").glob("slices=4/slice=*"))) == 4
    odd = spark.createDataFrame([(1, ""), (2, None), (3, "a/b=c %41")], SLICE)
    sinks.write_slices(odd, str(tmp_path / "odd"))
    assert sorted(tuple(r) for r in readers.read_slices(spark, str(tmp_path / "odd"), SLICE).collect()) == [(1, ""), (2, None), (3, "a/b=c %41")]
    with pytest.raises(ValueError, match="slice"):
        sinks.write_slices(df.withColumnRenamed("n", "slice"), str(tmp_path / "taken"))


def test_stream_upsert_equals_batch_and_restarts(spark, tmp_path):
    src, table, mark = (str(tmp_path / n) for n in ("in", "table", "mark"))
    schema = "k string, s double, seq int"
    spark.createDataFrame([("a", 0.5, 1), ("a", 0.9, 2), ("b", 0.1, 3)], schema).write.parquet(src)
    run = lambda: jobs.upsert(spark.readStream.schema(schema).parquet(src), table, mark, ["k"], ["-s", "seq"]).awaitTermination()
    run()
    spark.createDataFrame([("b", 0.4, 4), ("a", 0.9, 5)], schema).write.mode("append").parquet(src)
    run()
    run()
    assert sorted(tuple(r) for r in jobs.latest(spark, table).select("k", "s", "seq").collect()) == [("a", 0.9, 2), ("b", 0.4, 4)]


def test_upsert_writes_touched_buckets_and_vacuums(spark, tmp_path):
    src, table, mark = (str(tmp_path / n) for n in ("in", "table", "mark"))
    schema = "k long, s double, seq int"
    run = lambda: jobs.upsert(spark.readStream.schema(schema).parquet(src), table, mark, ["k"], ["-s", "seq"], buckets=8).awaitTermination()
    spark.range(200).selectExpr("id AS k", "0.5D AS s", "1 AS seq").coalesce(1).write.parquet(src)
    run()
    spark.createDataFrame([(7, 0.9, 2), (7, 0.1, 3)], schema).write.mode("append").parquet(src)
    run()
    versions = jobs._versions(spark, table)
    assert [len(v) for _, v in sorted(versions.items())] == [8, 1]
    state = lambda: {r["k"]: r["s"] for r in jobs.latest(spark, table).collect()}
    assert state() == {**dict.fromkeys(range(200), 0.5), 7: 0.9}
    assert jobs.vacuum(spark, table) == 1 and jobs.vacuum(spark, table) == 0
    assert state()[7] == 0.9 and len(state()) == 200


def test_a_subject_is_marked_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "model string, unit int"
    for rows in ([("a", 1), ("b", 1)], [("a", 2)], [("a", 3), ("b", 1)], [("a", 4)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        jobs.completed(spark.readStream.schema(schema).parquet(src), "model", ["unit"], 2, out, mark).awaitTermination()
    assert [tuple(r) for r in spark.read.schema("model string, units long").json(out).select("model", "units").collect()] == [("a", 2)]


def test_places_in_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.jsonl").write_text("".join(f'{{"a": {100 * k + i}}}\n' for i in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = readers.with_sequence(spark.read.schema("a long").json(str(tmp_path))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [100 * k + i for k in range(3) for i in range(400)]
    assert [r["a"] for r in sorted(rows, key=lambda r: r["seq"])] == want and sorted(r["seq"] for r in rows) == list(range(1, 1201))


def test_gate_and_stall_timer(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "model string, unit int, score double"
    spark.createDataFrame([("a", 1, 3.0), ("a", 1, 3.0), ("a", 2, None), ("b", 1, 1.0)], schema).write.parquet(src)
    needs = spark.createDataFrame([("a", 2), ("b", 1)], "model string, need int")
    stream = spark.readStream.schema(schema).parquet(src)
    q = jobs.gate(stream, needs, "model", ["unit"]).writeStream.format("memory").queryName("gated").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["model"]: r["ready"] for r in spark.table("gated").collect()} == {"a": False, "b": True}
    # Timers ask for batches without data, for ever; a run that is to end goes without these.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        q = jobs.stall_timer(stream, "model", 60_000).writeStream.format("memory").queryName("stalls").outputMode("update").trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert {r["subject"]: (r["rows"], r["state"]) for r in spark.table("stalls").collect()} == {"a": (3, "active"), "b": (1, "active")}


def test_watchdog_over_restarts_and_silence(spark, tmp_path):
    src, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    schema = "m string, at long, seq long, stop boolean"
    got = []

    def run(rows, silent_ms=10**9):
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(src)
        found = jobs.watchdog(spark.readStream.schema(schema).parquet(src), F.col("m"), F.col("at"), F.col("seq"), F.col("stop"), 3, 100, silent_ms)
        found.writeStream.outputMode("update").foreachBatch(lambda b, n: got.extend(map(tuple, b.collect()))).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()

    with jobs.with_rocksdb(spark):
        run([("a", 30, 3, False), ("a", 10, 1, True), ("a", 20, 2, True), ("b", 10, 4, True), ("b", 20, 5, True), ("c", 5, 6, None), ("d", 0, 7, False)])
        assert got == []
        run([("b", 30, 8, True), ("b", 40, 9, True), ("a", 131, 10, False), ("c", 50, 11, None)])
        assert sorted(got) == [("a", "idle", 130), ("b", "stopped", 30)]
        run([("b", 900, 12, True), ("a", 990, 13, True), ("c", 60, 14, True)], silent_ms=1)
        assert sorted(got) == [("a", "idle", 130), ("b", "stopped", 30)]  # each once
        import time

        time.sleep(0.1)
        run([("e", 1, 15, False)], silent_ms=10**9)
        assert sorted(got) == [("a", "idle", 130), ("b", "stopped", 30), ("c", "silent", 60)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("HDFSBackedStateStoreProvider") or "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")


def test_outbox_records_each_key_once_whatever_dies(spark, tmp_path):
    path, src, mark = (str(tmp_path / n) for n in ("box", "in", "mark"))
    calls = []

    def deliver(some):
        calls.append(sorted(map(tuple, some.collect())))
        if len(calls) in (1, 3):
            raise RuntimeError("lost")
        return some.withColumn("ok", F.col("attempt") >= F.col("k") % 3)

    def run(rows):
        spark.createDataFrame([(r,) for r in rows], "k int").write.mode("append").parquet(src)
        box = jobs.Outbox(spark, path, "k", deliver)
        q = box.start(spark.readStream.schema("k int").parquet(src), mark)
        try:
            q.awaitTermination()
        except Exception as e:
            assert "lost" in str(e)  # noqa: PT017
        return box

    run([0, 1, 2, 2])  # dies
    box = run([3, 3])
    assert calls[0] == calls[1]  # the round that died is done again
    run([1, 4])
    box = run([0, 5])
    box.drain()
    assert sorted((r["k"], r["attempt"]) for r in box.delivered().collect()) == [(k, k % 3) for k in range(6)] and box.pending().count() == 0
    assert box.drain() == 0
    before = len(calls)
    box.round(spark.createDataFrame([(9,)], "k int"), 0)
    assert len(calls) == before  # that round is there already
