"""Streaming: incremental ingest, idempotent upsert, completeness, gates and stall timers.

Sources are folders into which immutable files land. Keys, not event times, decide about late and
repeated rows; state is bounded by the number of keys of the run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trialmill.operators.ranks import pick
from trialmill.sources.staging import stored

C = F.col


def landed(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """A stream of JSON lines from a landing folder; a cut last line is dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("mode", "DROPMALFORMED").json(folder)


def once_per_key(stream: DataFrame, key: Sequence[str]) -> DataFrame:
    """At-least-once delivery made idempotent: ratings without a score are not done and pass no state."""
    return stream.filter(C("score").isNotNull()).dropDuplicates(list(key))


def upsert(stream: DataFrame, path: str, checkpoint: str, key: Sequence[str], order: Sequence[str], trigger: dict | None = None, buckets: int = 64) -> StreamingQuery:
    """Keep the best row of each key in a versioned Parquet table, in buckets of keys: a batch writes anew only the buckets it touches.

    ``order`` lists columns by which rows compare, descending with a leading minus. A batch that is run again
    finds its version there and writes nothing, so a restart changes nothing. ``vacuum`` removes what newer versions replace.
    """
    ordering = [-C(c[1:]) if c.startswith("-") else C(c) for c in order]

    def merge(batch: DataFrame, number: int) -> None:
        spark, target = batch.sparkSession, f"{path}/v={number:010d}"
        if _committed(spark, target):
            return
        rows = batch.withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in rows.select(BUCKET).distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        places = {b: p for b, p in _places(spark, path, number).items() if b in touched}
        if places:
            before = spark.read.schema(batch.schema).parquet(*places.values())
            rows = rows.unionByName(before.withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")))
        pick(rows, [BUCKET, *key], ordering).write.mode("overwrite").partitionBy(BUCKET).parquet(target)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


BUCKET = "__bucket"


def _committed(spark: SparkSession, target: str) -> bool:
    from trialmill.sources.readers import exists

    return exists(spark, f"{target}/_SUCCESS")


def _matches(spark: SparkSession, pattern: str) -> list[str]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return [s.getPath().toString() for s in found or []]


def _versions(spark: SparkSession, path: str) -> dict[int, dict[int, str]]:
    """Folders of the buckets of each committed version."""
    done = {int(n.rpartition("v=")[2].partition("/")[0]) for n in _matches(spark, f"{path}/v=*/_SUCCESS")}
    out: dict[int, dict[int, str]] = {}
    for folder in _matches(spark, f"{path}/v=*/{BUCKET}=*"):
        version, _, bucket = folder.rpartition("/v=")[2].partition(f"/{BUCKET}=")
        if int(version) in done:
            out.setdefault(int(version), {})[int(bucket)] = folder
    return out


def _places(spark: SparkSession, path: str, below: int | None = None) -> dict[int, str]:
    """For each bucket the folder of the newest version that wrote it."""
    places: dict[int, str] = {}
    for version, folders in sorted(_versions(spark, path).items()):
        if below is None or version < below:
            places |= folders
    return places


def latest(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """An upserted table as its committed versions leave it, if there is one."""
    places = _places(spark, path, below)
    return spark.read.parquet(*places.values()) if places else None


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete folders of buckets that a newer committed version replaces; says how many. Not while a stream or a reader is at work."""
    kept, gone = set(_places(spark, path).values()), 0
    for folders in _versions(spark, path).values():
        for folder in set(folders.values()) - kept:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            gone += bool(hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True))
    return gone


def completeness(stream: DataFrame, subject: str, unit: Sequence[str]) -> DataFrame:
    """Distinct units of each subject so far (update mode)."""
    return stream.dropDuplicates([subject, *unit]).groupBy(subject).agg(F.count("*").alias("units"))


def completed(stream: DataFrame, subject: str, unit: Sequence[str], expected: int, path: str, checkpoint: str) -> StreamingQuery:
    """Append a marker (subject, units) when a subject first has all its units.

    Later units of a subject, or a batch that is run again, write no second marker.
    """

    def mark(batch: DataFrame, number: int) -> None:
        full, target = batch.filter(C("units") >= expected), f"{path}/batch={number:010d}"
        earlier = sorted(n.rpartition("/")[0] for n in _matches(batch.sparkSession, f"{path}/batch=*/_SUCCESS"))
        earlier = [n for n in earlier if int(n.rpartition("batch=")[2]) < number]
        if earlier:
            full = full.join(batch.sparkSession.read.schema(batch.schema).json(earlier).select(subject), subject, "left_anti")
        full.write.mode("overwrite").json(target)

    counted = completeness(stream, subject, unit)
    return counted.writeStream.outputMode("update").foreachBatch(mark).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gate(stream: DataFrame, needs: DataFrame, subject: str, unit: Sequence[str]) -> DataFrame:
    """Stream-static gate: distinct rated units of each subject against those it needs (subject, need)."""
    counted = stream.filter(C("score").isNotNull()).dropDuplicates([subject, *unit]).groupBy(subject).agg(F.count("*").alias("got"))
    return counted.join(needs, subject).withColumn("ready", C("got") >= C("need"))


STALL_OUT = "subject string, rows long, state string"
STALL_STATE = "rows long"


def stall_timer(stream: DataFrame, subject: str, idle_ms: int) -> DataFrame:
    """Rows of each subject, and the state ``stalled`` once none came for ``idle_ms`` of processing time.

    The timers ask for batches without data, so the query runs until it is stopped; with
    spark.sql.streaming.noDataMicroBatches.enabled off, a run over available rows ends.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], rows, "stalled")], columns=["subject", "rows", "state"])
            return
        rows += sum(len(b) for b in batches)
        state.update((rows,))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], rows, "active")], columns=["subject", "rows", "state"])

    return stream.groupBy(subject).applyInPandasWithState(step, STALL_OUT, STALL_STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


WATCH_OUT = "subject string, reason string, at long"


class _Watch(StatefulProcessor):
    """State of a run: when it last made progress, how often in a row it has stopped since, and whether it was reported."""

    def __init__(self, stops: int, idle_ms: int, silent_ms: int) -> None:
        self.stops, self.idle_ms, self.silent_ms = stops, idle_ms, silent_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "last long, stopped int, failed boolean")

    def _found(self, key: tuple, reason: str, at: int) -> pd.DataFrame:
        return pd.DataFrame([(key[0], reason, at)], columns=["subject", "reason", "at"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, stopped, failed = self.run.get() if self.run.exists() else (None, 0, False)
        batch = pd.concat(list(rows)).sort_values(["at", "seq"])
        for at, stop in zip(batch["at"].tolist(), batch["stopped"].tolist(), strict=True):
            if failed:
                break
            if last is not None and at - last > self.idle_ms:
                failed = True
                yield self._found(key, "idle", last + self.idle_ms)
            else:
                stopped = stopped + 1 if stop else 0
                if stopped >= self.stops:
                    failed = True
                    yield self._found(key, "stopped", at)
            last = at
        self.run.update((last, stopped, failed))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if not failed:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, stopped, _ = self.run.get()
        self.run.update((last, stopped, True))
        yield self._found(key, "silent", last)

    def close(self) -> None:
        pass


def watchdog(stream: DataFrame, subject: Column, at: Column, seq: Column, stopped: Column, stops: int = 10, idle_ms: int = 180_000, silent_ms: int = 180_000) -> DataFrame:
    """Runs that fail, each once: (subject, reason, at), in update mode.

    ``stopped``: so many rows in a row say that the run has stopped. ``idle``: its rows are further apart than ``idle_ms`` by their own times
    (milliseconds). ``silent``: nothing came for ``silent_ms`` of processing time, by a timer that each batch of the run sets anew. Batches
    come in the order of their times; rows of a batch are put in order. The state store must be RocksDB's (``with_rocksdb``).
    """
    rows = stream.select(subject.cast("string").alias("subject"), at.cast("long").alias("at"), seq.cast("long").alias("seq"), F.coalesce(stopped, F.lit(False)).alias("stopped"))
    return rows.groupBy("subject").transformWithStateInPandas(_Watch(stops, idle_ms, silent_ms), WATCH_OUT, "Update", "ProcessingTime")


@contextmanager
def with_rocksdb(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, in so many partitions if given, and make no batches without data."""
    conf = ({} if partitions is None else {"spark.sql.shuffle.partitions": str(partitions)}) | {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Outbox:
    """Deliveries that are tried again until they succeed: a versioned table of pending keys (key, attempt, due) and one of delivered ones.

    A round takes the new keys and those that are due, hands them to ``deliver`` and writes the next version of both tables: what was
    delivered, and what is pending with one attempt more and its next due round (1, 2, 4, ... rounds on, up to ``longest``). A version counts once both
    of its folders are committed; a round that died is done again over the same input, so a key is recorded once, whatever was lost.
    ``deliver`` takes (key, attempt) and returns it with a flag ``ok``; it may see a key again whose round died after it.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, deliver: Callable[[DataFrame], DataFrame], longest: int = 64) -> None:
        self.spark, self.path, self.key, self.deliver, self.longest = spark, path, key, deliver, longest

    def _done(self) -> list[int]:
        sides = [{int(n.rpartition("v=")[2].partition("/")[0]) for n in _matches(self.spark, f"{self.path}/{side}/v=*/_SUCCESS")} for side in ("pending", "delivered")]
        return sorted(sides[0] & sides[1])

    def _read(self, side: str, versions: Sequence[int], kind: str) -> DataFrame | None:
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/{side}/v={v:010d}" for v in versions]) if versions else None

    def pending(self) -> DataFrame | None:
        done = self._done()
        return None if not done else self.spark.read.parquet(f"{self.path}/pending/v={done[-1]:010d}")

    def delivered(self) -> DataFrame | None:
        done = self._done()
        return None if not done else self.spark.read.parquet(*[f"{self.path}/delivered/v={v:010d}" for v in done])

    def round(self, new: DataFrame | None, number: int) -> None:
        """Round ``number`` with new keys; nothing if it is there already."""
        done = self._done()
        if number in done:
            return
        earlier = [v for v in done if v < number]
        fresh = None if new is None else new.select(self.key).distinct().select(self.key, F.lit(0).alias("attempt"), F.lit(number).cast("long").alias("due"))
        if earlier:
            kind = f"{self.key} {dict(self.spark.read.parquet(f'{self.path}/pending/v={earlier[-1]:010d}').dtypes)[self.key]}, attempt int, due long"
            waiting, sent = self._read("pending", earlier[-1:], kind), self._read("delivered", earlier, kind)
            if fresh is not None:
                waiting = waiting.unionByName(fresh.join(waiting, self.key, "left_anti").join(sent, self.key, "left_anti"))
        else:
            waiting = fresh
        if waiting is None:
            return
        waiting = stored(waiting)
        tried = stored(self.deliver(waiting.filter(C("due") <= number).select(self.key, "attempt")).select(self.key, "attempt", F.coalesce("ok", F.lit(False)).alias("ok")))
        again = tried.filter(~C("ok")).select(self.key, (C("attempt") + 1).alias("attempt"), (F.lit(number) + F.least(F.lit(self.longest), F.pow(F.lit(2), "attempt"))).cast("long").alias("due"))
        for side, rows in (("delivered", tried.filter("ok").select(self.key, "attempt", F.lit(number).cast("long").alias("due"))), ("pending", waiting.filter(C("due") > number).unionByName(again))):
            rows.write.mode("overwrite").parquet(f"{self.path}/{side}/v={number:010d}")

    def start(self, stream: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """A round for each batch of a stream of keys."""
        writer = stream.writeStream.foreachBatch(lambda batch, number: self.round(batch, number)).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def drain(self, most: int = 1000) -> int:
        """Rounds without new keys until none is pending; says how many. Rounds in which nothing is due are skipped."""
        for k in range(most):
            waiting = self.pending()
            first = None if waiting is None else waiting.agg(F.min("due")).first()[0]
            if first is None:
                return k
            self.round(None, max(first, self._done()[-1] + 1))
        raise RuntimeError(f"keys are still pending after {most} rounds")


def live_progress(stream: DataFrame) -> DataFrame:
    """Running totals (complete mode): rows, energy, seconds."""
    return stream.groupBy("model").agg(F.count("*").alias("rows"), F.sum("wall_s").alias("wall_s"), F.max(F.struct("seq", "scenario")).alias("last"))


def terminal_state(states: DataFrame, markers: DataFrame, key: str) -> DataFrame:
    """Markers override: canceled goes before done, and both before the state itself."""
    flags = markers.groupBy(key).agg(F.bool_or(C("marker") == "canceled").alias("c"), F.bool_or(C("marker") == "done").alias("d"))
    joined = states.join(flags, key, "left")
    return joined.select(key, F.when(C("c"), "canceled").when(C("d"), "done").otherwise(C("state")).alias("state"))


def windowed(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Extension: event-time windows with a watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
