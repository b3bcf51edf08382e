"""Time series inside and across records: counters, gaps, running extremes, resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def first_last_delta(values: Column) -> Column:
    """Last minus first of the non-null values of an array; null for fewer than two."""
    known = F.filter(values, lambda x: x.isNotNull())
    return F.when(F.size(known) >= 2, F.element_at(known, -1) - F.element_at(known, 1))


def counter_rate(df: DataFrame, value: str, time: str, partition: Sequence[str], wrap: int, into: str = "rate") -> DataFrame:
    """Increase per unit of time since the row before; a counter that falls has wrapped at ``wrap``."""
    w = Window.partitionBy(*partition).orderBy(time)
    step = C(value) - F.lag(value).over(w)
    dt = C(time) - F.lag(time).over(w)
    return df.withColumn(into, F.try_divide(F.when(step < 0, step + wrap).otherwise(step).cast("double"), dt))


def utilisation(df: DataFrame, idle: str, total: str, order: str, partition: Sequence[str], into: str = "util") -> DataFrame:
    """100 * (1 - idle step / total step) of cumulative counters."""
    w = Window.partitionBy(*partition).orderBy(order)
    di, dt = C(idle) - F.lag(idle).over(w), C(total) - F.lag(total).over(w)
    return df.withColumn(into, F.when(dt > 0, 100 * (1 - di / dt)))


def core_utilisation(idle_before: Column, idle_now: Column, total_before: Column, total_now: Column) -> Column:
    """The same for arrays with one counter for each core."""
    idle = F.zip_with(idle_now, idle_before, lambda a, b: a - b)
    total = F.zip_with(total_now, total_before, lambda a, b: a - b)
    return F.zip_with(idle, total, lambda i, t: F.when(t > 0, 100 * (1 - i / t)))


def gaps_ms(times: Column) -> Column:
    """Differences of consecutive seconds, in milliseconds."""
    return F.when(
        F.size(times) >= 2,
        F.zip_with(F.slice(times, F.lit(2), F.size(times) - 1), F.slice(times, F.lit(1), F.size(times) - 1), lambda b, a: (b - a) * 1000),
    ).otherwise(F.array().cast("array<double>"))


def running(df: DataFrame, value: str, order: Sequence[str], partition: Sequence[str]) -> DataFrame:
    """Running maximum, minimum and sum."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running_max", F.max(value).over(w)).withColumn("running_min", F.min(value).over(w)).withColumn("running_sum", F.sum(value).over(w))


def by_timestamp(events: DataFrame) -> DataFrame:
    """Bandwidth records (request, t, event, mb): reads and writes of one instant together."""
    side = lambda name: F.coalesce(F.sum(F.when(C("event") == name, C("mb"))), F.lit(0.0))
    return events.groupBy("request", "t").agg(side("read").alias("read_mb"), side("write").alias("write_mb")).withColumn("total_mb", C("read_mb") + C("write_mb"))


def resample(df: DataFrame, seconds: int, time: str = "ts", value: str = "value") -> DataFrame:
    """Tumbling windows: rows, last value and sum of each."""
    start = F.window(time, f"{seconds} seconds")["start"]
    return df.groupBy(start.alias("start")).agg(F.count("*").alias("n"), F.max_by(value, F.struct(time, "event_id")).alias("last"))


def carry_forward(df: DataFrame, value: str, order: str, partition: Sequence[str] = ()) -> DataFrame:
    """The last non-null value up to each row."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))
