"""Merging of records by key: de-duplication, upserts, completeness, consensus."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialmill.operators.ranks import keep_best, last_wins, pick, running_total
from trialmill.sources.staging import stored

#: Up to so many rows, checked by a count, a side of a cross join is broadcast.
BROADCAST_ROWS = 100_000
#: Units in one bitmap.
BUCKET_BITS = 32768


def _broadcast_if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def dedup_best(df: DataFrame, key: Sequence[str], score: str, seq: str, fatal: str = "fatal") -> DataFrame:
    """Failure stubs go; of each key the best row stays, the earliest on ties."""
    return keep_best(df.filter(F.col(fatal).isNull()), key, score, seq)


def duplicate_count(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: rows beyond the first of their key."""
    return df.groupBy(*key).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.greatest(F.col("c") - 1, F.lit(0))), F.lit(0)).alias("duplicates"))


def upsert_newer(current: DataFrame, new: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """Rows of both by key; the new one replaces, at the old one's place. New keys go last, in their order."""
    return _upsert(current, new, key, seq, F.lit(True))


def upsert_better(current: DataFrame, new: DataFrame, key: Sequence[str], seq: str, score: str) -> DataFrame:
    """As ``upsert_newer``, but a row is only replaced by one with a strictly higher score (null counts as 0)."""
    return _upsert(current, new, key, seq, F.coalesce(F.col(f"n.{score}"), F.lit(0.0)) > F.coalesce(F.col(f"c.{score}"), F.lit(0.0)))


def _upsert(current: DataFrame, new: DataFrame, key: Sequence[str], seq: str, wins: Column) -> DataFrame:
    c, n = current.alias("c"), last_wins(new, key, seq).alias("n")
    on = [F.col(f"c.{k}") == F.col(f"n.{k}") for k in key]
    both = c.join(n, on, "full_outer")
    is_old, is_new = F.col(f"c.{seq}").isNotNull(), F.col(f"n.{seq}").isNotNull()
    take = F.when(~is_old, True).when(~is_new, False).otherwise(wins)
    columns = [F.when(take, F.col(f"n.{x}")).otherwise(F.col(f"c.{x}")).alias(x) for x in current.columns if x != seq]
    place = F.when(is_old, F.col(f"c.{seq}")).otherwise(F.col(f"n.{seq}"))
    return both.select(*columns, place.alias(seq))


def completeness(df: DataFrame, subject: str, expected: int, slack: int = 2) -> DataFrame:
    """Rows for each subject, and whether they reach expected - slack."""
    return df.groupBy(subject).agg(F.count("*").alias("rows")).withColumn("complete", F.col("rows") >= expected - slack)


def consensus(results: DataFrame, ratings: DataFrame, key: Sequence[str]) -> DataFrame:
    """Mean rating of each result: unfinished ones without a rating count as 1, finished ones without are left null."""
    means = ratings.filter(F.col("score").isNotNull()).groupBy(*key).agg((F.sum("score") / F.count("*")).alias("mean_score"))
    joined = results.join(means, list(key), "left")
    return joined.withColumn("consensus", F.coalesce("mean_score", F.when(F.col("dnf"), 1.0))).drop("mean_score")


def pending(work: DataFrame, specs: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Units of ``work`` x ``specs`` that are not in ``done``; unfinished ratings (null score) are not done."""
    ready = done.filter(F.col("score").isNotNull()).select(*key).distinct()
    return work.crossJoin(_broadcast_if_small(specs)).join(ready, list(key), "left_anti")


def _coverage(seen: DataFrame, grid: DataFrame, subject: str, unit: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Expected units by number (bucket, bit), and for each subject and bucket the bitmap of the units it covers."""
    units = stored(grid.select(*unit).distinct())
    few = units.count() <= BROADCAST_ROWS  # then one task numbers them
    units = units.withColumn("__no", F.row_number().over(Window.orderBy(*unit)) - 1) if few else running_total(units, [], list(unit), F.lit(1), "__no")
    units = units.withColumn("__bucket", F.floor(F.col("__no") / BUCKET_BITS)).withColumn("__bit", (F.col("__no") % BUCKET_BITS).cast("int")).drop("__no")
    units = units if few else stored(units)
    near = F.broadcast(units) if few else units
    bits = seen.select(subject, *unit).join(near, list(unit)).groupBy(subject, "__bucket").agg(F.bitmap_construct_agg("__bit").alias("__map"))
    return units, bits


def missing_units(seen: DataFrame, subjects: DataFrame, grid: DataFrame, subject: str, unit: Sequence[str]) -> DataFrame:
    """(subject, unit) pairs of the expected grid that no row covers: relational division by bitmaps.

    Each subject has one bitmap for every BUCKET_BITS units; what is missing is read off its complement, so only missing pairs become rows.
    """
    units, bits = _coverage(seen, grid, subject, unit)
    buckets = units.groupBy("__bucket").agg(F.count("*").cast("int").alias("__size"))
    wanted = subjects.select(subject).distinct().join(_broadcast_if_small(buckets), how="cross")  # a row for BUCKET_BITS units

    @F.pandas_udf("array<int>")
    def absent(maps: pd.Series, sizes: pd.Series) -> pd.Series:
        def one(some: bytes | None, n: int) -> np.ndarray:
            got = np.unpackbits(np.frombuffer(some, np.uint8), bitorder="little")[:n] if some is not None else np.zeros(n, np.uint8)
            return np.flatnonzero(got == 0).astype(np.int32)

        return pd.Series([one(m, n) for m, n in zip(maps, sizes, strict=True)], dtype=object)

    left = wanted.join(bits, [subject, "__bucket"], "left").select(subject, "__bucket", F.explode(absent("__map", "__size")).alias("__bit"))
    return left.join(_broadcast_if_small(units), ["__bucket", "__bit"]).select(subject, *unit)


def is_complete(seen: DataFrame, grid: DataFrame, subject: str, unit: Sequence[str]) -> DataFrame:
    """Relational division: subjects with the number of expected units they cover, complete if all."""
    units, bits = _coverage(seen, grid, subject, unit)
    n = units.count()
    got = bits.groupBy(subject).agg(F.sum(F.bitmap_count("__map")).alias("covered"))
    return got.withColumn("complete", F.col("covered") == n)


def trim_last_subject(df: DataFrame, subject: str, seq: str, finished: DataFrame) -> DataFrame:
    """Without the rows of the subject that was written last, unless it is in ``finished``."""
    last = df.agg(F.max_by(subject, seq).alias(subject)).join(finished, subject, "left_anti")
    return df.join(F.broadcast(last), subject, "left_anti")


def representative(df: DataFrame, subject: str, known: str, seq: str) -> DataFrame:
    """The first row of each subject in which ``known`` is set."""
    return pick(df.filter(F.col(known).isNotNull()), [subject], [F.col(seq)])
