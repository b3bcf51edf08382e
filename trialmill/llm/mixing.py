"""Mixing sources to target weights.

Tokens are summed for each source; targets follow the sources' weights, capped at a multiple of
what a source has (the excess goes to the others by weight, until none is above its cap). The
repetition rate of a source is target / size. A document is emitted floor(rate) times, plus once
more if a hash of seed and id, as a number in [0, 1), is below the fraction.

How near a source comes to its target: the words taken deviate by a sum of independent draws, one a document (or key), of
standard deviation sqrt(sum of size^2 p (1 - p)) over the source's documents, p being the fraction of its rate; four such deviations are
passed about once in 16,000 sources. Long documents in a small source make it large, a whole rate (p = 0) makes it nothing.

The filling level comes from running sums over sources sorted by cap / weight, so it is exact
and needs no rounds. Decisions hang on seed and id alone: reruns and retried tasks agree.

Defined cases: a null text has 0 words; the null source is a source, ordered last; a source
without words gets rate 0. The key of a null id is its text. Repeated rows with one id share
their decision. Texts of any length are counted whole. An empty table gives an empty result. Other columns pass through ``mix``.

The level is found in one task that sorts one narrow row a source; it is meant for up to some million
sources.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialmill.llm.common import n_words, shared_dir, store

#: Up to so many sources (a few MB) their rates are broadcast; beyond that they are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) with 52 bits from md5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """sizes (source, source_size) -> source, source_size, target, rate. One row a source: a small table."""
    every = Window.partitionBy()
    order = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    caps = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size").cast("double") * cap)
        .withColumn("full_at", F.col("cap") / F.col("weight"))
    )
    by_level = Window.orderBy("full_at", F.col("source").isNull(), "source")
    up = by_level.rowsBetween(Window.unboundedPreceding, -1)
    down = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum(F.col("source_size").cast("double")).over(every)
    level = (total - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / F.sum("weight").over(down)
    ranked = caps.withColumn("level", level).withColumn("pos", F.row_number().over(by_level))
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("pos", "level"))).over(every)
    filled = ranked.withColumn("first", first)
    target = F.when(F.col("first").isNull() | (F.col("pos") < F.col("first.pos")), F.col("cap")).otherwise(
        F.least(F.col("weight") * F.col("first.level"), F.col("cap"))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return filled.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def _with_copies(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows (source, u, ...) with the columns of their source's target and the number of copies."""
    if targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    named = targets.withColumnRenamed("source", "__source")
    joined = rows.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    whole = F.floor("rate")
    return joined.withColumn("copies", (whole + (F.col("u") < F.col("rate") - whole).cast("long")).cast("long"))


def plan_mix(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """For each row of ``docs``: id, size (words), source, source_size, target, rate, copies."""
    path = shared_dir(docs.sparkSession)
    text = F.col(text_col).cast("string")
    key = F.coalesce(F.col(id_col).cast("string"), text, F.lit(""))
    sized = store(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"), uniform(seed, key).alias("u")),
        f"{path}/sized",
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = store(source_targets(sizes, weights, cap), f"{path}/targets")
    return _with_copies(sized, targets).drop("u")


def mix(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as the plan says, with all its columns."""
    path = shared_dir(docs.sparkSession)
    text = F.col(text_col).cast("string")
    sizes = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.sum(n_words(text)).alias("source_size"))
    targets = store(source_targets(sizes, weights, cap), f"{path}/targets")
    key = F.coalesce(F.col(id_col).cast("string"), text, F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).cast("string").alias("source"), uniform(seed, key).alias("u")
    )
    picked = _with_copies(rows, targets).filter("copies > 0")
    return picked.select("row", F.explode(F.expr("array_repeat(0, cast(copies as int))"))).select("row.*")
