"""Choosing among the candidates of a strategy. Candidates: index, det_passed, det_total, dnf, chars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col


def _ratio() -> Column:
    return F.coalesce(F.try_divide(C("det_passed").cast("double"), C("det_total")), F.lit(0.0))


def best(candidates: DataFrame, key: Sequence[str]) -> DataFrame:
    """By share of checks, then finished before unfinished, then longer; the lowest index on ties."""
    order = F.struct((-_ratio()).alias("a"), C("dnf").alias("b"), (-C("chars")).alias("c"), C("index").alias("i"))
    return candidates.groupBy(*key).agg(F.min(order).alias("o"), F.count("*").alias("candidates")).select(*key, C("o.i").alias("selected"), "candidates")


def modal(candidates: DataFrame, key: Sequence[str]) -> DataFrame:
    """The most frequent share of checks (the higher of two as frequent); in it, finished, then longer, then first."""
    ratio = F.round(_ratio(), 3)
    marked = candidates.withColumn("bucket", ratio)
    sizes = marked.groupBy(*key, "bucket").agg(F.count("*").alias("size"), F.min(F.struct(C("dnf").alias("a"), (-C("chars")).alias("b"), C("index").alias("i"))).alias("o"))
    top = sizes.groupBy(*key).agg(F.max_by("o", F.struct("size", "bucket")).alias("o"), F.max("size").alias("votes"))
    return top.select(*key, C("o.i").alias("selected"), "votes")


def revised_or_draft(revised_dnf: Column, draft_dnf: Column, revised: Column, draft: Column) -> Column:
    """The draft, where the revision did not finish and the draft did."""
    return F.when(revised_dnf & ~draft_dnf, draft).otherwise(revised)


def totals(candidates: Column) -> Column:
    """Sums over an array of candidate structs."""
    total = lambda f: F.aggregate(candidates, F.lit(0.0), lambda acc, x: acc + F.coalesce(x[f].cast("double"), F.lit(0.0)))
    return F.struct(*[total(f).alias(f) for f in ("wall_s", "in_tokens", "out_tokens", "retries")])
