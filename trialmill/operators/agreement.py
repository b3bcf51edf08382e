"""Agreement between raters, rank correlations and other estimators.

Inputs are pairs (a, b) of ratings, optionally grouped. Closed forms over grouped sums replace
matrices: a pass over the data, then arithmetic on a few rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialmill.operators.ranks import average_rank, seeded, uniforms, value_ranks
from trialmill.sources.staging import stored

C = F.col
#: Random draws that one row is dealt out for, equal values that are drawn for together, and parts of a stratum.
DRAW_BLOCK, POISSON_ROWS, SALTS = 1000, 256, 256
#: Points that one task compares when inversions are counted: their frames and orders take some 50 MB.
BLOCK_ROWS = 1 << 18


def pair_raters(ratings: DataFrame, key: Sequence[str], first: str, second: str) -> DataFrame:
    """(key, a, b) for items that both raters scored."""
    side = lambda who, into: ratings.filter((C("judge_model") == who) & C("score").isNotNull()).select(*key, C("score").alias(into))
    return side(first, "a").join(side(second, "b"), list(key))


def pairing_counts(ratings: DataFrame, key: Sequence[str], first: str, second: str) -> DataFrame:
    """One row: items both rated, only the first, only the second."""
    flags = ratings.filter("score IS NOT NULL").groupBy(*key).agg(
        F.bool_or(C("judge_model") == first).alias("has_a"), F.bool_or(C("judge_model") == second).alias("has_b")
    )
    return flags.agg(F.count_if(C("has_a") & C("has_b")).alias("both"), F.count_if(C("has_a") & ~C("has_b")).alias("only_a"), F.count_if(C("has_b") & ~C("has_a")).alias("only_b"))


def confusion(pairs: DataFrame, scale: Sequence[int]) -> DataFrame:
    """Counts of all (a, b) cells of a fixed scale, zero-filled."""
    spark = pairs.sparkSession
    cells = spark.createDataFrame([(int(i), int(j)) for i in scale for j in scale], "a int, b int")
    found = pairs.groupBy(C("a").cast("int").alias("a"), C("b").cast("int").alias("b")).agg(F.count("*").alias("n"))
    return cells.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def kappa_nominal(pairs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Cohen's kappa: 1 if chance agreement is 1."""
    keyed = pairs.select(*group, "a", "b")
    n = keyed.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(C("a") == C("b")).alias("same"))
    margin = lambda x: keyed.groupBy(*group, C(x).alias("cat")).agg(F.count("*").alias(f"n{x}"))
    chance = margin("a").join(margin("b"), [*group, "cat"]).groupBy(*group).agg(F.sum(C("na") * C("nb")).alias("cross"))
    joined = n.join(chance, list(group), "left") if group else n.crossJoin(chance)
    po, pe = C("same") / C("n"), F.coalesce("cross", F.lit(0)) / (C("n") * C("n"))
    return joined.select(*group, "n", F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def kappa_weighted(pairs: DataFrame, weights: str = "quadratic", scale: Sequence[int] | None = None) -> DataFrame:
    """Weighted kappa over one set of pairs: 1 - observed / expected disagreement, 1 if nothing is expected.

    Without ``scale`` a rating's index is its place among the ratings seen, so {1, 2, 5} are evenly spaced.
    """
    if scale is None:
        seen = pairs.select(C("a").alias("v")).union(pairs.select("b")).distinct()
        index = seen.select("v", (F.row_number().over(Window.orderBy("v")) - 1).alias("i"))
    else:
        index = pairs.sparkSession.createDataFrame([(int(v), k) for k, v in enumerate(scale)], "v int, i int")
    cells = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    cells = cells.join(index.withColumnRenamed("v", "a").withColumnRenamed("i", "ia"), "a").join(index.withColumnRenamed("v", "b").withColumnRenamed("i", "ib"), "b")
    gap = F.abs(C("ia") - C("ib"))
    cost = {"unweighted": F.when(gap > 0, 1).otherwise(0), "linear": gap, "quadratic": gap * gap}[weights]
    observed = cells.agg(F.sum(cost * C("n")).alias("observed"), F.sum("n").alias("n"))
    margin = lambda i: cells.groupBy(C(i).alias("i")).agg(F.sum("n").cast("double").alias(f"n{i}"))
    sides = index.select("i").join(margin("ia"), "i", "left").join(margin("ib"), "i", "left").fillna(0.0, ["nia", "nib"])
    # Expected disagreement from sums over categories, not over pairs of them.
    upto = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    i, total = C("i"), F.sum("nia")
    steps = sides.withColumn("fa", F.sum("nia").over(upto)).withColumn("fb", F.sum("nib").over(upto))
    crossed = F.sum(C("fa")) * total + F.sum(C("fb")) * total - 2 * F.sum(C("fa") * C("fb"))
    expected = steps.agg(
        {
            "unweighted": total * total - F.sum(C("nia") * C("nib")),
            "quadratic": total * F.sum(i * i * (C("nia") + C("nib"))) - 2 * F.sum(i * C("nia")) * F.sum(i * C("nib")),
            "linear": crossed,
        }[weights].alias("expected")
    )
    ratio = C("observed") * C("n") / C("expected")
    return observed.crossJoin(expected).select(C("n").alias("n"), F.when(C("expected") == 0, 1.0).otherwise(1 - ratio).alias("kappa"))


def kappa_quadratic(pairs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Quadratic kappa on a fixed scale, in one pass: the scale's width cancels."""
    a, b = C("a").cast("long"), C("b").cast("long")
    s = pairs.groupBy(*group).agg(
        F.count("*").alias("n"), F.sum((a - b) * (a - b)).alias("d"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * a).alias("qa"), F.sum(b * b).alias("qb")
    )
    expected = C("n") * (C("qa") + C("qb")) - 2 * C("sa") * C("sb")
    return s.select(*group, "n", F.when(expected == 0, 1.0).otherwise(1 - C("n") * C("d") / expected).alias("qwk"), (C("sa") / C("n")).alias("mean_a"), (C("sb") / C("n")).alias("mean_b"))


def kappa_binary(pairs: DataFrame, good: int) -> DataFrame:
    """Kappa on whether a rating reaches ``good``."""
    return kappa_quadratic(pairs.select((C("a") >= good).cast("int").alias("a"), (C("b") >= good).cast("int").alias("b")))


def fleiss(ratings: DataFrame, item: Sequence[str], category: str) -> DataFrame:
    """Fleiss' kappa: null unless all items have the same number (two or more) of ratings."""
    cells = ratings.groupBy(*item, C(category).alias("cat")).agg(F.count("*").alias("c"))
    items = cells.groupBy(*item).agg(F.sum("c").alias("n"), F.sum(C("c") * (C("c") - 1)).alias("agree"))
    total = items.agg(F.count("*").alias("items"), F.min("n").alias("low"), F.max("n").alias("high"), F.sum("agree").alias("agree"))
    shares = cells.groupBy("cat").agg(F.sum("c").alias("c")).agg(F.sum(C("c") * C("c")).alias("squares"), F.sum("c").alias("all"))
    p, pe = C("agree") / (C("items") * C("high") * (C("high") - 1)), C("squares") / (C("all") * C("all"))
    kappa = F.when((C("low") == C("high")) & (C("high") >= 2), F.when(pe >= 1, 1.0).otherwise((p - pe) / (1 - pe)))
    return total.crossJoin(shares).select("items", kappa.alias("kappa"))


def closeness(pairs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Shares of equal and of at most one apart, and the mean distance."""
    gap = F.abs(C("a") - C("b"))
    return pairs.groupBy(*group).agg(
        F.count("*").alias("n"), (F.count_if(gap == 0) / F.count("*")).alias("exact"), (F.count_if(gap <= 1) / F.count("*")).alias("within_1"), (F.sum(gap) / F.count("*")).alias("mean_gap")
    )


def all_agree(ratings: DataFrame, item: Sequence[str], raters: int) -> DataFrame:
    """Among items that all raters scored: how many there are and how many got one score."""
    cells = ratings.filter("score IS NOT NULL").groupBy(*item).agg(F.count_distinct("judge_model").alias("raters"), F.min("score").alias("low"), F.max("score").alias("high"))
    return cells.filter(C("raters") == raters).agg(F.count("*").alias("items"), F.count_if(C("low") == C("high")).alias("same"))


def _sums(df: DataFrame, x: Column, y: Column, group: Sequence[str]) -> DataFrame:
    x, y = x.cast("double"), y.cast("double")
    both = x.isNotNull() & y.isNotNull()
    return df.filter(both).groupBy(*group).agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("qx"), F.sum(y * y).alias("qy"), F.sum(x * y).alias("p")
    )


def pearson(df: DataFrame, x: str, y: str, group: Sequence[str] = (), least: int = 3) -> DataFrame:
    """Pearson's r over pairwise complete rows; null for fewer than ``least`` rows or no variance."""
    return _r(_sums(df, C(x), C(y), group), group, least)


def _r(s: DataFrame, group: Sequence[str], least: int) -> DataFrame:
    """(group, n, r) from the sums of products."""
    vx, vy = C("n") * C("qx") - C("sx") * C("sx"), C("n") * C("qy") - C("sy") * C("sy")
    r = (C("n") * C("p") - C("sx") * C("sy")) / F.sqrt(vx) / F.sqrt(vy)
    return s.select(*group, "n", F.when((C("n") >= least) & (vx > 0) & (vy > 0), r).alias("r"))


def spearman(df: DataFrame, x: str, y: str, group: Sequence[str] = ()) -> DataFrame:
    """Pearson's r of average ranks, from the counts of distinct pairs."""
    known = df.filter(C(x).isNotNull() & C(y).isNotNull())
    cells = known.groupBy(*group, C(x).alias("__x"), C(y).alias("__y")).agg(F.count("*").alias("__c"))
    for v, r in (("__x", "__rx"), ("__y", "__ry")):
        cells = cells.join(value_ranks(known.withColumn(v, C(x if v == "__x" else y)), v, r, group), [*group, v])
    n, total = C("__c"), lambda e: F.sum(e * C("__c"))
    s = cells.groupBy(*group).agg(
        F.sum(n).alias("n"), total(C("__rx")).alias("sx"), total(C("__ry")).alias("sy"), total(C("__rx") * C("__rx")).alias("qx"), total(C("__ry") * C("__ry")).alias("qy"), total(C("__rx") * C("__ry")).alias("p")
    )
    return _r(s, group, 2).withColumnRenamed("r", "rho")


def kendall_tau_b(pairs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Kendall's tau-b of any two scales; pairs with a null are left out, null without two values on either scale.

    Discordant pairs are the inversions between two orders of the distinct cells (a, b): by a, then b, and by b, then a. Ties are none
    in either, and ties of pairs come from grouped counts.
    """
    cells = stored(pairs.filter(C("a").isNotNull() & C("b").isNotNull()).groupBy("a", "b").agg(F.count("*").alias("n")))
    exact = lambda n: n.cast("decimal(19,0)")
    doubles = lambda df: df.agg(F.coalesce(F.sum(exact(C("n")) * exact(C("n") - 1)), F.lit(0)).cast("double")).first()[0] / 2
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    every = total * (total - 1) // 2
    by_a, by_b = (doubles(cells.groupBy(x).agg(F.sum("n").alias("n"))) for x in ("a", "b"))
    same = doubles(cells)
    rest = every - by_a - by_b + same
    ua, ub = every - by_a, every - by_b
    tau = (rest - 2 * inversions(cells, "a", "b", "n", block_rows)) / math.sqrt(ua) / math.sqrt(ub) if ua > 0 and ub > 0 else None
    return pairs.sparkSession.createDataFrame([(tau,)], "tau_b double")


def inversions(points: DataFrame, x: str, y: str, n: str, block_rows: int = BLOCK_ROWS) -> float:
    """Weighted pairs of distinct points of which one is greater in x and less in y.

    Points are cut into blocks of about ``block_rows`` twice, by ranges of (x, y) and of (y, x); a block is one task. Pairs in one block of the first
    kind are counted there; other pairs in one block of the second kind are counted there, by their blocks of the first; for
    all others only the two blocks count, so the sums of the block table's cells are points of the same problem, and far fewer.
    """
    size = points.count()
    blocks = -(-size // block_rows)
    rows = points.select(C(x).alias("x"), C(y).alias("y"), C(n).alias("n"))
    if blocks <= 1:
        return _inverted(rows.withColumn("block", F.lit(0)), ["x", "y"], ["y", "x"])
    rows = stored(rows.repartitionByRange(blocks, "x", "y").withColumn("i", F.spark_partition_id()))
    rows = stored(rows.repartitionByRange(blocks, "y", "x").withColumn("k", F.spark_partition_id()))
    within = _inverted(rows.withColumn("block", C("i")), ["x", "y"], ["y", "x"])
    across = _inverted(rows.withColumn("block", C("k")), ["i", "y", "x"], ["y", "x"])
    table = stored(rows.groupBy("i", "k").agg(F.sum("n").alias("n")))
    if table.count() >= size:
        raise ValueError(f"blocks of {block_rows} points are too small for {size} points")
    return within + across + inversions(table, "i", "k", "n", block_rows)


def _inverted(rows: DataFrame, first: Sequence[str], second: Sequence[str]) -> float:
    """Inversions between two orders of the rows of each block, summed over blocks."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf.reset_index(drop=True, inplace=True)
        place = np.empty(len(pdf), np.int64)
        place[pdf[list(second)].sort_values(list(second)).index] = np.arange(len(pdf))
        order = pdf[list(first)].sort_values(list(first)).index
        return pd.DataFrame({"pairs": [count_inversions(place[order], pdf["n"].to_numpy(np.int64)[order])]})

    found = rows.select("block", *dict.fromkeys([*first, *second]), "n").groupBy("block").applyInPandas(count, "pairs double").agg(F.sum("pairs")).first()[0]
    return found or 0.0


def count_inversions(place: np.ndarray, n: np.ndarray) -> float:
    """Sum of n[i] * n[j] over i < j with place[i] > place[j], for places that are a permutation.

    From the highest bit of the places down: among those that agree above it, a one before a zero is an inversion.
    """
    kind = np.int64 if int(n.sum()) ** 2 < 1 << 62 else np.float64
    place, n, total = place.copy(), n.astype(kind), 0
    for bit in reversed(range(max(len(place) - 1, 1).bit_length())):
        one = (place >> bit & 1).astype(bool)
        ahead = np.cumsum(np.where(one, n, 0))
        start = np.flatnonzero(np.diff(place >> (bit + 1), prepend=-1))
        before = np.repeat(ahead[start] - np.where(one[start], n[start], 0), np.diff(np.append(start, len(place))))
        total += (np.where(one, 0, n) * (ahead - before)).sum().item()
        order = np.argsort(place >> bit, kind="stable")
        place, n = place[order], n[order]
    return float(total)


def icc_2_1(pairs: DataFrame) -> DataFrame:
    """ICC(2,1) of two raters: two-way random effects, absolute agreement, single rater."""
    a, b = C("a").cast("double"), C("b").cast("double")
    s = pairs.agg(F.count("*").alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * a + b * b).alias("q"), F.sum((a + b) * (a + b)).alias("rows2"))
    n, total = C("n"), C("sa") + C("sb")
    correction = total * total / (2 * n)
    rows, cols, everything = C("rows2") / 2 - correction, (C("sa") * C("sa") + C("sb") * C("sb")) / n - correction, C("q") - correction
    msr, msc, mse = rows / (n - 1), cols, (everything - rows - cols) / (n - 1)
    return s.select("n", ((msr - mse) / (msr + mse + 2 * (msc - mse) / n)).alias("icc"))


def bland_altman(pairs: DataFrame) -> DataFrame:
    """Bias, standard deviation of differences and the limits of agreement."""
    s = pairs.select((C("a") - C("b")).cast("double").alias("d")).agg(F.count("*").alias("n"), F.sum("d").alias("s"), F.sum(C("d") * C("d")).alias("q"))
    bias = C("s") / C("n")
    sd = F.sqrt((C("n") * C("q") - C("s") * C("s")) / (C("n") * (C("n") - 1)))
    return s.select("n", bias.alias("bias"), sd.alias("sd"), (bias - 1.96 * sd).alias("low"), (bias + 1.96 * sd).alias("high"))


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line and r."""
    s = _sums(df, C(x), C(y), ())
    vx, vy, cov = C("n") * C("qx") - C("sx") * C("sx"), C("n") * C("qy") - C("sy") * C("sy"), C("n") * C("p") - C("sx") * C("sy")
    return s.select("n", (cov / vx).alias("slope"), ((C("sy") - cov / vx * C("sx")) / C("n")).alias("intercept"), (cov / F.sqrt(vx) / F.sqrt(vy)).alias("r"))


def label(kappa: Column) -> Column:
    """Landis and Koch's bands. Fixed values."""
    return (
        F.when(kappa >= 0.81, "almost perfect").when(kappa >= 0.61, "substantial").when(kappa >= 0.41, "moderate")
        .when(kappa >= 0.21, "fair").when(kappa >= 0, "slight").when(kappa.isNotNull(), "poor")
    )


def friedman(df: DataFrame, treatment: str, block: str, value: str) -> DataFrame:
    """Friedman's chi-square over blocks that have all treatments, corrected for ties, and its p; null under 3 treatments or 2 blocks."""
    cells = df.groupBy(block, treatment).agg((F.sum(C(value).cast("double")) / F.count(value)).alias("v")).filter("v IS NOT NULL")
    k = df.filter(C(value).isNotNull()).agg(F.count_distinct(treatment)).first()[0]
    whole = cells.groupBy(block).count().filter(C("count") == k).select(block)
    ranked = average_rank(cells.join(whole, block), "v", "rank", [block])
    ties = ranked.groupBy(block, "v").agg(F.count("*").alias("t")).agg(F.sum(C("t") * C("t") * C("t") - C("t")).alias("ties"))
    sums = ranked.groupBy(treatment).agg(F.sum("rank").alias("r"), F.count("*").alias("n"))
    s = sums.agg(F.sum(C("r") * C("r")).alias("squares"), F.max("n").alias("n"), F.count("*").alias("k")).crossJoin(ties)
    n, kk = C("n"), C("k")
    raw = 12 * C("squares") / (n * kk * (kk + 1)) - 3 * n * (kk + 1)
    fix = 1 - C("ties") / (n * kk * (kk * kk - 1))
    found = s.select("n", "k", F.when((kk >= 3) & (n >= 2) & (fix > 0), raw / fix).alias("chi2"))
    return found.withColumn("p", chi2_tail(C("chi2"), C("k") - 1))


def log_gamma(a: Column) -> Column:
    """The logarithm of the gamma function for a > 0: Stirling's series from a + 10 on, less the logarithm of the ten factors between."""
    b = a + 10
    series = (b - 0.5) * F.log(b) - b + 0.5 * math.log(2 * math.pi) + 1 / (12 * b) - 1 / (360 * b**3) + 1 / (1260 * b**5) - 1 / (1680 * b**7)
    return series - sum((F.log(a + k) for k in range(1, 10)), F.log(a))


def chi2_tail(x: Column, df: Column) -> Column:
    """P(X > x) of the chi-square distribution, for any number of degrees of freedom.

    Below its middle the series of the lower tail, above it the continued fraction of the upper one (Lentz's method): the common factor of
    either is taken as a logarithm, so that nothing overflows and small tails keep their digits. Terms are in proportion to the
    square root of the degrees of freedom, which is what both need near the middle.
    """
    a, z = df.cast("double") / 2, x.cast("double") / 2
    steps = F.sequence(F.lit(1), (60 + 12 * F.sqrt(a)).cast("int"))
    factor = a * F.log(z) - z - log_gamma(a)

    one = F.lit(1.0)
    grown = lambda s, n: F.struct((s["term"] * z / (a + n)).alias("term"), (s["total"] + s["term"] * z / (a + n)).alias("total"))
    series = F.aggregate(steps, F.struct(one.alias("term"), one.alias("total")), grown, lambda s: s["total"])
    lower = F.exp(factor - F.log(a) + F.log(series))

    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    b0 = F.greatest(z + 1 - a, F.lit(1.0))  # the branch below is only read where z + 1 - a is over 2

    def lentz(s: Column, n: Column) -> Column:
        over, b = n * (a - n), s["b"] + 2
        return F.struct(b.alias("b"), safe(b + over / s["c"]).alias("c"), (1 / safe(over * s["d"] + b)).alias("d"), s["h"].alias("h"))

    def step(s: Column, n: Column) -> Column:
        return F.get(F.transform(F.array(lentz(s, n)), lambda t: F.struct(t["b"], t["c"], t["d"], (t["h"] * t["c"] * t["d"]).alias("h"))), 0)

    first = F.struct(b0.alias("b"), F.lit(1 / tiny).alias("c"), (1 / b0).alias("d"), (1 / b0).alias("h"))
    upper = F.exp(factor + F.log(F.aggregate(steps, first, step, lambda s: s["h"])))
    return F.when(x <= 0, 1.0).when(z < a + 1, 1 - lower).otherwise(upper)


def normal_ci(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """Mean and a 95 % interval by the normal approximation; no interval for fewer than two values."""
    x = C(value).cast("double")
    s = df.filter(x.isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    m = C("s") / C("n")
    half = 1.96 * F.sqrt((C("n") * C("q") - C("s") * C("s")) / (C("n") * C("n"))) / F.sqrt(C("n").cast("double"))
    return s.select(*group, "n", m.alias("mean"), F.when(C("n") >= 2, m - half).alias("low"), F.when(C("n") >= 2, m + half).alias("high"))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """(n, least, steps) for whole rates n: the cumulative probabilities of Poisson(n) from ``least`` on, to ten deviations and more on either side."""
    spread = 10 * F.sqrt(C("n").cast("double"))
    ends = rates.select(C("n").cast("long").alias("n")).distinct().select("n", F.greatest(F.floor(C("n") - spread) - 10, F.lit(0)).alias("least"), (F.ceil(C("n") + spread) + 20).alias("most"))
    terms = ends.select("n", "least", F.explode(F.sequence("least", "most")).alias("k"))
    mass = F.exp(-C("n").cast("double") + C("k") * F.log(C("n").cast("double")) - log_gamma(C("k").cast("double") + 1))
    upto = F.sum(mass).over(Window.partitionBy("n").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    listed = terms.select("n", "least", "k", upto.alias("p")).groupBy("n", "least").agg(F.array_sort(F.collect_list(F.struct("k", "p"))).alias("s"))
    return listed.select("n", "least", F.transform("s", lambda x: x["p"]).alias("steps"))


def bootstrap_ci(df: DataFrame, value: str, group: str, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """Mean and a 95 % interval by the Poisson bootstrap, which needs no group in one place.

    Every row has weight Poisson(1) in each of ``draws`` resamples, so POISSON_ROWS equal values or fewer have a weight Poisson(their number)
    together. Weights come from counters by inversion (``uniform``), so any run, and any engine, draws the same. A batch of rows gives its weighted
    sums by draw, which meet in a grouped aggregate, and the interval is the 2.5 to 97.5 percentile of the resampled means (one row a draw).
    """
    x = df.filter(C(value).isNotNull()).groupBy(C(group).alias("g"), C(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    x = stored(x)
    parts = x.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((C("c") - 1) / POISSON_ROWS).cast("int"))))
    parts = parts.withColumn("n", F.least(C("c") - C("part") * POISSON_ROWS, F.lit(POISSON_ROWS)))
    steps = {r["n"]: (r["least"], np.array(r["steps"])) for r in poisson_steps(parts).collect()}  # POISSON_ROWS rows at most
    blocks = df.sparkSession.range(0, draws, DRAW_BLOCK).select(C("id").alias("block"))
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    stem = F.concat_ws(":", F.lit(str(seed)), *[C(c).cast("string") for c in ("g", "v", "part")])
    dealt = parts.join(F.broadcast(blocks)).repartition(tasks).select("g", "v", "n", "block", stem.alias("stem"))  # a row a block of draws

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = defaultdict(lambda: np.zeros((2, DRAW_BLOCK)))
            for g, v, n, block, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                least, upto = steps[n]
                u = uniforms(text, range(block, min(block + DRAW_BLOCK, draws)))
                w = least + np.searchsorted(upto, u)
                sums[g, block][:, : len(w)] += w, w * v
            for (g, block), (w, wv) in sums.items():
                many = min(DRAW_BLOCK, draws - block)
                columns = [pa.array([g] * many, batch.schema.field("g").type), pa.array(np.arange(block, block + many)), pa.array(w[:many]), pa.array(wv[:many])]
                yield pa.RecordBatch.from_arrays(columns, ["g", "draw", "w", "wv"])

    kind = x.schema["g"].dataType.simpleString()
    summed = dealt.mapInArrow(weighed, f"g {kind}, draw long, w double, wv double")
    means = summed.groupBy("g", "draw").agg((F.sum("wv") / F.sum("w")).alias("m"))
    bounds = means.groupBy("g").agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    exact = x.groupBy("g").agg((F.sum(C("v") * C("c")) / F.sum("c")).alias("mean"), F.sum("c").alias("n"))
    return exact.join(bounds, "g").select(C("g").alias(group), "n", "mean", "low", "high")


def bracket_gate(intervals: DataFrame, key: str, candidate: str, reference: str, lift: float = 0.05) -> DataFrame:
    """Whether a candidate group is worth its cost: its mean is higher by ``lift`` and its interval lies above the reference's."""
    c = intervals.filter(C(key) == candidate).select(C("mean").alias("cm"), C("low").alias("cl"))
    r = intervals.filter(C(key) == reference).select(C("mean").alias("rm"), C("high").alias("rh"))
    both = c.crossJoin(r)  # one row each
    return both.select((C("cm") - C("rm")).alias("lift"), ((C("cm") - C("rm") >= lift) & (C("cl") > C("rh"))).alias("passes"))


def stratified(df: DataFrame, stratum: str, key: Sequence[str], n: int, seed: int, least: int = 2) -> DataFrame:
    """A sample of n rows with strata in proportion: at least ``least`` each where there are so many, drawn by hash order.

    Quotas are worked out on the sizes of the strata, a few rows.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(stratum).count().collect()}
    total = sum(sizes.values())
    quota = {s: min(c, max(least, int(n * c / total))) for s, c in sizes.items()} if total else {}
    goal = min(n, total)
    while sum(quota.values()) > goal:
        quota[max(quota, key=lambda s: (quota[s], str(s)))] -= 1
    while sum(quota.values()) < goal:
        quota[min((s for s in quota if quota[s] < sizes[s]), key=lambda s: (quota[s] / sizes[s], str(s)))] += 1
    wanted = df.sparkSession.createDataFrame(list(quota.items()) or [(None, 0)], f"{stratum} string, __quota int")
    rows = df.join(F.broadcast(wanted), stratum).withColumn("__draw", seeded(seed, key)).withColumn("__salt", F.pmod(F.xxhash64("__draw"), F.lit(SALTS)))
    for by in ([stratum, "__salt"], [stratum]):  # the first of each part, then the first of these
        rows = rows.withColumn("__place", F.row_number().over(Window.partitionBy(*by).orderBy("__draw", *key))).filter("__place <= __quota")
    return rows.drop("__place", "__quota", "__draw", "__salt")


def overhead_pct(clean: Column, instrumented: Column) -> Column:
    return F.try_divide(100 * (clean - instrumented), clean)
