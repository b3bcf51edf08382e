"""Multi-criteria selection over small tables of subjects (one row each, after aggregation)."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialmill.functions.derive import UNSAFE
from trialmill.operators.ranks import beside, position_ranks, running_total, uniform
from trialmill.sources.staging import stored

C = F.col
#: Random draws of one task, and draws and subjects that one row holds when they are scored: so many scores are worked out at once.
DRAW_BLOCK, DRAW_PACK, SUBJECT_PACK, SCORES = 1000, 5000, 1 << 14, 1 << 17
#: Up to so many rows, checked by a count, points meet each other in one join; more go by cells of a grid.
FEW_POINTS = 5000
#: Cells of the grid at most; points of a cell that are first reduced in parts of about this size.
MAX_CELLS, PART_ROWS = 4096, 50_000
#: Axes of these types are compared as doubles without loss; others by their positions.
_EXACT = ("tinyint", "smallint", "int", "float", "double", "boolean", "date")


def front(df: DataFrame, up: Sequence[str] = (), down: Sequence[str] = ()) -> DataFrame:
    """Rows that no other row dominates: none is as good on every axis and better on one. Equal best rows all stay.

    Rows that lack an axis are dropped. Few points meet each other in a theta anti-join. Of many, see ``skyline``.
    """
    axes = [*up, *down]
    known = df.dropna(subset=axes)
    if known.limit(FEW_POINTS + 1).count() <= FEW_POINTS:
        a, b = known.alias("a"), known.select(*axes).distinct().alias("b")
        as_good, better = F.lit(True), F.lit(False)
        for c in up:
            as_good, better = as_good & (C(f"b.{c}") >= C(f"a.{c}")), better | (C(f"b.{c}") > C(f"a.{c}"))
        for c in down:
            as_good, better = as_good & (C(f"b.{c}") <= C(f"a.{c}")), better | (C(f"b.{c}") < C(f"a.{c}"))
        return a.join(b, as_good & better, "left_anti")
    kinds = dict(known.dtypes)
    for k, c in enumerate(axes):
        if kinds[c] in _EXACT:
            number = C(c).cast("int").cast("double") if kinds[c] == "boolean" else F.datediff(C(c), F.lit("1970-01-01").cast("date")).cast("double") if kinds[c] == "date" else F.nanvl(C(c).cast("double"), F.lit(float("inf")))
            known = known.withColumn(f"__a{k}", number if c in up else -number)
        else:
            places = running_total(known.select(c).distinct(), [], [c], F.lit(1), "__p").select(c, C("__p").cast("double").alias("__p"))
            known = beside(known, places, [c]).withColumn(f"__a{k}", C("__p") if c in up else -C("__p")).drop("__p")
    names = [f"__a{k}" for k in range(len(axes))]
    known = stored(known)
    return known.join(skyline(known.select(*names)), names, "left_semi").select(*df.columns)


def skyline(points: DataFrame) -> DataFrame:
    """Distinct points (doubles, more is better) that none dominates, by cells of a grid over quantiles of the axes.

    A cell is dropped whole if another one is higher on every axis. What is left of a cell's points meets only cells that are as high on
    some axes and higher on the rest: on the axes that are equal, a point must be beaten there, the rest is beaten anyway. For one equal axis
    the greatest value of those cells decides, a number by cell; for more the points of those cells that none in their own cell dominates are
    sent along, to be compared on the equal axes. Cells hold few points where many are dominated; where hardly any is, a cell is about the
    number of points over the cells of one side of the grid, and large cells are first reduced in parts.
    """
    spark, names = points.sparkSession, points.columns
    d = len(names)
    points = stored(points.distinct())
    sides = min(64, max(2, int(MAX_CELLS ** (1 / d) + 1e-9)))
    cuts = points.approxQuantile(names, [k / sides for k in range(1, sides)], 0.002)
    place = [sum(((C(c) > v).cast("int") for v in sorted(set(cut))), F.lit(0)) for c, cut in zip(names, cuts, strict=True)]
    celled = stored(points.withColumn("cell", sum((p * sides**k for k, p in enumerate(place)), F.lit(0))))
    cells = celled.groupBy("cell").agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in names]).limit(sides**d).collect()
    if not cells:
        return points
    ids = np.array([r["cell"] for r in cells])
    at, top = np.stack([ids // sides**k % sides for k in range(d)], 1), np.array([[r[c] for c in names] for r in cells])
    above = lambda k: (at > at[k]).all(1)
    kept = np.array([not above(k).any() for k in range(len(ids))])
    ids, at, top, sizes = ids[kept], at[kept], top[kept], np.array([r["n"] for r in cells])[kept]
    bounds, meets = [], []
    for k in range(len(ids)):
        equal = at == at[k]
        rivals = (at >= at[k]).all(1) & ~equal.all(1)
        one = rivals & (equal.sum(1) == 1)
        bounds.append([int(ids[k]), -(-int(sizes[k]) // PART_ROWS), *[float(top[one & equal[:, j], j].max(initial=-np.inf)) for j in range(d)]])
        meets += [(int(ids[r]), int(ids[k]), int(sum(1 << j for j in range(d) if equal[r, j]))) for r in np.flatnonzero(rivals & (equal.sum(1) > 1))]
    limits = spark.createDataFrame(bounds, "cell int, parts int, " + ", ".join(f"__b{j} double" for j in range(d)))
    free = celled.join(F.broadcast(limits), "cell")  # a row a cell
    for j, c in enumerate(names):
        free = free.filter(C(c) > C(f"__b{j}"))
    schema = "cell int, " + ", ".join(f"{c} double" for c in names)

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.loc[undominated(pdf[names].to_numpy()), ["cell", *names]]

    parts = free.withColumn("part", F.pmod(F.xxhash64(*names), C("parts")).cast("int")).select("cell", "part", *names).groupBy("cell", "part").applyInPandas(own, schema)
    local = stored(parts.groupBy("cell").applyInPandas(own, schema))
    if not meets:
        return local.select(*names)
    pairs = F.broadcast(spark.createDataFrame(meets, "cell int, other int, axes int"))  # pairs of cells, by the grid's size
    others = [f"__r{k}" for k in range(d)]
    sent = local.join(pairs, "cell").select(C("other").alias("cell"), "axes", *[C(c).alias(r) for c, r in zip(names, others, strict=True)])

    def beaten(mine: pd.DataFrame, rivals: pd.DataFrame) -> pd.DataFrame:
        p, keep = mine[names].to_numpy(), np.ones(len(mine), bool)
        for axes, some in rivals.groupby("axes"):
            which = [j for j in range(d) if axes >> j & 1]
            keep &= ~covered(p[:, which], some[others].to_numpy()[:, which])
        return mine.loc[keep, names]

    return local.groupBy("cell").cogroup(sent.groupBy("cell")).applyInPandas(beaten, ", ".join(f"{c} double" for c in names))


def undominated(p: np.ndarray) -> np.ndarray:
    """Which of distinct points no other dominates."""
    n, d = p.shape
    order = np.lexsort([-p[:, k] for k in reversed(range(d))])
    p, keep = p[order], np.ones(n, bool)
    if d == 1:
        keep = p[:, 0] == p[0, 0]
    elif d == 2:
        keep[1:] = p[1:, 1] > np.maximum.accumulate(p[:-1, 1])
    elif d == 3:
        xs, ys = [], []  # a staircase of the last two axes: the second falls as the first rises
        for k, (x, y) in enumerate(p[:, 1:].tolist()):
            i = bisect_left(xs, x)
            if i < len(xs) and ys[i] >= y:
                keep[k] = False
                continue
            j = i + (i < len(xs) and xs[i] == x)
            while i > 0 and ys[i - 1] <= y:
                i -= 1
            xs[i:j], ys[i:j] = [x], [y]
    else:
        best = np.empty((0, d))
        for k in range(0, n, 256):
            some = p[k : k + 256]
            good = ~covered(some, best)
            inner = (some[None, :, :] >= some[:, None, :]).all(2) & (some[None, :, :] > some[:, None, :]).any(2)
            good &= ~inner.any(1)
            keep[k : k + 256], best = good, np.concatenate([best, some[good]])
    out = np.empty(n, bool)
    out[order] = keep
    return out


def covered(p: np.ndarray, rivals: np.ndarray) -> np.ndarray:
    """Which points some rival equals or beats on every axis."""
    if p.shape[1] == 2 and len(rivals):
        order = np.argsort(rivals[:, 0])
        x, best = rivals[order, 0], np.maximum.accumulate(rivals[order, 1][::-1])[::-1]
        i = np.searchsorted(x, p[:, 0], "left")
        return (i < len(x)) & (best[np.minimum(i, len(x) - 1)] >= p[:, 1])
    out = np.zeros(len(p), bool)
    for k in range(0, len(rivals), 1024):
        left = np.flatnonzero(~out)
        for m in range(0, len(left), 1024):
            some = left[m : m + 1024]
            out[some] = (rivals[None, k : k + 1024] >= p[some][:, None]).all(2).any(1)
    return out


def constrained_pick(df: DataFrame, quality: str, safety: str, cost: str, name: str, tolerance: float = 0.05) -> DataFrame:
    """Within ``tolerance`` of the best quality: the safest, then the cheapest, then by name."""
    best = df.agg(F.max(quality).alias("__best"))
    near = df.join(F.broadcast(best)).filter(C(quality) >= C("__best") - tolerance).drop("__best")
    return near.orderBy(F.desc(safety), cost, name).limit(1)


def normalised(df: DataFrame, up: Sequence[str] = (), down: Sequence[str] = ()) -> DataFrame:
    """Adds n_<axis> in [0, 1], 1 being best; a constant axis gives 0.5."""
    axes = [*up, *down]
    bounds = df.agg(*[f(c).alias(f"__{f.__name__}_{c}") for c in axes for f in (F.min, F.max)])
    wide = df.join(F.broadcast(bounds))  # one row
    for c in axes:
        low, high = C(f"__min_{c}"), C(f"__max_{c}")
        x = F.try_divide(C(c) - low if c in up else high - C(c), high - low)
        wide = wide.withColumn(f"n_{c}", F.when(high == low, 0.5).otherwise(x))
    return wide.drop(*bounds.columns)


def balance(df: DataFrame, up: Sequence[str] = (), down: Sequence[str] = ()) -> DataFrame:
    """Mean of the normalised axes."""
    scaled = normalised(df, up, down)
    total = sum((C(f"n_{c}") for c in (*up, *down)), F.lit(0.0))
    return scaled.withColumn("balance", total / len([*up, *down]))


def floor_curve(df: DataFrame, quality: str, safety: str, step: int = 5) -> DataFrame:
    """For safety floors 0, 5, ..., 100 percent: survivors and their best quality."""
    bars = df.sparkSession.range(0, 101, step).select((C("id") / 100).alias("bar"))
    joined = F.broadcast(bars).join(df, C(safety) >= C("bar"), "left")
    return joined.groupBy("bar").agg(F.count(safety).alias("survivors"), F.max(quality).alias("best_quality"))


def topsis(df: DataFrame, up: Sequence[str] = (), down: Sequence[str] = ()) -> DataFrame:
    """Closeness to the ideal point on normalised axes with equal weights."""
    scaled = normalised(df, up, down)
    axes = [C(f"n_{c}") for c in (*up, *down)]
    to_best = F.sqrt(sum(((1 - a) * (1 - a) for a in axes), F.lit(0.0)))
    to_worst = F.sqrt(sum((a * a for a in axes), F.lit(0.0)))
    return scaled.withColumn("closeness", to_worst / (to_best + to_worst))


def weighted_winners(df: DataFrame, vectors: dict[str, Sequence[float]], axes: Sequence[str], name: str) -> DataFrame:
    """The winner of each named weight vector over the given columns; ties by name."""
    rows = [(n, *map(float, w)) for n, w in vectors.items()]
    weights = df.sparkSession.createDataFrame(rows, ["weights", *[f"__w{k}" for k in range(len(axes))]])
    score = sum((C(f"__w{k}") * C(c) for k, c in enumerate(axes)), F.lit(0.0))
    scored = df.join(F.broadcast(weights)).withColumn("score", score)
    return scored.groupBy("weights").agg(F.min(F.struct((-C("score")).alias("s"), C(name).alias("n"))).alias("b")).select("weights", C("b.n").alias(name), (-C("b.s")).alias("score"))


def acceptability(df: DataFrame, axes: Sequence[str], name: str, draws: int = 100_000, seed: int = 0, every: bool = False) -> DataFrame:
    """Share of random weight vectors (Dirichlet) under which each subject scores best; first by name on ties.

    Weights are positive, so only subjects that no other dominates can win: only these are scored, unless ``every`` is set. A subject
    that lacks an axis wins nowhere. Vectors come from counters (``uniform``), so any engine draws the same. Draws and subjects meet
    as packs, and a pair of packs gives one row a draw, its best subject: scores never become rows.
    """
    known = stored(df.select(name, *axes))
    names = [f"__w{k}" for k in range(len(axes))]
    raw = df.sparkSession.range(0, draws, 1, -(-draws // DRAW_BLOCK)).select("id", *[(-F.log(1 - uniform(seed, F.lit(k), C("id")))).alias(w) for k, w in enumerate(names)])
    total = sum((C(w) for w in names), F.lit(0.0))
    shares = raw.select("id", *[(C(w) / total).alias(w) for w in names])
    scored = stored((known if every else front(known, axes)).dropna(subset=axes))
    packs = max(1, -(-scored.count() // SUBJECT_PACK))
    drawn = _packed(shares, F.floor(C("id") / DRAW_PACK), "id", names)
    subjects = _packed(scored.select(C(name).alias("__n"), *axes), F.pmod(F.xxhash64("__n"), F.lit(packs)), "__n", axes)
    pairs = subjects.crossJoin(drawn).repartition(packs * -(-draws // DRAW_PACK))

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.to_dict("records"):
                points, weights = [row[c] for c in axes], [row[w] for w in names]
                step, at, top = max(1, SCORES // len(points[0])), [], []
                for k in range(0, len(row["id"]), step):
                    score = np.zeros((len(weights[0][k : k + step]), len(points[0])))
                    for p, w in zip(points, weights, strict=True):
                        score += w[k : k + step, None] * p
                    at.append(score.argmax(1))  # the first by name
                    top.append(np.take_along_axis(score, at[-1][:, None], 1)[:, 0])
                yield pd.DataFrame({"id": row["id"], "s": np.concatenate(top), "n": row["__n"][np.concatenate(at)]})

    kind = df.select(C(name).alias("n")).schema["n"].dataType.simpleString()
    found = pairs.mapInPandas(best, f"id long, s double, n {kind}")
    wins = stored(found.groupBy("id").agg(F.min(F.struct((-C("s")).alias("s"), "n")).alias("b")).groupBy(C("b.n").alias(name)).agg(F.count("*").alias("wins")))
    return known.select(name).join(wins, name, "left").select(name, (F.coalesce("wins", F.lit(0)) / draws).alias("acceptability"))


def _packed(df: DataFrame, pack: Column, key: str, values: Sequence[str]) -> DataFrame:
    """One row a pack: its keys in order and their values, an array a column."""
    rows = df.groupBy(pack.alias("__pack")).agg(F.sort_array(F.collect_list(F.struct(key, *values))).alias("__rows"))
    return rows.select(*[C("__rows").getField(c).alias(c) for c in (key, *values)])


def inversion(df: DataFrame, size: str, safety: str, name: str, large: Column, small: Column) -> DataFrame:
    """One row: the largest of one kind and the safest of the other, and whether the small one is safer."""
    a = df.filter(large).agg(F.min(F.struct((-C(size)).alias("s"), C(name).alias("n"), C(safety).alias("v"))).alias("l"))
    b = df.filter(small).agg(F.min(F.struct((-C(safety)).alias("s"), C(name).alias("n"), C(safety).alias("v"))).alias("r"))
    return a.crossJoin(b).select(C("l.n").alias("largest"), C("r.n").alias("safest_small"), (C("r.v") > C("l.v")).alias("inverted"))


def swot(report: DataFrame, name: Sequence[str] = ("model", "memory")) -> DataFrame:
    """Four texts for each subject: tertiles on four axes, absolute gates, opportunities and threats."""
    quality = F.coalesce(C("judge_pct"), 100 * C("det_mean"))
    df = position_ranks(stored(report), {"__pq": quality, "__ps": C("median_tok_s"), "__pe": -C("wh_per_correct"), "__pc": C("pass_consistency")}, name)
    high = lambda p, text: F.when(C(p) >= 2.0 / 3, text)
    low = lambda p, text: F.when(C(p) <= 1.0 / 3, text)
    join = lambda *xs: F.array_join(F.array_compact(F.array(*xs)), "; ")
    dash = lambda x: F.when(x == "", "-").otherwise(x)
    rejected = C("verdict") == UNSAFE
    slow = C("median_tok_s") < 8
    strengths = join(high("__pq", "quality"), high("__ps", "fast"), high("__pe", "efficient"), high("__pc", "consistent"))
    weak = join(
        low("__pq", "quality"), low("__ps", "slow"), low("__pe", "costly"), low("__pc", "flaky"), F.when(slow, "sub-interactive"), F.when(rejected, "endorses destructive action")
    )
    chances = join(F.when(C("paired_lift") > 0.05, "gains from context"), F.when(slow & (C("median_tok_s") >= 5), "interactive on faster hardware"), F.lit("context axis pending"))
    threats = join(F.when(rejected, "safety: endorses destructive recovery"), F.lit("licence and provenance to be verified"))
    return df.select(*name, "bracket", dash(strengths).alias("strengths"), dash(weak).alias("weaknesses"), chances.alias("opportunities"), threats.alias("threats"))
