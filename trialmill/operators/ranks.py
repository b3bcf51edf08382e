"""Order statistics, ranks and picks by order. Every tie has an explicit breaker."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from hashlib import md5
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialmill.sources.staging import stored

C = F.col
#: Buckets of a round of ``at_places``, the rows of a range that are ordered at once in the end, and the most rounds before that.
BUCKETS, FEW_ROWS, MAX_ROUNDS = 1024, 10_000, 12
#: Up to so many ranges that are looked for, by count, are broadcast.
BROADCAST_RANGES = 100_000


def beside(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys of which null equals null; the right side's keys go."""
    named = right
    for k in keys:
        named = named.withColumnRenamed(k, f"__r_{k}")
    same = reduce(and_, [C(k).eqNullSafe(C(f"__r_{k}")) for k in keys], F.lit(True))
    return left.join(named, same, how).drop(*[f"__r_{k}" for k in keys])


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[str], weight: Column, into: str) -> DataFrame:
    """Adds the sum of ``weight`` over the rows of the group before this one; ``order`` must leave no ties.

    Rows are dealt out by ranges of group and order, so neither a hot group nor the whole table is one task: a window sums up inside
    a range, and the totals of a group's earlier ranges (one row a range and group) are added.
    """
    ranged = stored(stored(df.withColumn("__weight", weight)).repartitionByRange(*group, *order).withColumn("__range", F.spark_partition_id()))
    before = lambda keys, by, what: F.coalesce(F.sum(what).over(Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = ranged.withColumn("__inside", before(["__range", *group], order, "__weight"))
    totals = ranged.groupBy(*group, "__range").agg(F.sum("__weight").alias("__total"))
    offsets = totals.select(*group, "__range", before([F.lit(0), *group], ["__range"], "__total").alias("__offset"))
    joined = beside(inside, offsets, [*group, "__range"])
    return joined.withColumn(into, C("__inside") + C("__offset")).drop("__inside", "__offset", "__range", "__weight")


def order_statistic(df: DataFrame, group: Sequence[str], value: str | Column, into: str, place: Callable[[Column], Column]) -> DataFrame:
    """For each group the value at ``place`` (a number from 0, from the count of values) of its sorted non-null values.

    Values are counted first, then counts are summed in order: no group is gathered into one row. A group
    without values, or a place outside, gives null.
    """
    value = C(value) if isinstance(value, str) else value
    cells = df.groupBy(*group, value.alias("__v")).agg(F.count(value).alias("__n"))
    w = Window.partitionBy(*group).orderBy("__v")
    upto = F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = place(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    placed = cells.withColumn("__upto", upto).withColumn("__at", at)
    hit = (C("__upto") > C("__at")) & (C("__upto") - C("__n") <= C("__at"))
    return placed.groupBy(*group).agg(F.max(F.when(hit, C("__v"))).alias(into))


def upper_median(df: DataFrame, group: Sequence[str], value: str | Column, into: str) -> DataFrame:
    """The value at n div 2."""
    return order_statistic(df, group, value, into, lambda n: F.floor(n / 2))


def floor_index(df: DataFrame, group: Sequence[str], value: str | Column, p: float, into: str) -> DataFrame:
    """The value at floor(p * (n - 1))."""
    return order_statistic(df, group, value, into, lambda n: F.floor(F.lit(p) * (n - 1)))


def nearest_rank(df: DataFrame, group: Sequence[str], value: str | Column, percent: float, into: str) -> DataFrame:
    """The value at percent / 100 * (n - 1), rounded half to even."""
    return order_statistic(df, group, value, into, lambda n: F.bround(F.lit(percent / 100) * (n - 1)))


def at_places(df: DataFrame, group: Sequence[str], value: str | Column, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(group, n, one column a place): as ``order_statistic``, for groups of any size, of which none is sorted or gathered in one task.

    Rounds of histograms: the range that a place lies in is cut into BUCKETS parts, one pass counts each part's rows with their least
    and greatest value, and the part that holds the place is the next range; a round leaves a few rows for each group. Ranges of few rows are ordered at the end.
    """
    value = C(value) if isinstance(value, str) else value
    rows = stored(df.select(*group, value.alias("__v")))
    sizes = stored(rows.groupBy(*group).agg(F.count("__v").alias("n"), F.min("__v").alias("__low"), F.max("__v").alias("__high")))
    at = F.explode(F.array(*[F.struct(F.lit(name).alias("__name"), place(C("n")).cast("long").alias("__at")) for name, place in places.items()]))
    asked = sizes.withColumn("__p", at).select(*group, "__p.*", "__low", "__high", C("n").alias("__left")).filter((C("__at") >= 0) & (C("__at") < C("__left")))
    asked, found = stored(asked), None
    keys = [*group, "__name"]
    upto = lambda: F.sum("__c").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def inside(open_: DataFrame, n: int) -> DataFrame:
        ranges = F.broadcast(open_) if n <= BROADCAST_RANGES else open_
        return beside(rows.filter("__v IS NOT NULL"), ranges, group).filter(C("__v").between(C("__low"), C("__high")))

    number = lambda c: F.greatest(F.least(F.nanvl(C(c).cast("double"), F.lit(float("inf"))), F.lit(1.7e308)), F.lit(-1.7e308)) / 2
    for turn in range(MAX_ROUNDS + 1):
        done = asked.filter("__low = __high").select(*keys, C("__low").alias("__v"))
        found = done if found is None else found.unionByName(done)
        open_ = asked.filter("NOT __low = __high")
        few = open_.filter(C("__left") <= FEW_ROWS) if turn < MAX_ROUNDS else open_
        many = open_.filter(C("__left") > FEW_ROWS)
        n_few, n_many = open_.agg(F.count_if(C("__left") <= FEW_ROWS), F.count_if(C("__left") > FEW_ROWS)).first()
        if turn == MAX_ROUNDS:
            n_few, n_many = n_few + n_many, 0
        if n_few:
            cells = inside(few, n_few).groupBy(*keys, C("__v").alias("__b"), "__at").agg(F.count("*").alias("__c")).withColumn("__upto", upto())
            found = found.unionByName(stored(cells.filter((C("__upto") > C("__at")) & (C("__upto") - C("__c") <= C("__at"))).select(*keys, C("__b").alias("__v"))))
        if not n_many:
            break
        share = F.try_divide(number("__v") - number("__low"), number("__high") - number("__low"))
        bucket = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BUCKETS), F.lit(BUCKETS - 1))
        parts = inside(many, n_many).groupBy(*keys, "__at", bucket.alias("__b")).agg(F.count("*").alias("__c"), F.min("__v").alias("__low"), F.max("__v").alias("__high")).withColumn("__upto", upto())
        hit = parts.filter((C("__upto") > C("__at")) & (C("__upto") - C("__c") <= C("__at")))
        asked = stored(hit.select(*keys, (C("__at") - C("__upto") + C("__c")).alias("__at"), "__low", "__high", C("__c").alias("__left")))
    got = found.groupBy(*group).agg(*[F.max(F.when(C("__name") == name, C("__v"))).alias(name) for name in places])
    return beside(sizes.drop("__low", "__high"), got, group, "left")


def linear_quantiles(df: DataFrame, group: Sequence[str], value: str | Column, shares: dict[str, float]) -> DataFrame:
    """(group, one column a share): the quantile at share * (n - 1), linear between the two values beside it; null without values."""
    places = {}
    for name, p in shares.items():
        places |= {f"{name}__0": lambda n, p=p: F.floor(F.lit(p) * (n - 1)), f"{name}__1": lambda n, p=p: F.ceil(F.lit(p) * (n - 1))}
    found = at_places(df, group, value, places)
    low = lambda name: C(f"{name}__0").cast("double")
    part = lambda p: F.lit(p) * (C("n") - 1) - F.floor(F.lit(p) * (C("n") - 1))
    return found.select(*group, *[(low(name) + part(p) * (C(f"{name}__1").cast("double") - low(name))).alias(name) for name, p in shares.items()])


def position_rank(df: DataFrame, value: str, order: Sequence[str], into: str, partition: Sequence[str] = ()) -> DataFrame:
    """Position among the non-null values over n - 1; ties by ``order``; 0.5 where there is one value."""
    ranked = running_total(df.withColumn("__known", C(value).isNotNull()), [*partition, "__known"], [value, *order], F.lit(1), "__i")
    sizes = df.groupBy(*partition).agg(F.count(value).alias("__n"))
    both = beside(ranked, sizes, partition)
    return both.withColumn(into, F.when(C("__known"), F.when(C("__n") < 2, 0.5).otherwise(C("__i") / (C("__n") - 1)))).drop("__i", "__n", "__known")


def position_ranks(df: DataFrame, values: dict[str, Column], key: Sequence[str]) -> DataFrame:
    """Adds one ``position_rank`` for each name of ``values``, ties by ``key``, which must tell rows apart; all in one pass."""
    axes = F.explode(F.array(*[F.struct(F.lit(name).alias("__axis"), v.cast("double").alias("__value")) for name, v in values.items()]))
    long = position_rank(df.select(*key, axes.alias("a")).select(*key, "a.*"), "__value", key, "__rank", ["__axis"])
    return beside(df, long.groupBy(*key).agg(*[F.max(F.when(C("__axis") == name, C("__rank"))).alias(name) for name in values]), key)


def value_ranks(df: DataFrame, value: str, into: str, partition: Sequence[str] = ()) -> DataFrame:
    """(partition, value, into): the fractional rank of each distinct value, null first; ties share the mean of their places.

    Only distinct values are sorted.
    """
    cells = df.groupBy(*partition, value).agg(F.count("*").alias("__n"))
    return running_total(cells, partition, [value], C("__n"), "__before").select(*partition, value, (C("__before") + 1 + (C("__n") - 1) / 2).alias(into))


def average_rank(df: DataFrame, value: str, into: str, partition: Sequence[str] = ()) -> DataFrame:
    """Fractional ranks of rows: those of their values."""
    keys = [*partition, value]
    ranks = value_ranks(df, value, into, partition).select(*[C(k).alias(f"__k{i}") for i, k in enumerate(keys)], into)
    same = reduce(and_, [C(k).eqNullSafe(C(f"__k{i}")) for i, k in enumerate(keys)])
    return df.join(ranks, same).drop(*[f"__k{i}" for i in range(len(keys))])


def pick(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order, with all columns, by a partial aggregate on the row as a struct.

    Unlike a window, it combines on the map side, so a hot key never fills one task.
    """
    flags, fields = [], []
    for k, c in enumerate(order):
        fields.append(c.alias(f"__o{k}"))
        flags.append(f"__o{k}")
    rest = [c for c in df.columns if c not in key]
    best = F.min(F.struct(*fields, *[F.col(f"`{c}`") for c in rest]))
    return df.groupBy(*key).agg(best.alias("__best")).select(*key, *[F.col("__best").getField(c).alias(c) for c in rest])


def keep_best(df: DataFrame, key: Sequence[str], score: str, seq: str) -> DataFrame:
    """The row of the highest score (null counts as 0); the earliest on a tie."""
    return pick(df, key, [-F.coalesce(F.col(score).cast("double"), F.lit(0.0)), F.col(seq)])


def last_wins(df: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    return pick(df, key, [-F.col(seq)])


def first_wins(df: DataFrame, key: Sequence[str], *order: str) -> DataFrame:
    return pick(df, key, [F.col(c) for c in order])


def step_between(df: DataFrame, value: str, order: str, into: str) -> DataFrame:
    """Difference to the row before. For small tables: one task orders them."""
    return df.withColumn(into, F.col(value) - F.lag(value).over(Window.orderBy(order)))


def seeded(seed: int, key: Sequence[str]) -> Column:
    """A hash of seed and key to draw or order by, the same in every run and engine: md5 of both, joined by colons, as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[C(k).cast("string") for k in key]).cast("binary"))


def uniform(seed: int, *index: Column) -> Column:
    """A number in [0, 1) for each index (columns, joined by colons as texts): the first 52 bits of an md5, so that any engine draws the same."""
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in index])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def uniforms(stem: str, numbers: Iterable[int]) -> np.ndarray:
    """As ``uniform``, inside a task: for each last index, the text of seed and the other indexes being given."""
    head = f"{stem}:".encode()
    digests = b"".join([md5(head + b"%d" % k).digest() for k in numbers])
    return (np.frombuffer(digests, ">u8")[::2] >> 12) / float(1 << 52)


def seeded_order(df: DataFrame, key: Sequence[str], seed: int, into: str = "draw") -> DataFrame:
    """A shuffle that each run repeats, by the column ``into``."""
    return df.withColumn(into, seeded(seed, key)).orderBy(into, *key)


def tail(df: DataFrame, n: int, seq: str) -> DataFrame:
    """The last n rows, in their order."""
    return df.orderBy(F.desc(seq)).limit(n).orderBy(seq)
