"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words: space and U+0009 to U+000D. Fixed by the result contracts.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: The bit filter never has more bits than this (8 MB), whatever the input.
MAX_FILTER_BITS = 1 << 26
#: Up to so many narrow rows (a few MB), by count, a side of a join is broadcast; beyond that it is shuffled.
BROADCAST_KEYS = 100_000
BUCKET_BITS = 32768  # bits in one bitmap of bitmap_construct_agg


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's spark.checkpoint.dir; where that is unset and the master local (tests), a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="trialmill-")
    return f"{base.rstrip('/')}/trialmill/{uuid.uuid4().hex}"


def unused(docs: DataFrame, into: str) -> None:
    """Refuse to write a result over a column of the input."""
    if into.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {into} already; give the result another name")


def store(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: lineage ends here, and what follows sees one fixed copy.

    A lost executor costs only the tasks that it ran, since the files are in the shared folder.
    """
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def broadcast_if_few(keys: DataFrame, n: int) -> DataFrame:
    """``keys``, of which there are n, marked for broadcast if they are few."""
    return F.broadcast(keys) if n <= BROADCAST_KEYS else keys


def bit_filter(keys: DataFrame, on: Sequence[str], n_keys: int, bits_per_key: int = 64) -> DataFrame:
    """A one-hash Bloom filter over the columns ``on`` as rows (bucket, bitmap, bits), at most MAX_FILTER_BITS in all.

    It has no false negatives. Beyond the bound it fills up and passes more rows, so callers
    that check the passing rows exactly stay right at any size.
    """
    bits = BUCKET_BITS
    while bits < min(MAX_FILTER_BITS, n_keys * bits_per_key):
        bits *= 2
    slot = F.pmod(F.xxhash64(*on), F.lit(bits))
    return (
        keys.select(slot.alias("slot"))
        .groupBy(F.floor(F.col("slot") / BUCKET_BITS).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.col("slot") % BUCKET_BITS).alias("bitmap"))
        .withColumn("bits", F.lit(bits).cast("long"))
    )


def _bit() -> Column:
    """Whether the bit of __slot is set in the bitmap beside it; null without a bitmap."""
    bit = F.col("__slot") % BUCKET_BITS
    byte = F.conv(F.hex(F.substring(F.col("__bitmap"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int"))) != 0


def _probed(df: DataFrame, on: Sequence[str], filt: DataFrame) -> DataFrame:
    bits = filt.select("bits").first()
    bits = bits[0] if bits else BUCKET_BITS
    maps = filt.select(F.col("bucket").alias("__bucket"), F.col("bitmap").alias("__bitmap"))
    probed = df.withColumn("__slot", F.pmod(F.xxhash64(*on), F.lit(bits))).withColumn("__bucket", F.floor(F.col("__slot") / BUCKET_BITS))
    return probed.join(F.broadcast(maps), "__bucket", "left")


def passing(df: DataFrame, on: Sequence[str], filt: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be in the (stored) filter. It is broadcast: its size is bounded above."""
    return _probed(df, on, filt).filter(_bit()).select(*df.columns)


def without(df: DataFrame, keys: DataFrame, on: Sequence[str], path: str) -> DataFrame:
    """``df`` without the rows whose columns ``on`` equal a row of ``keys`` (null equals null).

    Only rows that may match, by a bounded bit filter, are shuffled to the exact anti-join.
    """
    n = keys.count()
    if not n:
        return df
    filt = store(bit_filter(keys, on, n), f"{path}/dropped")
    probed = _probed(df, on, filt).withColumn("__maybe", F.coalesce(_bit(), F.lit(False)))
    clear = probed.filter(~F.col("__maybe")).select(*df.columns)
    maybe = probed.filter("__maybe").select(*df.columns)
    same = reduce(and_, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on])
    return clear.unionByName(maybe.alias("a").join(broadcast_if_few(keys.select(*on), n).alias("b"), same, "left_anti"))


#: Keys with more rows than this, and than one in MOST_HOT of all, are joined by broadcast: MOST_HOT at most.
HOT_KEY, MOST_HOT = 1000, 10_000


def joined_by_key(rows: DataFrame, keys: DataFrame, on: str, n: str) -> DataFrame:
    """``rows`` with the columns of ``keys``, a stored table of one row a key (null, too) whose column ``n`` says how many rows have it.

    Few keys are broadcast. Of many, only those with very many rows are, whose number is bounded, and the rest is shuffled.
    """
    size = keys.agg(F.count("*").alias("keys"), F.coalesce(F.sum(n), F.lit(0)).alias("rows")).first()
    named = keys.withColumnRenamed(on, "__key")
    with_key = lambda left, right: left.join(right.drop(n), F.col(on).eqNullSafe(F.col("__key"))).drop("__key")
    if size["keys"] <= BROADCAST_KEYS:
        return with_key(rows, F.broadcast(named))
    is_hot = F.col(n) > max(HOT_KEY, -(-size["rows"] // MOST_HOT))
    hot = F.broadcast(named.filter(is_hot))
    rest = rows.join(hot.select("__key"), F.col(on).eqNullSafe(F.col("__key")), "left_anti")
    return with_key(rows, hot).unionByName(with_key(rest, named.filter(~is_hot)))
