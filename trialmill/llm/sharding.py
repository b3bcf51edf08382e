"""Contiguous, byte-balanced shards from global prefix sums.

Rows are ordered by (id, CRC-32, size) with a range partitioning of narrow rows. Each partition
gives one total; a running sum over those totals (one row for each partition) gives every
partition its offset, and a running sum inside the partition gives every row its own. A row goes
to the shard in whose equal slice of all bytes its middle byte lies, so shards are contiguous
and each differs from the target by less than one row at either end.

Defined cases: a null text has no bytes; size counts the overhead too. Null ids come first. Rows
that agree in id, CRC-32 and size are interchangeable. An empty table gives an empty result;
there may be fewer rows than shards, and then some shards are empty. Of a very long text only its size and checksum move.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialmill.llm.common import shared_dir, store


def shard_by_bytes(docs: DataFrame, n_shards: int, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of ``docs``: id, size, crc, shard, slot (gapless from 0 within its shard)."""
    path = shared_dir(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
    )
    ranged = store(narrow.repartitionByRange("id", "crc", "size").withColumn("part", F.spark_partition_id()), f"{path}/ranged")

    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    zero = F.lit(0).cast("long")
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(earlier), zero).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(earlier), zero).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("bytes_total"),
    )
    inside = Window.partitionBy("part").orderBy("id", "crc", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = ranged.withColumn("bytes_to", F.sum("size").over(inside)).withColumn("rows_to", F.row_number().over(Window.partitionBy("part").orderBy("id", "crc", "size")))
    # as many rows as there are partitions
    placed = running.join(F.broadcast(offsets), "part")
    middle_x2 = 2 * (F.col("bytes_before") + F.col("bytes_to")) - F.col("size")
    shard = F.least(F.lit(n_shards - 1), F.expr(f"({n_shards} * __m2) div (2 * bytes_total)")).cast("int")
    placed = placed.withColumn("__m2", middle_x2).select(
        "id", "size", "crc", shard.alias("shard"), (F.col("rows_before") + F.col("rows_to") - 1).alias("row")
    )
    placed = store(placed, f"{path}/placed")
    starts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # n_shards rows
    return placed.join(F.broadcast(starts), "shard").select("id", "size", "crc", "shard", (F.col("row") - F.col("first_row")).alias("slot"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write ``docs`` (unique ids) as one folder for each shard, rows in slot order."""
    place = assigned.select(F.col("id").alias(id_col), "shard", "slot")
    joined = docs.join(place, id_col)
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
