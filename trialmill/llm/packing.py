"""Conflict-constrained best-fit packing of documents into bins of a fixed capacity.

A bin holds at most one document of each source and one of each duplicate cluster. Documents
longer than a bin are cut: full pieces fill bins of their own, the rest is packed like any other.
Open bins are kept in the order of what is left in them, each with a bitmap of sources and one of
clusters. For a piece, the search starts at the tightest bin that is large enough and goes on to
its successors until one has no conflict; if none has, a new bin opens.

Spark deals narrow rows (no texts) evenly over partitions, and each task packs them in blocks of
``block`` rows, largest first. Blocks bound the memory and the search, whatever the skew: a hot
source or cluster is spread over all blocks. The waste is at most the open bins of each block.
Inside a task rows are put into the order of a hash first, so blocks do not depend on the order in which
they arrive: a task that is run again packs the same bins.

Defined cases: null ids, sources and texts are values like any other (a null source is one source;
a null or wordless text takes a piece of size 0). Repeated rows are packed each, never two in one bin,
as they share a cluster. Of a very long text only its size moves. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialmill.llm.common import n_words, shared_dir, store

RESULT = "id long, piece int, n_pieces int, word_from long, size long, bin_id long, bin_used long, bin_docs int"
#: bin_id = partition, block, bin: so many bits for the last two.
BLOCK_BITS, BIN_BITS = 18, 24


class Bins:
    """Best-fit bins of one block; sources and clusters are small integers."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.open: list[tuple[int, int]] = []  # (left, bin), ascending
        self.left: list[int] = []
        self.docs: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def add(self, size: int, source: int, cluster: int) -> int:
        """Put a piece into the tightest bin that has room and no conflict; returns the bin."""
        has_source, has_cluster = 1 << source, 1 << cluster
        at, sources, clusters = bisect_left(self.open, (size, -1)), self.sources, self.clusters
        for k in range(at, len(self.open)):
            b = self.open[k][1]
            if not sources[b] & has_source and not clusters[b] & has_cluster:
                del self.open[k]
                break
        else:
            b = self.fresh()
        self.sources[b] |= has_source
        self.clusters[b] |= has_cluster
        self.docs[b] += 1
        self.left[b] -= size
        if self.left[b] > 0:
            insort(self.open, (self.left[b], b))
        return b

    def fresh(self) -> int:
        for values, first in ((self.left, self.capacity), (self.docs, 0), (self.sources, 0), (self.clusters, 0)):
            values.append(first)
        return len(self.left) - 1

    def full(self) -> int:
        """A bin that one full piece takes."""
        b = self.fresh()
        self.left[b], self.docs[b] = 0, 1
        return b


def pack_block(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pack rows (id, size, source, cluster); clusters and sources of any hashable kind."""
    sources = pd.factorize(rows["source"], use_na_sentinel=False)[0].tolist()
    clusters = pd.factorize(rows["cluster"], use_na_sentinel=False)[0].tolist()
    sizes = rows["size"].tolist()
    bins, out = Bins(capacity), []
    rest = [s % capacity if s > capacity else s for s in sizes]
    for i, size in enumerate(sizes):
        full = size // capacity if size > capacity else 0
        pieces = full + (1 if rest[i] or not full else 0)
        for k in range(full):
            out.append((i, k, pieces, k * capacity, capacity, bins.full()))
    order = sorted((i for i in range(len(sizes)) if rest[i] or sizes[i] <= capacity), key=lambda i: (-rest[i], i))
    for i in order:
        full = sizes[i] // capacity if sizes[i] > capacity else 0
        out.append((i, full, full + 1, full * capacity, rest[i], bins.add(rest[i], sources[i], clusters[i])))
    found = pd.DataFrame(out, columns=["row", "piece", "n_pieces", "word_from", "size", "bin_id"])
    ids = rows["id"].array
    found.insert(0, "id", ids.take(found["row"].to_numpy()))
    found["bin_used"] = [capacity - bins.left[b] for b in found["bin_id"]]
    found["bin_docs"] = [bins.docs[b] for b in found["bin_id"]]
    return found.drop(columns="row")


def pack(
    docs: DataFrame, capacity: int = 1024, block: int = 4096, rows_per_task: int = 200_000, cluster: Column | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row for each piece: id, piece, n_pieces, word_from, size, bin_id, bin_used, bin_docs.

    ``cluster`` marks duplicates; by default documents with equal texts are one cluster.
    """
    text = F.col(text_col).cast("string")
    cluster = F.xxhash64(F.coalesce(text, F.lit(""))) if cluster is None else cluster
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), n_words(text).alias("size"), F.col(source_col).cast("string").alias("source"), cluster.cast("string").alias("cluster")
    )

    n_rows = docs.count()
    parallel = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, -(-n_rows // rows_per_task), min(parallel, -(-n_rows // block)))
    share = n_rows / tasks  # of a task, cut into even blocks so that no small one is left over
    block = int(1.02 * share / max(1, -(-share // block))) + 8

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << (BLOCK_BITS + BIN_BITS)
        held, n, blocks = [], 0, 0

        def packed(part: pd.DataFrame, number: int) -> pd.DataFrame:
            found = pack_block(part, capacity)
            found["bin_id"] += first + (number << BIN_BITS)
            return found

        for batch in batches:
            batch = batch.astype({"id": "Int64"})
            held.append(batch)
            n += len(batch)
            while n >= block:
                whole = pd.concat(held, ignore_index=True)
                yield packed(whole.iloc[:block].reset_index(drop=True), blocks)
                blocks += 1
                held, n = [whole.iloc[block:]], n - block
        if n:
            yield packed(pd.concat(held, ignore_index=True), blocks)

    # Dealt in turn: even whatever the keys are.
    mixed = [F.xxhash64("id", "size", "source", "cluster"), "id", "size", "source", "cluster"]
    return rows.repartition(tasks).sortWithinPartitions(*mixed).mapInPandas(run, RESULT)


def bin_texts(docs: DataFrame, packed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed bins themselves: bin_id, words (in the order of id and piece). Ids must be unique.

    ``packed`` is stored first, so that every task sees the same bins.
    """
    packed = store(packed, f"{shared_dir(docs.sparkSession)}/packed")
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    parts = packed.join(docs.select(F.col(id_col).alias("id"), words.alias("all")), "id")
    cut = F.slice("all", (F.col("word_from") + 1).cast("int"), F.col("size").cast("int"))
    sorted_parts = F.array_sort(F.collect_list(F.struct("id", "piece", cut.alias("words"))))
    return parts.groupBy("bin_id").agg(sorted_parts.alias("parts")).select("bin_id", F.flatten(F.col("parts.words")).alias("words"))
