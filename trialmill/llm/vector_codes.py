"""Product codes of vectors: short codes of parts, whose nearest entries are found by Orchard search.

A vector's components become integers (floor of SCALE times the component) and are cut into equal consecutive
parts. Every part position has a codebook; it starts as that part of the vectors with the smallest ids and is moved to
the means of its parts for some rounds. All arithmetic is on integers, so runs agree to the last digit.

Orchard search: each entry of a codebook keeps the list of all entries in order of their distance from it. A
search holds the best entry so far, walks down its list, marks what it visits, jumps to the list of an entry that is nearer (or as near,
with a lower index), and stops where the list goes beyond twice the present distance: by the triangle inequality no
entry farther down can be as near. A batch of parts is searched at once, in numpy.

A round is one pass over the stored integers: each task gives sums for its rows (parts x entries, whatever its size), which meet in a
grouped sum; the driver sees the codebooks alone.

Defined cases: vectors that are null or hold null or non-finite components are dropped. The length is that of most vectors (the larger one
on a tie), which must be a multiple of the number of parts; vectors of another length keep their row, with null code and error. Rows
with a null id come last in the order of ids; rows that share an id are told apart by their components. With fewer vectors than entries
the codebooks are shorter. Components are cut off at +-2^27 (+-32768 before scaling; less for parts of over 16 components), where squares
would not fit into 64 bits. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialmill.llm.common import joined_by_key, shared_dir, store

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows that one search takes at once.
BATCH = 1 << 14


class Orchard:
    """A codebook with the list of neighbours of every entry."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        gaps = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(-1)
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, 1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row of x (the lowest on ties) and the squared distance."""
        n, k = len(x), len(self.entries)
        best = np.zeros(n, np.int64)
        dist = ((x - self.entries[0]) ** 2).sum(1)
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        at = np.zeros(n, np.int64)  # place in the list of the best entry
        live = np.arange(n)
        while True:
            live = live[at[live] < k]
            b, p = best[live], at[live]
            near = self.gaps[b, p] <= 4 * dist[live]
            live, b, p = live[near], b[near], p[near]
            if not len(live):
                return best, dist
            entry = self.order[b, p]
            at[live] += 1
            new = ~seen[live, entry]
            rows, entry = live[new], entry[new]
            seen[rows, entry] = True
            d = ((x[rows] - self.entries[entry]) ** 2).sum(1)
            better = (d < dist[rows]) | ((d == dist[rows]) & (entry < best[rows]))
            rows = rows[better]
            best[rows], dist[rows], at[rows] = entry[better], d[better], 0


def _limit(width: int) -> int:
    """The largest component for which four times a squared distance fits into 63 bits."""
    return 1 << min(27, int((58 - math.log2(max(width, 1))) / 2))


def _integers(parts: int, scale: int):
    """Batches of (id, label, vector) as (id, label, ints, size), without vectors that are not all finite numbers."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            rows = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
            vectors = vectors.take(pa.array(rows))
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            x = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
            finite = np.ones(len(rows), bool)
            finite[np.repeat(np.arange(len(rows)), sizes)[~np.isfinite(x)]] = False
            x = x[np.repeat(finite, sizes)]
            rows, sizes = rows[finite], sizes[finite]
            limits = np.array([_limit(int(s) // parts) for s in sizes], np.float64) if len(set(sizes.tolist())) > 1 else np.full(len(sizes), _limit(int(sizes[0]) // parts) if len(sizes) else 1, np.float64)
            bound = np.repeat(limits, sizes)
            ints = np.clip(np.floor(np.clip(x, -bound, bound) * scale), -bound, bound).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ints))
            keep = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), lists, pa.array(sizes.astype(np.int32))], ["id", "label", "ints", "size"])

    return each


def _parts(lists: pa.Array, length: int, parts: int) -> np.ndarray:
    """(part, row, component) of lists that are all of one length."""
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return x.reshape(-1, parts, length // parts).transpose(1, 0, 2)


def _sums(books: np.ndarray, length: int):
    """For each entry of each part: how many parts of the task's rows it is nearest to, and their sum."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k, width = books.shape
        orchards = [Orchard(b) for b in books]
        counts, totals = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                for p, x in enumerate(_parts(batch.column(0).slice(start, BATCH), length, parts)):
                    found, _ = orchards[p].nearest(x)
                    counts[p] += np.bincount(found, minlength=k)
                    np.add.at(totals[p], found, x)
        used = np.flatnonzero(counts.ravel())
        flat = totals.reshape(-1, width)[used]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, max(width, 1)).astype(np.int32)[: len(used) + 1]), pa.array(flat.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts.ravel()[used]), lists], ["slot", "n", "sums"])

    return each


def _codes(books: np.ndarray, length: int):
    """(id, label, code, error) of each row; null where the vector is of another length."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, width = books.shape[0], books.shape[2]
        orchards = [Orchard(b) for b in books] if books.size else []
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                some = batch.slice(start, BATCH)
                fits = (some.column(3).to_numpy(zero_copy_only=False) == length) & (width > 0)
                at = np.flatnonzero(fits)
                codes, errors = np.full(len(fits), None, object), np.zeros(len(fits), np.int64)
                if len(at):
                    names = np.zeros((len(at), parts), np.int64)
                    for p, x in enumerate(_parts(some.column(2).take(pa.array(at)), length, parts)):
                        names[:, p], dist = orchards[p].nearest(x)
                        errors[at] += dist
                    codes[at] = ["".join(f"{e:02x}" for e in row) for row in names.tolist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(codes, pa.string()), pa.array(errors, mask=~fits)], ["id", "label", "code", "error"])

    return each


def train(kept: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, components of a part) of stored integer vectors (id, ints)."""
    width = length // parts
    seeds = kept.select("id", "ints").orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).collect()
    books = np.array([r["ints"] for r in seeds], np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = kept.select("ints").mapInArrow(_sums(books, length), "slot int, n long, sums array<long>")
        cells = sums.select("slot", "n", F.posexplode("sums").alias("at", "v")).groupBy("slot", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
        for r in cells.collect():  # parts x entries x width numbers at most
            books[r["slot"] // len(seeds), r["slot"] % len(seeds), r["at"]] = r["v"] // r["n"]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error, label_error) of every vector that is kept, and the codebooks.

    ``code`` is the index of each part's entry in two hex digits, so ``entries`` is 256 at most. ``label_error``
    is the error of all rows of the label together.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    path = shared_dir(vectors.sparkSession)
    columns = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    kinds = {f.name: f.dataType.simpleString() for f in columns.schema}
    kept = store(columns.mapInArrow(_integers(parts, scale), f"id {kinds['id']}, label {kinds['label']}, ints array<int>, size int"), f"{path}/ints")
    most = kept.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    length = most["size"] if most else 0
    if length % parts:
        raise ValueError(f"vectors of {length} components have no {parts} equal parts")
    books = train(kept.filter(F.col("size") == length), length, parts, entries, rounds) if length else np.zeros((parts, 0, 0), np.int64)
    coded = store(kept.mapInArrow(_codes(books, length), f"id {kinds['id']}, label {kinds['label']}, code string, error long"), f"{path}/codes")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("__n"))
    return joined_by_key(coded, store(totals, f"{path}/labels"), "label", "__n"), books
