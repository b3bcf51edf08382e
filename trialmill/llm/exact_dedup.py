"""Exact de-duplication over a log-structured merge index of digests.

* memtable: a part of the corpus (one of MEMTABLES, by a hash of the id). Its (digest, id) pairs are combined by digest, as they are
  dealt out: the identifier that stays and the number of members.
* flush: a memtable becomes a run, bucketed by digest and sorted in each bucket, with a bounded bit filter of its digests.
* probe: a new run's digests are sought in the tables before it, of which only those are read whose filter lets a digest pass. Digests that
  are found, or that the run itself holds twice, are hits.
* compaction: runs are tables of level 0; once a level has ``fan_out`` of them, they merge into one of the next level, bucket
  by bucket: a merge of sorted files without a shuffle, in which the smallest (or largest) identifier stays.
* verification: a hit is only a candidate. Texts that pass a bounded bit filter of the hits are grouped by digest *and text*, so Spark
  compares their bytes; map-side combine leaves one row for each distinct text and task, however large the group.

Only digests, identifiers and the distinct texts that pass the filter of hits are shuffled. (That filter has 8 MB; beyond
some 10 million repeated digests it lets more and more texts pass that have no copy. They cost a
shuffle, and change nothing.)

Defined cases: a null text counts as empty; texts are compared as they are, whatever their length. A null id loses to
any other; a group with null ids only keeps null. Rows with equal id and text are one document:
``find_duplicates`` marks all of them alike, ``deduplicate`` leaves one. An empty table gives an
empty result. Other columns, whatever their names, are not read by ``find_duplicates`` and come
back unchanged from ``deduplicate``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialmill.llm.common import bit_filter, passing, shared_dir, store, without


#: Memtables that a corpus is flushed in.
MEMTABLES = 4


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@dataclass
class Table:
    """A compacted table (digest, keep_id, n), bucketed and sorted by digest."""

    rows: DataFrame
    path: str

    @cached_property
    def filter(self) -> DataFrame:
        """The bit filter of its digests, made when it is first asked for."""
        return store(bit_filter(self.rows, ["digest"], self.rows.count()), f"{self.path}-filter")


class MergeIndex:
    """Digests of a growing corpus, in a folder that all executors share.

    ``flush`` and ``compact`` may follow each other in any order, any number of times.
    """

    def __init__(self, path: str, keep: str = "min", fan_out: int = 4) -> None:
        if keep not in ("min", "max"):
            raise ValueError(f"keep must be min or max, not {keep}")
        if fan_out < 2:
            raise ValueError("fan_out must be 2 or more")
        self.path, self.keep, self.fan_out = path, keep, fan_out
        self.pairs: list[DataFrame] = []  # (id, digest) of every memtable
        self.fresh: list[Table] = []  # runs that no level has yet
        self.hits: list[DataFrame] = []  # digests with more than one member, by run
        self.levels: list[list[Table]] = []
        self.made = 0

    def _stays(self, column: str) -> Column:
        return F.min(column) if self.keep == "min" else F.max(column)

    def flush(self, rows: DataFrame) -> None:
        """A memtable of stored ``rows`` (id, digest) becomes a run, and its hits are noted."""
        run = self._write(rows.groupBy("digest").agg(self._stays("id").alias("keep_id"), F.count("*").alias("n")))
        twice = run.rows.filter("n > 1").select("digest")
        earlier = self.lookup(run.rows.select("digest"), fresh=True)
        self.hits.append(store(twice.unionByName(earlier.select("digest")), f"{run.path}-hits"))
        self.pairs.append(rows.select("id", "digest"))
        self.fresh.append(run)

    def entries(self) -> DataFrame:
        """All flushed (id, digest) pairs."""
        return reduce(DataFrame.unionByName, self.pairs)

    def _write(self, rows: DataFrame) -> Table:
        """A new table in as many buckets as there are shuffle partitions. Its files stay; the catalogue keeps no entry."""
        spark, path = rows.sparkSession, f"{self.path}/table{self.made}"
        self.made += 1
        name, buckets = f"trialmill_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows.write.bucketBy(buckets, "digest").sortBy("digest").option("path", path).saveAsTable(name)
        table = Table(spark.table(name), path)
        spark.sql(f"DROP TABLE {name}")
        return table

    def _merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Two tables as one; both are bucketed and sorted alike."""
        better = F.least if self.keep == "min" else F.greatest
        zero = F.lit(0).cast("long")
        return a.alias("a").join(b.alias("b"), F.col("a.digest") == F.col("b.digest"), "full").select(
            F.coalesce("a.digest", "b.digest").alias("digest"), better("a.keep_id", "b.keep_id").alias("keep_id"),
            (F.coalesce("a.n", zero) + F.coalesce("b.n", zero)).alias("n"),
        )

    def compact(self) -> None:
        """Fresh runs go to level 0, and full levels merge into the next."""
        for run in self.fresh:
            table, level = run, 0
            while True:
                if len(self.levels) == level:
                    self.levels.append([])
                self.levels[level].append(table)
                if len(self.levels[level]) < self.fan_out:
                    break
                full, self.levels[level] = self.levels[level], []
                table = full[0]
                for other in full[1:]:  # written in between: a merge's result is bucketed only as a table
                    table = self._write(self._merged(table.rows, other.rows))
                level += 1
        self.fresh = []

    def tables(self) -> list[Table]:
        return [t for level in self.levels for t in level]

    def all(self) -> DataFrame:
        """Every compacted digest (digest, keep_id, n), over all levels."""
        first, *rest = [t.rows for t in self.tables()]
        return reduce(self._merged, rest, first)

    def lookup(self, digests: DataFrame, fresh: bool = False) -> DataFrame:
        """(digest, keep_id, n) of those of ``digests`` (digest) that are in compacted tables, and in fresh runs if asked."""
        sought = digests.select("digest").distinct()
        found = [passing(sought, ["digest"], t.filter).join(t.rows, "digest") for t in self.tables() + (self.fresh if fresh else [])]
        if not found:
            return sought.select("digest", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("n")).limit(0)
        return reduce(DataFrame.unionByName, found).groupBy("digest").agg(self._stays("keep_id").alias("keep_id"), F.sum("n").alias("n"))

    def verify(self, texts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Compare the bytes of all hits among ``texts`` (id, digest, text), the rows of all compacted runs.

        Returns groups (digest, keep_id, n) for digests that stand for one text each, and, only if
        digests collide, a table (id, digest, keep_id, n) of the members of colliding ones.
        """
        path = f"{self.path}/verified-{uuid.uuid4().hex}"
        level = self.all()
        hits = store(reduce(DataFrame.unionByName, self.hits).distinct(), f"{path}/hits")
        n_hits = hits.count()
        single = level.filter("n = 1")
        if not n_hits:
            return single, None
        filt = store(bit_filter(hits, ["digest"], n_hits), f"{path}/filter")
        suspects = passing(texts, ["digest"], filt)
        by_text = suspects.groupBy("digest", "text").agg(self._stays("id").alias("keep_id"), F.count("*").alias("n"))
        by_digest = by_text.groupBy("digest").agg(
            F.count("*").alias("variants"), self._stays("keep_id").alias("keep_id"), F.sum("n").alias("n")
        )
        checked = store(by_digest.filter("n > 1"), f"{path}/checked")
        groups = single.unionByName(checked.filter("variants = 1").drop("variants"))
        collided = checked.filter("variants > 1").select("digest")
        if collided.isEmpty():
            return groups, None
        rows = suspects.join(collided, "digest", "left_semi")
        apart = rows.groupBy("digest", "text").agg(self._stays("id").alias("keep_id"), F.count("*").alias("n"))
        members = rows.join(apart, ["digest", "text"]).select("id", "digest", "keep_id", "n")
        return groups, store(members, f"{path}/collided")


def _index(docs: DataFrame, id_col: str, text_col: str, keep: str, digest: Callable[[Column], Column]):
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), digest(text).alias("digest"), text.alias("text"))
    index = MergeIndex(shared_dir(docs.sparkSession), keep)
    part = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(MEMTABLES)).cast("int")
    pairs = store(texts.select("id", "digest", part.alias("part")), f"{index.path}/pairs")
    for k in range(MEMTABLES):
        index.flush(pairs.filter(F.col("part") == k))
        index.compact()
    groups, collided = index.verify(texts)
    return index, groups, collided


def find_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """For each row of ``docs``: id, digest, keep_id (the row of equal text that stays), n, kept.

    Entries meet groups in a join that AQE splits where a digest is hot: each group is one row.
    """
    index, groups, collided = _index(docs, id_col, text_col, keep, digest)
    out = index.entries().join(groups, "digest").select("id", "digest", "keep_id", "n")
    if collided is not None:
        out = out.unionByName(collided)
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each distinct text.

    Only rows that may be dropped, or may be there twice, are shuffled.
    """
    path = shared_dir(docs.sparkSession)
    found = store(find_duplicates(docs, id_col, text_col, keep, digest), f"{path}/found")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), digest(text).alias("digest"))
    dropped = store(found.filter(~F.col("kept")).select("id", "digest").distinct(), f"{path}/ids")
    kept = without(rows, dropped, ["id", "digest"], f"{path}/first")
    twice = found.filter("kept").groupBy("id", "digest").count().filter("count > 1").select("id", "digest")
    twice = store(twice, f"{path}/twice")
    if twice.isEmpty():
        return kept.select("row.*")
    once = without(kept, twice, ["id", "digest"], f"{path}/second")
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.digest") == F.col("b.digest"))
    again = kept.alias("a").join(twice.alias("b"), same, "left_semi")
    one = again.groupBy("id", "digest").agg(F.min_by("row", F.to_json("row")).alias("row"))  # the least, as JSON, stays
    return once.select("row.*").unionByName(one.select("row.*"))
