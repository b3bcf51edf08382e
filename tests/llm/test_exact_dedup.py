import hashlib
import random

from pyspark.sql import functions as F

from trialmill.llm import exact_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, kept int"
ROWS = [
    (1, "a", "en", "s", 1, "x", 1), (2, "a", "en", "s", 1, "x", 1), (3, "b", None, None, None, None, None), (4, None, "en", "s", 0, "x", 1), (5, "", "en", "s", 0, "x", 1),
    (6, "A", "en", "s", 1, "x", 1), (7, "long " * 40000, "en", "s", 1, "x", 1), (8, "long " * 40000, "en", "s", 1, "x", 1), (2, "a", "en", "s", 1, "x", 1), (None, "n", "en", "s", 1, "x", 1),
]


def brute(rows, keep):
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    best = {t: keep([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    return sorted((str(r[0]), str(best[r[1] or ""]), len(groups[r[1] or ""]), r[0] == best[r[1] or ""]) for r in rows)


def found(spark, rows, **kw):
    out = exact_dedup.find_duplicates(spark.createDataFrame(rows, SCHEMA), **kw)
    return sorted((str(r["id"]), str(r["keep_id"]), r["n"], r["kept"]) for r in out.collect())


def test_against_brute_force(spark):
    assert found(spark, ROWS, keep="max") == brute(ROWS, max)
    assert found(spark, ROWS, keep="min") == brute(ROWS, min)


def test_digest_is_sha256_of_utf8(spark):
    out = exact_dedup.find_duplicates(spark.createDataFrame([(1, "é", "", "", 1, "", 1)], SCHEMA)).select(F.lower(F.hex("digest"))).first()[0]
    assert out == hashlib.sha256("é".encode()).hexdigest()


def test_colliding_digests_are_told_apart_by_bytes(spark):
    weak = lambda text: F.encode(F.length(text).cast("string"), "utf-8")
    assert found(spark, ROWS, keep="max", digest=weak) == brute(ROWS, max)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_deduplicate_keeps_columns_and_one_row_a_text(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = exact_dedup.deduplicate(docs, keep="max")
    assert out.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(["2", "3", "5", "6", "8", "None"])
    assert exact_dedup.deduplicate(docs.limit(0), keep="max").count() == 0


def test_index_in_rounds_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    index = exact_dedup.MergeIndex(str(tmp_path / "index"), "min", fan_out=2)
    texts, rows = [f"t{k}" for k in range(40)], []
    for r in range(5):
        batch = [(100 * r + i, rng.choice(texts)) for i in range(30)] + [(None, "t0")]
        df = spark.createDataFrame(batch, "id long, text string").select("id", exact_dedup.sha256(F.col("text")).alias("digest"), "text")
        before = {}
        for i, t in rows:
            before.setdefault(t, []).append(i)
        got = {bytes(x["digest"]): (x["keep_id"], x["n"]) for x in index.lookup(df).collect()}
        want = {t: ids for t, ids in before.items() if t in {t for _, t in batch}}
        assert got == {hashlib.sha256(t.encode()).digest(): (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in want.items()}
        index.flush(df)
        if r != 2:  # one compaction takes two runs
            index.compact()
            rows += [x for x in batch]
        else:
            held = batch
        if r == 3:
            rows += held
        index.compact() if r == 4 else None  # nothing fresh: nothing happens
    assert [len(x) for x in index.levels] == [1, 0, 1]  # five runs, merged by twos
    everything = spark.createDataFrame(rows, "id long, text string").select("id", exact_dedup.sha256(F.col("text")).alias("digest"), "text")
    for _ in range(2):
        groups, collided = index.verify(everything)
        assert collided is None
        by_text = {}
        for i, t in rows:
            by_text.setdefault(t, []).append(i)
        assert {bytes(x["digest"]): (x["keep_id"], x["n"]) for x in groups.collect()} == {
            hashlib.sha256(t.encode()).digest(): (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in by_text.items()
        }
    assert index.entries().count() == len(rows)


def test_levels_merge_without_a_shuffle(spark, tmp_path):
    index = exact_dedup.MergeIndex(str(tmp_path / "index"), "max", fan_out=3)
    for k in range(2):
        index.flush(spark.range(50 * k, 50 * k + 100).select("id", exact_dedup.sha256(F.col("id").cast("string")).alias("digest")))
        index.compact()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.all()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert index.all().count() == 150 and index.all().agg(F.sum("n")).first()[0] == 200


def test_the_query_goes_through_runs_probes_and_merges(spark, monkeypatch):
    made, probes = [], []
    write, lookup = exact_dedup.MergeIndex._write, exact_dedup.MergeIndex.lookup

    def written(self, rows):
        made.append(rows._jdf.queryExecution().executedPlan().toString())
        return write(self, rows)

    def looked(self, digests, fresh=False):
        probes.append(len(self.tables() + self.fresh))
        return lookup(self, digests, fresh)

    monkeypatch.setattr(exact_dedup.MergeIndex, "_write", written)
    monkeypatch.setattr(exact_dedup.MergeIndex, "lookup", looked)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(i, f"t{i % 70}") for i in range(200)], "doc_id long, text string")
        found = {r["id"]: (r["keep_id"], r["n"]) for r in exact_dedup.find_duplicates(docs, keep="max").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    same = lambda i: [j for j in range(200) if j % 70 == i % 70]
    assert found == {i: (max(same(i)), len(same(i))) for i in range(200)}
    assert probes == list(range(exact_dedup.MEMTABLES))  # each run is sought in all before it
    runs, merges = made[: exact_dedup.MEMTABLES], made[exact_dedup.MEMTABLES :]
    assert all("Exchange" in r and "Join" not in r for r in runs)
    assert merges and all("SortMergeJoin" in m and "Exchange" not in m for m in merges)  # sorted files, bucket by bucket
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("trialmill")]
