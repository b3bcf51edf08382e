import zlib

from trialmill.llm import sharding

SCHEMA = "doc_id long, text string, shard int, size int"


def brute(rows, n, overhead=16):
    sized = sorted(((r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + overhead) for r in rows))
    total, at, slots, out = sum(s[3] for s in sized), 0, {}, []
    for known, i, crc, size in sized:
        shard = min(n - 1, (2 * at + size) * n // (2 * total))
        slots[shard] = slots.get(shard, -1) + 1
        out.append((str(i if known else None), size, crc, shard, slots[shard]))
        at += size
    return sorted(out)


def found(spark, rows, n):
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, SCHEMA), n)
    return sorted((str(r["id"]), r["size"], r["crc"], r["shard"], r["slot"]) for r in out.collect())


def test_against_brute_force(spark):
    rows = [(i, "é" * (i * 7 % 50), 1, 2) for i in range(300)] + [(300, None, None, None), (301, "", 1, 1), (302, "x" * 3000, 1, 1), (5, "", 1, 1), (None, "q", 1, 1)]
    assert found(spark, rows, 7) == brute(rows, 7)


def test_more_shards_than_rows_and_empty_table(spark):
    assert found(spark, [(1, "a", 1, 1), (2, "b", 1, 1)], 40) == brute([(1, "a", 1, 1), (2, "b", 1, 1)], 40)
    assert found(spark, [], 40) == []


def test_balance(spark):
    rows = [(i, "x" * (i * 31 % 97), 1, 1) for i in range(2000)]
    size = {}
    for _, s, _, shard, _ in found(spark, rows, 10):
        size[shard] = size.get(shard, 0) + s
    mean = sum(size.values()) / 10
    assert max(abs(s - mean) for s in size.values()) <= 97 + 16


def test_written_shards_are_in_slot_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(50)], "doc_id long, text string")
    sharding.write_shards(docs, sharding.shard_by_bytes(docs, 3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and {r[0] for r in back.select("shard").distinct().collect()} == {0, 1, 2}
