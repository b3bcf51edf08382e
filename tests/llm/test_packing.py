import random

import pandas as pd

from trialmill.llm import packing

SCHEMA = "doc_id long, text string, source string, id int, bin_id string"


def brute(sizes, sources, clusters, capacity):
    """Best-fit decreasing by looking at every bin each time."""
    bins, where = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= sizes[i] and sources[i] not in b["s"] and clusters[i] not in b["c"] and b["left"] > 0]
        k = min(fits)[1] if fits else len(bins)
        if k == len(bins):
            bins.append({"left": capacity, "s": set(), "c": set()})
        bins[k]["left"] -= sizes[i]
        bins[k]["s"].add(sources[i])
        bins[k]["c"].add(clusters[i])
        where.append((i, k))
    return sorted(where)


def test_block_against_brute_force():
    random.seed(3)
    for _ in range(20):
        n = random.randrange(1, 120)
        rows = pd.DataFrame({"id": range(n), "size": [random.randrange(0, 100) for _ in range(n)], "source": [random.choice([None, "a", "b", "c", "d"]) for _ in range(n)], "cluster": [str(random.randrange(n)) for _ in range(n)]})
        got = packing.pack_block(rows, 100)
        want = brute(rows["size"].tolist(), rows["source"].tolist(), rows["cluster"].tolist(), 100)
        assert sorted(zip(got["id"], got["bin_id"], strict=True)) == want


def test_invariants(spark):
    random.seed(5)
    rows = [(i, "w " * random.choice([0, 1, 5, 30, 99, 100, 250]), random.choice(["a", "b", None]), 1, "x") for i in range(500)] + [(7, "same text", "a", 1, "x")] * 3 + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = packing.pack(df, capacity=100, block=64).toPandas()
    words = sorted(len((r[1] or "").split()) for r in rows)
    assert out.groupby("bin_id")["size"].sum().max() <= 100
    assert (out.groupby("bin_id")["size"].sum() == out.groupby("bin_id")["bin_used"].first()).all()
    assert (out.groupby("bin_id").size() == out.groupby("bin_id")["bin_docs"].first()).all()
    assert out["size"].sum() == sum(words)
    source = {r[0]: r[2] for r in rows}
    for _, part in out[out["id"].notna()].groupby("bin_id"):
        names = [str(source[i]) for i in part["id"]]
        assert len(names) == len(set(names))
    long = out[out["id"] == next(r[0] for r in rows if len((r[1] or "").split()) == 250)]
    assert sorted(long["size"]) == [50, 100, 100] and sorted(long["word_from"]) == [0, 100, 200] and set(long["n_pieces"]) == {3}


def test_bin_texts_hold_all_words(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{i}_{k}" for k in range(i * 3 % 40)), f"s{i % 5}", 1, "x") for i in range(60)], SCHEMA)
    packed = packing.pack(df, capacity=32, block=16)
    words = [w for r in packing.bin_texts(df, packed).collect() for w in r["words"]]
    assert sorted(words) == sorted(f"w{i}_{k}" for i in range(60) for k in range(i * 3 % 40))


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_reruns_and_partitions_in_any_order_agree(spark):
    random.seed(8)
    rows = [(i, "w " * random.randrange(1, 60), random.choice("abcdefgh"), 1, "x") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = packing.pack(df.coalesce(1), capacity=100, block=10_000)
    turned = packing.pack(df.coalesce(1).sortWithinPartitions("text"), capacity=100, block=10_000)
    key = lambda out: sorted(map(tuple, out.collect()))
    assert key(one) == key(one) == key(turned)
