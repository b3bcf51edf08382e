import random
import re

import numpy as np
import pytest

from trialmill.llm import jaccard_join as jj

SCHEMA = "doc_id long, text string, n_shingles int, component_id string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                up[y] = x
    return sorted((i, len(s), root(i)) for (i, _), s in zip(rows, sets, strict=True))


def corpus(n, families, seed=1, edits=(0, 1, 2, 5)):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 5, 6, 20, 60, 150]))] for _ in range(families)]
    rows = [(900001, None), (900002, ""), (900003, " \n"), (900004, "Hello"), (900005, "hello"), (900006, "a b c d"), (900007, "A b\tc d")]
    for i in range(n):
        t = list(rng.choice(bases))
        for _ in range(rng.choice(edits)):
            t[rng.randrange(len(t))] = rng.choice(words)
        if rng.random() < 0.2:
            t += passage
        if rng.random() < 0.1:
            t = t + t
        rows.append((i, " ".join(t)))
    rng.shuffle(rows)
    return rows


def found(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted((r["id"], r["n_shingles"], r["component"]) for r in jj.components(df, **kw).collect())


def test_against_brute_force(spark):
    rows = corpus(250, 25)
    assert found(spark, rows) == brute(rows)


def test_large_clusters_are_joined_in_blocks(spark):
    rows = corpus(160, 2, seed=5, edits=(0, 1, 2, 3, 4, 6))
    assert found(spark, rows, max_cluster=12) == brute(rows)


def test_clusters_are_bounded_by_shingles_too(spark):
    rows = corpus(120, 2, seed=6, edits=(0, 1, 2, 3, 4, 6))
    assert found(spark, rows, max_words=300) == brute(rows)


def test_a_large_cluster_without_links_keeps_its_few(spark, monkeypatch):
    monkeypatch.setattr(jj, "FREQUENT_AT", 10**9)  # nothing is known to be frequent: a passage of all makes one cluster
    rng, passage = random.Random(12), [f"p{i}" for i in range(60)]
    rows = []
    for i in range(1500):
        own = [f"u{i}x{j}" for j in range(rng.choice([25, 60, 150, 400]))]
        rows.append((i, " ".join(own + passage)))
        if i % 50 == 0:
            rows.append((5000 + i, " ".join(own + passage + ["tail"])))
        if i % 75 == 0:
            rows.append((9000 + i, " ".join(passage + own[: len(own) * 9 // 10])))
    got = found(spark, rows, max_group=40, max_cluster=64)
    sets = {i: shingle_set(t) for i, t in rows}
    where = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    shared = {}
    for ids in where.values():
        if len(ids) < 20:  # pairs that share the passage alone are no links
            for a in ids:
                for b in ids:
                    if a < b:
                        shared[a, b] = shared.get((a, b), 0) + 1
    up = {i: i for i in sets}
    root = lambda x: x if up[x] == x else root(up[x])
    for a, b in sorted(shared):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    assert got == sorted((i, len(s), root(i)) for i, s in sets.items())
    assert sum(i != c for i, _, c in got) >= 30


def test_copies_cost_nothing_and_share_a_component(spark):
    rows = [(i, "one two three four five six seven") for i in range(300)] + [(1000, "ONE two three four five six seven"), (1001, "one two three four five six eight")]
    assert found(spark, rows) == brute(rows)


def test_hot_classes_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(jj, "HOT_CLASS", 20)
    rows = [(i, "one two three four five six seven") for i in range(60)] + [(100 + i, f"x{i} two three four five six seven eight") for i in range(30)] + [(None, "one two three four five six seven")]
    got = [r for r in found_any(spark, rows)]
    assert sum(c == 0 for _, _, c in got) == 60 and sum(c is None for _, _, c in got) == 1 and len(got) == 91


def found_any(spark, rows):
    return [(r["id"], r["n_shingles"], r["component"]) for r in jj.components(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()]


def test_odd_rows(spark):
    assert found(spark, []) == []
    df = spark.createDataFrame([(None, "a b c d e f", 1, "x"), (2, "a b c d e f", 1, "x"), (2, "a b c d e f", 1, "x"), (2, "q r s t u v", 1, "x"), (1, "q r s t u v", 1, "x")], SCHEMA)
    got = sorted((str(r["id"]), r["component"]) for r in jj.components(df).collect())
    assert got == [("1", 1), ("2", 1), ("2", 1), ("2", 1), ("None", None)]


def test_an_id_that_is_a_copy_in_one_class_stands_for_another(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (2, a), (2, b), (3, b + " more")]
    assert found(spark, rows) == brute(rows) == [(1, 36, 1), (2, 36, 1), (2, 36, 1), (3, 37, 1)]


def test_keep_first_keeps_columns(spark):
    rows = corpus(120, 12, seed=8)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    kept = jj.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _, c in brute(rows) if i == c)


def test_components_of_a_long_path(spark, tmp_path):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "u long, v long")
    for small in (0, 10**6):
        got = {r["node"]: r["component"] for r in jj.connected_components(edges, str(tmp_path / f"c{small}"), small=small).collect()}
        assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def test_prefixes_put_the_most_frequent_last():
    tokens = np.array([2, 3, 5, 7, 11, 13, 17, 19, 23, 29], np.uint64)
    frequent, rank = np.array([3, 5, 13], np.uint64), np.array([2, 0, 1], np.int32)
    assert jj.prefix(tokens, frequent, rank).tolist() == [2, 7, 11]
    assert jj.prefix(frequent, frequent, rank, 50).tolist() == [5, 13]


@pytest.mark.parametrize("text", ["", "a", "a b c d e", "Ab\x0bcd\x1fé E", "x" * 5000 + " y"])
def test_shingle_counts(text):
    assert len(jj.shingles(text)) == len(shingle_set(text))
