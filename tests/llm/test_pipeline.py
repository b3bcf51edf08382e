import random

import pytest

import corpus_pipeline
from tests.llm.test_jaccard_join import shingle_set
from tests.llm.test_langid import text

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, language int, row string, rep int"


def rows():
    rng, out = random.Random(3), []
    for i in range(240):
        lang = ["aa", "bb", "cc"][i % 3]
        out.append((i, text(lang, rng, rng.randrange(12, 50)), lang, f"s{i % 5}", 1, 1, "r", 1))
    for i in range(30):  # exact copies, then near ones
        out.append((300 + i, out[i][1], out[i][2], out[i][3], 1, 1, "r", 1))
    for i in range(40, 60):
        out.append((400 + i, out[i][1] + " one more", out[i][2], out[i][3], 1, 1, "r", 1))
    return [*out, (600, None, None, None, None, None, None, None), (601, "", "aa", "s1", 0, 1, "r", 1), (602, "12 34 !!", "aa", "s1", 0, 1, "r", 1), (5, out[5][1], "cc", "s0", 1, 1, "r", 1)]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_against_brute_force(spark, tmp_path):
    table = rows()
    spark.createDataFrame(table, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    known = stage("language_id")(spark, docs, str(tmp_path)).cache()
    assert known.columns == docs.columns
    ids = sorted(r["doc_id"] for r in known.collect())
    assert ids == sorted(r[0] for r in table if r[0] not in (600, 601, 602))

    unique = stage("exact_dedup")(spark, known, str(tmp_path)).cache()
    best = {}
    for r in known.collect():
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    assert unique.columns == docs.columns and sorted(r["doc_id"] for r in unique.collect()) == sorted(best.values())

    near = stage("jaccard_join")(spark, unique, str(tmp_path)).cache()
    left = sorted((r["doc_id"], r["text"]) for r in unique.collect())
    sets = [shingle_set(t) for _, t in left]
    up = list(range(len(left)))

    def root(x):
        return x if up[x] == x else root(up[x])

    for a in range(len(left)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    assert near.columns == docs.columns
    assert sorted(r["doc_id"] for r in near.collect()) == [left[k][0] for k in range(len(left)) if root(k) == k]

    mixed = stage("mixing")(spark, near, str(tmp_path)).cache()
    assert mixed.columns == docs.columns
    total = sum(len(r["text"].split()) for r in near.collect())
    assert sum(len(r["text"].split()) for r in mixed.collect()) == pytest.approx(total, rel=0.4)
    assert {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in near.collect()}

    packed = stage("best_fit_packing")(spark, mixed, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in packed) == sorted(r["doc_id"] for r in mixed.collect())
    in_bin = {}
    for r in packed:
        assert r["doc_id"] not in in_bin.setdefault(r["bin_id"], set())
        in_bin[r["bin_id"]].add(r["doc_id"])


def test_run_over_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "mixing", "best_fit_packing"]
