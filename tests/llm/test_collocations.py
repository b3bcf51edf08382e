import re
from collections import Counter

import numpy as np
import pytest

from trialmill.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, rank int, a string"


def brute(rows, least=10, share=50, top=2000):
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        c = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in c.items():
            if any(len(q) == 3 and p in (q[:2], q[1:]) and len(p) == 2 and 100 * b >= share * a for q, b in c.items()):
                continue
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = co.mine(df, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


def corpus(seed, n=80, vocabulary=9):
    rng = np.random.default_rng(seed)
    words = ["The", "of", "é", "É", "\x01", "a\x02", "x-y", "#", "zz", "q", "\x00n", "漢字"][:vocabulary]
    ends = [" ", "  ", "\t", " ", " ", ", ", ".", "\n", "\r\n", " ! "]
    text = lambda k: "".join(words[min(int(rng.zipf(1.5)) - 1, vocabulary - 1)] + ends[int(rng.integers(0, len(ends)))] for _ in range(k))
    rows = [(i, text(int(rng.integers(0, 60))), ["en", "de", None, "und", ""][i % 5]) for i in range(n)]
    return [*rows, (n, None, "en"), (n + 1, "", "fr"), (None, text(20), "en"), (3, text(3000), "en"), *([(5, "fresh new phrase of it", "xx")] * 11)]


@pytest.mark.parametrize("options", [{}, {"top": 3}, {"least": 2, "share": 90}, {"capacity": 40, "burst": 3, "held": 5}, {"capacity": 8, "burst": 1, "held": 0}])
def test_against_brute_force(spark, options):
    rows = corpus(len(options) + options.get("capacity", 0))
    limits = {k: v for k, v in options.items() if k in ("top", "least", "share")}
    assert found(spark, rows, **options) == brute(rows, **limits)


def test_many_known_phrases_hot_pairs_and_many_parts(spark, monkeypatch):
    rows = corpus(9, vocabulary=12)
    want = brute(rows)
    monkeypatch.setattr(co, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(co, "PART_BYTES", 64)
    monkeypatch.setattr(co, "CHUNK", 50)
    monkeypatch.setattr(co, "BLOCK", 3)
    import trialmill.llm.common as common

    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(common, "HOT_KEY", 2)
    assert found(spark, rows, capacity=60) == want


def test_empty_table_and_texts_without_words(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, None), (2, " ,. ", "en")] * 20) == []


def test_exact_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    df = spark.createDataFrame([(big, big + 7, big * 5)], "a long, l long, r long")
    number = lambda c, d: co.C(c).cast(f"decimal({d},0)")
    df = df.select((number("a", 14) * number("a", 14) * co.F.lit(1_000_000).cast("decimal(7,0)")).alias("above"), (number("l", 18) * number("r", 18)).alias("below"))
    assert df.selectExpr("above div below").first()[0] == 1_000_000 * big * big // ((big + 7) * big * 5)


def test_the_trie_counts_bursts_and_spills_whole_subtrees():
    rng = np.random.default_rng(4)
    trie, want, spilled = co.HatTrie(burst=3), Counter(), Counter()
    for turn in range(31):
        ids = rng.integers(0, 90, 200)
        for size in (1, 2, 3):
            trie.add(*co.distinct(ids, size))
            for k in range(200 - size + 1):
                if (ids[k : k + size] > 0).all():
                    w = [*ids[k : k + size].tolist(), 0, 0]
                    want[w[0] << 2 * co.WORD_BITS | w[1] << co.WORD_BITS | w[2]] += 1
        assert trie.nodes and all(len(b) <= 3 or p[0] == len(co._SHIFT) - 1 for p, b in trie.boxes.items()) and trie.size == sum(map(len, trie.boxes.values()))
        goal = trie.size // 2 if turn < 30 else 0
        phrases, n = trie.cut(goal)
        assert trie.size <= goal and not any(p >> co._SHIFT[d] == at for p in phrases.tolist() for d, at in trie.boxes)
        for p, c in zip(phrases.tolist(), n.tolist(), strict=True):
            spilled[p] += c
    assert spilled == want and trie.size == 0


def test_waiting_phrases_are_added_up_in_order():
    runs = [(np.array([1, 5, 9]), np.array([1, 2, 3])), (np.zeros(0, np.int64), np.zeros(0, np.int64)), (np.array([5, 7]), np.array([4, 1]))]
    phrases, n = co.added_up(runs)
    assert phrases.tolist() == [1, 5, 7, 9] and n.tolist() == [1, 6, 1, 3]
    box = co.Container()
    for _ in range(co.SETTLE + 2):
        box.put(np.array([3]), np.array([2]))
    box.settle()
    assert box.phrases.tolist() == [3] and box.n.tolist() == [2 * (co.SETTLE + 2)]
