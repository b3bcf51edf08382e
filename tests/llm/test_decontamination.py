import re

import numpy as np
import pytest

from trialmill.llm import decontamination as dc

DOCS, ITEMS = "doc_id long, text string, spans string, items int", "item_id long, text string, row string"


def words(text):
    return re.findall(dc.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    wins = {}
    for item, text in items:
        w = words(text)
        for k in range(max(len(w) - window, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add("null" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for length in {len(x) for x in wins}:
            for k in range(len(w) - length + 1):
                got = wins.get(tuple(w[k : k + length]))
                if got:
                    found |= got
                    hit |= set(range(k, k + length))
        out.append((str(i), len(w), sorted(hit), sorted(found)))
    return sorted(out)


def found(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], DOCS).selectExpr("doc_id AS row", "text", "items")
    got = dc.find(d, spark.createDataFrame([(*r, "y") for r in items], ITEMS), **options).collect()
    return sorted((str(r["row"]), r["n_words"], [k for s in r["spans"] for k in range(s["start"], s["end"])], list(r["items"])) for r in got)


def corpus(seed, n=60, vocabulary=3):
    rng = np.random.default_rng(seed)
    text = lambda k: " ".join(f"w{x}" for x in rng.integers(0, vocabulary, k))
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " .,;! "), (n + 2, docs[3][1]), (None, docs[4][1]), (n + 3, docs[3][1]), (n + 4, text(4000))]
    items = [(i, text(int(rng.integers(1, 20)))) for i in range(12)] + [(3, docs[5][1]), (90, docs[5][1]), (91, None), (92, "..."), (None, text(8)), (93, docs[-1][1][:900])]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"shard_words": 50}, {"window": 3}, {"block_words": 300}, {"block_words": 300, "shard_words": 40, "window": 4}])
def test_against_brute_force(spark, options):
    docs, items = corpus(len(options) + options.get("window", 0))
    assert found(spark, docs, items, **options) == brute(docs, items, options.get("window", 10))


def test_words_case_and_other_letters(spark):
    docs = [(1, "x ÉTÉ It's\x00a--B2 Ünïcode 漢字 end"), (2, "étÉ it s a b2"), (3, "ÉTÉ it s a b2 Ünïcode")]
    items = [(7, "ÉTÉ IT'S A b2"), (8, "漢字")]
    assert found(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = corpus(1)
    assert found(spark, [], items) == []
    assert found(spark, docs, []) == brute(docs, []) and found(spark, docs, [(1, None)]) == brute(docs, [])


def test_long_items_keep_every_window(spark, monkeypatch):
    monkeypatch.setattr(dc, "ITEM_WORDS", 7)
    docs, items = corpus(5, vocabulary=2)
    assert found(spark, docs, items) == brute(docs, items)


def test_remove_cuts_spans_and_keeps_other_columns(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, f"Before: {item.upper()}, eleven... (After) é", "s", 5), (2, "clean Text", None, None), (3, None, "n", 0), (4, f"{item}. {item} eleven", "t", 1)]
    d = spark.createDataFrame(docs, DOCS)
    b = spark.createDataFrame([(9, item + " eleven", "r")], ITEMS)
    got = {r["doc_id"]: r for r in dc.remove(d, b).collect()}
    assert got[1]["text"] == "Before: ... (After) é" and got[1]["contamination"]["items"] == ["9"] and got[1]["contamination"]["n_hit"] == 11
    assert [got[k]["text"] for k in (2, 3, 4)] == ["clean Text", None, ""] and [got[k]["spans"] for k in (1, 2, 3, 4)] == ["s", None, "n", "t"]
    with pytest.raises(ValueError, match="already"):
        dc.remove(d, b, into="items")


def test_the_index_counts_and_locates_every_phrase():
    rng = np.random.default_rng(0)
    for _ in range(60):
        docs = [rng.integers(0, 4, rng.integers(0, 30)) for _ in range(rng.integers(1, 6))]
        docs += [docs[0]] * 3
        index = dc.FMIndex(docs, 4)
        for _ in range(20):
            phrase = rng.integers(0, 4, rng.integers(1, 6))
            row = np.zeros((1, 5), np.int64)
            row[0, 5 - len(phrase) :] = phrase
            which, low, high = index.search(row, np.array([len(phrase)]))
            got = sorted(index.locate(np.arange(low[0], high[0])).tolist()) if len(which) else []
            assert got == sorted(int(s) + k for d, s in zip(docs, index.starts, strict=True) for k in range(len(d) - len(phrase) + 1) if (d[k : k + len(phrase)] == phrase).all())


def test_suffixes_come_in_order():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 300):
        s = np.append(rng.integers(1, 3, n - 1), 0)
        assert dc.suffix_array(s).tolist() == sorted(range(n), key=lambda k: s[k:].tolist())


def test_texts_are_split_whole(monkeypatch):
    monkeypatch.setattr(dc, "_CUT", 5)
    text = "aB cdefghijkl  é mn, " * 3
    assert [w.decode() for part in dc.words_of(text.encode()) for w in part] == words(text)
