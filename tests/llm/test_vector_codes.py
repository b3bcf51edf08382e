import math
from collections import Counter

import numpy as np
import pytest

from trialmill.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int"


def brute(rows, parts=8, k=16, rounds=6):
    """Everything by plain loops over Python numbers."""
    kept = [(r[0], r[2], [math.floor(4096 * float(np.float32(x))) for x in r[1]]) for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    sizes = Counter(len(c) for _, _, c in kept)
    size = max(sizes, key=lambda s: (sizes[s], s)) if kept else 0
    w = size // parts
    used = sorted((r for r in kept if len(r[2]) == size), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = lambda c, p: c[p * w : (p + 1) * w]
    books = [[cut(c, p) for _, _, c in used[:k]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for _, _, c in used:
                got.setdefault(near(cut(c, p), books[p])[1], []).append(cut(c, p))
            for e, xs in got.items():
                books[p][e] = [sum(v) // len(xs) for v in zip(*xs, strict=True)]
    out, labels = [], {}
    for i, label, c in kept:
        found = [near(cut(c, p), books[p]) for p in range(parts)] if len(c) == size and size else None
        out.append((i, label, "".join(f"{e:02x}" for _, e in found) if found else None, sum(d for d, _ in found) if found else None))
        if found:
            labels[label] = labels.get(label, 0) + out[-1][3]
    return sorted((str(i), code, error, labels.get(label)) for i, label, code, error in out), [x for b in books for y in b for x in y]


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)
    coded, books = vc.encode(df)
    return sorted((str(r["id"]), r["code"], r["error"], r["label_error"]) for r in coded.collect()), books.ravel().tolist()


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 0.1, 16))], None if i % 9 == 0 else i % 4) for i in range(150)]
    rows += [(200 + i, rows[7][1], 1) for i in range(30)]  # repeated vectors
    rows += [(300, None, 1), (301, [None] * 16, 1), (302, [float("nan")] + [0.0] * 15, 1), (303, [float("inf")] * 16, 1), (304, [0.5] * 8, 1), (305, [], 2), (None, [0.1] * 16, 3)]
    assert found(spark, rows) == brute(rows)


def test_ties_and_equal_entries(spark):
    """All parts of a grid are equally far from several entries; the first sixteen hold equal ones."""
    rows = [(i, [float((i + j) % 3) for j in range(8)], 0) for i in range(60)]
    assert found(spark, rows) == brute(rows)


def test_few_rows_none_and_only_bad_ones(spark):
    rows = [(5, [0.25] * 8, 0), (4, [-0.25] * 8, 0)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == ([], [])
    assert found(spark, [(1, None, 0), (2, [], 0)]) == ([("2", None, None, None)], [])


def test_lengths_that_cannot_be_cut(spark):
    with pytest.raises(ValueError, match="equal parts"):
        found(spark, [(1, [0.0] * 9, 0)])


def test_huge_components_are_cut_off(spark):
    rows = [(i, [3e38 if i % 2 else -3e38] * 8, 0) for i in range(20)]
    coded, books = found(spark, rows)
    assert all(e == 0 for _, _, e, _ in coded) and set(books) == {1 << 27, -(1 << 27)}


def test_orchard_search_finds_what_a_full_search_finds():
    rng = np.random.default_rng(1)
    for k, d in ((1, 3), (2, 1), (16, 8), (256, 2)):
        entries, x = rng.integers(-20, 20, (k, d)), rng.integers(-25, 25, (500, d))
        best, dist = vc.Orchard(entries).nearest(x)
        full = ((x[:, None, :] - entries[None]) ** 2).sum(-1)
        assert (best == full.argmin(1)).all() and (dist == full.min(1)).all()


def test_many_labels_are_joined_as_few_are(spark, monkeypatch):
    rows = [(i, [float(i % 7), 1.0, float(i % 5), 0.0, 2.0, float(i % 3), 1.0, 1.0], None if i % 2 else i) for i in range(60)]
    import trialmill.llm.common as common

    want = found(spark, rows)
    monkeypatch.setattr(common, "BROADCAST_KEYS", 2)
    monkeypatch.setattr(common, "HOT_KEY", 5)
    assert found(spark, rows) == want == brute(rows)
