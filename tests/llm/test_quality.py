import random
import re

import pytest

from trialmill.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    where = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + j for at in where.values() if len(at) > 1 for i in at for j in range(8)}
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)


def texts():
    rng = random.Random(4)
    vocabulary = ["a", "bé", "c#", "$d", "Eff", "g|h"]
    out = [None, "", " \n\t", "x" * 30, "a b\n\na b\n a b\na b", "one word", "long " * 3000]
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))]
        out.append(rng.choice([" ", "\n", "  "]).join(base * rng.randrange(1, 4) + [str(rng.random()) for _ in range(rng.randrange(40))]))
    return out


def test_base_figures_against_brute_force():
    for t in texts():
        p = quality.Page(t)
        assert (len(p.words), p.word_chars, p.n_symbols, p.n_dup_lines, p.n_repeat_words, p.base_failed) == brute(t)


def test_cascade_verdict_does_not_depend_on_order(spark):
    rows = [(i, t, 1, True) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept boolean")
    key = lambda out: sorted((r["doc_id"], *r["q"]) for r in out.collect())
    got = key(quality.cascade(df, into="q"))
    assert got == key(quality.cascade(df, rules=quality.RULES[::-1], into="q"))
    for i, *figures, failed, kept in got:
        assert (*figures, failed) == brute(rows[i][1])
        assert kept == (not failed and not any(r.rejects(quality.Page(rows[i][1])) for r in quality.RULES))
    assert quality.cascade(df.limit(0), into="q").count() == 0


def test_rules_that_reject_more_for_less_come_first(spark):
    slow = quality.Rule("slow", lambda p: sum(i * i for i in range(3000)) < 0)
    busy = quality.Rule("busy", lambda p: "7" in p.text)
    df = spark.range(300).selectExpr("id AS doc_id", "concat(repeat(concat('word', cast(id as string), ' '), 1), array_join(transform(sequence(1, 30), i -> concat('w', cast(i * id as string))), ' ')) AS text")
    assert [r.name for r in quality.order_rules(df, [slow, busy])] == ["busy", "slow"]


def test_order_follows_what_is_left():
    # rule 0 rejects most, rule 1 nearly only the same rows, rule 2 others: after 0, 2 is worth more
    assert quality.best_order([1.0, 1.0, 1.0], {0b011: 50, 0b001: 10, 0b010: 1, 0b100: 20, 0: 900}) == [0, 2, 1]
    assert quality.best_order([100.0, 1.0], {0b01: 50, 0b10: 1}) == [1, 0]
    assert quality.best_order([1.0, 1.0, 1.0], {}) == [0, 1, 2]


def test_base_figures_cost_a_rule_nothing(spark):
    cheap = quality.Rule("cheap", lambda p: p.n_repeat_words > 10**9 or "7" in p.text)  # the costliest figure, but it is there
    dear = quality.Rule("dear", lambda p: sum(i * i for i in range(3000)) < 0 or "7" in p.text)
    df = spark.range(200).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 40), i -> concat('w', cast(i * id as string))), ' ') AS text")
    assert [r.name for r in quality.order_rules(df, [dear, cheap])] == ["cheap", "dear"]


def test_only_letters_shout():
    numerals = " ".join(["ⅣⅤⅥⅦ", "ab"] * 20)
    assert not quality.RULES[3].rejects(quality.Page(numerals))
    assert quality.RULES[3].rejects(quality.Page("ABCD ÉÀ " * 20))


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b", "x"), (1, "a b", "x"), (1, "a b", "x"), (None, None, None)], "doc_id long, text string, quality string")
    with pytest.raises(ValueError, match="quality"):
        quality.cascade(df)
    out = quality.cascade(df, into="found")
    assert out.columns == [*df.columns, "found"] and sorted(r["found"]["n_words"] for r in out.collect()) == [0, 2, 2, 2]


def test_clean_prose_is_kept():
    prose = " ".join(f"Word{i} means something, but not much." for i in range(60))
    assert not any(r.rejects(quality.Page(prose)) for r in quality.RULES)
    assert any(r.rejects(quality.Page(" ".join(f"W{i}***" for i in range(60)))) for r in quality.RULES)
