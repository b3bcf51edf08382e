"""Python patterns in Java's syntax: equal verdicts of both engines, and no pattern that fails."""

import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from trialmill.functions import checks as ck
from trialmill.functions.patterns import java_or_literal, literal, to_java

FIXED = [
    r"(?P<n>a)b", r"(?P<n>a|b)(?P=n)", r"(a)(b)\2\1", r"a{,3}b", r"^a{2,}$", r"a{2}?b", r"a*?b", r"a++b", r"a?+b", r"(?>a|ab)c", r"\Ab", r"b\Z", r"b$", r"^b", r"(?m)^b$", r"(?s)a.b", r"a.b", r"(?i)AB", r"(?i:A)b",
    r"(?i)a(?-i:B)c", r"(?x) a  b # c", r"[]a]", r"[^]a]", r"[a\]b]", r"[\w.]+", r"[^\w]", r"[\W_]", r"[^\W_]+", r"[\d\s]", r"[^\D]", r"[\D]", r"[a&&b]", r"[&&]", r"[a-c[]", r"[\[a]", r"[~|-]", r"[a\-z]", r"\bab\b", r"\Bb", r"b\B",
    r"\w+", r"\W", r"\d", r"\D", r"\s", r"\S+$", r"(?a)\w+$", r"(?a)\bb", r"(?<=a)b", r"(?<!a)b", r"a(?=b)", r"a(?!b)", r"(?<=^a)b", r"(?<=\ba)b", r"(?<=[ab]c)a", r"(?<=ab|cc)a", r"(a)?b(?(1)c|d)", r"(?P<q>a)?b(?(q)c)", r"(a)?(?(1)b|c)d",
    r"(a|(b))(?(2)c|d)", r"x*", r"", r"a|", r"|b", r"(|a)b", r"((a)|b)*c", r"(a*)*b", r"(a|b){2,3}?c", r"\x61b", r"a", r"\U00000061", r"\141", r"\0", r"\t", r"\n", r"a\.b", r"a\-b", r"\#", r"\ ", r"é", r"É", r"(?i)É", r"(?i)ß", r"漢", r"\N{LATIN SMALL LETTER A}",
    r"[é-ü]", r"(?i)[A-C]+", r"(?i)[^A-C]", r"$", r"^", r"\Z", r"\A", r"a$b", r"(?m)a$\nb", r"(?!)", r"(?=)", r"(?:)", r"a{0}b", r"a{0,0}", r"{", r"a{", r"a{x}", r"a{1", r"a{,}", r"}", r"]", r"(?s).", r".", r"[^a]", r"(?u)\w", r"\.", r"[.]", r"[$^*+?(){}|]",
    r"(?#comment)ab", r"(?s:.)(?-s:.)", r"(?ms)^.*$", r"(a)\1{2}", r"(?i)(a)\1", r"(?P<a1>x)?(?P<b2>a)(?P=b2)", r"a(?<!ba)", r"(?<!\n)b", r"\r", r"[\r\n]b", r"\v", r"\f", r"[\b]",
]
BROKEN = ["(", "a)", "[", "*a", "a**", "(?P<n>", "(?P<1>a)", "(?P=x)", r"\1", "(?z)", "a{2,1}", "(?<=a*)b", "(?", "[z-a]", "\\", r"\p{L}", "(?(1)a)", r"\Qa", "(?<n>a)", "a{99999999999}"]
PARTS = ["a", "b", "[ab]", "[^b]", ".", r"\w", r"\W", r"\b", "^", "$", "é", r"\d", r"\s", "_", "-", "(?=a)", "(?<=b)", "(?<![^a])"]
TEXTS = ["", "a", "b", "ab", "ba", "aab", "abab", "aaab", "b\n", "a\nb", "\nb", "abc", "bd", "bc", "abd", "aBc", "AB", "é", "É", "aéb", "ß", "SS", "a b", " a", "a_b", "_", "1", "٣", "²", "x²", "a b", "a b", "b\r\n", "a\rb", "]", "[", "-", "{", "a{", "a{x}", "}", "&&", "a&&b", "漢字", "áb", "ÜE", "ccaa", "aca", "\t", "\x00", "a.b", "a-b", "#", "\x1c", "\x85", "𝔸b", "$^", "\x08", "\\", "(?p<n>", "a**", "(", "ſ", "K", "İ", "\x0b"]


def random_patterns(n):
    rng = random.Random(7)

    def one(depth):
        kind = rng.randrange(7) if depth else 0
        if kind <= 2:
            return rng.choice(PARTS)
        if kind == 3:
            return one(depth - 1) + one(depth - 1)
        if kind == 4:
            return f"(?:{one(depth - 1)}|{one(depth - 1)})"
        if kind == 5:
            return f"(?P<g{rng.randrange(10**6)}>{one(depth - 1)})"
        return f"(?:{one(depth - 1)})" + rng.choice(["*", "+", "?", "{,2}", "{2}", "{1,}", "*?", "+?", "{1,2}+"])

    return [one(4) for _ in range(n)]


def verdicts(spark, patterns):
    """(pattern, text) that the JVM finds."""
    grid = spark.createDataFrame([(i, p) for i, p in enumerate(patterns)], "i int, p string").crossJoin(spark.createDataFrame(list(enumerate(TEXTS)), "j int, t string"))
    return {(r["i"], r["j"]) for r in grid.filter(F.regexp_like("t", F.col("p"))).select("i", "j").collect()}


def test_both_engines_agree(spark):
    patterns = FIXED + random_patterns(250)
    assert len(patterns) > 350
    for p in patterns:
        re.compile(p)
    found = verdicts(spark, [to_java(p) for p in patterns])
    wrong = [(p, t, bool(re.search(p, t))) for (i, p), (j, t) in itertools.product(enumerate(patterns), enumerate(TEXTS)) if bool(re.search(p, t)) != ((i, j) in found)]
    assert not wrong, wrong[:10]


@pytest.mark.parametrize("flags", [re.I | re.S, re.I, re.M])
def test_both_engines_agree_under_flags(spark, flags):
    patterns = FIXED + random_patterns(60)
    found = verdicts(spark, [to_java(p, flags) for p in patterns])
    wrong = [(p, t) for (i, p), (j, t) in itertools.product(enumerate(patterns), enumerate(TEXTS)) if bool(re.search(p, t, flags)) != ((i, j) in found)]
    assert not wrong, wrong[:10]


def test_patterns_that_are_none_are_their_text(spark):
    for p in BROKEN:
        with pytest.raises((re.error, OverflowError)):
            re.compile(p)
    found = verdicts(spark, [java_or_literal(p) for p in BROKEN])
    assert found == {(i, j) for (i, p), (j, t) in itertools.product(enumerate(BROKEN), enumerate(TEXTS)) if p in t}
    assert java_or_literal(r"(a)(?<=\1)b") == literal(r"(a)(?<=\1)b")  # Java cannot say it


def test_checks_of_all_kinds_take_python_patterns(spark):
    kinds = ["must_include", "any_include", "must_exclude", "must_not_endorse"]
    checks = [{"type": k, "patterns": [p]} for k in kinds for p in FIXED + BROKEN] + [{"type": "regex", "pattern": p} for p in FIXED + BROKEN]
    df = spark.createDataFrame([(json.dumps(checks), t) for t in TEXTS], "spec string, text string").withColumn("checks", ck.prepared(F.from_json("spec", ck.CHECKS))).withColumn("parsed", F.lit(None).cast("variant"))
    for r in df.select("text", ck.run_checks(F.col("text"), F.col("parsed"), F.col("checks"), ready=True).alias("d")).collect():
        low = r["text"].lower()
        for c, d in zip(checks, r["d"], strict=True):
            p = c.get("pattern") or c["patterns"][0] if c.get("patterns") or c.get("pattern") else ""
            lowered = p.lower()
            try:
                re.compile(p if c["type"] == "regex" else lowered)
            except (re.error, OverflowError):
                continue
            hit = bool(re.search(p, r["text"], re.I | re.S)) if c["type"] == "regex" else bool(re.search(lowered, low, re.I if c["type"] in ck.EXCLUDING else 0))
            assert d["pass"] == (hit if c["type"] not in ck.EXCLUDING else not hit), (p, r["text"], c["type"])
