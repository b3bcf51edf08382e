"""The text-check engine against its rules, the negation rule against a plain version of it."""

import json
import random
import re

from pyspark.sql import functions as F

from trialmill.functions import checks as ck

# Fixed value: the plain form of the negation rule, kept to compare with.
NEGATED = re.compile(r"(?:not|no|never|avoid|without|n't|do ?n'?t|instead of)\W*$", re.I)


def run(spark, text, *checks, strict=True):
    df = spark.createDataFrame([(text, json.dumps(list(checks)))], "text string, spec string")
    df = df.withColumn("parsed", ck.found_json(F.col("text"))).withColumn("checks", F.from_json("spec", ck.CHECKS))
    return [d["pass"] for d in df.select(ck.run_checks(F.col("text"), F.col("parsed"), F.col("checks"), strict).alias("d")).first()["d"]]


def test_negation_window(spark):
    check = {"type": "must_exclude", "patterns": ["delete"]}
    assert run(spark, "do not delete", check) == [True]
    assert run(spark, "delete it", check) == [False]
    assert run(spark, "not" + " " * 30 + "delete", check) == [False]
    assert run(spark, "do not delete, then delete", check) == [False]


def test_negation_on_random_phrases(spark):
    rng = random.Random(5)
    words = ["not", "no", "never", "avoid", "without", "don't", "dont", "do nt", "instead of", "delete", "the", ",", " ", "  ", "--", "pod", "known"]
    phrases = ["".join(rng.choice(words) + rng.choice([" ", "", ", "]) for _ in range(rng.randrange(1, 9))) for _ in range(1500)]
    want = [any(not NEGATED.search(p[max(0, m.start() - 18) : m.start()]) for m in re.finditer("delete", p)) for p in phrases]
    df = spark.createDataFrame(list(enumerate(phrases)), "i int, p string").select("i", ck.unnegated(F.col("p"), F.lit("delete")).alias("u"))
    got = [r["u"] for r in sorted(df.collect())]
    assert got == want


def test_patterns_that_are_none_are_taken_literally(spark):
    broken = [{"type": "must_exclude", "patterns": ["(now", "a.c"]}, {"type": "any_include", "patterns": ["[x", "zz*"]}, {"type": "valid_json_array"}]
    df = spark.createDataFrame([("run (now", json.dumps(broken)), ("see [x", json.dumps(broken)), ("abc", json.dumps(broken)), ("z", "[]"), ("q", None)], "text string, spec string")
    df = df.withColumn("parsed", ck.found_json(F.col("text"))).withColumn("checks", F.from_json("spec", ck.CHECKS)).withColumn("checks", ck.prepared(F.col("checks")))
    got = {r["text"]: None if r["d"] is None else [d["pass"] for d in r["d"]] for r in df.select("text", ck.run_checks(F.col("text"), F.col("parsed"), F.col("checks"), ready=True).alias("d")).collect()}
    assert got == {"run (now": [False, False, False], "see [x": [True, True, False], "abc": [False, False, False], "z": [], "q": None}


def test_letters_of_all_scripts_are_word_characters(spark):
    check = {"type": "must_exclude", "patterns": ["delete"]}
    assert run(spark, "no é delete", check) == [False]
    assert run(spark, "no – delete", check) == [True]
    assert run(spark, "éa", {"type": "regex", "pattern": r"^\w\w$"}) == [True]


def test_allowed_values_have_types(spark):
    field = lambda *xs: {"type": "json_field_values", "field": "a", "allowed": list(xs)}
    assert run(spark, '[{"a": 1}]', field(1), field("1"), field(1.0), field(True)) == [True, False, True, False]
    assert run(spark, '[{"a": "1"}, {"a": null}]', field("1", None), field("1")) == [True, False]
    assert run(spark, '[{"b": 1}]', field(1), field(None)) == [False, True]
    assert run(spark, "[1]", field(None)) == [False]


def test_unknown_type_fails_but_counts(spark):
    assert run(spark, "x", {"type": "max_len", "value": "5"}) == [False]
    assert run(spark, "x", {"type": "max_len", "value": "5"}, strict=False) == [True]
    assert run(spark, "x", {"type": "nothing"}) == [False]


def test_json_extraction(spark):
    valid, obj = {"type": "valid_json_array"}, {"type": "json_equals", "value": '[{"a": 1, "b": [1, 2]}, {"c": null}]'}
    assert run(spark, "see ```json\n[1, 2]\n``` [", valid) == [True]
    assert run(spark, 'prose {"a": 1}', valid) == [False]
    assert run(spark, "broken [1,", valid) == [False]
    assert run(spark, '[{"c": null}, {"b": [1, 2], "a": 1}]', obj) == [True]
    assert run(spark, '[{"c": null}, {"b": [2, 1], "a": 1}]', obj) == [False]
    keys, allowed = {"type": "json_keys", "value": '["a", "b"]'}, {"type": "json_field_values", "field": "a", "allowed": ["x", "y"]}
    assert run(spark, '[{"b": 1, "a": "x"}]', keys, allowed) == [True, True]
    assert run(spark, '[{"b": 1, "a": "z", "c": 0}]', keys, allowed) == [False, False]
    assert run(spark, "[1]", keys, allowed) == [False, False]
    assert run(spark, "[]", keys, allowed, {"type": "json_len", "value": "0"}) == [True, True, True]


def test_includes_and_regex(spark):
    text = "Restart SAFELY\nand verify"
    checks = [{"type": "must_include", "patterns": ["restart", "verify"]}, {"type": "any_include", "patterns": ["nope", "Safely"]}, {"type": "regex", "pattern": "restart.*verify"}, {"type": "must_include", "patterns": ["absent"]}]
    assert run(spark, text, *checks) == [True, True, True, False]


def test_repetition(spark):
    get = lambda t: spark.createDataFrame([(t,)], "t string").select(ck.words_of(F.col("t")).alias("w")).select(ck.repetition(F.col("w"))).first()[0]
    assert get("a b") == 0.0 and get("a b c a b c") == 0.25 and get("") == 0.0


def test_svg(spark):
    assert spark.createDataFrame([("x <SVG a>\n<g/></svg> y </svg>",)], "t string").select(ck.first_svg(F.col("t"))).first()[0] == "<SVG a>\n<g/></svg>"
