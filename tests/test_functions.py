"""Scalar derivations and predicates, one case for each branch."""

import pytest
from pyspark.sql import functions as F

from trialmill.functions import derive as dv
from trialmill.functions import predicates as pr


def values(spark, schema, rows, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_bottleneck_ladder(spark):
    rows = [(51.0, 60.0, None), (0.0, 90.0, None), (0.0, 60.0, 0.45), (None, None, 0.1), (None, None, None)]
    assert values(spark, "s double, c double, m double", rows, dv.bottleneck(F.col("s"), F.col("c"), F.col("m"))) == [dv.SWAPPING, dv.HOT, dv.SATURATED, dv.HEADROOM, dv.UNMEASURED]
    assert values(spark, "s double, c double, m double", rows[2:], dv.bottleneck(F.col("s"), F.col("c"), F.col("m"), F.col("s") == 0)) == [dv.HOT, dv.HEADROOM, dv.UNMEASURED]


def test_verdict_ladder(spark):
    rows = [(0.9, 90.0, 9.0, 0, True), (None, 90.0, 9.0, 0, False), (0.9, 70.0, 8.0, 0, False), (0.9, 70.0, 7.0, 0, False), (0.6, 70.0, 9.0, 1, False), (0.5, None, 9.0, 0, False)]
    expr = dv.verdict(F.col("d"), F.col("j"), F.col("t"), F.col("n"), F.col("f"))
    assert values(spark, "d double, j double, t double, n int, f boolean", rows, expr) == [dv.UNSAFE, "n/a", dv.INTERACTIVE, dv.SLOW, dv.SHALLOW, dv.WEAK]


def test_policy(spark):
    rows = [("mistral:7b", "ctx", "best_of_3_detcheck"), ("x", "none", "single"), ("qwen3:4b", "none", "evaluator_optimizer_1"), ("mistral", "ctx", "self_consistency_3")]
    p = spark.createDataFrame(rows, "m string, c string, s string").select(dv.effective_policy(F.lit(180), F.lit(45), F.col("m"), F.col("c"), F.col("s")).alias("p")).select("p.*").collect()
    assert p[0]["timeout_s"] > 180 and {"memory_context", "known_slow_model"} <= set(p[0]["reasons"])
    assert (p[1]["timeout_s"], p[1]["stall_s"], p[1]["reasons"]) == (180, 45, ["scenario_or_default"])
    assert (p[2]["timeout_s"], p[2]["stall_s"]) == (304, 56)
    assert p[3]["timeout_s"] == round(round(round(180 * 1.35) * 1.35) * 1.15)


def test_zero_and_null_differ(spark):
    rows = [(0.0,), (None,), (5.0,)]
    assert values(spark, "x double", rows, pr.truthy(F.col("x"))) == [False, False, True]


def test_numbers_and_experts(spark):
    rows = [("1",), ("-2.5e1",), ("true",), ("false",), ('"3"',), ("null",), ("[1]",), (None,), ("1x",)]
    assert values(spark, "x string", rows, pr.numeric(F.col("x"))) == [1.0, -25.0, 1.0, 0.0, None, None, None, None, None]
    assert values(spark, "n int", [(None,), (0,), (8,)], dv.is_moe(F.col("n"))) == [0, 0, 1]


def test_dnf_definitions(spark):
    rows = [(None, "DNF:stall"), (False, "http error"), (True, None), (None, None)]
    assert values(spark, "f boolean, r string", rows, pr.dnf_prefix(F.col("f"), F.col("r"))) == [True, False, True, False]
    assert values(spark, "f boolean, r string", rows, pr.dnf_word(F.col("f"), F.col("r"))) == [True, True, True, False]
    assert values(spark, "f string", [("True",), ("False",), (None,)], pr.finished_text(F.col("f"))) == [False, True, True]


@pytest.mark.parametrize(
    ("reply", "score", "verdict", "met", "missed"),
    [('{"score": 2, "evidence": "e", "verdict": "v"}', 2.0, "v", 0, 0), ("not json", None, "parse_error", 0, 0), ('{"score": 9, "criteria_missed": "one"}', None, "unspecified", 0, 1), ("[1]", None, "parse_error", 0, 0)],
)
def test_judgement(spark, reply, score, verdict, met, missed):
    j = spark.createDataFrame([(reply,)], "r string").select(dv.judgement(F.col("r")).alias("j")).first()["j"]
    assert (j["score"], j["verdict"], len(j["criteria_met"]), len(j["criteria_missed"])) == (score, verdict, met, missed)


def test_small_formulas(spark):
    one = spark.range(1)
    get = lambda e: one.select(e).first()[0]
    assert get(dv.duration_text(F.lit(90061))) == "1d 1h 1m" and get(dv.duration_text(F.lit(59))) == "0m"
    assert get(dv.kv_cache_mb(F.lit(2), F.lit(4), F.lit(8), F.lit(64), F.lit(10))) == pytest.approx(4 * 2 * 4 * 8 * 10 / 1e6)
    assert get(dv.kv_cache_mb(F.lit(2), F.lit(4), F.lit(0), F.lit(64), F.lit(10))) is None
    assert get(dv.bandwidth_share(F.lit(9.0), F.lit(3.0))) == 1.5
    assert get(dv.share_of_sum(F.lit(0), F.lit(0))) is None
    assert get(dv.footer_number(F.lit("\x1b[1m12.5k input"), "input")) == 12500.0
    assert get(dv.stall_phase(F.lit("DNF:x"), F.lit(1), F.lit(None), F.lit(None), F.lit(None), F.lit(None))) == "before_first_byte"
    assert get(dv.stall_phase(F.lit("stop"), F.lit(None), F.lit(None), F.lit(None), F.lit(None), F.lit(None))) is None
    assert get(pr.safe_id(F.lit("../x"))) is False and get(pr.safe_id(F.lit("run-1.a"))) is True
