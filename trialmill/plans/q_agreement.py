"""Agreement and estimator queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialmill.operators import agreement as ag
from trialmill.operators.ranks import linear_quantiles
from trialmill.plans.base import judged, query, table, trials

C = F.col
KEY = ["model", "scenario", "rep"]
PAIRS = """
, pairs AS (SELECT model, scenario, rep, class, a.score AS a, b.score AS b FROM
    (SELECT * FROM judged WHERE judge_model = 'A' AND score IS NOT NULL) a JOIN (SELECT model, scenario, rep, score FROM judged WHERE judge_model = 'B' AND score IS NOT NULL) b
    USING (model, scenario, rep))
"""


def pairs(spark, d):
    return ag.pair_raters(judged(spark, d), [*KEY, "class"], "A", "B")


@query("j02_rater_pairs", PAIRS + "SELECT model, scenario, rep, a, b FROM pairs")
def j02(spark, d):
    return pairs(spark, d).select(*KEY, "a", "b")


@query(
    "u03_key_overlap",
    ", f AS (SELECT model, scenario, rep, bool_or(judge_model = 'A') AS x, bool_or(judge_model = 'B') AS y FROM judged WHERE score IS NOT NULL GROUP BY 1, 2, 3) "
    'SELECT count(*) FILTER (x AND y) AS "both", count(*) FILTER (x AND NOT y) AS only_a, count(*) FILTER (y AND NOT x) AS only_b FROM f',
)
def u03(spark, d):
    return ag.pairing_counts(judged(spark, d), KEY, "A", "B")


@query(
    "j03_all_raters_agree",
    ", c AS (SELECT model, scenario, rep, count(DISTINCT judge_model) AS r, min(score) AS l, max(score) AS h FROM judged WHERE score IS NOT NULL GROUP BY 1, 2, 3) "
    "SELECT count(*) AS items, count(*) FILTER (l = h) AS same FROM c WHERE r = 2",
)
def j03(spark, d):
    return ag.all_agree(judged(spark, d), KEY, 2)


@query(
    "j04_pivot_raters",
    "SELECT model, scenario, rep, max(score) FILTER (judge_model = 'A') AS \"A\", max(score) FILTER (judge_model = 'B') AS \"B\" FROM judged GROUP BY 1, 2, 3",
)
def j04(spark, d):
    return judged(spark, d).groupBy(*KEY).pivot("judge_model", ["A", "B"]).agg(F.max("score"))


@query("a45_confusion", PAIRS + "SELECT x::INT AS a, y::INT AS b, (SELECT count(*) FROM pairs WHERE a = x AND b = y) AS n FROM range(1, 6) r(x), range(1, 6) s(y)")
def a45(spark, d):
    return ag.confusion(pairs(spark, d), range(1, 6))


@query(
    "e01_kappa_nominal",
    PAIRS + ", t AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS same FROM pairs), x AS (SELECT sum(na * nb) AS cross_ FROM (SELECT a AS c, count(*) AS na FROM pairs GROUP BY 1) "
    "JOIN (SELECT b AS c, count(*) AS nb FROM pairs GROUP BY 1) USING (c)), p AS (SELECT n, same / n::DOUBLE AS po, cross_::DOUBLE / (n * n) AS pe FROM t, x) "
    "SELECT n, CASE WHEN pe = 1 THEN 1e0 ELSE (po - pe) / (1 - pe) END AS kappa FROM p",
)
def e01(spark, d):
    return ag.kappa_nominal(pairs(spark, d))


def _weighted(cost: str) -> str:
    return (
        PAIRS
        + ", v AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT a AS v FROM pairs UNION SELECT b FROM pairs)), c AS (SELECT x.i AS ia, y.i AS ib, count(*) AS n FROM pairs JOIN v x ON x.v = a "
        f"JOIN v y ON y.v = b GROUP BY 1, 2), o AS (SELECT sum({cost} * n) AS o, sum(n) AS n FROM c), e AS (SELECT sum({cost} * na * nb) AS e FROM (SELECT ia, sum(n) AS na FROM c GROUP BY 1), "
        "(SELECT ib, sum(n) AS nb FROM c GROUP BY 1)) SELECT n::BIGINT AS n, CASE WHEN e = 0 THEN 1e0 ELSE 1 - (o * n)::DOUBLE / e END AS kappa FROM o, e"
    )


@query("e02_kappa_linear", _weighted("abs(ia - ib)"))
def e02_linear(spark, d):
    return ag.kappa_weighted(pairs(spark, d), "linear")


@query("e02_kappa_unweighted", _weighted("(CASE WHEN ia <> ib THEN 1 ELSE 0 END)"))
def e02_unweighted(spark, d):
    return ag.kappa_weighted(pairs(spark, d), "unweighted")


@query("e02_kappa_quadratic_seen", _weighted("((ia - ib) * (ia - ib))"))
def e02_quadratic(spark, d):
    return ag.kappa_weighted(pairs(spark, d), "quadratic")


QWK = (
    "count(*) AS n, CASE WHEN count(*) * (sum(a * a) + sum(b * b)) - 2 * sum(a) * sum(b) = 0 THEN 1e0 ELSE 1 - (count(*) * sum((a - b) * (a - b)))::DOUBLE / "
    "(count(*) * (sum(a * a) + sum(b * b)) - 2 * sum(a) * sum(b)) END AS qwk, sum(a)::DOUBLE / count(*) AS mean_a, sum(b)::DOUBLE / count(*) AS mean_b"
)


@query("e03_qwk_fixed", PAIRS + f"SELECT {QWK} FROM pairs")
def e03(spark, d):
    return ag.kappa_quadratic(pairs(spark, d))


@query("e04_kappa_binary", PAIRS + f"SELECT {QWK} FROM (SELECT (a >= 4)::INT AS a, (b >= 4)::INT AS b FROM pairs)")
def e04(spark, d):
    return ag.kappa_binary(pairs(spark, d), 4)


@query("e17_agreement_by_class", PAIRS + f"SELECT class, {QWK} FROM pairs GROUP BY class HAVING count(*) >= 5")
def e17(spark, d):
    return ag.kappa_quadratic(pairs(spark, d), ["class"]).filter("n >= 5")


@query(
    "e05_fleiss",
    PAIRS + ", r AS (SELECT model, scenario, rep, a AS c FROM pairs UNION ALL SELECT model, scenario, rep, b FROM pairs), x AS (SELECT model, scenario, rep, c, count(*) AS k FROM r GROUP BY ALL), "
    "i AS (SELECT sum(k) AS n, sum(k * (k - 1)) AS g FROM x GROUP BY model, scenario, rep), t AS (SELECT count(*) AS items, min(n) AS l, max(n) AS h, sum(g) AS g FROM i), "
    "s AS (SELECT sum(k * k) AS q, sum(k) AS w FROM (SELECT c, sum(k) AS k FROM x GROUP BY 1)), p AS (SELECT items, l, h, g::DOUBLE / (items * h * (h - 1)) AS p, q::DOUBLE / (w * w) AS pe FROM t, s) "
    "SELECT items, CASE WHEN l = h AND h >= 2 THEN CASE WHEN pe >= 1 THEN 1e0 ELSE (p - pe) / (1 - pe) END END AS kappa FROM p",
)
def e05(spark, d):
    both = pairs(spark, d)
    long = both.select(*KEY, C("a").alias("c")).unionByName(both.select(*KEY, C("b").alias("c")))
    return ag.fleiss(long, KEY, "c")


@query(
    "e06_closeness",
    PAIRS + "SELECT class, count(*) AS n, count(*) FILTER (a = b) / count(*)::DOUBLE AS exact, count(*) FILTER (abs(a - b) <= 1) / count(*)::DOUBLE AS within_1, sum(abs(a - b))::DOUBLE / count(*) AS mean_gap FROM pairs GROUP BY 1",
)
def e06(spark, d):
    return ag.closeness(pairs(spark, d), ["class"])


def _pearson(x: str, y: str, source: str) -> str:
    return (
        f", s AS (SELECT count(*) AS n, sum({x}::DOUBLE) AS sx, sum({y}::DOUBLE) AS sy, sum({x}::DOUBLE * {x}) AS qx, sum({y}::DOUBLE * {y}) AS qy, sum({x}::DOUBLE * {y}) AS p FROM {source} "
        f"WHERE {x} IS NOT NULL AND {y} IS NOT NULL) SELECT n, CASE WHEN n >= 3 AND n * qx - sx * sx > 0 AND n * qy - sy * sy > 0 THEN (n * p - sx * sy) / sqrt(n * qx - sx * sx) / sqrt(n * qy - sy * sy) END"
    )


@query("e07_spearman", PAIRS + ", r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2e0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2e0 AS rb FROM pairs)" + _pearson("ra", "rb", "r") + " AS rho FROM s")
def e07(spark, d):
    return ag.spearman(pairs(spark, d), "a", "b")


@query("e08_pearson", _pearson("det_score", "wall_s", "trials") + " AS r FROM s")
def e08(spark, d):
    return ag.pearson(trials(spark, d), "det_score", "wall_s")


@query(
    "e09_kendall",
    PAIRS + ", c AS (SELECT a, b, count(*) AS n FROM pairs GROUP BY 1, 2), t AS (SELECT sum(sign(p.a - q.a) * sign(p.b - q.b) * p.n * q.n)::DOUBLE AS s, sum(CASE WHEN p.a <> q.a THEN p.n * q.n ELSE 0 END)::DOUBLE AS ua, "
    "sum(CASE WHEN p.b <> q.b THEN p.n * q.n ELSE 0 END)::DOUBLE AS ub FROM c p, c q) SELECT s / sqrt(ua) / sqrt(ub) AS tau_b FROM t",
)
def e09(spark, d):
    return ag.kendall_tau_b(pairs(spark, d))


@query(
    "e09_kendall_continuous",
    "WITH o AS (SELECT o_totalprice AS a, o_custkey + date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS b FROM orders WHERE o_totalprice IS NOT NULL), t AS (SELECT sum(sign(p.a - q.a) * sign(p.b - q.b))::DOUBLE AS s, "
    "count(*) FILTER (p.a <> q.a)::DOUBLE AS ua, count(*) FILTER (p.b <> q.b)::DOUBLE AS ub FROM o p, o q) SELECT s / sqrt(ua) / sqrt(ub) AS tau_b FROM t",
    views=False,
)
def e09_continuous(spark, d):
    """Two scales with about as many values as rows."""
    day = F.datediff(C("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return ag.kendall_tau_b(table(spark, d, "orders").select(C("o_totalprice").alias("a"), (C("o_custkey") + day).alias("b")))


@query(
    "e10_icc",
    PAIRS + ", s AS (SELECT count(*) AS n, sum(a)::DOUBLE AS sa, sum(b)::DOUBLE AS sb, sum(a * a + b * b)::DOUBLE AS q, sum((a + b) * (a + b))::DOUBLE AS r FROM pairs), "
    "m AS (SELECT n, r / 2 - (sa + sb) * (sa + sb) / (2 * n) AS rw, (sa * sa + sb * sb) / n - (sa + sb) * (sa + sb) / (2 * n) AS cl, q - (sa + sb) * (sa + sb) / (2 * n) AS ev FROM s), "
    "k AS (SELECT n, rw / (n - 1) AS msr, cl AS msc, (ev - rw - cl) / (n - 1) AS mse FROM m) SELECT n, (msr - mse) / (msr + mse + 2 * (msc - mse) / n) AS icc FROM k",
)
def e10(spark, d):
    return ag.icc_2_1(pairs(spark, d))


@query(
    "e11_bland_altman",
    PAIRS + ", s AS (SELECT count(*) AS n, sum(a - b)::DOUBLE AS s, sum((a - b) * (a - b))::DOUBLE AS q FROM pairs), t AS (SELECT n, s / n AS bias, sqrt((n * q - s * s) / (n * (n - 1))) AS sd FROM s) "
    "SELECT n, bias, sd, bias - 1.96e0 * sd AS low, bias + 1.96e0 * sd AS high FROM t",
)
def e11(spark, d):
    return ag.bland_altman(pairs(spark, d))


@query(
    "e12_regression",
    ", s AS (SELECT count(*) AS n, sum(wall_s) AS sx, sum(det_score) AS sy, sum(wall_s * wall_s) AS qx, sum(det_score * det_score) AS qy, sum(wall_s * det_score) AS p FROM trials) "
    "SELECT n, (n * p - sx * sy) / (n * qx - sx * sx) AS slope, (sy - (n * p - sx * sy) / (n * qx - sx * sx) * sx) / n AS intercept, (n * p - sx * sy) / sqrt(n * qx - sx * sx) / sqrt(n * qy - sy * sy) AS r FROM s",
)
def e12(spark, d):
    return ag.regression(trials(spark, d), "wall_s", "det_score")


@query(
    "e13_friedman",
    ", c AS (SELECT scenario AS t, difficulty AS b, sum(det_score) / count(*) AS v FROM trials GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY b ORDER BY v) + (count(*) OVER (PARTITION BY b, v) - 1) / 2e0 AS r FROM c), "
    "ties AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*) AS t FROM r GROUP BY b, v)), s AS (SELECT sum(r * r) AS q, max(n) AS n, count(*) AS k FROM (SELECT t, sum(r) AS r, count(*) AS n FROM r GROUP BY 1)) "
    ", x AS (SELECT n, k, (12 * q / (n * k * (k + 1)) - 3 * n * (k + 1)) / (1 - ties::DOUBLE / (n * k * (k * k - 1))) AS chi2 FROM s, ties) "
    "SELECT n, k, chi2, CASE WHEN k % 2 = 1 THEN exp(-chi2 / 2) * list_sum(list_transform(range(0, (k - 1) // 2), lambda i: pow(chi2 / 2, i) / factorial(i::INT))) END AS p FROM x",
)
def e13(spark, d):
    return ag.friedman(trials(spark, d), "scenario", "difficulty", "det_score")


#: The upper tail of chi-square for any degrees of freedom: the terms of the recurrence, and erfc by series or continued fraction where they are odd.
_TAIL = (
    "CASE WHEN chi2 <= 0 THEN 1e0 ELSE list_sum(list_transform(range(0, (k - 1) // 2), lambda i: exp(-chi2 / 2 + (i + ((k - 1) % 2) / 2e0) * ln(chi2 / 2) - lgamma(i + 1 + ((k - 1) % 2) / 2e0)))) "
    "+ CASE WHEN k % 2 = 1 THEN 0e0 WHEN chi2 < 6 THEN 1 - exp(-chi2 / 2) * sqrt(chi2 / 2) * 2 / sqrt(pi()) * list_sum(list_transform(range(0, 80), lambda i: exp(i * ln(chi2) + 0.5 * ln(pi()) - ln(2e0) - lgamma(i + 1.5) - i * ln(2e0)))) "
    "ELSE exp(-chi2 / 2) / sqrt(pi()) / (sqrt(chi2 / 2) + list_reduce(list_prepend(0e0, list_reverse(range(1, 200))::DOUBLE[]), lambda f, n: (n / 2) / (sqrt(chi2 / 2) + f))) END END"
)


def _friedman(treatment: str, block: str) -> str:
    return (
        f", c AS (SELECT {treatment} AS t, {block} AS b, sum(det_score) / count(*) AS v FROM trials GROUP BY 1, 2), w AS (SELECT b FROM c GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT t) FROM c)), "
        "r AS (SELECT *, rank() OVER (PARTITION BY b ORDER BY v) + (count(*) OVER (PARTITION BY b, v) - 1) / 2e0 AS r FROM c WHERE b IN (FROM w)), "
        "ties AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*) AS t FROM r GROUP BY b, v)), s AS (SELECT sum(r * r) AS q, max(n) AS n, count(*) AS k FROM (SELECT t, sum(r) AS r, count(*) AS n FROM r GROUP BY 1)), "
        "x AS (SELECT n, k, (12 * q / (n * k * (k + 1)) - 3 * n * (k + 1)) / (1 - ties::DOUBLE / (n * k * (k * k - 1))) AS chi2 FROM s, ties) "
        f"SELECT n, k, chi2, {_TAIL} AS p FROM x"
    )


@query("e13_friedman_odd", _friedman("concat(difficulty, grounding)", "concat(bracket, class)"))
def e13_odd(spark, d):
    """Six treatments: five degrees of freedom."""
    t = trials(spark, d).withColumn("t", F.concat("difficulty", "grounding")).withColumn("b", F.concat("bracket", "class"))
    return ag.friedman(t, "t", "b", "det_score")


@query("e13_friedman_subjects", _friedman("model", "scenario"))
def e13_subjects(spark, d):
    """Subjects as treatments: about as many degrees of freedom as there are subjects."""
    return ag.friedman(trials(spark, d), "model", "scenario", "det_score")


@query("e15_agreement_label", PAIRS + f", k AS (SELECT class, {QWK} FROM pairs GROUP BY class) SELECT class, CASE WHEN qwk >= 0.81 THEN 'almost perfect' WHEN qwk >= 0.61 THEN 'substantial' WHEN qwk >= 0.41 THEN 'moderate' WHEN qwk >= 0.21 THEN 'fair' WHEN qwk >= 0 THEN 'slight' ELSE 'poor' END AS label FROM k")
def e15(spark, d):
    return ag.kappa_quadratic(pairs(spark, d), ["class"]).select("class", ag.label(C("qwk")).alias("label"))


NORMAL = (
    ", s AS (SELECT bracket, count(*) AS n, sum(det_score) AS s, sum(det_score * det_score) AS q FROM trials GROUP BY 1), ci AS (SELECT bracket, n, s / n AS mean, "
    "s / n - 1.96e0 * sqrt((n * q - s * s) / (n * n)) / sqrt(n) AS low, s / n + 1.96e0 * sqrt((n * q - s * s) / (n * n)) / sqrt(n) AS high FROM s)"
)


@query("a35_normal_interval", NORMAL + "SELECT * FROM ci")
def a35(spark, d):
    return ag.normal_ci(trials(spark, d), "det_score", ["bracket"])


_BOOT = (
    ", c AS (SELECT bracket AS g, det_score::DOUBLE AS v, count(*) AS c FROM trials WHERE det_score IS NOT NULL GROUP BY 1, 2), s AS (SELECT g, v, c, part, least(c - 256 * part, 256) AS n FROM (SELECT *, unnest(range(0, (c + 255) // 256)) AS part FROM c)), "
    "e AS (SELECT n, greatest(floor(n - 10 * sqrt(n)) - 10, 0)::INT AS least_, (ceil(n + 10 * sqrt(n)) + 20)::INT AS most FROM (SELECT DISTINCT n FROM s)), "
    "t AS (SELECT n, least_, list(p ORDER BY k) AS steps FROM (SELECT n, least_, k, sum(exp(-n::DOUBLE + k * ln(n) - lgamma(k + 1))) OVER (PARTITION BY n ORDER BY k) AS p FROM (SELECT *, unnest(range(least_, most + 1)) AS k FROM e)) GROUP BY 1, 2), "
    "w AS (SELECT g, d, v, least_ + len(list_filter(steps, lambda p: p < u)) AS w FROM (SELECT g, d, v, least_, steps, ('0x' || substr(md5(concat('7:', g, ':', v, ':', part, ':', d)), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0 AS u FROM s JOIN t USING (n), range(0, 10000) r(d))), "
    "m AS (SELECT g, d, sum(w * v) / sum(w) AS m FROM w GROUP BY 1, 2), b AS (SELECT g, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1) "
    "SELECT g AS bracket, sum(c)::BIGINT AS n, sum(c * v) / sum(c) AS mean, any_value(low) AS low, any_value(high) AS high FROM c JOIN b USING (g) GROUP BY 1"
)


@query("a34_bootstrap_interval", _BOOT)
def a34(spark, d):
    return ag.bootstrap_ci(trials(spark, d), "det_score", "bracket", seed=7)


@query("a34_interval_holds_mean", "SELECT bracket, count(det_score) AS n, sum(det_score) / count(det_score) AS mean, true AS holds, true AS narrow FROM trials GROUP BY 1")
def a34_holds(spark, d):
    """What must hold whatever is drawn: the mean lies within, and the interval is about as wide as four standard errors."""
    t = trials(spark, d)
    found = ag.bootstrap_ci(t, "det_score", "bracket", seed=7).join(ag.normal_ci(t, "det_score", ["bracket"]).select("bracket", (C("high") - C("low")).alias("width")), "bracket")
    ratio = (C("high") - C("low")) / C("width")
    return found.select("bracket", "n", "mean", ((C("low") <= C("mean")) & (C("mean") <= C("high"))).alias("holds"), ratio.between(0.8, 1.25).alias("narrow"))


@query("e16_bracket_gate", NORMAL + "SELECT c.mean - r.mean AS lift, c.mean - r.mean >= 0.05 AND c.low > r.high AS passes FROM ci c, ci r WHERE c.bracket = '4-5GB' AND r.bracket = '0-1B'")
def e16(spark, d):
    return ag.bracket_gate(ag.normal_ci(trials(spark, d), "det_score", ["bracket"]), "bracket", "4-5GB", "0-1B")


@query(
    "e18_stratified_sample",
    ", c AS (SELECT class AS s, count(*) AS c FROM trials GROUP BY 1), t AS (SELECT sum(c) AS total FROM c), "
    "q AS (WITH RECURSIVE q AS (SELECT list({'s': s, 'c': c, 'q': least(c, greatest(2, floor(50 * c / total::DOUBLE)::BIGINT))}) AS l FROM c, t UNION ALL "
    "SELECT list_transform(l, lambda x: {'s': x.s, 'c': x.c, 'q': x.q + CASE WHEN x.s <> pick THEN 0 WHEN over THEN -1 ELSE 1 END}) FROM (SELECT l, list_sum(list_transform(l, lambda x: x.q)) > 50 AS over, "
    "CASE WHEN list_sum(list_transform(l, lambda x: x.q)) > 50 THEN list_sort(list_transform(l, lambda x: {'a': x.q, 'b': x.s}))[-1].b "
    "ELSE list_sort(list_transform(list_filter(l, lambda x: x.q < x.c), lambda x: {'a': x.q / x.c::DOUBLE, 'b': x.s}))[1].b END AS pick FROM q WHERE list_sum(list_transform(l, lambda x: x.q)) <> least(50, list_sum(list_transform(l, lambda x: x.c))))) "
    "SELECT unnest(l) AS x FROM q WHERE list_sum(list_transform(l, lambda x: x.q)) = least(50, list_sum(list_transform(l, lambda x: x.c)))) "
    "SELECT model, scenario, rep, class FROM trials JOIN q ON q.x.s = class QUALIFY row_number() OVER (PARTITION BY class ORDER BY md5(concat('7:', model, ':', scenario, ':', rep)), model, scenario, rep) <= q.x.q",
)
def e18(spark, d):
    return ag.stratified(trials(spark, d), "class", KEY, 50, 7).select(*KEY, "class")


@query(
    "e18_strata",
    ", c AS (SELECT class, count(*) AS c FROM trials GROUP BY 1) SELECT class, true AS near, 50 AS total FROM c",
)
def e18_strata(spark, d):
    """What must hold whatever is drawn: 50 rows in all, each class within two of its share or the least of two."""
    t = trials(spark, d)
    sizes = t.groupBy("class").agg(F.count("*").alias("c"))
    got = ag.stratified(t, "class", KEY, 50, 7).groupBy("class").agg(F.count("*").alias("n"))
    totals = sizes.agg(F.sum("c").alias("all")).crossJoin(got.agg(F.sum("n").cast("int").alias("total")))  # one row each
    near = F.abs(C("n") - F.greatest(50 * C("c") / C("all"), F.least(C("c"), F.lit(2)))) <= 2
    return sizes.join(got, "class").join(F.broadcast(totals)).select("class", near.alias("near"), "total")


@query(
    "e20_quantile_band",
    "SELECT bracket, quantile_cont(x, 0.1) AS low, quantile_cont(x, 0.5) AS mid, quantile_cont(x, 0.9) AS high FROM (SELECT bracket, membw_mb_s / 32768e0 AS x FROM trials) GROUP BY 1",
)
def e20(spark, d):
    share = C("membw_mb_s") / 32768.0
    return linear_quantiles(trials(spark, d), ["bracket"], share, {"low": 0.1, "mid": 0.5, "high": 0.9})


@query(
    "agreement_binary_labels",
    f"SELECT {QWK} FROM (SELECT quality AS a, 1 - toxic AS b FROM labels)",
)
def binary_labels(spark, d):
    return ag.kappa_quadratic(table(spark, d, "labels").select(C("quality").alias("a"), (1 - C("toxic")).alias("b")))


@query(
    "agreement_ordinal_orders",
    f", x AS (SELECT left(o_orderpriority, 1)::INT AS a, least(5, max(l_linenumber)) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority) SELECT {QWK} FROM x",
)
def ordinal_orders(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("m"))
    orders = table(spark, d, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("a"))
    return ag.kappa_quadratic(orders.join(lines, C("o_orderkey") == C("l_orderkey")).select("a", F.least(F.lit(5), "m").alias("b")))
