"""Tails and rank correlations against high-precision and plain versions."""

import math
from decimal import Decimal as D
from decimal import localcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmill.operators import agreement as ag

PI = D("3.14159265358979323846264338327950288419716939937510582097494459230781640628620899862803482534211706798214808651328230664709384460955058223172535940812848111745028410270193852110555964462294895493038196442881097566593344612847564823378678316527120190914564856692346034861045432664821339360726024914127372458700660631558817488152092096282925409171536436789259036001133053054882046652138414695194151160943305727036575959195309218611738193261179310511854807446237996274956735188575272489122793818301194912")


def tail(x: float, k: int) -> D:
    """P(X > x) by the recurrence over degrees of freedom, in long decimals."""
    z = D(x) / 2
    with localcontext() as c:
        c.prec = 60 + (int(z) if z < 300 and k % 2 else 0)
        if k % 2 == 0:
            term, total, step, at = (-z).exp(), D(0), D(1), 0
        else:
            root = z.sqrt()
            if z < 300:  # erf by its series
                t = s = root
                n = 0
                while abs(t) > D(10) ** (-c.prec):
                    n += 1
                    t = t * 2 * z / (2 * n + 1)
                    s += t
                total = 1 - (-z).exp() * s * 2 / PI.sqrt()
            else:  # erfc by its fraction
                f = D(0)
                for n in range(200, 0, -1):
                    f = (D(n) / 2) / (root + f)
                total = (-z).exp() / PI.sqrt() / (root + f)
            term, step, at = (-z).exp() * root / (PI.sqrt() / 2), D("1.5"), 1
        for _ in range((k - at) // 2):
            total += term
            term, step = term * z / step, step + 1
        return +total


def test_chi_square_tail_keeps_its_digits(spark):
    rows = [(float(x), k) for k in (1, 2, 3, 4, 5, 7, 10, 11, 50, 51, 93, 94, 149, 150, 300, 499, 500) for x in (1e-3, 0.1, 1, 2, 3, max(k - 2, 0.5), k, k + 2, k * 1.5, 2 * k, 10, 50, 100, 300, 1000, 1300, 1767, 2000, 3000, 1e4, 1e5)]
    for r in spark.createDataFrame(rows, "x double, k int").select("x", "k", ag.chi2_tail(F.col("x"), F.col("k")).alias("p")).collect():
        want = tail(r["x"], r["k"])
        assert (r["p"] < 1e-299) if want < D(10) ** -300 else abs((D(r["p"]) - want) / want) < D(10) ** -9, r
    odd = spark.createDataFrame([(0.0, 3), (-1.0, 4), (None, 3)], "x double, k int").select(ag.chi2_tail(F.col("x"), F.col("k"))).collect()
    assert [r[0] for r in odd] == [1.0, 1.0, None]


def test_log_gamma(spark):
    rows = [(x,) for x in (0.5, 1.0, 1.5, 2.0, 7.5, 46.5, 250.0, 1e6)]
    assert all(r["g"] == pytest.approx(math.lgamma(r["x"]), rel=1e-12, abs=1e-11) for r in spark.createDataFrame(rows, "x double").select("x", ag.log_gamma(F.col("x")).alias("g")).collect())


def tau(a, b):
    s, ua, ub = 0, 0, 0
    for i in range(len(a)):
        s += int((np.sign(a[i] - a) * np.sign(b[i] - b)).sum())
        ua, ub = ua + int((a != a[i]).sum()), ub + int((b != b[i]).sum())
    return s / math.sqrt(ua) / math.sqrt(ub) if ua and ub else None


@pytest.mark.parametrize("values,block", [(5, 1 << 20), (40, 90), (10**6, 60), (3, 4)])
def test_kendall_of_any_scale(spark, values, block):
    rng = np.random.default_rng(values)
    a = rng.integers(0, values, 400)
    b = np.where(rng.random(400) < 0.3, 7, a + rng.integers(0, values, 400))  # one value holds a third
    df = spark.createDataFrame([(int(x), float(y)) for x, y in zip(a, b, strict=True)] + [(None, 1.0), (1, None)], "a int, b double")
    if values == 3:
        with pytest.raises(ValueError, match="too small"):
            ag.kendall_tau_b(df, 1)
        block = 8
    assert ag.kendall_tau_b(df, block).first()[0] == pytest.approx(tau(a, b), rel=1e-12)


def test_kendall_without_two_values(spark):
    for rows in ([], [(1, 2.0)], [(1, 2.0), (1, 3.0)]):
        assert ag.kendall_tau_b(spark.createDataFrame(rows, "a int, b double")).first()[0] is None


def test_many_cells_are_not_refused(spark):
    n = 20_000
    df = spark.range(n).select(F.col("id").alias("a"), (F.col("id") * 7919 % n).alias("b"))
    b = [i * 7919 % n for i in range(n)]
    tree, lower = [0] * (n + 1), 0
    for seen, v in enumerate(b):
        k, less = v, 0
        while k:
            less, k = less + tree[k], k & (k - 1)
        lower += less
        k = v + 1
        while k <= n:
            tree[k] += 1
            k += k & -k
    pairs = n * (n - 1) // 2
    assert ag.kendall_tau_b(df, 3000).first()[0] == pytest.approx((2 * lower - pairs) / pairs, rel=1e-12)


def test_inversions_of_weighted_places():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 64):
        p, w = rng.permutation(n), rng.integers(1, 5, n)
        assert ag.count_inversions(p, w) == sum(int(w[i] * w[j]) for i in range(n) for j in range(i + 1, n) if p[i] > p[j])
    assert ag.count_inversions(np.array([1, 0]), np.array([1 << 40, 1 << 40])) == 2.0**80


def test_a_block_of_kendall_takes_little_memory(spark):
    import tracemalloc

    n = ag.BLOCK_ROWS
    rng = np.random.default_rng(5)
    tracemalloc.start()
    ag.count_inversions(rng.permutation(n), np.ones(n, np.int64))
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()
