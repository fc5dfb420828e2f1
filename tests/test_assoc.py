"""Association measures: edge rules of SURVEY section 8 on invented rows."""

import math

import pytest
from pyspark.sql import functions as F

from eventfit.functions import assoc

from conftest import rows


@pytest.fixture()
def stats(spark):
    # ab, a, b, n, v: ordinary, zero joint, zero marginal, both zero, head=dep style doubles
    data = [(1, 24.0, 300.0, 500.0, 10000.0, 50.0), (2, 0.0, 30.0, 40.0, 10000.0, 50.0),
            (3, 0.0, 0.0, 40.0, 10000.0, 50.0), (4, 0.0, 0.0, 0.0, 10000.0, 50.0),
            (5, 1.0, 9000.0, 9000.0, 10000.0, 50.0)]
    return spark.createDataFrame(data, "k int, ab double, a double, b double, n double, v double")


def test_mi_ppmi_laplace(stats):
    ab, a, b, n, v = (F.col(c) for c in ("ab", "a", "b", "n", "v"))
    out = {r.k: r for r in stats.select("k", assoc.mi(ab, a, b, n).alias("mi"), assoc.ppmi(ab, a, b, n).alias("ppmi"),
                                        assoc.laplace(ab, a, b, n, v).alias("lap")).collect()}
    assert out[1].mi == pytest.approx(math.log2(24.0 / (300.0 * 500.0 / 10000.0)))
    assert out[1].ppmi == pytest.approx(out[1].mi)
    # numpy: ab = 0 -> -inf -> ppmi 0; 0/0 -> nan -> ppmi 0
    assert out[2].mi is None and out[2].ppmi == 0.0
    assert out[3].mi is None and out[3].ppmi == 0.0
    # negative association is cut at 0
    assert out[5].mi < 0 and out[5].ppmi == 0.0
    # laplace: always finite, unseen pairs with rare words score high
    assert out[4].lap == pytest.approx(max(0.0, math.log2(2 / (1 * 1 / 10050.0))))
    assert out[2].lap == pytest.approx(max(0.0, math.log2(2 / (31 * 41 / 10050.0))))


def test_lmi_strict_and_cprob(spark, stats):
    ab, a, b, n = (F.col(c) for c in ("ab", "a", "b", "n"))
    out = {r.k: r for r in stats.select("k", assoc.lmi(ab, a, b, n).alias("lmi"),
                                        assoc.c_prob(ab, b, a, n).alias("cp"),
                                        assoc.c_prob_simple(ab, a).alias("cs")).collect()}
    assert out[5].lmi == pytest.approx(math.log2(1 * 10000.0 / (9000.0 * 9000.0)) * 1)
    assert out[5].lmi < 0
    assert out[3].lmi is None  # zero marginal -> NULL instead of exit
    assert out[1].cp == pytest.approx(24.0 * 500.0 / 300.0 * 10000.0)
    assert out[3].cs is None
    with pytest.raises(Exception):
        stats.select(assoc.mi_strict(ab, a, b, n, strict=True)).collect()


def test_by_name(spark):
    assert assoc.by_name("lmi") is assoc.lmi
    with pytest.raises(ValueError):
        assoc.by_name("dice")


def test_negative_zero_normalised(spark):
    df = spark.createDataFrame([(-0.0,)], "x double")
    assert str(df.select(assoc.add0(F.col("x")).alias("y")).first().y) == "0.0"
    assert rows(df.select(assoc.add0(F.col("x")).alias("y"))) == [(0.0,)]
