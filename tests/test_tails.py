from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.functions import tails
from tideline.operators.regression import f_survival, regularized_beta, student_two_sided


def test_equal_to_the_helpers(spark):
    rng = random.Random(1)
    rows = [(rng.random() ** rng.choice([1, 4, 0.1]), 10 ** rng.uniform(-1, 3.5), 10 ** rng.uniform(-1, 3.5), rng.gauss(0, 4), rng.randint(1, 3000), rng.randint(1, 40)) for _ in range(400)]
    rows += [(0.0, 1.0, 2.0, 0.0, 5, 1), (1.0, 1.0, 2.0, 1e6, 1, 1), (0.5, 0.5, 0.5, -2.228138852, 10, 2)]
    df = spark.createDataFrame(rows, "x double, a double, b double, t double, n int, m int")
    c = F.col
    got = df.select("*", tails.log_gamma(c("a")).alias("g"), tails.regularized_beta(c("x"), c("a"), c("b")).alias("i"), tails.student_p(c("t"), c("n")).alias("p"), tails.f_p(F.abs("t"), c("m"), c("n")).alias("f"))
    assert "Python" not in got._jdf.queryExecution().toString().replace("PythonRDD", "")
    for r in got.collect():
        assert r.g == pytest.approx(math.lgamma(r.a), rel=1e-12, abs=1e-12)
        assert r.i == pytest.approx(regularized_beta(r.x, r.a, r.b), abs=1e-10)
        assert r.p == pytest.approx(student_two_sided(r.t, r.n), abs=1e-10)
        assert r.f == pytest.approx(f_survival(abs(r.t), r.m, r.n), abs=1e-10)


def test_nulls(spark):
    df = spark.sql("SELECT CAST(NULL AS DOUBLE) AS t, 5 AS n UNION ALL SELECT 1.0, NULL UNION ALL SELECT 2.0, 3")
    got = df.select(tails.student_p(F.col("t"), F.col("n")).alias("p"), tails.f_p(F.col("t"), F.col("n"), F.col("n")).alias("f")).collect()
    assert sorted((r.p is None, r.f is None) for r in got) == [(False, False), (True, True), (True, True)]
