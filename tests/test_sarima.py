from __future__ import annotations

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import kalman, sarima


def autocovariances(ar, ma, n, long=4000):
    """By the weights of a long moving average."""
    psi = np.zeros(long)
    for j in range(long):
        psi[j] = (ma[j] if j < len(ma) else 0.0) - sum(ar[k] * psi[j - k] for k in range(1, min(j, len(ar) - 1) + 1))
    return np.array([psi[: long - k] @ psi[k:] for k in range(n)])


def density(w, ar, ma, sigma2):
    """Log of the multivariate normal density."""
    n = len(w)
    g = autocovariances(ar, ma, n)
    cov = sigma2 * g[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    sign, size = np.linalg.slogdet(cov)
    return -0.5 * (n * math.log(2 * math.pi) + size + w @ np.linalg.solve(cov, w))


CASES = [([1.0], [1.0, 0.5]), ([1.0, -0.7], [1.0]), ([1.0, -0.5, 0.3], [1.0, 0.4]), ([1.0], [1.0, 1.6]), (sarima._poly(np.array([-0.6]), np.array([-0.5])), sarima._poly(np.array([0.3]), np.array([-0.4])))]


@pytest.mark.parametrize("ar, ma", CASES)
def test_likelihood_is_the_density(ar, ma):
    w = np.random.default_rng(3).normal(size=40).cumsum() * 0.3
    f = kalman.filtered(kalman.Models(np.array([ar, ar]), np.array([ma, ma])), np.array([w, 2 * w]))
    value, sigma2 = kalman.log_likelihood(f)
    for i, series in enumerate((w, 2 * w)):
        assert value[i] == pytest.approx(density(series, ar, ma, sigma2[i]), abs=1e-8)
    # given the first values: the density of all over that of the first
    assert kalman.log_likelihood(f, 7)[0][0] == pytest.approx(density(w, ar, ma, sigma2[0]) - density(w[:7], ar, ma, sigma2[0]), abs=1e-8)


@pytest.mark.parametrize("ar, ma", CASES)
def test_covariance_of_the_state(ar, ma):
    """The filtered covariance leads to the variance of the next value given the series."""
    n, steps = 25, 5
    model = kalman.Models(np.array([ar]), np.array([ma]))
    f = kalman.filtered(model, np.zeros((1, n)), keep_covariance=True)
    g = autocovariances(ar, ma, n + steps)
    whole = g[np.abs(np.subtract.outer(np.arange(n + steps), np.arange(n + steps)))]
    given = whole[n:, n:] - whole[n:, :n] @ np.linalg.solve(whole[:n, :n], whole[:n, n:])
    cov, step, shock = f.covariance[0], model.transition()[0], model.shock[0]
    for h in range(steps):
        assert cov[0, 0] == pytest.approx(given[h, h], abs=1e-8)
        cov = step @ cov @ step.T + np.outer(shock, shock)


def test_not_stationary():
    f = kalman.filtered(kalman.Models(np.array([[1.0, -1.01], [1.0, -0.5]]), np.ones((2, 1))), np.ones((2, 20)))
    assert f.good.tolist() == [False, True] and kalman.log_likelihood(f)[0][0] == -np.inf


def test_maximise():
    best, value, settled = kalman.maximise(lambda p: -((p[:, 0] - 3) ** 2) - 10 * (p[:, 1] + p[:, 0]) ** 2, np.zeros(2))
    assert settled and best == pytest.approx([3, -3], abs=1e-4)


def test_forecast_by_conditional_normal():
    """Means and errors of an undifferenced model are those of the normal distribution
    given the series."""
    rng = np.random.default_rng(4)
    x = np.zeros(120)
    for t in range(1, 120):
        x[t] = 0.6 * x[t - 1] + rng.normal()
    fit = sarima.fit_sarima(x + 2, (1, 0, 1), (0, 0, 0))
    g = fit.sigma2 * autocovariances(fit.ar, fit.ma, 126)
    whole = g[np.abs(np.subtract.outer(np.arange(126), np.arange(126)))]
    pull = np.linalg.solve(whole[:120, :120], whole[:120, 120:]).T
    mean, se = fit.forecast(6)
    assert mean == pytest.approx(fit.mean + pull @ (x + 2 - fit.mean), abs=1e-7)
    assert se**2 == pytest.approx(np.diag(whole[120:, 120:] - pull @ whole[:120, 120:]), rel=1e-7)


def test_random_walk():
    rng = np.random.default_rng(5)
    x = rng.normal(size=200).cumsum()
    fit = sarima.fit_sarima(x, (0, 1, 0), (0, 0, 0))
    mean, se = fit.forecast(4)
    assert mean == pytest.approx([x[-1]] * 4) and se == pytest.approx(math.sqrt(fit.sigma2) * np.sqrt([1, 2, 3, 4]))


def test_one_sample_for_all_orders():
    """Criteria judge the same values whatever the differences: of white noise the plain
    mean is best, of a random walk the difference."""
    rng = np.random.default_rng(6)
    noise, walk = rng.normal(size=150), rng.normal(size=150).cumsum()
    scores = lambda x: [sarima.fit_sarima(x, o, (0, 0, 0), burn=13).aic for o in ((0, 0, 0), (0, 1, 0))]
    a, b = scores(noise)
    assert a < b
    a, b = scores(walk)
    assert b < a
    fit = sarima.fit_sarima(noise, (0, 0, 0), (0, 0, 0), burn=13)
    want = 4 + sum(math.log(2 * math.pi * fit.sigma2) + (v - fit.mean) ** 2 / fit.sigma2 for v in noise[13:])
    assert fit.aic == pytest.approx(want, abs=1e-6)


def test_recovers_seasonal_parameters():
    rng = np.random.default_rng(7)
    e = rng.normal(size=1400)
    x = np.zeros(1400)
    for t in range(13, 1400):
        x[t] = 0.5 * x[t - 1] + 0.6 * x[t - 12] - 0.3 * x[t - 13] + e[t]
    fit = sarima.fit_sarima(x[200:], (1, 0, 0), (1, 0, 0))
    assert fit.converged and -fit.ar[1] == pytest.approx(0.5, abs=0.08) and -fit.ar[12] == pytest.approx(0.6, abs=0.08)


def test_jobs_are_dealt_in_lots(spark):
    rng = np.random.default_rng(8)
    day = datetime.date(1990, 1, 1)
    rows = [(k, datetime.date(day.year + t // 12, t % 12 + 1, 1), float(v)) for k in ("a", "b", None) for t, v in enumerate(rng.normal(size=96))]
    df = spark.createDataFrame([*rows, ("a", datetime.date(1999, 1, 1), None)], "k string, month date, v double").repartition(3)
    series = sarima.packed(df, ["k"], "v")
    assert [len(r["values"]) for r in series.collect()] == [96] * 3
    jobs = sarima.specs(spark, sarima.CANDIDATES).crossJoin(spark.sql("SELECT explode(array(date'1995-12-01', date'1996-12-01', date'1989-12-01')) AS origin"))
    lots = sarima.dealt(series, ["k"], jobs)
    assert lots.count() == 3 * 6 and {r.burn for r in lots.collect()} == {13}
    assert lots.select("k", F.explode("jobs").alias("j")).distinct().count() == 3 * 24
    found = sarima.forecast_sarima(df, ["k"], "v", jobs.where("spec_id IN (0, 3)")).collect()
    assert len(found) == 3 * 2 * 2 * 12 and {r.reason for r in found} == {None}
    own = jobs.where("spec_id = 1 AND year(origin) = 1995").withColumn("k", F.lit("b"))
    assert {(r.k, r.spec_id) for r in sarima.forecast_sarima(df, ["k"], "v", own).collect()} == {("b", 1)}
    a = [r for r in found if r.k == "a" and r.spec_id == 0 and str(r.origin) == "1995-12-01"]
    fit = sarima.fit_sarima(np.array([v for k, m, v in rows if k == "a" and m.year <= 1995]), *sarima.CANDIDATES[0], burn=13)
    assert [r.predicted for r in sorted(a, key=lambda r: r.h)] == pytest.approx(fit.forecast(12)[0].tolist())
    assert sarima.forecast_sarima(df.limit(0), ["k"], "v", jobs).count() == 0 and sarima.forecast_sarima(df, ["k"], "v", jobs.limit(0)).count() == 0
