"""Least squares and causality tests for many series at once.

One grouped aggregate per series collects means and co-moments (Spark's covariances
are centred as they are merged, so large levels lose no digits); what is left is a
system of a few equations for each series, solved in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails


def regularized_beta(x: float, a: float, b: float, eps: float = 3e-12, rounds: int = 400) -> float:
    """I_x(a, b) by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - regularized_beta(1 - x, b, a, eps, rounds)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(rounds):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + term * d or tiny)
        c = 1.0 + term / c or tiny
        f *= c * d
        if abs(1.0 - c * d) < eps:
            break
    return min(1.0, max(0.0, front * (f - 1.0)))


def student_two_sided(t: float, df: float) -> float:
    return regularized_beta(df / (df + t * t), df / 2, 0.5)


def f_survival(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else min(1.0, max(0.0, 1.0 - regularized_beta(d1 * f / (d1 * f + d2), d1 / 2, d2 / 2)))


def moments(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """(keys, n, mean, cov): over rows where all are there; the mean of (y, xs) and
    the lower triangle of their population covariance."""
    names = [y, *xs]
    complete = df.select(*keys, *names).na.drop(subset=names)
    pairs = [F.covar_pop(a, b) for i, a in enumerate(names) for b in names[: i + 1]]
    return complete.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in names]).alias("mean"), F.array(*pairs).alias("cov"))


def _square(cov: Sequence[float], size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.tril_indices(size)] = cov
    return out + np.tril(out, -1).T


def solve(n: int, mean: np.ndarray, cov: np.ndarray) -> dict:
    """OLS with an intercept from moments, in units of each deviation. A design that
    is not of full rank is an error."""
    k = len(mean)
    scale = np.sqrt(np.diag(cov))
    if n <= k or (scale[1:] == 0).any():
        raise np.linalg.LinAlgError("too few rows or a constant regressor")
    sxx = cov[1:, 1:] / np.outer(scale[1:], scale[1:])
    if np.linalg.matrix_rank(sxx, hermitian=True) < k - 1:
        raise np.linalg.LinAlgError("regressors depend on one another")
    inverse = np.linalg.inv(sxx)
    beta = inverse @ (cov[0, 1:] / scale[1:])
    rss = max(0.0, n * (cov[0, 0] - beta @ (cov[0, 1:] / scale[1:])))
    tss = n * cov[0, 0]
    slopes = beta / scale[1:]
    intercept = mean[0] - slopes @ mean[1:]
    sigma2 = rss / (n - k)
    spread = inverse / np.outer(scale[1:], scale[1:])
    se = np.sqrt(np.maximum(np.r_[sigma2 * (1 / n + mean[1:] @ spread @ mean[1:] / n), sigma2 * np.diag(spread) / n], 1e-18))
    coef = np.r_[intercept, slopes]
    t = coef / se
    return {"n": n, "rss": rss, "r_squared": 1 - rss / tss if tss > 0 else 0.0, "coefficient": coef, "std_error": se, "t_stat": t}


def ols(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """(keys, n, r_squared, rss, term, coefficient, std_error, t_stat, p_value), a row
    for each term; series with too few rows or a design not of full rank have null
    figures and a ``reason``."""
    terms = ["intercept", *xs]
    known = moments(df, keys, y, xs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                try:
                    fit = solve(row["n"], np.asarray(row["mean"], float), _square(row["cov"], len(terms)))
                except np.linalg.LinAlgError as e:
                    out += [[*[row[k] for k in keys], row["n"], None, None, term, None, None, None, str(e)] for term in terms]
                    continue
                for i, term in enumerate(terms):
                    out.append([*[row[k] for k in keys], fit["n"], fit["r_squared"], fit["rss"], term, *[fit[c][i] for c in ("coefficient", "std_error", "t_stat")], None])
            yield pd.DataFrame(out, columns=[*keys, "n", "r_squared", "rss", "term", "coefficient", "std_error", "t_stat", "reason"])

    head = "".join(f"`{k}` {known.schema[k].dataType.simpleString()}, " for k in keys)
    found = known.mapInPandas(run, head + "n long, r_squared double, rss double, term string, coefficient double, std_error double, t_stat double, reason string")
    p = tails.student_p(F.col("t_stat"), F.col("n") - len(terms)).alias("p_value")
    return found.select(*keys, "n", "r_squared", "rss", "term", "coefficient", "std_error", "t_stat", p, "reason")


def lagged(df: DataFrame, keys: Sequence[str], columns: Sequence[str], ks: Sequence[int], month: str = "month") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(month)
    return df.select(*keys, month, *columns, *[F.lag(c, k).over(w).alias(f"{c}_lag{k}") for c in columns for k in ks])


def granger(df: DataFrame, keys: Sequence[str], target: str, driver: str, lags: int = 2, month: str = "month") -> DataFrame:
    """(keys, lags, n, f_stat, p_value, reason): whether lags of a driver help to predict the
    target beyond its own. Both regressions see the same complete rows."""
    ks = range(1, lags + 1)
    own, other = [f"{target}_lag{k}" for k in ks], [f"{driver}_lag{k}" for k in ks]
    known = moments(lagged(df, keys, [target, driver], list(ks), month), keys, target, [*own, *other])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                n, mean, cov = row["n"], np.asarray(row["mean"], float), _square(row["cov"], 1 + 2 * lags)
                try:
                    full, part = solve(n, mean, cov), solve(n, mean[: 1 + lags], cov[: 1 + lags, : 1 + lags])
                except np.linalg.LinAlgError as e:
                    out.append([*[row[k] for k in keys], lags, n, None, str(e)])
                    continue
                rest = n - 1 - 2 * lags
                below = full["rss"] / rest if rest > 0 else 0.0
                f = max(0.0, part["rss"] - full["rss"]) / lags / below if below > 0 else 0.0
                out.append([*[row[k] for k in keys], lags, n, f if rest > 0 else None, None if rest > 0 else "too few rows"])
            yield pd.DataFrame(out, columns=[*keys, "lags", "n", "f_stat", "reason"])

    head = "".join(f"`{k}` {known.schema[k].dataType.simpleString()}, " for k in keys)
    found = known.mapInPandas(run, head + "lags int, n long, f_stat double, reason string")
    p = tails.f_p(F.col("f_stat"), F.col("lags"), F.col("n") - 1 - 2 * F.col("lags")).alias("p_value")
    return found.select(*keys, "lags", "n", "f_stat", p, "reason")


def indicator_relationship(df: DataFrame, keys: Sequence[str], target: str, indicator: str, month: str = "month") -> tuple[DataFrame, DataFrame]:
    """OLS of a target on its own and an indicator's last value, and the causality
    test of the indicator."""
    rows = lagged(df, keys, [target, indicator], [1], month)
    return ols(rows, keys, target, [f"{target}_lag1", f"{indicator}_lag1"]), granger(df, keys, target, indicator, month=month)


def correlations(df: DataFrame, keys: Sequence[str], target: str, others: Sequence[str]) -> DataFrame:
    """(keys, series, correlation) of the target with each other column, over the rows
    that have both; null where either is constant."""
    from ..functions.exprs import guarded_corr

    wide = df.groupBy(*keys).agg(*[guarded_corr(target, o).alias(o) for o in others])
    return wide.unpivot(list(keys), list(others), "series", "correlation")


def two_regressor_ols(df: DataFrame, keys: Sequence[str], y: str, x1: str, x2: str) -> DataFrame:
    """Closed form for two regressors with the p-values of their slopes: one grouped
    aggregate and expressions, no Python worker."""
    rows = df.select(*keys, F.col(y).alias("y"), F.col(x1).alias("a"), F.col(x2).alias("b")).na.drop(subset=["y", "a", "b"])
    m = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("my"), F.avg("a").alias("ma"), F.avg("b").alias("mb"),
        F.covar_pop("a", "a").alias("saa"), F.covar_pop("b", "b").alias("sbb"), F.covar_pop("a", "b").alias("sab"),
        F.covar_pop("a", "y").alias("say"), F.covar_pop("b", "y").alias("sby"), F.covar_pop("y", "y").alias("syy"),
    )
    det = F.nullif(F.col("saa") * F.col("sbb") - F.col("sab") * F.col("sab"), F.lit(0.0))
    m = m.withColumns({"b1": (F.col("say") * F.col("sbb") - F.col("sby") * F.col("sab")) / det, "b2": (F.col("sby") * F.col("saa") - F.col("say") * F.col("sab")) / det})
    r2 = F.try_divide(F.col("b1") * F.col("say") + F.col("b2") * F.col("sby"), F.col("syy"))
    free = F.nullif(F.greatest(F.col("n") - 3, F.lit(0)), F.lit(0))
    below = F.greatest(F.col("syy") - F.col("b1") * F.col("say") - F.col("b2") * F.col("sby"), F.lit(0.0)) / free / det
    p = lambda b, other: tails.student_p(F.try_divide(F.col(b), F.sqrt(below * F.col(other))), free)
    return m.select(
        *keys, "n", (F.col("my") - F.col("b1") * F.col("ma") - F.col("b2") * F.col("mb")).alias("intercept"), F.col("b1").alias("slope_1"), F.col("b2").alias("slope_2"),
        r2.alias("r_squared"), p("b1", "sbb").alias("p_value_1"), p("b2", "saa").alias("p_value_2"),
    )
