"""Unit-root (ADF) and stationarity (KPSS) tests of many series, one Arrow group for
each series and variant."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# MacKinnon's (1994) approximate p-values of the ADF statistic with a
# constant, as polynomials in the statistic inside a normal distribution function,
# and the bounds of their two branches.
ADF_LOW = (2.1659, 1.4412, 0.038269)
ADF_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_SPLIT, ADF_LEAST, ADF_MOST = -1.61, -18.83, 2.74
# Critical values of KPSS around a level, and their p-values.
KPSS_CRITICAL = (0.347, 0.463, 0.574, 0.739)
KPSS_P = (0.10, 0.05, 0.025, 0.01)

VARIANTS = {"level": 0, "first_difference": 1, "seasonal_difference_12": 12}


def adf_p_value(stat: float) -> float:
    if stat >= ADF_MOST:
        return 1.0
    if stat <= ADF_LEAST:
        return 0.0
    c = ADF_LOW if stat <= ADF_SPLIT else ADF_HIGH
    z = sum(v * stat**i for i, v in enumerate(c))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _design(x: np.ndarray, lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """Changes, and [level before, lagged changes, 1], from change ``skip`` on."""
    d = np.diff(x)
    rows = np.arange(skip, len(d))
    return d[rows], np.column_stack([x[rows], *[d[rows - k] for k in range(1, lags + 1)], np.ones(len(rows))])


def adf(x: np.ndarray) -> tuple[float, int]:
    """Statistic and lags; lags by AIC over one common sample."""
    n = len(x)
    most = max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))
    best = (math.inf, 0)
    for lags in range(most + 1):
        y, z = _design(x, lags, most)
        rss = float(((y - z @ np.linalg.lstsq(z, y, rcond=None)[0]) ** 2).sum())
        m = len(y)
        best = min(best, (m * math.log(max(rss, 1e-300) / m) + 2 * z.shape[1], lags))
    lags = best[1]
    y, z = _design(x, lags, lags)
    beta = np.linalg.lstsq(z, y, rcond=None)[0]
    rss, free = float(((y - z @ beta) ** 2).sum()), len(y) - z.shape[1]
    if free <= 0:
        return math.nan, lags
    spread = rss / free * np.linalg.pinv(z.T @ z)[0, 0]
    return (float(beta[0] / math.sqrt(spread)) if spread > 0 else math.nan), lags


def kpss(x: np.ndarray) -> tuple[float, int, float]:
    """Statistic around a level, lags (Hobijn, Franses and Ooms), and a p-value inside
    the table's range."""
    n, e = len(x), x - x.mean()
    first = int(n ** (2 / 9))
    auto = [2 * float(e[k:] @ e[: n - k]) / n for k in range(1, first + 1)]
    s0 = float(e @ e) / n + sum(auto)
    s1 = sum(k * a for k, a in enumerate(auto, 1))
    if s0 == 0:
        return math.nan, 0, math.nan
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    long_run = float(e @ e) / n + sum(2 * (1 - k / (lags + 1)) * float(e[k:] @ e[: n - k]) / n for k in range(1, lags + 1))
    stat = float((np.cumsum(e) ** 2).sum()) / n**2 / long_run if long_run > 0 else math.nan
    return stat, lags, float(np.interp(stat, KPSS_CRITICAL, KPSS_P))


def stationarity(df: DataFrame, keys: Sequence[str], value: str, month: str = "month", least: int = 20) -> DataFrame:
    """(keys, variant, observations, adf_lags, adf_statistic, adf_p_value, kpss_lags,
    kpss_statistic, kpss_p_value) for the level, and differences over 1 and 12 rows of
    what is not null. Series of fewer than ``least`` values give null statistics."""
    w = Window.partitionBy(*keys).orderBy(month)
    rows = df.where(F.col(value).isNotNull()).select(*keys, month, *[(F.col(value) - F.lag(value, k).over(w) if k else F.col(value)).alias(v) for v, k in VARIANTS.items()])
    long = rows.unpivot([*keys, month], list(VARIANTS), "variant", "x").where("x IS NOT NULL")
    groups = [*keys, "variant"]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x = frame.sort_values(month)["x"].to_numpy()
        if len(x) < least or x.std() == 0:
            tests = [None] * 6
        else:
            stat, lags = adf(x)
            level, level_lags, p = kpss(x)
            tests = [lags, stat, adf_p_value(stat), level_lags, level, p]
        return pd.DataFrame([[*key, len(x), *tests]], columns=[*groups, "observations", "adf_lags", "adf_statistic", "adf_p_value", "kpss_lags", "kpss_statistic", "kpss_p_value"])

    head = "".join(f"`{k}` {long.schema[k].dataType.simpleString()}, " for k in groups)
    return long.groupBy(*groups).applyInPandas(run, head + "observations long, adf_lags int, adf_statistic double, adf_p_value double, kpss_lags int, kpss_statistic double, kpss_p_value double")
