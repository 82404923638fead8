"""Seasonal ARIMA of many series by exact likelihood (see :mod:`.kalman`).

A series is packed once into one row of two arrays; the jobs (spec, origin) that every
series gets are dealt to its row in lots, so what is shuffled doesn't grow with the number
of jobs. A task fits a lot of jobs of a series. Forecasts are undone through the
differences, with standard errors from the filtered covariance of the last state.

Information criteria are taken over one sample: the values behind the longest differences
of all jobs, given those before, so orders with and without differences compare."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kalman

SEASON = 12
#: Jobs of a series that one task fits in a row.
LOT_JOBS = 4

#: The candidate orders (p, d, q)(P, D, Q) that are tuned over.
CANDIDATES = (
    ((1, 0, 0), (1, 0, 0)),
    ((1, 0, 1), (1, 0, 0)),
    ((2, 0, 0), (1, 0, 0)),
    ((0, 1, 1), (0, 1, 1)),
    ((1, 1, 0), (1, 0, 0)),
    ((1, 1, 1), (1, 0, 1)),
    ((0, 1, 1), (1, 0, 0)),
    ((1, 0, 1), (0, 1, 1)),
)


def _poly(short: np.ndarray, seasonal: np.ndarray) -> np.ndarray:
    """Coefficients of (1 + s1 B + ...)(1 + S1 B^12 + ...), from B^0 on."""
    a, b = np.r_[1.0, short], np.zeros(SEASON * len(seasonal) + 1)
    b[0] = 1.0
    b[SEASON::SEASON] = seasonal
    return np.convolve(a, b)


def differences(d: int, sd: int) -> np.ndarray:
    """The polynomial of d differences and sd seasonal ones, from B^0 on."""
    out = np.array([1.0])
    for k in [1] * d + [SEASON] * sd:
        step = np.zeros(k + 1)
        step[0], step[-1] = 1.0, -1.0
        out = np.convolve(out, step)
    return out


@dataclass
class Fit:
    ar: np.ndarray  # of the stationary part, from B^0 on
    ma: np.ndarray
    mean: float  # of the differenced series
    difference: np.ndarray  # polynomial of the differences
    x: np.ndarray
    sigma2: float
    log_likelihood: float
    aic: float
    bic: float
    converged: bool

    def forecast(self, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Means and standard errors of the next values. The state is that of the filter
        and, behind it, the last values, which are known."""
        model = kalman.Models(self.ar[None], self.ma[None])
        w = np.convolve(self.x, self.difference, "valid") - self.mean
        f = kalman.filtered(model, w[None], keep_covariance=True)
        r, k = model.size, len(self.difference) - 1
        step = np.zeros((r + k, r + k))
        step[:r, :r] = model.transition()[0]
        # a value is its difference and what the last values say; it becomes the first of these
        reads = np.r_[1.0, np.zeros(r - 1), -self.difference[1:]]
        if k:
            step[r] = reads
            step[np.arange(r + 1, r + k), np.arange(r, r + k - 1)] = 1.0
        shock = np.r_[model.shock[0], np.zeros(k)]
        state = np.r_[f.state[0], self.x[::-1][:k]]
        cov = np.zeros((r + k, r + k))
        cov[:r, :r] = f.covariance[0]
        mean, variance = np.empty(steps), np.empty(steps)
        drift = np.zeros(r + k)
        if k:
            drift[r] = self.mean
        for h in range(steps):
            mean[h], variance[h] = reads @ state + self.mean, reads @ cov @ reads
            state, cov = step @ state + drift, step @ cov @ step.T + np.outer(shock, shock)
        return mean, np.sqrt(self.sigma2 * np.maximum(variance, 0.0))


def fit_sarima(x: np.ndarray, order: Sequence[int], seasonal: Sequence[int], burn: int | None = None) -> Fit:
    """Fit one series without gaps. The mean of the differenced series is estimated
    only where ``d`` is 0, whatever the seasonal difference. ``burn`` values at the begin
    are given and not judged by the information criteria (those that the differences use
    up, at the least)."""
    (p, d, q), (sp, sd, sq) = order, seasonal
    difference = differences(d, sd)
    x = np.asarray(x, float)
    w = np.convolve(x, difference, "valid") if len(x) >= len(difference) else np.zeros(0)
    if len(w) - p - SEASON * sp < p + q + sp + sq + 3:
        raise ValueError(f"{len(x)} values are too few for {tuple(map(int, order))}{tuple(map(int, seasonal))}")
    level, scale = (w.mean() if d == 0 else 0.0), w.std() or 1.0
    z = (w - level) / scale

    def split(points: np.ndarray) -> tuple[kalman.Models, np.ndarray]:
        ar, ma, s_ar, s_ma = np.split(points[:, : p + q + sp + sq], np.cumsum([p, q, sp]), axis=1)
        both = [np.array([_poly(sign * a, sign * b) for a, b in zip(short, long, strict=True)]) for sign, short, long in ((-1.0, ar, s_ar), (1.0, ma, s_ma))]
        return kalman.Models(*both), (points[:, -1] if d == 0 else np.zeros(len(points)))

    def run(points: np.ndarray) -> kalman.Filtered:
        models, mean = split(points)
        return kalman.filtered(models, z[None] - mean[:, None])

    def value(points: np.ndarray) -> np.ndarray:
        wild = np.abs(points[:, : p + q + sp + sq]).max(1, initial=0.0) > 3.0
        return np.where(wild, -np.inf, kalman.log_likelihood(run(np.where(wild[:, None], 0.0, points)))[0])

    start = np.r_[np.full(p, 0.2), np.full(q, 0.1), np.full(sp, 0.2), np.full(sq, -0.2), np.zeros(int(d == 0))]
    params, best, converged = kalman.maximise(value, start)
    if not math.isfinite(best):
        raise ValueError(f"no likelihood for {tuple(map(int, order))}{tuple(map(int, seasonal))}")
    skip = max(0, (burn or 0) - len(difference) + 1)
    if skip >= len(w):
        raise ValueError(f"{len(x)} values are too few to leave out {burn}")
    f = run(params[None])
    (whole,), (sigma2,) = kalman.log_likelihood(f)
    judged = float(kalman.log_likelihood(f, skip)[0][0]) - (len(w) - skip) * math.log(scale)
    models, mean = split(params[None])
    k = len(params) + 1
    return Fit(models.ar[0], models.ma[0], float(level + scale * mean[0]), difference, x, float(sigma2) * scale**2, float(whole) - len(w) * math.log(scale), 2 * k - 2 * judged, k * math.log(len(w) - skip) - 2 * judged, converged)


def specs(spark: SparkSession, candidates: Sequence = CANDIDATES) -> DataFrame:
    """(spec_id, spec_order, seasonal_order)."""
    rows = [F.struct(F.lit(i).alias("spec_id"), F.array(*map(F.lit, o)).alias("spec_order"), F.array(*map(F.lit, s)).alias("seasonal_order")) for i, (o, s) in enumerate(candidates)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def packed(df: DataFrame, keys: Sequence[str], value: str, month: str = "month") -> DataFrame:
    """(keys, months, values): a row for each series, in order of month, without nulls."""
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(month).alias("m"), F.col(value).cast("double").alias("v")))).alias("rows"))
    return rows.select(*keys, F.col("rows.m").alias("months"), F.col("rows.v").alias("values"))


def dealt(series: DataFrame, keys: Sequence[str], jobs: DataFrame, lot: int = LOT_JOBS) -> DataFrame:
    """``series`` with (jobs, burn): a row for each lot of jobs. Jobs that have the keys
    are those of their series, others those of every series."""
    own = [k for k in keys if k in jobs.columns]
    listed = jobs.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("spec_id", "origin", "spec_order", "seasonal_order"))).alias("all")).where("size(all) > 0")
    met = series.join(listed, own) if own else series.crossJoin(F.broadcast(listed))  # one row, a handful of jobs
    burn = F.array_max(F.transform("all", lambda j: j["spec_order"][1] + SEASON * j["seasonal_order"][1])).alias("burn")
    lots = F.explode(F.expr(f"transform(sequence(0, (size(all) - 1) div {lot}), i -> slice(all, i * {lot} + 1, {lot}))")).alias("jobs")
    return met.select(*series.columns, lots, burn)


def forecast_sarima(df: DataFrame, keys: Sequence[str], value: str, jobs: DataFrame, steps: int = 12, month: str = "month") -> DataFrame:
    """``jobs`` (spec_id, spec_order, seasonal_order, origin), a row for each fit that
    every series gets (or, with the keys, that one series gets); returns (keys, spec_id, origin, h, month, predicted, std_error,
    lower, upper, aic, bic, converged, training_months). A fit learns from the values
    up to its origin. Where it fails (a series too short for a spec) there is one row
    with null figures and a ``reason``."""
    lots = dealt(packed(df, keys, value, month), keys, jobs)
    figures = ["h", "predicted", "std_error", "aic", "bic", "converged", "training_months", "reason"]
    columns = [*keys, "spec_id", "origin", *figures]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                months, values = np.array(row["months"], "datetime64[D]"), np.array(row["values"], float)
                for job in row["jobs"]:
                    train = values[months <= np.datetime64(job["origin"], "D")]
                    head = [*[row[k] for k in keys], job["spec_id"], job["origin"]]
                    if not len(train):
                        continue
                    try:
                        fit = fit_sarima(train, list(job["spec_order"]), list(job["seasonal_order"]), int(row["burn"]))
                    except ValueError as e:
                        out.append([*head, None, None, None, None, None, None, len(train), str(e)])
                        continue
                    mean, se = fit.forecast(steps)
                    out += [[*head, h + 1, mean[h], se[h], fit.aic, fit.bic, fit.converged, len(train), None] for h in range(steps)]
            yield pd.DataFrame(out, columns=columns).astype({"h": "Int32", "training_months": "Int64"})

    kinds = "".join(f"`{k}` {lots.schema[k].dataType.simpleString()}, " for k in keys) + f"spec_id {jobs.schema['spec_id'].dataType.simpleString()}, origin date, "
    # few and small rows, each of them much work: a number of partitions that stays
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = lots.repartition(tasks, *keys, F.xxhash64("jobs"))
    out = spread.mapInPandas(run, kinds + "h int, predicted double, std_error double, aic double, bic double, converged boolean, training_months long, reason string")
    band = 1.959963984540054 * F.col("std_error")
    return out.select(*keys, "spec_id", "origin", "h", F.add_months("origin", F.col("h")).alias(month), "predicted", "std_error", (F.col("predicted") - band).alias("lower"), (F.col("predicted") + band).alias("upper"), "aic", "bic", "converged", "training_months", "reason")


def tuning_scores(df: DataFrame, keys: Sequence[str], value: str, years: Sequence[int], candidates: Sequence = CANDIDATES, month: str = "month") -> DataFrame:
    """(keys, spec_id, year, rmse, mae, smape, bias, aic, bic, converged,
    training_months, reason): every candidate on every tuning year, all fits as tasks at
    once; a fit that failed has null figures and a reason."""
    from .metrics import metric_columns
    from .samples import folds

    spark = df.sparkSession
    years_df = folds(spark, years)
    jobs = specs(spark, candidates).crossJoin(years_df)  # candidates by years: a few rows
    found = forecast_sarima(df, keys, value, jobs.drop("year"), month=month)
    actual = df.select(*keys, month, F.col(value).alias("actual")).where("actual IS NOT NULL")
    # a fit's rows meet their months, and the one row of a failed fit nothing
    facts = found.join(actual, [*keys, month], "left").where("actual IS NOT NULL OR reason IS NOT NULL")
    one = {c: F.first(c) for c in ("aic", "bic", "converged", "training_months", "reason")}
    return facts.withColumn("year", F.year("origin") + 1).groupBy(*keys, "spec_id", "year").agg(*[c.alias(n) for n, c in (metric_columns() | one).items()])


def tuned(scores: DataFrame, keys: Sequence[str], candidates: Sequence = CANDIDATES) -> DataFrame:
    """(keys, spec_id, spec_order, seasonal_order): of each series the candidate of least
    mean error over the tuning years, by rmse, then mae, then its place."""
    means = scores.where("rmse IS NOT NULL").groupBy(*keys, "spec_id").agg(F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"))
    best = means.groupBy(*keys).agg(F.min(F.struct("rmse", "mae", "spec_id")).alias("best")).select(*keys, F.col("best.spec_id").alias("spec_id"))
    return best.join(specs(scores.sparkSession, candidates), "spec_id").select(*keys, "spec_id", "spec_order", "seasonal_order")
