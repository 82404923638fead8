"""Forecast errors, residual autocorrelation and the choice of a winner."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .halo import by_blocks


def metric_columns(actual: str = "actual", predicted: str = "predicted") -> dict[str, Column]:
    """rmse, mae, smape (percent) and bias (over-forecasts are positive)."""
    error = F.col(predicted) - F.col(actual)
    return {"rmse": F.sqrt(F.avg(error * error)), "mae": F.avg(F.abs(error)), "smape": F.avg(X.smape_term(actual, predicted)), "bias": F.avg(error)}


def metric_set(facts: DataFrame, keys: Sequence[str] = (), actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return facts.groupBy(*keys).agg(*[c.alias(n) for n, c in metric_columns(actual, predicted).items()])


def autocorrelation(facts: DataFrame, keys: Sequence[str], order: str, value: str, ks: Sequence[int]) -> DataFrame:
    """(keys, acf_k): correlation of a series with itself k rows before; 0 where it is
    too short or constant on either side."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = facts.select(*keys, value, *[F.lag(value, k).over(w).alias(f"_b{k}") for k in ks])

    def acf(k: int) -> Column:
        both = F.col(f"_b{k}").isNotNull() & F.col(value).isNotNull()
        a, b = F.when(both, F.col(value)), F.when(both, F.col(f"_b{k}"))
        flat = F.coalesce((F.stddev_pop(a) < 1e-12) | (F.stddev_pop(b) < 1e-12), F.lit(True))
        return X.zero_if(flat, X.guarded_corr(a, b)).alias(f"acf_{k}")

    return rows.groupBy(*keys).agg(*[acf(k) for k in ks])


def backtest_aggregate(facts: DataFrame, model: str = "model", order: str = "month", ks: Sequence[int] = (1, 12), per_fold: Sequence[str] = ()) -> DataFrame:
    """Errors and residual autocorrelation of each model, pooled over folds (the
    residuals run on across them), or of each fold if ``per_fold`` names it."""
    keys = [model, *per_fold]
    residuals = facts.withColumn("_e", F.col("actual") - F.col("predicted"))
    return metric_set(facts, keys).join(autocorrelation(residuals, keys, order, "_e", ks), keys)


def winner(scores: DataFrame, eligible: Sequence[str], model: str = "model", score: str = "rmse") -> DataFrame:
    """One row: the eligible model of least score, the first listed on a tie."""
    place = F.array_position(F.array(*[F.lit(m) for m in eligible]), F.col(model))
    return scores.where(F.col(model).isin(list(eligible))).agg(F.min_by(model, F.struct(F.col(score), place)).alias("winner"), F.min(score).alias(score))


def best_specs(scores: DataFrame, spec: Sequence[str], by: Sequence[str] = ("rmse", "mae"), n: int = 1) -> DataFrame:
    """Mean scores of each spec over its folds, the best ``n`` first."""
    means = scores.groupBy(*spec).agg(*[F.avg(b).alias(b) for b in by])
    return means.orderBy(*[F.asc_nulls_last(b) for b in by], *spec).limit(n)


def extremes(df: DataFrame, keys: Sequence[str], month: str, value: str) -> DataFrame:
    """Peak and trough with their months; the first month on a tie."""
    early = -F.unix_date(month)
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(*keys).agg(
        F.max(value).alias("peak"),
        F.max_by(month, F.struct(F.col(value), early)).alias("peak_month"),
        F.min(value).alias("trough"),
        F.min_by(month, F.struct(F.col(value), F.unix_date(month))).alias("trough_month"),
    )


def seasonal_naive(df: DataFrame, keys: Sequence[str], target: str, month: str = "month") -> DataFrame:
    """``df`` (on a spine) with the value of the same month a year before."""
    return by_blocks(df, keys, 12, lambda rows, own: rows.withColumn("predicted", F.lag(target, 12).over(Window.partitionBy(*own).orderBy(month))), month=month)


def naive_year(df: DataFrame, keys: Sequence[str], target: str, year: int, month: str = "month") -> DataFrame:
    """(keys, month, predicted) for a year: the twelve values of the year before; an
    error if any series lacks one."""
    before = df.where((F.year(month) == year - 1) & F.col(target).isNotNull())
    there = (F.year(month) == year - 1) & F.col(target).isNotNull()
    short = df.groupBy(*keys).agg(F.count_if(there).alias("n")).where("n <> 12").first()
    if short is not None:
        raise ValueError(f"the year before {year} has not twelve values: {short.asDict()}")
    return before.select(*keys, F.add_months(month, 12).alias(month), F.col(target).alias("predicted"))


def prediction_faults(predictions: DataFrame, first: str, horizon: int = 12, month: str = "year_month", value: str = "forecast") -> DataFrame:
    """Rows (fault, year_month) for each breach of the contract: months as text, each
    once, none missing or foreign, and finite values."""
    spark = predictions.sparkSession
    wanted = spark.range(horizon).select(F.date_format(F.add_months(F.lit(first).cast("date"), F.col("id").cast("int")), "yyyy-MM").alias(month))
    counted = predictions.groupBy(month).agg(F.count(F.lit(1)).alias("n"))
    fault = lambda df, text: df.select(F.lit(text).alias("fault"), F.col(month))
    v = F.col(value)
    return (
        fault(wanted.join(counted, month, "left_anti"), "missing month")
        .unionByName(fault(counted.join(wanted, month, "left_anti"), "foreign month"))
        .unionByName(fault(counted.where("n > 1"), "repeated month"))
        .unionByName(fault(predictions.where(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), "no finite value"))
    )


def assert_contract(predictions: DataFrame, first: str, horizon: int = 12, month: str = "year_month", value: str = "forecast") -> DataFrame:
    if predictions.columns != [month, value]:
        raise ValueError(f"columns {predictions.columns}")
    bad = prediction_faults(predictions, first, horizon, month, value).first()
    if bad is not None:
        raise ValueError(str(bad.asDict()))
    return predictions


def submission(predictions: DataFrame, month: str, value: str, digits: int = 6) -> DataFrame:
    """(year_month, forecast) rounded half to even, in order of month."""
    return predictions.select(X.month_text(month).alias("year_month"), F.bround(value, digits).alias("forecast")).orderBy("year_month")
