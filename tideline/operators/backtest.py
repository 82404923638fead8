"""Rolling-origin backtests: every fold forecasts the twelve months after its origin
from what was known there, with every model, as one long table of facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru, metrics, samples, sarima

SARIMA, RECURRENT, NAIVE = "SARIMA", "GRU", "Seasonal naive"
#: The naive forecast is a yardstick and cannot win; a tie goes to the first.
ELIGIBLE = (SARIMA, RECURRENT)


def naive_forecasts(df: DataFrame, keys: Sequence[str], target: str, fold: DataFrame, month: str = "month") -> DataFrame:
    """(keys, year, month, predicted): the value of a year before, for fold months."""
    shifted = df.select(*keys, F.add_months(month, 12).alias(month), F.col(target).alias("predicted")).where("predicted IS NOT NULL")
    return shifted.withColumn("year", F.year(month)).join(F.broadcast(fold.select("year")), "year").select(*keys, "year", month, "predicted")


def sarima_forecasts(df: DataFrame, keys: Sequence[str], target: str, fold: DataFrame, candidates: Sequence | DataFrame, month: str = "month") -> DataFrame:
    """``candidates`` are specs for every series, or a frame of specs with their keys."""
    of = candidates if isinstance(candidates, DataFrame) else sarima.specs(df.sparkSession, candidates)
    jobs = of.crossJoin(F.broadcast(fold))  # a handful of folds
    found = sarima.forecast_sarima(df, keys, target, jobs.drop("year"), month=month)
    return found.select(*keys, (F.year("origin") + 1).alias("year"), month, "predicted")


def recurrent_forecasts(channels: DataFrame, keys: Sequence[str], names: Sequence[str], target: str, fold: DataFrame, context: int, horizon: int = 12, month: str = "month", **options) -> tuple[DataFrame, DataFrame]:
    """Forecasts (keys, year, month, predicted) and the models: one for each fold and
    group of series, trained on samples whose label window ended by the origin."""
    blocks = samples.packed_blocks(channels, keys, names, target, context, horizon, month)
    models = gru.train_blocks(blocks, fold, keys, context, horizon, **options)
    at = samples.contexts(channels, keys, names, context, month).join(F.broadcast(fold), "origin")
    found = gru.predict(at, models, ["year"], [*keys, "year", "origin"], keys)
    return found.select(*keys, "year", F.add_months("origin", F.col("h")).alias(month), "predicted"), models


def facts(df: DataFrame, keys: Sequence[str], target: str, forecasts: dict[str, DataFrame], month: str = "month") -> DataFrame:
    """(keys, month, forecast_year, model, actual, predicted, residual) of all models,
    where the month was observed."""
    out = None
    for model, found in forecasts.items():
        part = found.select(*keys, month, F.col("year").alias("forecast_year"), F.lit(model).alias("model"), "predicted")
        out = part if out is None else out.unionByName(part)
    actual = df.select(*keys, month, F.col(target).alias("actual")).where("actual IS NOT NULL")
    return out.join(actual, [*keys, month]).withColumn("residual", F.col("actual") - F.col("predicted")).select(*keys, month, "forecast_year", "model", "actual", "predicted", "residual")


def choose(scores: DataFrame) -> DataFrame:
    return metrics.winner(scores, ELIGIBLE)


def selected_forecast(chosen: DataFrame, forecasts: DataFrame) -> DataFrame:
    """The rows of ``forecasts`` whose model won; the winner is one row."""
    return forecasts.join(F.broadcast(chosen.select(F.col("winner").alias("model"))), "model")


def candidates_table(forecasts: DataFrame, chosen: DataFrame, month: str = "month") -> DataFrame:
    """(year_month, a column for each eligible model, selected_model)."""
    wide = forecasts.groupBy(F.date_format(month, "yyyy-MM").alias("year_month")).pivot("model", list(ELIGIBLE)).agg(F.first("predicted"))
    return wide.crossJoin(F.broadcast(chosen.select(F.col("winner").alias("selected_model"))))  # one row


def pattern_check(actual: DataFrame, predicted: DataFrame, year: int, month: str = "month", value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """A row for each series: the fall from June to October in the year before and in
    the forecast."""

    def fall(df: DataFrame, y: int, name: str) -> DataFrame:
        at = lambda m: F.max(F.when((F.year(month) == y) & (F.month(month) == m), F.col(value)))
        return df.groupBy(*keys).agg(at(6).alias(f"{name}_june"), at(10).alias(f"{name}_october"), (at(6) - at(10)).alias(f"{name}_drop"))

    before, ahead = fall(actual, year - 1, "actual"), fall(predicted, year, "forecast")
    return before.join(ahead, list(keys)) if keys else before.crossJoin(ahead)  # without keys one row each
