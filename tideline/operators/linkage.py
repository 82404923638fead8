"""How series of different areas hang together, and what a forecast means ahead."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import regression
from .features import by_month
from .halo import by_blocks


def indicator(df: DataFrame, keys: Sequence[str], name: str, columns: Sequence[str], as_yoy: bool = False, month: str = "month") -> DataFrame:
    """``df`` with the mean of columns, or of their changes on a year in percent (the
    relative changes are averaged first)."""
    if not as_yoy:
        return df.withColumn(name, X.row_mean([F.col(c) for c in columns]))

    def f(rows: DataFrame, own: list[str]) -> DataFrame:
        w = by_month(own, month)
        return rows.withColumn(name, X.row_mean([X.pct_change(c, 12, w) for c in columns]) * 100)

    return by_blocks(df, keys, 12, f, month=month)


def linkages(df: DataFrame, keys: Sequence[str], target: str, drivers: Sequence[str], indicators: Sequence[str], month: str = "month") -> dict[str, DataFrame]:
    """The regression on own and drivers' last values, the correlations, the causality
    tests of drivers, and each indicator's regression and test."""
    rows = regression.lagged(df, keys, [target, *drivers], [1], month)
    out = {"regression": regression.ols(rows, keys, target, [f"{c}_lag1" for c in (target, *drivers)]), "correlations": regression.correlations(df, keys, target, [*drivers, *indicators])}
    for d in drivers:
        out[f"granger_{d}"] = regression.granger(df, keys, target, d, month=month)
    for i in indicators:
        out[f"regression_{i}"], out[f"granger_{i}"] = regression.indicator_relationship(df, keys, target, i, month)
    return out


def regional_projection(df: DataFrame, forecast: DataFrame, keys: Sequence[str], reused: Sequence[str], month: str = "month") -> DataFrame:
    """The forecast's months with the values of the year before reused for others."""
    before = df.select(*keys, F.add_months(month, 12).alias(month), *reused)
    return forecast.join(before, [*keys, month], "left")


def forward_pressure(projection: DataFrame, keys: Sequence[str], value: str, regional: Sequence[str], threshold: float = 10.0, month: str = "month") -> DataFrame:
    """Mean, peak and trough with their months, months at or over a threshold, means of
    both halves and their difference, the last value, and the regional mean."""
    early = -F.unix_date(month)
    half = lambda first: F.avg(F.when((F.month(month) <= 6) if first else (F.month(month) > 6), F.col(value)))
    rows = projection.withColumn("_region", X.row_mean(list(regional)) if regional else F.lit(None).cast("double"))
    known = F.col(value).isNotNull()
    return rows.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.max(value).alias("peak"),
        X.month_text(F.max_by(month, F.when(known, F.struct(F.col(value), early)))).alias("peak_month"),
        F.min(value).alias("trough"),
        X.month_text(F.min_by(month, F.when(known, F.struct(F.col(value), F.unix_date(month))))).alias("trough_month"),
        F.count_if(F.col(value) >= threshold).alias("months_over"),
        half(True).alias("first_half_mean"),
        half(False).alias("second_half_mean"),
        (half(True) - half(False)).alias("easing"),
        F.max_by(value, month).alias("last"),
        F.avg("_region").alias("regional_mean"),
    )
