"""Calendars without gaps, and joins onto them. A shift by rows is a shift by months
only on such a spine, so every lag is taken after :func:`spine`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def months(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(month): every month start from first to last."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("INTERVAL 1 MONTH"))).alias("month"))


def future_months(df: DataFrame, horizon: int, keys: Sequence[str] = (), month: str = "month") -> DataFrame:
    """(keys, month, h): the next ``horizon`` months after the last of each series."""
    last = df.groupBy(*keys).agg(F.max(month).alias("last")).where("last IS NOT NULL")
    return last.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"), "last").select(*keys, F.add_months(F.col("last"), F.col("h")).alias(month), "h")


def spine(df: DataFrame, keys: Sequence[str] = (), month: str = "month") -> DataFrame:
    """(keys, month): all months from the first to the last of each series."""
    ends = df.groupBy(*keys).agg(F.min(month).alias("first"), F.max(month).alias("last")).where("first IS NOT NULL")
    return ends.select(*keys, F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 MONTH"))).alias(month))


def on_spine(df: DataFrame, keys: Sequence[str] = (), month: str = "month") -> DataFrame:
    """``df`` with a row for each month of a series; what was not there is null."""
    on = [*keys, month]
    following = F.lead(month).over(Window.partitionBy(*keys).orderBy(month))
    last = F.greatest(F.col(month), F.add_months("_next", -1))  # the month before the next row's
    rows = df.where(F.col(month).isNotNull()).withColumn("_next", following).select("*", F.explode(F.sequence(month, F.coalesce(last, F.col(month)), F.expr("INTERVAL 1 MONTH"))).alias("_month"))
    return rows.select(*keys, F.col("_month").alias(month), *[F.when(F.col("_month") == F.col(month), F.col(c)).alias(c) for c in df.columns if c not in on])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that stand in more than one row, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df``, once no key is found twice."""
    bad = duplicate_keys(df, keys).first()
    if bad is not None:
        raise ValueError(f"duplicate key {bad.asDict()}")
    return df


def left_join_all(base: DataFrame, others: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Each of ``others`` joined to the left of ``base``; keys are to be unique there."""
    for other in others:
        base = base.join(other, list(on), "left")
    return base


def outer_merge(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """All frames joined fully on the same keys."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, list(on), "full")
    return out


def must_match(wanted: DataFrame, df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` at the wanted keys; an error if any key is missing."""
    missing = wanted.join(df, list(on), "left_anti").first()
    if missing is not None:
        raise KeyError(f"no row for {missing.asDict()}")
    return wanted.join(df, list(on))


def overlay(base: DataFrame, update: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """``value`` of ``update`` where it has one, else that of ``base``."""
    new = update.select(*on, F.col(value).alias("_new"))
    return base.join(new, list(on), "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """``left`` with the latest values of ``right`` at or before ``time``: both sides
    go through one window over a union, so there is no join by inequality."""
    a = left.withColumns({"_side": F.lit(1), **{f"_{v}": F.lit(None).cast(right.schema[v].dataType) for v in values}})
    b = right.select(*keys, time, *[F.col(v).alias(f"_{v}") for v in values]).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumns({f"_{v}": F.last(f"_{v}", ignorenulls=True).over(w) for v in values}).where("_side = 1")
    return got.select(*left.columns, *[F.col(f"_{v}").alias(v) for v in values])
