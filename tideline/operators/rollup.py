"""Daily observations rolled up to sixteen monthly statistics.

One window pass (ordered by day within series and month) and one grouped aggregate
on the same keys, so the rows are shuffled once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import month_start, safe_div, zero_if

#: Daily moves from which a day counts as extreme, both ways.
EXTREME = 0.03


def without_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def exact_duplicates(df: DataFrame) -> DataFrame:
    """(n_rows, n_duplicates): rows that repeat another in all columns."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("n_duplicates"))


def daily_to_monthly(df: DataFrame, keys: Sequence[str] = (), date: str = "date", close: str = "close", high: str = "high", low: str = "low", prefix: str = "shipping") -> DataFrame:
    """(keys, month, sixteen statistics named after ``prefix``).

    A return within a month is against the last close before it in that month; the
    trend is the slope on the ordinal of the trading day, 0 for one day and null if
    any close is missing; first and last closes are those of the first and last day,
    missing or not."""
    rows = df.select(*keys, F.col(date).cast("date").alias("_d"), F.col(close).alias("_c"), F.col(high).alias("_h"), F.col(low).alias("_l")).withColumn("month", month_start("_d"))
    order = Window.partitionBy(*keys, "month").orderBy("_d", "_c", "_h", "_l")
    filled = F.last("_c", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    before = F.last("_c", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select(*keys, "month", "_d", "_c", (safe_div(filled, before) - 1).alias("_r"), safe_div(F.col("_h") - F.col("_l"), "_c").alias("_s"), (F.row_number().over(order) - 1).cast("double").alias("_i"))
    late, early = F.dayofmonth("_d") > 15, F.dayofmonth("_d") <= 15
    first, last = F.min_by("_c", "_i"), F.max_by("_c", "_i")
    mean, std = F.avg("_c"), F.stddev_pop("_c")
    slope = F.when(F.count(F.lit(1)) <= 1, 0.0).when(F.count("_c") == F.count(F.lit(1)), F.regr_slope("_c", "_i"))
    halves = F.when((F.count_if(late) == 0) | (F.count_if(early) == 0), 0.0).otherwise(F.avg(F.when(late, F.col("_c"))) - F.avg(F.when(early, F.col("_c"))))
    named = {
        "mean": mean,
        "median": F.median("_c"),
        "std": std,
        "min": F.min("_c"),
        "max": F.max("_c"),
        "range": F.max("_c") - F.min("_c"),
        "cv": zero_if(mean == 0, safe_div(std, mean)),
        "month_return": zero_if(first == 0, safe_div(last, first) - 1),
        "trend_per_day": slope,
        "late_minus_early": halves,
        "abs_daily_move_mean": F.coalesce(F.avg(F.abs("_r")), F.lit(0.0)),
        "abs_daily_move_max": F.coalesce(F.max(F.abs("_r")), F.lit(0.0)),
        "extreme_up_days": F.count_if(F.col("_r") >= EXTREME),
        "extreme_down_days": F.count_if(F.col("_r") <= -EXTREME),
        "intraday_spread_mean": F.avg(F.coalesce("_s", F.lit(0.0))),
        "trading_days": F.count(F.lit(1)),
    }
    return rows.groupBy(*keys, "month").agg(*[c.alias(f"{prefix}_{n}") for n, c in named.items()])


def monthly_mean(df: DataFrame, keys: Sequence[str], date: str, value: str, digits: int = 2) -> DataFrame:
    """The plain monthly mean, rounded half to even."""
    return df.groupBy(*keys, month_start(date).alias("month")).agg(F.bround(F.avg(value), digits).alias(value))


def source_audit(df: DataFrame, date: str, values: Sequence[str]) -> DataFrame:
    """One row: n_rows, first and last date, and the non-null count of each value."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), *[F.count(v).alias(f"n_{v}") for v in values])


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value): the distinct values of each column, as text, nulls left out; sorted
    over ranges, so no task or row holds all values of a column."""
    long = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    return long.where("value IS NOT NULL").distinct().repartitionByRange("column", "value").sortWithinPartitions("column", "value")


def distinct_preview(df: DataFrame, columns: Sequence[str], most: int = 100) -> DataFrame:
    """One row for each column: n, and the first ``most`` of its distinct values in order.
    The first values are taken in every task before they meet."""
    out = None
    for c in columns:
        values = df.select(F.col(f"`{c}`").alias("value")).where("value IS NOT NULL").distinct()
        first = values.orderBy("value").limit(most).agg(F.array_sort(F.collect_list(F.col("value").cast("string"))).alias("first"))  # most rows
        row = values.agg(F.count(F.lit(1)).alias("n")).crossJoin(first).select(F.lit(c).alias("column"), "n", "first")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key, the first in the given order: a grouped minimum over the
    whole row, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    ordered = [*order, *[c for c in rest if c not in order]]
    best = df.groupBy(*keys).agg(F.min(F.struct(*ordered)).alias("_row"))
    return best.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def target_identity(df: DataFrame, keys: Sequence[str], target: str, index: str, month: str = "month") -> DataFrame:
    """One row: how far a target (on a spine) is from the year-on-year change of an index."""
    from ..functions.exprs import yoy
    from .halo import by_blocks

    def f(rows: DataFrame, own: list[str]) -> DataFrame:
        return rows.select(*own, month, F.abs(F.col(target) - yoy(index, Window.partitionBy(*own).orderBy(month))).alias("gap"))

    return by_blocks(df, keys, 12, f, month=month).agg(F.max("gap").alias("max_abs_gap"), F.avg("gap").alias("mean_abs_gap"), F.count("gap").alias("n"))
