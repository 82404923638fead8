"""The driver's tables in the roles of the analytics, and how queries are listed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.calendar import on_spine
from ..sources import sources

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DIGITS = 9


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to some digits, so that sums in another order compare equal."""
    return df.select(*[(F.round(f.name, digits) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


def query(sql: str | None = None, exact: str = "", doubles: str = "", digits: int = DIGITS):
    """List a function as a query under its name. ``sql`` is its equivalent; of its
    columns ``doubles`` are rounded as the query's are and ``exact`` left."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            columns = ", ".join([*exact.split(), *[f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles.split()]])
            SQL[f.__name__] = f"SELECT {columns} FROM (\n{sql}\n)"
        return f

    return add


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, date, close, high, low): order values in thousands, by priority."""
    df = sources.daily_orders(spark, sf_dir, ("o_orderpriority",))
    return df.select(F.col("o_orderpriority").alias("series"), "date", *[(F.col(c) / 1e3).alias(c) for c in ("close", "high", "low")])


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(area, month, total in millions, mean in thousands, orders)."""
    return sources.monthly_panel(spark, sf_dir).select("area", "month", (F.col("total") / 1e6).alias("total"), (F.col("mean") / 1e3).alias("mean"), "orders")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel on a spine without gaps."""
    return on_spine(panel(spark, sf_dir), ["area"])


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, price in thousands, discount in percent) of what was shipped."""
    items = sources.table(spark, sf_dir, "lineitem").select(F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("month"), "l_extendedprice", "l_discount")
    return items.groupBy("month").agg((F.avg("l_extendedprice") / 1e3).alias("price"), (F.avg("l_discount") * 100).alias("discount"))


DAILY_SQL = """daily AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date,
    avg(o_totalprice) / 1e3 AS close, max(o_totalprice) / 1e3 AS high, min(o_totalprice) / 1e3 AS low
  FROM orders GROUP BY 1, 2)"""

PANEL_SQL = """panel AS (SELECT r_name AS area, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
    sum(o_totalprice) / 1e6 AS total, avg(o_totalprice) / 1e3 AS mean, count(*) AS orders
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"""

GRID_SQL = PANEL_SQL + """,
ends AS (SELECT area, min(month) AS a, max(month) AS b FROM panel GROUP BY area),
spine AS (SELECT area, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS month FROM ends),
grid AS (SELECT area, month, total, mean, orders FROM spine LEFT JOIN panel USING (area, month))"""

SHIPPED_SQL = """shipped AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
    avg(l_extendedprice) / 1e3 AS price, avg(l_discount) * 100 AS discount FROM lineitem GROUP BY 1)"""

W = "(PARTITION BY area ORDER BY month)"


def lag_sql(c: str, k: int) -> str:
    return f"lag({c}, {k}) OVER {W}" if k else c


def yoy_sql(c: str) -> str:
    return f"({c} / nullif({lag_sql(c, 12)}, 0) - 1) * 100"


def rolling_sql(fn: str, c: str, n: int) -> str:
    frame = f"(PARTITION BY area ORDER BY month ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) OVER {frame} = {n} THEN {fn}({c}) OVER {frame} END"
