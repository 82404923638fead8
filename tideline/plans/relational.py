"""Queries: roll-up, calendars, joins, reshaping, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import calendar, reshape, rollup
from ..sources import sources
from .base import DAILY_SQL, GRID_SQL, PANEL_SQL, SHIPPED_SQL, daily, grid, panel, query, shipped

ROLLUP = "mean median std min max range cv month_return trend_per_day late_minus_early abs_daily_move_mean abs_daily_move_max intraday_spread_mean".split()


def rollup_sql(daily_sql: str) -> str:
    """The monthly statistics of ``daily`` (series, date, close, high, low)."""
    return f"""WITH {daily_sql},
r AS (SELECT *, CAST(date_trunc('month', date) AS DATE) AS month,
    row_number() OVER w - 1 AS i, lag(close) OVER w AS p, (high - low) / nullif(close, 0) AS s
  FROM daily WINDOW w AS (PARTITION BY series, date_trunc('month', date) ORDER BY date)),
m AS (SELECT *, close / nullif(p, 0) - 1 AS ret FROM r)
SELECT series, month, avg(close) AS shipping_mean, median(close) AS shipping_median, stddev_pop(close) AS shipping_std,
  min(close) AS shipping_min, max(close) AS shipping_max, max(close) - min(close) AS shipping_range,
  CASE WHEN avg(close) = 0 THEN 0.0 ELSE stddev_pop(close) / avg(close) END AS shipping_cv,
  CASE WHEN min_by(close, i) = 0 THEN 0.0 ELSE max_by(close, i) / min_by(close, i) - 1 END AS shipping_month_return,
  CASE WHEN count(*) > 1 THEN regr_slope(close, i) ELSE 0.0 END AS shipping_trend_per_day,
  CASE WHEN count(*) FILTER (day(date) > 15) = 0 OR count(*) FILTER (day(date) <= 15) = 0 THEN 0.0
       ELSE avg(close) FILTER (day(date) > 15) - avg(close) FILTER (day(date) <= 15) END AS shipping_late_minus_early,
  coalesce(avg(abs(ret)), 0) AS shipping_abs_daily_move_mean, coalesce(max(abs(ret)), 0) AS shipping_abs_daily_move_max,
  count(*) FILTER (ret >= 0.03) AS shipping_extreme_up_days, count(*) FILTER (ret <= -0.03) AS shipping_extreme_down_days,
  avg(coalesce(s, 0)) AS shipping_intraday_spread_mean, count(*) AS shipping_trading_days
FROM m GROUP BY series, month"""


ROLLUP_OUT = {
    "exact": "series month shipping_extreme_up_days shipping_extreme_down_days shipping_trading_days",
    "doubles": " ".join(f"shipping_{n}" for n in ROLLUP),
}


@query(rollup_sql(DAILY_SQL), **ROLLUP_OUT)
def daily_to_monthly_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.daily_to_monthly(daily(spark, sf_dir), ["series"])


@query(f"WITH {GRID_SQL} SELECT area, month FROM spine", exact="area month")
def calendar_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.spine(panel(spark, sf_dir), ["area"])


@query("SELECT CAST(unnest(generate_series(DATE '2000-01-01', DATE '2023-12-01', INTERVAL 1 MONTH)) AS DATE) AS month", exact="month")
def calendar_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.months(spark, "2000-01-01", "2023-12-01")


@query(f"WITH {PANEL_SQL}, e AS (SELECT area, max(month) AS last FROM panel GROUP BY area) SELECT area, CAST(last + to_months(CAST(h AS INT)) AS DATE) AS month, CAST(h AS INT) AS h FROM e, range(1, 13) t(h)", exact="area month h")
def future_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.future_months(panel(spark, sf_dir), 12, ["area"])


@query("SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, strftime(o_orderdate, '%Y-%m') AS month_text FROM orders", exact="o_orderkey month month_text")
def month_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = sources.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", X.month_start("o_orderdate").alias("month"), X.month_text("o_orderdate").alias("month_text"))


@query("SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round_even(avg(o_totalprice / 1e3), 2) AS value FROM orders GROUP BY 1, 2", exact="series month", doubles="value")
def monthly_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = sources.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series"), "o_orderdate", (F.col("o_totalprice") / 1e3).alias("value"))
    return rollup.monthly_mean(o, ["series"], "o_orderdate", "value")


@query(
    f"""WITH {GRID_SQL}, {SHIPPED_SQL}
SELECT area, month, total, mean, orders, price, discount FROM grid LEFT JOIN shipped USING (month)""",
    exact="area month orders", doubles="total mean price discount",
)
def spine_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.left_join_all(grid(spark, sf_dir), [calendar.assert_unique(shipped(spark, sf_dir), ["month"])], ["month"]).select("area", "month", "total", "mean", "orders", "price", "discount")


@query(
    f"""WITH {SHIPPED_SQL}, o AS (SELECT strftime(o_orderdate, '%Y-%m') AS year_month, count(*) AS orders FROM orders GROUP BY 1),
e AS (SELECT strftime(ts, '%Y-%m') AS year_month, count(*) AS events FROM events GROUP BY 1),
s AS (SELECT strftime(month, '%Y-%m') AS year_month, price FROM shipped)
SELECT year_month, orders, price, events FROM o FULL JOIN s USING (year_month) FULL JOIN e USING (year_month)""",
    exact="year_month orders events", doubles="price",
)
def full_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = sources.table(spark, sf_dir, "orders").groupBy(X.month_text("o_orderdate").alias("year_month")).agg(F.count(F.lit(1)).alias("orders"))
    e = sources.table(spark, sf_dir, "events").groupBy(X.month_text("ts").alias("year_month")).agg(F.count(F.lit(1)).alias("events"))
    s = shipped(spark, sf_dir).select(X.month_text("month").alias("year_month"), "price")
    return calendar.outer_merge([o, s, e], ["year_month"])


@query(
    f"""WITH {PANEL_SQL} SELECT month, {", ".join(f"max(total) FILTER (area = '{a}') AS {a.replace(' ', '_').lower()}" for a in ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'))} FROM panel GROUP BY month""",
    exact="month", doubles="africa america asia europe middle_east",
)
def pivot_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = panel(spark, sf_dir).select("month", F.lower(F.replace("area", F.lit(" "), F.lit("_"))).alias("area"), "total")
    return reshape.strict_pivot(named, ["month"], "area", "total", ["africa", "america", "asia", "europe", "middle_east"])


@query(
    f"""WITH {PANEL_SQL} SELECT area, month, code, v AS value FROM (
  SELECT area, month, 'total' AS code, total AS v FROM panel UNION ALL SELECT area, month, 'mean', mean FROM panel)""",
    exact="area month code", doubles="value",
)
def unpivot_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.melt(panel(spark, sf_dir).select("area", "month", "total", "mean"), ["area", "month"], ["total", "mean"])


@query(f"WITH {PANEL_SQL} SELECT area, month, total, mean FROM panel", exact="area month", doubles="total mean")
def pivot_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.pivot_first(unpivot_codes(spark, sf_dir), ["area", "month"], "code", "value", ["total", "mean"])


@query(
    f"""WITH {PANEL_SQL}, y AS (SELECT year(month) AS y, sum(total) AS total, CAST(sum(orders) AS DOUBLE) AS orders FROM panel WHERE year(month) IN (1996, 1997) GROUP BY 1)
SELECT 'total' AS metric, max(total) FILTER (y = 1996) AS y1996, max(total) FILTER (y = 1997) AS y1997 FROM y
UNION ALL SELECT 'orders', max(orders) FILTER (y = 1996), max(orders) FILTER (y = 1997) FROM y""",
    exact="metric", doubles="y1996 y1997",
)
def transpose_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = panel(spark, sf_dir).where(F.year("month").isin(1996, 1997)).groupBy(F.concat(F.lit("y"), F.year("month").cast("string")).alias("y")).agg(F.sum("total").alias("total"), F.sum("orders").cast("double").alias("orders"))
    return reshape.transpose(y, "y", ["total", "orders"], ["y1996", "y1997"])


@query(f"WITH {PANEL_SQL} SELECT area, month, total FROM panel WHERE area NOT IN ('ASIA')", exact="area month", doubles="total")
def exclude_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.exclude(panel(spark, sf_dir), "area", ["ASIA"]).select("area", "month", "total")


@query(
    """WITH d AS (SELECT l_orderkey, l_returnflag, l_linestatus FROM lineitem)
SELECT (SELECT count(*) FROM d) AS n_rows, (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS n_duplicates""",
    exact="n_rows n_duplicates",
)
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.exact_duplicates(sources.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus"))


@query("SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem", exact="l_orderkey l_returnflag l_linestatus")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.without_exact_duplicates(sources.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus"))


@query("SELECT o_custkey, o_orderdate, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1", exact="o_custkey o_orderdate o_orderkey")
def distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.first_by_key(sources.table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(
    "SELECT 'o_orderpriority' AS \"column\", o_orderpriority AS value FROM orders WHERE o_orderpriority IS NOT NULL UNION SELECT 'o_orderstatus', o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL UNION SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey IS NOT NULL",
    exact='"column" value',
)
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two columns with few values and one with many."""
    return rollup.distinct_values(sources.table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus", "o_custkey"])


@query(
    """WITH v AS (SELECT DISTINCT 'o_orderpriority' AS c, o_orderpriority AS value FROM orders UNION SELECT 'o_orderdate', CAST(CAST(o_orderdate AS DATE) AS VARCHAR) FROM orders), r AS (SELECT c, value, row_number() OVER (PARTITION BY c ORDER BY value) AS i, count(*) OVER (PARTITION BY c) AS n FROM v WHERE value IS NOT NULL)
SELECT c AS "column", any_value(n) AS n, list(value ORDER BY value) FILTER (i <= 10) AS first FROM r GROUP BY c""",
    exact='"column" n first',
)
def distinct_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten; the limit is the feature."""
    orders = sources.table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    return rollup.distinct_preview(orders, ["o_orderpriority", "o_orderdate"], 10)


@query(
    "SELECT count(*) AS n_rows, min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date, count(o_totalprice) AS n_o_totalprice, count(o_custkey) AS n_o_custkey FROM orders",
    exact="n_rows first_date last_date n_o_totalprice n_o_custkey",
)
def source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = sources.table(spark, sf_dir, "orders").withColumn("date", F.col("o_orderdate").cast("date"))
    return rollup.source_audit(o, "date", ["o_totalprice", "o_custkey"])


@query(
    """WITH d AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
SELECT e.event_id, max(d.ts) AS last_purchase FROM events e LEFT JOIN d ON d.user_id = e.user_id AND d.ts <= e.ts GROUP BY e.event_id""",
    exact="event_id last_purchase",
)
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sources.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    d = sources.table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "ts", F.col("ts").alias("last_purchase"))
    return calendar.as_of(e, d, ["user_id"], "ts", ["last_purchase"]).select("event_id", "last_purchase")


@query(
    f"""WITH {GRID_SQL}, u AS (SELECT area, month, total * 2 AS total FROM panel WHERE year(month) = 1997)
SELECT g.area, g.month, coalesce(u.total, g.total) AS total FROM grid g LEFT JOIN u USING (area, month)""",
    exact="area month", doubles="total",
)
def overlay_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir).select("area", "month", "total")
    return calendar.overlay(g, panel(spark, sf_dir).where(F.year("month") == 1997).withColumn("total", F.col("total") * 2), ["area", "month"], "total")


@query(
    "SELECT p_partkey, nullif(regexp_extract(p_name || p_brand, '(1[234]|2[345])', 1), '') AS code, lower(p_type) || '_' || p_brand AS label FROM part",
    exact="p_partkey code label",
)
def indicator_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sources.table(spark, sf_dir, "part")
    return p.select("p_partkey", X.indicator_code(F.concat("p_name", "p_brand"), ["1[234]", "2[345]"]).alias("code"), F.concat(F.lower("p_type"), F.lit("_"), "p_brand").alias("label"))


@query(
    f"""WITH {GRID_SQL} SELECT 'duplicate' AS fault, count(*) AS n FROM (SELECT area, month FROM grid GROUP BY 1, 2 HAVING count(*) > 1)""",
    exact="fault n",
)
def uniqueness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.duplicate_keys(grid(spark, sf_dir), ["area", "month"]).agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate").alias("fault"), "n")


@query(
    """SELECT event_type, CAST(ts AS DATE) AS date, avg(value) AS close, max(value) AS high, min(value) AS low, count(value) AS n FROM events GROUP BY 1, 2""",
    exact="event_type date n", doubles="close high low",
)
def daily_event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.daily import daily_bars

    return daily_bars(sources.table(spark, sf_dir, "events"), ["event_type"], "ts", "value")


@query(rollup_sql("daily AS (SELECT event_type AS series, CAST(ts AS DATE) AS date, avg(value) AS close, max(value) AS high, min(value) AS low FROM events GROUP BY 1, 2)"), **ROLLUP_OUT)
def monthly_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of events as a stream: what there is runs through the upsert of monthly
    figures, which are read back."""
    from ..sources.storage import shared_dir
    from ..streaming.monthly import MonthlyTable

    events = sources.table(spark, sf_dir, "events").select("ts", "event_type", "value")
    root = shared_dir(spark, "monthly")
    kept = MonthlyTable(spark, root, ["series"], "ts", "value", prefix="shipping")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*").withColumnRenamed("event_type", "series")
    kept.run(stream, f"{root}/checkpoint").awaitTermination()
    return kept.read()
