"""Queries: scalar functions, predicates, set operations and small joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import calendar, sarima
from ..operators.samples import folds
from ..sources import sources
from .base import GRID_SQL, PANEL_SQL, grid, panel, query


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.table(spark, sf_dir, "orders")


@query(
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(day(o_orderdate) AS INT) AS day, CAST(month(o_orderdate) AS INT) AS month, CAST(year(o_orderdate) AS INT) AS year,
  CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS next_month, make_date(year(o_orderdate) - 1, 12, 1) AS origin, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders""",
    exact="o_orderkey d day month year next_month origin iso",
)
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return orders(spark, sf_dir).select("o_orderkey", d.alias("d"), F.dayofmonth(d).alias("day"), F.month(d).alias("month"), F.year(d).alias("year"), F.add_months(X.month_start(d), 1).alias("next_month"), F.make_date(F.year(d) - 1, F.lit(12), F.lit(1)).alias("origin"), d.cast("string").alias("iso"))


@query(
    """SELECT p_partkey, lower(p_name) AS low, p_brand || '_' || p_type AS joined, starts_with(p_type, 'S') AS starts, sha256(p_name) AS sha,
  list_transform(string_split('1,0,12', ','), lambda v: CAST(v AS INT))[3] AS third, array_to_string([p_size, p_size + 1], ',') AS sizes FROM part""",
    exact="p_partkey low joined starts sha third sizes",
)
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sources.table(spark, sf_dir, "part")
    third = F.transform(F.split(F.lit("1,0,12"), ","), lambda v: v.cast("int"))[2]
    sizes = F.array_join(F.transform(F.array("p_size", F.col("p_size") + 1), lambda v: v.cast("string")), ",")
    return p.select("p_partkey", F.lower("p_name").alias("low"), F.concat("p_brand", F.lit("_"), "p_type").alias("joined"), F.startswith("p_type", F.lit("S")).alias("starts"), F.sha2("p_name", 256).alias("sha"), third.alias("third"), sizes.alias("sizes"))


@query(
    """WITH x AS (SELECT o_orderkey, (o_totalprice - 150000) / 7e3 AS v FROM orders)
SELECT o_orderkey, abs(v) AS absolute, sqrt(abs(v)) AS root, v * v AS square, CASE WHEN v >= 0 THEN v ELSE 0 END AS positive, ln(1 + greatest(v, 0)) AS log1p_clipped,
  least(greatest(v, 0), 1) AS unit, 1 / (1 + exp(-least(greatest(v, -30), 30))) AS sigmoid, CASE WHEN v > 5 THEN 'high' WHEN v < -5 THEN 'low' ELSE 'middle' END AS label FROM x""",
    exact="o_orderkey label", doubles="absolute root square positive log1p_clipped unit sigmoid",
)
def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = orders(spark, sf_dir).select("o_orderkey", ((F.col("o_totalprice") - 150000) / 7e3).alias("v"))
    v = F.col("v")
    return x.select("o_orderkey", F.abs(v).alias("absolute"), F.sqrt(F.abs(v)).alias("root"), (v * v).alias("square"), X.at_least_zero(v).alias("positive"), X.log1p_clipped(v).alias("log1p_clipped"), F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)).alias("unit"), X.sigmoid(v).alias("sigmoid"), F.when(v > 5, "high").when(v < -5, "low").otherwise("middle").alias("label"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity / 8, 2) AS two, round_even(l_quantity / 16, 3) AS three FROM lineitem", exact="l_orderkey l_linenumber", doubles="two three")
def round_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = sources.table(spark, sf_dir, "lineitem")
    return i.select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 8, 2).alias("two"), F.bround(F.col("l_quantity") / 16, 3).alias("three"))


@query("SELECT o_orderkey, o_totalprice / nullif(o_custkey % 3, 0) AS ratio, coalesce(o_totalprice / nullif(o_custkey % 3, 0), 0) AS filled, o_custkey % 3 = 0 AS missing FROM orders", exact="o_orderkey missing", doubles="ratio filled")
def null_handling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = X.safe_div("o_totalprice", F.col("o_custkey") % 3)
    return orders(spark, sf_dir).select("o_orderkey", ratio.alias("ratio"), F.coalesce(ratio, F.lit(0.0)).alias("filled"), ratio.isNull().alias("missing"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1996-08-31'", exact="o_orderkey d")
def closed_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compared as timestamps, so that the filter reaches the scan."""
    o = orders(spark, sf_dir).where((F.col("o_orderdate") >= F.lit("1996-03-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1996-09-01").cast("timestamp_ntz")))
    return o.select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))


@query(
    f"""WITH {GRID_SQL} SELECT area, month, total, mean FROM grid WHERE total IS NOT NULL AND mean IS NOT NULL""",
    exact="area month", doubles="total mean",
)
def complete_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).select("area", "month", "total", "mean").na.drop()


@query("SELECT o_orderkey AS k, 'order' AS kind FROM orders UNION ALL SELECT l_orderkey, 'line' FROM lineitem", exact="k kind")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = orders(spark, sf_dir).select(F.col("o_orderkey").alias("k"), F.lit("order").alias("kind"))
    return a.unionByName(sources.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.lit("line").alias("kind")))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders", exact="c_custkey")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.table(spark, sf_dir, "customer").select("c_custkey").subtract(orders(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey")))


@query("SELECT spec_id, year, make_date(year - 1, 12, 1) AS origin FROM (SELECT CAST(unnest(range(0, 8)) AS INT) AS spec_id), (SELECT CAST(unnest([2018, 2019, 2020]) AS INT) AS year)", exact="spec_id year origin")
def candidate_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight specifications by three years: 24 rows, whatever the data."""
    return sarima.specs(spark).select("spec_id").crossJoin(folds(spark, (2018, 2019, 2020)))


@query(
    f"""WITH {PANEL_SQL}, w AS (SELECT area, CAST(unnest(generate_series(DATE '1997-01-01', DATE '1997-12-01', INTERVAL 1 MONTH)) AS DATE) AS month FROM (SELECT DISTINCT area FROM panel))
SELECT area, month, total FROM w JOIN panel USING (area, month)""",
    exact="area month", doubles="total",
)
def must_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).select("area", "month", "total")
    wanted = calendar.spine(p.where(F.year("month") == 1997), ["area"])
    return calendar.must_match(wanted, p, ["area", "month"])


@query(
    f"""WITH {PANEL_SQL} SELECT area, max(total) FILTER (month = DATE '1998-06-01') AS june, max(total) FILTER (month = DATE '1998-10-01') AS october FROM panel GROUP BY area""",
    exact="area", doubles="june october",
)
def keyed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda d: F.max(F.when(F.col("month") == F.lit(d).cast("date"), F.col("total")))
    return panel(spark, sf_dir).groupBy("area").agg(at("1998-06-01").alias("june"), at("1998-10-01").alias("october"))


@query(
    f"""WITH {GRID_SQL}, t AS (SELECT area, month, total, row_number() OVER (PARTITION BY area ORDER BY month DESC) AS r FROM grid) SELECT area, month, total FROM t WHERE r <= 3""",
    exact="area month", doubles="total",
)
def last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three months of each area; the limit is the feature."""
    from pyspark.sql import Window

    w = Window.partitionBy("area").orderBy(F.desc("month"))
    return grid(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 3").select("area", "month", "total")


@query(
    f"""WITH {GRID_SQL} SELECT area, month, CASE WHEN n = 0 THEN NULL ELSE s / n END AS row_mean FROM (
  SELECT area, month, coalesce(total, 0) + coalesce(mean, 0) AS s, (total IS NOT NULL)::INT + (mean IS NOT NULL)::INT AS n FROM grid)""",
    exact="area month", doubles="row_mean",
)
def row_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).select("area", "month", X.row_mean(["total", "mean"]).alias("row_mean"))


@query(
    """SELECT c_mktsegment, printf('%.1f', avg(c_acctbal)) AS one, CASE WHEN avg(c_acctbal) < 4500 THEN 'Yes' ELSE 'No' END AS below FROM customer GROUP BY c_mktsegment""",
    exact="c_mktsegment one below",
)
def formatted_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sources.table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("m"))
    return c.select("c_mktsegment", F.format_string("%.1f", "m").alias("one"), F.when(F.col("m") < 4500, "Yes").otherwise("No").alias("below"))


@query("SELECT user_id, count(*) AS n, list_sort(list(event_id)) AS ids FROM events GROUP BY user_id", exact="user_id n ids")
def nested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("event_id")).alias("ids"))
