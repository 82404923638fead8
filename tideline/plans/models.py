"""Queries: regressions, tests, fitted models, backtests, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import backtest, gru, linkage, metrics, regression, samples, sarima, stationarity
from ..operators.features import by_month
from ..sources import sinks
from .base import GRID_SQL, grid, lag_sql, query, yoy_sql

K = ["area"]
#: Years that every sf has whole, with enough months before them.
YEARS = (1999, 2000)
#: Years before them with two years behind them, as seasonal specifications need.
TUNING = (1997, 1998)

MOMENTS = """m AS (SELECT area, count(*) AS n, avg(y) my, avg(a) ma, avg(b) mb, covar_pop(a, a) saa, covar_pop(b, b) sbb, covar_pop(a, b) sab, covar_pop(a, y) say, covar_pop(b, y) sby, covar_pop(y, y) syy FROM k GROUP BY area),
c AS (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS b1, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS b2 FROM m)"""
LAGGED = f"k AS (SELECT area, y, a, b FROM (SELECT area, total AS y, {lag_sql('total', 1)} AS a, {lag_sql('mean', 1)} AS b FROM grid) WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL)"


def lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regression.lagged(grid(spark, sf_dir), K, ["total", "mean"], [1, 2])


#: Two-sided p-value of Student's t by its finite series (Abramowitz and Stegun 26.7).
STUDENT_SQL = """CASE WHEN v % 2 = 0
  THEN 1 - sin(th) * list_sum(list_transform(range(0, v // 2), lambda k: list_product([1.0] || list_transform(range(1, k + 1), lambda j: (2.0 * j - 1) / (2 * j))) * cos(th) ^ (2 * k)))
  ELSE 1 - 2 / pi() * (th + sin(th) * list_sum(list_transform(range(0, (v - 1) // 2), lambda k: list_product([1.0] || list_transform(range(1, k + 1), lambda j: 2.0 * j / (2 * j + 1))) * cos(th) ^ (2 * k + 1)))) END"""


@query(
    f"""WITH {GRID_SQL}, {LAGGED}, {MOMENTS}, d AS (SELECT *, saa * sbb - sab * sab AS det, n - 3 AS v, greatest(syy - b1 * say - b2 * sby, 0) / (n - 3) AS s2 FROM c),
a AS (SELECT *, atan(abs(b1) / sqrt(s2 * sbb / det) / sqrt(v)) AS th FROM d), p AS (SELECT *, {STUDENT_SQL} AS p_value_1 FROM a),
b AS (SELECT * EXCLUDE (th), atan(abs(b2) / sqrt(s2 * saa / det) / sqrt(v)) AS th FROM p)
SELECT area, n, my - b1 * ma - b2 * mb AS intercept, b1 AS slope_1, b2 AS slope_2, (b1 * say + b2 * sby) / syy AS r_squared, p_value_1, {STUDENT_SQL} AS p_value_2 FROM b""",
    exact="area n", doubles="intercept slope_1 slope_2 r_squared p_value_1 p_value_2", digits=6,
)
def ols_two_regressors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regression.two_regressor_ols(lagged(spark, sf_dir), K, "total", "total_lag1", "mean_lag1")


@query(
    f"""WITH {GRID_SQL}, {LAGGED}, {MOMENTS}, r AS (SELECT *, greatest(n * (syy - b1 * say - b2 * sby), 0) AS rss, saa * sbb - sab * sab AS det FROM c),
s AS (SELECT *, rss / (n - 3) AS s2 FROM r),
o AS (SELECT area, n, rss, 1 - rss / (n * syy) AS r_squared, 'intercept' AS term, my - b1 * ma - b2 * mb AS coefficient, sqrt(s2 / n * (1 + (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / det)) AS std_error FROM s
UNION ALL SELECT area, n, rss, 1 - rss / (n * syy), 'total_lag1', b1, sqrt(s2 / n * sbb / det) FROM s
UNION ALL SELECT area, n, rss, 1 - rss / (n * syy), 'mean_lag1', b2, sqrt(s2 / n * saa / det) FROM s),
q AS (SELECT *, coefficient / std_error AS t_stat, n - 3 AS v, atan(abs(coefficient / std_error) / sqrt(n - 3)) AS th FROM o)
SELECT area, n, rss, r_squared, term, coefficient, std_error, t_stat, {STUDENT_SQL} AS p_value FROM q""",
    exact="area n term", doubles="rss r_squared coefficient std_error t_stat p_value", digits=6,
)
def ols_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regression.ols(lagged(spark, sf_dir), K, "total", ["total_lag1", "mean_lag1"]).select("area", "n", "rss", "r_squared", "term", "coefficient", "std_error", "t_stat", "p_value")


@query(
    f"""WITH {GRID_SQL}, k AS (SELECT area, y, a, b FROM (SELECT area, total AS y, {lag_sql('total', 1)} AS a, {lag_sql('mean', 1)} AS b FROM grid) WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL), {MOMENTS},
r AS (SELECT area, n, greatest(n * (syy - b1 * say - b2 * sby), 0) AS full_rss, n * (syy - say * say / saa) AS part_rss FROM c)
SELECT area, CAST(1 AS INT) AS lags, n, greatest(part_rss - full_rss, 0) / (full_rss / (n - 3)) AS f_stat FROM r""",
    exact="area lags n", doubles="f_stat", digits=6,
)
def granger_one_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regression.granger(grid(spark, sf_dir), K, "total", "mean", lags=1).drop("p_value", "reason")


def granger_sql(rows: str) -> str:
    """SQL for the causality test with two lags: the regressors made orthogonal one by
    one, so the sums of squares follow; with two restrictions the p-value is closed."""
    steps, known = [], ["e1"]
    steps.append("s1 AS (SELECT area, y - avg(y) OVER a AS y, x1 - avg(x1) OVER a AS e1, x2 - avg(x2) OVER a AS x2, x3 - avg(x3) OVER a AS x3, x4 - avg(x4) OVER a AS x4 FROM s0 WINDOW a AS (PARTITION BY area))")
    for k in (2, 3, 4):
        less = " - ".join([f"x{k}", *[f"{e} * sum(x{k} * {e}) OVER a / sum({e} * {e}) OVER a" for e in known]])
        steps.append(f"s{k} AS (SELECT area, y, {', '.join(known)}, {less} AS e{k}{''.join(f', x{j}' for j in range(k + 1, 5))} FROM s{k - 1} WINDOW a AS (PARTITION BY area))")
        known.append(f"e{k}")
    part = "sum(y * y) - sum(y * e1) ^ 2 / sum(e1 * e1) - sum(y * e2) ^ 2 / sum(e2 * e2)"
    return f"""s0 AS (SELECT * FROM ({rows}) WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL AND x4 IS NOT NULL), {', '.join(steps)},
t AS (SELECT area, count(*) AS n, {part} AS part_rss, {part} - sum(y * e3) ^ 2 / sum(e3 * e3) - sum(y * e4) ^ 2 / sum(e4 * e4) AS full_rss FROM s4 GROUP BY area),
f AS (SELECT area, CAST(2 AS INT) AS lags, n, greatest(part_rss - full_rss, 0) / 2 / (full_rss / (n - 5)) AS f_stat FROM t),
granger AS (SELECT *, (1 + 2 * f_stat / (n - 5)) ^ (-(n - 5) / 2.0) AS p_value FROM f)"""


@query(f"WITH {GRID_SQL}, {granger_sql('SELECT area, total AS y, lag(total, 1) OVER w AS x1, lag(total, 2) OVER w AS x2, lag(mean, 1) OVER w AS x3, lag(mean, 2) OVER w AS x4 FROM grid WINDOW w AS (PARTITION BY area ORDER BY month)')} SELECT area, lags, n, f_stat, p_value FROM granger", exact="area lags n", doubles="f_stat p_value", digits=6)
def granger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regression.granger(grid(spark, sf_dir), K, "total", "mean").drop("reason")


@query(
    f"""WITH {GRID_SQL}, g AS (SELECT area, month, total, {yoy_sql('mean')} AS i FROM grid),
k AS (SELECT area, y, a, b FROM (SELECT area, total AS y, lag(total, 1) OVER w AS a, lag(i, 1) OVER w AS b FROM g WINDOW w AS (PARTITION BY area ORDER BY month)) WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL), {MOMENTS},
r AS (SELECT *, greatest(n * (syy - b1 * say - b2 * sby), 0) AS rss, saa * sbb - sab * sab AS det FROM c),
z AS (SELECT *, rss / (n - 3) AS s2 FROM r),
o AS (SELECT area, n, rss, 1 - rss / (n * syy) AS r_squared, 'intercept' AS term, my - b1 * ma - b2 * mb AS coefficient, sqrt(s2 / n * (1 + (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / det)) AS std_error FROM z
  UNION ALL SELECT area, n, rss, 1 - rss / (n * syy), 'total_lag1', b1, sqrt(s2 / n * sbb / det) FROM z UNION ALL SELECT area, n, rss, 1 - rss / (n * syy), 'indicator_lag1', b2, sqrt(s2 / n * saa / det) FROM z),
q AS (SELECT *, coefficient / std_error AS t_stat, n - 3 AS v, atan(abs(coefficient / std_error) / sqrt(n - 3)) AS th FROM o),
u AS (SELECT *, {STUDENT_SQL} AS p_value FROM q),
{granger_sql('SELECT area, total AS y, lag(total, 1) OVER w AS x1, lag(total, 2) OVER w AS x2, lag(i, 1) OVER w AS x3, lag(i, 2) OVER w AS x4 FROM g WINDOW w AS (PARTITION BY area ORDER BY month)')}
SELECT u.area, u.n, r_squared, rss, term, coefficient, std_error, t_stat, u.p_value, granger.f_stat, granger.p_value AS granger_p_value, CASE WHEN u.p_value < 0.05 THEN 'Yes' ELSE 'Not at 5%' END AS significant FROM u JOIN granger ON u.area = granger.area""",
    exact="area n term significant", doubles="r_squared rss coefficient std_error t_stat p_value f_stat granger_p_value", digits=6,
)
def indicator_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regression and the test for an indicator, with the verdict at 5 %."""
    g = linkage.indicator(grid(spark, sf_dir), K, "indicator", ["mean"], as_yoy=True)
    fit, test = regression.indicator_relationship(g, K, "total", "indicator")
    return fit.drop("reason").join(test.select("area", "f_stat", F.col("p_value").alias("granger_p_value")), "area").withColumn("significant", X.yes_at_5_percent("p_value"))


@query(
    f"""WITH {GRID_SQL}, g AS (SELECT area, total, mean, {yoy_sql('mean')} AS indicator FROM grid), c AS (SELECT area, corr(total, mean) AS m, corr(total, indicator) AS i FROM g GROUP BY area)
SELECT area, 'mean' AS series, m AS correlation FROM c UNION ALL SELECT area, 'indicator', i FROM c""",
    exact="area series", doubles="correlation",
)
def linkage_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = linkage.indicator(grid(spark, sf_dir), K, "indicator", ["mean"], as_yoy=True)
    return linkage.linkages(g, K, "total", ["mean"], ["indicator"])["correlations"]


@query()
def adf_kpss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stationarity.stationarity(grid(spark, sf_dir), K, "total")


@query()
def sarima_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates over three years."""
    return sarima.tuning_scores(grid(spark, sf_dir), K, "total", (*TUNING, YEARS[0]))


def tuned(g: DataFrame) -> DataFrame:
    """The specification of each area that does best on the years before the folds."""
    return sarima.tuned(sarima.tuning_scores(g, K, "total", TUNING), K)


@query()
def sarima_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return sarima.forecast_sarima(g, K, "total", tuned(g).withColumn("origin", F.lit("1999-12-01").cast("date")))


NAMES = ["total", "mean", "month_sin", "month_cos"]
TRAINING = {"epochs": 500, "patience": 60, "validation": 24}


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).withColumns({"month_sin": X.month_sin("month"), "month_cos": X.month_cos("month")})


@query()
def gru_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of each epoch, one model for a group of areas of each fold."""
    blocks = samples.packed_blocks(channels(spark, sf_dir), K, NAMES, "total", context=12)
    return gru.training_history(gru.train_blocks(blocks, samples.folds(spark, YEARS), K, 12, **TRAINING), ["year"])


def _forecasts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    g, fold = channels(spark, sf_dir), samples.folds(spark, YEARS)
    recurrent, _ = backtest.recurrent_forecasts(g, K, NAMES, "total", fold, 12, **TRAINING)
    return {
        backtest.SARIMA: backtest.sarima_forecasts(g, K, "total", fold, tuned(g)),
        backtest.RECURRENT: recurrent,
        backtest.NAIVE: backtest.naive_forecasts(g, K, "total", fold),
    }


@query()
def rolling_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.facts(grid(spark, sf_dir), K, "total", _forecasts(spark, sf_dir))


@query()
def backtest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = backtest.facts(grid(spark, sf_dir), K, "total", _forecasts(spark, sf_dir))
    ordered = f.withColumn("at", F.concat_ws(" ", "area", F.col("month").cast("string")))
    return metrics.backtest_aggregate(ordered, order="at")


NAIVE_FOLD = f"""WITH {GRID_SQL}, f AS (SELECT area, CAST(month + INTERVAL 12 MONTH AS DATE) AS month, total AS predicted FROM grid WHERE total IS NOT NULL AND year(month) IN ({', '.join(str(y - 1) for y in YEARS)}))"""


@query(NAIVE_FOLD + " SELECT area, month, CAST(year(month) AS INT) AS forecast_year, 'Seasonal naive' AS model, g.total AS actual, predicted, g.total - predicted AS residual FROM f JOIN grid g USING (area, month) WHERE g.total IS NOT NULL", exact="area month forecast_year model", doubles="actual predicted residual")
def naive_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return backtest.facts(g, K, "total", {backtest.NAIVE: backtest.naive_forecasts(g, K, "total", samples.folds(spark, YEARS))})


@query(
    f"""WITH {GRID_SQL}, a AS (SELECT area, month, total AS value FROM grid), f AS (SELECT area, CAST(month + INTERVAL 24 MONTH AS DATE) AS month, total AS value FROM grid),
x AS (SELECT area, max(value) FILTER (month = DATE '1998-06-01') AS actual_june, max(value) FILTER (month = DATE '1998-10-01') AS actual_october FROM a GROUP BY area),
y AS (SELECT area, max(value) FILTER (month = DATE '1999-06-01') AS forecast_june, max(value) FILTER (month = DATE '1999-10-01') AS forecast_october FROM f GROUP BY area)
SELECT area, actual_june, actual_october, actual_june - actual_october AS actual_drop, forecast_june, forecast_october, forecast_june - forecast_october AS forecast_drop FROM x JOIN y USING (area)""",
    exact="area", doubles="actual_june actual_october actual_drop forecast_june forecast_october forecast_drop",
)
def pattern_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecast is the value of two years before."""
    a = grid(spark, sf_dir).select("area", "month", F.col("total").alias("value"))
    return backtest.pattern_check(a, a.withColumn("month", F.add_months("month", 24)), 1999, keys=K)


@query()
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.manifest(spark, sf_dir, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "bytes", "sha256")


@query(
    f"""WITH {GRID_SQL} SELECT 'area' AS name, area || '/' || strftime(month, '%Y-%m') AS key, length(area) AS n FROM grid""",
    exact="name key n",
)
def json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to JSON with sorted keys and back."""
    g = grid(spark, sf_dir).select(F.concat("area", F.lit("/"), X.month_text("month")).alias("key"), F.length("area").cast("long").alias("n"), F.lit("area").alias("name"))
    back = F.from_json("json", "key string, n long, name string").alias("r")
    return sinks.as_json(g).select(back).select("r.name", "r.key", "r.n")


@query(
    f"""WITH {GRID_SQL} SELECT area, CASE WHEN max(total) > min(total) THEN min(total) - (max(total) - min(total)) * 0.08 ELSE min(total) - 1 END AS low, CASE WHEN max(total) > min(total) THEN max(total) + (max(total) - min(total)) * 0.08 ELSE max(total) + 1 END AS high FROM grid WHERE area = 'ASIA' GROUP BY area""",
    exact="area", doubles="low high",
)
def chart_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.padded_range(grid(spark, sf_dir).where("area = 'ASIA'"), ["total"]).select(F.lit("ASIA").alias("area"), "low", "high")


@query(f"WITH {GRID_SQL} SELECT area, month, {yoy_sql('total')} AS total_yoy, {yoy_sql('mean')} AS mean_yoy FROM grid", exact="area month", doubles="total_yoy mean_yoy")
def chart_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = by_month(K)
    return grid(spark, sf_dir).select("area", "month", X.yoy("total", w).alias("total_yoy"), X.yoy("mean", w).alias("mean_yoy"))
