"""Queries: features that look back, samples, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import features, linkage, metrics, rollup, samples
from ..operators.features import by_month
from .base import GRID_SQL, W, grid, lag_sql, query, rolling_sql, yoy_sql

K = ["area"]


def grid_sql(columns: dict[str, str], where: str = "") -> str:
    return f"WITH {GRID_SQL}\nSELECT area, month, " + ",\n  ".join(f"{v} AS {k}" for k, v in columns.items()) + f" FROM grid {where}"


def listed(columns: dict[str, str], rest: str = "area month") -> dict[str, str]:
    """Arguments of ``query`` for columns of the grid."""
    return {"sql": grid_sql(columns), "exact": rest, "doubles": " ".join(columns)}


LAGS = {f"total_lag{k}" if k else "total_now": lag_sql("total", k) for k in (0, 1, 2, 3, 6, 12, 18, 24)}


@query(**listed(LAGS))
def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.lag_features(grid(spark, sf_dir), K, ["total"], features.TARGET_LAGS)


DIFFS = {f"total_diff{k}": f"total - {lag_sql('total', k)}" for k in (1, 3, 12)}


@query(**listed(DIFFS))
def diff_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.window_columns(grid(spark, sf_dir), K, lambda w: {f"total_diff{k}": X.diff("total", k, w) for k in (1, 3, 12)}, 12)


ROLLS = {f"total_roll_{n}_{k}": rolling_sql(f, "total", k) for n, f in (("mean", "avg"), ("std", "stddev_pop")) for k in (3, 6, 12, 24)}


@query(**listed(ROLLS))
def rolling_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolls = (("mean", X.rolling_mean), ("std", X.rolling_std))
    return features.window_columns(grid(spark, sf_dir), K, lambda w: {f"total_roll_{n}_{k}": f("total", k, w) for n, f in rolls for k in (3, 6, 12, 24)}, 23)


@query(**listed({"total_yoy": yoy_sql("total")}))
def yoy_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.window_columns(grid(spark, sf_dir), K, lambda w: {"total_yoy": X.yoy("total", w)}, 12)


CYCLIC = {"month_sin": "sin(2 * pi() * month(month) / 12)", "month_cos": "cos(2 * pi() * month(month) / 12)"}


@query(**listed(CYCLIC))
def cyclic_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).select("area", "month", X.month_sin("month").alias("month_sin"), X.month_cos("month").alias("month_cos"))


@query(**listed({f"target_momentum_{k}": f"total - {lag_sql('total', k)}" for k in (3, 12)}))
def momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.window_columns(grid(spark, sf_dir), K, lambda w: {f"target_momentum_{k}": X.diff("total", k, w) for k in (3, 12)}, 12)


def origin_sql() -> dict[str, str]:
    out = dict(CYCLIC)
    out |= {f"target_lag{k}" if k else "target_now": lag_sql("total", k) for k in features.TARGET_LAGS}
    out |= {f"target_roll_mean_{n}": rolling_sql("avg", "total", n) for n in features.TARGET_WINDOWS}
    out |= {f"target_roll_std_{n}": rolling_sql("stddev_pop", "total", n) for n in features.TARGET_WINDOWS}
    out |= {f"target_momentum_{k}": f"total - {lag_sql('total', k)}" for k in (3, 12)}
    out |= {f"mean_lag{k}" if k else "mean_now": lag_sql("mean", k) for k in features.DRIVER_LAGS}
    out |= {"mean_change1": f"mean - {lag_sql('mean', 1)}", "mean_change3": f"mean - {lag_sql('mean', 3)}", "mean_roll6_mean": rolling_sql("avg", "mean", 6)}
    return out


@query(**listed(origin_sql()))
def origin_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.origin_features(grid(spark, sf_dir), K, "total", drivers=["mean"])


PANEL = {f"mean_lag{k}" if k else "mean_now": lag_sql("mean", k) for k in features.PANEL_LAGS} | {"mean_roll3": rolling_sql("avg", "mean", 3), "total_yoy": yoy_sql("total")}


@query(**listed(PANEL))
def panel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.window_columns(grid(spark, sf_dir), K, lambda w: features.panel_columns("mean", "total", w), 12)


CHANNELS = {"target": "total", "total_yoy": yoy_sql("total"), "orders_log1p": "CASE WHEN orders IS NOT NULL THEN ln(1 + greatest(orders, 0)) END", "mean": "mean", "mean_yoy": yoy_sql("mean")} | CYCLIC


@query(**listed(CHANNELS))
def sequence_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir).withColumn("orders", F.col("orders").cast("double"))
    return features.sequence_channels(g, K, "total", "total", "orders", passed=["mean"], yoy_of=["mean"])


ZSCORE = {c: f"({c} - avg({c}) OVER (PARTITION BY area)) / CASE WHEN stddev_pop({c}) OVER (PARTITION BY area) = 0 THEN 1.0 ELSE stddev_pop({c}) OVER (PARTITION BY area) END" for c in ("total", "mean")}


@query(**listed(ZSCORE))
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.zscore(grid(spark, sf_dir), K, ["total", "mean"]).select("area", "month", "total", "mean")


@query(
    f"""WITH {GRID_SQL}, t AS (SELECT area, month, total, {yoy_sql('total')} AS y FROM grid),
g AS (SELECT abs(y + 0.5 - ({yoy_sql('total')})) AS gap FROM t)
SELECT max(gap) AS max_abs_gap, avg(gap) AS mean_abs_gap, count(gap) AS n FROM g""",
    exact="n", doubles="max_abs_gap mean_abs_gap",
)
def target_identity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir).withColumn("target", X.yoy("total", by_month(K)) + 0.5)
    return rollup.target_identity(g, K, "target", "total")


SAMPLE_SQL = f"""WITH {GRID_SQL}, s AS (SELECT area, month AS origin, CAST(month + INTERVAL 12 MONTH AS DATE) AS label_end,
    [total, mean, {lag_sql('total', 12)}] AS x, [{', '.join(f'lead(total, {h}) OVER {W}' for h in range(1, 13))}] AS y FROM grid),
f AS (SELECT * FROM s WHERE len(list_filter(x, lambda v: v IS NULL)) = 0 AND len(list_filter(y, lambda v: v IS NULL)) = 0)"""


@query(SAMPLE_SQL + "\nSELECT area, origin, label_end, CAST(unnest(range(1, 13)) AS INT) AS h, x[1] AS x1, x[2] AS x2, x[3] AS x3, unnest(y) AS y FROM f", exact="area origin label_end h", doubles="x1 x2 x3 y")
def direct_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir).withColumn("total_lag12", F.lag("total", 12).over(by_month(K)))
    s = samples.direct_samples(g, K, ["total", "mean", "total_lag12"], "total")
    return s.select("area", "origin", "label_end", *[F.col("x")[i].alias(f"x{i + 1}") for i in range(3)], F.posexplode("y").alias("h", "y")).withColumn("h", F.col("h") + 1)


@query(
    f"""WITH {GRID_SQL}, s AS (SELECT area, month AS origin, [{', '.join(f'lag(total, {k}) OVER {W}' for k in range(23, -1, -1))}] AS a, [{', '.join(f'lag(mean, {k}) OVER {W}' for k in range(23, -1, -1))}] AS b, [{', '.join(f'lead(total, {h}) OVER {W}' for h in range(1, 13))}] AS y FROM grid),
f AS (SELECT * FROM s WHERE len(list_filter(a, lambda v: v IS NULL)) + len(list_filter(b, lambda v: v IS NULL)) + len(list_filter(y, lambda v: v IS NULL)) = 0)
SELECT area, origin, CAST(unnest(range(0, 24)) AS INT) AS step, unnest(a) AS total, unnest(b) AS mean, list_sum(y) AS labels FROM f""",
    exact="area origin step", doubles="total mean labels",
)
def sequence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples.sequence_samples(grid(spark, sf_dir), K, ["total", "mean"], "total")
    labels = F.aggregate("y", F.lit(0.0), lambda a, v: a + v).alias("labels")
    return s.select("area", "origin", labels, F.posexplode("x").alias("step", "v")).select("area", "origin", "step", F.col("v")[0].alias("total"), F.col("v")[1].alias("mean"), "labels")


@query(SAMPLE_SQL + "\nSELECT f.area, y.year AS year, count(*) AS n, max(label_end) AS last_label FROM f JOIN (VALUES (1999), (2000), (2001)) y(year) ON label_end <= make_date(y.year - 1, 12, 1) GROUP BY 1, 2", exact="area year n last_label")
def leakage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir).withColumn("total_lag12", F.lag("total", 12).over(by_month(K)))
    s = samples.direct_samples(g, K, ["total", "mean", "total_lag12"], "total")
    return samples.eligible(s, samples.folds(spark, [1999, 2000, 2001])).groupBy("area", "year").agg(F.count(F.lit(1)).alias("n"), F.max("label_end").alias("last_label"))


@query(
    f"""WITH {GRID_SQL}, s AS (SELECT area, month AS origin, [{', '.join(f'lag(total, {k}) OVER {W}' for k in range(23, -1, -1))}] AS a FROM grid)
SELECT area, CAST(unnest(range(0, 24)) AS INT) AS step, unnest(a) AS total FROM s WHERE origin = DATE '1999-12-01' AND len(list_filter(a, lambda v: v IS NULL)) = 0""",
    exact="area step", doubles="total",
)
def latest_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    at = samples.latest_context(samples.contexts(g, K, ["total"]), K, "1999-12-01", wanted=g)
    return at.select("area", F.posexplode("x").alias("step", "v")).select("area", "step", F.col("v")[0].alias("total"))


NAIVE_SQL = f"""WITH {GRID_SQL}, f AS (SELECT area, month, total AS actual, {lag_sql('total', 12)} AS predicted FROM grid),
k AS (SELECT *, predicted - actual AS e, abs(actual) + abs(predicted) AS size FROM f WHERE actual IS NOT NULL AND predicted IS NOT NULL)"""
METRIC_SQL = "sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, avg(CASE WHEN size > 1e-9 THEN 200 * abs(e) / size ELSE 0 END) AS smape, avg(e) AS bias"


def naive_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = metrics.seasonal_naive(grid(spark, sf_dir), K, "total").withColumnRenamed("total", "actual")
    return f.where("actual IS NOT NULL AND predicted IS NOT NULL").select("area", "month", "actual", "predicted")


@query(NAIVE_SQL + " SELECT area, month, actual, predicted FROM k", exact="area month", doubles="actual predicted")
def seasonal_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive_facts(spark, sf_dir)


@query(NAIVE_SQL + f" SELECT area, {METRIC_SQL} FROM k GROUP BY area", exact="area", doubles="rmse mae smape bias")
def metric_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metric_set(naive_facts(spark, sf_dir), K)


def acf_sql(k: int) -> str:
    return f"CASE WHEN coalesce(stddev_pop(CASE WHEN b{k} IS NOT NULL THEN r END) < 1e-12 OR stddev_pop(CASE WHEN r IS NOT NULL THEN b{k} END) < 1e-12, true) THEN 0.0 ELSE corr(r, b{k}) END AS acf_{k}"


ACF_SQL = NAIVE_SQL + f", b AS (SELECT area, month, -e AS r, -lag(e, 1) OVER {W} AS b1, -lag(e, 12) OVER {W} AS b12 FROM k)"


@query(ACF_SQL + f" SELECT area, {acf_sql(1)}, {acf_sql(12)} FROM b GROUP BY area", exact="area", doubles="acf_1 acf_12")
def residual_acf(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = naive_facts(spark, sf_dir).withColumn("residual", F.col("actual") - F.col("predicted"))
    return metrics.autocorrelation(f, K, "month", "residual", [1, 12])


@query(ACF_SQL + f", m AS (SELECT area, {METRIC_SQL} FROM k GROUP BY area), a AS (SELECT area, {acf_sql(1)}, {acf_sql(12)} FROM b GROUP BY area) SELECT area AS model, rmse, mae, smape, bias, acf_1, acf_12 FROM m JOIN a USING (area)", exact="model", doubles="rmse mae smape bias acf_1 acf_12")
def backtest_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.backtest_aggregate(naive_facts(spark, sf_dir).withColumnRenamed("area", "model"))


@query(NAIVE_SQL + f", m AS (SELECT area, {METRIC_SQL} FROM k GROUP BY area) SELECT min_by(area, rmse) AS winner, min(rmse) AS rmse FROM m WHERE area IN ('ASIA', 'EUROPE')", exact="winner", doubles="rmse")
def winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.winner(metrics.metric_set(naive_facts(spark, sf_dir), K), ["ASIA", "EUROPE"], model="area")


@query(NAIVE_SQL + f", m AS (SELECT area, year(month) AS year, {METRIC_SQL} FROM k GROUP BY 1, 2) SELECT area, avg(rmse) AS rmse, avg(mae) AS mae FROM m GROUP BY area ORDER BY rmse, mae, area LIMIT 3", exact="area", doubles="rmse mae")
def best_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top three by mean scores over years; the limit is the feature."""
    m = metrics.metric_set(naive_facts(spark, sf_dir).withColumn("year", F.year("month")), ["area", "year"])
    return metrics.best_specs(m, ["area"], n=3)


@query(
    f"""WITH {GRID_SQL} SELECT area, max(total) AS peak, max_by(month, total) AS peak_month, min(total) AS trough, min_by(month, total) AS trough_month FROM grid GROUP BY area""",
    exact="area peak_month trough_month", doubles="peak trough",
)
def extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.extremes(grid(spark, sf_dir), K, "month", "total")


@query(
    f"""WITH {GRID_SQL} SELECT area, corr(total, mean) AS mean, corr(total, orders) AS orders FROM grid GROUP BY area""",
    exact="area", doubles="mean orders",
)
def cross_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return g.groupBy("area").agg(X.guarded_corr("total", "mean").alias("mean"), X.guarded_corr("total", F.col("orders").cast("double")).alias("orders"))


@query(
    f"""WITH {GRID_SQL}, p AS (SELECT strftime(month, '%Y-%m') AS year_month, CASE WHEN orders % 3 > 0 THEN total END AS forecast FROM grid WHERE month BETWEEN DATE '1997-11-01' AND DATE '1998-10-01' AND area < 'B'),
w AS (SELECT strftime(unnest(generate_series(DATE '1998-01-01', DATE '1998-12-01', INTERVAL 1 MONTH)), '%Y-%m') AS year_month)
SELECT 'missing month' AS fault, year_month FROM w WHERE year_month NOT IN (SELECT year_month FROM p)
UNION ALL SELECT DISTINCT 'foreign month', year_month FROM p WHERE year_month NOT IN (SELECT year_month FROM w)
UNION ALL SELECT 'repeated month', year_month FROM p GROUP BY year_month HAVING count(*) > 1
UNION ALL SELECT 'no finite value', year_month FROM p WHERE forecast IS NULL""",
    exact="fault year_month",
)
def prediction_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of a table that has them all: months of the year before, none of its end,
    each month once for every area of some, and a value for some orders only."""
    p = grid(spark, sf_dir).where("month BETWEEN DATE'1997-11-01' AND DATE'1998-10-01' AND area < 'B'")
    return metrics.prediction_faults(p.select(X.month_text("month").alias("year_month"), F.expr("CASE WHEN orders % 3 > 0 THEN total END").alias("forecast")), "1998-01-01")


@query(
    f"""WITH {GRID_SQL} SELECT strftime(month, '%Y-%m') AS year_month, round_even(total, 6) AS forecast FROM grid WHERE area = 'ASIA' AND year(month) = 1998""",
    exact="year_month", doubles="forecast",
)
def submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.submission(grid(spark, sf_dir).where((F.year("month") == 1998) & (F.col("area") == "ASIA")), "month", "total")


@query(
    f"""WITH {GRID_SQL}, f AS (SELECT area, CAST(month + INTERVAL 12 MONTH AS DATE) AS month, total AS v FROM grid WHERE year(month) = 1999)
SELECT f.area, f.month, f.v AS value, g.mean AS mean FROM f LEFT JOIN (SELECT area, CAST(month + INTERVAL 12 MONTH AS DATE) AS month, mean FROM grid) g USING (area, month)""",
    exact="area month", doubles="value mean",
)
def regional_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    f = g.where(F.year("month") == 1999).select("area", F.add_months("month", 12).alias("month"), F.col("total").alias("value"))
    return linkage.regional_projection(g, f, K, ["mean"])


@query(
    f"""WITH {GRID_SQL}, p AS (SELECT area, month, total AS v, (coalesce(mean, 0) + coalesce(CAST(orders AS DOUBLE), 0)) / nullif((mean IS NOT NULL)::INT + (orders IS NOT NULL)::INT, 0) AS r FROM grid WHERE year(month) = 1999)
SELECT area, avg(v) AS mean, max(v) AS peak, strftime(max_by(month, v), '%Y-%m') AS peak_month, min(v) AS trough, strftime(min_by(month, v), '%Y-%m') AS trough_month,
  count(*) FILTER (v >= 10) AS months_over, avg(v) FILTER (month(month) <= 6) AS first_half_mean, avg(v) FILTER (month(month) > 6) AS second_half_mean,
  avg(v) FILTER (month(month) <= 6) - avg(v) FILTER (month(month) > 6) AS easing, arg_max(v, month) AS last, avg(r) AS regional_mean FROM p GROUP BY area""",
    exact="area peak_month trough_month months_over", doubles="mean peak trough first_half_mean second_half_mean easing last regional_mean",
)
def forward_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir).where(F.year("month") == 1999).select("area", "month", "total", F.col("mean").alias("r1"), F.col("orders").cast("double").alias("r2"))
    return linkage.forward_pressure(g, K, "total", ["r1", "r2"])
