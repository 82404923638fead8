"""The whole evaluation: five sources to a monthly table, features, diagnostics, tuned
and trained models, a rolling backtest, the winner's forecast, linkages, and files.

``python -m tideline.plans.evaluation INPUTS.json OUT_DIR`` runs it. INPUTS.json names
the files and what their columns are called (see :class:`Inputs`) and may hold the
settings of :class:`tideline.sources.sources.Config`."""

from __future__ import annotations

import json
import sys
from collections.abc import Sequence
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import backtest, calendar, contract, features, gru, linkage, metrics, report, reshape, rollup, samples, sarima, stationarity
from ..sources import packs, sinks, sources

KEY = "unit"


@dataclass(frozen=True)
class Inputs:
    """Where the sources are. ``daily`` has columns date, close, high, low in this
    order; each of ``drivers`` (name to path) has date and value; ``indicators`` has
    date, code, item, value; ``panel`` date, area, indicator text, value. The target is
    the indicator ``target_code``, ``index_code`` the index that it is the yearly change
    of, and ``general_code`` a general index. ``own_area`` is left out of the panel."""

    daily: str
    drivers: dict[str, str]
    indicators: str
    panel: str
    first: str
    last: str
    target_code: str
    index_code: str
    general_code: str
    own_area: str
    areas: tuple[str, ...]
    linked: tuple[str, ...]

    @classmethod
    def from_dict(cls, given: dict) -> Inputs:
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in cls.__dataclass_fields__})

    def registry(self, spark: SparkSession) -> sources.Registry:
        found = {"daily": sources.Source(self.daily, sources.DAILY), "indicators": sources.Source(self.indicators, sources.INDICATORS), "panel": sources.Source(self.panel, sources.PANEL)}
        found |= {name: sources.Source(path, sources.MONTHLY) for name, path in self.drivers.items()}
        return sources.Registry(spark, found)

    @property
    def codes(self) -> list[str]:
        return sorted({self.target_code, self.index_code, self.general_code})


@dataclass(frozen=True)
class Bundle:
    """Lazy frames: the monthly table on its calendar, features, channels, audit."""

    monthly: DataFrame
    features: DataFrame
    channels: DataFrame
    channel_names: tuple[str, ...]
    audit: DataFrame


def area_column(area: str, code: str) -> str:
    return f"{area.lower()}_{code}"


def cut_off(inputs: Inputs, cutoff: str | None) -> Inputs:
    """The inputs up to the month of a cutoff."""
    return inputs if cutoff is None else replace(inputs, last=min(inputs.last, f"{cutoff[:7]}-01"))


def load(spark: SparkSession, inputs: Inputs, cutoff: str | None = None) -> Bundle:
    """Read, clean and join the sources; nothing is computed yet but key checks; the
    monthly table is kept once it is. Nothing after ``cutoff`` is used."""
    registry = inputs.registry(spark)
    registry.require()
    inputs, raw = cut_off(inputs, cutoff), registry.read("daily")
    if cutoff is not None:
        raw = raw.where(F.col("date") <= F.lit(cutoff).cast("date"))
    shipping = rollup.daily_to_monthly(rollup.without_exact_duplicates(raw))
    parts = [shipping]
    for name in inputs.drivers:
        monthly = registry.read(name).select(X.month_start("date").alias("month"), F.col("value").alias(name))
        parts.append(calendar.assert_unique(monthly, ["month"]))
    coded = registry.read("indicators").select(X.month_start("date").alias("month"), F.concat(F.lit("code_"), F.col("code").cast("string")).alias("code"), "value")
    parts.append(reshape.strict_pivot(coded.where(F.col("code").isin([f"code_{c}" for c in inputs.codes])), ["month"], "code", "value", [f"code_{c}" for c in inputs.codes]))
    abroad = reshape.exclude(registry.read("panel"), "area", [inputs.own_area])
    named = abroad.select(X.month_start("date").alias("month"), F.concat(F.lower("area"), F.lit("_"), X.indicator_code("indicator", inputs.codes)).alias("label"), "value")
    parts.append(reshape.strict_pivot(named, ["month"], "label", "value", [area_column(a, c) for a in inputs.areas for c in inputs.codes]))
    base = calendar.left_join_all(calendar.months(spark, inputs.first, inputs.last), parts, ["month"])
    # a row for each month, used by all that follows
    monthly = base.withColumn(KEY, F.lit("all")).withColumn("target", F.col(f"code_{inputs.target_code}")).persist()

    rolled = [c for c in shipping.columns if c != "month"]
    own = f"code_{inputs.general_code}"
    feature = features.origin_features(
        monthly, [KEY], "target", drivers=[own, f"code_{inputs.index_code}", *inputs.drivers],
        rollups=[c for c in rolled if c not in ("shipping_min", "shipping_max", "shipping_range", "shipping_intraday_spread_mean", "shipping_trading_days")], rolled=["shipping_mean"],
        panel=[(area_column(a, inputs.target_code), area_column(a, inputs.index_code)) for a in inputs.areas],
    )
    drivers = list(inputs.drivers)
    linked = [area_column(a, inputs.target_code) for a in inputs.linked]
    channel = features.sequence_channels(monthly, [KEY], "target", f"code_{inputs.index_code}", "shipping_mean", passed=[*drivers[:2], *linked])
    names = tuple(c for c in channel.columns if c not in (KEY, "month"))
    audit = rollup.source_audit(raw, "date", ["close", "high", "low"]).crossJoin(rollup.exact_duplicates(raw).select("n_duplicates"))  # one row each
    audit = audit.crossJoin(rollup.target_identity(monthly, [KEY], "target", f"code_{inputs.index_code}")).crossJoin(monthly.agg(F.count(F.lit(1)).alias("months"), F.count("target").alias("targets")))
    return Bundle(monthly, feature, channel, names, audit)


def evaluate(bundle: Bundle, inputs: Inputs, config: sources.Config, training: dict | None = None, candidates: Sequence = sarima.CANDIDATES) -> dict[str, DataFrame]:
    """Every result by name. Fits run as Spark tasks, all specs and folds at once."""
    spark = bundle.monthly.sparkSession
    training = {"seed": config.seed, "hidden": config.hidden} | (training or {})
    monthly = bundle.monthly.select(KEY, "month", "target").persist()
    folds = samples.folds(spark, config.evaluation_years)
    tests = stationarity.stationarity(monthly, [KEY], "target")
    tuning = sarima.tuning_scores(monthly, [KEY], "target", config.tuning_years, candidates).persist()
    best = metrics.best_specs(tuning, ["spec_id"]).first()
    if best is None:
        raise ValueError("no specification could be fitted on the tuning years")
    spec = [candidates[best.spec_id]]
    recurrent, models = backtest.recurrent_forecasts(bundle.channels, [KEY], bundle.channel_names, "target", folds, config.context, config.horizon, **training)
    models = models.persist()
    facts = backtest.facts(
        monthly, [KEY], "target",
        {backtest.SARIMA: backtest.sarima_forecasts(monthly, [KEY], "target", folds, spec), backtest.RECURRENT: recurrent, backtest.NAIVE: backtest.naive_forecasts(monthly, [KEY], "target", folds)},
    ).persist()
    scores = metrics.backtest_aggregate(facts.drop(KEY)).persist()
    chosen = backtest.choose(scores)

    final = spark.range(1).select((F.year(F.lit(inputs.last).cast("date")) + 1).alias("year"), F.lit(inputs.last).cast("date").alias("origin"))
    last_recurrent, last_models = backtest.recurrent_forecasts(bundle.channels, [KEY], bundle.channel_names, "target", final, config.context, config.horizon, **training)
    ahead = backtest.sarima_forecasts(monthly, [KEY], "target", final, spec).withColumn("model", F.lit(backtest.SARIMA)).unionByName(last_recurrent.withColumn("model", F.lit(backtest.RECURRENT))).persist()
    selected = backtest.selected_forecast(chosen, ahead)
    predictions = metrics.submission(selected, "month", "predicted")
    linked = [area_column(a, inputs.target_code) for a in inputs.linked]
    frame = linkage.indicator(bundle.monthly, [KEY], "food_indicator", [area_column(a, inputs.target_code) for a in inputs.areas])
    frame = linkage.indicator(frame, [KEY], "general_indicator", [area_column(a, inputs.general_code) for a in inputs.areas], as_yoy=True)
    links = linkage.linkages(frame, [KEY], "target", linked, ["food_indicator", "general_indicator"])
    projection = linkage.regional_projection(bundle.monthly, selected.select(KEY, "month", F.col("predicted").alias("forecast")), [KEY], linked)
    pressure = linkage.forward_pressure(projection, [KEY], "forecast", linked)
    final_jobs = sarima.specs(spark, spec).crossJoin(final.drop("year"))  # one row
    intervals = sarima.forecast_sarima(monthly, [KEY], "target", final_jobs).select(X.month_text("month").alias("year_month"), *[F.bround(c, 4).alias(c) for c in ("predicted", "std_error", "lower", "upper")]).orderBy("year_month")
    pattern = backtest.pattern_check(monthly.withColumnRenamed("target", "value"), selected.withColumnRenamed("predicted", "value"), int(inputs.last[:4]) + 1)
    return {
        "stationarity": tests, "tuning": tuning, "backtest": facts.drop(KEY), "scores": scores, "winner": chosen, "predictions": predictions,
        "candidates": backtest.candidates_table(ahead, chosen), "history": gru.training_history(last_models, ["year"]), "models": models.select("year", "part", "samples", "parameters", "epochs", "reason"), "intervals": intervals,
        "projection": projection, "pressure": pressure, "pattern": pattern, **{f"linkage_{k}": v for k, v in links.items()},
    }


def told_sections(spark: SparkSession, bundle: Bundle, inputs: Inputs, results: dict[str, DataFrame]) -> list[DataFrame]:
    """Sections of five documents, each made from the result that it tells of."""
    R, year = report, int(inputs.last[:4]) + 1
    features_, models_, memo, visuals, notes = "feature_report", "model_report", "linkage_memo", "visuals", "pitch_notes"
    granger = [(k.removeprefix("linkage_granger_"), df) for k, df in results.items() if k.startswith("linkage_granger_")]
    tests = None
    for name, df in granger:
        row = df.select(F.lit(name).alias("driver"), "lags", "n", "f_stat", "p_value", X.yes_at_5_percent("p_value").alias("significant"))
        tests = row if tests is None else tests.unionByName(row)
    means = results["tuning"].groupBy("spec_id").agg(F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"), F.avg("aic").alias("aic"), F.avg("bic").alias("bic"))
    n_features, n_channels = len(bundle.features.columns) - 2, len(bundle.channel_names)
    best = results["scores"].join(results["winner"].select(F.col("winner").alias("model")), "model")
    pattern = F.format_string(
        "June to October of %d went from %.1f to %.1f (a fall of %.1f); the forecast for %d goes from %.1f to %.1f (a fall of %.1f).",
        F.lit(year - 1), "actual_june", "actual_october", "actual_drop", F.lit(year), "forecast_june", "forecast_october", "forecast_drop",
    )
    correlations = [df for k, df in results.items() if k == "linkage_correlations"]
    return [
        R.heading(spark, features_, 1, "Data and features", 1), R.heading(spark, features_, 2, "Sources and checks"),
        R.told(bundle.audit, features_, 3, F.format_string("%d daily rows from %s to %s, of which %d are exact duplicates; %d months, %d of them with a target.", "n_rows", F.col("first_date").cast("string"), F.col("last_date").cast("string"), "n_duplicates", "months", "targets")),
        R.told(bundle.audit, features_, 4, F.format_string("The target differs from the yearly change of its index by %.6f at the most (%d months).", F.col("max_abs_gap"), F.col("n"))),
        R.table_section(bundle.audit, features_, 5), R.heading(spark, features_, 6, "What is known at an origin"),
        R.paragraph(spark, features_, 7, f"Each month has {n_features} features and {n_channels} channels, made from that month and those before it. Samples are learned from once all months of their labels have passed."),
        R.heading(spark, models_, 1, "Models", 1), R.heading(spark, models_, 2, "Backtest"), R.table_section(results["scores"], models_, 3, ["rmse"]),
        R.told(best, models_, 4, F.format_string("%s is selected: RMSE %.3f, MAE %.3f, sMAPE %.2f, bias %.3f over all folds. The seasonal naive forecast is a yardstick and cannot win.", "model", "rmse", "mae", "smape", "bias")),
        R.told(best, models_, 5, F.format_string("Its residuals have an autocorrelation of %.3f at one month and %.3f at twelve.", "acf_1", "acf_12")),
        R.heading(spark, models_, 6, "Stationarity"), R.table_section(results["stationarity"].drop(KEY), models_, 7, ["variant"]),
        R.heading(spark, models_, 8, "Tuning"), R.table_section(means, models_, 9, ["rmse"]),
        R.heading(spark, models_, 10, "Networks"), R.table_section(results["models"], models_, 11, ["year"]),
        R.heading(spark, models_, 12, "Forecast"), R.table_section(results["intervals"], models_, 13, ["year_month"]), R.table_section(results["candidates"], models_, 14, ["year_month"]),
        R.heading(spark, memo, 1, "Linkages", 1), R.heading(spark, memo, 2, "Method"),
        R.paragraph(spark, memo, 3, "The target is regressed on its own last value and those of other areas; tests ask whether the last values of a driver help to predict the target beyond its own. Neither shows a cause."),
        R.table_section(results["linkage_regression"].drop(KEY, "reason"), memo, 4, ["term"]), R.heading(spark, memo, 5, "Correlations"),
        *[R.table_section(df.drop(KEY), memo, 6, ["series"]) for df in correlations], R.heading(spark, memo, 7, "Predictive checks"),
        *([R.table_section(tests, memo, 8, ["driver"])] if tests is not None else []), R.heading(spark, memo, 9, "Pressure ahead"),
        R.told(results["pressure"], memo, 10, F.format_string("The forecast has a mean of %.1f, a peak of %.1f in %s and a trough of %.1f in %s; %d months are at or over the threshold. The halves of the year have means of %.1f and %.1f.", "mean", "peak", "peak_month", "trough", "trough_month", "months_over", "first_half_mean", "second_half_mean")),
        R.table_section(results["projection"].drop(KEY), memo, 11, ["month"]),
        R.heading(spark, visuals, 1, "Charts", 1), *[R.paragraph(spark, visuals, 2 + i, f"![{title}]({name})") for i, (name, title) in enumerate(CHARTS.items())],
        R.heading(spark, notes, 1, "Pitch notes", 1), R.heading(spark, notes, 2, "June to October"), R.told(results["pattern"], notes, 3, pattern),
    ]


CHARTS = {
    "target.svg": "Target", "drivers.svg": "Drivers", "backtest.svg": "Backtest", "scores.svg": "Errors of the models", "history.svg": "Losses of the network",
    "forecast.svg": "Forecast", "projection.svg": "Forecast and other areas", "correlations.svg": "Correlations with the target",
}


def drawn(bundle: Bundle, inputs: Inputs, results: dict[str, DataFrame]) -> dict[str, str]:
    """The charts as SVG by name; all are of some hundred months at the most."""
    facts = results["backtest"].groupBy("month").pivot("model", [backtest.SARIMA, backtest.RECURRENT, backtest.NAIVE]).agg(F.first("predicted"))
    facts = facts.join(results["backtest"].groupBy("month").agg(F.first("actual").alias("actual")), "month")
    projection = results["projection"]
    linked = [c for c in projection.columns if c not in (KEY, "month")]
    made = {
        "target.svg": sinks.line_chart(bundle.monthly, "month", ["target"], CHARTS["target.svg"]),
        "drivers.svg": sinks.line_chart(bundle.monthly, "month", list(inputs.drivers), CHARTS["drivers.svg"]),
        "backtest.svg": sinks.line_chart(facts, "month", ["actual", backtest.SARIMA, backtest.RECURRENT, backtest.NAIVE], CHARTS["backtest.svg"]),
        "scores.svg": report.bar_chart(results["scores"], "model", ["rmse", "mae"], CHARTS["scores.svg"]),
        "history.svg": sinks.line_chart(results["history"], "epoch", ["train_loss", "validation_loss"], CHARTS["history.svg"]),
        "forecast.svg": report.bar_chart(results["predictions"], "year_month", ["forecast"], CHARTS["forecast.svg"]),
        "projection.svg": sinks.line_chart(projection, "month", linked, CHARTS["projection.svg"]),
        "correlations.svg": report.bar_chart(results["linkage_correlations"], "series", ["correlation"], CHARTS["correlations.svg"]),
    }
    return made


def own_code(spark: SparkSession) -> DataFrame:
    """(name, content): the package's modules, some dozens of small files."""
    root = Path(__file__).resolve().parents[1]
    return spark.createDataFrame([(f"{root.name}/{p.relative_to(root)}", bytearray(p.read_bytes())) for p in sorted(root.rglob("*.py"))], "name string, content binary")


def run(spark: SparkSession, inputs: Inputs, config: sources.Config, out: str, training: dict | None = None, candidates: Sequence = sarima.CANDIDATES) -> DataFrame:
    """Evaluate and write everything below ``out``; returns the manifest of the files."""
    inputs, bundle = cut_off(inputs, config.data_cutoff), load(spark, inputs, config.data_cutoff)
    results = evaluate(bundle, inputs, config, training, candidates)
    first = f"{int(inputs.last[:4]) + 1}-01-01"
    metrics.assert_contract(results["predictions"], first, config.horizon)
    for name, df in {"monthly": bundle.monthly.drop(KEY), "features": bundle.features.drop(KEY)}.items():
        sinks.write_csv(df.orderBy("month"), f"{out}/{name}.csv")
    sinks.write_json(bundle.audit, f"{out}/audit.json")
    for name, df in results.items():
        nested = any(f.dataType.typeName() in ("array", "struct", "binary") for f in df.schema)
        sinks.write_json(df, f"{out}/{name}.json") if nested or name.startswith("linkage_") else sinks.write_csv(df, f"{out}/{name}.csv", one_file=True)
    contract.assert_written(spark, f"{out}/predictions.csv", contract.Expectation(("year_month", "forecast"), contract.months(first, config.horizon), ("forecast",)))
    # every result is small but the facts and losses, which stand in files of their own
    lines = [sinks.results_json({"audit": bundle.audit, **{k: df for k, df in results.items() if k not in ("backtest", "history")}})]
    sinks.write_text(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), f"{out}/results.json")
    documents = report.assembled(told_sections(spark, bundle, inputs, results)).persist()
    names = [r.report for r in documents.select("report").collect()]  # five
    for name in names:
        sinks.write_text(documents.where(F.col("report") == name).select("text").coalesce(1), f"{out}/{name}.md")
    documents.unpersist()
    for name, text in drawn(bundle, inputs, results).items():
        sinks.write_text(spark.createDataFrame([(text,)], "value string").coalesce(1), f"{out}/{name}")
    packs.write_pack(own_code(spark), f"{out}/code_archive.zip")
    members = {f"{n}.md": f"{out}/{n}.md" for n in names} | {n: f"{out}/{n}" for n in ("predictions.csv", "results.json", "code_archive.zip", *CHARTS)}
    packs.write_pack(packs.files(spark, members), f"{out}/submission_pack.zip")
    for df in (bundle.monthly, *results.values()):
        df.unpersist()
    return sinks.manifest(spark, out, "part-*").unionByName(sinks.manifest(spark, out, "*.zip"))


def main(args: list[str]) -> None:
    from pyspark.sql import SparkSession

    given = json.loads(open(args[0]).read())
    spark = SparkSession.builder.getOrCreate()
    config = sources.Config.from_json(json.dumps(given))
    run(spark, Inputs.from_dict(given), config, args[1]).show(100, truncate=False)


if __name__ == "__main__":
    main(sys.argv[1:])
