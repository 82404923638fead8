"""Sources: explicit schemas, a registry of named files, and a check before reading."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import finite


def schema(**kinds: str) -> str:
    """Columns in file order, as DDL."""
    return ", ".join(f"`{k}` {v}" for k, v in kinds.items())


DAILY = schema(date="date", close="double", high="double", low="double")
MONTHLY = schema(date="date", value="double")
INDICATORS = schema(date="date", code="int", item="string", value="double")
PANEL = schema(date="date", area="string", indicator="string", value="double")


@dataclass(frozen=True)
class Source:
    """A named file: its path, format, schema in file order, and read options."""

    path: str
    schema: str | T.StructType
    format: str = "csv"
    options: Mapping[str, str] = field(default_factory=dict)


class MissingSources(FileNotFoundError):
    """Lists every required source that is not there."""


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


class Registry:
    """Sources by name."""

    def __init__(self, spark: SparkSession, sources: Mapping[str, Source]) -> None:
        self.spark, self.sources = spark, dict(sources)

    def require(self) -> None:
        """Raise once, naming all that is missing."""
        missing = [f"{k} ({s.path})" for k, s in self.sources.items() if not exists(self.spark, s.path)]
        if missing:
            raise MissingSources("missing sources: " + ", ".join(missing))

    def read(self, name: str) -> DataFrame:
        """A source's rows; NaN and infinities of its doubles are null."""
        s = self.sources[name]
        reader = self.spark.read.format(s.format).schema(s.schema)
        if s.format == "csv":
            reader = reader.option("header", True).option("enforceSchema", True)
        return without_nan(reader.options(**s.options).load(s.path))

    def register(self) -> None:
        """A temporary view for each source."""
        self.require()
        for name in self.sources:
            self.read(name).createOrReplaceTempView(name)


def without_nan(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: finite(c) for c in doubles}) if doubles else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Config:
    """Settings of an evaluation, read from JSON; tuning years stand apart from those
    that are evaluated."""

    target: str = "target"
    data_cutoff: str | None = None
    horizon: int = 12
    context: int = 24
    hidden: int = 16
    seed: int = 17
    evaluation_years: tuple[int, ...] = ()
    tuning_years: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        both = set(self.evaluation_years) & set(self.tuning_years)
        if both:
            raise ValueError(f"years both tuned on and evaluated: {sorted(both)}")

    @classmethod
    def from_json(cls, text: str) -> Config:
        given = json.loads(text)
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in cls.__dataclass_fields__}
        return cls(**known)


def read_config(spark: SparkSession, path: str) -> Config:
    return Config.from_json(spark.read.text(path, wholetext=True).first().value)


# The driver's tables in the roles of the sources ---------------------------------


def daily_orders(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, date, close, high, low): order values of a day by mean, most and least."""
    orders = table(spark, sf_dir, "orders").withColumn("date", F.col("o_orderdate").cast("date"))
    return orders.groupBy(*keys, "date").agg(F.avg("o_totalprice").alias("close"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"))


def monthly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(area, month, total, mean, orders): orders by the customer's region."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("area"))
    # by customer first, so that what is joined is small; nation and region have fixed sizes
    by_customer = orders.groupBy("o_custkey", "month").agg(F.sum("o_totalprice").alias("s"), F.count("o_totalprice").alias("n"))
    placed = by_customer.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))), F.col("c_nationkey") == F.col("n_nationkey"))
    return placed.groupBy("area", "month").agg(F.sum("s").alias("total"), (F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("orders"))
