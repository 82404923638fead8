"""Monthly figures kept up by a stream of events, however late these come.

Each micro-batch is reduced to the sums of its days (total, count, greatest, least), which
merge in any order. They are written below ``parts`` under their month and the batch's
number, in place of what that number wrote before, so a batch that is run again changes
nothing. Then the months that the batch touched, and no others, are rolled up from all
their parts and put in place of their partition below ``months``. What is kept grows with
days and not with events; :func:`compact` merges the parts of old batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rollup import daily_to_monthly


def day_parts(events: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """(keys, date, total, n, high, low): what a set of events adds to each day."""
    rows = events.select(*keys, F.col(time).cast("date").alias("date"), F.col(value).cast("double").alias("v")).where("date IS NOT NULL")
    return rows.groupBy(*keys, "date").agg(F.sum("v").alias("total"), F.count("v").alias("n"), F.max("v").alias("high"), F.min("v").alias("low"))


def merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return parts.groupBy(*keys, "date").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("high").alias("high"), F.min("low").alias("low"))


def bars(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Daily bars (keys, date, close, high, low, n) of all parts."""
    return merged(parts, keys).select(*keys, "date", F.try_divide("total", "n").alias("close"), "high", "low", "n")


def _put(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Write ``df`` in place of the partitions that it has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


class MonthlyTable:
    """The folders of a stream's monthly figures, and what reads and writes them."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], time: str, value: str, prefix: str = "events") -> None:
        self.spark, self.keys, self.time, self.value, self.prefix = spark, list(keys), time, value, prefix
        self.parts_path, self.months_path = f"{root.rstrip('/')}/parts", f"{root.rstrip('/')}/months"

    def upsert(self, batch: DataFrame, number: int) -> None:
        """What ``foreachBatch`` calls. Numbers of batches are not negative."""
        parts = day_parts(batch, self.keys, self.time, self.value).withColumns({"ym": F.date_format("date", "yyyy-MM"), "batch": F.lit(number).cast("long")}).persist()
        try:
            touched = [r.ym for r in parts.select("ym").distinct().collect()]  # the months of one batch
            if touched:
                _put(parts, self.parts_path, ["ym", "batch"])
                self.refresh(touched)
        finally:
            parts.unpersist()

    def parts(self) -> DataFrame:
        return self.spark.read.option("basePath", self.parts_path).parquet(self.parts_path).withColumn("ym", F.col("ym").cast("string"))

    def refresh(self, months: Sequence[str]) -> None:
        """Roll these months up anew from all their parts."""
        own = self.parts().where(F.col("ym").isin(list(months)))
        figures = daily_to_monthly(bars(own, self.keys), self.keys, prefix=self.prefix)
        _put(figures.withColumn("ym", F.date_format("month", "yyyy-MM")), self.months_path, ["ym"])

    def read(self) -> DataFrame:
        """(keys, month, figures) of all months so far."""
        return self.spark.read.parquet(self.months_path).drop("ym")

    def compact(self, below: int) -> None:
        """Merge the parts of batches under ``below`` into one of number -1 for each month.
        Only for batches that will not be run again (a checkpoint is past them). What is
        merged is first written beside, so a failure leaves the parts as they were or both
        marked by their number."""
        old = self.parts().where((F.col("batch") < below) & (F.col("batch") >= -1))
        whole = merged(old, [*self.keys, "ym"]).withColumn("batch", F.lit(-1).cast("long"))
        beside = f"{self.parts_path}-compacted"
        whole.write.mode("overwrite").parquet(beside)
        pairs = [(r.ym, r.batch) for r in old.select("ym", "batch").distinct().collect()]
        _put(self.spark.read.parquet(beside), self.parts_path, ["ym", "batch"])
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for ym, batch in pairs:
            if batch >= 0:
                path = hadoop.Path(f"{self.parts_path}/ym={ym}/batch={batch}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def run(self, events: DataFrame, checkpoint: str, available: bool = True) -> StreamingQuery:
        """Follow a stream of events; with ``available`` what there is so far, then stop."""
        writer = events.writeStream.foreachBatch(self.upsert).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available else writer).start()


def monthly_figures(events: DataFrame, keys: Sequence[str], time: str, value: str, prefix: str = "events") -> DataFrame:
    """The same figures of a table of events as a batch."""
    return daily_to_monthly(bars(day_parts(events, keys, time, value), keys), keys, prefix=prefix)


