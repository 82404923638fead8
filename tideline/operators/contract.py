"""What a written table has to look like, judged on its files and not on the frame that
they were written from."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Expectation:
    """Columns in order; values of the first column in order of lines (none: any);
    and columns that hold finite numbers."""

    columns: tuple[str, ...]
    keys: tuple[str, ...] | None = None
    finite: tuple[str, ...] = ()


def written_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, line): the lines of text files by their place; the last newline ends the
    last line."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"\r?\n\z", "").alias("value"))
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))


def written_faults(spark: SparkSession, path: str, want: Expectation, manifest: DataFrame | None = None) -> DataFrame:
    """(file, fault, detail) for each breach: another header, lines with more or fewer
    fields, other keys or another order, numbers that aren't finite, and, against a
    manifest (path, bytes, sha256; as rows or a written table, for a cached plan would be
    taken for the files' state now), files that changed, are gone or came in addition. For
    tables of CSV without quotes or line breaks in fields."""
    lines = written_lines(spark, path)
    fields = lines.where("at > 0").withColumn("f", F.split("line", ",", -1))
    fault = lambda df, name, detail: df.select("file", F.lit(name).alias("fault"), detail.cast("string").alias("detail"))
    header = ",".join(want.columns)
    out = fault(lines.where((F.col("at") == 0) & (F.col("line") != header)), "header", F.col("line"))
    out = out.unionByName(fault(fields.where(F.size("f") != len(want.columns)), "fields", F.col("line")))
    for c in want.finite:
        value = F.try_element_at("f", F.lit(want.columns.index(c) + 1)).try_cast("double")
        bad = fields.where(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")))
        out = out.unionByName(fault(bad, "not finite", F.concat_ws(" ", F.lit(c), "line")))
    if want.keys is not None:
        keys = spark.createDataFrame([(i + 1, k) for i, k in enumerate(want.keys)], "at int, want string")
        met = fields.select("file", "at", F.col("f")[0].alias("key")).join(keys, "at", "full")
        bad = met.where(~F.col("key").eqNullSafe(F.col("want")))
        out = out.unionByName(fault(bad, "key", F.concat_ws(" ", F.lit("line"), "at", F.lit("is"), F.coalesce("key", F.lit("missing")), F.lit("and not"), F.coalesce("want", F.lit("expected")))))
    if manifest is not None:
        from ..sources.sinks import manifest as listed

        old = manifest.select("path", F.col("sha256").alias("was"))
        now = listed(spark, path).select("path", F.col("sha256").alias("is"))
        both = old.where(F.col("path").contains(path.split("://")[-1])).join(now, "path", "full").withColumnRenamed("path", "file")
        out = out.unionByName(fault(both.where("was IS NULL AND NOT rlike(file, '/[._][^/]*$')"), "came in addition", F.col("is")))
        out = out.unionByName(fault(both.where("is IS NULL"), "gone", F.col("was"))).unionByName(fault(both.where("was <> is"), "bytes", F.col("is")))
    return out


def assert_written(spark: SparkSession, path: str, want: Expectation, manifest: DataFrame | None = None) -> None:
    """An error that names the first breaches, if there are any."""
    bad = written_faults(spark, path, want, manifest).limit(5).collect()
    if bad:
        raise ValueError(f"{path}: " + "; ".join(f"{r.fault}: {r.detail}" for r in bad))


def months(first: str, horizon: int) -> Sequence[str]:
    """``horizon`` months as text from that of a date on."""
    year, month = int(first[:4]), int(first[5:7]) - 1
    return tuple(f"{year + (month + i) // 12:04d}-{(month + i) % 12 + 1:02d}" for i in range(horizon))
