"""Reports as Markdown and SVG, told from computed results only.

A set of reports is a frame of sections (report, place, text), each made by Spark from the
result that it tells of; :func:`assembled` puts the sections of each report in a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Report:
    """A Markdown document, piece by piece. Tables take small results: a frame of more
    than ``most`` rows is an error."""

    def __init__(self, title: str, most: int = 200) -> None:
        self.parts, self.most = [f"# {title}"], most

    def heading(self, text: str) -> Report:
        self.parts.append(f"## {text}")
        return self

    def paragraph(self, text: str) -> Report:
        self.parts.append(" ".join(text.split()))
        return self

    def bullets(self, items: Sequence[str]) -> Report:
        self.parts.append("\n".join(f"- {x}" for x in items))
        return self

    def callout(self, text: str) -> Report:
        self.parts.append(f"> {text}")
        return self

    def table(self, df: DataFrame, digits: int = 3) -> Report:
        rows = df.limit(self.most + 1).collect()
        if len(rows) > self.most:
            raise ValueError(f"more than {self.most} rows for a report")
        show = lambda v: "" if v is None else f"{v:,.{digits}f}" if isinstance(v, float) else str(v)
        lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        self.parts.append("\n".join([*lines, *["| " + " | ".join(map(show, r)) + " |" for r in rows]]))
        return self

    def image(self, name: str, text: str = "") -> Report:
        self.parts.append(f"![{text}]({name})")
        return self

    def text(self) -> str:
        return "\n\n".join(self.parts) + "\n"


def told(df: DataFrame, report: str, place: int, text: Column) -> DataFrame:
    """A section for each row of a small result: a sentence made from its figures."""
    return df.select(F.lit(report).alias("report"), F.lit(place).alias("place"), text.alias("text"))


def heading(spark: SparkSession, report: str, place: int, text: str, level: int = 2) -> DataFrame:
    return told(spark.range(1), report, place, F.lit("#" * level + " " + text))


def paragraph(spark: SparkSession, report: str, place: int, text: str) -> DataFrame:
    return told(spark.range(1), report, place, F.lit(" ".join(text.split())))


def table_section(df: DataFrame, report: str, place: int, order: Sequence[str] = (), digits: int = 3, most: int = 200) -> DataFrame:
    """A section that holds a small result as a table, in order of columns; more than
    ``most`` rows are an error."""
    show = lambda c: F.format_number(c, digits) if dict(df.dtypes)[c] in ("double", "float") else F.regexp_replace(F.col(f"`{c}`").cast("string"), r"\|", "\\\\|")
    cells = F.concat(F.lit("| "), F.array_join(F.array(*[F.coalesce(show(c), F.lit("")) for c in df.columns]), " | "), F.lit(" |"))
    lines = df.select(F.struct(*[F.col(f"`{c}`") for c in order], cells.alias("line")).alias("row"))
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    all_ = lines.agg(F.array_sort(F.collect_list("row")).alias("rows"))  # a small result
    checked = F.when(F.size("rows") > most, F.raise_error(F.lit(f"more than {most} rows for a report"))).otherwise(F.array_join(F.concat(F.array(F.lit(head)), F.col("rows.line")), "\n"))
    return told(all_, report, place, checked)


def assembled(sections: Sequence[DataFrame]) -> DataFrame:
    """(report, text): the sections of each report in order of place, as one document."""
    out = sections[0]
    for more in sections[1:]:
        out = out.unionByName(more)
    rows = out.groupBy("report").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("rows"))
    return rows.select("report", F.concat(F.array_join("rows.text", "\n\n"), F.lit("\n")).alias("text"))


def ticks(n: int, most: int = 8) -> list[int]:
    """Evenly spread places of at most ``most`` labels among n points, each once."""
    if n <= 0:
        return []
    k = min(n, most)
    return sorted({i * (n - 1) // max(1, k - 1) for i in range(k)})


def bar_chart(df: DataFrame, label: str, values: Sequence[str], title: str, width: int = 900, height: int = 420, most: int = 500) -> str:
    """Grouped bars of a small frame as SVG; a missing value has no bar."""
    rows = df.select(label, *values).orderBy(label).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} groups")
    known = [r[v] for r in rows for v in values if r[v] is not None] or [0.0]
    low, high = min(0.0, *known), max(0.0, *known)
    unit = (height - 80) / ((high - low) or 1.0)
    zero, step = height - 40 + low * unit, (width - 60) / max(1, len(rows))
    bars = []
    for i, r in enumerate(rows):
        for k, v in enumerate(values):
            if r[v] is not None:
                tall = r[v] * unit
                x, w = 40 + i * step + k * step * 0.8 / len(values), step * 0.8 / len(values)
                bars.append(f'<rect x="{x:.1f}" y="{zero - max(tall, 0):.1f}" width="{w:.1f}" height="{abs(tall):.1f}" fill="hsl({k * 67 % 360},60%,45%)"/>')
    names = "".join(f'<text x="{40 + i * step:.1f}" y="{height - 8}">{rows[i][label]}</text>' for i in ticks(len(rows)))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><text x="20" y="24">{title}</text>{"".join(bars)}{names}</svg>\n'


def summary_lines(winner: str, scores: DataFrame, pressure: DataFrame) -> DataFrame:
    """(line): a few sentences about a forecast, made from its figures."""
    best = scores.where(F.col("model") == winner).select(F.format_string("Selected model: %s (RMSE %.3f, MAE %.3f).", F.lit(winner), "rmse", "mae").alias("line"))
    ahead = pressure.select(F.format_string("Forecast mean %.1f; peak %.1f in %s; trough %.1f in %s; %d months at or over the threshold.", "mean", "peak", "peak_month", "trough", "trough_month", "months_over").alias("line"))
    return best.unionByName(ahead)
