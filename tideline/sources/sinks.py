"""Sinks: CSV, JSON and text by Spark's writers, a manifest of what was written, and
small reports. Packing files into a ZIP is the one thing the driver does itself."""

from __future__ import annotations

import hashlib
import json
import math
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Files up to this size are hashed as one value, others in blocks.
WHOLE_BYTES, BLOCK_BYTES = 256 << 20, 8 << 20


def write_csv(df: DataFrame, path: str, one_file: bool = False, mode: str = "overwrite") -> None:
    """CSV with a header; ``one_file`` is for results that are known to be small."""
    (df.coalesce(1) if one_file else df).write.mode(mode).option("header", True).csv(path)


def write_text(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Lines of a frame with one string column."""
    df.write.mode(mode).text(path)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON text for each row, its keys sorted."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias(name))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    write_text(as_json(df), path, mode)


def json_ready(value):
    """Rows, numbers, dates and containers as JSON knows them; what is not finite is
    null."""
    import datetime

    import numpy as np
    from pyspark.sql import Row

    if isinstance(value, Row):
        return json_ready(value.asDict())
    if isinstance(value, Mapping):
        return {str(k): json_ready(v) for k, v in value.items()}
    if isinstance(value, np.ndarray):
        return json_ready(value.tolist())
    if isinstance(value, (list, tuple, set, frozenset)):
        return [json_ready(v) for v in (sorted(value) if isinstance(value, (set, frozenset)) else value)]
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, np.generic):
        return json_ready(value.item())
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return str(value) if isinstance(value, Path) else value


def results_json(parts: Mapping[str, DataFrame | object], most: int = 10_000) -> str:
    """A nested document of small results; a frame of more than ``most`` rows is an
    error and not cut."""
    out = {}
    for name, part in parts.items():
        if isinstance(part, DataFrame):
            rows = part.limit(most + 1).collect()
            if len(rows) > most:
                raise ValueError(f"{name} has more than {most} rows; write it as a table")
            out[name] = rows
        else:
            out[name] = part
    return json.dumps(json_ready(out), indent=2, sort_keys=True) + "\n"


def manifest(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, bytes, sha256) of the files under a path, hashed where they are read; files
    of more than ``WHOLE_BYTES``, too large for one value, in blocks."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    small = files.where(F.col("length") <= WHOLE_BYTES).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > WHOLE_BYTES).select("path", F.col("length").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = []
            for uri in b.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(uri)
                digest = hashlib.sha256()
                with store.open_input_stream(at) as file:
                    while block := file.read(BLOCK_BYTES):
                        digest.update(block)
                hashes.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hashes, pa.string())], names=["path", "bytes", "sha256"])

    return small.unionByName(large.mapInArrow(run, "path string, bytes long, sha256 string"))


def zip_files(target: str, members: Mapping[str, str]) -> None:
    """A ZIP of local files under given names, in order of name."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as z:
        for name in sorted(members):
            z.write(members[name], name)


def padded_range(df: DataFrame, values: Sequence[str], share: float = 0.08) -> DataFrame:
    """(low, high): the range that a chart's axis needs, with some room at both ends."""
    low, high = F.least(*[F.min(v) for v in values]) if len(values) > 1 else F.min(values[0]), F.greatest(*[F.max(v) for v in values]) if len(values) > 1 else F.max(values[0])
    room = F.when(high > low, (high - low) * share).otherwise(F.lit(1.0))
    return df.agg((low - room).alias("low"), (high + room).alias("high"))


def line_chart(df: DataFrame, x: str, values: Sequence[str], title: str, width: int = 900, height: int = 420, most: int = 5000) -> str:
    """An SVG line chart of a small frame; a missing value leaves a gap."""
    rows = df.select(x, *values).orderBy(x).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} points; aggregate them first")
    known = [r[v] for r in rows for v in values if r[v] is not None]
    low, high = (min(known), max(known)) if known else (0.0, 1.0)
    room = (high - low) * 0.08 or 1.0
    low, high = low - room, high + room
    place = lambda i, v: (60 + i * (width - 80) / max(1, len(rows) - 1), height - 40 - (v - low) * (height - 80) / (high - low))
    lines = []
    for k, v in enumerate(values):
        run: list[str] = []
        for i, r in enumerate([*rows, None]):
            if r is not None and r[v] is not None:
                run.append("{:.1f},{:.1f}".format(*place(i, r[v])))
            elif run:
                lines.append(f'<polyline class="s{k}" fill="none" stroke="hsl({k * 67 % 360},60%,40%)" points="{" ".join(run)}"/>')
                run = []
        lines.append(f'<text x="{70 + 160 * k}" y="{height - 10}" fill="hsl({k * 67 % 360},60%,40%)">{v}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><text x="20" y="24">{title}</text>{"".join(lines)}</svg>\n'
