"""What the operators of this subpackage share: shared storage, batches, words."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raw text bytes that one step of a Python worker holds at a time.
CHUNK_BYTES = 8 << 20


#: Arrow batches between Spark and its Python workers stand in both, several at once; and
#: what a task reads of a shuffle stands in network buffers and sorters. Small executors
#: have room for little of either.
BYTES_CONF = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20}


def prepare(spark: SparkSession) -> None:
    """Let Python workers that Spark starts on this machine import the package, and let
    tasks take batches and partitions of few bytes, unless the session asks for fewer.

    On a cluster the package is shipped with ``--py-files`` or installed."""
    for name, most in BYTES_CONF.items():
        plain = re.fullmatch("([0-9]+)b?", spark.conf.get(name))
        if plain and int(plain[1]) > most:
            spark.conf.set(name, f"{most}b")
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the storage that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; a local folder serves only
    where all of Spark runs on this machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tideline-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to shared storage and read it back: the lineage ends there,
    so a lost executor costs no more than the tasks it was running."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(taken: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as it takes to differ from all
    of ``taken`` (whatever the case) and from each other."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


_TASK_TABLES: list[Callable] = []


def task_table(make: Callable) -> Callable:
    """``make`` with its results kept by a worker until the end of the task, see
    :func:`release`: a table of words met is full within a task and helps the next one
    little, but would stand beside all later stages."""
    kept = cache(make)
    _TASK_TABLES.append(kept)
    return kept


def release() -> None:
    """Drop the task's tables and give freed memory back to the system: Python workers
    live on between tasks, two or more of them beside an executor's heap."""
    filled = [t for t in _TASK_TABLES if t.cache_info().currsize]
    for t in filled:
        t.cache_clear()
    if filled:
        gc.collect()  # tables and what fills them refer to each other
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``max_bytes`` in each; a longer
    single text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to
    release()


BITMAP_BITS = 26


def bitmap_of(rows: DataFrame, column: str, bits: int = BITMAP_BITS) -> bytes:
    """Bitmap of hashes (signed longs) by their leading bits: 2^bits bits, whatever the
    number of rows; the larger it is beside that, the fewer false hits it has."""
    place = F.shiftrightunsigned(column, 64 - bits) + 1
    blocks = rows.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = bytearray(max(4096, 1 << (bits - 3)))
    for r in blocks.collect():  # at most 2^bits / 32768 rows of 4 KB
        out[(r.block - 1) * 4096 : r.block * 4096] = r.bits
    return bytes(out[: max(1, 1 << (bits - 3))])


def in_bitmap(bitmap: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (uint64) a bitmap marks."""
    place = hashes >> np.uint64(64 - (len(bitmap).bit_length() + 2))
    marks = np.frombuffer(bitmap, np.uint8)
    return ((marks[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def sieved(rows: DataFrame, hash_col: str, bitmap, wanted: bool = True) -> DataFrame:
    """The rows whose hash a broadcast bitmap marks, or those that it doesn't; nothing
    is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = b.column(b.schema.get_field_index(hash_col)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield b.filter(pa.array(in_bitmap(bitmap.value, hashes) == wanted))

    return rows.mapInArrow(run, rows.schema)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is the empty text."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def texts(column: pa.Array) -> list[str]:
    """Texts as str; null is the empty text."""
    return pc.fill_null(column, "").to_pylist()
