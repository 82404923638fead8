"""ZIP packs written by tasks: members are compressed side by side, one task puts them in
a row and the directory behind them under a name of its own, and a rename commits the
pack, so a lost task leaves no half pack. Equal members make equal bytes: they go in order
of name, with one fixed date."""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: signatures, UTF-8 names, deflate, and 1980-01-01 as its date.
LOCAL, CENTRAL, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
VERSION, UTF8, DEFLATE, TIME, DATE = 20, 0x800, 8, 0, 33
#: Bytes and members of a pack, as the format without extensions holds them.
MOST_BYTES, MOST_MEMBERS = (1 << 32) - 1, (1 << 16) - 1


def files(spark: SparkSession, members: Mapping[str, str]) -> DataFrame:
    """(name, content): the files under paths that Spark reads, by their names in a pack. A
    path may be a folder that holds one file."""
    out = None
    for name, path in members.items():
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[!._]*").load(path).select(F.lit(name).alias("name"), "content")
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("a pack has members")
    return out


def compressed(members: DataFrame) -> DataFrame:
    """(name, crc, size, data) from (name, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                deflate = zlib.compressobj(9, zlib.DEFLATED, -15)
                data = deflate.compress(content) + deflate.flush()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([zlib.crc32(content)], pa.int64()), pa.array([len(content)], pa.int64()), pa.array([data], pa.binary())], names=["name", "crc", "size", "data"])

    return members.mapInArrow(run, "name string, crc long, size long, data binary")


def write_pack(members: DataFrame, target: str) -> DataFrame:
    """Write (name, content) as the ZIP ``target`` (a URI); returns (path, members, bytes,
    sha256), one row. Names that come twice are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(target)
        beside = f"{path}.{uuid.uuid4().hex}"
        digest, at, directory, last = hashlib.sha256(), 0, [], None
        with store.open_output_stream(beside) as out:

            def put(data: bytes) -> None:
                nonlocal at
                out.write(data)
                digest.update(data)
                at += len(data)

            for b in batches:
                for name, crc, size, data in zip(*[b.column(c).to_pylist() for c in ("name", "crc", "size", "data")], strict=True):
                    if name == last:
                        raise ValueError(f"two members are called {name}")
                    last, raw = name, name.encode()
                    facts = struct.pack("<HHHHHIIIHH", VERSION, UTF8, DEFLATE, TIME, DATE, crc, len(data), size, len(raw), 0)
                    if max(at + len(data), size) > MOST_BYTES or len(directory) >= MOST_MEMBERS:
                        raise ValueError("too large for a pack")
                    directory.append(CENTRAL + struct.pack("<H", VERSION) + facts + struct.pack("<HHHII", 0, 0, 0, 0, at) + raw)
                    put(LOCAL + facts + raw)
                    put(data)
            begin = at
            for entry in directory:
                put(entry)
            n = len(directory)
            put(END + struct.pack("<HHHHIIH", 0, 0, n, n, at - begin, begin, 0))
        store.move(beside, path)
        yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([n], pa.int64()), pa.array([at], pa.int64()), pa.array([digest.hexdigest()])], names=["path", "members", "bytes", "sha256"])

    spark = members.sparkSession
    one = compressed(members).repartition(1).sortWithinPartitions("name")  # streamed, a member at a time
    rows = one.mapInArrow(run, "path string, members long, bytes long, sha256 string").collect()
    return spark.createDataFrame(rows, "path string, members long, bytes long, sha256 string")
