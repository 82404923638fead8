"""WARC records in ZIP archives (operator 8), written by tasks and read by ranges.

An archive that is written is a ZIP file of two stored (not deflated) members:
``archive/data.warc.gz`` with one gzip member for each WARC record, and
``indexes/index.cdxj`` with one line for each record (key, date, JSON). Writing streams records out and
never holds an archive; sizes and places beyond 32 bits go to ZIP64 fields.

The reader never extracts. It parses the end of the central directory (and its
ZIP64 form), the directory, and the members' local headers; reads the indexes (.cdxj, .cdx)
by their ranges, for any number of members that end in .warc or .warc.gz, and scans
those that no index tells of; and every task then reads runs of neighbouring records by
their ranges. Packages of other tools will do; a WARC member that is deflated, a damaged
record or an index that points nowhere raises ValueError.

Files go to a folder of the storage that the cluster shares, by pyarrow's file
systems, so a URI of any store that they open will do. Every attempt of a task writes
archives under names of its own, and which archives count is what the manifest says,
of which Spark keeps one attempt's rows; so a task may fail or run twice, and stores
without renaming will do.

Defined cases: a null payload is empty; a null URL writes no target header; of equal
payloads (by SHA-1 and length) of at least ``least_bytes`` bytes the rows with the
largest id are responses and the others revisit it, rows with a null id among the
others unless all are null; rows that repeat the largest id are all responses; each
row in is one row out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir, slices, table

LEAST_BYTES = 1000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Salts under which rows of one digest are spread.
SALTS = 64
#: Bytes that a reading task takes in one range.
RANGE_BYTES = 4 << 20
#: Records after which a task begins the next archive.
ARCHIVE_BYTES = 1 << 30
#: WARC-Date of what is written: the payloads carry no time of their own.
DATE = "1970-01-01T00:00:00Z"


def record_urn(page: int | None, digest: bytes, own: str | None = None) -> str:
    """Name of a record: of a page and payload, so that revisits can tell it; ``own`` sets
    apart records that nobody refers to."""
    name = f"tideline:{page}:{digest.hex()}" if own is None else f"tideline:record:{own}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def warc_record(kind: str, page: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, own: str | None = None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header, which tells the length
    of the payload that it does not repeat."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_urn(page, digest, own)),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", " ".join(url.split()))] if url else []),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()),
        *([("X-Page-ID", str(page))] if page is not None else []),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_urn(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields; a line that begins with a space goes on the one before."""
    found: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t") and name is not None:
            found[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"no header line: {line[:80]!r}")
        found[name] = value.strip()
    return found


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record; a record that is no HTTP
    message has none of the second, and its block is the payload."""
    head, end, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/") or not end:
        raise ValueError("no WARC record here")
    warc = _fields(lines[1:])
    size = warc.get("Content-Length", "")
    if not size.isdigit():
        raise ValueError("a record without Content-Length")
    block = rest[: int(size)]
    if len(block) < int(size):
        raise ValueError("the record is cut short")
    if not block.startswith(b"HTTP/"):
        return warc, {}, block
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, _fields(http.decode("latin-1").split("\r\n")[1:]), payload


def payload_sha1(warc: dict[str, str]) -> bytes | None:
    """The payload's SHA-1 as its record states it, in base 32 or hexadecimal."""
    kind, _, text = warc.get("WARC-Payload-Digest", "").partition(":")
    if kind.lower() != "sha1":
        return None
    return bytes.fromhex(text) if len(text) == 40 else base64.b32decode(text.upper())


def index_line(url: str | None, digest: str, at: int, length: int) -> bytes:
    """A CDXJ line: the URL from its host's end on, the date, and where the record is."""
    host, _, rest = (url or "").partition("://")[2].partition("/")
    key = ",".join(reversed(host.lower().split("."))) + ")/" + rest
    told = {"url": url or "", "digest": "sha1:" + digest, "filename": DATA.rsplit("/", 1)[-1], "offset": at, "length": length}
    return f"{''.join(key.split()) or '-'} {''.join(c for c in DATE if c.isdigit())} {json.dumps(told)}\n".encode()


def gzipped(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _extra64(*values: int) -> bytes:
    return struct.pack("<HH", 1, 8 * len(values)) + struct.pack(f"<{len(values)}Q", *values)


class ZipWriter:
    """Stored members, streamed; sizes stand in a ZIP64 data descriptor after each."""

    def __init__(self, out) -> None:
        self.out, self.at, self.members = out, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.head, self.crc = name.encode(), self.at, 0
        extra = _extra64(0, 0)
        # bit 3: sizes follow the data; bit 11: the name is UTF-8
        self._write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x808, 0, 0, 0x21, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(self.name), len(extra)) + self.name + extra)
        self.data = self.at

    def add(self, data: bytes) -> tuple[int, int]:
        """Append to the open member; offset in it and length."""
        offset = self.at - self.data
        self.crc = zlib.crc32(data, self.crc)
        self._write(data)
        return offset, len(data)

    def end(self) -> None:
        size = self.at - self.data
        self._write(struct.pack("<IIQQ", 0x08074B50, self.crc, size, size))
        self.members.append((self.name, self.crc, size, self.head))

    def close(self) -> None:
        directory = self.at
        for name, crc, size, head in self.members:
            extra = _extra64(size, size, head)
            self._write(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x808, 0, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra)
        length, n = self.at - directory, len(self.members)
        end = self.at
        self._write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, length, directory))
        self._write(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
        self._write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(length, 0xFFFFFFFF), 0xFFFFFFFF, 0))
        self.out.close()


def read_range(file, at: int, length: int) -> bytes:
    file.seek(at)
    data = file.read(length)
    if len(data) != length:
        raise ValueError("the archive is cut short")
    return data


def members(file, size: int) -> dict[str, tuple[int | None, int]]:
    """Where the data of every stored member lies: name -> (offset, length). Deflated and
    encrypted members have no offset: no range of them can be read alone."""
    tail_at = max(0, size - 65557)
    tail = read_range(file, tail_at, size - tail_at)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at)  # the signature stood in a comment
    if at < 0:
        raise ValueError("no end of a central directory")
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    if tail_at + at >= 20:
        mark, _, where, _ = struct.unpack("<IIQI", read_range(file, tail_at + at - 20, 20))
        if mark == 0x07064B50:
            fields = struct.unpack("<IQHHIIQQQQ", read_range(file, where, 56))
            if fields[0] != 0x06064B50:
                raise ValueError("no ZIP64 end of the central directory")
            n, length, start = fields[7:10]
    directory, found, at = read_range(file, start, length), {}, 0
    for _ in range(n):
        mark, _, _, flags, method, _, _, _, packed, full, name_n, extra_n, note_n, _, _, _, head = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
        if mark != 0x02014B50:
            raise ValueError("the central directory is damaged")
        name = directory[at + 46 : at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + name_n : at + 46 + name_n + extra_n]
        at += 46 + name_n + extra_n + note_n
        while len(extra) >= 4:
            kind, size_n = struct.unpack_from("<HH", extra)
            if kind == 1:  # only what did not fit stands there, in this order
                wide = iter(struct.unpack_from(f"<{size_n // 8}Q", extra, 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                head = next(wide) if head == 0xFFFFFFFF else head
            extra = extra[4 + size_n :]
        if method or flags & 1:
            found[name] = (None, packed)
            continue
        local = struct.unpack("<IHHHHHIIIHH", read_range(file, head, 30))
        if local[0] != 0x04034B50:
            raise ValueError("a local header is missing")
        found[name] = (head + 30 + local[9] + local[10], packed)
    return found


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def index_lines(text: str) -> Iterator[tuple[str, int, int]]:
    """(file, offset, length) of each line of a CDXJ index (key, date, JSON) or a CDX one
    (columns named by letters in its first line)."""
    letters: list[str] = []
    for line in text.splitlines():
        if line.split()[:1] == ["CDX"]:
            letters = line.split()[1:]
        elif "{" in line:
            told = json.loads(line[line.index("{") :])
            yield str(told["filename"]), int(told["offset"]), int(told["length"])
        elif line.strip() and not line.startswith("!"):
            told = dict(zip(letters, line.split(), strict=False))
            if not {"g", "V", "S"} <= set(told):
                raise ValueError(f"no index line: {line[:80]!r}")
            yield told["g"], int(told["V"]), int(told["S"])


def scanned(file, at: int, length: int, block: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(offset, length) of each record of a member without an index: of gzip members, or
    of plain records by their Content-Length."""
    end, begin = at + length, at
    while begin < end:
        head = read_range(file, begin, min(64 << 10, end - begin))
        if head[:2] == b"\x1f\x8b":
            z, pos = zlib.decompressobj(31), begin
            while not z.eof:
                if pos >= end:
                    raise ValueError("a record is cut short")
                data = read_range(file, pos, min(block, end - pos))
                pos += len(data)
                z.decompress(data)
            n = pos - begin - len(z.unused_data)
        else:
            top, mark, _ = head.partition(b"\r\n\r\n")
            size = _fields(top.decode("utf-8", "replace").split("\r\n")[1:]).get("Content-Length", "") if mark and top.startswith(b"WARC/") else ""
            if not size.isdigit():
                raise ValueError("no WARC record here")
            n = len(top) + 4 + int(size) + 4
        yield begin - at, min(n, end - begin)
        begin += n


def located(file, size: int) -> Iterator[tuple[int, int]]:
    """(place in the file, length) of every record of a package: members that end in
    .warc or .warc.gz, by the indexes in it (.cdx, .cdxj) or else by a scan."""
    found = members(file, size)
    data = {n: v for n, v in found.items() if n.endswith((".warc", ".warc.gz"))}
    if not data:
        raise ValueError("no WARC file in the package")
    told: dict[str, list[tuple[int, int]]] = {}
    for name, (at, length) in found.items():
        if name.endswith((".cdx", ".cdxj")) and at is not None:
            for file_name, offset, n in index_lines(read_range(file, at, length).decode()):
                told.setdefault(file_name.rsplit("/", 1)[-1], []).append((offset, n))
    for name, (at, length) in data.items():
        if at is None:
            raise ValueError(f"{name} is not stored, so its records cannot be read by ranges")
        for offset, n in sorted(set(told.get(name.rsplit("/", 1)[-1], []))) or scanned(file, at, length):
            if offset + n > length:
                raise ValueError(f"the index of {name} points behind its end")
            yield at + offset, n


def decided(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(id, url, payload, digest, refers_to, named): refers_to is null for a response,
    ``named`` tells those that others refer to."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    size = F.octet_length("payload")
    groups = rows.where(size >= least_bytes).groupBy("digest").agg(F.max("id").alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # rows of one digest go under many salts, so a page that many repeat is no hot task
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    other = F.col("largest").isNotNull() & ~F.col("id").eqNullSafe(F.col("largest"))
    named = F.col("largest").isNotNull() & ~other
    return spread.join(salted, ["digest", "salt"], "left").select("id", "url", "payload", "digest", F.when(other, F.col("largest")).alias("refers_to"), named.alias("named"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write records (as :func:`decided` gives them) to archives under ``folder``,
    some for each task; returns the manifest: archive, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = _opened(folder)
        store.create_dir(root, recursive=True)
        part, attempt, serial = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        out, index, done, count = None, [], [], 0

        def name() -> str:
            return f"part-{part:06d}-{attempt}-{serial:04d}.zip"

        def close() -> None:
            nonlocal out, index, serial
            out.end()
            out.begin(INDEX)
            for line in sorted(index):
                out.add(line)
            out.end()
            out.close()
            done.append((f"{folder}/{name()}", len(index)))
            out, index, serial = None, [], serial + 1

        for b in slices(batches, "payload"):
            for page, url, payload, digest, refers_to, named in zip(*[b.column(c).to_pylist() for c in ("id", "url", "payload", "digest", "refers_to", "named")], strict=True):
                if out is None:
                    out = ZipWriter(store.open_output_stream(f"{root}/{name()}"))
                    out.begin(DATA)
                kind = "response" if refers_to is None else "revisit"
                count += 1
                at, n = out.add(gzipped(warc_record(kind, page, url, payload, bytes.fromhex(digest), refers_to, None if named else f"{part}:{attempt}:{count}")))
                index.append(index_line(url, digest, at, n))
                if out.at >= archive_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["archive", "records"])

    return materialise(records.mapInArrow(run, "archive string, records long"))


def ranges(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(archive, at, lengths): runs of neighbouring records, from the archives' own
    directories and indexes. ``manifest`` names archives, and the records of each if they
    are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, records in zip(b.column("archive").to_pylist(), b.column("records").to_pylist(), strict=True):
                store, path = _opened(archive)
                with store.open_input_file(path) as file:
                    places = list(located(file, file.size()))
                if records is not None and len(places) != records:
                    raise ValueError(f"{archive}: {len(places)} records in the package, {records} in the manifest")
                out, size = [], 0
                for at, length in places:
                    if not out or size + length > range_bytes or at != out[-1][0] + size:
                        out.append((at, []))
                        size = 0
                    out[-1][1].append(length)
                    size += length
                yield pa.RecordBatch.from_arrays([pa.array([archive] * len(out)), pa.array([a for a, _ in out], pa.int64()), pa.array([n for _, n in out], pa.list_(pa.int64()))], names=["archive", "at", "lengths"])

    return manifest.mapInArrow(run, "archive string, at long, lengths array<bigint>")


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(manifest: DataFrame, with_payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every record of the archives, ours or others'. A payload is checked against its
    digest; that of a revisit is null, its length and digest come from its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, at, lengths in zip(b.column("archive").to_pylist(), b.column("at").to_pylist(), b.column("lengths").to_pylist(), strict=True):
                store, path = _opened(archive)
                with store.open_input_file(path) as file:
                    data = read_range(file, at, sum(lengths))
                out, begin = [], 0
                for n in lengths:
                    raw = data[begin : begin + n]
                    begin += n
                    warc, http, payload = parse_record(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw)
                    kind, digest = warc.get("WARC-Type", ""), payload_sha1(warc)
                    page, refers = warc.get("X-Page-ID"), warc.get("X-Refers-To-Page-ID")
                    if kind == "revisit":
                        told = http.get("Content-Length", "")
                        size, whole = int(told) if told.isdigit() else None, None
                    else:
                        size, whole, own = len(payload), payload, hashlib.sha1(payload).digest()
                        # others may take the digest before an encoding for transfer
                        if digest is not None and digest != own and "Transfer-Encoding" not in http:
                            raise ValueError(f"{archive}: the payload of {warc.get('WARC-Record-ID')} is damaged")
                        digest = digest or own
                    out.append((page and int(page), warc.get("WARC-Target-URI"), size, digest and digest.hex(), kind, refers and int(refers), whole if with_payload else None))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    places = ranges(manifest, range_bytes)
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return places.repartition(tasks, "archive", "at").mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    manifest = write_archives(decided(pages, id_col, url_col, html_col, least_bytes), folder)
    return read_archives(manifest, with_payload=False).drop("payload", "url").withColumnRenamed("page_id", id_col)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), shared_dir(spark))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS largest FROM q)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < largest THEN largest END AS refers_to
FROM r"""
