from __future__ import annotations

import gzip
import hashlib
import io
import zipfile

import pytest
from pyarrow import fs

from tideline.llm import warc
from tideline.llm.common import shared_dir


class Sink(io.BytesIO):
    def close(self):
        pass


def test_zip_as_others_read_it():
    sink = Sink()
    w = warc.ZipWriter(sink)
    w.begin("a.txt")
    assert w.add(b"hello ") == (0, 6) and w.add(b"you") == (6, 3)
    w.end()
    w.begin("é.bin")
    w.end()
    w.close()
    data = sink.getvalue()
    z = zipfile.ZipFile(io.BytesIO(data))
    assert z.testzip() is None and z.read("a.txt") == b"hello you" and z.namelist() == ["a.txt", "é.bin"]
    found = warc.members(io.BytesIO(data), len(data))
    at, n = found["a.txt"]
    assert data[at : at + n] == b"hello you" and found["é.bin"][1] == 0


@pytest.mark.parametrize("comment", [b"", b"note PK\x05\x06 in a comment"])
def test_zip_that_others_wrote(comment):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("s.bin"), b"stored")
        z.writestr("d.bin", b"deflated" * 50, zipfile.ZIP_DEFLATED)
        with z.open("big.bin", "w", force_zip64=True) as f:
            f.write(b"wide")
        z.comment = comment
    data = out.getvalue()
    found = warc.members(io.BytesIO(data), len(data))
    assert found.pop("d.bin")[0] is None and set(found) == {"s.bin", "big.bin"}
    assert all(data[a : a + n] == want for (a, n), want in ((found["s.bin"], b"stored"), (found["big.bin"], b"wide")))
    for broken in (b"", b"no archive", data[:-30]):
        with pytest.raises(ValueError):
            warc.members(io.BytesIO(broken), len(broken))


def test_record_round_trip():
    raw = warc.warc_record("response", 5, "http://x.example/ä b", b"<p>\r\n\r\n</p>", hashlib.sha1(b"x").digest(), None)
    fields, http, payload = warc.parse_record(raw)
    assert payload == b"<p>\r\n\r\n</p>" and fields["WARC-Target-URI"] == "http://x.example/ä b" and http["Content-Length"] == "11"
    with pytest.raises(ValueError):
        warc.parse_record(raw[:-20])
    with pytest.raises(ValueError):
        warc.parse_record(b"junk\r\n\r\n")


def record(i: int, kind: str = "response", extra: str = "") -> bytes:
    body = b"HTTP/1.1 200 OK\r\nX-A: b\r\n\r\npage %d" % i if kind == "response" else b"software: other\r\n"
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://h/{i}\r\n{extra}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def package(folder, name: str, parts: dict[str, bytes], deflated=()) -> str:
    path = folder / name
    with zipfile.ZipFile(path, "w") as z:
        for n, data in parts.items():
            z.writestr(zipfile.ZipInfo(n), data, zipfile.ZIP_DEFLATED if n in deflated else zipfile.ZIP_STORED)
    return f"file://{path}"


def test_packages_of_other_tools(spark, tmp_path):
    zipped = [gzip.compress(record(i, extra="X-Folded: one\r\n two\r\n")) for i in range(5)]
    plain = [record(9, "warcinfo"), *[record(i) for i in range(5, 8)]]
    starts = [sum(map(len, zipped[:i])) for i in range(5)]
    cdxj = "".join(f'com,h)/{i} 20200101000000 {{"url": "http://h/{i}", "filename": "a.warc.gz", "offset": "{starts[i]}", "length": "{len(zipped[i])}"}}\n' for i in (3, 0, 1, 2, 4))
    cdx = " CDX N b a m s k r M S V g\n" + "".join(f"k 2020 http://h/{i} text/html 200 X - - {len(zipped[i])} {starts[i]} a.warc.gz\n" for i in range(5))
    urls = [
        package(tmp_path, "1.wacz", {"archive/a.warc.gz": b"".join(zipped), "indexes/index.cdxj": cdxj.encode(), "archive/b.warc": b"".join(plain), "pages/pages.jsonl": b"{}"}, ["pages/pages.jsonl"]),
        package(tmp_path, "2.wacz", {"archive/a.warc.gz": b"".join(zipped), "indexes/index.cdx": cdx.encode()}),
        package(tmp_path, "3.wacz", {"data.warc.gz": b"".join(zipped)}),
    ]
    got = warc.read_archives(spark.createDataFrame([(u, None) for u in urls], "archive string, records long")).collect()
    assert sorted(r.url for r in got if r.record_type == "response") == sorted([f"http://h/{i}" for i in range(8)] + [f"http://h/{i}" for i in range(5)] * 2)
    assert [r.payload for r in got if r.record_type == "warcinfo"] == [b"software: other\r\n"]
    assert all(r.payload == b"page " + r.url[-1:].encode() and r.payload_digest == hashlib.sha1(r.payload).hexdigest() for r in got if r.record_type == "response")


def test_packages_at_fault(tmp_path):
    one = gzip.compress(record(1))
    faulty = {
        "deflated": ({"a.warc.gz": one * 50}, ["a.warc.gz"]),
        "none": ({"a.txt": b"x"}, []),
        "short": ({"a.warc.gz": one[:-9]}, []),
        "behind": ({"a.warc.gz": one, "i.cdxj": b'k 1 {"filename": "a.warc.gz", "offset": 0, "length": 9999}'}, []),
        "junk": ({"a.warc": b"junk"}, []),
    }
    for name, (parts, deflated) in faulty.items():
        store, path = fs.FileSystem.from_uri(package(tmp_path, name, parts, deflated))
        with store.open_input_file(path) as file, pytest.raises(ValueError):
            list(warc.located(file, file.size()))
    with pytest.raises(ValueError):
        warc.parse_record(b"WARC/1.0\r\nno colon here\r\nContent-Length: 0\r\n\r\n")
    with pytest.raises(ValueError):
        warc.parse_record(b"WARC/1.0\r\nA: b\r\n\r\n")


def test_record_names():
    a, b = b"1" * 20, b"2" * 20
    assert len({warc.record_urn(1, a), warc.record_urn(1, b), warc.record_urn(2, a), warc.record_urn(None, a, "0:x:1"), warc.record_urn(None, a, "0:x:2")}) == 5


def want_of(rows):
    digest = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    largest: dict = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            largest[digest(h)] = max(i, largest.get(digest(h), i))
    out = []
    for i, _, h in rows:
        top = largest.get(digest(h))
        other = top is not None and i != top
        out.append((i, len((h or "").encode()), digest(h), "revisit" if other else "response", top if other else None))
    return sorted(out, key=repr)


def test_rows(spark):
    big = "é" * 600
    rows = [(1, "http://a/", big), (2, None, big), (3, "u\nv", big), (3, "u\nv", big), (4, "x", "small"), (5, "x", "small"), (6, "x", None), (None, "x", big), (None, "y", "z" * 1000), (7, "x", "long " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "2 AS digest")
    got = sorted([tuple(r) for r in warc.round_trip(df, shared_dir(spark)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()], key=repr)
    assert got == want_of(rows)
    assert warc.round_trip(df.limit(0), shared_dir(spark)).count() == 0


def test_archives(spark):
    """Several archives for a task, ranges cut small, and the data as gzip reads it."""
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * (i % 200 + 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    folder = shared_dir(spark)
    manifest = warc.write_archives(warc.decided(df, "page_id", "url", "html"), folder, archive_bytes=4000)
    archives = [r.archive for r in manifest.collect()]
    assert len(archives) > 4 and all(a.endswith(".zip") for a in archives)
    got = warc.read_archives(manifest, range_bytes=500).collect()
    html = {i: h for i, _, h in rows}
    assert sorted(r.page_id for r in got) == list(range(300))
    assert all(r.payload.decode() == html[r.page_id] for r in got if r.record_type == "response")
    store, path = fs.FileSystem.from_uri(archives[0])
    with store.open_input_file(path) as f:
        z = zipfile.ZipFile(io.BytesIO(f.read()))
    assert z.testzip() is None and gzip.decompress(z.read(warc.DATA)).startswith(b"WARC/1.1\r\n")


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in df.collect()]
    got = sorted([tuple(r) for r in warc.round_trip(df, shared_dir(spark)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()], key=repr)
    assert got == want_of(rows)
