from __future__ import annotations

import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tideline.operators import contract, report
from tideline.sources import packs, sinks


def test_pack(spark, tmp_path):
    root = f"file://{tmp_path}"
    contents = {"b/two.txt": b"two " * 5000, "a.csv": b"x,y\n1,2\n", "empty": b"", "é.md": "# é\n".encode()}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "name string, content binary").repartition(3)
    one = packs.write_pack(df, f"{root}/one.zip").first()
    packs.write_pack(df.repartition(2), f"{root}/two.zip")
    raw = (tmp_path / "one.zip").read_bytes()
    assert raw == (tmp_path / "two.zip").read_bytes() and one.sha256 == hashlib.sha256(raw).hexdigest() and (one.members, one.bytes) == (4, len(raw))
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and z.namelist() == sorted(contents) and {n: z.read(n) for n in z.namelist()} == contents
    with pytest.raises(Exception, match="two members"):
        packs.write_pack(df.unionByName(df), f"{root}/bad.zip")
    assert not (tmp_path / "bad.zip").exists()


def test_members_are_those_of_the_manifest(spark, tmp_path):
    root = f"file://{tmp_path}"
    sinks.write_csv(spark.range(20).withColumn("v", F.col("id") * 2), f"{root}/t.csv", one_file=True)
    packs.write_pack(packs.files(spark, {"t.csv": f"{root}/t.csv"}), f"{root}/p.zip")
    listed = sinks.manifest(spark, f"{root}/t.csv", "part-*").first()
    with zipfile.ZipFile(tmp_path / "p.zip") as z:
        assert hashlib.sha256(z.read("t.csv")).hexdigest() == listed.sha256


def test_written_table(spark, tmp_path):
    """A damaged file is found, whatever is wrong with it."""
    path = tmp_path / "t.csv"
    want = contract.Expectation(("year_month", "forecast"), contract.months("2023-11-01", 3), ("forecast",))
    good = "year_month,forecast\n2023-11,1.5\n2023-12,2.0\n2024-01,-3e-2\n"
    faults = lambda: {(r.fault, r.detail) for r in contract.written_faults(spark, f"file://{path}", want).collect()}
    path.write_text(good)
    assert not faults()
    rows = sinks.manifest(spark, f"file://{path}").collect()
    manifest = spark.createDataFrame(rows, "path string, bytes long, sha256 string")  # as it was
    assert len(rows) == 1
    contract.assert_written(spark, f"file://{path}", want, manifest)
    for damaged, kind in (
        (good.replace("forecast", "value", 1), "header"),
        (good.replace("2023-12,2.0\n", ""), "key"),
        (good + "2024-02,1\n", "key"),
        (good.replace("2023-11,1.5\n2023-12,2.0", "2023-12,2.0\n2023-11,1.5"), "key"),
        (good.replace("2.0", "NaN"), "not finite"),
        (good.replace("2.0", "two"), "not finite"),
        (good.replace("2.0", "2.0,7"), "fields"),
        (good.replace("1.5", "1.50"), "bytes"),
    ):
        path.write_text(damaged)
        found = {r.fault for r in contract.written_faults(spark, f"file://{path}", want, manifest).collect()}
        assert kind in found and "bytes" in found
        with pytest.raises(ValueError, match=kind):
            contract.assert_written(spark, f"file://{path}", want, manifest)


def test_reports(spark):
    df = spark.createDataFrame([("b|x", 2, 0.5), ("a", 1, None), ("c", 3, 1234.5678)], "name string, n int, v double")
    sections = [report.paragraph(spark, "one", 2, "some \n text"), report.heading(spark, "one", 1, "Title", 1), report.table_section(df, "one", 3, ["n"]), report.told(df.where("n = 3"), "two", 1, F.format_string("%s has %.2f.", "name", "v"))]
    got = {r.report: r.text for r in report.assembled(sections).collect()}
    assert got["one"] == "# Title\n\nsome text\n\n| name | n | v |\n| --- | --- | --- |\n| a | 1 |  |\n| b\\|x | 2 | 0.500 |\n| c | 3 | 1,234.568 |\n"
    assert got["two"] == "c has 1234.57.\n"
    with pytest.raises(Exception, match="more than 2 rows"):
        report.assembled([report.table_section(df, "x", 1, most=2)]).collect()
