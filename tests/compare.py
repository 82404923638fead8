"""Run queries beside their SQL in DuckDB: ``python tests/compare.py [--sf sf0.01] NAME...``"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    import datetime
    import decimal

    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if both give the same rows; else the first difference."""
    import duckdb

    df = query(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = path + "/*.parquet" if Path(path).is_dir() else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    theirs = rows_of(columns, got.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    return next((f"{a} against {b}" for a, b in zip(ours, theirs, strict=True) if a != b), "")


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(args: list[str]) -> None:
    import __spark_entry__ as entry

    sf = args[args.index("--sf") + 1] if "--sf" in args else "sf0.01"
    names = [a for a in args if a not in ("--sf", sf)]
    spark, queries, sql = session(), entry.queries(), entry.oracle_sql()
    for name in names or queries:
        began = time.time()
        try:
            if name in sql:
                bad = compare(spark, f"/root/testdata/{sf}", queries[name], sql[name])
                said = "DIFFERS " + bad if bad else "same"
            else:
                said = f"{queries[name](spark, f'/root/testdata/{sf}').count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001  the next query is still of interest
            said = f"FAILED {str(e)[:400]}"
        print(name, said, f"{time.time() - began:.1f} s", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
