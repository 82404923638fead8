from __future__ import annotations

import pyarrow as pa
from tideline.llm import packing, tiling, tokens

D = "/root/testdata/sf0.001"


def kept_by_workers(spark) -> int:
    """Tables that reused Python workers hold."""

    def run(batches):
        list(batches)
        n = tokens.word_ids.cache_info().currsize + tiling.word_hashes.cache_info().currsize
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return sum(r.n for r in spark.range(0, 64, 1, 16).mapInArrow(run, "n long").collect())


def test_tables_end_with_their_task(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").repartition(8)
    assert packing.pieces(docs, tokens.tokenizer_path(tokens.WORD_TOKENIZER)).count() > 0
    assert kept_by_workers(spark) == 0
    assert tiling.contaminated(docs, spark.read.parquet(f"{D}/benchmark.parquet")).count() > 0
    assert kept_by_workers(spark) == 0
