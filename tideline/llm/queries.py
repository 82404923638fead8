"""Queries and SQL of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chats, infill, packing, pii, simhash, substrings, tiling, token_counts, toxicity, url_filters, variants, warc
from .common import prepare


OPERATORS = (
    tiling.op1_decontamination,
    ann.op2_ann,
    packing.op3_best_fit_packing,
    simhash.op4_simhash,
    url_filters.op5_url_filters,
    toxicity.op6_toxicity,
    pii.op7_pii,
    warc.op8_warc,
    substrings.op9_substring_dedup,
    token_counts.op10_token_counts,
    variants.op11_spelling_variants,
    infill.op12_fill_in_middle,
    chats.op13_chat_formatting,
)


#: Windows of 13 words by their text: removed is what a window covers that also starts
#: in a smaller document.
SUBSTRINGS_SQL = r"""WITH w AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents)),
s AS (SELECT doc_id, i, word, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS win,
             count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS k FROM w),
f AS (SELECT doc_id, i, word, k = 13 AND min(CASE WHEN k = 13 THEN doc_id END) OVER (PARTITION BY win) < doc_id AS hit FROM s),
g AS (SELECT doc_id, i, word, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM f),
r AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM documents LEFT JOIN r USING (doc_id)"""


def _ready(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _ready(f) for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filters": url_filters.oracle(), "op8_warc": warc.ORACLE, "op9_substring_dedup": SUBSTRINGS_SQL, "op12_fill_in_middle": infill.ORACLE, "op13_chat_formatting": chats.oracle()}
