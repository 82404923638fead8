"""Benchmark decontamination (operator 1): greedy string tiling.

Texts are lower-cased and cut into runs of letters and digits.

1. Seeds. Every ``min_match`` (5) tokens in a row of an item are a seed (an item of
   fewer tokens is one seed whole). A bitmap of fixed size marks the items' seeds, and
   one pass over the documents keeps those of their seeds that it marks: a few numbers
   for each distinct text, never the text.
2. Candidates. Seeds of texts and items are joined in Spark. Tiles of at least
   ``min_match`` tokens that cover a share of an item hold at least a fifth of that
   share of its seeds, so a text that meets fewer is no candidate. Half as many of an
   item's seeds, the most frequent ones, need no joining: the others are met all the same.
3. Tiling. Each candidate text, once however often it stands in the table, meets its
   items in one task. The longest matches that overlap no earlier one are marked again
   and again, longest first: running Karp-Rabin hashes tell the longest length that is
   left (by halving), and all matches of that length are marked, the first in the item
   first; what is left of broken matches comes up again at its own length. The share of
   the item's tokens under tiles is its coverage, and a text is contaminated by an item
   of which it covers at least ``threshold`` (0.8), in any order of the passages.
4. What was found goes back to the rows by the hash of their texts.

The benchmark may have any size: it is never collected or broadcast, and the documents
are read once to find candidates and once to name them.

Defined cases: null or empty texts on either side match nothing; repeated rows are
judged alike and all returned; ids may be null; an empty table on either side gives
no rows; extra columns are ignored by :func:`contaminated` and kept by
:func:`decontaminate`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BITMAP_BITS, bitmap_of, free_names, in_bitmap, materialise, sieved, slices, table, task_table, texts
from .tokens import Recent

MIN_MATCH = 5
THRESHOLD = 0.8
SLICE_BYTES = 2 << 20
#: Words of a generation of which a task keeps the hashes.
KEPT_WORDS = 100_000

_TOKENS = re.compile(r"[^\W_]+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def tokens(text: str) -> list[str]:
    return _TOKENS.findall(text.lower())


@task_table
def word_hashes() -> Recent:
    from xxhash import xxh64_intdigest

    return Recent(xxh64_intdigest, KEPT_WORDS)


def hashed(words: list[str]) -> np.ndarray:
    return np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))


def run_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` values (uint64), rolled over the array."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, mixed = np.zeros(n, np.uint64), values * _B
    for j in range(length):
        out = out * _A + mixed[j : j + n]
    return out ^ (out >> np.uint64(31)) ^ np.uint64(length)


class Side:
    """A sequence of numbers with marks on it, and hashes of its unmarked runs."""

    def __init__(self, values: Sequence[int]) -> None:
        self.values = np.asarray(values, np.int64)
        self.taken = np.zeros(len(self.values), bool)
        mixed = (self.values.astype(np.uint64) + np.uint64(1)) * _B
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _A
        # sums of value * A^place; a run's hash is shifted to place 0 by the inverse
        n = len(mixed)
        self._inverse = _powers(pow(int(_A), -1, 1 << 64), n + 1)
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * _powers(int(_A), n + 1)[:n], dtype=np.uint64)])

    def free(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of every unmarked run of this length."""
        marks = np.cumsum(np.r_[0, self.taken])
        at = np.flatnonzero(marks[length:] == marks[:-length])
        return at, (self._sums[at + length] - self._sums[at]) * self._inverse[at]


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def greedy_tiles(item: Sequence[int], text: Sequence[int], min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, length), the longest first and of equal ones
    the first in the item, then in the text: no token of either side is in two of them."""
    a, b = Side(item), Side(text)
    tiles: list[tuple[int, int, int]] = []

    def meets(length: int) -> bool:
        return bool(np.isin(a.free(length)[1], b.free(length)[1]).any())

    most = min(len(a.values), len(b.values))
    while most >= min_match:
        low, high = min_match - 1, most  # the longest length at which hashes meet
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if meets(mid) else (low, mid - 1)
        if low < min_match:
            break
        (at_a, hash_a), (at_b, hash_b) = a.free(low), b.free(low)
        fit_a, fit_b = np.isin(hash_a, hash_b), np.isin(hash_b, hash_a)
        where: dict[int, list[int]] = {}
        for h, t in zip(hash_b[fit_b].tolist()[::-1], at_b[fit_b].tolist()[::-1], strict=True):
            where.setdefault(h, []).append(t)  # the last one is the first in the text
        end = 0
        for i, h in zip(at_a[fit_a].tolist(), hash_a[fit_a].tolist(), strict=True):
            if i < end:
                continue
            held, unlike = where[h], []
            while held:
                t = held.pop()
                if b.taken[t] or b.taken[t + low - 1]:
                    continue  # tiles are no shorter than this run, so one that meets it holds an end
                if not np.array_equal(a.values[i : i + low], b.values[t : t + low]):
                    unlike.append(t)
                    continue
                a.taken[i : i + low] = b.taken[t : t + low] = True
                tiles.append((i, t, low))
                end = i + low
                break
            held += unlike[::-1]
        most = low - 1
    return tiles


def coverage(text: list[str], item: list[str], min_match: int) -> tuple[int, int]:
    """(tiles, tokens under tiles) of an item in a text."""
    number = {w: i + 1 for i, w in enumerate(dict.fromkeys(item))}
    ids = np.fromiter(map(number.get, text, repeat(0)), np.int64, len(text))
    length = min(min_match, len(item))
    tiles = greedy_tiles([number[w] for w in item], _relevant(ids, length), length)
    return len(tiles), sum(n for _, _, n in tiles)


def _relevant(ids: np.ndarray, length: int) -> np.ndarray:
    """A text without what no run of the item's words reaches; a gap is one -1."""
    edge = np.flatnonzero(np.diff(np.r_[False, ids > 0, False].astype(np.int8)))
    parts = [np.r_[ids[a:b], -1] for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= length]
    return np.concatenate(parts) if parts else ids[:0]


def item_seeds(items: DataFrame, min_match: int) -> DataFrame:
    """(item, seed, at, words): the seeds of each item (mark, text), its place and the
    item's number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            for mark, text in zip(b.column("mark").to_pylist(), texts(b.column("text")), strict=True):
                words = tokens(text)
                seeds = run_hashes(hashed(words), min(min_match, max(1, len(words))))
                if len(seeds):
                    n = len(seeds)
                    yield pa.RecordBatch.from_arrays([pa.array([mark] * n), pa.array(seeds.view(np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, len(words), np.int32))], names=["item", "seed", "at", "words"])

    return items.mapInArrow(run, "item string, seed long, at int, words int")


def needed(words: str, min_match: int, threshold: float) -> str:
    """SQL: seeds of an item of so many tokens that a text covering it must meet: of a
    tile of n tokens n - min_match + 1 are met, at the least one for min_match tokens."""
    return f"CASE WHEN {words} < {min_match} THEN 1 ELSE greatest(1, cast(ceil({threshold} * {words} / {min_match} - 1e-9) AS int)) END"


def candidates(rows: DataFrame, seeds: DataFrame, min_match: int, threshold: float, bits: int) -> DataFrame:
    """(mark, item): texts of ``rows`` (mark, text) that meet enough of an item's seeds."""
    spark = rows.sparkSession
    lengths = [r.words for r in seeds.where(f"words < {min_match}").select("words").distinct().collect()]  # at most four
    shared = spark.sparkContext.broadcast((bitmap_of(seeds, "seed", bits), sorted({*lengths, min_match})))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, lengths = shared.value
        for b in slices(batches, "text", SLICE_BYTES):
            names, found = [], []
            known: set[str] = set()
            for mark, text in zip(b.column("mark").to_pylist(), texts(b.column("text")), strict=True):
                if mark in known:
                    continue
                known.add(mark)
                values = hashed(tokens(text))
                for length in lengths:
                    seeds = run_hashes(values, length)
                    hit = np.unique(seeds[in_bitmap(bitmap, seeds)])
                    names += [mark] * len(hit)
                    found.append(hit)
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate(found).view(np.int64))], names=["mark", "seed"])

    met = rows.mapInArrow(run, "mark string, seed long").distinct()
    # half of the seeds that may be missed are left out, the most frequent ones
    frequent = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("item").orderBy(F.desc("n"), "seed", "at")
    ranked = seeds.join(frequent, "seed").select("item", "seed", F.row_number().over(w).alias("r"), F.expr(needed("words", min_match, threshold)).alias("least"))
    kept = ranked.withColumn("out", F.floor((F.col("least") - 1) / 2)).where("r > out").select("item", "seed", (F.col("least") - F.col("out")).alias("least"))
    counted = met.join(kept, "seed").groupBy("mark", "item").agg(F.count(F.lit(1)).alias("n"), F.first("least").alias("least"))
    return counted.where("n >= least").select("mark", "item")


def tiled(rows: DataFrame, items: DataFrame, pairs: DataFrame, min_match: int, threshold: float) -> DataFrame:
    """(mark, item, coverage, n_tiles, n_tokens) of the pairs that reach the threshold."""
    # texts that are no candidates stay where they are
    wanted = rows.sparkSession.sparkContext.broadcast(bitmap_of(pairs.select(F.xxhash64("mark").alias("h")), "h"))
    near = sieved(rows.withColumn("h", F.xxhash64("mark")), "h", wanted).drop("h")
    own = near.join(pairs.select("mark").distinct(), "mark", "left_semi").dropDuplicates(["mark"]).select("mark", F.lit(None).cast("string").alias("item"), "text")
    theirs = pairs.join(items.withColumnRenamed("mark", "item"), "item").select("mark", "item", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = None, []
        for b in slices(batches, "text", SLICE_BYTES):
            out = []
            for mark, item, text in zip(*[b.column(c).to_pylist() for c in ("mark", "item", "text")], strict=True):
                if item is None:
                    held, words = mark, tokens(text)
                elif mark == held:
                    own = tokens(text)
                    n, covered = coverage(words, own, min_match)
                    if own and covered >= threshold * len(own):
                        out.append((mark, item, covered / len(own), n, covered))
            if out:
                kinds = [pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["mark", "item", "coverage", "n_tiles", "n_tokens"])

    met = own.unionByName(theirs).repartition("mark").sortWithinPartitions("mark", F.col("item").asc_nulls_first())
    return met.mapInArrow(run, "mark string, item string, coverage double, n_tiles int, n_tokens int")


def found_in(rows: DataFrame, items: DataFrame, min_match: int, threshold: float, bits: int) -> DataFrame:
    """:func:`tiled` for all texts of ``rows`` and ``items`` (mark, text)."""
    items = materialise(items.where("text IS NOT NULL").dropDuplicates(["mark"]))
    seeds = materialise(item_seeds(items, min_match))
    rows = rows.where("text IS NOT NULL")
    pairs = materialise(candidates(rows, seeds, min_match, threshold, bits))
    return materialise(tiled(rows, items, pairs, min_match, threshold))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD, bits: int = BITMAP_BITS) -> DataFrame:
    """(id, item, coverage, n_tiles, n_tokens) for each row and each item that it
    covers; clean rows do not appear."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.md5(f"`{text_col}`").alias("mark"), F.col(f"`{text_col}`").alias("text"))
    items = benchmark.select(F.col(f"`{item_col}`").alias("name"), F.md5(f"`{item_text_col}`").alias("mark"), F.col(f"`{item_text_col}`").alias("text"))
    found = found_in(rows.select("mark", "text"), items.select("mark", "text"), min_match, threshold, bits)
    named = found.join(items.select(F.col("mark").alias("item"), "name"), "item")
    out = rows.select("id", "mark").join(named, "mark")
    return out.select(F.col("id").alias(id_col), F.col("name").alias(item_col), "coverage", "n_tiles", "n_tokens")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD, bits: int = BITMAP_BITS) -> DataFrame:
    """``docs`` without the rows that cover an item."""
    of = lambda df, c: df.select(F.md5(f"`{c}`").alias("mark"), F.col(f"`{c}`").alias("text"))
    found = found_in(of(docs, text_col), of(benchmark, item_text_col), min_match, threshold, bits)
    mark, h = free_names(docs.columns, "_mark", "_h")
    bad = found.select(F.col("mark").alias(mark)).distinct()
    marked = docs.sparkSession.sparkContext.broadcast(bitmap_of(bad.select(F.xxhash64(mark).alias("h")), "h"))
    hashed_ = docs.withColumn(h, F.xxhash64(F.md5(F.col(f"`{text_col}`"))))
    suspect, clean = (sieved(hashed_, h, marked, wanted).drop(h) for wanted in (True, False))
    return clean.unionByName(suspect.join(bad, F.md5(F.col(f"`{text_col}`")) == F.col(mark), "left_anti"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
