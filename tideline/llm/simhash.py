"""SimHash near-duplicates (operator 4): BK-trees over shards of fingerprints.

1. Fingerprints. Each text is lower-cased (A-Z), cut at ASCII white space, and
   every run of ``shingle`` words hashed by XXH64; bit i is set where more than
   half of the hashes have it set.
2. Classes. Equal fingerprints fall together first (a grouped minimum), so a
   group of thousands of copies is one node from here on.
3. Shards. Two fingerprints that differ in at most r = 2 of 64 bits agree on at
   least two of four 16-bit blocks, so each is sent to the six shards named by a
   pair of its blocks, and no near pair is missed. A shard with more than
   ``tree_size`` members is cut again by a third of the bits left (at least one
   third agrees), and once more if need be; the members of a shard then share 49
   bits, so no tree can exceed 2^15 nodes however large the corpus is.
4. Trees. In each shard a BK-tree keeps every child under its integer Hamming
   distance to the parent; a query follows only the edges d-r..d+r. Shards are
   sent to their queries by key: all trees together grow with the corpus, so
   sending them all to every executor would not be bounded.
5. Links are reduced inside a shard to a spanning forest, and components found
   by star contraction over the links of all shards.

Defined cases: null and empty texts have fingerprint zero, linked like any other;
a null id is never the least of its component unless all are null; repeated rows
come out as often as they came in; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, slices, table, utf8
from .components import components

RADIUS = 2
#: Members of a shard beyond which it is cut by further bits.
TREE_SIZE = 2048


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a UTF-8 text as an unsigned 64-bit integer."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= shingle:
        return xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    ones = np.zeros(64, np.int64)
    count = n - shingle + 1
    for lo in range(0, count, 65536):
        hi = min(count, lo + 65536)
        hashes = np.fromiter(
            (xxh64_intdigest(line[a:b], seed) for a, b in zip(starts[lo:hi].tolist(), ends[lo + shingle - 1 : hi + shingle - 1].tolist(), strict=True)),
            np.dtype("<u8"),
            hi - lo,
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for each row; fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("id"), _prints(b.column("text"))], names=["id", "fp"])

    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _prints(texts: pa.Array) -> pa.Array:
    return pa.array(np.fromiter(map(fingerprint, utf8(texts)), np.uint64, len(texts)).view(np.int64))


def with_fingerprint(rows: DataFrame, text_col: str, name: str) -> DataFrame:
    """``rows`` with the fingerprint of each text, as a signed long, in one more column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([*b.columns, _prints(b.column(b.schema.get_field_index(text_col)))], names=[*b.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())]))


class BKTree:
    """Children keyed by integer Hamming distance to their parent."""

    def __init__(self) -> None:
        self.codes: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, code: int) -> int:
        """Put a code in, unless it is there; returns its node."""
        if not self.codes:
            self.codes.append(code)
            self.children.append({})
            return 0
        at = 0
        while True:
            d = (self.codes[at] ^ code).bit_count()
            if not d:
                return at
            to = self.children[at].get(d)
            if to is None:
                self.children[at][d] = len(self.codes)
                self.codes.append(code)
                self.children.append({})
                return len(self.codes) - 1
            at = to

    def within(self, code: int, radius: int) -> list[int]:
        """Nodes whose codes differ in at most ``radius`` bits."""
        found, open_ = [], [0] if self.codes else []
        while open_:
            at = open_.pop()
            d = (self.codes[at] ^ code).bit_count()
            if d <= radius:
                found.append(at)
            kids = self.children[at]
            open_ += [kids[k] for k in range(max(1, d - radius), d + radius + 1) if k in kids]
        return found


def forest(codes: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join the codes of a shard as all pairs within radius would."""
    tree, root, links = BKTree(), [], []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for code in codes:
        near = tree.within(code, radius)
        at = tree.add(code)
        if at == len(root):
            root.append(at)
        for other in near:
            a, b = find(at), find(other)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((code, tree.codes[other]))
    return links


def _thirds(free: str) -> list[str]:
    """SQL for masks that cut the bits of mask ``free`` into three parts by rank."""
    n = free.bit_count()
    bits = [i for i in range(64) if free >> i & 1]
    cuts = [0, n // 3, 2 * n // 3, n]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _masks() -> tuple[list[int], dict[int, list[int]]]:
    """Masks of the six pairs of blocks, and of every mask the three that extend it."""
    full = (1 << 64) - 1
    blocks = [0xFFFF << 16 * i for i in range(4)]
    first = [blocks[i] | blocks[j] for i in range(4) for j in range(i)]
    longer: dict[int, list[int]] = {}
    level = first
    for _ in range(2):
        for m in level:
            longer[m] = [m | x for x in _thirds(full & ~m)]
        level = [x for m in level for x in longer[m]]
    return first, longer


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sharded(codes: DataFrame, tree_size: int = TREE_SIZE) -> DataFrame:
    """(mask, key, fp): each fingerprint in every shard that needs it; shards of
    one member are left out."""
    first, longer = _masks()
    level, kept = None, []
    masks = {m: longer[m] for m in first}
    for depth in range(3):
        if depth == 0:
            rows = codes.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in first])).alias("mask"))
        else:
            grown = F.create_map(*[x for m, ms in masks.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(y)) for y in ms]))])
            rows = level.select("fp", F.explode(F.element_at(grown, F.col("mask"))).alias("mask"))
            masks = {x: longer.get(x, []) for ms in masks.values() for x in ms}
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = rows.join(sizes, ["mask", "key"])
        if depth == 2:
            kept.append(rows.drop("n"))
        else:
            rows = materialise(rows)
            kept.append(rows.where(F.col("n") <= tree_size).drop("n"))
            level = rows.where(F.col("n") > tree_size).drop("n")
            if level.isEmpty():
                break
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


def links(codes: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that join them just
    as all pairs at most ``radius`` bits apart would."""
    if radius > 2:
        raise ValueError("the shards are made for a radius of at most 2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        codes: list[int] = []
        out: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            a = np.array([x for x, _ in out], np.uint64).view(np.int64)
            b = np.array([y for _, y in out], np.uint64).view(np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).tolist()
            keys = zip(batch.column("mask").to_pylist(), batch.column("key").to_pylist(), strict=True)
            for key, fp in zip(keys, fps, strict=True):
                if key != held:
                    out += forest(codes, radius)
                    held, codes = key, []
                codes.append(fp)
            if out:
                yield flush()
        out += forest(codes, radius)
        if out:
            yield flush()

    placed = sharded(codes, tree_size).repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return placed.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """(id, fingerprint, component_id) for each row of ``docs``."""
    prints = materialise(fingerprints(docs, id_col, text_col))
    classes = materialise(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(classes.select("fp"), radius, tree_size))
    grouped = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    firsts = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(firsts, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: of the rows with its least id that of
    the least fingerprint, and of equal fingerprints the least by content. Rows without
    an id are kept."""
    mark = "_fingerprint"
    rows = docs.where(F.col(f"`{id_col}`").isNotNull())
    found = near_duplicates(rows, id_col, text_col).withColumnRenamed(id_col, "_id")
    firsts = found.groupBy("component_id").agg(F.min(F.struct("_id", "fingerprint")).alias("first")).select("first.*")
    own = [F.col(f"`{c}`") for c in docs.columns]
    asked = rows.join(firsts.select("_id").distinct(), F.col(f"`{id_col}`") == F.col("_id"), "left_semi")
    named = with_fingerprint(asked, text_col, mark).join(firsts, (F.col(f"`{id_col}`") == F.col("_id")) & (F.lpad(F.lower(F.hex(mark)), 16, "0") == F.col("fingerprint")))
    whole = F.struct(*own)
    kept = named.groupBy("_id", "fingerprint").agg(F.min_by(whole, F.to_json(whole)).alias("_row")).select("_row.*")
    return kept.unionByName(docs.where(F.col(f"`{id_col}`").isNull()))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
