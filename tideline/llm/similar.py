"""Near-duplicates by word shingles, as a stage of a pipeline takes them: five words,
Jaccard similarity of 0.8 or more, checked exactly.

1. Sets. Texts are lower-cased (A-Z) and cut at ASCII white space; a text's set is that
   of its 5-word shingles (a shorter text is one shingle). Equal sets are one class
   from here on, so thousands of copies are one node.
2. Candidates by SimHash. Each set has a 64-bit fingerprint, and operator 4's BK-trees
   link those at most 2 bits apart. At similarity 0.8 fingerprints differ in some ten
   bits, so this meets copies with few changes only.
3. Candidates by minima, for all the others. Of each set 160 minima under different
   permutations are taken, and every 5 of them name one of 32 buckets. Sets of
   similarity s share a bucket with probability 1 - (1 - s^5)^32, which is 0.999997 at
   0.8.
4. Stars. The head of a bucket is the member that meets most others in all its buckets,
   so the copies of one text, which are often nearer to it than to each other, have
   one head. Each class is compared with the head that it shares most buckets with, and
   then with its other heads if these did not fall together with it.
5. Rest. Of the classes in buckets that the stars did not join, all pairs that can be
   similar are found by prefixes (see :func:`prefix_pairs`), so every similar pair that
   shares a bucket is compared or already joined, and no bucket is expanded into pairs.
6. Comparison is exact, on whole sets of 64-bit shingle hashes; sets are sent only for
   classes that stand in some pair. Components are found by star contraction.

Defined cases: null and empty texts are one class; rows without an id are kept; of a
component the class with the least id stays (the least of these, if rows repeat this id),
and of its rows with that id one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import bitmap_of, free_names, in_bitmap, materialise, sieved, slices, utf8
from .components import components
from .substrings import _groups, _mix, word_hashes

SHINGLE = 5
#: Least similarity, as a fraction of integers.
LEAST = (4, 5)
BANDS, ROWS = 32, 5
SEED = 8
SLICE_BYTES = 1 << 20

_SALT, _ODD = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_ODD |= np.uint64(1)


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """The set of each text: sorted distinct hashes, none for a text without words."""
    h, text = word_hashes([t.lower() for t in texts])
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    groups = _groups(h, SHINGLE) if len(h) >= SHINGLE else h[:0]
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(groups[a : b - SHINGLE + 1]))
        else:
            out.append(_mix(_groups(h[a:b], b - a) + np.uint64(b - a)) if b > a else h[:0])
    return out


def buckets(sets: list[np.ndarray]) -> np.ndarray:
    """(set, band): the buckets of each set that is not empty, as signed longs."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    x = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    for band in range(BANDS):
        key = np.full(len(sets), band, np.uint64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            key = _mix(key * _ODD[0] + np.minimum.reduceat((x ^ _SALT[i]) * _ODD[i], starts))
        out[:, band] = key
    return out.view(np.int64)


def digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set of hashes, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(found), 65536):
        ones += np.unpackbits(found[lo : lo + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])


def classes_of(rows: DataFrame) -> DataFrame:
    """(id, cls, size, fp, buckets) for each row (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            sets = shingles(utf8(b.column("text")))
            full = np.array([len(s) > 0 for s in sets])
            ends = np.cumsum(np.r_[0, full * BANDS]).astype(np.int32)
            keys = buckets([s for s in sets if len(s)]).ravel() if full.any() else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(map(digest, sets), pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array(map(fingerprint, sets), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))],
                names=["id", "cls", "size", "fp", "buckets"],
            )

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, cls binary, size long, fp long, buckets array<long>")


def sets_of(rows: DataFrame, wanted) -> DataFrame:
    """(cls, items) of the rows (id, text) whose ids a bitmap marks: the set, sorted."""
    near = rows.select(F.xxhash64("id").alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            hashes = b.column("h").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            b = b.filter(pa.array(in_bitmap(wanted.value, hashes)))
            sets = shingles(utf8(b.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(map(digest, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["cls", "items"])

    return near.mapInArrow(run, "cls binary, items array<long>")


#: SQL: a class's first 8 bytes as a signed long, as :func:`with_class` reads them.
CLASS_HASH = "cast(conv(hex(substring(cls, 1, 8)), 16, -10) AS long)"


def with_class(rows: DataFrame, text_col: str, name: str, bitmap, wanted: bool) -> DataFrame:
    """``rows`` with the class of each text in one more column, those whose class a
    bitmap marks, or those whose it doesn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, SLICE_BYTES):
            found = list(map(digest, shingles(utf8(b.column(b.schema.get_field_index(text_col))))))
            hashes = np.frombuffer(b"".join(d[:8] for d in found), ">u8").astype(np.uint64)
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], names=[*b.schema.names, name])
            yield out.filter(pa.array(in_bitmap(bitmap.value, hashes) == wanted))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.BinaryType())]))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of classes that are similar."""
    # merged at every size, so that what a small table shows holds for a large one
    x, y = sets.withColumnsRenamed({"cls": "a", "items": "x"}), sets.withColumnsRenamed({"cls": "b", "items": "y"})
    beside = pairs.hint("merge").join(x.hint("merge"), "a").join(y.hint("merge"), "b")
    shared = beside.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("both"))
    return materialise(shared.where(f"{LEAST[1]} * n >= {LEAST[0]} * (both - n)").select("a", "b"))


def alike(x: str, y: str) -> str:
    """SQL: sets of these sizes can be similar."""
    return f"{LEAST[1]} * least({x}, {y}) >= {LEAST[0]} * greatest({x}, {y})"


def near_fingerprints(one: DataFrame) -> DataFrame:
    """(a, b): classes with equal fingerprints beside the least of these, and the least
    ones of fingerprints that operator 4 links."""
    firsts = one.where("size > 0").groupBy("fp").agg(F.min(F.struct("cls", "size")).alias("first"))
    same = one.where("size > 0").join(firsts, "fp").select("cls", "size", F.col("first.cls").alias("head"), F.col("first.size").alias("head_size"))
    linked = simhash.links(firsts.select("fp"))
    a, b = (firsts.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first")) for c in "ab")
    near = linked.join(a, "a").join(b, "b").select(F.col("a_first.cls").alias("cls"), F.col("a_first.size").alias("size"), F.col("b_first.cls").alias("head"), F.col("b_first.size").alias("head_size"))
    return same.where("cls <> head").unionByName(near).where(alike("size", "head_size")).select(F.greatest("cls", "head").alias("a"), F.least("cls", "head").alias("b")).distinct()


def bucket_members(one: DataFrame) -> DataFrame:
    """(bucket, cls, size, head, head_size) for buckets of more than one class."""
    placed = one.select("cls", "size", F.explode("buckets").alias("bucket"))
    sizes = materialise(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    # most buckets have one class: these rows are not shuffled
    shared = one.sparkSession.sparkContext.broadcast(bitmap_of(sizes, "bucket"))
    met = materialise(sieved(placed, "bucket", shared).join(sizes, "bucket"))
    degrees = met.groupBy("cls").agg(F.sum(F.col("n") - 1).alias("degree"))
    ranked = met.drop("n").join(degrees, "cls")
    heads = ranked.groupBy("bucket").agg(F.max(F.struct("degree", "cls", "size")).alias("head")).select("bucket", F.col("head.cls").alias("head"), F.col("head.size").alias("head_size"))
    return materialise(met.drop("n").join(heads, "bucket"))


def links(rows: DataFrame, found: DataFrame, least: DataFrame) -> DataFrame:
    """(a, b): links between classes that join them as all similar pairs that share a
    bucket would. ``found`` is what :func:`classes_of` gives, ``least`` the least id of
    each class."""
    one = materialise(found.groupBy("cls").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("buckets").alias("buckets")))
    met = bucket_members(one)
    stars = materialise(met.where("cls <> head").where(alike("size", "head_size")).groupBy("cls", "head").agg(F.count(F.lit(1)).alias("shared")))
    nearest = stars.groupBy("cls").agg(F.max_by("head", F.struct("shared", "head")).alias("head"))
    pairs = materialise(nearest.select(F.greatest("cls", "head").alias("a"), F.least("cls", "head").alias("b")).unionByName(near_fingerprints(one)).distinct())
    asked = pairs.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(met.select("cls")).distinct()
    ids = least.join(asked, "cls", "left_semi").select(F.xxhash64("least").alias("h"))
    wanted = rows.sparkSession.sparkContext.broadcast(bitmap_of(ids, "h"))
    sets = materialise(sets_of(rows, wanted).join(asked.hint("merge"), "cls", "left_semi").dropDuplicates(["cls"]))
    known = confirmed(pairs, sets)
    # other heads, of classes that are still apart from them
    apart = rooted(stars, components(known), "cls", "head").select(F.greatest("cls", "head").alias("a"), F.least("cls", "head").alias("b"))
    more = materialise(apart.distinct().join(pairs, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        known = known.unionByName(confirmed(more, sets))
    # classes of a bucket that are still apart: the stars have compared all with the head
    roots = components(known)
    named = met.join(roots, met.cls == roots.node, "left").select("bucket", "cls", "size", F.coalesce("root", "cls").alias("root"))
    mixed = named.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
    left = materialise(named.join(mixed, "bucket").select("cls", "size", "root").distinct())
    rest = materialise(prefix_pairs(left, sets).join(pairs.unionByName(more), ["a", "b"], "left_anti"))
    return known if rest.isEmpty() else known.unionByName(confirmed(rest, sets))


def prefix_pairs(left: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): all pairs of classes (cls, size, root) of different roots that can be
    similar, by prefixes: with a set's shingles in order of how few of these classes have
    them, similar sets x and y share one that stands so far ahead in both that enough can
    follow. A set with many shingles of its own has none but those there, and meets
    nobody. Sizes go by bands, so that a place in the order meets no sizes that are out of
    its reach; of the classes at one shingle those of the most frequent root are not
    compared with each other."""
    upper = lambda n: f"cast(floor(ln({n}) / ln(1.05)) AS int)"
    rows = left.where("size > 0").join(sets, "cls").select("cls", "size", "root", F.explode("items").alias("t"))
    counts = rows.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("cls").orderBy("n", "t")
    ahead = rows.join(counts, "t").withColumn("pos", F.row_number().over(w)).where("pos <= size - ceil(4 * size / 5) + 1 AND n > 1")
    ahead = materialise(ahead.select("cls", "size", "root", "t", "pos"))
    small = ahead.where("pos <= size - ceil(8 * size / 9) + 1").withColumn("band", F.expr(upper("size")))
    reach = ahead.withColumn("most", F.expr("least(size, cast(floor(9 * (size - pos + 1) / 4) AS long) - size)")).where("most >= ceil(4 * size / 5)")
    large = reach.withColumn("band", F.explode(F.expr(f"sequence({upper('ceil(4 * size / 5)')}, {upper('most')})"))).drop("most")
    tops = small.groupBy("t", "band", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("t", "band").agg(F.max_by("root", F.struct("k", "root")).alias("top"))
    x = small.join(tops, ["t", "band"]).withColumn("main", F.expr("root = top")).drop("top")
    y = large.join(tops, ["t", "band"]).withColumn("main", F.expr("root = top")).drop("top")
    enough = "ceil(4 * (x.size + y.size) / 9)"
    fits = f"(x.size < y.size OR (x.size = y.size AND x.cls < y.cls)) AND x.root <> y.root AND x.pos <= x.size - {enough} + 1 AND y.pos <= y.size - {enough} + 1"
    met = None
    for one, other in ((x.where("NOT main"), y), (x.where("main"), y.where("NOT main"))):
        part = one.alias("x").join(other.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.band") == F.col("y.band")) & F.expr(fits))
        part = part.select(F.greatest("x.cls", "y.cls").alias("a"), F.least("x.cls", "y.cls").alias("b"))
        met = part if met is None else met.unionByName(part)
    return met.distinct()


def rooted(pairs: DataFrame, roots: DataFrame, x: str, y: str) -> DataFrame:
    """Those of the pairs whose two classes have different roots."""
    for side in (x, y):
        pairs = pairs.join(roots.withColumnsRenamed({"node": side, "root": f"{side}_root"}), side, "left").withColumn(f"{side}_root", F.coalesce(f"{side}_root", side))
    return pairs.where(F.col(f"{x}_root") != F.col(f"{y}_root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component of similar ones, that with the
    least id."""
    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").where("id IS NOT NULL")
    found = materialise(classes_of(rows))
    least = materialise(found.groupBy("cls").agg(F.min("id").alias("least")))
    roots = components(links(rows, found, least))
    joined = least.join(roots, least.cls == roots.node, "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    firsts = joined.groupBy("root").agg(F.min(F.struct("least", "cls")).alias("first")).select(F.col("first.least").alias("id"), F.col("first.cls").alias("cls"))
    rows_of = found.groupBy("id", "cls").agg(F.count(F.lit(1)).alias("rows"))
    kept = materialise(rows_of.join(firsts.withColumn("stays", F.lit(True)), ["id", "cls"], "left").withColumn("stays", F.coalesce("stays", F.lit(False))))
    return one_row_each(docs, kept, id_col, text_col)


def one_row_each(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of ``docs`` one row for each (id, cls) of ``kept`` (id, cls, rows, stays) that
    stays, and the rows without an id. Where more rows have this id and class, the least
    by content stays. A bitmap tells rows of which some go from the others, which are not
    shuffled."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    class_, id_, cls, rows, row = free_names(docs.columns, "_class", "_id", "_cls", "_rows", "_row")
    doubtful = kept.where("NOT stays OR rows > 1")
    marked = docs.sparkSession.sparkContext.broadcast(bitmap_of(doubtful.select(F.expr(CLASS_HASH).alias("h")), "h"))
    named = docs.where(F.col(f"`{id_col}`").isNotNull())
    sure = with_class(named, text_col, class_, marked, wanted=False).select(*own)
    of = kept.where("stays").select(F.col("id").alias(id_), F.col("cls").alias(cls), F.col("rows").alias(rows))
    asked = with_class(named, text_col, class_, marked, wanted=True).join(of.hint("merge"), (F.col(f"`{id_col}`") == F.col(id_)) & (F.col(class_) == F.col(cls)))
    whole = F.struct(*own)
    several = asked.groupBy(id_, cls).agg(F.min_by(whole, F.to_json(whole)).alias(row)).select(f"{row}.*")
    return sure.unionByName(several).unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
