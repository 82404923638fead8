"""Approximate nearest neighbours (operator 2): cross-polytope hashing.

Nearness is the largest inner product. A hash applies three rounds of random signs and
a fast Hadamard transform (a pseudo-rotation) to a vector's direction and takes the
nearest signed axis; each of ``tables`` tables has its own signs. A table of n vectors
takes so many hashes together (``depth``) that a bucket holds some hundred vectors
whatever n is. Vectors of unequal length stand in bands of norms (each a factor of
2^(1/3) wide, the last open below), so inside a band the nearest direction is nearly
the largest product; a query asks all bands.

Every vector stands in one bucket of each table. A query probes, in each table, the
``probes`` buckets whose signed axes are nearest to it (multiprobe). How many is
measured: for a bounded sample of queries (``SAMPLE``) the true neighbours are found by
one pass over all vectors, and the least number of probes is taken that meets
``TARGET`` of them. A query that meets fewer than ``k`` others is then asked again of
every bucket, so its list is whole.

Buckets travel, not pairs: a bucket's vectors are cut into lots of bounded size,
queries go to every lot of a bucket that they probe, and in a lot one matrix product
gives each query its best ``k`` candidates. A task joins what its lots say of a query
before anything leaves it. Scores are taken exactly, in double precision, on the
original vectors. No bucket is capped: a large one has more lots.

Recall against brute force is measured by the tests (at least 0.9).

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows with a null id; vectors of different length
never meet; a query's own rows are those with its id; if an id repeats, its best
row counts; a query with fewer than ``k`` others gets all of them; ties go to the
smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, table

K = 20
TABLES = 3
#: Queries by which the number of probes is measured, and the recall asked for there.
SAMPLE, TARGET = 128, 0.93
#: Least vectors of a bucket on average before buckets are made finer.
BUCKET_VECTORS = 256
#: Vectors of a lot, at most about twice this.
LOT_VECTORS = 2048
#: Queries that one lot takes at a time.
LOT_QUERIES = 4096
#: Signed axes of a hash from which probes are combined, where several hashes are.
NEAR_AXES = 32
BANDS = 24
#: Found neighbours that a task holds before it lets them go.
HELD = 1 << 20
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def signs(hashes: int, width: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, width]).choice([-1.0, 1.0], (hashes, 3, width))


def rotated(x: np.ndarray, flips: np.ndarray) -> np.ndarray:
    for f in flips:
        x = hadamard(x * f)
    return x


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors padded to a power of two, and the norms."""
    n, d = x.shape
    most = np.abs(x).max(1, keepdims=True)
    out = np.zeros((n, 1 << int(np.ceil(np.log2(d))) if d > 1 else 2))
    out[:, :d] = x / most
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return out / size, (size * most)[:, 0]


def bands(norms: np.ndarray, greatest: float) -> np.ndarray:
    """Band of each norm: 0 for the greatest, the last for all that is far below."""
    with np.errstate(all="ignore"):
        return np.nan_to_num(np.clip(np.floor(3 * np.log2(greatest / norms)), 0, BANDS)).astype(np.int32)


def depth_of(n: int, width: int) -> int:
    """How many hashes a bucket's name joins."""
    depth = 1
    while (2 * width) ** (depth + 1) * BUCKET_VECTORS <= n:
        depth += 1
    return depth


class Hashes:
    """The hashes of one length of vectors."""

    def __init__(self, width: int, tables: int, depth: int, seed: int) -> None:
        self.width, self.tables, self.depth = width, tables, depth
        self.flips = signs(tables * depth, width, seed).reshape(tables, depth, 3, width)

    def _scores(self, unit: np.ndarray, t: int) -> list[np.ndarray]:
        """Of each hash the scores of the signed axes: the coordinates, then their
        negatives."""
        turned = [rotated(unit, f) for f in self.flips[t]]
        return [np.concatenate([r, -r], axis=1) for r in turned]

    def codes(self, unit: np.ndarray, t: int) -> np.ndarray:
        """Bucket of each vector in table t."""
        return reduce(lambda code, s: code * (2 * self.width) + s.argmax(1), self._scores(unit, t), np.zeros(len(unit), np.int64))

    def near(self, unit: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets that may be probed, and how near each is: (query, bucket) twice."""
        codes, nearness = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
        for s in self._scores(unit, t):
            if self.depth == 1:
                axis = np.broadcast_to(np.arange(s.shape[1]), s.shape)
            else:
                axis = np.argpartition(-s, min(NEAR_AXES, s.shape[1]) - 1, axis=1)[:, :NEAR_AXES]
            value = np.take_along_axis(s, axis, 1)
            codes = (codes[:, :, None] * (2 * self.width) + axis[:, None, :]).reshape(len(unit), -1)
            nearness = (nearness[:, :, None] + value[:, None, :]).reshape(len(unit), -1)
        return codes, nearness

    def probed(self, unit: np.ndarray, t: int, probes: int) -> np.ndarray:
        codes, nearness = self.near(unit, t)
        if probes >= codes.shape[1]:
            return codes
        return np.take_along_axis(codes, np.argpartition(-nearness, probes - 1, axis=1)[:, :probes], 1)


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vectors in a column."""
    ends = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, values[ends[rows][:, None] + np.arange(d)]


def best_of(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k nearest; scores are summed row by row, so
    equal vectors score alike wherever they stand. Of an id's rows the best counts."""
    alone = len(np.unique(ids)) == len(ids)
    out = []
    for lo in range(0, len(query_ids), 256):
        q, own = queries[lo : lo + 256], query_ids[lo : lo + 256]
        rough = q @ vectors.T
        slack = 1e-9 * np.maximum(1.0, np.abs(rough).max(1))
        rough[own[:, None] == ids] = -np.inf
        n = min(k, rough.shape[1])
        if alone:
            floor = np.partition(rough, rough.shape[1] - n, axis=1)[:, -n] - slack
        else:
            floor = np.full(len(own), -np.inf)
        row, col = np.nonzero((rough >= floor[:, None]) & (rough > -np.inf))
        if len(row):
            out.append(top(own[row], ids[col], (vectors[col] * q[row]).sum(1), k))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def top(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best different ids of each query, ties to smaller ids."""
    order = np.lexsort((-scores, ids, query))
    q, i = query[order], ids[order]
    order = order[np.r_[True, (q[1:] != q[:-1]) | (i[1:] != i[:-1])]] if len(q) else order
    order = order[np.lexsort((ids[order], -scores[order], query[order]))]
    q = query[order]
    cut = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(cut, np.diff(np.r_[cut, len(q)]))
    order = order[rank < k]
    return query[order], ids[order], scores[order]


LISTS = "query_id long, ids array<long>, scores array<double>"
FOUND = "query_id long, rank int, vec_id long, score double"

Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def _lists_of(found: list[Found], k: int) -> pa.RecordBatch:
    """One row for each query: its best so far."""
    query, ids, scores = top(*(np.concatenate(c) for c in zip(*found, strict=True)), k)
    cut = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
    ends = pa.array(np.r_[cut, len(query)].astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(query[cut].astype(np.int64)), pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int64))), pa.ListArray.from_arrays(ends, pa.array(scores))], names=["query_id", "ids", "scores"])


def merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of all lists of each query; rows come sorted by query."""
    held: list[Found] = []

    def ranked(found: list[Found]) -> pa.RecordBatch:
        query, ids, scores = top(*(np.concatenate(c) for c in zip(*found, strict=True)), k)
        cut = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        rank = np.arange(1, len(query) + 1) - np.repeat(cut, np.diff(np.r_[cut, len(query)]))
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(rank.astype(np.int32)), pa.array(ids), pa.array(scores)], names=["query_id", "rank", "vec_id", "score"])

    for b in batches:
        if not b.num_rows:
            continue
        own = b.column("query_id").to_numpy(zero_copy_only=False)
        query = np.repeat(own, np.diff(b.column("ids").offsets.to_numpy()))
        ids, scores = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "scores"))
        last = query == own[-1]  # this query may go on in the next batch
        if held and held[0][0][0] != own[-1] or not last.all():
            yield ranked([*held, (query[~last], ids[~last], scores[~last])])
            held = []
        held.append((query[last], ids[last], scores[last]))
        if len(held) > 64:
            held = [top(*(np.concatenate(c) for c in zip(*held, strict=True)), k)]
    if held:
        yield ranked(held)


def answers(batches: Iterator[pa.RecordBatch], kind: str, k: int) -> Iterator[pa.RecordBatch]:
    """Each lot's best for its queries, joined over the lots of a task. Rows come
    sorted by lot, and in a lot the vectors before the queries."""
    held: tuple | None = None
    ids: list[np.ndarray] = []
    vectors: list[np.ndarray] = []
    found: list[Found] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "band", "tab", "code", "lot", "asked")], axis=1)
        own = b.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
        raw = b.column("vec")
        ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + b.num_rows + 1]
        data = raw.buffers()[2]
        cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, b.num_rows]
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            lot = tuple(keys[a, :5].tolist())
            x = np.frombuffer(data[ends[a] : ends[z]], kind).reshape(z - a, -1).astype(np.float64)
            if lot != held:
                held, ids, vectors = lot, [], []
            if not keys[a, 5]:
                ids.append(own[a:z]), vectors.append(x)
            elif ids:
                if len(ids) > 1:
                    ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                for lo in range(0, z - a, LOT_QUERIES):
                    found.append(best_of(own[a + lo : min(z, a + lo + LOT_QUERIES)], x[lo : lo + LOT_QUERIES], ids[0], vectors[0], k))
                    size += len(found[-1][0])
                    if size >= HELD:
                        yield _lists_of(found, k)
                        found, size = [], 0
    if found:
        yield _lists_of(found, k)


@dataclass(frozen=True)
class Plan:
    """What tasks need to know: of each length of vectors their number and greatest
    norm, and the hashes that follow from it."""

    figures: dict[int, tuple[int, float]]
    tables: int
    seed: int

    def hashes(self, dim: int) -> Hashes:
        width = 1 << int(np.ceil(np.log2(dim))) if dim > 1 else 2
        return Hashes(width, self.tables, depth_of(self.figures[dim][0], width), self.seed)

    def probes_of(self, dim: int, share: float) -> int:
        hashes = self.hashes(dim)
        return max(1, int(np.ceil(share * (2 * hashes.width if hashes.depth == 1 else min(NEAR_AXES, 2 * hashes.width) ** hashes.depth))))


class Search:
    """One table of vectors, made ready for search."""

    def __init__(self, vectors: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int, tables: int, lot: int, seed: int) -> None:
        self.k, self.lot = k, lot
        narrow = isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType)
        self.kind = "<f4" if narrow else "<f8"
        rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>" if narrow else "array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asked"))
        rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec")))
        self.rows = rows.groupBy("id", "vec").agg(F.max("asked").alias("asked"))  # equal rows say nothing new
        square = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
        # one row for each length of vector
        self.plan = Plan({r.dim: (r.n, r.norm) for r in rows.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(square)).alias("norm")).collect()}, tables, seed)

    def index(self) -> DataFrame:
        """(dim, band, tab, code, id, vec): the bucket of each vector in every table."""
        plan = self.plan

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for rows, x in by_length(b.column("vec")):
                    d = x.shape[1]
                    unit, norms = directions(x.astype(np.float64))
                    hashes = plan.hashes(d)
                    codes = np.stack([hashes.codes(unit, t) for t in range(plan.tables)], axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), d, np.int32)), pa.array(bands(norms, plan.figures[d][1])), pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, plan.tables, dtype=np.int32)), pa.array(codes.ravel())), b.column("id").take(pa.array(rows)), pa.array([v.tobytes() for v in x], pa.binary())],
                        names=["dim", "band", "codes", "id", "vec"],
                    )

        placed = self.rows.select("id", "vec").mapInArrow(run, "dim int, band int, codes array<long>, id long, vec binary")
        return placed.select("dim", "band", F.posexplode("codes").alias("tab", "code"), "id", "vec")

    def probes(self, queries: DataFrame, shares: float) -> DataFrame:
        """(dim, tab, code, id, vec): the buckets that each query probes."""
        plan = self.plan

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for rows, x in by_length(b.column("vec")):
                    unit, _ = directions(x.astype(np.float64))
                    hashes = plan.hashes(x.shape[1])
                    for lo in range(0, len(rows), 256):  # nearness is held for these at a time
                        some = unit[lo : lo + 256]
                        for t in range(plan.tables):
                            codes = hashes.probed(some, t, plan.probes_of(x.shape[1], shares))
                            n, per = codes.shape
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(n, x.shape[1], np.int32)), pa.array(np.full(n, t, np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(0, n * per + 1, per, dtype=np.int32)), pa.array(codes.ravel())), b.column("id").take(pa.array(rows[lo : lo + 256])), pa.array([v.tobytes() for v in x[lo : lo + 256]], pa.binary())],
                                names=["dim", "tab", "codes", "id", "vec"],
                            )

        return queries.select("id", "vec").mapInArrow(run, "dim int, tab int, codes array<long>, id long, vec binary").select("dim", "tab", F.explode("codes").alias("code"), "id", "vec")

    def measured(self, sample: int, target: float) -> float:
        """Share of the buckets to probe in each table so that ``target`` of the true
        neighbours of ``sample`` queries are met."""
        asked = self.rows.where("asked").select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
        if not asked:
            return 1.0
        shared = self.rows.sparkSession.sparkContext.broadcast([(r.id, np.array(r.vec, np.float64)) for r in asked])
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple] = {}
            for b in batches:
                own = b.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
                for rows, x in by_length(b.column("vec")):
                    x = x.astype(np.float64)
                    for n, (i, q) in enumerate(shared.value):
                        if len(q) == x.shape[1]:
                            score = np.where(own[rows] == i, -np.inf, x @ q)
                            near = np.argpartition(-score, min(k, len(score)) - 1)[:k]
                            near = near[score[near] > -np.inf]
                            old = best.get(n, (np.zeros(0), np.zeros((0, len(q)))))
                            value, vecs = np.r_[old[0], score[near]], np.concatenate([old[1], x[near]])
                            keep = np.argsort(-value, kind="stable")[:k]
                            best[n] = (value[keep], vecs[keep])
            for n, (value, vecs) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), n)), pa.array(value), pa.array([v.tobytes() for v in vecs], pa.binary())], names=["n", "score", "vec"])

        w = Window.partitionBy("n").orderBy(F.desc("score"), "vec")
        true = self.rows.select("id", "vec").mapInArrow(run, "n long, score double, vec binary").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).collect()
        share = []
        for n, (_, q) in enumerate(shared.value):
            near = [np.frombuffer(r.vec) for r in true if r.n == n]
            if near:
                hashes, ranks = self.plan.hashes(len(q)), []
                unit, theirs = directions(q[None])[0], directions(np.stack(near))[0]
                for t in range(self.plan.tables):
                    codes, nearness = hashes.near(unit, t)
                    place = {c: p for p, c in enumerate(codes[0][np.argsort(-nearness[0])].tolist())}
                    ranks.append([place.get(c, codes.shape[1]) + 1 for c in hashes.codes(theirs, t).tolist()])
                share += (np.min(ranks, axis=0) / codes.shape[1]).tolist()
        return float(np.sort(share)[int(np.ceil(target * len(share))) - 1]) if share else 1.0

    def met(self, index: DataFrame, lots: DataFrame, asked: DataFrame) -> DataFrame:
        """(query_id, vec_id, score): the best of what ``asked`` (with lots) meets."""
        bucket = ["dim", "band", "tab", "code"]
        stored = index.join(lots, bucket).select(*bucket, F.pmod(F.xxhash64("id", "vec"), F.col("lots")).cast("int").alias("lot"), F.lit(0).alias("asked"), "id", "vec")
        sent = asked.select(*bucket, F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.lit(1).alias("asked"), "id", "vec")
        where, kind, k = [*bucket, "lot"], self.kind, self.k
        rows = stored.unionByName(sent).repartition(*where).sortWithinPartitions(*where, "asked")
        lists = rows.mapInArrow(lambda batches: answers(batches, kind, k), LISTS)
        return lists.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(lambda batches: merged(batches, k), FOUND)


def search(vectors: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int = K, tables: int = TABLES, lot: int = LOT_VECTORS, seed: int = SEED, sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query row its k nearest found."""
    s = Search(vectors, id_col, vec_col, is_query, k, tables, lot, seed)
    index = s.index()
    queries = s.rows.where("asked")
    lots = index.groupBy("dim", "band", "tab", "code").agg(F.count(F.lit(1)).alias("n")).select("dim", "band", "tab", "code", F.ceil(F.col("n") / lot).cast("int").alias("lots"))
    lots = materialise(lots)
    first = materialise(s.met(index, lots, s.probes(queries, s.measured(sample, target)).join(lots, ["dim", "tab", "code"])))
    whole = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short = queries.join(whole, queries.id == whole.query_id, "left_anti")
    if short.isEmpty():
        return first
    # the exact way for the rest: all buckets of one table hold every vector once
    again = short.mapInArrow(_as_bytes, "dim int, id long, vec binary").join(lots.where("tab = 0"), "dim")
    rest = s.met(index.where("tab = 0"), lots.where("tab = 0"), again)
    return first.join(whole, "query_id", "left_semi").select(rest.columns).unionByName(rest)


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for rows, x in by_length(b.column("vec")):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), x.shape[1], np.int32)), b.column("id").take(pa.array(rows)), pa.array([v.tobytes() for v in x], pa.binary())], names=["dim", "id", "vec"])


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0)
