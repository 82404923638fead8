"""Best-fit packing (operator 3): a grouping genetic algorithm on islands.

Documents become token sequences; only those longer than ``capacity`` are cut.
Full pieces need no packing. All others go to lots of about ``lot_items`` pieces, and
lots are dealt to tasks. Each lot lives on ``ISLANDS`` islands: on each a small
population of packings evolves, where crossover puts whole well-filled bins of one
parent into the other, drops the bins that then hold a piece twice, lets displaced pieces take the places of smaller
ones where they fill better, and best-fits what is displaced then; mutation empties the worst-filled bins likewise. After some
generations each island's elite migrates to the next one, and so for ``ROUNDS`` rounds,
or until no packing can have fewer bins. Then the pieces of all bins that are not well
filled migrate: they meet in pools over ``pool_lots`` lots and evolve there once more,
which leaves one poor bin for a pool instead of one for a lot. A lot's islands share a
task, since a lot takes less time than its pieces take to travel between tasks.

A lot has a bounded number of pieces, so no task grows with the corpus, and the
random choices depend on the lot alone, so a task that is run again gives the
same bins.

Defined cases: a null or empty text is the one closing id 0; every row is a
document of its own, also where rows or ids repeat or ids are null; an empty table
gives no rows; other columns are ignored; a very long text is cut, none is dropped.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices, table, utf8
from .tokens import WORD_TOKENIZER, tokenizer_path, word_ids

CAPACITY = 2048
LOT_ITEMS = 4096
POOL_LOTS = 16
#: A bin below this share of the capacity is pooled and packed again.
WELL_FILLED = 0.98
POPULATION = 4
#: Bins that a displaced piece is tried in.
TRIED_BINS = 40
#: Generations between migrations, islands, and migrations.
GENERATIONS, ISLANDS, ROUNDS = 3, 2, 4

PIECES = "doc long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, piece, start, length, ids_crc32): the documents' pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = b"\0\0\0\0"
        for b in slices(batches, "text", 4 << 20):
            out: list[tuple] = []
            for doc, text in zip(b.column("id").to_pylist(), utf8(b.column("text")), strict=True):
                ids = word_ids(tokenizer).ids(text) + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc, i, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(columns)],
                names=["doc", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.selectExpr(f"cast(`{id_col}` AS long) AS id", f"`{text_col}` AS text")
    return rows.mapInArrow(run, PIECES)


class Bins:
    """One packing: for every bin its pieces and its room."""

    def __init__(self, lengths: list[int], capacity: int) -> None:
        self.lengths, self.capacity = lengths, capacity
        self.items: list[list[int]] = []
        self.room: list[int] = []

    def copy(self) -> Bins:
        out = Bins(self.lengths, self.capacity)
        out.items, out.room = [list(b) for b in self.items], list(self.room)
        return out

    def best_fit(self, loose: list[int]) -> None:
        """Put pieces, in this order, each where it leaves the least room."""
        by_room: dict[int, list[int]] = {}
        rooms = 0  # bit r is set where a bin with room r is
        for b, r in enumerate(self.room):
            if r:
                by_room.setdefault(r, []).append(b)
                rooms |= 1 << r
        for i in loose:
            n = self.lengths[i]
            fits = rooms >> n
            if fits:
                r = n + (fits & -fits).bit_length() - 1
                held = by_room[r]
                b = held.pop()
                if not held:
                    rooms ^= 1 << r
                self.items[b].append(i)
            else:
                r, b = self.capacity, len(self.items)
                self.items.append([i])
                self.room.append(r)
            r -= n
            self.room[b] = r
            if r:
                by_room.setdefault(r, []).append(b)
                rooms |= 1 << r

    def drop(self, bins: set[int]) -> list[int]:
        """Remove bins; their pieces."""
        loose = [i for b in bins for i in self.items[b]]
        keep = [b for b in range(len(self.items)) if b not in bins]
        self.items, self.room = [self.items[b] for b in keep], [self.room[b] for b in keep]
        return loose

    def score(self) -> tuple[int, float]:
        """Lower is better: bins, then how unevenly they are filled (evenly is worse)."""
        return len(self.items), -sum((self.capacity - r) ** 2 for r in self.room)


def _exchange(bins: Bins, loose: list[int], rng: random.Random) -> list[int]:
    """Put loose pieces in the place of smaller ones where that fills a bin better (some
    bins are tried for each); the pieces that are loose then."""
    open_ = [b for b, r in enumerate(bins.room) if r]
    out = []
    for i in loose:
        n, best = bins.lengths[i], None
        for b in rng.sample(open_, min(TRIED_BINS, len(open_))):
            r = bins.room[b]
            for place, j in enumerate(bins.items[b]):
                gain = n - bins.lengths[j]
                if 0 < gain <= r and (best is None or gain - r > best[0]):
                    best = (gain - r, b, place)
        if best is None:
            out.append(i)
        else:
            _, b, place = best
            out.append(bins.items[b][place])
            bins.room[b] += bins.lengths[bins.items[b][place]] - n
            bins.items[b][place] = i
    return out


def _settle(bins: Bins, loose: list[int], rng: random.Random) -> Bins:
    """Best-fit loose pieces, the longest first; equal lengths in random order."""
    rng.shuffle(loose)
    loose.sort(key=lambda i: -bins.lengths[i])
    bins.best_fit(loose)
    return bins


def crossover(a: Bins, b: Bins, rng: random.Random) -> Bins:
    """Well-filled bins of ``b`` put whole into ``a``; duplicates go, and what they
    displace is best-fitted."""
    order = sorted(range(len(b.items)), key=lambda x: b.room[x])
    well = order[: max(1, len(order) // 2)]
    at = rng.randrange(len(well))
    injected = well[at : at + max(1, len(well) // 6)]
    taken = {i for x in injected for i in b.items[x]}
    child = a.copy()
    hit = {x for x, held in enumerate(child.items) if not taken.isdisjoint(held)}
    loose = [i for i in child.drop(hit) if i not in taken]
    child.items += [list(b.items[x]) for x in injected]
    child.room += [b.room[x] for x in injected]
    return _settle(child, _exchange(child, loose, rng), rng)


def mutate(a: Bins, rng: random.Random) -> Bins:
    """The worst-filled bins and a few others emptied and packed again."""
    child = a.copy()
    if len(child.items) < 2:
        return child
    worst = sorted(range(len(child.items)), key=lambda x: -child.room[x])[: max(2, len(child.items) // 20)]
    others = rng.sample(range(len(child.items)), max(1, len(child.items) // 20))
    return _settle(child, _exchange(child, child.drop({*worst, *others}), rng), rng)


class Island:
    """A population of packings of one lot."""

    def __init__(self, lengths: list[int], capacity: int, rng: random.Random, population: int = POPULATION, known: Sequence[Bins] = ()) -> None:
        self.rng, self.population = rng, population
        self.crowd = list(known)
        while len(self.crowd) < population:
            self.crowd.append(_settle(Bins(lengths, capacity), list(range(len(lengths))), rng))
        self.crowd.sort(key=Bins.score)

    @property
    def elite(self) -> Bins:
        return self.crowd[0]

    def live(self, generations: int, least: int) -> None:
        """Some generations; none further once the packing has ``least`` bins."""
        for _ in range(generations):
            if len(self.elite.items) <= least:
                break
            a, b = self.crowd[0], self.rng.choice(self.crowd[1:])
            self.crowd += [crossover(a, b, self.rng), crossover(b, a, self.rng), mutate(a, self.rng)]
            self.crowd = sorted(self.crowd, key=Bins.score)[: self.population]

    def welcome(self, migrant: Bins) -> None:
        """A packing from elsewhere takes the worst one's place."""
        self.crowd[-1] = migrant.copy()
        self.crowd.sort(key=Bins.score)


def fewest(lengths: list[int], capacity: int) -> int:
    """No packing has fewer bins: by the sum, and by pieces of more than half a bin."""
    return max(-(-sum(lengths) // capacity), sum(2 * n > capacity for n in lengths))


def _bins_of(lengths: list[int], capacity: int, bins: np.ndarray) -> Bins:
    """A packing from each piece's bin."""
    found = Bins(lengths, capacity)
    order = np.argsort(bins, kind="stable")
    cuts = np.flatnonzero(np.diff(bins[order])) + 1
    found.items = [held.tolist() for held in np.split(order, cuts) if len(held)]
    found.room = [capacity - sum(lengths[i] for i in held) for held in found.items]
    return found


def _numbered(best: Bins, n: int) -> np.ndarray:
    """Each piece's bin."""
    bins = np.zeros(n, np.int64)
    for number, held in enumerate(best.items):
        bins[held] = number
    return bins


def settled(capacity: int, generations: int, islands: int, rounds: int):
    """A function that evolves a lot (a frame of uid, length) where its islands are: at
    each round's end the elites go round to the next island. With a column ``bin`` the
    islands begin from that packing."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "uid"], ascending=[False, True], kind="stable").reset_index(drop=True)
        lengths = frame["length"].tolist()
        least = fewest(lengths, capacity)
        known = [_bins_of(lengths, capacity, frame["bin"].to_numpy())] if "bin" in frame.columns else []
        homes = [Island(lengths, capacity, random.Random(f"{i}:{':'.join(map(str, key))}"), known=known) for i in range(islands)]
        for _ in range(rounds):
            if min(len(h.elite.items) for h in homes) <= least:
                break
            for home in homes:
                home.live(generations, least)
            elites = [h.elite for h in homes]
            for home, migrant in zip(homes, [elites[-1], *elites[:-1]], strict=True):
                home.welcome(migrant)
        best = min((h.elite for h in homes), key=Bins.score)
        return frame.assign(bin=_numbered(best, len(frame)))

    return run


def pack(lengths: DataFrame, capacity: int = CAPACITY, lot_items: int = LOT_ITEMS, pool_lots: int = POOL_LOTS) -> DataFrame:
    """(uid, length) -> (uid, sequence_id, offset). ``uid`` names a row and is not
    negative; a length is at least 1 and at most ``capacity``."""
    lots = max(1, -(-lengths.where(F.col("length") < capacity).count() // lot_items))
    small = lengths.where(F.col("length") < capacity).withColumn("lot", F.pmod(F.xxhash64("uid"), F.lit(lots)))
    schema = "uid long, length long, lot long, bin long"
    evolved = settled(capacity, GENERATIONS, ISLANDS, ROUNDS)
    packed = materialise(small.select("uid", "length", "lot").repartition(lots, "lot").groupBy("lot").applyInPandas(evolved, schema))
    # between lots: the pieces of poor bins meet in pools and are packed again
    filled = packed.groupBy("lot", "bin").agg(F.sum("length").alias("filled"))
    poor = filled.where(F.col("filled") < WELL_FILLED * capacity).drop("filled")
    good = packed.join(poor, ["lot", "bin"], "left_anti").select("uid", "length", "lot", "bin")
    pooled = packed.join(poor, ["lot", "bin"], "left_semi").withColumn("lot", -1 - F.floor(F.col("lot") / pool_lots)).select("uid", "length", "lot")
    again = pooled.groupBy("lot").applyInPandas(evolved, schema).select("uid", "length", "lot", "bin")
    placed = good.unionByName(again).withColumn("sequence_id", F.shiftleft(F.col("lot"), 32) + F.col("bin"))

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Running sums of the lengths, from 0 in each sequence; rows come sorted."""
        last, carried = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            seq, n = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("sequence_id", "length"))
            before = np.cumsum(n) - n
            cut = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            at = before - np.repeat(before[cut], np.diff(np.r_[cut, len(seq)]))
            if seq[0] == last:
                at[: cut[1] if len(cut) > 1 else len(at)] += carried
            last, carried = seq[-1], int(at[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("sequence_id"), pa.array(at)], names=["uid", "sequence_id", "offset"])

    ordered = placed.select("uid", "length", "sequence_id").repartition("sequence_id").sortWithinPartitions("sequence_id", "uid")
    whole = lengths.where(F.col("length") == capacity).select("uid", F.shiftleft(F.lit(1).cast("long"), 62).alias("high"))
    full = whole.select("uid", (F.col("high") + F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ordered.mapInArrow(offsets, "uid long, sequence_id long, offset long").unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its place: id, piece, start, length,
    ids_crc32, sequence_id, offset."""
    path = tokenizer or tokenizer_path(WORD_TOKENIZER)
    cut = materialise(pieces(docs, path, capacity, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()))
    placed = pack(cut.select("uid", "length"), capacity)
    return cut.join(placed, "uid").select(F.col("doc").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
