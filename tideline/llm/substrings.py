"""Substring dedup (operator 9): repeated-phrase automata.

A window is ``window`` (13) consecutive words of a document. Words covered by a
window that also starts in a document with a smaller id are removed.

1. Seeds. Every window names one of its 5-word groups, the one of least hash, so
   equal windows name the same seed, and one seed stands for several windows in a
   row. Least and greatest document and the number of places of each seed are taken
   per slice of text before the shuffle, then grouped; seeds of one document only are
   done.
2. A bitmap of fixed size (2^``bitmap_bits`` bits, whatever the corpus) marks the
   recurring seeds. It only spares shuffling: a false hit costs a row, and were
   it full the result would be the same.
3. Segments. The windows in a row under one recurring seed make a segment, which is
   sent, words and all, to the shard of its seed. Where a slice of text holds the same
   segment in a smaller document, that settles it there, so a passage that a third of
   all documents share sends one row for each slice. Seeds that stand in many places
   (``HOT_PLACES``; a second bitmap marks them all) do not hold their windows together:
   each of these windows is a segment of its own, under its own hash, so a frequent phrase
   in differing surroundings is spread. A false hit spreads windows that needn't be.
4. Confirmed passages. In a shard the windows of the segments of a seed are compared
   word for word; windows in a row that recur together make one passage, which carries
   the least document that holds it.
5. Automata. The passages of a shard (at most about ``SHARD_BYTES`` of segments at a
   time) are compiled into one Aho-Corasick automaton over words, and the segments of
   all documents are streamed through it. Each hit in a document behind the passage's
   least one is a span to remove; spans come from nowhere else but from step 3's equal
   segments in one slice. Hashes only choose shards: where two different seeds or
   windows share one, their segments meet and differ.
6. Spans go back to their rows by id and the hash of the whole text.

Defined cases: null text: no words; a null id: nothing is removed from the row
and it is no source for others; repeated rows have one id, so they do not remove
from each other; empty table: no rows; texts are judged whole, whatever length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_of, in_bitmap, materialise, slices, table, utf8

WINDOW = 13
SEED_WORDS = 5
BITMAP_BITS = 26
SLICE_BYTES = 4 << 20
#: Places of a seed beyond which its windows are spread.
HOT_PLACES = 20_000
#: Segments that one automaton is made from.
SHARD_BYTES = 2 << 20

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(29))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """All words of the texts: where each begins and ends in the joined line, and the
    number of its text; and that line, with 8 bytes to spare."""
    line = b"\n".join([*texts, b"", b"\0" * 8])
    raw = np.frombuffer(line, np.uint8)[:-8]
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = ends[-len(starts) :] if len(starts) else ends[:0]
    first = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    return starts, ends, np.searchsorted(first, starts, "right") - 1, line


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and for every word the number of its text."""
    starts, ends, text_of, line = words_of(texts)
    lengths = ends - starts
    lanes = np.ndarray((len(line) - 8,), "<u8", line, strides=(1,))
    h = lengths.astype(np.uint64) * _A
    on, at, left = np.arange(len(starts)), starts, lengths
    while len(on):
        cut = np.clip(8 - left, 0, 8).astype(np.uint64) * np.uint64(8)
        lane = (lanes[at] << cut) >> cut
        h[on] = _mix((h[on] ^ lane) * _A)
        more = left > 8
        on, at, left = on[more], at[more] + 8, left[more] - 8
    return h, text_of


def spaced(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """All words of the texts joined by one space, and where each begins (and where one
    more would)."""
    starts, ends, _, line = words_of(texts)
    raw = np.frombuffer(line, np.uint8)
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts] += 1
    inside[ends + 1] -= 1  # a word and the sign after it
    kept = np.cumsum(inside[:-1]).astype(bool)
    out = raw[kept].copy()
    begins = np.cumsum(np.r_[0, ends - starts + 1])
    out[begins[1:] - 1] = 32
    return out.tobytes(), begins


def _groups(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k hashes in a row."""
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _A + h[j : j + n]
    return _mix(out)


def _least(h: np.ndarray, k: int) -> np.ndarray:
    """Least of every k values in a row."""
    width = 1
    while 2 * width <= k:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return h if width == k else np.minimum(h[: len(h) - (k - width)], h[k - width :])


class Windows:
    """All windows of the texts of one slice."""

    def __init__(self, texts: list[bytes], window: int = WINDOW) -> None:
        self.h, self.text_of = word_hashes(texts)
        n = max(0, len(self.h) - window + 1)
        self.window, self.at = window, np.zeros(0, np.int64)
        if n:
            self.at = np.flatnonzero(self.text_of[:n] == self.text_of[window - 1 :])  # word at which each begins
            self.seed = _least(_groups(self.h, SEED_WORDS), window - SEED_WORDS + 1)[self.at]
            self.doc = self.text_of[self.at]
            self.first_word = np.searchsorted(self.text_of, np.arange(len(texts)))

    def __len__(self) -> int:
        return len(self.at)

    def hashes(self) -> np.ndarray:
        return _groups(self.h, self.window)[self.at]


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(h).view(np.int64))


def _named(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids, marks and texts of the rows that have an id, repeated rows once."""
    rows = batch.filter(batch.column("id").is_valid())
    ids, marks = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "mark"))
    order = np.lexsort((marks, ids))
    new = np.r_[True, (ids[order][1:] != ids[order][:-1]) | (marks[order][1:] != marks[order][:-1])] if len(ids) else np.zeros(0, bool)
    own = np.sort(order[new])
    return ids[own], marks[own], utf8(rows.column("text").take(pa.array(own)))


def recurring_seeds(rows: DataFrame, window: int) -> DataFrame:
    """(seed, places) of the seeds (as signed longs) that occur in more than one
    document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            ids, _, texts = _named(b)
            w = Windows(texts, window)
            if not len(w):
                continue
            new = np.r_[True, (w.seed[1:] != w.seed[:-1]) | (w.doc[1:] != w.doc[:-1])]
            seed, doc = w.seed[new], ids[w.doc[new]]
            order = np.argsort(seed)
            seed, doc = seed[order], doc[order]
            cut = np.flatnonzero(np.r_[True, seed[1:] != seed[:-1]])
            places = np.diff(np.r_[cut, len(seed)])
            yield pa.RecordBatch.from_arrays([_signed(seed[cut]), pa.array(np.minimum.reduceat(doc, cut)), pa.array(np.maximum.reduceat(doc, cut)), pa.array(places)], names=["seed", "lo", "hi", "n"])

    found = rows.mapInArrow(run, "seed long, lo long, hi long, n long")
    return found.groupBy("seed").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("places")).where("lo < hi").select("seed", "places")


#: A row is an open segment (words) or settled (n > 0 words to remove).
SEGMENTS = "key long, words binary, doc long, mark long, pos long, n long"


def segment_rows(batches: Iterator[pa.RecordBatch], marked: tuple[bytes, bytes], window: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``SEGMENTS`` from rows (id, mark, text); bitmaps mark recurring seeds and
    those in many places."""
    bitmap, hot = marked
    for b in slices(batches, "text", SLICE_BYTES):
        ids, marks, texts = _named(b)
        w = Windows(texts, window)
        if not len(w):
            continue
        hit = np.flatnonzero(in_bitmap(bitmap, w.seed))
        if not len(hit):
            continue
        key, text, at = w.seed[hit], w.doc[hit], w.at[hit]
        begin = np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)]
        busy = in_bitmap(hot, key)
        if busy.any():
            key = np.where(busy, w.hashes()[hit], key)
            begin |= busy
        starts = np.flatnonzero(begin)
        first, last = at[starts], at[np.r_[starts[1:], len(at)] - 1] + window
        key, text = key[starts], text[starts]
        line, begins = spaced(texts)
        words = [line[x:y] for x, y in zip(begins[first].tolist(), (begins[last] - 1).tolist(), strict=True)]
        doc, mark, pos = ids[text], marks[text], first - w.first_word[text]
        # the first of equal segments, in order of document, settles the others
        order = np.argsort(doc, kind="stable")
        owner: dict[bytes, int] = {}
        own = np.empty(len(words), np.int64)
        own[order] = [owner.setdefault(words[i], i) for i in order.tolist()]
        settled = doc[own] < doc
        open_ = np.flatnonzero(~settled)
        gone = np.flatnonzero(settled)
        if len(gone):  # settled segments of a text that overlap or touch are one
            new = np.r_[True, (text[gone][1:] != text[gone][:-1]) | (first[gone][1:] > last[gone][:-1])]
            cut = np.flatnonzero(new)
            n = last[gone][np.r_[cut[1:], len(gone)] - 1] - first[gone][cut]
            gone = gone[cut]
        else:
            n = np.zeros(0, np.int64)
        both = np.r_[open_, gone]
        yield pa.RecordBatch.from_arrays(
            [_signed(key[both]), pa.array([*[words[i] for i in open_.tolist()], *[None] * len(gone)], pa.binary()), *[pa.array(x[both]) for x in (doc, mark, pos)], pa.array(np.r_[np.zeros(len(open_), np.int64), n])],
            names=["key", "words", "doc", "mark", "pos", "n"],
        )


def segments(rows: DataFrame, marked, window: int) -> DataFrame:
    """The segments under marked seeds, each under its key."""
    return rows.mapInArrow(lambda batches: segment_rows(batches, marked.value, window), SEGMENTS)


Place = tuple[bytes, int, int, int]  # a segment's words, and where it stands: doc, mark, pos


def passages(held: list[tuple[tuple[int, ...], int, int]], window: int) -> dict[tuple[int, ...], int]:
    """Passages of the segments of one key, each with its least document. Segments are
    (words as numbers, least doc, greatest doc), all different. Windows in a row that
    occur in the same places are one passage."""
    if len(held) == 1:
        words, lo, hi = held[0]
        return {words: lo} if lo < hi else {}
    where: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    for s, (words, _, _) in enumerate(held):
        for i in range(len(words) - window + 1):
            where.setdefault(words[i : i + window], []).append((s, i))
    out: dict[tuple[int, ...], int] = {}
    begin, last = (0, 0), None  # a passage's first window, and the places of its last
    reach = 0

    def close() -> None:
        if last is not None:
            s, i = begin
            out[held[s][0][i:reach]] = min(held[t][1] for t, _ in last)

    for places in where.values():  # in order of first occurrence
        if min(held[t][1] for t, _ in places) == max(held[t][2] for t, _ in places):
            continue
        s, i = places[0]
        if last is not None and len(last) == len(places) and reach == i + window - 1 and all(a == c and b + 1 == d for (a, b), (c, d) in zip(last, places, strict=True)):
            reach += 1
        else:
            close()
            begin, reach = (s, i), i + window
        last = places
    close()
    return out


def located(groups: list[list[Place]], window: int) -> Iterator[tuple[int, int, int, int]]:
    """Spans (doc, mark, pos, n) that the passages of the groups (each of one key, in
    order of doc) cover in later documents: one automaton for all groups."""
    import ahocorasick

    number: dict[bytes, int] = {}
    found: dict[tuple[int, ...], int] = {}
    streams: list[tuple[tuple[int, ...], list[Place]]] = []
    for group in groups:
        if group[0][1] == group[-1][1]:
            continue
        by: dict[bytes, list[Place]] = {}
        for place in group:
            by.setdefault(place[0], []).append(place)
        own = [(tuple([number.setdefault(w, len(number) + 1) for w in words.split(b" ")]), held) for words, held in by.items()]
        new = passages([(words, held[0][1], held[-1][1]) for words, held in own], window)
        if new:
            for words, lo in new.items():
                found[words] = min(lo, found.get(words, lo))
            streams += own
    if not found:
        return
    auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for words, lo in found.items():
        auto.add_word(words, (len(words), lo))
    auto.make_automaton()
    for words, held in streams:
        hits = sorted((end - n + 1, end + 1, lo) for end, (n, lo) in auto.iter(words))
        spans: dict[int, list[list[int]]] = {}
        for _, doc, mark, pos in held:
            if pos < 0:
                continue
            if doc not in spans:
                own: list[list[int]] = []
                for a, b, lo in hits:
                    if lo < doc:
                        if own and a <= own[-1][1]:
                            own[-1][1] = max(own[-1][1], b)
                        else:
                            own.append([a, b])
                spans[doc] = own
            for a, b in spans[doc]:
                yield doc, mark, pos + a, b - a


def spans_of(placed: DataFrame, window: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc, mark, pos, n): words to remove, from segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list[Place]] = []
        held, size = None, 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*located(groups, window), strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "mark", "pos", "n"])

        for b in batches:
            n = b.column("n").to_numpy(zero_copy_only=False)
            done = b.filter(pa.array(n > 0))
            if done.num_rows:
                yield done.select(["doc", "mark", "pos", "n"])
            rows = b.filter(pa.array(n == 0))
            for key, words, doc, mark, pos in zip(*[rows.column(c).to_pylist() for c in ("key", "words", "doc", "mark", "pos")], strict=True):
                if key != held:
                    if size >= shard_bytes:
                        yield flush()
                        groups, size = [], 0
                    groups.append([])
                    held = key
                elif size >= shard_bytes and len(groups[-1]) > 1 and groups[-1][-1][1] < doc:
                    # one key alone: its different segments stay, each with its least document
                    yield flush()
                    kept: dict[bytes, Place] = {}
                    for w, d, m, _ in groups[-1]:
                        kept.setdefault(w, (w, d, m, -1))
                    groups, size = [list(kept.values())], 0
                groups[-1].append((words, doc, mark, pos))
                size += len(words) + 32
        if groups:
            yield flush()

    return placed.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(run, "doc long, mark long, pos long, n long")


def remaining(words: list[bytes], ranges: list[tuple[int, int]]) -> list[bytes]:
    """The words outside all ranges."""
    if not ranges:
        return words
    kept, at = [], 0
    for a, b in sorted(ranges):
        if a > at:
            kept += words[at:a]
        at = max(at, b)
    return kept + words[at:]


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, bitmap_bits: int = BITMAP_BITS, hot_places: int = HOT_PLACES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, text, spans): every row of ``docs`` with the (pos, n) to remove."""
    if window < SEED_WORDS:
        raise ValueError(f"a window has at least {SEED_WORDS} words")
    spark = docs.sparkSession
    rows = docs.selectExpr(f"cast(`{id_col}` AS long) AS id", f"`{text_col}` AS text").withColumn("mark", F.xxhash64("text"))
    seeds = materialise(recurring_seeds(rows, window))
    marked = spark.sparkContext.broadcast((bitmap_of(seeds, "seed", bitmap_bits), bitmap_of(seeds.where(F.col("places") > hot_places), "seed", bitmap_bits)))
    spans = spans_of(segments(rows, marked, window), window, shard_bytes)
    # rows that repeat a text under one id share its spans
    grouped = spans.groupBy("doc", "mark").agg(F.collect_set(F.struct("pos", "n")).alias("spans"))
    return rows.join(grouped.withColumnRenamed("mark", "of"), (F.col("id") == F.col("doc")) & (F.col("mark") == F.col("of")), "left").select("id", "text", "spans")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, bitmap_bits: int = BITMAP_BITS, hot_places: int = HOT_PLACES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each row: id, n_words, n_removed, kept (text, words joined by a
    space), kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            out, lines = [], []
            for text, spans in zip(utf8(b.column("text")), b.column("spans").to_pylist(), strict=True):
                words = text.split()
                kept = remaining(words, [(s["pos"], s["pos"] + s["n"]) for s in spans or ()])
                lines.append(b" ".join(kept))
                out.append((len(words), len(words) - len(kept)))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *[pa.array(c, pa.int64()) for c in zip(*out, strict=True)], pa.array(lines, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in lines], pa.string())],
                names=["id", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    beside = removed_spans(docs, id_col, text_col, window, bitmap_bits, hot_places, shard_bytes)
    return beside.mapInArrow(run, "id long, n_words long, n_removed long, kept string, kept_sha256 string").withColumnRenamed("id", id_col)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept")
