"""Spelling variant grouping (operator 11): Aho-Corasick halves.

Two words are near if they differ by one inserted, deleted or replaced code point. Such
an edit falls into one half of the shorter word (the first, if lengths are equal), so
the other half stands unchanged in the longer word, at its begin or at its end.

1. Words. Letter runs of whole texts are counted in each task and then over all, so a
   frequent word sends one row for each task. A run that its checksum picks loses one
   letter first, which makes variants of known origin.
2. Keys. A word holds two keys, one for each half (length, place, letters); and it asks
   for the keys of the words of its own length, which are those that it holds (one row
   says both), and of one letter less, whose halves it would contain at the right place.
   Keys with more than ``HOT_ROWS`` rows (a common beginning) cut what is left of the word
   into halves again, as often as it takes: so a beginning that a third of all words share
   is dealt by what follows. Which keys these are a bitmap of fixed size tells; a false hit
   cuts a key that needn't be cut, for the words that hold it and those that ask for it
   alike.
3. Automata. Keys are dealt to shards. In each shard the held segments make one
   Aho-Corasick automaton, and all words that ask for one of its keys are scanned. A hit
   counts if the segment stands at its offset and the lengths are compatible (segments
   list what is held by scanned length and place of the hit) and the other known part (of
   a key cut again) is equal; then the distance is verified. Each pair is told at one of
   its keys only: the first half, if that is unchanged, and so on.
4. Forms. A word's form is its most frequent near word (ties: the first in code-point
   order) if that is ten times as frequent; roots follow forms by pointer doubling.

Defined cases: null text: no words; a null id counts as the empty id; repeated rows count
as often as they stand there; very long runs are words like others (an automaton keeps 64
letters of a segment, the rest is compared); an empty table gives no rows; other columns
are ignored."""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_of, materialise, sieved, slices, table, utf8

MIN_LENGTH, MIN_COUNT = 7, 2
#: One run in so many (by checksum) loses a letter.
ALTERED = 31
#: A form is so many times as frequent as its word.
RATIO = 10
#: Rows of a key (a word that holds it and asks for it counts twice) beyond which it is
#: cut again, as long as three letters or more are left.
HOT_ROWS = 128
#: Letters of the words that one shard holds, and of a segment that its automaton keeps.
SHARD_CHARS, ANCHOR = 1 << 20, 64
#: Pairs that a task tells at a time.
TOLD = 20_000
#: Different words that a task counts before it sends them.
COUNTED = 300_000
BITMAP_BITS = 26


def altered(word: str, start: int) -> str:
    """``word``, without one letter where its checksum (``start``: that of what comes
    before it) says so."""
    h = crc32(word.encode(), start)
    at = h % len(word)
    return word if h % ALTERED else word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of ``min_length`` letters that stand in at least ``min_count``
    places."""
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{min_length},}}").findall  # shorter runs make shorter words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = defaultdict(int)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for b in slices(batches, "text"):
            for name, text in zip(b.column("id").to_pylist(), utf8(b.column("text")), strict=True):
                start = crc32(f"{name or ''}:".encode())
                for word, n in Counter(runs(text.lower().decode())).items():  # bytes: A-Z alone
                    word = altered(word, start)
                    if len(word) >= min_length:
                        total[word] += n
            if len(total) >= COUNTED:
                yield flush()
        if total:
            yield flush()

    rows = docs.selectExpr(f"cast(`{id_col}` AS string) AS id", f"`{text_col}` AS text")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# -- keys -----------------------------------------------------------------------------------

#: What a key fixes of a word of ``la`` letters: the first ``p`` and the last ``s``; its
#: newest segment has ``seg`` letters and ends the first (side 0) or begins the last ones.
STATE = ["la", "p", "s", "side", "seg"]
KEY = "xxhash64(la, p, s, substring(word, 1, p), substring(word, length(word) - s + 1, s))"


def halved(rows: DataFrame) -> DataFrame:
    """Both keys that cut what the states of ``rows`` leave open."""
    first, second = "(la - p - s) div 2", "la - p - s - (la - p - s) div 2"
    cuts = f"inline(array(struct(0 AS side1, p + {first} AS p1, s AS s1, {first} AS seg1), struct(1 AS side1, p AS p1, s + {second} AS s1, {second} AS seg1)))"
    named = rows.selectExpr("word", "n", "la", cuts)
    return named.selectExpr("word", "n", "la", "cast(p1 AS int) AS p", "cast(s1 AS int) AS s", "side1 AS side", "cast(seg1 AS int) AS seg").withColumn("key", F.expr(KEY))


def keyed(words: DataFrame, min_length: int = MIN_LENGTH, hot_rows: int = HOT_ROWS, bits: int = BITMAP_BITS) -> DataFrame:
    """(word, n, la, p, s, side, seg, key): the keys that words hold and ask for (those of
    their own length) or only ask for (of one letter less), cut so far that no key has more
    than ``hot_rows`` rows or more than two letters open."""
    spark = words.sparkSession
    lengths = "explode(array(length(word), length(word) - 1)) AS la"
    level = halved(words.selectExpr("word", "n", lengths).where(F.col("la") >= min_length).selectExpr("*", "0 AS p", "0 AS s"))
    done = None
    while True:
        level = materialise(level)
        sizes = level.where("la - p - s > 2").groupBy("key").agg(F.sum(F.expr("if(la = length(word), 2, 1)")).alias("rows")).where(F.col("rows") > hot_rows)
        hot = materialise(sizes.select("key"))
        if hot.isEmpty():
            return level if done is None else done.unionByName(level)
        marked = spark.sparkContext.broadcast(bitmap_of(hot, "key", bits))
        open_ = level.where("la - p - s > 2")
        kept = sieved(open_, "key", marked, wanted=False).unionByName(level.where("la - p - s <= 2"))
        done = kept if done is None else done.unionByName(kept)
        level = halved(sieved(open_, "key", marked))


# -- automata -------------------------------------------------------------------------------


def first_difference(a: str, b: str, lo: int = 0) -> int:
    """How many letters a and b (as long as a, or longer) share before they differ, at
    least ``lo``."""
    if len(a) - lo > 64:
        if b.startswith(a):
            return len(a)
        hi = len(a)
        while hi - lo > 64:
            middle = (lo + hi) // 2
            lo, hi = (middle, hi) if a[lo:middle] == b[lo:middle] else (lo, middle)
    while lo < len(a) and a[lo] == b[lo]:
        lo += 1
    return lo


def by_first_halves(la: int, same: int, p: int, s: int) -> bool:
    """Whether the state (p, s) is the one reached from the whole word of ``la`` letters
    by taking the first half where it lies within the first ``same`` letters, and the
    second where it doesn't."""
    x = y = 0
    while x + y < p + s:
        half = (la - x - y) // 2
        x, y = (x + half, y) if same >= x + half else (x, la - x - half)
    return (x, y) == (p, s)


#: The words that hold a state, by the letters that it fixes.
Groups = dict[tuple[str, str], list[tuple[str, int]]]


class Shard:
    """An automaton of segments, and the words that hold them by state and known parts."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.states: dict[tuple[str, int, int, int, int], Groups] = {}
        #: By segment, length of a scanned word and end of the hit in it: what is held there.
        self.places: dict[str, dict[tuple[int, int], list[tuple[int, int, int, Groups]]]] = {}
        self.made = False

    def hold(self, word: str, n: int, la: int, p: int, s: int, side: int, seg: int) -> None:
        begin = p - seg if side == 0 else la - s
        segment = word[begin : begin + min(seg, ANCHOR)]
        groups = self.states.get((segment, la, p, s, side))
        if groups is None:
            groups = self.states[segment, la, p, s, side] = {}
            places = self.places.setdefault(segment, {})
            for longer in (0, 1):  # a last part begins a letter later in a longer word
                end = begin + len(segment) - 1 + (longer if side else 0)
                places.setdefault((la + longer, end), []).append((la, p, s, groups))
        groups.setdefault((word[:p], word[la - s :]), []).append((word, n))

    def make(self) -> None:
        for segment, places in self.places.items():
            self.automaton.add_word(segment, places)
        self.automaton.make_automaton()
        self.made = True

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """Words held here that are one edit away, as long as ``word`` and before it in
        order or one letter shorter."""
        if not self.made:
            self.make()
        if not self.places:
            return
        length = len(word)
        for end, places in self.automaton.iter(word):
            for la, p, s, groups in places.get((length, end), ()):
                equal = la == length
                for other, n in groups.get((word[:p], word[length - s :]), ()):
                    if equal and other >= word:
                        continue
                    same = first_difference(other, word, p)
                    if other[same + equal :] == word[same + 1 :] and by_first_halves(la, same, p, s):
                        yield other, n


def near_pairs(words: DataFrame, min_length: int = MIN_LENGTH, hot_rows: int = HOT_ROWS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(a, a_n, b, b_n): every pair of near words once, from (word, n)."""
    spark = words.sparkSession
    rows = keyed(words, min_length, hot_rows)
    chars = words.agg(F.sum(F.length("word"))).first()[0] or 0
    shards = max(-(-2 * chars // shard_chars), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def told(shard: Shard, asked: dict[str, int]) -> Iterator[pa.RecordBatch]:
        pairs = ((other, m, word, n) for word, n in asked.items() for other, m in shard.near(word))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        while some := list(itertools.islice(pairs, TOLD)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=["a", "a_n", "b", "b_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard, asked = None, Shard(), {}  # a word asks a shard once
        for b in batches:
            for at, word, n, la, *state in zip(*[b.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("shard", "word", "n", *STATE)], strict=True):
                if at != held:
                    yield from told(shard, asked)
                    held, shard, asked = at, Shard(), {}
                asked[word] = n
                if len(word) == la:
                    shard.hold(word, n, la, *state)
        yield from told(shard, asked)

    dealt = rows.withColumn("shard", F.pmod("key", F.lit(shards))).drop("key")
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "a string, a_n long, b string, b_n long")


# -- forms ----------------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form), forms followed to the last."""
    now = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        ahead = materialise(ahead.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            return now


def variants(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word (word, n)."""
    both = F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    best = pairs.select(both).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    high = -F.col("best.less") >= ratio * F.col("n")
    named = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(high, F.col("best.near")).alias("form"), F.when(high, -F.col("best.less")).alias("form_n"))
    named = materialise(named)
    ends = roots(named.where("form IS NOT NULL"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, hot_rows: int = HOT_ROWS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for all words of ``docs``."""
    words = materialise(word_counts(docs, id_col, text_col, min_length, min_count))
    return variants(words, near_pairs(words, min_length, hot_rows, shard_chars), ratio)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"))
