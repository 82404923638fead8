"""Toxicity (operator 6): a subsequence string kernel and a linear machine over
Nyström landmarks.

The kernel of two words counts the letter subsequences of length ``ORDER`` that they
share, each weighted ``DECAY`` for every letter that it spans (Lodhi et al., 2002);
normalised, and taken to the power ``POWER``, which leaves it a kernel and sets words
of some shared letters far apart. An insult with letters put in, left out or exchanged
stays near its stem. A word is compared by its windows of ``WINDOW`` letters, at every
place (a shorter word whole); signs in it do not count, and four or more single letters
in a row are one more word.

Training. From the labelled documents a bounded sample is drawn (see :func:`train`).
Landmarks are word parts found there by greedy cover: each next one is the part that
covers most words in toxic documents of which less than ``COVER`` are covered, and that
hardly occurs in clean ones. The
kernel's values with the landmarks, whitened by the landmarks' own kernel matrix, are a
word's Nyström coordinates; no value is cut off. A squared-hinge machine is fitted to
words: of each toxic document those that the machine finds worst, chosen anew a few
times, and landmarks with a letter put in, left out or exchanged; of the clean ones
those that it finds worst. A logistic curve over the worst word of each document turns
it into a score.

Scoring reads every whole text once, without a shuffle. The model is a few matrices
whose size is set by the number of landmarks. A landmark's subsequences are rows of a
table, so a word's kernel values come from looking its own subsequences up there; those
of no landmark add nothing and are the only ones left out. Words already met by a worker
are looked up.

Defined cases: null and empty texts get the score of a text without any toxic word;
documents that are unlabelled, or labelled null, train nothing; a document labelled
both ways counts as toxic; without training rows of both classes, or without any telling
word part (then with a warning), every score is 0; rows come out as often as they came
in; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, texts

ORDER = 3
DECAY = 0.8
#: Chosen, like the machine's penalty, by halves of the training rows of sf0.1.
POWER = 3
PENALTY = 1e-4
WINDOW = 10
LANDMARKS = 40
PART_LENGTHS = (4, 12)
#: A landmark occurs in so many toxic documents for each clean one.
PRECISE = 15
#: Toxic words that one clean document with a part outweighs when it is chosen.
FOREIGN = 6
#: Words of a toxic document that landmarks are to cover.
COVER = 3
#: Altered forms of a landmark in training: of each kind so many, from this length on.
ALTERED, ALTERED_LENGTH = 3, 5
#: What all altered forms weigh in training, where all toxic documents weigh 1.
FORMS_SHARE = 0.2
#: Bound of the training sample: documents of each class, and characters of a text.
TRAIN_DOCS = 2500
TRAIN_CHARS = 3000
THRESHOLD = 0.3
KEPT_WORDS = 200_000
SLICE_BYTES = 1 << 20

_SIGNS = re.compile(r"[\W_]+")


def kernel(words: np.ndarray, marks: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Subsequence kernel of pairs: ``words`` (n, w) and ``marks`` (n, m) hold letter
    codes, 0 where a string has ended."""
    n, width = marks.shape
    gap = np.arange(width)[None, :] - np.arange(width)[:, None] - 1
    carry = np.where(gap >= 0, decay ** np.maximum(gap, 0), 0).astype(np.float32)
    state = np.zeros((order - 1, n, width), np.float32)
    total = np.zeros(n, np.float32)
    for i in range(words.shape[1]):
        letter = words[:, i : i + 1]
        match = ((letter == marks) & (letter > 0)) * np.float32(decay * decay)
        ends = [match]
        for q in range(order - 1):
            ends.append(match * (state[q] @ carry))
        for q in range(order - 1):
            state[q] *= decay
            state[q] += ends[q]
        total += ends[-1].sum(1)
    return total


def codes(words: list[str], width: int) -> np.ndarray:
    """Letter codes, one row for each word, padded with 0."""
    out = np.zeros((len(words), width), np.int32)
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), np.int32)
    return out


@cache
def places(n: int, order: int = ORDER, decay: float = DECAY) -> tuple[np.ndarray, np.ndarray]:
    """All ways to take ``order`` places of n in a row, and their weights."""
    at = np.array(list(combinations(range(n), order)), np.int64).reshape(-1, order)
    return at, (decay ** (at[:, -1] - at[:, 0] + 1)).astype(np.float32)


def bare(token: str) -> str:
    """A token as it is compared: lower case, without signs around or in it."""
    word = token.lower()
    return word if word.isalnum() else _SIGNS.sub("", word)


def windows(word: str) -> list[str]:
    return [word] if len(word) <= WINDOW else [word[i : i + WINDOW] for i in range(len(word) - WINDOW + 1)]


def tokens_of(text: str) -> list[str]:
    """Tokens of a text; a row of single letters is one more."""
    own = text.split()
    if list(map(len, own)).count(1) > 3:
        row = "".join(t if len(t) == 1 else " " for t in own)
        own += [w for w in row.split() if len(w) > 3]
    return own


class Landmarks:
    """Kernel values of words with the landmarks."""

    def __init__(self, marks: list[str]) -> None:
        self.marks = marks
        letters = sorted({c for m in marks for c in m})
        self._number = np.zeros(max(map(ord, letters), default=0) + 1, np.int64)
        self._number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self._base = len(letters) + 1
        rows: dict[int, int] = {}
        found = []
        for k, m in enumerate(marks):
            at, weight = places(len(m))
            for code, w in zip(self._coded(self._numbers([m])[0][at]).tolist(), weight.tolist(), strict=True):
                found.append((rows.setdefault(code, len(rows) + 1), k, w))
        self._row = np.zeros(self._base**ORDER, np.int32)
        self._row[list(rows)] = list(rows.values())
        self._table = np.zeros((len(rows) + 1, len(marks)), np.float32)
        for row, k, w in found:
            self._table[row, k] += w
        own = np.sqrt((self._table.astype(np.float64) ** 2).sum(0))
        self._table = (self._table / np.where(own > 0, own, 1)).astype(np.float32)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Words of one length by the numbers of their letters, 0 for foreign ones."""
        raw = np.frombuffer("".join(words).encode("utf-32-le"), np.int32).reshape(len(words), -1)
        return np.where(raw < len(self._number), self._number[np.minimum(raw, len(self._number) - 1)], 0)

    def _coded(self, letters: np.ndarray) -> np.ndarray:
        code = np.zeros(letters.shape[:-1], np.int64)
        for k in range(ORDER):
            code = code * self._base + letters[..., k]
        return code

    def values(self, words: list[str]) -> np.ndarray:
        """(word, landmark): the normalised kernel to the power."""
        out = np.zeros((len(words), len(self.marks)), np.float32)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) >= ORDER:
                by.setdefault(len(w), []).append(i)
        for n, all_of in by.items():
            at, weight = places(n)
            step = max(1, 400_000 // len(at))
            for lo in range(0, len(all_of), step):
                own = all_of[lo : lo + step]
                some = [words[i] for i in own]
                rows = self._row[self._coded(self._numbers(some)[:, at])]
                word, place = np.nonzero(rows)
                if not len(word):
                    continue
                first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                near = np.add.reduceat(self._table[rows[word, place]] * weight[place, None], first, axis=0)
                hit = word[first]
                letters = codes([some[i] for i in hit.tolist()], n)
                out[np.array(own)[hit]] = near / np.sqrt(kernel(letters, letters))[:, None]
        return np.minimum(out, 1) ** POWER


@dataclass
class Model:
    marks: list[str]
    whiten: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def __post_init__(self) -> None:
        self.landmarks = Landmarks(self.marks)
        self._known: dict[str, float] = {}

    def values(self, words: list[str]) -> np.ndarray:
        """The machine's value of each word."""
        return self.landmarks.values(words) @ (self.whiten @ self.weights).astype(np.float32) + self.bias

    def learn(self, tokens: set[str]) -> None:
        """Fill the table of tokens with those not in it."""
        if len(self._known) + len(tokens) > KEPT_WORDS:
            self._known.clear()
        new = [t for t in tokens if t not in self._known]
        cut = [windows(bare(t)) for t in new]
        flat = self.values(list(chain.from_iterable(cut)))
        at = np.cumsum([0, *map(len, cut)])[:-1]
        self._known.update(zip(new, np.maximum.reduceat(flat, at).tolist() if new else (), strict=True))

    def scores(self, batch: list[str]) -> np.ndarray:
        if not self.marks:
            return np.zeros(len(batch))
        cut = [tokens_of(text) for text in batch]
        self.learn(set(chain.from_iterable(cut)))
        worst = np.array([max(map(self._known.__getitem__, own), default=self.bias) for own in cut])
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -30, 30)))


def parts(word: str, shortest: int = PART_LENGTHS[0], longest: int = PART_LENGTHS[1]) -> list[str]:
    return [word[i : i + n] for n in range(shortest, min(longest, len(word)) + 1) for i in range(len(word) - n + 1)]


def choose_landmarks(toxic: list[str], clean: list[str], most: int = LANDMARKS) -> list[str]:
    """Word parts by greedy cover of the toxic documents, ``COVER`` words in each. A part
    is telling if enough toxic documents have it and few clean ones."""
    shortest = PART_LENGTHS[0]
    words_of = lambda text: {w for w in map(bare, text.split()) if len(w) >= shortest}
    bad, good = [words_of(t) for t in toxic], [words_of(t) for t in clean]
    support = max(5, len(toxic) // 100)
    roots = {g for g, n in Counter(g for words in bad for g in {g for w in words for g in parts(w, shortest, shortest)}).items() if n >= support}

    @cache
    def frequent(word: str) -> tuple[str, ...]:
        """Parts all of whose roots are frequent."""
        out, at = [], 0
        fits = [word[i : i + shortest] in roots for i in range(len(word) - shortest + 1)]
        while at < len(fits):
            end = at
            while end < len(fits) and fits[end]:
                end += 1
            if end > at:
                out += parts(word[at : end + shortest - 1])
            at = end + 1
        return tuple(out)

    has = Counter(p for words in bad for p in set(chain.from_iterable(map(frequent, words))))
    wanted = {p for p, n in has.items() if n >= support}
    foreign = Counter(p for words in good for p in wanted.intersection(chain.from_iterable(map(frequent, words))))
    telling = {p for p in wanted if PRECISE * foreign[p] <= has[p]}
    owners: dict[str, dict[int, set[int]]] = {}  # part -> document -> its words with the part
    for d, words in enumerate(bad):
        for n, w in enumerate(sorted(words)):
            for p in telling.intersection(frequent(w)):
                owners.setdefault(p, {}).setdefault(d, set()).add(n)
    worth = {p: sum(min(COVER, len(n)) for n in o.values()) - FOREIGN * foreign[p] for p, o in owners.items()}
    order = sorted(owners, key=lambda p: (-worth[p], -len(p), p))
    covered: dict[int, set[int]] = {}
    chosen: list[str] = []
    while len(chosen) < most:
        best, gain = None, (support - 1, 0)
        for p in order:
            if worth[p] < gain[0]:
                break
            new = sum(min(COVER - len(own), len(n - own)) for d, n in owners[p].items() if len(own := covered.get(d, set())) < COVER)
            now = (new - FOREIGN * foreign[p], len(p))
            if now > gain:
                best, gain = p, now
        if best is None:
            break
        chosen.append(best)
        for d, n in owners[best].items():
            covered.setdefault(d, set()).update(n)
    return chosen


def machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, penalty: float = PENALTY, steps: int = 40) -> tuple[np.ndarray, float]:
    """Squared-hinge machine by Newton steps on the points inside the margin; ``cost`` is
    what each point weighs. y is -1 or 1."""
    z = np.c_[x, np.ones(len(x))].astype(np.float64)
    w = np.zeros(z.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[-1, -1] = 1e-9
    inside = None
    for _ in range(steps):
        now = y * (z @ w) < 1
        if inside is not None and (now == inside).all():
            break
        inside = now
        a = z[inside] * cost[inside, None]
        w = np.linalg.solve(a.T @ z[inside] + ridge, a.T @ y[inside])
    return w[:-1], float(w[-1])


def logistic(v: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and shift of a logistic curve, slightly drawn to zero."""
    z = np.c_[v, np.ones(len(v))]
    p, ridge = np.zeros(2), np.diag([1e-2, 1e-6])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(z @ p, -30, 30)))
        grad = z.T @ (q - y) + ridge @ p
        step = np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + ridge, grad)
        p = p - step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(p[0]), float(p[1])


def altered(word: str, rng: random.Random, each: int = ALTERED) -> list[str]:
    """Forms of a word with a letter put in, exchanged and left out."""
    signs, out = "abcdefghijklmnopqrstuvwxyz0123456789", []
    for _ in range(each):
        at = rng.randrange(1, len(word))
        out += [word[:at] + rng.choice(signs) + word[at:], word[:at] + rng.choice(signs) + word[at + 1 :], word[:at] + word[at + 1 :]]
    return out


def fit(toxic: list[str], clean: list[str], landmarks: int = LANDMARKS, rounds: int = 5, penalty: float = PENALTY, seed: int = 6) -> Model:
    """A model from texts of both classes."""
    empty = Model([], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, 0.0)
    if not toxic or not clean:
        return empty
    marks = choose_landmarks(toxic, clean, landmarks)
    if not marks:
        warnings.warn("no word part tells toxic texts from clean ones; all scores are 0", stacklevel=2)
        return empty
    kernels = Landmarks(marks)
    gram = kernels.values(marks).astype(np.float64)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    whiten = vectors @ np.diag(np.maximum(values, 1e-6 * values.max()) ** -0.5) @ vectors.T
    number: dict[str, int] = {}
    bags = [np.array([number.setdefault(w, len(number)) for t in dict.fromkeys(tokens_of(text)) for w in windows(bare(t))], np.int64) for text in (*toxic, *clean)]
    points = kernels.values(list(number)) @ whiten.astype(np.float32)
    bad, good = [b for b in bags[: len(toxic)] if len(b)], [b for b in bags[len(toxic) :] if len(b)]
    rng = random.Random(seed)
    forms = kernels.values(sorted({f for m in marks if len(m) >= ALTERED_LENGTH for f in altered(m, rng)})) @ whiten.astype(np.float32)
    held = np.zeros(len(number), bool)
    held[[i for w, i in number.items() if any(m in w for m in marks)]] = True
    # a word of clean documents weighs as many of them as have it; a toxic document is
    # shared by the words that stand for it
    clean_in = np.bincount(np.concatenate([np.unique(b) for b in good]), minlength=len(number)) / len(clean) if good else np.zeros(len(number))
    seen = np.flatnonzero(clean_in)
    hard = np.array(sorted(rng.sample(seen.tolist(), min(3000, len(seen)))), np.int64)
    witnesses = [b[held[b]] for b in bad]
    for r in range(rounds + 1):
        toxic_in = np.zeros(len(number))
        for own in witnesses:
            toxic_in[own] += 1 / len(own) / len(toxic) if len(own) else 0.0
        worst = np.flatnonzero(toxic_in)
        x = np.concatenate([points[worst], forms, points[hard]])
        y = np.r_[np.ones(len(worst) + len(forms)), -np.ones(len(hard))]
        cost = np.r_[toxic_in[worst], np.full(len(forms), FORMS_SHARE / max(1, len(forms))), clean_in[hard]]
        weights, bias = machine(x, y, cost, penalty)
        value = points @ weights + bias
        if r < rounds:
            witnesses = [np.unique(np.r_[b[value[b] >= 0.5], b[value[b].argmax()]]) for b in bad]
            hard = np.unique(np.concatenate([hard, *[np.r_[b[value[b] >= -0.5], b[value[b].argmax()]] for b in good]]))
    decisions = np.array([value[b].max() if len(b) else bias for b in bags])
    slope, shift = logistic(decisions, np.r_[np.ones(len(toxic)), np.zeros(len(clean))])
    return Model(marks, whiten, weights, bias, slope, shift)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> Model:
    """Fit a model on a bounded sample of labelled rows that are not held out. Of each
    class the ``2 * per_class`` ids first by hash are asked for; of their texts those of
    up to ``max_chars`` characters come first, and ``per_class`` at most are used. Of a
    longer text the sample takes ``max_chars`` characters from a place set by its hash."""
    named = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("id")))
    named = named.groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn("at", F.xxhash64("id"))
    drawn = [named.where(F.col("toxic") == t).orderBy("at", "id").limit(2 * per_class) for t in (0, 1)]
    wanted = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most 4 * per_class rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted, "id").where(F.length("text") > 0)
    over = F.greatest(F.length("text") - max_chars, F.lit(0))
    part = F.substring("text", F.pmod(F.xxhash64("text"), over + 1).cast("int") + 1, F.lit(max_chars))
    rows = rows.select("id", "toxic", "at", (over > 0).alias("long"), part.alias("text"))
    sample = [r for t in (0, 1) for r in rows.where(F.col("toxic") == t).orderBy("long", "at", "id", "text").limit(per_class).collect()]
    return fit([r.text for r in sample if r.toxic == 1], [r.text for r in sample if r.toxic == 0])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(shared.value.scores(texts(b.column("text"))), pa.float64())], names=["id", "score"])

    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, SLICE_BYTES):
            yield b.filter(pa.array(shared.value.scores(texts(b.column(b.schema.get_field_index(text_col)))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
