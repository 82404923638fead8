"""Fill-in-middle transformation (operator 12) over an index of distinct texts.

1. Hashes of all texts are counted. Texts whose hash stands alone are their own group and
   are worked on where they are read; a bitmap of fixed size tells them from the others.
2. Distinct texts. Each task sends one row for each different text (compared as a whole
   in the task) and a small reference (id, hash, digest) for each document. Texts of one
   hash and digest meet and are compared again as they come, byte for byte, so a group
   holds one content; of these one stays.
3. Boundaries. The byte offsets of a distinct text's code points are kept as an Elias-Fano
   list (about two bits for each), made once, whatever the number of its documents.
4. The index (text, list) is joined back to the references. A hash with more documents
   than one in ``SHARES`` of all (so at most ``SHARES`` hashes) deals them to that many
   parts, with the index row in each.
5. Each document draws two cuts from its seed; two selects in the list turn them into byte
   offsets, and the parts are put together.

Defined cases: null text is the empty text, which stays plain; a null id counts as the
empty id in the seed; repeated rows come out as often as they stand there; a text that
holds a sentinel stays plain; texts of any length are cut whole; an empty table gives no
rows; other columns are ignored."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_of, materialise, sieved, slices, table, utf8

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 documents so many are transformed, and of 100 of these so many suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: A hash with more than one in so many of all documents is dealt to parts.
SHARES = 20_000
LEAST_SHARE = 1000
SLICE_BYTES = 4 << 20


class EliasFano:
    """A list of growing integers: the low bits of each side by side, the high ones as
    gaps in unary; every 256th mark has its place noted."""

    STEP = 256

    def __init__(self, n: int, low_bits: int, marks: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.low_bits, self.marks, self.low, self.high = n, low_bits, marks, low, high

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        low_bits = max(0, (int(values[-1] + 1) // n).bit_length() - 1) if n else 0
        values = values.astype(np.int64)
        places = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        low = np.packbits((values[:, None] >> np.arange(low_bits) & 1).astype(np.uint8).ravel(), bitorder="little")
        return cls(n, low_bits, places[:: cls.STEP].astype(np.int64), low, np.packbits(bits, bitorder="little"))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        mark = int(self.marks[i // self.STEP])
        to = int(self.marks[i // self.STEP + 1]) if i // self.STEP + 1 < len(self.marks) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[mark >> 3 : (to >> 3) + 1], bitorder="little"))
        first = int(np.searchsorted(ones, mark & 7))
        place = int(ones[first + i % self.STEP]) + (mark & ~7)
        bits = np.arange(i * self.low_bits, (i + 1) * self.low_bits)
        low = int(((self.low[bits >> 3] >> (bits & 7) & 1).astype(np.int64) << np.arange(self.low_bits)).sum())
        return place - i << self.low_bits | low

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.marks), len(self.low)) + self.marks.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, low_bits, marks, low = struct.unpack_from("<QBQQ", raw)
        at = struct.calcsize("<QBQQ")
        return cls(n, low_bits, np.frombuffer(raw, np.int64, marks, at), np.frombuffer(raw, np.uint8, low, at + 8 * marks), np.frombuffer(raw, np.uint8, -1, at + 8 * marks + low))


def boundaries(text: bytes) -> EliasFano:
    """Byte offsets at which the code points of a UTF-8 text begin, and its end."""
    raw = np.frombuffer(text, np.uint8)
    return EliasFano.of(np.r_[np.flatnonzero((raw & 0xC0) != 0x80), len(raw)])


def draws(name: str, seed: str) -> tuple[int, ...]:
    """Four draws of a document."""
    h = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24))


Made = tuple[int, str, int | None, int | None, bytes]


def transformed(name: str, text: bytes, cuts: EliasFano, seed: str = "1") -> Made:
    """(n, form, prefix_chars, middle_chars, output) of a document."""
    n = len(cuts) - 1
    h1, h2, h3, h4 = draws(name, seed)
    if not n or h3 % 100 >= TRANSFORMED or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y = cuts[a], cuts[b]
    prefix, middle, suffix = text[:x], text[x:y], text[y:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


MADE = "n long, form string, prefix_chars long, middle_chars long, output string"


def _made(ids: pa.Array, made: list[Made]) -> pa.RecordBatch:
    n, form, prefix, middle, output = zip(*made, strict=True) if made else ((),) * 5
    columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays([ids, *columns], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])


def in_place(rows: DataFrame, seed: str) -> DataFrame:
    """Documents (id, name, text) of which each is a group of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            yield _made(b.column("id"), [transformed(name, text, boundaries(text), seed) for name, text in zip(b.column("name").to_pylist(), utf8(b.column("text")), strict=True)])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {MADE}")


def references(rows: DataFrame) -> DataFrame:
    """From documents (id, name, h, text): a row (id, name, lane, h, digest) for each, and
    a row (h, digest, text) for each text that a task has met."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()  # 16 bytes for each
        lane = 0
        for b in slices(batches, "text", SLICE_BYTES):
            texts = utf8(b.column("text"))
            numbers: dict[bytes, int] = {}
            of = [numbers.setdefault(t, len(numbers)) for t in texts]
            digests = [hashlib.blake2b(t, digest_size=16).digest() for t in numbers]
            own = [digests[i] for i in of]
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("name"), pa.array(range(lane, lane + n), pa.int64()), b.column("h"), pa.array(own, pa.binary()), pa.nulls(n, pa.string())], names=["id", "name", "lane", "h", "digest", "text"])
            lane += n
            first = {i: at for at, i in reversed(list(enumerate(of)))}
            new = [at for i, at in first.items() if digests[i] not in sent]
            sent.update(own)
            if new:
                at = pa.array(new)
                m = len(new)
                yield pa.RecordBatch.from_arrays([pa.nulls(m, b.schema.field("id").type), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), b.column("h").take(at), pa.array([own[i] for i in new], pa.binary()), pa.array([texts[i] for i in new], pa.binary()).cast(pa.string())], names=["id", "name", "lane", "h", "digest", "text"])

    return rows.mapInArrow(run, f"id {kind}, name string, lane long, h long, digest binary, text string")


def distinct_texts(found: DataFrame) -> DataFrame:
    """(h, digest, text, cuts): each content once, with the list of its boundaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, bytes] | None = None
        content = b""
        for b in slices(batches, "text", SLICE_BYTES):
            keep, cuts = [], []
            for at, (h, digest, text) in enumerate(zip(b.column("h").to_pylist(), b.column("digest").to_pylist(), utf8(b.column("text")), strict=True)):
                if (h, digest) != held:
                    held, content = (h, digest), text
                    keep.append(at)
                    cuts.append(boundaries(text).to_bytes())
                elif text != content:
                    raise ValueError("different texts have one hash and one digest")
            if keep:
                own = b.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cuts, pa.binary())], names=["h", "digest", "text", "cuts"])

    met = found.where("text IS NOT NULL").select("h", "digest", "text").repartition("h", "digest").sortWithinPartitions("h", "digest")
    return met.mapInArrow(run, "h long, digest binary, text string, cuts binary")


def selected(joined: DataFrame, seed: str) -> DataFrame:
    """Documents (id, name) beside their text and its list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            yield _made(b.column("id"), [transformed(name, text, EliasFano.from_bytes(cuts), seed) for name, text, cuts in zip(b.column("name").to_pylist(), utf8(b.column("text")), b.column("cuts").to_pylist(), strict=True)])

    return joined.mapInArrow(run, f"id {joined.schema['id'].dataType.simpleString()}, {MADE}")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", least_share: int = LEAST_SHARE) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for each row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("rows"))
    met = materialise(counts.where("rows > 1").unionByName(counts.agg(F.lit(None).cast("long").alias("h"), F.sum("rows").alias("rows"))))
    total = met.where("h IS NULL").first()["rows"] or 0
    repeated = met.where("h IS NOT NULL")
    share = max(least_share, -(-total // SHARES))
    hot = F.broadcast(repeated.where(F.col("rows") > share).select("h", F.ceil(F.col("rows") / share).cast("int").alias("parts")))  # SHARES rows at most
    marked = spark.sparkContext.broadcast(bitmap_of(repeated, "h"))
    alone, copies = (sieved(rows, "h", marked, wanted) for wanted in (False, True))
    found = materialise(references(copies))
    of = found.where("text IS NULL").join(hot, "h", "left").selectExpr("id", "name", "h", "digest", "cast(pmod(lane, coalesce(parts, 1)) AS int) AS part")
    index = distinct_texts(found).join(hot, "h", "left").withColumn("part", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)"))).drop("parts")
    made = in_place(alone, seed).unionByName(selected(of.join(index, ["h", "digest", "part"]).select("id", "name", "text", "cuts"), seed))
    return made.withColumnRenamed("id", id_col)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from, by its sentinels."""
    out = {"out": output, "f": form, "p": PREFIX.decode(), "s": SUFFIX.decode(), "m": MIDDLE.decode()}
    last = "substring({out}, instr({out}, '{m}') + 3)"
    psm = "concat(substring({out}, 4, instr({out}, '{s}') - 4), " + last + ", substring({out}, instr({out}, '{s}') + 3, instr({out}, '{m}') - instr({out}, '{s}') - 3))"
    spm = "concat(substring({out}, instr({out}, '{p}') + 3, instr({out}, '{m}') - instr({out}, '{p}') - 3), " + last + ", substring({out}, 4, instr({out}, '{p}') - 4))"
    return F.expr(f"CASE {{f}} WHEN 'psm' THEN {psm} WHEN 'spm' THEN {spm} ELSE {{out}} END".format(**out))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


ORACLE = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, left(t, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM g"""
