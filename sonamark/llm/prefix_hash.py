"""Document fingerprints from prefix polynomial hashes.

P[i] is the sum of (code point + 1) * base**j over j < i, modulo the prime 2**31 - 1, for two bases. With these arrays the hash of any span
is (P[j] - P[i]) * base**-i, so two spans of any two texts are compared in constant time (to one chance in 2**61 or so), and
the longest common extension from two positions is found by binary search over its length.

A fingerprint holds the length, the hash of the whole text, the hashes of its prefixes at up to GRID multiples of a power of two,
and the SKETCH smallest hashes among all its spans of SPAN code points. Two fingerprints give a likeness without the texts:
the larger of the Dice share of spans, estimated from the smallest hashes, and of the common prefix found by binary search
over the common grid. Equal texts have equal fingerprints, and likeness 1.

Nulls count as the empty text; two empty texts are alike (1), an empty and another are not (0). Null ids come after all others
in descending order; repeated ids are ordered by a hash of the text. A table of one row is its own next row. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

PRIME, BASES = (1 << 31) - 1, (1_103_515_245, 1_220_703_125)
SPAN, SKETCH, GRID = 16, 64, 32
U = np.uint64
M, S = U(PRIME), U(31)
LEAST = -(1 << 63)


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, for any x below 2**64: no division."""
    x = (x & M) + (x >> S)
    x = (x & M) + (x >> S)
    x = (x & M) + (x >> S)
    return np.where(x == M, U(0), x)


class Powers:
    """base**j and base**-j, doubled as longer texts come."""

    def __init__(self, base: int):
        self.bases = [base, pow(base, -1, PRIME)]
        self.tables = [np.ones(1, U), np.ones(1, U)]

    def upto(self, n: int) -> list[np.ndarray]:
        while len(self.tables[0]) < n:
            step = len(self.tables[0])
            self.tables = [np.concatenate((t, reduced(t * U(pow(b, step, PRIME))))) for b, t in zip(self.bases, self.tables)]
        return self.tables


powers = [Powers(b) for b in BASES]


class Prefixes:
    """The prefix arrays of one text."""

    def __init__(self, text: str):
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U) + U(1)
        self.n = len(c)
        self.p = [np.concatenate((np.zeros(1, U), reduced(np.cumsum(reduced(c * q.upto(self.n + 1)[0][: self.n]))))) for q in powers]

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """62-bit hashes of spans; equal spans have equal hashes, wherever they stand."""
        a, b = (reduced((p[stop] + M - p[start]) * q.upto(self.n + 1)[1][start]) for p, q in zip(self.p, powers))
        return (a << S) | b

    def span(self, start: int, stop: int) -> int:
        return int(self.spans(np.array([start]), np.array([stop]))[0])

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all spans of a size."""
        size = min(size, self.n)
        k = self.n - size + 1
        a, b = (reduced((p[size:] + M - p[:k]) * q.upto(self.n + 1)[1][:k]) for p, q in zip(self.p, powers))
        return (a << S) | b


def longest_common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """How many code points agree from position i of a and j of b on."""
    lo, hi = 0, min(a.n - i, b.n - j)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a.span(i, i + mid) == b.span(j, j + mid) else (lo, mid - 1)
    return lo


@dataclass(frozen=True)
class Fingerprint:
    n: int
    whole: int
    step: int
    grid: tuple[int, ...]  # 31-bit hashes of the prefixes of step, 2 * step, ... code points
    least: tuple[int, ...]  # the smallest span hashes, mixed to 32 bits

    def __str__(self) -> str:
        return f"{self.n:x}-{self.whole:016x}-{self.step:x}-{''.join(f'{x:08x}' for x in self.grid)}-{''.join(f'{x:08x}' for x in self.least)}"

    @classmethod
    def parse(cls, s: str) -> Fingerprint:
        n, whole, step, grid, least = s.split("-")
        cut = lambda x: tuple(int(x[i : i + 8], 16) for i in range(0, len(x), 8))
        return cls(int(n, 16), int(whole, 16), int(step, 16), cut(grid), cut(least))

    def likeness(self, other: Fingerprint) -> float:
        if self.n == other.n and self.whole == other.whole:
            return 1.0
        if not self.n or not other.n:
            return 0.0
        a, b = set(self.least), set(other.least)
        k = min(SKETCH, len(a | b))
        first = set(sorted(a | b)[:k])
        j = len(first & a & b) / k
        step = max(self.step, other.step)
        p, q = self.grid[step // self.step - 1 :: step // self.step], other.grid[step // other.step - 1 :: step // other.step]
        lo, hi = 0, min(len(p), len(q))
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if p[mid - 1] == q[mid - 1] else (lo, mid - 1)
        return max(2 * j / (1 + j), 2 * lo * step / (self.n + other.n))


def fingerprint(x: Prefixes) -> Fingerprint:
    step = 1
    while x.n // step > GRID:
        step *= 2
    grid = tuple(int(v) for v in x.p[0][step::step])
    h = x.windows(SPAN) if x.n else np.zeros(0, U)
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    h = (h >> U(32)).astype(np.uint32)
    take, least = 2 * SKETCH, np.zeros(0, np.uint32)
    while True:  # spans may repeat: take more of the smallest until enough are distinct
        least = np.unique(np.partition(h, take)[:take] if take < len(h) else h)
        if len(least) >= SKETCH or take >= len(h):
            break
        take *= 4
    return Fingerprint(x.n, x.span(0, x.n) if x.n else 0, step, grid, tuple(least[:SKETCH].tolist()))


def likeness(a: str, b: str) -> float:
    return Fingerprint.parse(a).likeness(Fingerprint.parse(b))


def beside_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, extra, id, text), partitioned and sorted so that each row is followed by the next row in descending id order, rows of one id in the order of a hash of the
    text. One shuffle of the texts: this order is cut into ranges, one for each partition, and the first row of a range is also sent, marked extra, to the end
    of the range before it (that of the first range to the end of the last). An id that many rows share lies in several ranges. Only numbers of ranges, not
    rows, come to the driver."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = lambda: (F.coalesce("id", F.lit(LEAST)).alias("key"), (-F.xxhash64("text").cast("decimal(20,0)")).alias("tie"))
    keys = rows.select(*order())
    cut = keys.repartitionByRange(parts, "key", "tie").withColumn("bucket", F.spark_partition_id())
    tops = sorted((r.bucket, r.top.key, r.top.tie) for r in cut.groupBy("bucket").agg(F.max(F.struct("key", "tie")).alias("top")).collect())  # a row for each range
    bounds = F.array(*(F.struct(F.lit(key).cast("long").alias("key"), F.lit(tie).cast("decimal(20,0)").alias("tie")) for _, key, tie in tops[:-1])) if len(tops) > 1 else F.array().cast("array<struct<key:bigint,tie:decimal(20,0)>>")
    own = rows.select("id", "text", *order())
    own = own.withColumn("bucket", F.size(F.filter(bounds, lambda top: top < F.struct("key", "tie"))))
    # The first row of a range, in descending order, is its top; of rows that agree in id and text any one is it.
    last = len(tops) - 1
    heads = spark.createDataFrame([(key, tie, k + 1 if k < last else 0, 1) for k, (_, key, tie) in enumerate(tops)], "key long, tie decimal(20,0), target int, extra int")
    copies = own.join(F.broadcast(heads), ["key", "tie"]).groupBy("key", "tie", "target", "extra").agg(F.first("id").alias("id"), F.first("text").alias("text"))
    every = own.select("bucket", F.lit(0).alias("extra"), "key", "tie", "id", "text").unionByName(copies.select(F.col("target").alias("bucket"), "extra", "key", "tie", "id", "text"))
    return every.repartitionById(max(1, len(tops)), F.col("bucket")).sortWithinPartitions("bucket", "extra", F.desc("key"), F.desc("tie")).select("bucket", "extra", "id", "text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and
    common_prefix: the longest common extension of the text and the edited text from their starts."""
    arrow_rows(docs.sparkSession)

    def run(batches):
        last = None  # the row that waits for the one after it
        for batch in batches:
            out = []
            for _, extra, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                own = Prefixes(text)
                mark = fingerprint(own)
                if last is not None:
                    was_id, was, was_own, was_mark = last
                    half = len(was) // 2
                    edited = was[: len(was) - half] + text[:half]
                    edited_own = Prefixes(edited)
                    edited_mark = fingerprint(edited_own)
                    out.append((was_id, len(was), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), str(was_mark), str(edited_mark), was_mark.likeness(edited_mark), was_mark.likeness(mark), longest_common_extension(was_own, 0, edited_own, 0)))
                last = None if extra else (doc_id, text, own, mark)
            columns = list(zip(*out)) or [()] * 8
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"
    return beside_next(docs, id_col, text_col).mapInArrow(run, schema)
