"""Document fingerprints from prefix polynomial hashes.

A text's code points c0, c1, ... give two prefix arrays P[i] = sum of (c[j] + 1) * B^j modulo 2^31 - 1, j < i.
A span's hash is (P[end] - P[start]) / B^start, so any two spans compare in constant time and the longest
common extension of two positions is found by binary search.

Fingerprint: code points, both whole-text hashes, then the `SKETCH` smallest distinct mixed hashes of all spans
of `SPAN` code points (a shorter text is one span), in hex. Likeness: 1 for equal fingerprints, else the
bottom-k Jaccard estimate of the two span sets. Null text counts as empty; two empty texts are alike (1),
an empty and another text are not (0). Repeated rows follow each other, each with its own row of the result; an empty table
gives none; other columns are left out, whatever their names.

`with_next` gives each row its successor by (doc_id, text); the last one's is the first. Rows are dealt to
ranges of doc_id whose lower ends are actual ids; the rows at a lower end are also dealt, as guests, to the
range before. So each range finds its successors alone, while rows stream through in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import table

#: 2^31 - 1: folding the high bits replaces a division. Two bases make two independent hashes.
PRIME, BASES = (1 << 31) - 1, (1_103_515_245, 1_566_083_941)
SPAN, SKETCH = 24, 32


@lru_cache(maxsize=8)
def _powers(k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """B^0 .. B^(2^bits) of the k-th base, and their inverses."""

    def up(b: int) -> np.ndarray:
        out = np.ones(1, np.int64)
        while len(out) <= 1 << bits:
            out = np.concatenate([out, out * pow(b, len(out), PRIME) % PRIME])
        return out[: (1 << bits) + 1]

    return up(BASES[k]), up(pow(BASES[k], -1, PRIME))


def powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(k, max(12, int(n).bit_length()))


def fold(x: np.ndarray) -> np.ndarray:
    """Congruent to x and below 2^32, for 0 <= x < 2^62."""
    y = x >> 31
    x = x & PRIME
    x += y
    return x


def mod(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, 0 <= x < 2^62."""
    x = fold(fold(x))
    np.subtract(x, PRIME, out=x, where=x >= PRIME)
    return x


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Prefix:
    """Prefix arrays of one text; with `like` and `keep`, those of like's first `keep` code points and then `text`."""

    def __init__(self, text: str, like: Prefix | None = None, keep: int = 0):
        c = code_points(text) + np.int64(1)
        self.n, self.p = keep + len(c), []
        for k in range(2):
            own = np.empty(self.n + 1, np.int64)
            own[: keep + 1] = like.p[k][: keep + 1] if like else 0
            c_k = fold(c * powers(k, self.n)[0][keep : self.n])
            np.cumsum(c_k, out=c_k)
            c_k += own[keep]
            own[keep + 1 :] = mod(c_k)
            self.p.append(own)

    def spans(self, start: np.ndarray, end: np.ndarray, k: int = 0) -> np.ndarray:
        """Hashes of [start, end) in the k-th base."""
        d = self.p[k][end] - self.p[k][start]
        return mod((d + PRIME * (d < 0)) * powers(k, self.n)[1][start])

    def equal(self, other: Prefix, i: int, j: int, n: int) -> bool:
        """Whether n code points from i here and from j there are the same."""
        for k in range(2):
            up = powers(k, max(self.n, other.n))[0]
            a, b = int(self.p[k][i + n]) - int(self.p[k][i]), int(other.p[k][j + n]) - int(other.p[k][j])
            if (a * int(up[j]) - b * int(up[i])) % PRIME:
                return False
        return True

    def extension(self, other: Prefix, i: int, j: int) -> int:
        """Length of the longest common extension of self from i and other from j."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(other, i, j, mid) else (low, mid - 1)
        return low

    def suffix(self, other: Prefix) -> int:
        """Length of the longest common suffix."""
        low, high = 0, min(self.n, other.n)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(other, self.n - mid, other.n - mid, mid) else (low, mid - 1)
        return low

    def sketch(self) -> np.ndarray:
        """The smallest distinct mixed hashes of all spans."""
        if not self.n:
            return np.zeros(0, np.int64)
        w = min(SPAN, self.n)
        x = self.p[0][w:] - self.p[0][:-w]
        np.add(x, PRIME, out=x, where=x < 0)
        x *= powers(0, self.n)[1][: len(x)]
        h = mod(x)
        h ^= h >> 15
        h = mod(h * 0x5BD1E995)
        least = np.unique(h[h < PRIME // len(h) * 4 * SKETCH])  # where too few distinct ones are that small, all are sorted
        return least[:SKETCH] if len(least) >= SKETCH else np.unique(h)[:SKETCH]

    def fingerprint(self) -> str:
        whole = [int(p[-1]) for p in self.p]
        return f"{self.n:x}:{whole[0]:08x}{whole[1]:08x}:" + "".join(f"{x:08x}" for x in self.sketch().tolist())


def likeness(a: str, b: str) -> float:
    """0 to 1 from two fingerprints alone."""
    if a == b:
        return 1.0
    x, y = ({t[i : i + 8] for i in range(0, len(t), 8)} for t in (a.rsplit(":", 1)[1], b.rsplit(":", 1)[1]))
    least = sorted(x | y)[:SKETCH]
    return sum(t in x and t in y for t in least) / len(least) if x and y else 0.0


def _range_of(value: Column, ends: list[int]) -> Column:
    """Number of the last of the ascending ends that isn't above the value: a part by its first end, then the end in the part."""
    step = max(1, round(len(ends) ** 0.5))
    parts = [ends[i : i + step] for i in range(0, len(ends), step)]
    below = lambda x: F.size(F.filter(x, lambda e: e <= value))
    nth = below(F.array(*(F.lit(p[0]) for p in parts)))
    own = F.element_at(F.array(*(F.array(*map(F.lit, p)) for p in parts)), nth)
    return (nth - 1) * step + below(own) - 1


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id and text with bucket, guest: every row in its own range, and the lower end's rows in the range before.

    Rows without doc_id come first. The number of ranges follows spark.sql.shuffle.partitions.
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    got = docs.agg(F.percentile_approx("_id", [i / ranges for i in range(ranges)], 10_000).alias("q"), F.min("_id").alias("least")).first()
    ends = sorted({got.least, *(got.q or [])}) if got.least is not None else [0]
    found = _range_of(F.col("_id"), ends)
    before = F.when(F.col("_id").isin(ends), F.array(F.struct(F.col("_b").alias("bucket"), F.lit(0).alias("guest")), F.struct(F.pmod(F.col("_b") - 1, F.lit(len(ends))).alias("bucket"), F.lit(1).alias("guest"))))
    dealt = docs.withColumn("_b", found).select("_id", "doc_id", "text", F.inline(F.coalesce(before, F.array(F.struct(F.col("_b").alias("bucket"), F.lit(0).alias("guest"))))))
    return dealt.repartition(len(ends), "bucket").sortWithinPartitions("bucket", "guest", "_id", "text")


def _successors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, str]]:
    """(doc_id, text, next text) of rows sorted by bucket, guest, id and text; of the guests only the first counts."""
    last = None
    for b in batches:
        for bucket, guest, doc, text in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("bucket", "guest", "doc_id", "text"))):
            if last is not None and last[0] == bucket:
                yield last[1], last[2], text
                last = None
            if not guest:
                last = (bucket, doc, text)


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per document; common_prefix and common_suffix are the longest common extensions with the edited text."""
    schema = "doc_id long, n_chars long, edited binary, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long, common_suffix long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        rows: list[tuple] = []
        size, ready = 0, None
        for doc, text, after in _successors(batches):
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            own = ready[1] if ready and ready[0] == text else Prefix(text)
            nxt = Prefix(after)
            new = Prefix(after[:half], own, len(text) - half)
            a, b, c = (ready[2] if ready and ready[0] == text else own.fingerprint()), new.fingerprint(), nxt.fingerprint()
            ready = (after, nxt, c)
            rows.append((doc, own.n, edited.encode(), a, b, likeness(a, b), likeness(a, c), own.extension(new, 0, 0), own.suffix(new)))
            size += len(edited)
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    return with_next(docs, ranges).mapInArrow(run, schema)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints(table(spark, sf_dir, "documents"))
    return out.withColumn("edited", F.sha2("edited", 256)).withColumnRenamed("edited", "edited_sha256")
