"""Packing: documents in order, cut into sequences of at most `length` ids by dynamic programming.

The ids of all documents (each followed by an end id) in ascending order of doc_id form one line. It may be cut at a
document's end for nothing, at a sentence's end for `SENTENCE_FEE`, and, where none is near, every `STEP` ids for
`INSIDE_FEE`. A sequence of another length than a power of two is padded to `length`. With cuts at a[0] < a[1] < ...
the cheapest way to end a sequence at a[i] is

    best[i] = fee[i] + min(min over j with a[i] - a[j] <= length of best[j] + a[j], minus a[i], plus length;
                           best[j] where a[i] - a[j] is a power of two)

The inner minimum runs over a window that only moves right, so a monotone queue gives it in constant time; places that
are a power of two apart are looked up. Order stays: sequences follow each other as documents do.

Documents are dealt to tasks by ranges of (doc_id, hash of the text). A task packs stretches of about `STRETCH` ids: the
last sequences of one, which another end would change, are left to the next, so a task holds a stretch and one document
and only a range's last sequence is short. Fees and padding are a sum that the cuts of a stretch make least.

Null text counts as empty: its only id is the end id. Rows without doc_id come first. Repeated rows are packed once each.
A very long text is cut like any other. An empty table gives no row. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import batch_bytes, release, slices, table
from strata.llm.token_files import default_path, encoder

LENGTH, END = 4096, 2
SENTENCE_FEE, INSIDE_FEE, STEP = 8, 64, 64
STRETCH = 1 << 19
#: A token that ends a sentence.
STOP = re.compile(r"[.!?]+[\"')\]]*</w>")


def cuts(at: np.ndarray, fee: np.ndarray, length: int) -> np.ndarray:
    """Places in `at` (ascending, the first is the beginning, the last the end) of the cuts that cost least."""
    n = len(at)
    near = [(np.searchsorted(at, at + (1 << p)), 1 << p) for p in range(length.bit_length()) if 1 << p <= length]
    pairs = [(i[ok], np.flatnonzero(ok)) for i, p in near for ok in [(i < n) & (at[np.minimum(i, n - 1)] == at + p)]]
    to, come = (np.concatenate(x) for x in zip(*pairs))
    order = np.argsort(to, kind="stable")
    come, first = come[order].tolist(), np.searchsorted(to[order], np.arange(n + 1)).tolist()
    place, cost = at.tolist(), fee.tolist()
    best, via, key = [0] * n, [0] * n, [0] * n
    key[0] = place[0]
    queue: deque[int] = deque()
    for i in range(1, n):
        while queue and key[queue[-1]] > key[i - 1]:
            queue.pop()
        queue.append(i - 1)
        a = place[i]
        while place[queue[0]] < a - length:
            queue.popleft()
        j = queue[0]
        least = key[j] - a + length
        for k in come[first[i] : first[i + 1]]:
            if best[k] <= least:
                least, j = best[k], k
        best[i], via[i] = least + cost[i], j
        key[i] = best[i] + a
    out, i = [], n - 1
    while i > 0:
        out.append(i)
        i = via[i]
    return np.array([0, *out[::-1]])


def places(stop: np.ndarray, ends: np.ndarray, length: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where a line may be cut, and the fee for it. stop: sentences' ends; ends: documents' ends; last: nothing follows."""
    n, step = int(ends[-1]), min(STEP, length)
    sure = np.union1d(np.flatnonzero(stop) + 1, ends)
    gaps = np.flatnonzero(np.diff(np.concatenate([[0], sure])) > step)
    inner = [np.arange(a + step, b, step) for a, b in zip(np.concatenate([[0], sure])[gaps].tolist(), sure[gaps].tolist())]
    tail = np.arange(n - step, max(0, n - 2 * length), -step) if last else np.zeros(0, np.int64)
    at = np.unique(np.concatenate([[0, n], sure, tail, *inner]).astype(np.int64))
    fee = np.full(len(at), INSIDE_FEE, np.int64)
    fee[np.searchsorted(at, sure)] = SENTENCE_FEE
    fee[np.searchsorted(at, ends)] = 0
    fee[0] = 0
    return at, fee


@lru_cache(maxsize=2)
def _stops(path: str) -> np.ndarray:
    """Whether an id ends a sentence."""
    names = encoder(path).tokenizer.get_vocab()
    out = np.zeros(max(names.values(), default=0) + 2, bool)
    out[[i for t, i in names.items() if STOP.fullmatch(t)]] = True
    return out


class Line:
    """Ids of documents that aren't packed yet, the first of which may have lost a part already."""

    def __init__(self, length: int):
        self.length, self.number = length, 0
        self.names, self.texts = [], []
        self.ids, self.stop = [np.zeros(0, np.uint32)], [np.zeros(0, bool)]
        self.counts, self.skip, self.total, self.size = [], [], [], 0

    def add(self, names: pa.Array, ids: np.ndarray, counts: np.ndarray, stops: np.ndarray) -> None:
        self.names.append(names)
        self.ids.append(ids)
        self.stop.append(stops[np.minimum(ids, len(stops) - 1)])
        self.counts.append(counts)
        self.skip.append(np.zeros(len(counts), np.int64))
        self.total.append(counts)
        self.size += len(ids)

    def pack(self, last: bool) -> Iterator[pa.RecordBatch]:
        """Pieces of what can be packed now; of all there is, if nothing follows."""
        if not self.size:
            return
        names, ids, stop, counts, skip, total = (x[0] if len(x) == 1 else pa.concat_arrays(x) if isinstance(x[0], pa.Array) else np.concatenate(x) for x in (self.names, self.ids, self.stop, self.counts, self.skip, self.total))
        ends = np.cumsum(counts)
        at, fee = places(stop, ends, self.length, last)
        cut = at[cuts(at, fee, self.length)]
        if not last:
            cut = cut[cut <= self.size - 2 * self.length]
        done = int(cut[-1])
        starts = ends - counts
        begin = np.union1d(cut[:-1], starts[starts < done])
        long = np.diff(np.append(begin, done))
        doc, seq = np.searchsorted(ends, begin, "right"), np.searchsorted(cut, begin, "right") - 1
        raw_ids = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((np.append(begin, done) * 4).astype(np.int32).tobytes()), pa.py_buffer(ids[:done].astype("<u4").tobytes())])
        columns = [names.take(pa.array(doc)), pa.array(begin - starts[doc] + skip[doc]), pa.array(long), raw_ids, pa.array(total[doc]), pa.array(self.number + seq), pa.array(begin - cut[seq])]
        if len(begin):
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        self.number += len(cut) - 1
        left = int(np.searchsorted(ends, done, "right"))
        counts, skip = counts[left:].copy(), skip[left:].copy()
        if len(counts):
            used = done - int(starts[left])
            counts[0] -= used
            skip[0] += used
        self.names, self.ids, self.stop = [names.slice(left)], [ids[done:].copy()], [stop[done:].copy()]
        self.counts, self.skip, self.total, self.size = [counts], [skip], [total[left:]], self.size - done


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, stretch: int = STRETCH, ranges: int | None = None) -> DataFrame:
    """doc_id, start, length, ids (binary: little-endian uint32), doc_tokens, sequence_id, offset: one row per piece.

    Sequence numbers ascend with doc_id; those of one range follow each other without gaps.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    batch_bytes(docs.sparkSession, "32m")
    kind, arrow = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)
    ranges = ranges or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        line, coder, stops = Line(length), encoder(tokenizer), _stops(tokenizer)
        line.number = TaskContext.get().partitionId() << 32
        for b in (x for batch in batches for x in slices(batch, 1, 8 << 20)):
            ids, counts = coder.encode(b.column(1), end)
            line.add(b.column(0).cast(arrow), ids, counts, stops)
            if line.size >= max(stretch, 4 * length):
                yield from line.pack(False)
        yield from line.pack(True)
        release()

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(ranges, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return dealt.mapInArrow(packed, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def sequences(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """sequence_id, ids (binary), n_tokens, padding, doc_ids and starts (offsets of its documents): one row per sequence."""
    own = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("all"))  # at most `length` pieces
    ids = F.aggregate("all.ids", F.lit(b""), lambda a, x: F.concat(a, x))
    n = F.length("ids") / 4
    whole = F.bit_count(n.cast("long")) == 1
    rows = own.select("sequence_id", ids.alias("ids"), F.col("all.doc_id").alias("doc_ids"), F.col("all.offset").alias("starts"))
    return rows.select("sequence_id", "ids", n.cast("long").alias("n_tokens"), F.when(whole, 0).otherwise(length - n).cast("long").alias("padding"), "doc_ids", "starts")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return pack(docs, default_path()).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
