"""Byte-level BPE with public ranks: overlapping chunks are pre-tokenised apart and stitched.

Pre-tokenising reads left to right and never looks back, so two scans that share one boundary agree
from there on. A text longer than `chunk_chars` is cut into chunks that overlap by `overlap_chars`;
every chunk is scanned from its own start, and in the overlap the first boundary that both scans have
becomes the stitch. Shorter texts are one chunk. Where an overlap holds no common boundary (one
pre-token longer than the overlap) the document is scanned whole, which is exact too.

Null text counts as empty: no ids. Rows with equal ids stay apart, as each input row gets a key of its own. An empty table
gives no row. Other columns than the keys are left out, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import batch_bytes, release, slices, table

CHUNK_CHARS, OVERLAP_CHARS = 32_768, 1_024
#: Matches that end this close to the end of a slice may change with the text that follows.
TAIL = 8
#: Distinct pre-tokens kept by one Python worker; the store starts anew beyond it.
CACHE_PIECES = 150_000


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


class Codec:
    """Ranks, pattern and a bounded store of encoded pre-tokens; one per Python worker."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken

        ranks = _ranks(path)
        self.scan = regex.compile(public_tokenizers.PATTERN)
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.store: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """Ids of a text that starts and ends at a pre-token boundary, as little-endian uint32."""
        store, out = self.store, []
        for piece in self.scan.findall(text):
            if (known := store.get(piece)) is None:
                if len(store) >= CACHE_PIECES:
                    store.clear()
                known = store[piece] = np.array(self.bpe.encode_ordinary(piece), "<u4").tobytes()
            out.append(known)
        return b"".join(out)

    def rest(self) -> None:
        """Between tasks a worker holds no pre-tokens: the executor's memory is for all of its workers, idle ones too."""
        self.store.clear()
        release()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=1)
def bytes_of(path: str) -> dict[int, bytes]:
    """The bytes of every id."""
    return {i: b for b, i in _ranks(path).items()}


def stitch(scan, text: str, border: int) -> int | None:
    """First boundary at or after `border` shared by the scans from 0 and from `border`; None if the slice has none."""
    last = len(text) - TAIL
    own = {m.end() for m in scan.finditer(text) if border <= m.end() <= last}
    if border in own:
        return border
    return next((m.end() for m in scan.finditer(text, border) if m.end() in own), None)


def encode(docs: DataFrame, path: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",), chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """`keys` and ids (binary: little-endian uint32), one row per input row; other columns aren't carried."""
    batch_bytes(docs.sparkSession, "4m")
    docs = docs.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys), "ids binary"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in (x for batch in batches for x in slices(batch, len(keys))):
            ids = pa.array([c.ids(x.as_py()) for x in b.column(len(keys))], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], ids], [*keys, "ids"])
        c.rest()

    long = F.length("_text") > chunk_chars
    short_ids = docs.where(~long).mapInArrow(whole, schema)
    many = docs.where(long).select(F.struct(*keys).alias("_key"), F.xxhash64("_text").alias("_h"), F.monotonically_increasing_id().alias("_row"), "_text")
    kind = many.schema["_key"].dataType.simpleString()

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = b.column(3)[i].as_py()
                starts = range(0, len(x), chunk_chars)
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([b.column(0).slice(i, 1)] * n), pa.concat_arrays([b.column(1).slice(i, 1)] * n), pa.concat_arrays([b.column(2).slice(i, 1)] * n), pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32()), pa.array([x[s : s + chunk_chars + overlap_chars] for s in starts], pa.string())],
                    ["_key", "_h", "_row", "_k", "_n", "_part"],
                )

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            k, n, part = (b.column(i).to_pylist() for i in (3, 4, 5))
            to = [len(p) if i + 1 == m else -1 if (s := stitch(c.scan, p, chunk_chars)) is None else s for i, m, p in zip(k, n, part)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to, pa.int32())], [*b.schema.names, "_to"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            part, to, start, ok = (b.column(i).to_pylist() for i in (5, 6, 7, 8))
            ids = [c.ids(p[s:t]) if o else b"" for p, s, t, o in zip(part, start, to, ok)]
            over = [None if o else p[:chunk_chars] for p, o in zip(part, ok)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(ids, pa.binary()), pa.array(over, pa.string())], [*b.schema.names[:5], "_ids", "_over"])
        c.rest()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            out = [c.ids("".join(t)) if t else b"".join(i) for i, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["_key", "_ids"])
        c.rest()

    head = f"_key {kind}, _h bigint, _row bigint, _k int, _n int"
    chunks = many.mapInArrow(cuts, f"{head}, _part string").repartition("_h", "_row", "_k").mapInArrow(borders, f"{head}, _part string, _to int")
    doc = Window.partitionBy("_h", "_row")
    chunks = chunks.withColumns({"_start": F.coalesce(F.lag("_to").over(doc.orderBy("_k")) - chunk_chars, F.lit(0)), "_ok": F.min("_to").over(doc) >= 0})
    pieces = chunks.mapInArrow(parts, f"{head}, _ids binary, _over string")
    # one document's own pieces, in order: no larger than that document
    own = pieces.groupBy("_h", "_row").agg(F.first("_key").alias("_key"), F.array_sort(F.collect_list(F.struct("_k", "_ids", "_over"))).alias("_all"))
    own = own.select("_key", F.col("_all._ids").alias("_ids"), F.filter("_all._over", lambda x: x.isNotNull()).alias("_over"))
    return short_ids.unionByName(own.mapInArrow(joined, f"_key {kind}, _ids binary").select("_key.*", F.col("_ids").alias("ids")))


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns and `out`: the ids' bytes concatenated (binary, UTF-8 where the ids came from a text). Null ids give null."""

    @F.arrow_udf("binary")
    def back(column: pa.Array) -> pa.Array:
        known = bytes_of(path).__getitem__
        out = pa.array([None if x is None else b"".join(map(known, np.frombuffer(x, "<u4").tolist())) for x in column.to_pylist()], pa.binary())
        release()
        return out

    return encoded.withColumn(out, back(F.col(ids)))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_path()
    return decode(encode(table(spark, sf_dir, "documents"), path), path).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
