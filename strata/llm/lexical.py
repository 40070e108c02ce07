"""Ranked lexical search: every item's best documents by an integer score, with LEMP-style norm buckets.

A document is an impact vector over the terms of the items: (10^9 tf) div (1000 tf + 12 m) in every term it has. An
item is a vector of term weights times their repeats, and the score is the inner product of both. Documents are
ordered by the length (Euclidean norm) of their vectors and dealt to tasks and buckets in that order. A bucket whose
longest vector times the item's length (Cauchy-Schwarz) stays below the item's threshold is skipped. Inside a bucket
the item's heaviest terms are its focus: enough of them that the other terms alone can't reach the threshold. Only
documents with a focus term are looked at, and one of them survives if its part in the focus plus the product of what
both vectors have left outside reaches the threshold. Survivors are scored anew in 64-bit integers. Thresholds begin
as the k-th best score among the longest vectors, which are scored first, and grow inside each task. Bounds are doubles
with a margin above their rounding, and a document that ties with the threshold is kept, so nothing is lost.

Items come to the driver in blocks of `BLOCK_CHARS` characters (a longer item is a block by itself); a block's terms,
weights and thresholds are what tasks get. Each block is one pass over the documents' texts.

A null text has no term; an item without terms, or whose terms no document has, gets no row. Repeated rows are
documents (or items) of their own. Equal scores are ranked by ascending doc_id, null last; among rows of one doc_id the
order is arbitrary. No documents or no items give no rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import batch_bytes, raw, release, slices, stored, table

TOP = 20
#: Characters of the items that are searched in one pass, and longest vectors (about) that give the first thresholds.
BLOCK_CHARS, SEEDS = 4 << 20, 4096
#: Above the relative rounding error of a bound.
MARGIN = 1 + 1e-9

#: What a byte of UTF-8 becomes: A-Z in lower case, ASCII other than letters and digits as a blank, others as they are.
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[65:91] += 32
_BYTES[[*range(48), *range(58, 65), *range(91, 97), *range(123, 128)]] = 32


def terms(texts: pa.Array) -> pa.ListArray:
    """Terms of each text, with empty ones between them; null has none."""
    data, offsets = raw(texts)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(_BYTES[data].tobytes()))
    return pc.split_pattern(plain, " ")


def vectors(docs: DataFrame, known: pa.Array) -> DataFrame:
    """doc_id, n (terms with repeats), at (int32 places in `known`) and tf (int32) of the documents with a term."""
    batch_bytes(docs.sparkSession, "8m")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch, 1)):
            split = terms(b.column(1))
            flat, starts = split.flatten(), np.asarray(split.offsets, np.int64)
            doc = np.repeat(np.arange(b.num_rows), np.diff(starts))
            n = np.bincount(doc[np.asarray(pc.not_equal(flat, ""))], minlength=b.num_rows)
            place = np.asarray(pc.index_in(flat, value_set=known).fill_null(-1), np.int64)
            pair, tf = np.unique(doc[place >= 0] * len(known) + place[place >= 0], return_counts=True)
            ends = np.searchsorted(pair, np.arange(b.num_rows + 1) * len(known)) * 4
            packed = [pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(x.astype("<i4").tobytes())]) for x in (pair % len(known), tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *packed], ["doc_id", "n", "at", "tf"]).filter(pa.array(n > 0))
        release()

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(count, f"doc_id {kind}, n bigint, at binary, tf binary")


def frequencies(found: DataFrame, size: int) -> np.ndarray:
    """How many documents have each term: counted in every task first."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(raw(b.column(0))[0], "<i4"), minlength=size)
        (at,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["at", "df"])

    out = np.zeros(size, np.int64)
    for r in found.select("at").mapInArrow(each, "at int, df bigint").groupBy("at").agg(F.sum("df").alias("df")).toLocalIterator():  # a row per term of the block
        out[r["at"]] = r["df"]
    return out


def impacts(found: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """doc_id, norm, at, v (int32): impact vectors and their lengths; documents with no impact are left out."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, ends = raw(b.column(3))
            tf, per = np.frombuffer(data, "<i4").astype(np.int64), np.diff(ends) // 4
            m = 75 + (25 * np.asarray(b.column(1), np.int64) * n_docs) // n_terms
            v = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, per))
            square = np.bincount(np.repeat(np.arange(b.num_rows), per), v.astype(np.float64) ** 2, b.num_rows)
            v32 = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(v.astype("<i4").tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.sqrt(square)), b.column(2), v32], ["doc_id", "norm", "at", "v"]).filter(pa.array(square > 0))

    return found.mapInArrow(each, f"doc_id {kind}, norm double, at binary, v binary")


class Queries:
    """A block's items as weight vectors, heaviest terms first, with the length of what is left after each."""

    def __init__(self, wanted: list[Counter], weight: np.ndarray, k: int):
        self.size, self.k, self.items = len(weight), k, []
        for some in wanted:
            at = np.fromiter(some.keys(), np.int64, len(some))
            w = weight[at] * np.fromiter(some.values(), np.int64, len(some))
            order = np.lexsort((at, -w))
            order = order[w[order] > 0]
            left = np.sqrt(np.cumsum(w[order][::-1].astype(np.float64) ** 2)[::-1])
            self.items.append((at[order], w[order], np.append(left, 0.0)))


class Bucket:
    """Impact vectors of about one length: by document, and by term."""

    def __init__(self, norm: np.ndarray, at: np.ndarray, v: np.ndarray, ends: np.ndarray, size: int):
        self.norm, self.at, self.v, self.ends = norm, at, v, ends
        order = np.argsort(at, kind="stable")
        self.doc, self.value = np.repeat(np.arange(len(norm)), np.diff(ends))[order], v[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=size))])
        self.longest = float(norm.max(initial=0.0)) * MARGIN

    def survivors(self, item: tuple[np.ndarray, np.ndarray, np.ndarray], least: int) -> np.ndarray:
        """Documents that may score `least` or more."""
        at, w, left = item
        reach = left * self.longest
        if reach[0] < least:
            return np.zeros(0, np.int64)  # Cauchy-Schwarz, for all of the bucket
        focus = int(np.argmax(reach < max(least, 1)))
        spans = [slice(self.start[t], self.start[t + 1]) for t in at[:focus]]
        doc = np.concatenate([self.doc[s] for s in spans])
        value = np.concatenate([self.value[s] for s in spans]).astype(np.float64)
        weight = np.repeat(w[:focus].astype(np.float64), [s.stop - s.start for s in spans])
        part = np.bincount(doc, weight * value, len(self.norm))
        rest = np.maximum(self.norm**2 * MARGIN - np.bincount(doc, value * value, len(self.norm)), 0.0)
        return np.flatnonzero((part > 0) & ((part + left[focus] * np.sqrt(rest)) * MARGIN >= least))

    def scores(self, item: tuple[np.ndarray, np.ndarray, np.ndarray], docs: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact scores of documents; dense: zeros, one for each term, left as they were."""
        begin, many = self.ends[docs], self.ends[docs + 1] - self.ends[docs]
        total = np.cumsum(many)
        places = np.arange(total[-1]) + np.repeat(begin - (total - many), many)
        dense[item[0]] = item[1]
        out = np.add.reduceat(dense[self.at[places]] * self.v[places], total - many)
        dense[item[0]] = 0
        return out


def _find(batches: Iterator[pa.RecordBatch], queries: Queries, least: np.ndarray, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """item, doc_id, score of a task's best documents of every item, none of which scores below `least`."""
    least, dense = least.copy(), np.zeros(queries.size, np.int64)
    best: list[tuple[np.ndarray, pa.Array]] = [(np.zeros(0, np.int64), pa.array([], kind)) for _ in queries.items]
    for b in batches:
        (at, ends), (v, _) = raw(b.column(2)), raw(b.column(3))
        bucket = Bucket(np.asarray(b.column(1)), np.frombuffer(at, "<i4").astype(np.int64), np.frombuffer(v, "<i4").astype(np.int64), ends // 4, queries.size)
        for i, item in enumerate(queries.items):
            if not len(item[0]) or not len(docs := bucket.survivors(item, int(least[i]))):
                continue
            score = bucket.scores(item, docs, dense)
            good = np.flatnonzero(score >= max(1, least[i]))
            if not len(good):
                continue
            found, held = score[good], best[i]
            ids = pa.concat_arrays([held[1], b.column(0).take(pa.array(docs[good]))])
            both = pa.table({"s": np.concatenate([held[0], found]), "d": ids})
            top = pc.sort_indices(both, sort_keys=[("s", "descending"), ("d", "ascending")])[: queries.k]
            best[i] = (np.asarray(both["s"].combine_chunks().take(top)), ids.take(top))
            if len(top) == queries.k:
                least[i] = max(int(least[i]), int(best[i][0][-1]))
    for i, (score, ids) in enumerate(best):
        if len(score):
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(score), pa.int32()), ids, pa.array(score)], ["item", "doc_id", "score"])
    release()


def _ranked(rows: DataFrame, queries: Queries, least: np.ndarray) -> DataFrame:
    """item, rank, doc_id, score: the best of all tasks' best."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind, name = to_arrow_type(rows.schema["doc_id"].dataType), rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(lambda batches: _find(batches, queries, least, kind), f"item int, doc_id {name}, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= queries.k).select("item", "rank", "doc_id", "score")


def _blocks(items: DataFrame, most: int) -> Iterator[list]:
    """Rows of the items, in runs of about `most` characters; the driver holds one run at a time."""
    held, size = [], 0
    for r in items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").toLocalIterator():
        held.append(r)
        size += len(r["text"]) + 1
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_chars: int = BLOCK_CHARS, seeds: int = SEEDS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of every item (item_id, text)."""
    spark = docs.sparkSession
    name = items.schema["item_id"].dataType.simpleString()
    parts = [spark.createDataFrame([], f"item_id {name}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint")]
    for block in _blocks(items, block_chars):
        wanted = [[t for t in x if t] for x in terms(pa.array([r["text"] for r in block], pa.string())).to_pylist()]
        known = sorted({t for x in wanted for t in x})
        if not known:
            continue
        place = {t: i for i, t in enumerate(known)}
        found = stored(vectors(docs, pa.array(known, pa.large_string())))
        n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        df = frequencies(found, len(known))
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        queries = Queries([Counter(place[t] for t in x) for x in wanted], weight, k)
        rows = impacts(found, n_docs, n_terms)
        least = np.ones(len(block), np.int64)
        if n_docs > seeds:
            long = rows.agg(F.percentile_approx("norm", 1 - seeds / n_docs)).first()[0]
            if long is not None:
                for r in _ranked(rows.where(F.col("norm") >= long), queries, least).where(F.col("rank") == k).collect():  # a row per item of the block
                    least[r["item"]] = max(1, r["score"])
        dealt = rows.repartitionByRange(F.desc("norm"), F.xxhash64("doc_id")).sortWithinPartitions(F.desc("norm"))
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"item int, item_id {name}")
        parts.append(_ranked(dealt, queries, least).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, parts)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return search(docs, table(spark, sf_dir, "benchmark"))


ORACLE = r"""
with d as (select doc_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) as t from documents),
b as (select item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) as t from benchmark),
q as (select item_id, t, count(*) as times from b group by all),
size as (select doc_id, count(*) as n from d group by doc_id),
total as (select count(*) as nn, cast(sum(n) as bigint) as ll from size),
tf as (select doc_id, t, count(*) as tf from d semi join q using (t) group by all),
w as (select t, cast(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) as bigint) as w from tf, total group by t, nn),
v as (select doc_id, t, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)) as v from tf join size using (doc_id), total),
s as (select item_id, doc_id, cast(sum(times * w * v) as bigint) as score from q join w using (t) join v using (t) group by all)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from s where score > 0
qualify rank <= 20
"""
