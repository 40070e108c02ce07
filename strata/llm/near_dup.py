"""MinHash near-dedup: BagMinHash signatures, bands, and verification of the weighted Jaccard similarity.

Words have A-Z lower-cased; a shingle is five consecutive words (all words of a shorter text), counted with its
multiplicity. BagMinHash: a shingle of weight w owns Poisson processes on the weight intervals (0,1], (1,2],
(2,4], (4,8], ... up to w; each has the interval's width as its rate. A point has a register and a discrete
position, and counts if the position is at most w, so two texts share a point for the part of the weight they
share. A register keeps its earliest point. Points come in order of time, and times beyond which a register is
hardly ever still empty aren't generated (where one is, that text goes on until all are full).

1. Texts of one word sequence are one node from the start, by two 64-bit hashes (no words: by the text itself).
2. A node goes into `BANDS` buckets, by `ROWS` registers each. Two nodes are a candidate pair if they share a bucket
   and agree in `AGREE` registers; the pair belongs to the first bucket that it shares. A bucket of more than `BLOCK`
   members is dealt out as blocks. First, blocks are looked at by themselves: a small one names all its pairs, in a
   larger one each member names the one with most candidates (the hub) and its `BEST` most alike ones; then the hubs
   of a bucket's blocks meet in the same way. What is named is linear in the members.
3. Named pairs are verified exactly on their texts; links make connected components, the classes.
4. Buckets with more candidates go on, by pairs of blocks. Now most members are of a few classes: blocks hold one
   large class each, or the rest, and no block meets another one of its class. An exact bound leaves out what can't
   be a link: a text that is like no other yet shares with any text at most the weight of those of its shingles that
   other open texts have (`foreign`). What passes is named and verified, until nothing is open.

No candidate is dropped: it is verified, in one class already, or ruled out by the bound.

Null text: a class of its own. Empty texts are copies of each other, as are all texts without words that are equal.
Every row is a document by its own text: rows with one doc_id and different texts may be in different classes (which
then may have one class_id, as that is the smallest doc_id), and `deduplicate` keeps one row of each class. Rows without
doc_id take part; their class_id is null where no row of the class has one. Columns besides id and text don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import batch_bytes, blocks, cut, raw, release, table

SHINGLE, SIMILARITY = 5, 0.8
REGISTERS, BANDS, ROWS = 128, 16, 4
#: Registers that agree in a pair worth verifying: three standard deviations below what the similarity gives.
AGREE = 89
#: Blocks of up to SMALL members name all candidates at once; in larger ones each member names BEST besides the hub, in later rounds more.
SMALL, BEST, BLOCK = 48, 1, 1024
#: Rows of a few numbers that are broadcast (some 40 bytes each); more are joined by shuffle.
MAX_IDS = 200_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _times(k: int, salt: np.uint64) -> np.uint64:
    return np.uint64(k * int(salt) & 0xFFFFFFFFFFFFFFFF)


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    base = 0x2127599BF4325C37
    up = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full((1 << bits) - 1, b, np.uint64))])
    return up(base), up(pow(base, -1, 1 << 64))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the number of words of each text."""
    data, offsets = raw(texts)
    data = _LOWER[data]
    word = np.concatenate([[False], _WORD[data], [False]])
    cutting = np.zeros(len(data) + 1, bool)
    cutting[offsets] = True
    start = np.flatnonzero(word[1:-1] & (~word[:-2] | cutting[:-1]))
    end = np.flatnonzero(word[1:-1] & (~word[2:] | cutting[1:])) + 1
    up, down = _powers(max(19, len(data).bit_length()))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    hashes = mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(start, offsets))


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) in order, as text numbers, hashes and weights."""
    doc = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    left = np.repeat(begin + counts, counts) - np.arange(len(doc))  # words from here to the text's end
    lead = np.flatnonzero((left >= size) | (np.arange(len(doc)) == np.repeat(begin, counts)))
    value = np.zeros(len(lead), np.uint64)
    for k in range(size):
        has = left[lead] > k
        value = value * _A + np.where(has, hashes[np.minimum(lead + k, max(len(hashes) - 1, 0))], np.uint64(0)) if len(lead) else value
    value, doc = mix(value), doc[lead]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])])) if len(value) else np.zeros(0, np.int64)
    return doc[new], value[new], np.diff(np.concatenate([new, [len(value)]]))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """BagMinHash registers (texts, REGISTERS) as uint32 marks of the earliest points; 0 for a text without elements."""
    best = np.full(texts * REGISTERS, np.uint64(2**64 - 1))
    total = np.bincount(doc, weight, texts)
    limit = REGISTERS * (np.log(REGISTERS) + 4) / np.maximum(total, 1)
    todo = np.ones(len(doc), bool)
    while len(doc):
        d, e, w = doc[todo], element[todo], weight[todo]
        low, width, level = np.zeros(len(d), np.int64), np.ones(len(d), np.int64), 0
        while len(d):  # one weight interval after another; most elements have the first alone
            key, time, at = mix(e + _times(level, _A)), np.zeros(len(d)), np.arange(len(d))
            point = 0
            while len(at):
                h = mix(key[at] + _times(point, _C))
                time[at] -= np.log1p((h >> np.uint64(11)).astype(np.float64) * -(2.0**-53)) / width[at]
                at = at[time[at] <= limit[d[at]]]
                h = mix(mix(key[at] + _times(point, _C)))
                place = low[at] + 1 + ((h >> np.uint64(6)) & np.uint64(0xFFFFFF)).astype(np.int64) % width[at]
                ok = place <= w[at]
                hit, mark = at[ok], h[ok]
                slot = d[hit] * REGISTERS + (mark & np.uint64(REGISTERS - 1)).astype(np.int64)
                np.minimum.at(best, slot, (time[hit].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (mark >> np.uint64(32)))
                point += 1
            more = w > low + width
            low, d, e, w = (low + width)[more], d[more], e[more], w[more]
            width, level = low.copy(), level + 1
        open_ = np.zeros(texts, bool)
        open_[np.flatnonzero(best == np.uint64(2**64 - 1)) // REGISTERS] = True
        todo = open_[doc]
        if not todo.any():
            break
        limit = limit * 2
    best[best == np.uint64(2**64 - 1)] = 0
    return (best & np.uint64(0xFFFFFFFF)).astype("<u4").reshape(texts, REGISTERS)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (sorted distinct shingles, weights)."""
    total = int(a[1].sum() + b[1].sum())
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both) if total else 0.0


FEATURES = "struct<n: bigint, k1: bigint, k2: bigint, low: binary, bands: array<bigint>>"


def band_keys(sig: np.ndarray) -> np.ndarray:
    """Keys (texts, BANDS) of the buckets, from all bits of a band's registers and its number."""
    part = sig[:, : BANDS * ROWS].reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64) * _A + _B), part.shape[:2])
    for k in range(ROWS):
        key = mix(key * _C + part[:, :, k])
    return key.view(np.int64)


def features(texts: pa.Array) -> pa.Array:
    """Shingles, two hashes of the word sequence, the registers' lowest bytes and the keys of the buckets."""
    out: list[list] = [[], [], [], [], []]
    for part in blocks(texts.fill_null(""), 1 << 19):
        hashes, counts = word_hashes(part)
        at = (np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64)
        ends = np.cumsum(counts)
        doc, element, weight = shingles(hashes, counts)
        sig = signatures(doc, element, weight, len(part))
        out[0].append(np.bincount(doc, weight, len(part)).astype(np.int64))
        for k, salt in ((1, _A), (2, _B)):
            prefix = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ mix(at * salt + salt)))])
            out[k].append((prefix[ends] - prefix[ends - counts]).view(np.int64))
        out[3] += [x.tobytes() for x in sig.astype(np.uint8)]
        out[4].append(band_keys(sig).ravel())
    flat = [pa.array(np.concatenate(out[k]) if out[k] else np.zeros(0, np.int64), pa.int64()) for k in (0, 1, 2, 4)]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), flat[3])
    made = pa.StructArray.from_arrays([*flat[:3], pa.array(out[3], pa.binary()), lists], ["n", "k1", "k2", "low", "bands"])
    release()
    return made


def bags(texts: pa.Array, size: int = 256) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Of every text its sorted distinct shingles and their weights, `size` texts at a time."""
    for i in range(0, len(texts), size):
        part = texts.slice(i, size).fill_null("")
        doc, element, weight = shingles(*word_hashes(part))
        cutting = np.searchsorted(doc, np.arange(len(part) + 1))
        yield [(element[s:e], weight[s:e]) for s, e in zip(cutting, cutting[1:])]


def text_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Weighted Jaccard of two texts' shingles."""
    out = [similarity(x, y) for left, right in zip(bags(a), bags(b)) for x, y in zip(left, right)]
    release()
    return pa.array(out, pa.float64())


def text_bag(texts: pa.Array) -> pa.Array:
    """Distinct shingles of a text with their weights."""
    each = [x for part in bags(texts) for x in part]
    flat = [np.concatenate([x[k] for x in each]).astype(np.int64, copy=False) if each else np.zeros(0, np.int64) for k in (0, 1)]
    ends = np.cumsum([0, *(len(x[0]) for x in each)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[0].view(np.int64)), pa.array(flat[1])], ["e", "w"]))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of sorted rows."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t]).combine_chunks()
        if not t.num_rows:
            continue
        changed = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            x = np.asarray(t[k])
            changed |= x[1:] != x[:-1]
        edge = [0, *(np.flatnonzero(changed) + 1).tolist()]
        for s, e in zip(edge, edge[1:]):
            yield t.slice(s, e - s)
        rest = t.slice(edge[-1])
    if rest is not None and rest.num_rows:
        yield rest


def _name_pairs(batches: Iterator[pa.RecordBatch], best: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, a, b, null) of pairs to verify, once each; (key, hub, null, parts) of a block among several; (key, null, null, null) where more are left."""
    names = ["key", "a", "b", "parts"]
    out: list[tuple] = []
    for t in _groups(batches, ["key", "i", "j"]):
        ids, n, group, own, foreign = (np.asarray(t[c]) for c in ("id", "n", "class", "own", "foreign"))
        apart, key, size = t["i"][0].as_py() != t["j"][0].as_py(), t["key"][0].as_py(), len(t)
        hub, parts = 0, t["parts"][0].as_py()
        if len(np.unique(group)) > 1:
            low = np.frombuffer(b"".join(t["low"].to_pylist()), np.uint8).reshape(size, REGISTERS)
            bands = np.asarray(t["bands"].combine_chunks().flatten()).reshape(size, BANDS)
            may = np.zeros((size, size), np.uint8)  # agreeing registers of candidate pairs, else 0
            for x in range(size):
                # the most that two texts of different classes can share, against what a link needs
                most = np.minimum(foreign, foreign[x])
                other = (group != group[x]) & (most * (1 + SIMILARITY) >= SIMILARITY * (n + n[x]) - 1e-6)
                if apart:
                    other &= own != own[x]
                (y,) = np.nonzero(other)
                if len(y):
                    agree = (low[y] == low[x]).sum(1).astype(np.uint8)
                    y, agree = y[agree >= AGREE], agree[agree >= AGREE]
                    # a pair belongs to the first bucket that it shares, so no other bucket names it again
                    shared = bands[y] == bands[x]
                    may[x, y] = np.where(bands[x][shared.argmax(1)] == key, agree, 0)
            count = (may > 0).sum(1)
            hub = int(np.lexsort((ids, -may.sum(1, dtype=np.int64), -count))[0])
            more, pairs = False, set()
            for x in np.flatnonzero(count).tolist():
                y = np.flatnonzero(may[x])
                # the member with most candidates goes first: its links make short paths
                y = y[np.lexsort((ids[y], -may[x, y].astype(np.int64), y != hub))][: size if size <= SMALL else best + 1].tolist()
                more |= count[x] > len(y)
                pairs.update((min(x, k), max(x, k)) for k in y)
            out += [(key, int(ids[x]), int(ids[y]), None) for x, y in pairs]
            if more:
                out.append((key, None, None, None))
        if parts > 1:
            out.append((key, int(ids[hub]), None, parts))
        if len(out) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
            out = []
    release()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)


def handy(df: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= MAX_IDS else df


def components(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """node, label (the smallest node of its component) of every node in edges (a, b), which are read several times: give a written table.

    `start`: labels known before, of parts of components. Each pass takes the smallest label around and then its
    label, so long chains fold quickly; the passes end when no label changes.
    """
    both = edges.select("a", "b")
    if start is not None:  # a node's label stands for what was known before
        both = both.unionByName(start.select(F.col("node").alias("a"), F.col("label").alias("b")))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    labels = labels if start is None else labels.join(start.withColumnRenamed("label", "l"), "node", "left").select("node", F.least("label", "l").alias("label"))
    labels = cut(labels)
    while True:
        known = handy(labels)
        seen = both.join(known, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        near = seen.join(known, seen.a == labels.node).select("node", F.col("label").alias("old"), F.least("label", "m").alias("to"))
        step = near.join(known.select(F.col("node").alias("to"), F.col("label").alias("top")), "to").select("node", "old", F.least("to", "top").alias("label"))
        step = cut(step)
        labels = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            return labels


def _named(rows: DataFrame, best: int) -> DataFrame:
    """Checkpointed output of _name_pairs for rows dealt by (key, i, j)."""
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return cut(dealt.mapInArrow(lambda x: _name_pairs(x, best), "key bigint, a bigint, b bigint, parts bigint"))


def _alone(rows: DataFrame) -> DataFrame:
    """Rows with blocks of about BLOCK members of a key; a block meets itself only. Needs `count`, the key's members."""
    parts = F.ceil(F.col("count") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("id", "key"), parts.cast("long"))
    return rows.withColumns({"parts": parts, "own": block, "i": block, "j": block})


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows with the pairs of blocks that they take part in: a class of BLOCK members has blocks of its own, which don't meet.

    `count` is what a key had in the first round, so keys of one block need no counting.
    """
    whole = rows.withColumns({"own": F.lit(0).cast("long"), "i": F.lit(0).cast("long"), "j": F.lit(0).cast("long"), "parts": F.lit(1)})
    small, large = whole.where(F.col("count") <= BLOCK), rows.where(F.col("count") > BLOCK)
    if large.isEmpty():
        return small
    of = large.groupBy("key", "class").agg(F.count("*").alias("_c"))
    # a row per BLOCK members at most
    big = F.collect_list(F.when(F.col("_c") >= BLOCK, F.struct("class", F.ceil(F.col("_c") / BLOCK).cast("int").alias("n"))))
    rest = F.ceil(F.coalesce(F.sum(F.when(F.col("_c") < BLOCK, F.col("_c"))), F.lit(0)) / BLOCK).cast("int")
    large = large.join(of.groupBy("key").agg(big.alias("_big"), rest.alias("_rest")), "key")
    name = lambda c, k: F.xxhash64(c, k.cast("long"))
    mine = F.get(F.filter("_big", lambda x: x["class"] == F.col("class")), F.lit(0))
    group, parts = F.coalesce(mine["class"], F.lit(-1).cast("long")), F.coalesce(mine["n"], F.col("_rest"))
    large = large.withColumn("own", name(group, F.pmod(F.xxhash64("id"), parts.cast("long"))))
    count = lambda n: F.filter(F.sequence(F.lit(0), n), lambda k: k < n)
    others = F.flatten(F.transform(F.filter("_big", lambda x: x["class"] != F.col("class")), lambda x: F.transform(count(x["n"]), lambda k: name(x["class"], k))))
    to = F.concat(others, F.transform(count(F.col("_rest")), lambda k: name(F.lit(-1).cast("long"), k)))
    meet = F.explode(F.transform(to, lambda b: F.struct(F.least("own", b).alias("i"), F.greatest("own", b).alias("j"))))
    large = large.withColumn("_pair", meet).withColumns({"i": F.col("_pair.i"), "j": F.col("_pair.j"), "parts": F.lit(1)})
    return small.unionByName(large.select(small.columns))


def _foreign(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows (id, class, n, single and more) with foreign: at most so much weight a text shares with open texts of other classes.

    For a text that is a class by itself (`single`) it is n less the weight of the shingles that no other open text has,
    counted by shingle and then by text, without a join. For texts of larger classes, which have found their like, it is n.
    """
    ids = rows.select("id", "class", "single").distinct()
    bag = F.explode(F.arrow_udf(text_bag, "array<struct<e: bigint, w: bigint>>")(F.col("text"))).alias("x")
    each = texts.join(ids, "id").select("class", "single", bag).select("class", "single", "x.e", "x.w")
    kept = each.groupBy("e").agg(F.min("class").alias("id"), F.max("class").alias("_hi"), F.first("single").alias("_one"), F.sum("w").alias("w"))
    own = kept.where("id = _hi and _one").groupBy("id").agg(F.sum("w").alias("_own"))
    return rows.join(own, "id", "left").withColumn("foreign", F.col("n") - F.coalesce("_own", F.lit(0))).drop("_own", "single")


def _nodes(docs: DataFrame, text: str, id: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, h1, h2 of the text, n, k1, k2) and nodes (k1, k2, n, id, one row's doc, h1, h2, low, bands)."""
    batch_bytes(docs.sparkSession, "4m")
    docs = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).withColumns(_text_hashes())
    alone = F.struct(F.monotonically_increasing_id().alias("k1"), F.lit(1).cast("long").alias("k2"))
    plain = F.when(F.col("text").isNull(), alone).otherwise(F.struct(F.col("h1").alias("k1"), F.lit(0).cast("long").alias("k2")))
    made = docs.select("doc", "h1", "h2", F.arrow_udf(features, FEATURES)(F.col("text")).alias("f"), plain.alias("p"))
    key = F.when(F.col("f.n") > 0, F.struct("f.k1", "f.k2")).otherwise(F.col("p"))
    made = cut(made.select("doc", "h1", "h2", F.col("f.n").alias("n"), key.alias("k"), "f.low", "f.bands").select("*", "k.*").drop("k"))
    one = F.min_by(F.struct("doc", "h1", "h2", "low", "bands"), F.struct(F.col("doc").isNull(), "doc", "h1", "h2")).alias("r")
    nodes = made.groupBy("k1", "k2", "n").agg(one).select("k1", "k2", "n", "r.*", F.monotonically_increasing_id().alias("id"))
    return made.drop("low", "bands"), cut(nodes)


def _text_hashes(text: str = "text") -> dict:
    return {"h1": F.xxhash64(text), "h2": F.xxhash64(text, F.lit(1))}


def _labels(docs: DataFrame, nodes: DataFrame, text: str, id: str) -> DataFrame | None:
    """node, label of the nodes that have links; None without any."""
    keys = nodes.where("n > 0").select("id", F.explode("bands").alias("key"))
    many = keys.groupBy("key").count().where("count > 1")
    # only nodes that share a bucket go on
    rows = cut(keys.join(many, "key").join(nodes.select("id", "n", "low", "bands"), "id"))
    asked = nodes.join(rows.select("id"), "id", "left_semi").select("id", F.col("doc").alias("_doc"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    asked = handy(cut(asked))
    have = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).withColumns(_text_hashes())
    same = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & F.col("doc").eqNullSafe(F.col("_doc"))
    texts = cut(have.join(asked, same).groupBy("id").agg(F.min("text").alias("text")))

    def verified(tested: DataFrame) -> DataFrame:
        both = tested.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        return cut(both.select("a", "b", F.arrow_udf(text_similarity, "double")(F.col("ta"), F.col("tb")).alias("s")).where(F.col("s") >= SIMILARITY))

    named = every = _named(_alone(rows.withColumns({"class": F.col("id"), "foreign": F.col("n")})), BEST)
    while True:  # the hubs of a bucket's blocks meet, until one block holds them
        hubs = named.where("parts is not null").select("key", F.col("a").alias("id"), F.col("parts").alias("count"))
        if hubs.isEmpty():
            break
        met = rows.drop("count").join(handy(hubs), ["key", "id"]).withColumns({"class": F.col("id"), "foreign": F.col("n")})
        named = _named(_alone(met), BEST)
        every = every.unionByName(named)
    best, label = BEST, None
    while True:
        good = verified(every.where("b is not null").select("a", "b"))
        if not good.isEmpty():
            label = components(good, label)
        rows = cut(rows.join(handy(every.where("b is null").select("key")), "key", "left_semi"))
        if rows.isEmpty():
            return label
        state = rows.withColumns({"class": F.col("id"), "single": F.lit(True)})
        if label is not None:
            known = handy(label.withColumnRenamed("node", "id"))
            state = rows.join(known, "id", "left").withColumns({"class": F.coalesce("label", "id"), "single": F.col("label").isNull()}).drop("label")
        state = _foreign(state, texts).where(F.col("foreign") >= SIMILARITY * F.col("n") - 1e-6)
        best *= 4096  # what is still open has few classes left, and pairs that the bound lets pass: few rounds
        every = _named(_blocks(state), best)
        if every.isEmpty():
            return label


def _classed(docs: DataFrame, text: str, id: str) -> DataFrame:
    """doc, h1, h2, n, class of every row."""
    made, nodes = _nodes(docs, text, id)
    to, label = nodes.select("k1", "k2", "n", F.col("id").alias("node")), _labels(docs, nodes, text, id)
    to = to.withColumn("class", F.col("node")) if label is None else to.join(label, "node", "left").withColumn("class", F.coalesce("label", "node"))
    return made.join(to.select("k1", "k2", "n", "class"), ["k1", "k2", "n"]).select("doc", "h1", "h2", "n", "class")


def classes(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id of the class); one row per input row."""
    rows = cut(_classed(docs, text, id))
    least = rows.groupBy("class").agg(F.min("doc").alias("class_id"))
    return rows.join(least, "class").select(F.col("doc").alias(id), F.col("n").alias("n_shingles"), "class_id")


def deduplicate(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """docs without near duplicates: of every class the row with the smallest doc_id (then the smallest text hashes), once."""
    rows = _classed(docs, text, id)
    first = F.min_by(F.struct("doc", "h1", "h2"), F.struct(F.col("doc").isNull(), "doc", "h1", "h2")).alias("r")
    best = rows.groupBy("class").agg(first).select(F.col("r.doc").alias("_doc"), F.col("r.h1").alias("_h1"), F.col("r.h2").alias("_h2"))
    # null texts are classes of their own, so all their rows stay
    body = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("body")
    have = docs.select(body, F.col(id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    have = have.select("body", "doc", *(c.alias(k) for k, c in _text_hashes().items()), F.col("text").isNull().alias("none"))
    same = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & F.col("doc").eqNullSafe(F.col("_doc"))
    kept = have.where("not none").join(best.distinct(), same, "left_semi").dropDuplicates(["doc", "h1", "h2"])
    return kept.select("body.*").unionByName(docs.where(F.col(text).isNull()))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
