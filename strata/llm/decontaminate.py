"""Benchmark decontamination: a hash set of the benchmark's n-grams is held against every window of a text.

Items and texts are words (A-Z lower-cased). A gram is `n` consecutive item words; an item of fewer words, but
not none, is one gram. The grams become hash tables of at most `TABLE_GRAMS` grams, which are literals sent to all tasks:
buckets of (words, item ids), and a byte per bucket that says whether it holds any. A text's windows are hashed, looked
up by bucket, and verified word by word, all inside the text's own row: no join, no shuffle, so a passage that every
text holds costs no more than any other. One job looks at `JOB_TABLES` tables.

A benchmark of more grams than that is first reduced to the grams that occur, in one pass: a Bloom filter of the grams'
hashes (`BITS` bits and three probes a gram, at most `FILTER_GRAMS` grams a filter) marks windows, the distinct hashes of
marked windows are held against the grams by a join, and what is left (the hashes that both have) makes the tables. If
even these are more than a job takes, its hits are written and the next job goes on; neither a plan nor the driver holds
more than a filter or a job's tables.

Null or empty texts and items have no words: no hits. Repeated items count once each by item_id, repeated texts each by
itself. Very long texts are handled whole, in their row. Other columns are kept, whatever their names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import cut, prefix, table, words

N, TABLE_GRAMS, JOB_TABLES, BUCKETS_PER_GRAM = 10, 20_000, 8, 16
BITS, FILTER_GRAMS = 32, 8_000_000
#: Hashes of grams are below this.
HASHES = 1 << 40
HIT = "array<struct<at: int, size: int, items: array<string>>>"


def grams(benchmark: DataFrame, n: int = N) -> DataFrame:
    """size, gram (words joined by spaces), items: one row per distinct gram."""
    item = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    item = item.withColumn("size", F.least(F.size("w"), F.lit(n)))
    each = item.select("item", "size", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.array_join(F.slice("w", i, F.col("size")), " "))).alias("gram"))
    return each.groupBy("size", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _hash(hashes: Column, at: Column, size: int) -> Column:
    """Hash of `size` words from `at` (from 1), from the words' own hashes."""
    return F.xxhash64(*(F.element_at(hashes, at + i) for i in range(size)))


def _gram_hash(size: int) -> Column:
    return _hash(F.transform(F.split("gram", " "), lambda w: F.xxhash64(w)), F.lit(1), size)


def _literals(gram: DataFrame) -> tuple[int, Column, Column]:
    """Number of buckets, a byte per bucket, and the buckets, of one table's grams with their hashes (h)."""
    rows, buckets = gram.collect(), 16  # TABLE_GRAMS short rows at most
    while buckets < len(rows) * BUCKETS_PER_GRAM:
        buckets *= 2
    held: list[list] = [[] for _ in range(buckets)]
    for r in rows:
        held[r.h % buckets].append({"size": r["size"], "gram": r.gram, "items": r["items"]})
    kind = "array<array<struct<size: int, gram: string, items: array<string>>>>"
    # both fold into literals, which go out with the tasks once
    return buckets, F.lit(bytes(bool(x) for x in held)), F.from_json(F.lit(json.dumps(held, ensure_ascii=False)), kind)


def _slots(h: Column, bits: int) -> list[Column]:
    """Three places of a hash in a filter."""
    return [F.pmod(x, F.lit(bits)) for x in (h, F.xxhash64(h), F.xxhash64(h, F.lit(1)))]


def _filter(gram: DataFrame, n: int) -> tuple[int, Column]:
    """Number of bits, and a Bloom filter of n grams' hashes (h) as 64-bit numbers: one row for each of them comes to the driver."""
    bits = 64
    while bits < n * BITS:
        bits *= 2
    each = gram.select(F.explode(F.array(*_slots(F.col("h"), bits))).alias("s"))
    set_ = each.groupBy(F.shiftright("s", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits"))
    held = [0] * (bits // 64)
    for r in set_.toLocalIterator():
        held[r.word] = r.bits
    return bits, F.from_json(F.lit(json.dumps(held)), "array<bigint>")


def _occurring(split: DataFrame, gram: DataFrame, sizes: list[int], total: int, filter_grams: int) -> DataFrame:
    """The grams whose hash some window of the texts (a column w of words) has."""
    count = -(-total // filter_grams)
    hashed, left = split.select(F.transform("w", lambda w: F.xxhash64(w)).alias("h")), []
    for t in range(count):
        part = gram if count == 1 else gram.where(F.pmod(F.xxhash64("h"), F.lit(count)) == t)
        bits, held = _filter(part, -(-total // count))

        def may(h: Column, bits: int = bits, held: Column = held) -> Column:
            tests = [F.getbit(F.element_at(held, (F.shiftright(s, 6) + 1).cast("int")), (s % 64).cast("int")) == 1 for s in _slots(h, bits)]
            return tests[0] & tests[1] & tests[2]

        windows = []
        for k in sizes:
            at = F.when(F.size("h") >= k, F.sequence(F.lit(1), F.size("h") - k + 1)).otherwise(F.array().cast("array<int>"))
            windows.append(F.filter(F.transform(at, _at(k)), _one(may)))
        seen = hashed.select(F.explode(F.concat(*windows)).alias("h")).distinct()
        left.append(part.join(seen, "h", "left_semi").select(gram.columns))
    out = left[0]
    for x in left[1:]:
        out = out.unionByName(x)
    return out


def _found(docs: DataFrame, own: str, tables: list[tuple[int, Column, Column]], sizes: list[int]) -> tuple[DataFrame, list[Column]]:
    """docs with columns of windows whose bucket holds something, and the verified hits of each table and size."""
    words_, hashes, found = f"{own}_words", f"{own}_h", []
    for i, (buckets, filled, lists) in enumerate(tables):
        for k in sizes:
            at = F.when(F.size(words_) >= k, F.sequence(F.lit(1), F.size(words_) - k + 1)).otherwise(F.array().cast("array<int>"))

            # transform() hands a second parameter the index, so what varies is bound by functions of one parameter
            def slot(p: Column, k: int = k, buckets: int = buckets) -> Column:
                return (F.pmod(_hash(F.col(hashes), p, k), F.lit(buckets)) + 1).cast("int")

            def maybe(p: Column, filled: Column = filled, slot=slot) -> Column:
                return F.substring(filled, slot(p), F.lit(1)) != F.lit(b"\0")

            def verified(p: Column, k: int = k, lists: Column = lists, slot=slot) -> Column:
                text = F.array_join(F.slice(words_, p, k), " ")
                same = F.filter(F.element_at(lists, slot(p)), lambda g: (g["size"] == k) & (g["gram"] == text))
                return F.struct(p.alias("at"), F.lit(k).alias("size"), F.flatten(F.transform(same, lambda g: g["items"])).alias("items"))

            name = f"{own}_maybe_{i}_{k}"
            docs = docs.withColumn(name, F.filter(at, _one(maybe)))
            found.append(F.filter(F.transform(name, _one(verified)), lambda x: F.size(x["items"]) > 0))
    return docs, found


def _at(k: int):
    """The hash of k words from a place, as a function of the place alone."""
    return lambda p: F.pmod(_hash(F.col("h"), p, k), F.lit(HASHES))


def _one(f):
    """f as a function of one parameter."""
    return lambda x: f(x)


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N, text: str = "text", table_grams: int = TABLE_GRAMS, filter_grams: int = FILTER_GRAMS) -> tuple[DataFrame, str, str]:
    """docs with two columns, and their names: the words, and the hits (HIT: window starts from 1, by start then size)."""
    gram = grams(benchmark, n)
    sizes = [k for k in range(1, n + 1)]
    gram = cut(gram.withColumn("h", F.pmod(F.coalesce(*(F.when(F.col("size") == k, _gram_hash(k)) for k in sizes)), F.lit(HASHES))))
    total = gram.count()
    sizes = sorted(r["size"] for r in gram.select("size").distinct().collect())  # at most n
    own = prefix(docs)
    words_, hashes, out = f"{own}_words", f"{own}_h", f"{own}_hits"
    columns = docs.columns
    if total > JOB_TABLES * table_grams:
        gram = cut(_occurring(docs.select(words(F.col(text)).alias("w")), gram, sizes, total, filter_grams))
        total = gram.count()
    docs = docs.withColumn(words_, words(F.col(text)))
    count = -(-total // table_grams)
    # tables by hash, so none is much larger than table_grams
    gram = gram.withColumn("t", F.pmod(F.floor(F.col("h") / 65_536), F.lit(max(count, 1))))
    done: list[Column] = []
    for first in range(0, count, JOB_TABLES):
        tables = [_literals(gram.where(F.col("t") == t)) for t in range(first, min(count, first + JOB_TABLES))]
        docs = docs.withColumn(hashes, F.transform(words_, lambda w: F.xxhash64(w)))
        docs, found = _found(docs, own, tables, sizes)
        docs = docs.withColumn(out, F.array_sort(F.concat(*done, *found)) if len(done) + len(found) > 1 else found[0])
        docs, done = docs.select(*(f"`{c}`" for c in columns), words_, out), [F.col(out)]
        if first + JOB_TABLES < count:
            docs = cut(docs)
    return (docs if count else docs.withColumn(out, F.array().cast(HIT))), words_, out


def n_hit(found: Column) -> Column:
    """Words inside any window, from hits sorted by start."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        found,
        zero,
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["at"] + x["size"] - 1 - F.greatest(a["end"], x["at"] - 1))).alias("n"), F.greatest(a["end"], x["at"] + x["size"] - 1).alias("end")),
        lambda a: a["n"],
    )


def item_ids(found: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda x: x["items"]))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = N, text: str = "text", table_grams: int = TABLE_GRAMS) -> DataFrame:
    """docs without contaminated documents; with remove="spans", all docs, the hit words cut out.

    With spans removed a hit text becomes its other words (A-Z lower-cased) joined by spaces.
    """
    found, words_, hit = hits(docs, benchmark, n, text, table_grams)
    if remove == "documents":
        # as a generator: a filter would be pushed below, and the words be split anew for every window
        once = F.explode(F.when(F.size(hit) == 0, F.array(F.lit(1))))
        return found.select("*", once.alias(f"{hit}_none")).select(*(f"`{c}`" for c in docs.columns))
    hit_at = F.array_distinct(F.flatten(F.transform(hit, lambda x: F.sequence(x["at"], x["at"] + x["size"] - 1))))
    kept = F.transform(F.array_except(F.sequence(F.lit(1), F.size(words_)), hit_at), lambda i: F.element_at(words_, i))
    cleaned = F.when(F.size(hit) > 0, F.array_join(kept, " ")).otherwise(F.col(text)).alias(text)
    return found.select(*(cleaned if c == text else F.col(f"`{c}`") for c in docs.columns))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, words_, hit = hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    found = found.select("doc_id", F.size(words_).cast("long").alias("n_words"), n_hit(F.col(hit)).cast("long").alias("n_hit"), item_ids(F.col(hit)).alias("i"))
    ids = F.sha2(F.array_join("i", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("i").cast("long").alias("n_items"), ids, (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
with dw as (select doc_id, row_number() over () as r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
bw as (select cast(item_id as varchar) as item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
g as (select distinct item, least(len(w), 10) as k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as gram from (select item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from bw where len(w) > 0)),
k as (select distinct k from g),
win as (select r, k, i, array_to_string(w[i : i + k - 1], ' ') as gram from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from dw, k where len(w) >= k)),
h as (select r, i, win.k, item from win join g using (k, gram)),
c as (select r, count(distinct p) as n_hit from (select distinct r, unnest(range(i, i + k)) as p from (select distinct r, i, k from h)) group by r),
t as (select r, count(*) as n_items, string_agg(item, ',' order by item collate binary) as items from (select distinct r, item from h) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join c using (r) left join t using (r)
""".replace(" collate binary", "")
