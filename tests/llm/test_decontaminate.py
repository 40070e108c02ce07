import re

import pytest
from pyspark.sql import functions as F

from strata.llm import decontaminate as dec

GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return [w for w in GAP.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def brute(text, items, n):
    doc, hit, ids = words(text), set(), set()
    for item, t in items:
        w = words(t)
        k = min(len(w), n)
        for i in range(len(w) - k + 1 if k else 0):
            for p in range(len(doc) - k + 1):
                if doc[p : p + k] == w[i : i + k]:
                    hit |= set(range(p, p + k))
                    ids.add(str(item))
    return len(doc), len(hit), sorted(ids)


ITEMS = [(1, "The quick, brown fox! jumps over"), (10, "jumps OVER the lazy dog and the quick brown fox"), (2, "Été Sur"), (3, ""), (4, None), (5, "the the the the the"), (5, "the quick"), (6, "\U0001f600 x")]
DOCS = [
    (1, "a the quick brown fox jumps over the lazy dog and the quick brown fox jumps"),
    (2, "Été sur; Été Sur été sur Été  Sur"),
    (3, None),
    (4, ""),
    (5, "the the the the the the the"),
    (6, "clean words only"),
    (7, "x \U0001f600-X " * 3000),
    (1, "a the quick brown fox jumps over the lazy dog and the quick brown fox jumps"),
]


@pytest.mark.parametrize(("most", "filtered"), [(dec.TABLE_GRAMS, 1), (5, 1), (1, dec.FILTER_GRAMS), (1, 3)])
def test_against_brute_force(spark, most, filtered):
    docs = spark.createDataFrame([(*d, 1, "s") for d in DOCS], "doc_id long, text string, size int, gram string")
    bench = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, items string")
    found, words_, hit = dec.hits(docs, bench, n=4, table_grams=most, filter_grams=filtered)
    got = found.select("doc_id", "text", dec.F.size(words_).alias("w"), dec.n_hit(dec.F.col(hit)).alias("h"), dec.item_ids(dec.F.col(hit)).alias("i")).collect()
    assert len(got) == len(DOCS)
    for r in got:
        assert (r.w, r.h, r.i) == brute(r.text, ITEMS, 4)


def test_removal(spark):
    docs, bench = spark.createDataFrame([(*d, "s", "w") for d in DOCS], "doc_id long, text string, source string, _x_words string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted(r.doc_id for r in dec.decontaminate(docs, bench, n=4).collect()) == [3, 4, 6]
    cut = {r.doc_id: r.text for r in dec.decontaminate(docs, bench, remove="spans", n=4).collect()}
    assert cut[6] == "clean words only" and cut[5] == "" and cut[1].split()[0] == "a" and cut[3] is None
    assert dec.decontaminate(docs, bench, n=4).columns == docs.columns == dec.decontaminate(docs, bench, remove="spans", n=4).columns
    assert dec.decontaminate(docs, bench.limit(0)).count() == len(DOCS)
    assert dec.decontaminate(docs.limit(0), bench).count() == 0


def test_a_large_benchmark_is_reduced_to_what_occurs(spark):
    """Far more grams than a job takes: one pass leaves those that the texts have, and the hits are the same."""
    docs = spark.createDataFrame([(*d, 1) for d in DOCS], "doc_id long, text string, x int")
    noise = spark.range(400).select((F.col("id") + 100).alias("item_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.concat(F.lit("w"), F.xxhash64("id", i).cast("string"))), " ").alias("text"))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").unionByName(noise)
    gram = dec.grams(bench, 4)
    assert gram.count() > 60_000
    found, words_, hit = dec.hits(docs, bench, n=4, table_grams=100)
    got = found.select("text", dec.n_hit(F.col(hit)).alias("h"), dec.item_ids(F.col(hit)).alias("i")).collect()
    assert len(got) == len(DOCS) and all((r.h, r.i) == brute(r.text, ITEMS, 4)[1:] for r in got)
