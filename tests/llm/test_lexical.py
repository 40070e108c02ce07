import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import lexical

DATA = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def found(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items, k=20):
    """(item, rank, score) and the documents that may stand there: rows of one doc_id and score are interchangeable."""
    have = [(d, Counter(found(t))) for d, t in docs if found(t)]
    n_docs, n_terms = len(have), sum(sum(c.values()) for _, c in have)
    df = Counter(t for _, c in have for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in have:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in found(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


DOCS = [
    (5, "Apple pie, apple tart", "x"), (3, "apple PIE; apple tart", "x"), (4, None, "x"), (1, "", "x"), (2, "... --- !!!", "x"), (7, "pear", "x"), (None, "pear pear", "x"), (7, "pear", "x"),
    (8, "été Été naïve 東京 42", "x"), (9, "word " * 40_000 + "apple", "x"), (10, "tart " * 3 + "pear " * 9, "x"), (11, "zebra a_b a-b", "x"),
]
ITEMS = [("a", "apple tart tart"), ("b", None), ("c", "..."), ("d", "PEAR été b"), ("d", "zebra unknown"), ("e", "unknown"), (None, "42")]


@pytest.mark.parametrize(("block", "seeds"), [(1 << 20, 4096), (1, 2)])
def test_odd_rows_against_brute_force(spark, block, seeds):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, score string").repartition(3)
    items = spark.createDataFrame([(*x, 0) for x in ITEMS], "item_id string, text string, rank int")
    for k in (1, 3, 20):
        got = sorted(map(tuple, lexical.search(docs, items, k, block, seeds).collect()), key=str)
        assert got == brute([x[:2] for x in DOCS], ITEMS, k)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string, score string"), spark.createDataFrame(ITEMS, "item_id string, text string")
    assert lexical.search(docs.limit(0), items).collect() == lexical.search(docs, items.limit(0)).collect() == []
    assert lexical.search(docs.where("doc_id in (1, 2, 4)"), items).collect() == []
    assert lexical.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 12))
def test_a_bucket_loses_nothing(seed, level):
    """Every document that scores the threshold or more survives, and its score is exact."""
    rng = np.random.default_rng(seed)
    size, n = 30, 40
    per = rng.integers(1, 8, n)
    at = np.concatenate([rng.choice(size, k, replace=False) for k in per]).astype(np.int64)
    v = rng.integers(1, 10 ** int(rng.integers(1, 7)), len(at))
    ends = np.concatenate([[0], np.cumsum(per)])
    norm = np.sqrt(np.array([(v[i:j].astype(float) ** 2).sum() for i, j in zip(ends, ends[1:])]))
    queries = lexical.Queries([Counter(rng.integers(0, size, 6).tolist())], rng.integers(1, 9000, size), 5)
    bucket, (places, w, _) = lexical.Bucket(norm, at, v, ends, size), queries.items[0]
    of = dict(zip(places.tolist(), w.tolist()))
    scores = np.array([sum(of.get(t, 0) * x for t, x in zip(at[i:j].tolist(), v[i:j].tolist())) for i, j in zip(ends, ends[1:])])
    least = max(1, int(scores.max() * level / 10))
    docs = bucket.survivors(queries.items[0], least)
    assert set(np.flatnonzero(scores >= least)) <= set(docs)
    if len(docs):
        assert (bucket.scores(queries.items[0], docs, np.zeros(size, np.int64)) == scores[docs]).all()


def test_query_against_its_oracle(spark):
    c = duckdb.connect()
    for n in ("documents", "benchmark"):
        c.sql(f"create view {n} as select * from '{DATA}/{n}.parquet'")
    assert sorted(map(tuple, lexical.op13_lexical_search(spark, DATA).collect())) == sorted(c.sql(lexical.ORACLE).fetchall())
