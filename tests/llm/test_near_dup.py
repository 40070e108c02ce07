import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import near_dup as nd

GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return [w for w in GAP.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def bag(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows):
    """doc_id -> class by all pairs."""
    top = {i: i for i, _ in rows}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    bags = [(i, t, bag(t)) for i, t in rows]
    for k, (i, t, a) in enumerate(bags):
        for j, u, b in bags[:k]:
            total = sum((a | b).values())
            if (total and sum((a & b).values()) / total >= 0.8) or (not a and not b and t is not None and t == u):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def corpus(seed, groups, size):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(300))
    texts = ["", "", None, "!!", "!!", "one two", "One, two!", "one two three"]
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(60, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(size)):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 40)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
            if rng.random() < 0.4:
                texts.append(texts[-1].upper())
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


def test_classes_against_all_pairs(spark):
    rows = corpus(4, 12, 9)
    got = {r.doc_id: r.class_id for r in nd.classes(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string")).collect()}
    want = brute(rows)
    # a link at the threshold may be missed by the bands; here none is
    assert got == want


def test_star_of_variants_in_blocks(spark, monkeypatch):
    """Variants that are like their base only, in buckets dealt out as blocks."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(600)]
    rows = [(500, " ".join(base))]
    for k in range(40):
        own = list(base)
        for p in range(k * 15 % 590, k * 15 % 590 + 12, 5):
            own[p] = f"x{rng.randrange(10**6)}"
        rows += [(k, " ".join(own))]
    monkeypatch.setattr(nd, "BLOCK", 8)
    monkeypatch.setattr(nd, "SMALL", 4)
    got = {r.doc_id: r.class_id for r in nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é1.,-\n", max_size=60), max_size=6))
def test_shingles_against_counts(texts):
    doc, element, weight = nd.shingles(*nd.word_hashes(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert sorted(weight[doc == i]) == sorted(bag(t).values())


def test_signature_is_unbiased_and_counts_multiplicity():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(120):
        e = rng.integers(0, 2**63, 40).astype(np.uint64)
        a, b = rng.integers(0, 9, 40), rng.integers(0, 9, 40)
        s = nd.signatures(np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)]), np.concatenate([e[a > 0], e[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02


def test_edges(spark):
    rows = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (None, "a b c d e f", "s"), (2, "a b c d e f", "s"), (3, None, "s"), (4, None, "s"), (None, "z", "s"), (None, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted((key((r.doc_id, r.n_shingles, r.class_id)) for r in nd.classes(df).collect()))
    assert got == [(-1, 0, -1), (-1, 1, -1), (-1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4)]
    kept = nd.deduplicate(df)
    assert kept.columns == df.columns and sorted(key((r.doc_id, r.text or "")) for r in kept.collect()) == [(-1, ""), (-1, "z"), (1, "a b c d e f"), (3, ""), (4, "")]
    assert nd.classes(df.limit(0)).collect() == [] and nd.deduplicate(df.limit(0)).collect() == []


def test_rows_of_one_id_are_documents_by_their_texts(spark):
    """No text vanishes that isn't like a kept one, and links hold for every row's own text."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    df = spark.createDataFrame([(1, a, 0), (1, b, 0), (2, b + " z", 0), (3, a + " z", 0), (4, "x y", 0)], "doc_id long, text string, h1 int")
    assert sorted((r.doc_id, r.class_id) for r in nd.classes(df).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    assert sorted((r.doc_id, r.text) for r in nd.deduplicate(df).collect()) == [(1, a), (1, b), (4, "x y")]
    assert nd.deduplicate(df).columns == df.columns


def test_bound_on_shared_weight_is_exact(spark):
    """foreign counts the shingles of a text alone that stand in other classes, with their weights."""
    texts = [(1, 1, "a b c d e f"), (2, 1, "a b c d e g"), (3, 3, "a b c d e a b c d e")]
    rows = spark.createDataFrame([(1, 1, 2, False), (2, 1, 2, False), (3, 3, 6, True), (4, 4, 1, True)], "id long, class long, n long, single boolean")
    got = nd._foreign(rows, spark.createDataFrame([*((t[0], t[2]) for t in texts), (4, "x")], "id long, text string"))
    assert {r.id: (r["class"], r.foreign) for r in got.collect()} == {1: (1, 2), 2: (1, 2), 3: (3, 2), 4: (4, 0)}


def test_large_group_without_a_base(spark, monkeypatch):
    """Variants in blocks, many of them just under the threshold to all others: classes equal those of all pairs."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(60):
        own = list(base)
        for p in rng.sample(range(150), rng.randrange(1, 6)):
            own[p] = f"x{k}_{p}"
        rows.append((k, " ".join(own)))
    monkeypatch.setattr(nd, "BLOCK", 7)
    monkeypatch.setattr(nd, "SMALL", 3)
    got = {r.doc_id: r.class_id for r in nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and 1 < len(set(got.values())) < 60


def test_first_bucket_is_told_by_whole_registers():
    """An earlier band that agrees in its lowest bytes only is no bucket that the pair shares."""
    sig = np.tile(np.arange(1, nd.REGISTERS + 1, dtype="<u4"), (2, 1))
    sig[1, [0, *range(2 * nd.ROWS, nd.BANDS * nd.ROWS, nd.ROWS)]] += 256  # all bands but the second differ, above the lowest byte
    keys = nd.band_keys(sig).tolist()
    (key,) = set(keys[0]) & set(keys[1])
    low = [x.astype(np.uint8).tobytes() for x in sig]
    assert low[0] == low[1] and key == keys[0][1]
    same = {"key": [key] * 2, "i": [0] * 2, "j": [0] * 2, "own": [0] * 2, "parts": [1] * 2}
    t = pa.table(same | {"id": [1, 2], "n": [296, 297], "foreign": [296, 297], "low": low, "bands": keys, "class": [1, 2]})
    named = [tuple(r.values()) for b in nd._name_pairs(iter(t.to_batches()), nd.BEST) for r in b.to_pylist()]
    assert named == [(key, 1, 2, None)]
