import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import variants as v

DATA = "/root/testdata/sf0.001"
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def vocabulary(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def pairs(words):
    """Near words of each word: those with one code point left out meet at what is left."""
    out, less = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            less[w[:i] + w[i + 1 :]].add((w, i))
    for x, some in less.items():
        for w, i in some:
            out[w] |= {y for y, j in some if y != w and i == j}
        if x in words:
            for w, _ in some:
                out[w].add(x)
                out[x].add(w)
    return out


def brute(docs):
    words = vocabulary(docs)
    near = pairs(set(words))
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else -1) for w, n in words.items())


def rows(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 5))
def test_search_schemes(seed, letters):
    """Both searches together give every near word once or more; each alone gives those that share its exact part."""
    rng = random.Random(seed)
    alphabet = rng.sample(LETTERS, letters)
    words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(6, 8))) for _ in range(200)})
    index, want = v.Index([w.encode("latin-1") for w in words]), pairs(set(words))
    for length in {len(w) for w in words}:
        own = [w for w in words if len(w) == length]
        codes = np.array([v._CODE[np.frombuffer(w.encode("latin-1"), np.uint8)] for w in own]).astype(np.int64)
        found = defaultdict(set)
        for side, k in ((1, length // 2), (0, length - length // 2)):
            some = defaultdict(set)
            for i, j in zip(*v.near(index, codes, k, side)):
                assert words[j] not in some[own[i]]
                some[own[i]].add(words[j])
            for w in own:
                assert some[w] >= {x for x in want[w] if (x[:k] == w[:k] if side else x[-k:] == w[-k:]) and min(len(x), len(w)) >= k + 1 and len(x) >= len(w)}
                found[w] |= some[w]
        assert all(found[w] == want[w] for w in own)


def fixture():
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcdé") for _ in range(rng.randint(6, 14))) for _ in range(25)] + ["aaaaaaa", "abcabcab", "interner", "interned", "interne", "intérne"]
    noisy = []
    for i, w in enumerate(stems):
        noisy += [w] * (5 * 5 ** (i % 3))
        for _ in range(6):
            p, c = rng.randrange(len(w)), rng.choice("abcdé")
            x = rng.choice([w[:p] + w[p + 1 :], w[:p] + c + w[p:], w[:p] + c + w[p + 1 :]])
            noisy += [x] * rng.choice([3, 5, 6])
    rng.shuffle(noisy)
    docs = [(i, " ".join(w.title() if rng.random() < 0.3 else w for w in noisy[i::40])) for i in range(40)]
    odd = [(None, None), (50, None), (None, "Straße_Straße straße, STRASSE; " * 4), (51, "x1abcdefx2abcdef " * 5), (52, "É" * 300 + " " + "é" * 300), (53, "éééééé " * 5), (53, "éééééé " * 5), (54, "")]
    return docs + odd + [(55 + i, "y" * 1_500 + " " + "y" * 1_499) for i in range(6)]


@pytest.mark.parametrize(("hot", "block"), [(v.HOT, v.BLOCK), (2, 7), (0, 1000), (10**6, 3)])
def test_groups_against_brute_force(spark, hot, block):
    docs = spark.createDataFrame([(*x, "c") for x in fixture()], "doc_id long, text string, word string").repartition(3)
    assert rows(v.group(docs, hot, block)) == brute(fixture())


def test_empty_table(spark):
    assert v.group(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert rows(v.op11_spelling_variants(spark, DATA)) == brute(docs)
