import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strata.llm import packing
from strata.llm.token_files import default_path

PATH = default_path()
REF = Tokenizer.from_file(PATH)
DATA = "/root/testdata/sf0.001"


def plain(text):
    return [*REF.encode(text or "", add_special_tokens=False).ids, packing.END]


def cost(at, fee, chosen, length):
    sizes = np.diff(at[chosen])
    assert chosen[0] == 0 and chosen[-1] == len(at) - 1 and sizes.max() <= length
    return sum(0 if n & (n - 1) == 0 else length - n for n in sizes.tolist()) + int(fee[chosen[1:]].sum())


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([16, 64, 256]))
def test_cuts_cost_least(seed, length):
    """Against all pairs of places."""
    rng = np.random.default_rng(seed)
    at = np.concatenate([[0], np.cumsum(rng.integers(1, 1 + length // int(rng.integers(1, 6)), int(rng.integers(1, 60))))])
    fee = rng.integers(0, 30, len(at))
    best = [0] + [10**9] * (len(at) - 1)
    for i in range(1, len(at)):
        for j in range(i):
            if (n := int(at[i] - at[j])) <= length:
                best[i] = min(best[i], best[j] + (0 if n & (n - 1) == 0 else length - n) + int(fee[i]))
    assert cost(at, fee, packing.cuts(at, fee, length), length) == best[-1]


def check(rows, docs, length):
    """Each id in one piece, sequences gapless, in order and not too long; the ids are the library's."""
    want = sorted(((d is not None, d or 0, zlib.crc32(np.array(plain(t), "<u4").tobytes())) for d, t in docs))
    rows = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    whole, at, seq, pad = [], 0, None, 0
    for r in rows:
        if r.sequence_id != seq:
            pad += 0 if at & (at - 1) == 0 else length - at
            at, seq = 0, r.sequence_id
        assert r.offset == at and r.length > 0 and len(r.ids) == 4 * r.length
        at += r.length
        assert at <= length
        if r.start == 0:
            whole.append((r.doc_id, r.doc_tokens, bytearray()))
        assert whole[-1][:2] == (r.doc_id, r.doc_tokens) and len(whole[-1][2]) == 4 * r.start
        whole[-1][2].extend(r.ids)
    assert all(4 * n == len(x) for _, n, x in whole)
    assert sorted((d is not None, d or 0, zlib.crc32(x)) for d, _, x in whole) == want
    assert [(d is not None, d or 0) for d, _, _ in whole] == sorted((d is not None, d or 0) for d, _, _ in whole)
    return pad + (0 if at & (at - 1) == 0 else length - at)


def texts():
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh é東") for _ in range(rng.randint(2, 9))) + rng.choice(["", "", ".", "!)", "?"]) for _ in range(n))
    odd = [(1, None), (2, ""), (None, "no id. none."), (None, None), (3, "a<|endoftext|>b <|startoftext|>"), (4, "<|ENDOFTEXT|> is text"), (5, "same. text"), (5, "same. text"), (5, "other")]
    return odd + [(10 + i, say(rng.choice([3, 40, 700]))) for i in range(60)] + [(200, "word " * 9000), (201, "x. " * 5000), (202, "|" * 3000)]


@pytest.mark.parametrize(("length", "stretch", "ranges"), [(4096, 1 << 19, 2), (256, 2000, 3), (64, 1, 1)])
def test_pieces_against_the_library(spark, length, stretch, ranges):
    docs = spark.createDataFrame([(*x, i) for i, x in enumerate(texts())], "doc_id long, text string, offset int").repartition(4)
    rows = packing.pack(docs, PATH, length, stretch=stretch, ranges=ranges).collect()
    total = sum(r.length for r in rows)
    assert check(rows, texts(), length) <= max(0.05 * total, ranges * length // 4)


def test_sequences(spark):
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    pieces = packing.pack(docs, PATH, 256, ranges=1)
    rows = sorted(packing.sequences(pieces, 256).collect())
    assert b"".join(r.ids for r in rows) == b"".join(r.ids for r in sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset)))
    for r in rows:
        n = len(r.ids) // 4
        assert r.n_tokens == n <= 256 and r.padding == (0 if n & (n - 1) == 0 else 256 - n)
        assert len(r.doc_ids) == len(r.starts) and r.starts == sorted(set(r.starts)) and r.starts[0] == 0


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_query_pads_little(spark):
    rows = packing.op12_packing(spark, DATA).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    ends = {}
    for r in rows:
        ids = np.array(plain(docs[r.doc_id])[r.start : r.start + r.length], "<u4")
        assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(ids.tobytes()), len(plain(docs[r.doc_id])))
        ends[r.sequence_id] = max(ends.get(r.sequence_id, 0), r.offset + r.length)
    total, padded = sum(ends.values()), sum(n if n & (n - 1) == 0 else 4096 for n in ends.values())
    assert total == sum(len(plain(t)) for t in docs.values()) and padded <= 1.02 * total
