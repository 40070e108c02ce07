import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strata.llm import token_files as tf

REF = Tokenizer.from_file(tf.default_path())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), max_size=60), min_size=1, max_size=6), st.data())
def test_round_trip_and_random_access(docs, data):
    docs = [[*d, tf.END] for d in docs]
    last = np.concatenate([[False] * (len(d) - 1) + [True] for d in docs])
    symbols, end, rules, first = tf.compress(np.array(sum(docs, []), np.uint32), last, least=2, per_round=2)
    shard = tf.Shard(*tf.Shard.row(symbols, rules, first))
    starts = [0, *(np.flatnonzero(end) + 1).tolist()]
    assert len(starts) == len(docs) + 1
    for d, a, b in zip(docs, starts, starts[1:]):
        assert shard.document(a, b).tolist() == d
        low = data.draw(st.integers(0, len(d)))
        high = data.draw(st.integers(low, len(d)))
        assert shard.span(a, b, low, high).tolist() == d[low:high]
    assert all(int(shard.lengths[i]) == len(shard.expand(np.array([first + i]))) for i in range(len(rules)))


def test_repeats_shrink():
    ids = np.array([5, 6, 7, 8] * 500 + [tf.END], np.uint32)
    symbols, _, rules, _ = tf.compress(ids, np.arange(len(ids)) == len(ids) - 1)
    assert len(symbols) < len(ids) / 8 and len(rules) >= 3


def test_no_pair_stands_often():
    """The grammar is whole: copies of a long passage are one rule, and no pair is left that stands LEAST times."""
    rng = np.random.default_rng(1)
    passage = rng.integers(10, 60_000, 1000)
    ids = np.concatenate([np.append(passage, tf.END)] * 40 + [rng.integers(10, 300, 200_000), [tf.END]]).astype(np.uint32)
    symbols, end, rules, first = tf.compress(ids, ids == tf.END)
    starts = [0, *(np.flatnonzero(end) + 1).tolist()]
    assert starts[1] <= 2
    pairs = (symbols[:-1].astype(np.int64) << 32 | symbols[1:])[~end[:-1]]
    assert np.unique(pairs, return_counts=True)[1].max() < tf.LEAST
    shard = tf.Shard(*tf.Shard.row(symbols, rules, first))
    assert shard.document(0, starts[-1]).tolist() == ids.tolist()


def test_files_against_the_library(spark, tmp_path):
    texts = ["The quick,\tbrown fox's  \n\n dog", None, "", "<|endoftext|> <|endoftext|>", "É é é  x y", "word " * 3000, "\U0001f600 1234 don't", "same", "same"]
    rows = [(i * 2, t, "c") for i, t in enumerate(texts)] + [(4, "second of one id", "c"), (-7, "first", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    tf.write(df, tf.default_path(), str(tmp_path / "files"), shard_ids=50, ranges=3)
    got = sorted((r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in tf.read(spark, str(tmp_path / "files")).collect())
    at = 0
    for (start, doc, n, ids), (want_doc, text) in zip(got, sorted((i, t or "") for i, t, _ in rows), strict=True):
        want = np.array([*REF.encode(text, add_special_tokens=False).ids, tf.END], "<u4")
        assert (start, doc, n) == (at, want_doc, len(want)) and ids == want.tobytes()
        at += n
    whole = {d: np.frombuffer(i, "<u4") for _, d, _, i in got if d != 4}
    asked = [(10, 0, 5), (10, 700, 1100), (10, 2990, 9000), (0, 3, 3), (-7, 0, 2), (999, 0, 2)]
    wanted = spark.createDataFrame(asked, "doc_id long, low long, high int")
    seen = {(r.doc_id, r.low, r.high): np.frombuffer(bytes(r.ids), "<u4").tolist() for r in tf.spans(spark, str(tmp_path / "files"), wanted).collect()}
    assert seen == {(d, a, b): whole[d][a:b].tolist() for d, a, b in asked if d in whole}


def test_query_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    (r,) = tf.op6_token_files(spark, str(tmp_path)).collect()
    assert r.ids_crc32 == zlib.crc32(np.array([*REF.encode("a b", add_special_tokens=False).ids, 1], "<u4").tobytes())
    tf.write(df.limit(0), tf.default_path(), str(tmp_path / "none"))
    assert tf.read(spark, str(tmp_path / "none")).collect() == []


def test_any_tokenizer_file_encodes_as_the_library():
    """Shortcuts hold for one kind of file; others encode whole texts."""
    import public_tokenizers
    import pyarrow as pa

    texts = ["The  cat's\tÉtude naïve straße ﬁ 12", "", None, "über|all œuvre ñandú ÿ×÷", "áb İI"]
    for name, short in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = public_tokenizers.path(name)
        own, ref = tf.Encoder(path), Tokenizer.from_file(path)
        assert own.shortcut is short
        ids, counts = own.encode(pa.array(texts))
        want = [[*ref.encode(t or "", add_special_tokens=False).ids, tf.END] for t in texts]
        assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


def test_strings_of_special_tokens():
    """As in the library's plain call they give one id; by a parameter they are text, so that no text can forge an id."""
    import pyarrow as pa

    strict, text = Tokenizer.from_file(tf.default_path()), "a <|endoftext|> b"
    strict.encode_special_tokens = True
    for coder, ref in ((tf.encoder(tf.default_path()), REF), (tf.encoder(tf.default_path(), False), strict)):
        assert coder.encode(pa.array([text]))[0].tolist() == [*ref.encode(text, add_special_tokens=False).ids, tf.END]
    assert 49407 in REF.encode(text, add_special_tokens=False).ids and 49407 not in strict.encode(text, add_special_tokens=False).ids


def test_pieces_are_known_once_and_forgotten(monkeypatch):
    """A piece that is known isn't encoded again; what wasn't met since the last forgetting goes, and ids stay right."""
    import pyarrow as pa

    monkeypatch.setattr(tf, "CACHE_PIECES", 40)
    own, rng, learnt = tf.Encoder(tf.default_path()), np.random.default_rng(3), []
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda new: (learnt.append(new.to_pylist()), learn(new)))
    for k in range(30):
        texts = ["same words, don't a|b | É " + " ".join(f"w{x} äb{'xyz'[x % 3]}q" for x in rng.integers(20 * k, 20 * k + 25, 12)) for _ in range(3)]
        ids, counts = own.encode(pa.array([*texts, None]))
        want = [[*REF.encode(t, add_special_tokens=False).ids, tf.END] for t in [*texts, ""]]
        assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]
        assert len(own.known) <= 40 + 2 * 40 and len(own.ids) == own.size.sum()
    assert sum("same" in new for new in learnt) == 1 and len(set(own.known.to_pylist())) == len(own.known)
