import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import byte_bpe as bb

PATH = bb.default_path()
REF = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bb._ranks(PATH), special_tokens={})


def test_chunked_encoding_equals_library(spark):
    texts = [None, "", "  two  spaces \n\n x", "It's we'll  " * 40, "x" * 300, "été 日本 \U0001f600 " * 30, " " * 200 + "a" + "\n" * 90]
    rows = [(i, t, 9) for i, t in enumerate(texts)] + [(3, texts[3], 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bb.decode(bb.encode(df, PATH, chunk_chars=50, overlap_chars=24), PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        want = REF.encode_ordinary(texts[r.doc_id] or "")
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want
        assert bytes(r.decoded).decode() == (texts[r.doc_id] or "")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab '\n1é.srelv", max_size=80))
def test_stitch_is_a_true_boundary(text):
    border = 20
    if len(text) > border and (at := bb.stitch(bb.codec(PATH).scan, text, border)) is not None:
        ends = {m.end() for m in bb.codec(PATH).scan.finditer(text)}
        assert at in ends


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bb.encode(df, PATH).collect() == []


def test_query_digests(spark, tmp_path):
    df = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in bb.op10_byte_bpe(spark, str(tmp_path)).collect()}
    assert got[1].decoded_sha256 == hashlib.sha256(b"hello world").hexdigest()
    assert (got[2].n_tokens, got[2].ids_sha256) == (0, hashlib.sha256(b"").hexdigest())
