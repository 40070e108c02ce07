import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import fingerprint as fp

words = st.text(alphabet="ab é\U0001f600", max_size=60)


@settings(max_examples=150, deadline=None)
@given(words, words)
def test_extensions_against_brute_force(a, b):
    p, q = fp.Prefix(a), fp.Prefix(b)
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    m = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    assert (p.extension(q, 0, 0), p.suffix(q)) == (n, m)
    assert p.equal(fp.Prefix("zz" + a), 0, 2, len(a))
    assert fp.Prefix(b, p, len(a)).fingerprint() == fp.Prefix(a + b).fingerprint()
    assert (p.fingerprint() == q.fingerprint()) == (a == b)


def test_sketch_is_the_smallest_of_all_spans():
    text = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(5000))
    p = fp.Prefix(text)
    import numpy as np

    h = fp.mod((lambda x: x ^ (x >> 15))(p.spans(np.arange(len(text) - fp.SPAN + 1), np.arange(fp.SPAN, len(text) + 1))) * 0x5BD1E995)
    assert p.sketch().tolist() == sorted(set(h.tolist()))[: fp.SKETCH]


def test_successors_against_brute_force(spark):
    rows = [(i * 3, f"text {i} " * (i % 7)) for i in range(60)] + [(9, "text 3 " * 3), (9, None), (12, "y" * 40000), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", fp.F.lit("clash")).repartition(5)
    got = sorted((-(2**63) if r.doc_id is None else r.doc_id, r.n_chars, bytes(r.edited).decode()) for r in fp.fingerprints(df, 7).collect())
    order = sorted((-(2**63) if i is None else i, t or "") for i, t in rows)
    want = sorted((i, len(t), t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2]) for k, (i, t) in enumerate(order))
    assert got == want


def test_single_and_no_document(spark, tmp_path):
    spark.createDataFrame([(1, "abcd")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    (row,) = fp.op9_fingerprints(spark, str(tmp_path)).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1.0
    assert fp.fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_likeness_against_true_jaccard(spark):
    """The columns near_edited and near_next estimate the Jaccard of the texts' sets of spans."""
    import random

    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdef ") for _ in range(3000))]
    for k in range(12):
        cut = rng.randrange(200, 2800)
        texts.append(texts[-1][:cut] + "".join(rng.choice("abcdef ") for _ in range(3000 - cut)))
    spans = lambda t: {t[i : i + fp.SPAN] for i in range(max(1, len(t) - fp.SPAN + 1))}
    jaccard = lambda a, b: len(spans(a) & spans(b)) / len(spans(a) | spans(b))
    got = {r.doc_id: r for r in fp.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    errors = []
    for k, t in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        errors += [got[k].near_edited - jaccard(t, edited), got[k].near_next - jaccard(t, after)]
    assert max(map(abs, errors)) < 0.4 and abs(sum(errors) / len(errors)) < 0.06


def test_ranges_are_those_of_a_scan(spark):
    ends = [-5, 0, 3, 4, 10, 11, 50]
    df = spark.createDataFrame([(v,) for v in range(-5, 60)], "v long")
    got = df.select("v", fp._range_of(fp.F.col("v"), ends).alias("r")).collect()
    assert all(r.r == sum(e <= r.v for e in ends) - 1 for r in got)
