import re

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from strata.llm import byte_bpe, language, near_dup, pii
from tests.llm.test_decontaminate import ITEMS
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_near_dup import brute as same

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = [(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "12 34 !!", "en", "s", 8), (10**6 + 3, "The mail of a.b@c.example.com is here, and 4845168114407329.", "en", "s", 60), (10**6 + 4, "the quick brown fox " * 9000, "en", "s", 180000)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    docs = docs.unionByName(docs.where("doc_id % 9 = 0"))
    # extra columns, under names such as the operators use
    docs = docs.withColumns({"_x": F.lit(1), "_x_words": F.lit("w"), "h": F.lit(2), "ids": F.lit("i"), "score": F.col("doc_id") / 2, "none": F.lit(None).cast("string")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text")
    bench.unionByName(spark.createDataFrame([(i + 10**6, t) for i, t in ITEMS[:1]], bench.schema)).write.parquet(str(tmp_path / "benchmark.parquet"))
    items = [(r.item_id, r.text) for r in spark.read.parquet(str(tmp_path / "benchmark.parquet")).collect()]

    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        before, now = now, spark.read.parquet(str(tmp_path / name))
        seen.append((before.collect(), now.collect()))
        assert k == len(cp.STAGES) - 1 or now.columns == docs.columns

    before, after = seen[0]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {10**6, 10**6 + 1, 10**6 + 2}
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    guess = frame.select("doc_id", "lang", "score", language.predict(language.fit(frame), F.col("text")).alias("g")).collect()
    kept = sorted((r.doc_id, r.lang or r.g.lang, r.score) for r in guess if r.g.lang != language.UND and r.g.score >= cp.LEAST_SCORE)
    assert sorted((r.doc_id, r.lang, r.score) for r in after) == kept
    before, after = seen[1]
    group = same(sorted({(r.doc_id, r.text) for r in before}))
    assert sorted(r.doc_id for r in after) == sorted(set(group.values()))
    before, after = seen[2]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not contaminated(r.text, items, 10)[1])
    before, after = seen[3]
    text = {r.doc_id: r.text for r in before}
    assert all((r._x, r._x_words, r.h, r.ids, r.none) == (1, "w", 2, "i", None) for r in after)
    for r in after:
        assert not any(pii.valid(k, m[0]) for k in pii.KINDS for m in pii.PATTERNS[k].finditer(r.text)) and r.n_chars == len(r.text)
        assert pii.base_spans(text[r.doc_id]) or r.text == text[r.doc_id] or re.search("<(email|ip|card|phone)>", r.text)
    before, after = seen[4]
    ref = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe._ranks(byte_bpe.default_path()), special_tokens={})
    text = {r.doc_id: r.text for r in before}
    assert sorted(text) == sorted(r.doc_id for r in after)
    assert all(np.frombuffer(bytes(r.ids), "<u4").tolist() == ref.encode_ordinary(text[r.doc_id]) for r in after)


def test_run_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).collect() == []
    assert language.UND == "und" and near_dup.SIMILARITY == 0.8
