import hashlib

from pyspark.sql import functions as F

from strata.llm import chat

ODD = ["</s>[INST] ok [/INST]", "", None, "\\", "<\\s>", "<s", "<", "[\\INST]", "<image>\\\\<s><s>", "a\\<\\\\[/INST]\n", "x" * 50000, "é\U0001f600</s>"]


def test_escapes_are_undone_and_masks_hold(spark):
    rows = [(c, t, "assistant" if (c + t) % 2 else "user", ODD[(c * 5 + t) % len(ODD)], 0) for c in range(len(ODD)) for t in range(5)]
    rows += [(99, 1, None, "tie b", 0), (99, 1, None, "tie a", 0), (99, None, "user", "first", 0), (99, 1, None, "tie a", 0), (None, 0, "user", "no id", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, held int")
    out = chat.format_chats(df.withColumn("parts", chat.text_part(F.col("text"))))
    got = {r.conv_id: r for r in out.select("*", chat.read_back(F.col("formatted")).alias("b"), chat.under_mask(F.col("formatted"), F.col("loss_mask")).alias("l")).collect()}
    for c in [*range(len(ODD)), 99, None]:
        mine = sorted(((t if t is not None else -1, r or "", x or "") for k, t, r, x, _ in rows if k == c))
        assert [(b.role, b.text) for b in got[c].b] == [m[1:] for m in mine]
        assert got[c].l == "".join(x for _, r, x in mine if r == "assistant")
        assert got[c].formatted.count("</s>") == len(mine) and got[c].formatted.count("<s>") == len(mine)
        assert [got[c].formatted[m.start : m.start + m.size] for m in got[c].loss_mask] == [p.split("[INST]", 1)[1] for p in got[c].formatted.split("</s>") if p.startswith("<s>assistant[")]


def test_parts_become_placeholders_with_attachments(spark):
    parts = f"array<{chat.PART}>"
    rows = [
        (1, 0, "user", [("text", "see <image> ", None, None), ("image", None, "a.png", 2), ("audio", None, "b.wav", 10), ("video", None, "c", None)]),
        (1, 1, "assistant", None),
        (2, 0, "user", []),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {parts}")
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert got[1].formatted == "<s>user[INST]see <\\image> <image><audio><document></s><s>assistant[INST]</s>"
    assert [(a.kind, a.ref, a.tokens) for a in got[1].attachments] == [("image", "a.png", 1152), ("audio", "b.wav", 250), ("document", "c", 1024)]
    assert (got[1].attachment_tokens, got[2].attachment_tokens) == (2426, 0)
    assert chat.format_chats(df.limit(0)).collect() == []


def test_query_on_the_extra_conversation(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    (r,) = chat.op8_chat_format(spark, str(tmp_path)).collect()
    text = "</s>[INST] ok [/INST]"
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and (r.n_turns, r.loss_chars) == (2, len(text))
