r"""Chat formatting: a visitor flattens typed content parts, a template marks turns, control strings are escaped.

A turn is `<s>` role `[INST]` content `</s>`. Content is its parts in order: text escaped, other parts as
placeholders `<image>`, `<audio>`, `<document>`; the n-th placeholder of a conversation belongs to its n-th
attachment, which records reference and expanded token count.

Escaping puts a backslash behind the first character of a control string and doubles backslashes, so no
control string remains; dropping the backslash behind each `<`, `[` or `\` that has one undoes it.

Null text is an empty text, null parts are none, unknown kinds are treated as documents. Turns go by turn
number, ties by role and content; repeated rows are all kept. A conversation is one string by contract, so its
turns meet in one row; everything else is done turn by turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import table

PART = "struct<kind: string, text: string, ref: string, units: int>"
#: Tokens that one unit (tile, second, page) of an attachment expands to.
TOKENS = {"image": 576, "audio": 25, "document": 1024}
CONTROL = r"\\|<(?=(?:/?s|image|audio|document)>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def text_part(text: Column) -> Column:
    """Parts of a plain text: one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))


def _kind(part: Column) -> Column:
    return F.when(part["kind"].isin("text", *TOKENS), part["kind"]).otherwise("document")


def visit(parts: Column) -> tuple[Column, Column]:
    """Content string and attachments array<struct<kind, ref, tokens>> of an array of PART."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    content = F.array_join(F.transform(parts, lambda p: F.when(_kind(p) == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), _kind(p), F.lit(">")))), "")
    each = F.create_map(*(F.lit(x) for kv in TOKENS.items() for x in kv))
    held = F.transform(F.filter(parts, lambda p: _kind(p) != "text"), lambda p: F.struct(_kind(p).alias("kind"), p["ref"].alias("ref"), (each[_kind(p)] * F.coalesce(p["units"], F.lit(1))).alias("tokens")))
    return content, held


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask array<struct<start, size>> (code points, from 0: assistant contents), attachments, attachment_tokens."""
    content, held = visit(F.col("parts"))
    role = F.coalesce(F.col("role"), F.lit(""))
    turn = turns.select("conv_id", "turn", role.alias("role"), content.alias("content"), held.alias("held"))
    turn = turn.select("conv_id", F.struct("turn", "role", "content", (F.length(escape(F.col("role"))) + 9).alias("before"), (F.length("content")).alias("size"), "held").alias("t"))
    chat = turn.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    formatted = F.array_join(F.transform("t", lambda t: F.concat(F.lit("<s>"), escape(t["role"]), F.lit("[INST]"), t["content"], F.lit("</s>"))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, size: int>>").alias("spans"))
    spans = F.aggregate(
        "t",
        start,
        lambda a, t: F.struct(
            (a["at"] + t["before"] + t["size"] + 4).alias("at"),
            F.when(t["role"] == "assistant", F.concat(a["spans"], F.array(F.struct((a["at"] + t["before"]).alias("start"), t["size"].alias("size"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    attachments = F.flatten(F.transform("t", lambda t: t["held"]))
    out = chat.select("conv_id", formatted.alias("formatted"), spans.alias("loss_mask"), attachments.alias("attachments"))
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.expr("0L"), lambda a, x: a + x["tokens"]))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation, escapes undone (placeholders stay)."""
    pieces = F.filter(F.split(formatted, "</s>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "[INST]", 1)
        return F.struct(unescape(F.substr(role, F.lit(4))).alias("role"), unescape(F.substr(p, F.length(role) + 7)).alias("text"))

    return F.transform(pieces, turn)


def under_mask(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(formatted, m["start"] + 1, m["size"]))), "")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    odd = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), odd.alias("text"))
    chats = format_chats(rows.unionByName(extra).withColumn("parts", text_part(F.col("text"))))
    back, loss = read_back(F.col("formatted")), under_mask(F.col("formatted"), F.col("loss_mask"))
    chats = chats.select("conv_id", back.alias("back"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )


ORACLE = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '</?s>|\[/?INST\]|<image>|<audio>|<document>')) as size,
  length(role) + 9 as before from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(before + size + 4) as bigint) as formatted_chars
from e group by conv_id
"""
