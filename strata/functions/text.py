"""Text forms and hashes that keys and change detection rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUDIT = ("_load_ts", "_source", "_batch_id", "_file")


def text_of(df: DataFrame, name: str) -> Column:
    """A column as text; doubles without exponents between 1e-4 and 1e16, so that engines agree."""
    c = F.col(name)
    if df.schema[name].dataType.typeName() not in ("double", "float"):
        return c.cast("string")
    plain = (F.abs(c) >= 1e-3) & (F.abs(c) < 1e7) | (c == 0)
    wide = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", ".0")
    return F.when(plain, c.cast("string")).when((F.abs(c) >= 1e-4) & (F.abs(c) < 1e16), wide).otherwise(c.cast("string"))


def norm(text: Column, upper: bool) -> Column:
    """Trimmed text, empty for null."""
    return F.coalesce(F.upper(F.trim(text)) if upper else F.trim(text), F.lit(""))


def key_text(df: DataFrame, columns: list[str]) -> Column:
    """The upper-cased, trimmed values joined by ||: what a hash key is made of."""
    return F.concat_ws("||", *(norm(text_of(df, c), True) for c in columns))


def hash_key(df: DataFrame, columns: list[str]) -> Column:
    """sha1 of the key text."""
    return F.sha1(key_text(df, columns))


def hashdiff(df: DataFrame, columns: list[str]) -> Column:
    """sha1 of the trimmed values joined by ||, without trailing bars: added empty columns don't version a row."""
    return F.sha1(F.regexp_replace(F.concat_ws("||", *(norm(text_of(df, c), False) for c in columns)), r"\|+$", ""))
