"""Table writes: audit columns, storage types, conforming, merge. Versioned tables are in `versions`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.text import AUDIT


def with_audit(df: DataFrame, load_ts, source: str, batch_id: str, file: Column | None = None) -> DataFrame:
    """The four audit columns at the end, in the place of any the source brings."""
    audit = {"_load_ts": F.lit(load_ts).cast("timestamp"), "_source": F.lit(source), "_batch_id": F.lit(batch_id)}
    return df.drop(*AUDIT).withColumns(audit | {"_file": file if file is not None else F.lit(None).cast("string")})


def storable(df: DataFrame) -> DataFrame:
    """void, time and interval columns as text."""
    text = (T.NullType, T.DayTimeIntervalType, T.YearMonthIntervalType)
    return df.select(*(F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, text) or f.dataType.typeName().startswith("time(") else F.col(f.name) for f in df.schema))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns cast to a table's types; a value that the cast would change, or a text that isn't one, is an error. Columns the table lacks stay."""
    kinds = {f.name: f.dataType for f in schema}

    def one(f: T.StructField) -> Column:
        c = F.col(f.name)
        if f.name not in kinds or f.dataType == kinds[f.name]:
            return c
        to = c.try_cast(kinds[f.name])
        same = to.isNotNull() if isinstance(f.dataType, T.StringType) else F.coalesce(to.try_cast(f.dataType) == c, F.lit(False))
        lost = c.isNotNull() & ~same
        return F.when(lost, F.raise_error(F.concat(F.lit(f"{f.name}: not a {kinds[f.name].simpleString()}: "), c.cast("string"))).cast(kinds[f.name])).otherwise(to).alias(f.name)

    return df.select(*(one(f) for f in df.schema))


def append(target: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Rows of both; columns that one lacks are null."""
    return batch if target is None else target.unionByName(batch, allowMissingColumns=True)


def last_per_key(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """Of each key (null is a key of its own) the last row by `order_by`, which must be given: frames have no order."""
    if not order_by:
        raise ValueError("last_per_key needs order_by")
    return df.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in df.columns if c not in keys)), F.struct(*order_by)).alias("r")).select(*keys, "r.*").select(df.columns)


def merge(target: DataFrame | None, source: DataFrame, keys: list[str], delete_flag: str | None = None) -> DataFrame:
    """The target after updating matches and inserting the rest; source keys must be unique.

    A null key never matches: it is inserted. Columns the source lacks keep the target's values. With
    `delete_flag` a flagged match is deleted, a flagged other row ignored; the flag isn't stored.
    """
    flag = F.coalesce(F.col(delete_flag), F.lit(False)) if delete_flag else F.lit(False)
    src = source.withColumn("_gone", flag).drop(*([delete_flag] if delete_flag else []))
    if target is None:
        return src.where("not _gone").drop("_gone")
    columns = [*target.columns, *(c for c in src.columns if c not in [*target.columns, "_gone"])]
    s = src.select(*(F.col(c).alias(f"_s_{c}") for c in src.columns if c != "_gone"), "_gone", F.lit(True).alias("_src"))
    t = target.withColumn("_tgt", F.lit(True))
    same = reduce(Column.__and__, (t[k] == s[f"_s_{k}"] for k in keys))
    joined = t.join(s, same, "full_outer").where(~F.coalesce("_gone", F.lit(False)))
    pick = [(F.when(F.col("_src"), F.col(f"_s_{c}")).otherwise(F.col(c)) if c in target.columns else F.col(f"_s_{c}")).alias(c) if c in src.columns else F.col(c) for c in columns]
    return joined.select(*pick)
