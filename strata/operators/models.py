"""Models on top of the vault and the lake: versions, facts, calendar, materialisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.text import AUDIT, text_of

#: Versions of a key among which a fact looks for its own.
VERSIONS = 64
#: Beginnings of stretches that are sent to every executor at most.
BROADCAST = 1_000_000


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """md5 of the trimmed texts of columns joined by ||; null counts as empty."""
    return F.md5(F.concat_ws("||", *(F.coalesce(F.trim(text_of(df, c)), F.lit("")) for c in columns)))


def scd2(changes: DataFrame, keys: list[str], attributes: list[str], ts: str, order: list[str] | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """sk, keys, attributes, valid_from, valid_to, is_current, row_hash of every version.

    One row per key and time: a delete wins, then the latest by `order`, then by hash. `deletes` (keys, ts) close
    versions. sk is md5 of keys and valid_from, so rebuilding gives the same keys.
    """
    order = order or []
    rows = changes.select(*(F.trim(text_of(changes, k)).alias(k) for k in keys), *attributes, F.col(ts).alias("valid_from"), row_hash(changes, attributes).alias("row_hash"), *(F.col(o).alias(f"_o{i}") for i, o in enumerate(order)), F.lit(False).alias("_gone"))
    if deletes is not None:
        gone = deletes.select(*(F.trim(text_of(deletes, k)).alias(k) for k in keys), F.col(ts).alias("valid_from"), F.lit(True).alias("_gone"))
        rows = rows.unionByName(gone, allowMissingColumns=True)
    best = F.struct(F.col("_gone"), *(f"_o{i}" for i in range(len(order))), F.coalesce("row_hash", F.lit("")))
    rows = rows.groupBy(*keys, "valid_from").agg(F.max_by(F.struct("_gone", "row_hash", *attributes), best).alias("r")).select(*keys, "valid_from", "r.*")
    over = Window.partitionBy(*keys).orderBy("valid_from")
    rows = rows.withColumn("_h", F.when(F.col("_gone"), F.lit("deleted")).otherwise(F.col("row_hash")))
    rows = rows.withColumn("_b", F.lag("_h").over(over)).where(~F.col("_h").eqNullSafe(F.col("_b")))
    rows = rows.withColumn("valid_to", F.lead("valid_from").over(over)).where("not _gone")
    sk = F.md5(F.concat_ws("||", *keys, F.col("valid_from").cast("string")))
    return rows.select(sk.alias("sk"), *keys, *attributes, "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current"), "row_hash")


def with_hub_keys(satellite: DataFrame, hub: DataFrame, entity: str) -> DataFrame:
    """A satellite with its hub's business keys."""
    hk = f"hk_{entity}"
    keys = [c for c in hub.columns if c != hk and c not in ("load_date", "record_source", "_batch_id")]
    return satellite.join(hub.select(hk, *keys), hk)


def _history(dimension: DataFrame, on: dict[str, str], carry: dict[str, str], each: int) -> tuple[DataFrame, DataFrame]:
    """A dimension's versions with their keys as text and numbered stretches of `each` versions; and, for keys that have
    several stretches, when each but the first begins. Versions of a key don't overlap, so a time lies in one stretch."""
    keys = [f"_d{i}" for i in range(len(on))]
    columns = {"_from": F.col("valid_from").cast("timestamp"), "_to": F.col("valid_to").cast("timestamp"), "_sk": F.col("sk")}
    columns |= {f"_c{i}": F.col(c) for i, c in enumerate(carry.values())}
    rows = dimension.select(*(text_of(dimension, d).alias(k) for k, d in zip(keys, on.values())), *(c.alias(n) for n, c in columns.items()))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_from", F.asc_nulls_last("_to")))
    rows = rows.withColumn("_part", F.floor((nth - 1) / each).cast("int"))
    first = rows.where("_part > 0").groupBy(*keys, "_part").agg(F.min("_from").alias("_from"))
    return rows, first.groupBy(*keys).agg(F.collect_list("_from").alias("_starts"))


def lookup(fact: DataFrame, dimension: DataFrame, on: dict[str, str], out: str, as_of: str | None = None, carry: dict[str, str] | None = None, each: int = VERSIONS) -> DataFrame:
    """fact, `out` (the dimension's sk: valid at `as_of`, or current without it; '-1' where there is none) and carried columns.

    `carry`: dimension columns by the names they get, so that no second join is needed. As of a time, facts and versions
    are joined by key and stretch of the key's history, and a version must be valid then. A key with a large share of the
    facts is a skewed join, which Spark splits at run time wherever it likes. Where keys have more than `each` versions
    (the dimension is asked for that first), their facts find the stretch before, so a fact meets at most `each` versions;
    the stretches' beginnings are broadcast only after a count.
    """
    carry = carry or {}
    keys = [f"_d{i}" for i in range(len(on))]
    mine = {k: text_of(fact, f) for k, f in zip(keys, on)}
    found = ["_sk", *(f"_c{i}" for i in range(len(carry)))]
    if not as_of:
        now = dimension.where("is_current")
        now = now.select(F.col("sk").alias("_sk"), *(text_of(now, d).alias(k) for k, d in zip(keys, on.values())), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry.values())))
        joined = fact.join(now, reduce(Column.__and__, (mine[k] == F.col(k) for k in keys)), "left")
    else:
        versions, starts = _history(dimension, on, carry, each)
        facts = fact.withColumns({f"_k{k}": c for k, c in mine.items()} | {"_at": F.col(as_of).cast("timestamp")})
        same = lambda other: [F.col(f"_k{k}") == other[k] for k in keys]
        if long := starts.agg(F.sum(F.size("_starts"))).first()[0]:
            facts = facts.join(F.broadcast(starts) if long <= BROADCAST else starts, same(starts), "left").drop(*keys)
            facts = facts.withColumn("_at_part", F.coalesce(F.size(F.filter("_starts", lambda t: t <= F.col("_at"))), F.lit(0))).drop("_starts")
        else:  # a key of the join that isn't a literal: so both sides are shuffled for the join alone, which Spark can split then
            facts = facts.withColumn("_at_part", F.when(F.col("_at").isNull(), -1).otherwise(0))
        valid = (F.col("_at") >= versions["_from"]) & ((F.col("_at") < versions["_to"]) | versions["_to"].isNull())
        joined = facts.join(versions, [*same(versions), F.col("_at_part") == versions["_part"], valid], "left")
    return joined.select(*(f"`{c}`" for c in fact.columns), F.coalesce(found[0], F.lit("-1")).alias(out), *(F.col(f"_c{i}").alias(n) for i, n in enumerate(carry)))


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row per day."""
    day = F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("date")
    d, iso = F.col("date"), F.weekday("date") + 1
    return spark.range(1).select(day).select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), "date", F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.date_format(d, "MMMM").alias("month_name"),
        F.dayofmonth(d).alias("day"), iso.alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"), F.weekofyear(d).alias("week"), (iso >= 6).alias("is_weekend"),
    )


def promote(bronze: DataFrame) -> DataFrame:
    """Bronze without its audit columns."""
    return bronze.drop(*AUDIT)
