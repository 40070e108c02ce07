"""Data Vault loads: insert-only hubs, links and satellites, point-in-time and bridge tables.

Every load is a function of a staged source and the target so far, and returns the rows to add. Running it
again on the same source adds nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.text import hash_key, hashdiff, key_text, norm, text_of

TRAILER = ("load_date", "record_source", "_batch_id")


def stage(df: DataFrame, name: str, record_source: str | None = None) -> DataFrame:
    """Adds load_date (source time, else load time), record_source and _batch_id."""
    if "_load_ts" not in df.columns:
        raise ValueError(f"{name} has no _load_ts")
    at = F.coalesce("_source_ts", "_load_ts") if "_source_ts" in df.columns else F.col("_load_ts")
    if record_source is not None:
        origin = F.lit(record_source)
    else:
        origin = F.coalesce(F.col("_source"), F.lit(name)) if "_source" in df.columns else F.lit(name)
    batch = F.col("_batch_id") if "_batch_id" in df.columns else F.lit(None).cast("string")
    return df.withColumns({"load_date": at, "record_source": origin, "_batch_id": batch})


def _need(df: DataFrame, columns: list[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"unknown columns: {', '.join(missing)}")


def _with_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(Column.__and__, (F.col(c).isNotNull() for c in columns)))


def _first(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Of each key the row that comes first by (load_date, _batch_id): an aggregate, so combined before the shuffle.

    One struct has the order and the rest, so a row's values are shuffled once. Its columns are short texts: hashes, which
    don't compress, are made of what is left.
    """
    order = ("load_date", "_batch_id")
    best = F.min(F.struct(*order, *(c for c in columns if c not in order))).alias("r")
    return df.groupBy(key).agg(best).select(key, "r.*")


def narrowed(target: DataFrame | None, rows: DataFrame, keys: list[str], small: bool) -> DataFrame | None:
    """The target's rows of the keys in `rows`, if those are few: the target is filtered where it is read, and never shuffled."""
    return target if target is None or not small else target.join(rows.select(*keys).distinct(), keys, "left_semi")


def hub(source: DataFrame, entity: str, keys: list[str], target: DataFrame | None = None, small: bool = False) -> DataFrame:
    """hk_<entity>, keys as trimmed text, trailer: keys not in the target. Rows with a null key are left out."""
    _need(source, keys)
    hk = f"hk_{entity}"
    rows = _with_keys(source, keys).select(key_text(source, keys).alias(hk), *(F.trim(text_of(source, k)).alias(k) for k in keys), *TRAILER)
    rows = _first(rows, hk, [*keys, *TRAILER]).select(F.sha1(hk).alias(hk), *keys, *TRAILER)
    target = narrowed(target, rows, [hk], small)
    return rows if target is None else rows.join(target.select(hk), hk, "left_anti")


def link(source: DataFrame, name: str, roles: dict[str, list[str]], target: DataFrame | None = None, small: bool = False) -> DataFrame:
    """hk_<name>, one hk_<role> per role, trailer. A null key leaves the row out."""
    keys = [k for r in roles.values() for k in r]
    _need(source, keys)
    hk = f"hk_{name}"
    ends = [f"hk_{role}" for role in roles]
    parts = [key_text(source, cols).alias(end) for end, cols in zip(ends, roles.values())]
    rows = _with_keys(source, keys).select(key_text(source, keys).alias(hk), *parts, *TRAILER)
    rows = _first(rows, hk, [*ends, *TRAILER]).select(*(F.sha1(c).alias(c) for c in (hk, *ends)), *TRAILER)
    target = narrowed(target, rows, [hk], small)
    return rows if target is None else rows.join(target.select(hk), hk, "left_anti")


def _versions(rows: DataFrame, key: list[str], target: DataFrame | None, keep: list[str]) -> DataFrame:
    """Rows whose hashdiff differs from the one before.

    Before: the batch's previous row, else the target's latest strictly earlier row (two look-backs over
    the union; one look-back over both would miss that the batch goes first).
    """
    rows = rows.groupBy(*key, "load_date").agg(F.max_by(F.struct(*keep), F.struct(F.coalesce("_batch_id", F.lit("")), F.col("hashdiff"))).alias("r")).select(*key, "load_date", "r.*")
    over = Window.partitionBy(*key).orderBy("load_date")
    if target is None:
        seen = rows.withColumn("_before", F.lag("hashdiff").over(over)).withColumn("_first", F.row_number().over(over) == 1)
        return seen.where(F.col("_first") | ~F.col("hashdiff").eqNullSafe(F.col("_before"))).drop("_before", "_first")
    same = reduce(Column.__and__, (rows[k].eqNullSafe(target[k]) for k in [*key, "load_date"]))
    rows = rows.join(target, same, "left_anti").withColumn("_new", F.lit(1))
    both = rows.unionByName(target.select(*key, "load_date", "hashdiff").withColumn("_new", F.lit(0)), allowMissingColumns=True)
    back = over.rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last(F.when(F.col("_new") == 1, F.col("hashdiff")), ignorenulls=True).over(back)
    prior = F.last(F.when(F.col("_new") == 0, F.col("hashdiff")), ignorenulls=True).over(back)
    seen = both.withColumn("_before", F.coalesce(prev, prior)).where("_new = 1")
    return seen.where(~F.col("hashdiff").eqNullSafe(F.col("_before"))).drop("_before", "_new")


def satellite(source: DataFrame, parent: str, keys: list[str], attributes: list[str], target: DataFrame | None = None, active: list[str] | None = None, small: bool = False) -> DataFrame:
    """hk_<parent>, load_date, hashdiff, attributes, record_source, _batch_id: changes of the attributes.

    Deletes (_op 'd') are left out. `active`: further columns that tell rows valid at the same time apart.
    """
    active = active or []
    _need(source, [*keys, *attributes, *active])
    rows = _with_keys(source, keys)
    if "_op" in source.columns:
        rows = rows.where(F.col("_op").isNull() | (F.col("_op") != "d"))
    hk = f"hk_{parent}"
    kept = [a for a in attributes if a not in active]
    rows = rows.select(hash_key(source, keys).alias(hk), "load_date", hashdiff(source, attributes).alias("hashdiff"), *active, *kept, "record_source", "_batch_id")
    out = _versions(rows, [hk, *active], narrowed(target, rows, [hk], small), ["hashdiff", *kept, "record_source", "_batch_id"])
    return out.select(hk, "load_date", "hashdiff", *active, *kept, "record_source", "_batch_id")


def status_satellite(source: DataFrame, parent: str, keys: list[str], target: DataFrame | None = None, small: bool = False) -> DataFrame:
    """is_deleted per change; false without _op, null (with a null hashdiff) for a null one."""
    _need(source, keys)
    gone = F.col("_op") == "d" if "_op" in source.columns else F.lit(False)
    hk = f"hk_{parent}"
    rows = _with_keys(source, keys).select(hash_key(source, keys).alias(hk), "load_date", F.sha1(gone.cast("string")).alias("hashdiff"), gone.alias("is_deleted"), "record_source", "_batch_id")
    out = _versions(rows, [hk], narrowed(target, rows, [hk], small), ["hashdiff", "is_deleted", "record_source", "_batch_id"])
    return out.select(hk, "load_date", "hashdiff", "is_deleted", "record_source", "_batch_id")


def since(df: DataFrame, mark, column: str = "_load_ts") -> DataFrame:
    """Rows after a high-water mark; all for none."""
    return df if mark is None else df.where(F.col(column) > F.lit(mark))


def high_mark(df: DataFrame, mark, column: str = "_load_ts"):
    """The new high-water mark, never below the old one."""
    seen = df.agg(F.max(column)).first()[0]
    return mark if seen is None else seen if mark is None else max(seen, mark)


def pit(hub: DataFrame, entity: str, satellites: dict[str, DataFrame]) -> DataFrame:
    """hk, snapshot_date (every load date of any satellite) and <name>_load_date: the latest at or before it."""
    hk = f"hk_{entity}"
    for name, sat in satellites.items():
        if hk not in sat.columns:
            raise ValueError(f"satellite {name} belongs to another hub")
    dates = reduce(DataFrame.unionByName, (s.select(hk, F.col("load_date").alias("snapshot_date"), F.lit(n).alias("_of")) for n, s in satellites.items()))
    each = dates.groupBy(hk, "snapshot_date").agg(*(F.max(F.when(F.col("_of") == n, F.col("snapshot_date"))).alias(f"_{n}") for n in satellites))
    each = each.join(hub.select(hk), hk, "left_semi")
    over = Window.partitionBy(hk).orderBy("snapshot_date").rowsBetween(Window.unboundedPreceding, 0)
    return each.select(hk, "snapshot_date", *(F.last(f"_{n}", ignorenulls=True).over(over).alias(f"{n}_load_date") for n in satellites))


def key_texts(source: DataFrame, roles: dict[str, list[str]]) -> DataFrame:
    """Distinct hk_<role>, as the texts that hashes are made of, of rows without null keys: a hub's keys, or a link's ends, for `bridge`."""
    keys = [k for r in roles.values() for k in r]
    _need(source, keys)
    return _with_keys(source, keys).select(*(key_text(source, cols).alias(f"hk_{role}") for role, cols in roles.items())).distinct()


def bridge(hub: DataFrame, entity: str, links: list[DataFrame], hashed: bool = True) -> DataFrame:
    """Distinct hub keys along a path of links; each link must share a hub with the path so far.

    hashed: hub and links are tables of the vault. Else they are `key_texts` of the sources that those would be loaded from;
    the path is made of the texts, a fraction of the hashes' bytes in every shuffle, and hashed at its end. Pairs that one link hash stands for (of texts
    with || in them) are both in the path, where a stored link has the first.
    """
    path, known = hub.select(f"hk_{entity}"), [f"hk_{entity}"]
    for k, step in enumerate(links):
        ends = [c for c in step.columns if c.startswith("hk_")][1 if hashed else 0 :]
        shared = [c for c in ends if c in known]
        if not shared:
            raise ValueError(f"link {k} shares no hub with the path")
        path = path.join(step.select(*ends), shared)
        known += [c for c in ends if c not in known]
    path = path.select(*known).distinct()
    return path if hashed else path.select(*(F.sha1(c).alias(c) for c in known))


def norm_key(df: DataFrame, column: str) -> Column:
    return norm(text_of(df, column), True)
