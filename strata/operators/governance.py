"""Classification, masking, row filters and grants as joins over small policy tables, applied inside the query plan."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from py4j.java_gateway import is_instance_of
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.text import AUDIT, text_of

#: Tags and what they say.
CLASSIFICATIONS = {
    "pii": "Personal data (any kind)",
    "pii.email": "Email address",
    "pii.phone": "Phone number",
    "pii.name": "Person name",
    "pii.address": "Postal address",
    "pii.birth_date": "Date of birth",
    "pii.national_id": "National identifier (SSN, passport, tax id)",
    "pii.card_number": "Payment card number (PCI)",
    "pii.ip_address": "IP address",
}
#: Tag, pattern searched in the lower-cased column name, confidence.
NAME_RULES = (
    ("pii.email", r"(^|_)e?_?mail(_?addr(ess)?)?($|_)", 0.8),
    ("pii.phone", r"(^|_)(phone|mobile|cell|tel|telephone|fax)(_?(no|number|nr))?($|_)", 0.8),
    ("pii.name", r"(^|_)(first|last|given|family|middle|full|sur)_?name($|_)|^surname$|^name$", 0.7),
    ("pii.address", r"(^|_)(street|(?<!mail_)address|addr|address_line_?\d?|postal_?code|zip_?code)($|_)", 0.6),
    ("pii.birth_date", r"(^|_)(birth_?date|date_?of_?birth|dob|birthday)($|_)", 0.8),
    ("pii.national_id", r"(^|_)(ssn|national_?id|passport(_?no)?|tax_?id|nin|personnummer)($|_)", 0.8),
    ("pii.card_number", r"(^|_)(card_?(no|number|num)|cc_?number|pan)($|_)", 0.8),
    ("pii.ip_address", r"(^|_)(ip|ip_?addr(ess)?|client_?ip)($|_)", 0.7),
)
#: Patterns of a profile that tell a tag, the least percentage, columns that are never classified.
PATTERN_RULES = {"email": "pii.email", "phone": "pii.phone", "card_number": "pii.card_number"}
PATTERN_MIN_PCT = 80.0
SKIP = (*AUDIT, "_op", "_source_ts", "_offset", "record_source", "load_date", "hashdiff")
#: Mask methods from weak to strong; roles that may read everything.
METHODS = ("partial", "hash", "redact", "null")
OPEN_ROLES = ("admin", "steward")
#: Functions and table functions that a user's query or predicate may not call, or alone may call.
FORBIDDEN = {"reflect", "java_method", "try_reflect"}
TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack"}


class AccessDenied(PermissionError):
    """A principal may not read a dataset."""


def name_signals(columns: DataFrame) -> DataFrame:
    """dataset, column, tag, confidence, reason from a frame of dataset, column."""
    name = F.lower("column")

    def why(tag: str) -> Column:
        # fixed value: the text decides between equal confidences
        return F.concat(F.lit("column name '"), "column", F.lit(f"' looks like {CLASSIFICATIONS[tag].lower()}"))

    hits = [F.when(name.rlike(p), F.struct(F.lit(t).alias("tag"), F.lit(c).alias("confidence"), why(t).alias("reason"))) for t, p, c in NAME_RULES]
    found = F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")
    return columns.select("dataset", "column", found).select("dataset", "column", "h.*")


def pattern_signals(profiles: DataFrame, least: float = PATTERN_MIN_PCT) -> DataFrame:
    """From dataset, column, patterns (name to percent): tags of patterns that nearly all values match."""
    each = profiles.select("dataset", "column", F.explode("patterns").alias("pattern", "pct"))
    tag = F.create_map(*(F.lit(x) for kv in PATTERN_RULES.items() for x in kv))
    hit = each.where(F.col("pattern").isin(list(PATTERN_RULES)) & (F.col("pct") >= least))
    # fixed value: the text decides between equal confidences
    why = F.concat(F.bround("pct", 0).cast("int").cast("string"), F.lit("% of values look like "), F.translate("pattern", "_", " "), F.lit("s"))
    return hit.select("dataset", "column", tag[F.col("pattern")].alias("tag"), F.bround(F.least(F.col("pct") / 100, F.lit(0.99)), 2).alias("confidence"), why.alias("reason"))


def lineage_signals(edges: DataFrame, tags: DataFrame) -> DataFrame:
    """Active classifications of a column pass to the columns computed from it. edges: from/to dataset and column."""
    active = tags.where((F.col("status") == "active") & F.col("tag").isin(list(CLASSIFICATIONS)))
    active = active.select(F.col("dataset").alias("from_dataset"), F.col("column").alias("from_column"), "tag")
    hit = edges.join(active, ["from_dataset", "from_column"])
    # fixed value: the text decides between equal confidences
    why = F.concat(F.lit("computed from "), "from_dataset", F.lit("."), "from_column", F.lit(", which is classified "), "tag")
    return hit.select(F.col("to_dataset").alias("dataset"), F.col("to_column").alias("column"), "tag", F.lit(0.9).alias("confidence"), why.alias("reason")).distinct()


def suggest(signals: list[DataFrame], existing: DataFrame) -> DataFrame:
    """Best signal per tag and column, ties by reason; never one that was assigned, whatever its status, nor SKIP or hash columns."""
    every = reduce(DataFrame.unionByName, signals).where(~F.col("column").isin(list(SKIP)) & ~F.col("column").startswith("hk_"))
    signal = F.struct("confidence", "reason")
    best = every.groupBy("tag", "dataset", "column").agg(F.max(signal).alias("r")).select("tag", "dataset", "column", "r.*")
    return best.join(existing.select("tag", "dataset", "column"), ["tag", "dataset", "column"], "left_anti")


def mask(text: Column, method: str, key: str = "") -> Column:
    """A text value masked; null stays null."""
    if method == "null":
        return F.lit(None).cast("string")
    if method == "redact":
        return F.when(text.isNotNull(), F.lit("****"))
    if method == "partial":
        n = F.greatest(F.length(text) - 4, F.lit(0))
        return F.concat(F.repeat(F.lit("*"), n), F.right(text, F.lit(4)))
    if method == "hash":
        return F.left(F.sha2(F.concat(F.lit(key), text), 256), F.lit(16))
    raise ValueError(f"unknown method {method}")


def _exempt(roles: Column, mine: list[str]) -> Column:
    none = F.array().cast("array<string>")
    return F.arrays_overlap(F.coalesce(roles, none), F.array(*map(F.lit, mine)).cast("array<string>"))


def column_masks(tags: DataFrame, policies: DataFrame, roles: list[str]) -> DataFrame:
    """dataset, column, method: the strongest policy whose tag covers an active tag and that exempts none of the roles.

    A tag is covered by itself and by what stands before each of its dots, so this is an equi-join.
    """
    rank = F.create_map(*(x for i, m in enumerate(METHODS) for x in (F.lit(m), F.lit(i))))
    held = policies.where(~_exempt(F.col("exempt_roles"), roles)).select(F.col("tag").alias("_p"), "method")
    parts = F.split("tag", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    active = tags.where((F.col("status") == "active") & (F.col("column") != "")).select("dataset", "column", F.explode(above).alias("_p"))
    covered = active.join(held, "_p")
    return covered.groupBy("dataset", "column").agg(F.max_by("method", rank[F.col("method")]).alias("method"))


def readable(datasets: DataFrame, grants: DataFrame, user: str, roles: list[str]) -> DataFrame:
    """dataset, restricted, readable of datasets (dataset, domain): no grant on dataset or domain leaves it open; OPEN_ROLES always may."""
    mine = ((F.col("to_kind") == "user") & (F.col("to_name") == user)) | ((F.col("to_kind") == "role") & F.col("to_name").isin(roles or [""]))
    given = grants.groupBy("kind", "name").agg(F.bool_or(mine).alias("_ok"))
    out = datasets.select("dataset", "domain")
    for kind, on in (("dataset", "dataset"), ("domain", "domain")):
        own = given.where(F.col("kind") == kind).select(F.col("name").alias(on), F.col("_ok").alias(f"_{kind}"))
        out = out.join(own, on, "left")
    restricted = F.col("_dataset").isNotNull() | F.col("_domain").isNotNull()
    may = F.lit(bool(set(roles) & set(OPEN_ROLES))) | ~restricted | F.coalesce(F.col("_dataset"), F.lit(False)) | F.coalesce(F.col("_domain"), F.lit(False))
    return out.select("dataset", restricted.alias("restricted"), may.alias("readable"))


def allowed(grants: DataFrame, dataset: str, domain: str | None, user: str, roles: list[str]) -> bool:
    """Whether one principal may read one dataset."""
    one = grants.sparkSession.createDataFrame([(dataset, domain)], "dataset string, domain string")
    return readable(one, grants, user, roles).first().readable


@dataclass(frozen=True)
class Policies:
    """The policy tables; small, but joined like any others.

    datasets (dataset, domain), tags (dataset, column, tag, status), masking (tag, method, exempt_roles),
    filters (dataset, predicate, exempt_roles), grants (kind, name, to_kind, to_name).
    """

    datasets: DataFrame
    tags: DataFrame
    masking: DataFrame
    filters: DataFrame
    grants: DataFrame


@dataclass(frozen=True)
class DatasetPolicy:
    dataset: str
    readable: bool
    restricted: bool = False
    masks: dict[str, str] = field(default_factory=dict)
    row_filters: tuple[str, ...] = ()


def effective(policies: Policies, user: str, roles: list[str]) -> DataFrame:
    """dataset, restricted, readable, masks map<column, method>, row_filters array: what holds for a principal, of every dataset."""
    masks = column_masks(policies.tags, policies.masking, roles).groupBy("dataset")
    masks = masks.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "method")))).alias("masks"))  # a dataset's columns
    kept = policies.filters.where(~_exempt(F.col("exempt_roles"), roles))
    filters = kept.groupBy("dataset").agg(F.array_sort(F.collect_list("predicate")).alias("row_filters"))  # and its filters
    out = readable(policies.datasets, policies.grants, user, roles).join(masks, "dataset", "left").join(filters, "dataset", "left")
    none = F.create_map().cast("map<string,string>")
    return out.select("dataset", "restricted", "readable", F.coalesce("masks", none).alias("masks"), F.coalesce("row_filters", F.array().cast("array<string>")).alias("row_filters"))


def policy_of(policies: Policies, dataset: str, user: str, roles: list[str]) -> DatasetPolicy:
    """One dataset's policy for a principal; a dataset that isn't known is an error."""
    own = Policies(*(t.where(F.col("dataset") == dataset) for t in (policies.datasets, policies.tags)), policies.masking, policies.filters.where(F.col("dataset") == dataset), policies.grants)
    r = effective(own, user, roles).first()
    if r is None:
        raise LookupError(f"{dataset} is not in the catalog")
    return DatasetPolicy(dataset, r.readable, r.restricted, dict(r.masks), tuple(r.row_filters))


def _parts(x):
    """What a Scala value holds, as far as it may lead to plans and expressions."""
    kind = x.getClass().getName()
    if kind.startswith("scala.collection.") or kind in ("scala.Some", "scala.None$"):
        it = x.iterator()
    elif kind.startswith(("org.apache.spark.sql.", "scala.Tuple")) and is_instance_of(SparkContext._gateway, x, "scala.Product"):
        it = x.productIterator()
    else:
        return
    while it.hasNext():
        part = it.next()
        if hasattr(part, "getClass"):
            yield part


def _words(x) -> list[str]:
    return [str(x.apply(i)) for i in range(x.size())]


def _check(node, known: set[str], plans: bool) -> None:
    """Refuses relations that aren't `known`, functions that reach outside, and (unless `plans`) every sub-query."""
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedRelation":
        name = _words(node.multipartIdentifier())
        if not plans or len(name) != 1 or name[0].lower() not in known:
            raise AccessDenied(f"no access to {'.'.join(name)}")
    elif kind in ("UnresolvedTableValuedFunction", "UnresolvedTVFAliases"):
        names = _words(node.name()) if hasattr(node, "name") else []
        if not plans or any(n.lower() not in TABLE_FUNCTIONS for n in names):
            raise AccessDenied(f"no access to {'.'.join(names)}")
    elif "WithUnresolvedIdentifier" in kind:
        raise AccessDenied("no access by identifier()")
    elif kind == "UnresolvedFunction" and {n.lower() for n in _words(node.nameParts())} & FORBIDDEN:
        raise AccessDenied(f"no access to {'.'.join(_words(node.nameParts()))}")
    elif kind == "UnresolvedWith":
        ctes, inner = node.cteRelations(), set(known)
        for i in range(ctes.size()):
            one = ctes.apply(i)
            _check(one._2(), inner | ({one._1().lower()} if node.allowRecursion() else set()), plans)
            inner.add(one._1().lower())
        return _check(node.child(), inner, plans)
    elif not plans and kind in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery"):
        raise ValueError("a row filter is a condition on the dataset's own columns")
    for part in _parts(node):
        _check(part, known, plans)


def checked_predicate(df: DataFrame, predicate: str) -> Column:
    """A condition on the frame's own columns; sub-queries, aggregates and other columns are errors."""
    parsed = df.sparkSession._jsparkSession.sessionState().sqlParser().parseExpression(predicate)
    _check(parsed, set(), False)
    if not isinstance(df.select(F.expr(predicate).alias("c")).schema["c"].dataType, T.BooleanType):
        raise ValueError(f"not a condition: {predicate}")
    df.where(F.expr(predicate))  # aggregates and windows are errors here
    return F.expr(predicate)


def secured(df: DataFrame, masks: dict[str, str], predicates: list[str] | tuple[str, ...], key: str = "") -> DataFrame:
    """Filters on raw values, then masks (text): one lazy plan, so pruning and pushdown pass through."""
    for p in predicates:
        df = df.where(checked_predicate(df, p))
    return df.select(*(mask(text_of(df, c), masks[c], key).alias(c) if c in masks else F.col(f"`{c}`") for c in df.columns))


def read_secured(df: DataFrame, policy: DatasetPolicy, key: str = "") -> DataFrame:
    """A dataset's rows as a principal may see them; an error where the principal may not read it."""
    if not policy.readable:
        raise AccessDenied(f"no access to {policy.dataset}")
    return secured(df, policy.masks, policy.row_filters, key)


def secured_relations(frames: dict[str, DataFrame], policies: Policies, user: str, roles: list[str], key: str = "") -> dict[str, DataFrame]:
    """The datasets a query names (name to raw frame), secured for a principal."""
    return {n: read_secured(df, policy_of(policies, n, user, roles), key) for n, df in frames.items()}


def secured_sql(spark: SparkSession, query: str, relations: dict[str, DataFrame]) -> DataFrame:
    """A user's one query over secured relations, which are all that it can name: tables, files and views of the session are refused.

    Its names stand for views of this call alone, which are gone when the plan is made.
    """
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    if not parsed.getClass().getName().startswith("org.apache.spark.sql.catalyst.") or "Command" in parsed.getClass().getSimpleName() or parsed.getClass().getSimpleName().startswith(("Insert", "Create", "Drop", "Alter", "Replace", "Merge", "Update", "Delete", "Set", "Cache", "Uncache", "Truncate", "Describe", "Show")):
        raise ValueError("not a query")
    _check(parsed, {n.lower() for n in relations}, True)
    views = {n: f"_secured_{uuid.uuid4().hex}" for n in relations}
    try:
        for n, df in relations.items():
            df.createTempView(views[n])
        named = ", ".join(f"`{n}` as (select * from {v})" for n, v in views.items())
        return spark.sql(f"with {named} select * from (\n{query}\n)" if named else query)
    finally:
        for v in views.values():
            spark.catalog.dropTempView(v)


def ask(spark: SparkSession, query: str, relations: dict[str, DataFrame], limit: int = 500) -> tuple[DataFrame, bool]:
    """At most `limit` (1 to 5000) rows of a secured query, and whether there are more: a preview, so the rows are held."""
    limit = min(max(limit, 1), 5000)
    out = secured_sql(spark, query, relations)
    rows = out.limit(limit + 1).collect()
    return spark.createDataFrame(rows[:limit], out.schema), len(rows) > limit


def mask_profile(profile: DataFrame, masks: dict[str, str]) -> DataFrame:
    """A full_profile without ranges and with masked top values of masked columns; hash shows as ****."""
    out = profile
    for c, m in masks.items():
        own = F.col("column") == c
        for x in ("min", "max", "mean", "stddev"):
            out = out.withColumn(x, F.when(~own, F.col(x)))
        out = out.withColumn("top_values", F.when(own, _hide(m)).otherwise(F.col("top_values")))
    return out


def _hide(method: str) -> Column:
    shown = "redact" if method == "hash" else method
    return F.transform("top_values", lambda v: F.struct(mask(v["value"], shown).alias("value"), v["count"].alias("count")))
