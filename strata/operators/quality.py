"""Quality rules, scorecards and column profiles.

A rule gives (checked, failed). Column rules of one dataset fuse into one aggregation; unique, referential and
custom rules are jobs of their own. score = 100 (checked - failed) / checked, 100 when nothing was checked.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.text import text_of

SAMPLE = 5


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    columns: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)
    threshold: float = 1.0


def _column_rule(df: DataFrame, rule: Rule) -> tuple[Column, Column]:
    """(checked, failed) as conditions on a row."""
    c, p = F.col(rule.columns[0]), rule.params
    if rule.kind == "not_null":
        return F.lit(True), c.isNull()
    text = text_of(df, rule.columns[0])
    if rule.kind == "range":
        bad = [c < F.lit(p["min"])] if p.get("min") is not None else []
        bad += [c > F.lit(p["max"])] if p.get("max") is not None else []
        return c.isNotNull(), reduce(Column.__or__, bad)
    if rule.kind == "regex":
        return c.isNotNull(), ~text.rlike(rf"\A(?:{p['pattern']})\z")
    if rule.kind == "allowed_values":
        return c.isNotNull(), ~text.isin([str(v) for v in p["values"]])
    raise ValueError(f"unknown rule {rule.kind}")


def _sql(df: DataFrame, query: str) -> DataFrame:
    """A query over `data`. The rows stand under a view of a name of their own, and a common table expression gives them the
    name `data` inside the query alone: a view of the user's that is called so stays what it is."""
    spark, own = df.sparkSession, f"data_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(own)
    try:
        head = re.match(r"(?is)\s*with\s+(recursive\s+)?", query)
        named = f"WITH {head[1] or ''}data AS (SELECT * FROM {own}), {query[head.end() :]}" if head else f"WITH data AS (SELECT * FROM {own}) {query}"
        return spark.sql(named)
    finally:
        spark.catalog.dropTempView(own)


def _unmatched(df: DataFrame, rule: Rule, references: dict[str, DataFrame]) -> DataFrame:
    """_k, count, _found of the known values of a referential rule's column: a frequent value is one row in the join."""
    if (ref := references.get(rule.params["reference"])) is None:
        raise ValueError(f"{rule.params['reference']} has no data")
    known = ref.select(text_of(ref, rule.params["column"]).alias("_k")).where("_k is not null").distinct().withColumn("_found", F.lit(True))
    rows = df.select(text_of(df, rule.columns[0]).alias("_k")).where("_k is not null")
    return rows.groupBy("_k").count().join(known, "_k", "left")


def _alone(df: DataFrame, rule: Rule, references: dict[str, DataFrame]) -> DataFrame:
    """checked, failed of a rule that needs a job of its own."""
    none = F.lit(0)
    if rule.kind == "unique":
        n = df.groupBy(*rule.columns).count()
        return n.agg(F.coalesce(F.sum("count"), none).alias("checked"), F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), none).alias("failed"))
    if rule.kind == "referential":
        n, lost = _unmatched(df, rule, references), F.when(F.col("_found").isNull(), F.col("count"))
        return n.agg(F.coalesce(F.sum("count"), none).alias("checked"), F.coalesce(F.sum(lost), none).alias("failed"))
    if rule.kind == "custom_sql":
        bad = _sql(df, rule.params["sql"]).agg(none.alias("checked"), F.count("*").alias("failed"))
        every = df.agg(F.count("*").alias("checked"), none.alias("failed"))
        return every.unionAll(bad).agg(F.sum("checked").alias("checked"), F.sum("failed").alias("failed"))
    raise ValueError(f"unknown rule {rule.kind}")


def failing(df: DataFrame, rule: Rule, references: dict[str, DataFrame] | None = None, as_of=None) -> DataFrame:
    """Up to five distinct failing values as text, in order: keys (unique), whole rows as JSON (custom_sql), what was
    measured where the rule fails (freshness, row_count), none for not_null."""
    if rule.kind == "not_null":
        return df.sparkSession.createDataFrame([], "value string")
    if rule.kind == "unique":
        keys = df.groupBy(*rule.columns).count().where("count > 1")
        rows = keys.select(F.concat_ws("|", *(text_of(df, c) for c in rule.columns)).alias("value"))
    elif rule.kind == "referential":
        rows = _unmatched(df, rule, references or {}).where("_found is null").select(F.col("_k").alias("value"))
    elif rule.kind == "custom_sql":
        bad = _sql(df, rule.params["sql"])
        rows = bad.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in bad.columns))).alias("value")).distinct()
    elif rule.kind in ("freshness", "row_count"):
        measured = F.max(rule.columns[0] if rule.columns else "_load_ts") if rule.kind == "freshness" else F.count("*")
        rows = df.agg(measured.cast("string").alias("value"), _fused(df, rule, as_of)[1].alias("_bad")).where("_bad > 0").select("value")
    else:
        checked, bad = _column_rule(df, rule)
        rows = df.where(checked & bad).select(text_of(df, rule.columns[0]).alias("value")).distinct()
    return rows.orderBy("value").limit(SAMPLE)


FUSED = ("not_null", "range", "regex", "allowed_values", "freshness", "row_count")


def _fused(df: DataFrame, r: Rule, as_of) -> tuple[Column, Column]:
    """(checked, failed) of a rule as aggregates."""
    if r.kind == "freshness":
        seen = F.max(r.columns[0] if r.columns else "_load_ts")
        late = seen.isNull() | (seen < F.lit(as_of).cast("timestamp") - F.make_interval(mins=F.lit(int(r.params["minutes"]))))
        return F.lit(1).cast("long"), late.cast("long")
    if r.kind == "row_count":
        low, high = r.params.get("min"), r.params.get("max")
        bad = [F.count("*") < low] if low is not None else []
        bad += [F.count("*") > high] if high is not None else []
        return F.lit(1).cast("long"), reduce(Column.__or__, bad, F.lit(False)).cast("long")
    checked, failed = _column_rule(df, r)
    return F.count_if(checked), F.count_if(checked & failed)


def _known(df: DataFrame, r: Rule) -> None:
    for c in r.columns:
        if c not in df.columns:
            raise ValueError(f"the dataset has no column '{c}'")


def evaluate(df: DataFrame, rules: list[Rule], as_of=None, references: dict[str, DataFrame] | None = None) -> DataFrame:
    """name, kind, checked, failed, score, passed, error; one row per rule.

    A rule that can't be planned (an unknown column, a query that doesn't parse) has an error and no score, and the
    others go on. What fails while running is told by `run`.
    """
    aggs: list[Column] = []
    parts, lost = [], []
    for r in rules:
        head = (F.lit(r.name).alias("name"), F.lit(r.kind).alias("kind"), F.lit(float(r.threshold)).alias("t"))
        try:
            _known(df, r)
            if r.kind in FUSED:
                checked, failed = _fused(df, r, as_of)
                df.agg(checked.alias("checked"), failed.alias("failed"))  # an error of this rule's own shows here
                aggs.append(F.struct(*head, checked.alias("checked"), failed.alias("failed")))
            else:
                one = _alone(df, r, references or {})
                parts.append(one.select(*head, F.col("checked").cast("long").alias("checked"), F.col("failed").cast("long").alias("failed")))
        except Exception as e:  # a rule's own failure is its result
            lost.append(errored(df.sparkSession, r, e))
    parts += [df.agg(F.array(*aggs).alias("r")).select(F.inline("r"))] if aggs else []
    ratio = F.when(F.col("checked") == 0, F.lit(1.0)).otherwise((F.col("checked") - F.col("failed")) / F.col("checked"))
    score = F.when(F.col("checked") == 0, F.lit(100.0)).otherwise(F.bround(100 * (F.col("checked") - F.col("failed")) / F.col("checked"), 2))
    out = [p.select("name", "kind", "checked", "failed", score.alias("score"), (ratio >= F.col("t")).alias("passed"), F.lit(None).cast("string").alias("error")) for p in parts]
    return reduce(DataFrame.unionByName, [*out, *lost])


RESULT = "name string, kind string, checked long, failed long, score double, passed boolean, error string"


def errored(spark: SparkSession, rule: Rule, why: Exception) -> DataFrame:
    """The result of a rule that failed itself: not passed, no score."""
    return spark.createDataFrame([(rule.name, rule.kind, None, None, None, False, str(why)[:2000])], RESULT)


def run(df: DataFrame, rules: list[Rule], as_of=None, references: dict[str, DataFrame] | None = None) -> DataFrame:
    """`evaluate`, done: where the whole suite fails while running, each rule runs alone and keeps its own error."""
    spark = df.sparkSession
    try:
        return spark.createDataFrame(evaluate(df, rules, as_of, references).collect(), RESULT)  # a row per rule
    except Exception:  # told apart below
        rows = []
        for r in rules:
            try:
                rows += evaluate(df, [r], as_of, references).collect()
            except Exception as e:  # a rule's own failure is its result
                rows += errored(spark, r, e).collect()
        return spark.createDataFrame(rows, RESULT)


def latest(results: DataFrame) -> DataFrame:
    """Of each rule the result with the latest `at`."""
    return results.groupBy("rule").agg(F.max_by(F.struct(*(c for c in results.columns if c != "rule")), "at").alias("r")).select("rule", "r.*")


def scorecard(results: DataFrame, by: str | None = None) -> DataFrame:
    """Weighted mean of the latest scores: critical rules count twice, an errored one (null score) is 0."""
    weight = F.when(F.col("severity") == "critical", 2).otherwise(1)
    score = F.bround(F.sum(F.coalesce("score", F.lit(0.0)) * weight) / F.sum(weight), 2).alias("score")
    now = latest(results)
    return now.groupBy(by).agg(score) if by else now.agg(score)


def degradation(scores: DataFrame, window: int, pct: float, card: str = "card") -> DataFrame:
    """baseline: mean of the `window` scores before; degraded: below baseline by more than pct percent."""
    back = Window.partitionBy(card).orderBy("at").rowsBetween(-window, -1)
    out = scores.withColumn("baseline", F.avg("score").over(back))
    return out.withColumn("degraded", F.coalesce((F.col("baseline") > 0) & (F.col("score") < F.col("baseline") * (1 - pct / 100)), F.lit(False)))


def summary(results: DataFrame) -> DataFrame:
    """rules, failing, unevaluated and mean score of the latest results by dataset."""
    return latest(results).groupBy("dataset").agg(F.count("*").alias("rules"), F.count_if(~F.col("passed")).alias("failing"), F.count_if(F.col("score").isNull()).alias("unevaluated"), F.bround(F.avg("score"), 2).alias("score"))


def series(results: DataFrame, rule: str, since) -> DataFrame:
    """A rule's results from a time on, in order of time."""
    return results.where((F.col("rule") == rule) & (F.col("at") >= F.lit(since).cast("timestamp"))).orderBy("at")


#: Value shapes that a profile counts.
PATTERNS = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
    "phone": r"^\+?[0-9][0-9 ()./-]{6,18}[0-9]$",
    "url": r"^https?://\S+$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "ipv4": r"^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$",
    "iso_date": r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?.*)?$",
    "card_number": r"^(?:\d[ -]?){13,19}$",
    "postal_code": r"^[0-9]{4,5}(-[0-9]{4})?$",
}
TOP_N, CUT = 5, 100


def profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row per column, from one aggregation: nulls, distinct values, ranges, lengths, patterns."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    nothing = {k: F.lit(None).cast(t) for k, t in (("min", "string"), ("max", "string"), ("mean", "double"), ("stddev", "double"), ("min_length", "long"), ("max_length", "long"), ("avg_length", "double"), ("blanks", "long"), ("true_pct", "double"))}
    rows = []
    for f in df.schema:
        c, kind, own = F.col(f"`{f.name}`"), f.dataType, dict(nothing)
        own["patterns"] = F.create_map().cast("map<string,double>")
        flat = not isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))
        if isinstance(kind, T.NumericType):
            six = lambda x: F.bround(x.cast("double"), 6)
            own |= {"min": six(F.min(c)).cast("string"), "max": six(F.max(c)).cast("string"), "mean": six(F.avg(c)), "stddev": six(F.stddev_samp(c))}
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            own |= {"min": F.min(c).cast("string"), "max": F.max(c).cast("string")}
        elif isinstance(kind, T.StringType):
            n = F.length(c)
            own |= {"min_length": F.min(n).cast("long"), "max_length": F.max(n).cast("long"), "avg_length": F.bround(F.avg(n), 6), "blanks": F.count_if(F.trim(c) == "")}
            hits = [F.struct(F.lit(k).alias("key"), F.bround(100 * F.count_if(c.rlike(p.replace("$", r"\z"))) / F.greatest(F.count(c), F.lit(1)), 6).alias("value")) for k, p in PATTERNS.items()]
            own["patterns"] = F.map_from_entries(F.filter(F.array(*hits), lambda h: h["value"] > 0))
        elif isinstance(kind, T.BooleanType):
            own["true_pct"] = F.bround(100 * F.count_if(c) / F.greatest(F.count(c), F.lit(1)), 6)
        d = distinct(c) if flat else F.lit(None).cast("long")
        common = [F.lit(f.name).alias("column"), F.lit(kind.simpleString()).alias("type"), F.count("*").alias("rows"), F.count_if(c.isNull()).alias("nulls")]
        common += [F.bround(100 * F.count_if(c.isNull()) / F.greatest(F.count("*"), F.lit(1)), 6).alias("null_pct"), d.alias("distinct"), F.bround(100 * d / F.greatest(F.count(c), F.lit(1)), 6).alias("distinct_pct")]
        rows.append(F.struct(*common, *(v.alias(k) for k, v in own.items())))
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def _flat(df: DataFrame) -> list[str]:
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)
    return [f.name for f in df.schema if not isinstance(f.dataType, nested)]


#: Types whose values are equal where their texts are; others are counted as text.
_TYPED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.StringType, T.BooleanType, T.DateType, T.TimestampType)


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, value (text), count of the known values of flat columns (all, or those given).

    Each column is read and counted by itself in its own type, so a shuffle carries that column's distinct values and no
    texts; they become text once counted.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    parts = []
    for c in _flat(df) if columns is None else columns:
        own = F.col(f"`{c}`") if isinstance(kinds[c], _TYPED) else text_of(df, c)
        n = df.select(own.alias(c)).where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`")).count()
        parts.append(n.select(F.lit(c).alias("column"), text_of(n, c).alias("value"), "count"))
    return reduce(DataFrame.unionAll, parts) if parts else df.sparkSession.createDataFrame([], "column string, value string, count long")


def top_values(df: DataFrame, n: int = TOP_N) -> DataFrame:
    """column, value, count, rank: the most frequent non-null values as text, ties by value."""
    return _top(value_counts(df), n)


#: Values a sketch keeps of a column, and asked of it.
TRACKED, CANDIDATES = 10_000, 100


def heavy_values(df: DataFrame, n: int = TOP_N, tracked: int = TRACKED) -> DataFrame:
    """top_values by sketches where they prove it; the other columns are counted in full.

    One aggregation makes a frequent-items sketch of each column, whose size doesn't grow with the data. A value that a
    sketch doesn't name stands at most `bound` times: twice the sketch's error (3.5 / tracked of the values), or what the
    last named one is said to have. The named ones are counted exactly in a second pass, without a shuffle of any other
    value. If the n-th of them stands more often than `bound`, they hold the n most frequent ones, and all that tie with them.
    """
    spark, kinds = df.sparkSession, {f.name: f.dataType for f in df.schema}
    some = [c for c in _flat(df) if isinstance(kinds[c], _TYPED)]
    proven: list[DataFrame] = []
    asked = min(CANDIDATES, tracked)
    if some:
        quoted = lambda c: f"`{c.replace('`', '``')}`"
        said = df.agg(*(F.struct(F.count(quoted(c)).alias("n"), F.expr(f"approx_top_k({quoted(c)}, {asked}, {tracked})").alias("top")).alias(f"c{i}") for i, c in enumerate(some))).first()
        hope, bound = {}, {}
        for i, c in enumerate(some):
            found = [x for x in said[i]["top"] if x["item"] is not None]
            bound[c] = max(7 * said[i]["n"] / tracked, found[-1]["count"] if len(found) == asked else 0)
            if sum(x["count"] > bound[c] for x in found) >= n or said[i]["n"] and len(found) == said[i]["n"]:
                hope[c] = [x["item"] for x in found]
        if hope:
            each = [F.struct(F.lit(c).alias("column"), text_of(df, c).alias("value"), F.col(quoted(c)).isin(v).alias("ok")) for c, v in hope.items()]
            rows = df.select(F.explode(F.filter(F.array(*each), lambda x: x["ok"])).alias("r")).select("r.column", "r.value")
            exact: dict[str, list] = {}
            for r in rows.groupBy("column", "value").count().collect():  # CANDIDATES rows of a column at most
                exact.setdefault(r["column"], []).append((r["value"], r["count"]))
            for c, counted in exact.items():
                if len(counted) >= n and sorted((k for _, k in counted), reverse=True)[n - 1] > bound[c]:
                    proven.append(spark.createDataFrame([(c, *x) for x in counted], "column string, value string, count long"))
                    some.remove(c)
    rest = [c for c in _flat(df) if c in some or not isinstance(kinds[c], _TYPED)]
    return _top(reduce(DataFrame.unionAll, [*proven, *([value_counts(df, rest)] if rest or not proven else [])]), n)


def _top(counts: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= n)
    return best.withColumn("value", F.when(F.length("value") > CUT, F.concat(F.left("value", F.lit(CUT)), F.lit("…"))).otherwise(F.col("value")))


def full_profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """profile and top_values, as array<struct<value, count>>. exact: distinct values are counted, from the same counts that
    give the top ones; else both come from sketches as far as these prove the top ones."""
    counts = value_counts(df) if exact else None
    best = _top(counts, TOP_N) if exact else heavy_values(df)
    top = best.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "count"))).alias("t"))
    out = profile(df).join(top, "column", "left")
    if exact:
        seen = counts.groupBy("column").agg(F.count("*").alias("_n"), F.sum("count").alias("_of"))
        flat = F.col("distinct").isNotNull()
        out = out.join(seen, "column", "left").withColumn("distinct", F.when(flat, F.coalesce("_n", F.lit(0))))
        out = out.withColumn("distinct_pct", F.when(flat, F.bround(100 * F.col("distinct") / F.greatest(F.coalesce("_of", F.lit(0)), F.lit(1)), 6)))
    values = F.transform("t", lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count")))
    return out.withColumn("top_values", values).drop("t", "_n", "_of")
