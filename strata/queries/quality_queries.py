"""Quality, profile and governance queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators import governance as gov
from strata.operators import quality as q
from strata.operators.quality import Rule
from strata.queries.base import table

AS_OF, KEY = "2024-02-01 00:00:00", "k"


def _one(table_name, rule, references=()):
    def run(s, d):
        return q.evaluate(table(s, d, table_name), [rule], AS_OF, {n: table(s, d, n) for n in references})

    return run


def _nullable(s, d):
    """Customers whose balance is null where the segment is BUILDING."""
    c = table(s, d, "customer")
    return c.withColumn("c_acctbal", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")))


def dq_not_null(s, d):
    return q.evaluate(_nullable(s, d), [Rule("n", "not_null", ("c_acctbal",))])


RULES = {
    "dq_unique": ("lineitem", Rule("u", "unique", ("l_orderkey", "l_linenumber"))),
    "dq_range": ("lineitem", Rule("r", "range", ("l_quantity",), {"min": 2, "max": 45})),
    "dq_regex": ("customer", Rule("x", "regex", ("c_name",), {"pattern": "Customer#[0-9]*1"})),
    "dq_allowed_values": ("orders", Rule("a", "allowed_values", ("o_orderstatus",), {"values": ["O", "F"]})),
    "dq_freshness": ("events", Rule("f", "freshness", ("ts",), {"minutes": 60})),
    "dq_row_count": ("orders", Rule("c", "row_count", (), {"min": 1, "max": 100})),
    "dq_custom_sql": ("orders", Rule("s", "custom_sql", (), {"sql": "select * from data where o_totalprice < 1000"})),
}


def dq_referential(s, d):
    """Orders against the customers of even nations."""
    known = table(s, d, "customer").where("c_nationkey % 2 = 0")
    return q.evaluate(table(s, d, "orders"), [Rule("k", "referential", ("o_custkey",), {"reference": "c", "column": "c_custkey"})], references={"c": known})


SUITE = [
    Rule("key", "not_null", ("o_orderkey",)),
    Rule("price", "range", ("o_totalprice",), {"min": 1000}, 0.9),
    Rule("status", "allowed_values", ("o_orderstatus",), {"values": ["O", "F"]}, 0.5),
    Rule("rows", "row_count", (), {"min": 1}),
    Rule("unique", "unique", ("o_orderkey",)),
]


def dq_suite(s, d):
    return q.evaluate(table(s, d, "orders"), SUITE)


def dq_failure_sample(s, d):
    """Samples of every kind of rule, as rows."""
    part, known = table(s, d, "part"), {"c": table(s, d, "customer").where("c_nationkey % 2 = 0")}
    rules = {
        "range": (part, Rule("range", "range", ("p_size",), {"max": 44})),
        "regex": (part, Rule("regex", "regex", ("p_brand",), {"pattern": "Brand#[0-3].*"})),
        "allowed_values": (table(s, d, "orders"), Rule("allowed_values", "allowed_values", ("o_orderpriority",), {"values": ["1-URGENT"]})),
        "unique": (table(s, d, "lineitem"), Rule("unique", "unique", ("l_orderkey", "l_linenumber"))),
        "not_null": (_nullable(s, d), Rule("not_null", "not_null", ("c_acctbal",))),
        "referential": (table(s, d, "orders"), Rule("referential", "referential", ("o_custkey",), {"reference": "c", "column": "c_custkey"})),
        "custom_sql": (part, Rule("custom_sql", "custom_sql", (), {"sql": "select p_size from data where p_size > 47"})),
        "row_count": (part, Rule("row_count", "row_count", (), {"max": 1})),
    }
    return reduce(DataFrame.unionByName, (q.failing(df, r, known).withColumn("rule", F.lit(n)) for n, (df, r) in rules.items()))


def dq_suite_errors(s, d):
    """A suite in which one rule names an unknown column and one fails while running: both have errors, the others results."""
    broken = [Rule("lost", "not_null", ("nothing",)), Rule("run", "custom_sql", (), {"sql": "select * from data where cast(o_orderstatus as int) = 1"})]
    r = q.run(table(s, d, "orders"), [*SUITE, *broken])
    return r.select("name", "kind", "checked", "failed", "score", "passed", F.col("error").isNotNull().alias("errored"))


def _results(s, d):
    """Daily scores of event types as rule results."""
    e = table(s, d, "events")
    day = F.date_trunc("day", "ts").alias("at")
    r = e.groupBy(F.col("event_type").alias("rule"), day).agg(F.bround(100 * F.avg((F.col("value") > 20).cast("double")), 2).alias("score"))
    r = r.withColumn("severity", F.when(F.col("rule") == "purchase", "critical").otherwise("warning")).withColumn("dimension", F.when(F.col("rule").isin("view", "click"), "traffic").otherwise("account"))
    return r.withColumns({"dataset": F.lit("events"), "passed": F.col("score") >= 50})


def dq_scorecard(s, d):
    return q.scorecard(_results(s, d), "dimension")


def dq_degradation(s, d):
    cards = _results(s, d).select(F.col("rule").alias("card"), "at", "score")
    return q.degradation(cards, 3, 10).withColumn("baseline", F.round("baseline", 6))


def dq_latest(s, d):
    return q.summary(_results(s, d))


def dq_series(s, d):
    return q.series(_results(s, d), "purchase", "2024-01-10").select("rule", "at", "score")


def profile_numeric(s, d):
    return q.profile(table(s, d, "customer").select("c_acctbal", "c_nationkey"), exact=True).select("column", "rows", "nulls", "distinct", "distinct_pct", F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max"), "mean", "stddev")


def profile_string(s, d):
    return q.profile(table(s, d, "documents").select("lang", "source"), exact=True).select("column", "nulls", "distinct", "min_length", "max_length", "avg_length", "blanks")


#: Value shapes by part key: {0} is the key padded to seven digits.
SHAPES = ("a.b{0}@x-y.example.com", "+47 {0} 12", "https://h.example/{0}", "{0}8-1234-abcd-ABCD-0123456789ab", "10.0.255.{1}", "2024-01-15", "2024-01-15T10:30:00Z", "4111 1111-1{0} ", "0150", "01500-1234", "999.1.1.1", "12/34 5678{0}")


def profile_patterns(s, d):
    """Every pattern, over texts of many shapes made from the parts."""
    k = F.lpad(F.col("p_partkey").cast("string"), 7, "0")
    shape = F.element_at(F.array(*map(F.lit, SHAPES)), (F.col("p_partkey") % len(SHAPES) + 1).cast("int"))
    text = F.replace(F.replace(shape, F.lit("{0}"), k), F.lit("{1}"), (F.col("p_partkey") % 300).cast("string"))
    p = q.profile(table(s, d, "part").select(text.alias("value")), exact=True)
    return p.select("column", F.explode("patterns").alias("pattern", "pct"))


def profile_top_values(s, d):
    return q.top_values(table(s, d, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey"))


def profile_all_columns(s, d):
    """Every column of lineitem, with exact distinct values."""
    p = q.full_profile(table(s, d, "lineitem"), exact=True)
    return p.select("column", "rows", "nulls", "distinct", "mean", F.posexplode("top_values").alias("rank", "t")).select("column", "rows", "nulls", "distinct", "mean", "rank", F.col("t.value").alias("value"), F.col("t.count").alias("count"))


COLUMNS = ("email", "e_mail", "mobile_no", "tel", "first_name", "c_name", "mail_address", "address_line_1", "dob", "ssn", "card_number", "iban", "client_ip", "hk_email", "_batch_id", "plain", "fullname", "passport_no", "zip_code", "pan")


def _columns(s, d):
    """A catalog of one dataset per supplier and column names that follow the part's key."""
    name = F.element_at(F.array(*map(F.lit, COLUMNS)), (F.col("p_partkey") % len(COLUMNS) + 1).cast("int"))
    return table(s, d, "part").select(F.concat(F.lit("crm.t"), "p_partkey").alias("dataset"), name.alias("column"))


def pii_name_signals(s, d):
    return gov.name_signals(_columns(s, d))


def pii_suggestions(s, d):
    """Names, values of emails and phones made from customers, and lineage from active tags; assigned ones are left out."""
    c = table(s, d, "customer").select(F.concat(F.lower("c_mktsegment"), F.lit("."), F.col("c_custkey"), F.lit("@example.com")).alias("contact"), F.concat(F.lit("+1 555 "), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("line"))
    values = gov.pattern_signals(q.profile(c).withColumn("dataset", F.lit("silver.contacts")))
    n = table(s, d, "supplier")
    tags = n.select(F.concat(F.lit("silver.s"), "s_suppkey").alias("dataset"), F.lit("contact").alias("column"), F.lit("pii.email").alias("tag"), F.when(F.col("s_suppkey") % 3 == 0, "rejected").otherwise("active").alias("status"))
    tags = tags.unionByName(_columns(s, d).where("column = 'ssn' and dataset like '%9'").select("dataset", "column", F.lit("pii.national_id").alias("tag"), F.lit("rejected").alias("status")))
    edges = n.select(F.concat(F.lit("silver.s"), "s_suppkey").alias("from_dataset"), F.lit("contact").alias("from_column"), F.concat(F.lit("gold.n"), "s_nationkey").alias("to_dataset"), F.lit("who").alias("to_column"))
    return gov.suggest([gov.name_signals(_columns(s, d)), values, gov.lineage_signals(edges, tags)], tags)


def mask_columns(s, d):
    c = table(s, d, "customer")
    return gov.secured(c, {"c_name": "partial", "c_mktsegment": "hash", "c_acctbal": "redact", "c_nationkey": "null"}, [], KEY)


def _policies(s):
    """Policies on the customer table, which is of the domain sales."""
    frame = s.createDataFrame
    return gov.Policies(
        frame([("customer", "sales"), ("orders", "sales"), ("part", None)], "dataset string, domain string"),
        frame([("customer", "c_name", "pii.name", "active"), ("customer", "c_acctbal", "financial.account", "suggested")], "dataset string, column string, tag string, status string"),
        frame([("pii", "redact", ["auditor"]), ("financial", "null", None)], "tag string, method string, exempt_roles array<string>"),
        frame([("customer", "c_acctbal > 0", None), ("customer", "c_nationkey <> 3", ["auditor"])], "dataset string, predicate string, exempt_roles array<string>"),
        frame([("domain", "sales", "role", "analyst"), ("domain", "sales", "role", "auditor")], "kind string, name string, to_kind string, to_name string"),
    )


def row_filtered(s, d):
    """The customers as an auditor reads them: exempt from one filter and from the mask."""
    policy = gov.policy_of(_policies(s), "customer", "eve", ["auditor"])
    return gov.read_secured(table(s, d, "customer"), policy, KEY)


def secured_query(s, d):
    """An analyst's query over secured relations."""
    safe = gov.secured_relations({"customer": table(s, d, "customer"), "orders": table(s, d, "orders")}, _policies(s), "ann", ["analyst"], KEY)
    return gov.secured_sql(s, "with big as (select * from orders where o_totalprice > 1000) select c_name, c_mktsegment, count(*) as n from customer join big on o_custkey = c_custkey group by all", safe)


def ad_hoc_query(s, d):
    """A preview of 7 rows with the flag that there are more."""
    safe = gov.secured_relations({"customer": table(s, d, "customer")}, _policies(s), "ann", ["analyst"], KEY)
    rows, more = gov.ask(s, "select c_custkey, c_name from customer order by c_custkey", safe, 7)
    return rows.withColumn("truncated", F.lit(more))


def _catalog(s, d):
    """One dataset per part, with its tags, filters and grants, and a few masking policies."""
    p, pick = table(s, d, "part"), lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    k = F.col("p_partkey")
    name = F.concat(F.lit("p"), k).alias("dataset")
    tags = p.select(name, F.lit("a").alias("column"), pick(["pii.email", "pii.name", "financial.account", "piix"], k).alias("tag"), F.when(k % 10 == 0, "suggested").otherwise("active").alias("status"))
    tags = tags.unionByName(p.where("p_partkey % 6 = 0").select(name, F.lit("b").alias("column"), F.lit("pii.email").alias("tag"), F.lit("active").alias("status")))
    masking = s.createDataFrame([("pii", "partial", ["auditor"]), ("pii.email", "hash", None), ("financial", "redact", None)], "tag string, method string, exempt_roles array<string>")
    filters = p.where("p_partkey % 50 = 0").select(name, F.lit("a > 1").alias("predicate"), F.when(k % 100 == 0, F.array(F.lit("analyst"))).alias("exempt_roles"))
    grants = p.where("p_partkey % 20 = 0").select(F.lit("dataset").alias("kind"), F.concat(F.lit("p"), k).alias("name"), F.lit("user").alias("to_kind"), F.when(k % 40 == 0, "bob").otherwise("ann").alias("to_name"))
    grants = grants.unionByName(s.createDataFrame([("domain", "Brand#12", "role", "analyst"), ("domain", "Brand#13", "role", "auditor")], "kind string, name string, to_kind string, to_name string"))
    return gov.Policies(p.select(name, F.col("p_brand").alias("domain")), tags, masking, filters, grants)


def effective_policy(s, d):
    """What holds for one principal, of every dataset."""
    e = gov.effective(_catalog(s, d), "bob", ["analyst"])
    return e.select("dataset", "restricted", "readable", F.col("masks")["a"].alias("mask_a"), F.col("masks")["b"].alias("mask_b"), F.array_join("row_filters", " and ").alias("filters"))


def grants(s, d):
    c = _catalog(s, d)
    return gov.readable(c.datasets, c.grants, "bob", ["analyst"])


def masked_profile(s, d):
    """A profile whose segment values and balance range are hidden."""
    p = q.full_profile(table(s, d, "customer").select("c_acctbal", "c_mktsegment"), exact=True)
    m = gov.mask_profile(p, {"c_mktsegment": "partial", "c_acctbal": "redact"})
    return m.select("column", "min", "mean", F.explode("top_values").alias("t")).select("column", "min", "mean", F.col("t.value").alias("value"), F.col("t.count").alias("count"))


QUERIES = {n: _one(t, r) for n, (t, r) in RULES.items()} | {
    f.__name__: f
    for f in (dq_not_null, dq_referential, dq_suite, dq_suite_errors, dq_failure_sample, dq_scorecard, dq_degradation, dq_latest, dq_series, profile_numeric, profile_string, profile_patterns, profile_top_values, profile_all_columns, pii_name_signals, pii_suggestions, mask_columns, row_filtered, secured_query, ad_hoc_query, effective_policy, grants, masked_profile)
}


def _rule_sql(name, kind, checked, failed, source, t=1.0):
    return f"select '{name}' as name, '{kind}' as kind, cast(checked as bigint) as checked, cast(failed as bigint) as failed, case when checked = 0 then 100.0 else round_even(100 * (checked - failed) / checked, 2) end as score, case when checked = 0 then 1.0 else (checked - failed) / checked end >= {t} as passed, cast(null as varchar) as error from (select {checked} as checked, {failed} as failed from {source})"


_RES = "r as (select event_type as rule, date_trunc('day', ts) as \"at\", round_even(100 * avg(case when value > 20 then 1.0 else 0.0 end), 2) as score, case when event_type = 'purchase' then 2 else 1 end as w, case when event_type in ('view', 'click') then 'traffic' else 'account' end as dimension from events group by event_type, date_trunc('day', ts))"
_LAST = "l as (select * from r qualify row_number() over (partition by rule order by \"at\" desc) = 1)"
_UNIQ = "select '{0}' as name, 'unique' as kind, cast(sum(n) as bigint) as checked, cast(coalesce(sum(n) filter (n > 1), 0) as bigint) as failed, round_even(100 * (sum(n) - coalesce(sum(n) filter (n > 1), 0)) / sum(n), 2) as score, coalesce(sum(n) filter (n > 1), 0) = 0 as passed, cast(null as varchar) as error from (select count(*) as n from {1} group by {2})"
_H = "left(sha256('k' || {0}), 16)"

ORACLES = {
    "dq_not_null": _rule_sql("n", "not_null", "count(*)", "count(*) filter (c_mktsegment = 'BUILDING')", "customer"),
    "dq_unique": _UNIQ.format("u", "lineitem", "l_orderkey, l_linenumber"),
    "dq_range": _rule_sql("r", "range", "count(*)", "count(*) filter (l_quantity < 2 or l_quantity > 45)", "lineitem"),
    "dq_regex": _rule_sql("x", "regex", "count(*)", "count(*) filter (not regexp_full_match(c_name, 'Customer#[0-9]*1'))", "customer"),
    "dq_allowed_values": _rule_sql("a", "allowed_values", "count(*)", "count(*) filter (o_orderstatus not in ('O', 'F'))", "orders"),
    "dq_freshness": _rule_sql("f", "freshness", "1", f"case when max(ts) is null or max(ts) < timestamp '{AS_OF}' - interval 60 minute then 1 else 0 end", "events"),
    "dq_row_count": _rule_sql("c", "row_count", "1", "case when count(*) < 1 or count(*) > 100 then 1 else 0 end", "orders"),
    "dq_custom_sql": _rule_sql("s", "custom_sql", "count(*)", "count(*) filter (o_totalprice < 1000)", "orders"),
    "dq_referential": _rule_sql("k", "referential", "count(*)", "count(*) filter (o_custkey not in (select c_custkey from customer where c_nationkey % 2 = 0))", "orders"),
    "dq_suite": " union all ".join([
        _rule_sql("key", "not_null", "count(*)", "count(*) filter (o_orderkey is null)", "orders"),
        _rule_sql("price", "range", "count(*)", "count(*) filter (o_totalprice < 1000)", "orders", 0.9),
        _rule_sql("status", "allowed_values", "count(*)", "count(*) filter (o_orderstatus not in ('O', 'F'))", "orders", 0.5),
        _rule_sql("rows", "row_count", "1", "case when count(*) < 1 then 1 else 0 end", "orders"),
        _UNIQ.format("unique", "orders", "o_orderkey"),
    ]),
    "dq_failure_sample": "with f as ("
    + " union all ".join([
        "select distinct 'range' as rule, cast(p_size as varchar) as value from part where p_size > 44",
        "select distinct 'regex', p_brand from part where not regexp_full_match(p_brand, 'Brand#[0-3].*')",
        "select distinct 'allowed_values', o_orderpriority from orders where o_orderpriority <> '1-URGENT'",
        "select 'unique', l_orderkey || '|' || l_linenumber from lineitem group by l_orderkey, l_linenumber having count(*) > 1",
        "select distinct 'referential', cast(o_custkey as varchar) from orders where o_custkey not in (select c_custkey from customer where c_nationkey % 2 = 0)",
        "select distinct 'custom_sql', '{\"p_size\":' || p_size || '}' from part where p_size > 47",
        "select 'row_count', cast(count(*) as varchar) from part",
    ])
    + ") select * from f qualify row_number() over (partition by rule order by value) <= 5",
    "dq_suite_errors": "select name, kind, checked, failed, score, passed, false as errored from (@suite@) union all values ('lost', 'not_null', null, null, null, false, true), ('run', 'custom_sql', null, null, null, false, true)",
    "dq_scorecard": f"with {_RES}, {_LAST} select dimension, round_even(sum(score * w) / sum(w), 2) as score from l group by 1",
    "dq_degradation": f"with {_RES}, b as (select rule as card, \"at\", score, avg(score) over (partition by rule order by \"at\" rows between 3 preceding and 1 preceding) as baseline from r) select card, \"at\", score, round(baseline, 6) as baseline, coalesce(baseline > 0 and score < baseline * 0.9, false) as degraded from b",
    "dq_latest": f"with {_RES}, {_LAST} select 'events' as dataset, count(*) as rules, count(*) filter (score < 50) as failing, 0 as unevaluated, round_even(avg(score), 2) as score from l",
    "dq_series": f"with {_RES} select rule, \"at\", score from r where rule = 'purchase' and \"at\" >= timestamp '2024-01-10'",
    "profile_numeric": " union all ".join(f"select '{c}' as \"column\", count(*) as rows, count(*) - count({c}) as nulls, count(distinct {c}) as \"distinct\", round_even(100 * count(distinct {c}) / count({c}), 6) as distinct_pct, cast(min({c}) as double) as min, cast(max({c}) as double) as max, round_even(avg({c}), 6) as mean, round_even(stddev_samp({c}), 6) as stddev from customer" for c in ("c_acctbal", "c_nationkey")),
    "profile_string": " union all ".join(f"select '{c}' as \"column\", count(*) - count({c}) as nulls, count(distinct {c}) as \"distinct\", min(length({c})) as min_length, max(length({c})) as max_length, round_even(avg(length({c})), 6) as avg_length, count(*) filter (trim({c}, ' ') = '') as blanks from documents" for c in ("lang", "source")),
    "profile_patterns": "with s(i, v) as (values "
    + ", ".join(f"({i}, '{v}')" for i, v in enumerate(SHAPES))
    + f"), t as (select replace(replace(v, '{{0}}', lpad(cast(p_partkey as varchar), 7, '0')), '{{1}}', cast(p_partkey % 300 as varchar)) as v from part join s on p_partkey % {len(SHAPES)} = i), p(pattern, re) as (values "
    + r"('email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), ('phone', '\+?[0-9][0-9 ()./-]{6,18}[0-9]'), ('url', 'https?://\S+'), ('uuid', '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}'), ('ipv4', '((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)'), ('iso_date', '\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?.*)?'), ('card_number', '(\d[ -]?){13,19}'), ('postal_code', '\d{4,5}(-\d{4})?')"
    + ") select 'value' as \"column\", pattern, round_even(100 * count(*) / (select count(*) from part), 6) as pct from t, p where regexp_full_match(v, re) group by pattern",
    "profile_top_values": "with m as (select 'o_orderstatus' as \"column\", o_orderstatus as value from orders union all select 'o_orderpriority', o_orderpriority from orders union all select 'o_custkey', cast(o_custkey as varchar) from orders), g as (select \"column\", value, count(*) as \"count\" from m where value is not null group by 1, 2) select *, row_number() over (partition by \"column\" order by \"count\" desc, value) as rank from g qualify rank <= 5",
    "mask_columns": f"select c_custkey, repeat('*', greatest(length(c_name) - 4, 0)) || right(c_name, 4) as c_name, null as c_nationkey, '****' as c_acctbal, {_H.format('c_mktsegment')} as c_mktsegment from customer",
    "row_filtered": "select * from customer where c_acctbal > 0",
    "secured_query": "select '****' as c_name, c_mktsegment, count(*) as n from customer join orders on o_custkey = c_custkey where c_acctbal > 0 and c_nationkey <> 3 and o_totalprice > 1000 group by all",
    "ad_hoc_query": "select c_custkey, '****' as c_name, (select count(*) > 7 from customer where c_acctbal > 0 and c_nationkey <> 3) as truncated from customer where c_acctbal > 0 and c_nationkey <> 3 order by c_custkey limit 7",
    "effective_policy": "select 'p' || p_partkey as dataset, p_partkey % 20 = 0 or p_brand in ('Brand#12', 'Brand#13') as restricted, not (p_partkey % 20 = 0 or p_brand in ('Brand#12', 'Brand#13')) or p_partkey % 40 = 0 or p_brand = 'Brand#12' as readable, case when p_partkey % 10 = 0 then null else case p_partkey % 4 when 0 then 'hash' when 1 then 'partial' when 2 then 'redact' end end as mask_a, case when p_partkey % 6 = 0 then 'hash' end as mask_b, case when p_partkey % 50 = 0 and p_partkey % 100 <> 0 then 'a > 1' else '' end as filters from part",
    "grants": "select 'p' || p_partkey as dataset, p_partkey % 20 = 0 or p_brand in ('Brand#12', 'Brand#13') as restricted, not (p_partkey % 20 = 0 or p_brand in ('Brand#12', 'Brand#13')) or p_partkey % 40 = 0 or p_brand = 'Brand#12' as readable from part",
    "masked_profile": "with m as (select 'c_acctbal' as \"column\", '****' as value, v from (select c_acctbal as v0, cast(c_acctbal as varchar) as v from customer) union all select 'c_mktsegment', repeat('*', greatest(length(c_mktsegment) - 4, 0)) || right(c_mktsegment, 4), c_mktsegment from customer), g as (select \"column\", value, v, count(*) as \"count\" from m group by 1, 2, 3), t as (select * from g qualify row_number() over (partition by \"column\" order by \"count\" desc, v) <= 5) select \"column\", null as min, null as mean, value, \"count\" from t",
    "profile_all_columns": "with g as ("
    + " union all ".join(
        f"select '{c}' as \"column\", {v} as value, {m} as m, count(*) as \"count\" from lineitem group by all"
        for c, v, m in [(c, f"cast({c} as varchar)", f"cast({c} as double)") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")]
        + [(c, c, "null::double") for c in ("l_returnflag", "l_linestatus")]
        + [("l_shipdate", "cast(l_shipdate as varchar)", "null::double")]
    )
    + "), a as (select \"column\", cast(sum(\"count\") as bigint) as rows, 0 as nulls, count(*) as \"distinct\" from g group by 1), m as ("
    + " union all ".join(f"select '{c}' as \"column\", round_even(avg({c}), 6) as mean from lineitem" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    + "), t as (select \"column\", value, \"count\", row_number() over (partition by \"column\" order by \"count\" desc, value) - 1 as rank from g qualify rank < 5) select \"column\", rows, nulls, \"distinct\", mean, cast(rank as int) as rank, value, \"count\" from t join a using (\"column\") left join m using (\"column\")",
}

#: The rules on column names once more, as sets of names: what each of COLUMNS is.
_NAMED = {
    "email": ("email", "pii.email", 0.8, "email address"), "e_mail": ("e_mail", "pii.email", 0.8, "email address"), "mobile_no": ("mobile_no", "pii.phone", 0.8, "phone number"),
    "tel": ("tel", "pii.phone", 0.8, "phone number"), "first_name": ("first_name", "pii.name", 0.7, "person name"),
    "mail_address": ("mail_address", "pii.email", 0.8, "email address"), "address_line_1": ("address_line_1", "pii.address", 0.6, "postal address"), "dob": ("dob", "pii.birth_date", 0.8, "date of birth"),
    "ssn": ("ssn", "pii.national_id", 0.8, "national identifier (ssn, passport, tax id)"), "card_number": ("card_number", "pii.card_number", 0.8, "payment card number (pci)"), "client_ip": ("client_ip", "pii.ip_address", 0.7, "ip address"),
    "hk_email": ("hk_email", "pii.email", 0.8, "email address"), "fullname": ("fullname", "pii.name", 0.7, "person name"), "passport_no": ("passport_no", "pii.national_id", 0.8, "national identifier (ssn, passport, tax id)"),
    "zip_code": ("zip_code", "pii.address", 0.6, "postal address"), "pan": ("pan", "pii.card_number", 0.8, "payment card number (pci)"),
}
_CATALOG = "c as (select 'crm.t' || p_partkey as dataset, ['" + "', '".join(COLUMNS) + f"'][p_partkey % {len(COLUMNS)} + 1] as \"column\" from part), r(\"column\", tag, confidence, what) as (values " + ", ".join(f"('{n}', '{t}', cast({c} as double), '{w}')" for n, t, c, w in _NAMED.values()) + ")"
ORACLES["dq_suite_errors"] = ORACLES["dq_suite_errors"].replace("@suite@", ORACLES["dq_suite"])
ORACLES["pii_name_signals"] = f"with {_CATALOG} select dataset, \"column\", tag, confidence, 'column name ' || chr(39) || \"column\" || chr(39) || ' looks like ' || what as reason from c join r using (\"column\")"
ORACLES["pii_suggestions"] = f"""with {_CATALOG}
select tag, dataset, "column", confidence, 'column name ' || chr(39) || "column" || chr(39) || ' looks like ' || what as reason from c join r using ("column") where "column" <> 'hk_email' and not ("column" = 'ssn' and dataset like '%9')
union all values ('pii.email', 'silver.contacts', 'contact', 0.99, '100% of values look like emails'), ('pii.phone', 'silver.contacts', 'line', 0.99, '100% of values look like phones')
union all select 'pii.email', 'gold.n' || s_nationkey, 'who', 0.9, max('computed from silver.s' || s_suppkey || '.contact, which is classified pii.email') from supplier where s_suppkey % 3 <> 0 group by s_nationkey"""
