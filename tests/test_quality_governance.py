from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strata.operators import governance as g
from strata.operators import lineage as lin
from strata.operators import quality as q
from strata.operators.quality import Rule

NOW = datetime(2026, 1, 2)


@pytest.fixture(scope="module")
def customers(spark):
    rows = [(1, "a@x.io", "+47 400 11 222", "NO", 20), (2, None, "+47 400 11 223", "NO", 230), (3, "c@x.io", "none", "SE", 31), (4, "d@x.io", "+47 400 11 225", "XX", 230), (4, "nope", "x", "DK", 40)]
    return spark.createDataFrame(rows, "id int, email string, phone_number string, country string, age int").withColumn("_load_ts", F.lit(datetime(2026, 1, 1, 22)))


def test_rules(spark, customers):
    rules = [
        Rule("nn", "not_null", ("email",)),
        Rule("un", "unique", ("id",)),
        Rule("ra", "range", ("age",), {"min": 0, "max": 120}),
        Rule("re", "regex", ("email",), {"pattern": r"[^@]+@x\.io"}),
        Rule("al", "allowed_values", ("country",), {"values": ["NO", "SE", "DK"]}),
        Rule("fr", "freshness", ("_load_ts",), {"minutes": 60}),
        Rule("rc", "row_count", (), {"min": 5, "max": 5}),
        Rule("cu", "custom_sql", (), {"sql": "select * from data where age > 200 and country = 'NO'"}),
    ]
    got = {r.name: (r.checked, r.failed, r.passed) for r in q.evaluate(customers, rules, NOW).collect()}
    assert got == {"nn": (5, 1, False), "un": (5, 2, False), "ra": (5, 2, False), "re": (4, 1, False), "al": (5, 1, False), "fr": (1, 1, False), "rc": (1, 0, True), "cu": (5, 1, False)}
    orders = spark.createDataFrame([(1,), (2,), (99,), (None,)], "cid int")
    (r,) = q.evaluate(orders, [Rule("k", "referential", ("cid",), {"reference": "c", "column": "id"})], references={"c": customers}).collect()
    assert (r.checked, r.failed, r.score) == (3, 1, 66.67)
    (e,) = q.evaluate(customers.limit(0), [Rule("nn", "not_null", ("email",))]).collect()
    assert (e.checked, e.score, e.passed) == (0, 100.0, True)
    assert [r.value for r in q.failing(customers, rules[2]).collect()] == ["230"]
    nl = spark.createDataFrame([("a\n",), ("a",)], "s string")
    assert q.evaluate(nl, [Rule("x", "regex", ("s",), {"pattern": "a"})]).first().failed == 1


def test_null_keys_are_duplicates_of_each_other(spark):
    df = spark.createDataFrame([(None,), (None,), (1,)], "k int")
    assert q.evaluate(df, [Rule("u", "unique", ("k",))]).first().failed == 2


def test_scorecard_and_degradation(spark):
    at = lambda d: datetime(2026, 1, d)
    rows = [("a", at(1), 100.0, "critical"), ("b", at(1), 80.0, "warning"), ("a", at(2), 50.0, "critical"), ("c", at(2), None, "warning")]
    r = spark.createDataFrame(rows, "rule string, at timestamp, score double, severity string")
    assert q.scorecard(r).first().score == 45.0
    s = spark.createDataFrame([("x", at(1), 93.33), ("x", at(2), 93.33), ("x", at(3), 73.33)], "card string, at timestamp, score double")
    last = q.degradation(s, 3, 10).orderBy("at").collect()
    assert [x.degraded for x in last] == [False, False, True] and last[0].baseline is None and round(last[2].baseline, 2) == 93.33


def test_profile(customers):
    p = {r.column: r for r in q.full_profile(customers, exact=True).collect()}
    assert (p["email"].nulls, p["email"].distinct, p["email"].patterns) == (1, 4, {"email": 75.0})
    assert (p["age"].min, p["age"].max, p["age"].top_values[0].value) == ("20.0", "230.0", "230")




def test_masking_filters_and_policies(spark, customers):
    tags = spark.createDataFrame([("c", "email", "pii.email", "active"), ("c", "phone_number", "pii.phone", "active"), ("c", "country", "pii.x", "suggested")], "dataset string, column string, tag string, status string")
    policies = spark.createDataFrame([("pii.email", "hash", None), ("pii", "partial", ["boss"])], "tag string, method string, exempt_roles array<string>")
    masks = {r.column: r.method for r in g.column_masks(tags, policies, ["analyst"]).collect()}
    assert masks == {"email": "hash", "phone_number": "partial"}
    assert {r.column for r in g.column_masks(tags, policies, ["boss"]).collect()} == {"email"}
    seen = g.secured(customers, masks, ["country <> 'XX'"], "k").collect()
    assert len(seen) == 4 and all(r.email is None or len(r.email) == 16 for r in seen) and seen[0].phone_number == "**********" + " 222"[-4:]
    for bad in ("id in (select 1)", "exists (select 1)"):
        with pytest.raises(ValueError):
            g.checked_predicate(customers, bad)
    with pytest.raises(g.AccessDenied):
        g.checked_predicate(customers, "reflect('java.lang.System', 'getenv', 'HOME') = 'x'")
    with pytest.raises(Exception):
        g.checked_predicate(customers, "sum(age) > 1")
    with pytest.raises(ValueError):
        g.checked_predicate(customers, "age + 1")
    grants = spark.createDataFrame([("domain", "sales", "role", "analyst")], "kind string, name string, to_kind string, to_name string")
    assert g.allowed(grants, "d", "sales", "u", ["analyst"]) and g.allowed(grants, "d", "hr", "u", []) and not g.allowed(grants, "d", "sales", "u", ["other"]) and g.allowed(grants, "d", "sales", "u", ["admin"])


def test_secured_sql_names_its_relations_only(spark, customers, tmp_path):
    customers.write.parquet(str(tmp_path / "raw"))
    customers.createOrReplaceTempView("open_view")
    safe = {"t": g.secured(customers, {"email": "redact"}, [])}
    good = ("select email from t", "with x as (select * from t) select email from x", "select email from (select * from T) where id in (select id from t)", "select email from t order by id limit 2 -- end")
    for sql in good:
        assert {r.email for r in g.secured_sql(spark, sql, safe).collect()} <= {"****", None}
    bad = (
        f"select * from parquet.`{tmp_path}/raw`",
        "select * from open_view",
        "select * from t where id in (select id from open_view)",
        "with x as (select * from open_view) select * from x",
        "select * from (with open_view as (select 1 as a) select * from open_view) a, open_view",
        "select (select max(email) from open_view) from t",
        "select reflect('java.lang.System', 'getenv', 'HOME') from t",
        "select * from default.t",
        "select * from sql_keywords()",
        "select * from identifier('open_view')",
    )
    for sql in bad:
        with pytest.raises(PermissionError):
            g.secured_sql(spark, sql, safe)
    for sql in ("drop view open_view", "insert into t values (1)", "select 1; select 2"):
        with pytest.raises(Exception):
            g.secured_sql(spark, sql, safe)
    assert not [v.name for v in spark.catalog.listTables() if v.name.startswith("_secured_")]
    few, more = g.ask(spark, "select id from t order by id", safe, 2)
    assert ([r.id for r in few.collect()], more) == ([1, 2], True) and g.ask(spark, "select id from t", safe, 5)[1] is False


def test_denied_reads_are_errors(spark, customers):
    frame = spark.createDataFrame
    p = g.Policies(
        frame([("c", "sales"), ("d", None)], "dataset string, domain string"),
        frame([("c", "email", "pii.email", "active")], "dataset string, column string, tag string, status string"),
        frame([("pii", "redact", ["boss"])], "tag string, method string, exempt_roles array<string>"),
        frame([("c", "country <> 'XX'", ["boss"])], "dataset string, predicate string, exempt_roles array<string>"),
        frame([("domain", "sales", "role", "analyst"), ("dataset", "d", "user", "ann")], "kind string, name string, to_kind string, to_name string"),
    )
    seen = g.secured_relations({"c": customers}, p, "eve", ["analyst"])["c"].collect()
    assert len(seen) == 4 and {r.email for r in seen} == {"****", None}
    assert g.policy_of(p, "c", "x", ["admin", "boss"]) == g.DatasetPolicy("c", True, True, {}, ())
    assert g.policy_of(p, "d", "ann", []).readable and not g.policy_of(p, "d", "eve", []).readable
    with pytest.raises(g.AccessDenied):
        g.secured_relations({"c": customers}, p, "eve", ["other"])
    with pytest.raises(LookupError):
        g.policy_of(p, "nothing", "eve", [])


@pytest.mark.parametrize("column, tags", [("email", {"pii.email"}), ("mail_addr", {"pii.email", "pii.address"}), ("customer_phone_no", {"pii.phone"}), ("name", {"pii.name"}), ("filename", set()), ("mail_address", {"pii.email"}), ("home_address", {"pii.address"}), ("card_no", {"pii.card_number"}), ("client_ip", {"pii.ip_address"}), ("ship_date", set()), ("personnummer", {"pii.national_id"})])
def test_name_signals(spark, column, tags):
    got = g.name_signals(spark.createDataFrame([("d", column)], "dataset string, column string")).collect()
    assert {r.tag for r in got} == tags and all(r.reason.startswith(f"column name '{column}' looks like ") for r in got)


def test_value_patterns():
    import re

    fits = lambda name, text: bool(re.fullmatch(q.PATTERNS[name], text))
    assert fits("ipv4", "255.1.0.99") and not fits("ipv4", "256.1.1.1")
    assert fits("iso_date", "2024-01-15") and fits("iso_date", "2024-01-15T10:30:00Z") and not fits("iso_date", "2024-1-5")
    assert fits("phone", "+47 400/11 222") and not fits("phone", "1" * 21) and fits("postal_code", "0150") and fits("card_number", "4111 1111 1111 1111 ")


def test_suite_keeps_errors_apart(spark, customers):
    rules = [Rule("ok", "not_null", ("id",)), Rule("lost", "unique", ("nothing",)), Rule("sql", "custom_sql", (), {"sql": "select * frm data"}), Rule("ref", "referential", ("id",), {"reference": "none", "column": "id"}), Rule("run", "custom_sql", (), {"sql": "select * from data where cast(email as int) = 1"})]
    got = {r.name: r for r in q.run(customers, rules).collect()}
    assert (got["ok"].passed, got["ok"].error) == (True, None)
    assert all(got[n].error and not got[n].passed and got[n].score is None for n in ("lost", "sql", "ref", "run")) and "nothing" in got["lost"].error
    assert q.failing(customers, Rule("nn", "not_null", ("email",))).collect() == []
    assert [r.value for r in q.failing(customers, Rule("k", "referential", ("id",), {"reference": "c", "column": "id"}), {"c": customers.where("id < 3")}).collect()] == ["3", "4"]
    assert [r.value for r in q.failing(customers, Rule("s", "custom_sql", (), {"sql": "select id from data where age > 200"})).collect()] == ['{"id":2}', '{"id":4}']
    assert [r.value for r in q.failing(customers, Rule("u", "unique", ("id",))).collect()] == ["4"]


def test_suggestions_are_made_once(spark):
    cols = spark.createDataFrame([("c", "email"), ("c", "hk_email"), ("c", "_batch_id")], "dataset string, column string")
    none = spark.createDataFrame([], "dataset string, column string, tag string, status string")
    first = g.suggest([g.name_signals(cols)], none)
    assert [(r.column, r.tag) for r in first.collect()] == [("email", "pii.email")]
    kept = first.select("dataset", "column", "tag", F.lit("rejected").alias("status"))
    assert g.suggest([g.name_signals(cols)], kept).count() == 0


def test_alerts_open_once_and_clear(spark):
    none = spark.createDataFrame([], "kind string, target string, message string, opened_at timestamp, resolved_at timestamp")
    cond = spark.createDataFrame([("freshness", "a", "late")], "kind string, target string, message string")
    one = lin.alert_state(cond, none, NOW)
    two = lin.alert_state(cond.withColumn("message", F.lit("later")), one, datetime(2026, 1, 3))
    assert [(r.message, r.opened_at, r.resolved_at) for r in two.collect()] == [("later", NOW, None)]
    three = lin.alert_state(cond.limit(0), two, datetime(2026, 1, 4))
    assert [r.resolved_at for r in three.collect()] == [datetime(2026, 1, 4)]
    assert lin.alert_state(cond, three, datetime(2026, 1, 5)).count() == 2


def test_reach_stops_on_cycles(spark):
    e = spark.createDataFrame([("a", "b", "j"), ("b", "c", "j"), ("c", "a", "j"), ("x", "a", "j")], "source string, target string, job string")
    assert {(r.node, r.distance) for r in lin.reach(e, ["a"]).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r.node for r in lin.reach(e, ["a"], 1, "both").collect()} == {"a", "b", "c", "x"}
    d = lin.drift(spark.createDataFrame([("a", "int"), ("b", "int")], "column string, type string"), spark.createDataFrame([("a", "bigint"), ("c", "int"), ("d", "int")], "column string, type string"), spark.createDataFrame([("c",)], "column string"))
    assert {(r.column, r.change) for r in d.collect()} == {("a", "type_changed"), ("b", "removed"), ("c", "re-added"), ("d", "added")}


def test_heavy_values_are_proven_or_counted(spark):
    """A long tail, ties at the edge, unique keys and nulls: always what counting everything gives."""
    rows = [(i, f"v{i % 7}" if i % 3 else f"t{i}", i % 2 == 0, None, float(i % 11)) for i in range(5000)]
    df = spark.createDataFrame(rows, "k int, tail string, half boolean, none string, d double")
    want = sorted(map(tuple, q.top_values(df).collect()))
    for tracked in (10, 100, 10_000):
        assert sorted(map(tuple, q.heavy_values(df, tracked=tracked).collect())) == want
    assert q.heavy_values(df.limit(0)).collect() == []
    many = spark.range(200_000).selectExpr("if(id % 4 = 0, concat('h', id % 5), concat('u', id)) as x")
    plan = q.heavy_values(many, tracked=50_000)
    assert plan.count() == 5 and "Range" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.value for r in plan.collect()) == ["h0", "h1", "h2", "h3", "h4"]


def test_custom_sql_leaves_a_users_view_alone(spark):
    spark.range(2).createOrReplaceTempView("data")
    df = spark.createDataFrame([(1,), (5,), (9,)], "x int")
    for sql in ("select * from data where x > 3", "with big as (select * from data where x > 3) select * from big", "select x from data where x in (select max(x) from data) union all select x from data where x = 5"):
        r = q.evaluate(df, [Rule("r", "custom_sql", (), {"sql": sql})]).first()
        assert (r.checked, r.failed, r.error) == (3, 2, None)
    assert spark.table("data").count() == 2
    spark.catalog.dropTempView("data")
