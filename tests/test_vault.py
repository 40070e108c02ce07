import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strata.functions.text import hash_key, hashdiff, text_of
from strata.operators import models, vault

T0 = datetime(2026, 1, 1)


def test_hashes_equal_their_plain_form(spark):
    df = spark.createDataFrame([(" ab ", 1, None), (None, None, "x|")], "a string, b int, c string")
    got = df.select(hash_key(df, ["a", "b", "c"]).alias("k"), hashdiff(df, ["a", "b", "c"]).alias("d")).collect()
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()
    assert got[0].k == sha("AB||1||") and got[0].d == sha("ab||1")
    assert got[1].k == sha("||||X|") and got[1].d == sha("||||x")


def test_text_of_doubles(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.5, 12345678.9, 0.0001, -2e7, 3.0)], "d double")
    assert [r[0] for r in df.select(text_of(df, "d")).collect()] == ["0.0", "1.5", "12345678.9", "0.0001", "-20000000.0", "3.0"]


def batch(spark, rows, n, op=False):
    at = T0 + timedelta(days=n)
    df = spark.createDataFrame(rows, "id int, name string, city string")
    return vault.stage(df.withColumns({"_load_ts": F.lit(at), "_source": F.lit("s"), "_batch_id": F.lit(f"b{n}")}), "customers")


def test_reloading_adds_nothing_and_changes_version(spark):
    one = batch(spark, [(1, "Ann", "Rome"), (2, "Bob", "Oslo")], 0)
    hub, sat = vault.hub(one, "c", ["id"]), vault.satellite(one, "c", ["id"], ["name", "city"])
    assert (hub.count(), sat.count()) == (2, 2)
    two = batch(spark, [(1, "Ann", "Rome"), (2, "Bob", "Oslo")], 1)
    assert vault.hub(two, "c", ["id"], hub).count() == vault.satellite(two, "c", ["id"], ["name", "city"], sat).count() == 0
    three = batch(spark, [(1, "Ann", "Paris"), (3, "Cy", "Lima")], 2)
    assert vault.hub(three, "c", ["id"], hub).count() == 1
    new = vault.satellite(three, "c", ["id"], ["name", "city"], sat)
    assert sorted(r.city for r in new.collect()) == ["Lima", "Paris"]
    snaps = vault.pit(hub, "c", {"main": sat.unionByName(new)})
    assert snaps.count() == 3  # Cy isn't in this hub
    with pytest.raises(ValueError):
        vault.pit(hub, "d", {"main": sat})


def test_changes_with_deletes(spark):
    rows = [(1, "Oslo", "c", 0), (1, "Oslo", "u", 1), (1, "Bergen", "u", 2), (1, None, "d", 3), (None, "x", "c", 0)]
    df = spark.createDataFrame([(i, c, o, T0 + timedelta(days=d), T0) for i, c, o, d in rows], "id int, city string, _op string, _source_ts timestamp, _load_ts timestamp")
    st = vault.stage(df, "customers")
    assert [r.city for r in vault.satellite(st, "c", ["id"], ["city"]).orderBy("load_date").collect()] == ["Oslo", "Bergen"]
    assert [r.is_deleted for r in vault.status_satellite(st, "c", ["id"]).orderBy("load_date").collect()] == [False, True]
    dim = models.scd2(df.where("_op <> 'd' and id is not null"), ["id"], ["city"], "_source_ts", deletes=df.where("_op = 'd'"))
    got = dim.orderBy("valid_from").collect()
    assert [(r.city, r.is_current) for r in got] == [("Oslo", False), ("Bergen", False)] and got[0].valid_to == got[1].valid_from
    assert sorted(r.sk for r in got) == sorted(r.sk for r in models.scd2(df.where("_op <> 'd' and id is not null"), ["id"], ["city"], "_source_ts", deletes=df.where("_op = 'd'")).collect())


def test_links_and_bridge_leave_null_keys_out(spark):
    df = spark.createDataFrame([(1, 7), (2, 7), (3, None)], "oid int, cust int").withColumn("_load_ts", F.lit(T0))
    st = vault.stage(df, "orders")
    link = vault.link(st, "oc", {"order": ["oid"], "customer": ["cust"]})
    assert (vault.hub(st, "customer", ["cust"]).count(), vault.hub(st, "order", ["oid"]).count(), link.count()) == (1, 3, 2)
    assert vault.link(st, "oc", {"order": ["oid"], "customer": ["cust"]}, link).count() == 0
    assert vault.bridge(vault.hub(st, "customer", ["cust"]), "customer", [link]).count() == 2
    with pytest.raises(ValueError):
        vault.bridge(vault.hub(st, "x", ["oid"]).withColumnRenamed("hk_x", "hk_y"), "y", [link])
    with pytest.raises(ValueError):
        vault.hub(st, "x", ["nope"])


def test_high_water_mark(spark):
    df = spark.createDataFrame([(1, T0), (2, T0 + timedelta(days=1))], "id int, _load_ts timestamp")
    assert vault.since(df, T0).count() == 1 and vault.since(df, None).count() == 2
    assert vault.high_mark(df, None) == T0 + timedelta(days=1) == vault.high_mark(df.limit(0), T0 + timedelta(days=1))


def test_facts_and_calendar(spark):
    dim = spark.createDataFrame([("a", "7", T0, T0 + timedelta(days=10), False), ("b", "7", T0 + timedelta(days=10), None, True)], "sk string, cust string, valid_from timestamp, valid_to timestamp, is_current boolean")
    fact = spark.createDataFrame([(1, 7, T0 + timedelta(days=3)), (2, 7, T0 + timedelta(days=10)), (3, 8, T0)], "sale int, cust int, at timestamp")
    assert [r.k for r in models.lookup(fact, dim, {"cust": "cust"}, "k", "at").orderBy("sale").collect()] == ["a", "b", "-1"]
    assert [r.k for r in models.lookup(fact, dim, {"cust": "cust"}, "k").orderBy("sale").collect()] == ["b", "b", "-1"]
    days = models.calendar(spark, "2024-02-27", "2024-03-02").orderBy("date").collect()
    assert [d.date_key for d in days] == [20240227, 20240228, 20240229, 20240301, 20240302] and days[-1].is_weekend and days[3].month_name == "March"


def test_as_of_look_ups_of_hot_keys_and_long_histories(spark):
    """One key with half the facts and hundreds of versions, against a plain range join; the hot key's join is split."""
    at = lambda m: T0 + timedelta(minutes=m)
    dim = [(f"k{k}-{v}", str(k), at(10 * v), at(10 * v + 10) if v + 1 < n else None, v + 1 == n) for k, n in ((7, 300), (8, 1), (9, 3)) for v in range(n)]
    dim.append(("empty", "7", at(50), at(50), False))  # a version of no length
    fact = [(i, 7 if i % 2 else 8 + i % 3, at(i % 3100 - 20) if i % 50 else None) for i in range(4000)]
    dims = spark.createDataFrame(dim, "sk string, cust string, valid_from timestamp, valid_to timestamp, is_current boolean")
    facts = spark.createDataFrame(fact, "sale int, cust int, at timestamp")

    def plain(cust, when):
        return next((s for s, k, a, b, _ in dim if when is not None and k == str(cust) and a <= when and (b is None or when < b)), "-1")

    want = [plain(c, t) for _, c, t in fact]
    for each in (1, 7, models.VERSIONS):
        got = models.lookup(facts, dims, {"cust": "cust"}, "k", "at", {"v": "sk"}, each).orderBy("sale").collect()
        assert [r.k for r in got] == want == [r.v or "-1" for r in got]
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, x in keys.items():
            spark.conf.set(k, x)
        hot = models.lookup(facts.repartition(8), dims, {"cust": "cust"}, "k", "at", each=10_000)
        assert [r.k for r in hot.orderBy("sale").collect()] == want
        seen = hot.where("k is not null")
        seen.collect()
        assert "skew=true" in seen._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)


def test_hashes_are_made_behind_the_shuffle(spark):
    """Hubs, links and bridges shuffle key texts; the plan's hashes stand above its aggregates. Equal texts of other parts are one key."""
    rows = [("a||b", "c", "p", 1), ("a", "b||c", "p", 0), ("a", "b", "q", 2), ("a ", "B", "q", 1), (None, "b", "q", 0)]
    df = spark.createDataFrame([(a, b, p, T0 + timedelta(days=n), f"b{n}") for a, b, p, n in rows], "a string, b string, p string, _load_ts timestamp, _batch_id string")
    st = vault.stage(df, "s")
    link, hub = vault.link(st, "ab", {"x": ["a"], "y": ["b"]}), vault.hub(st, "ab", ["a", "b"])
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()
    assert sorted(map(tuple, link.select("hk_ab", "hk_x", "hk_y", "_batch_id").collect())) == sorted([(sha("A||B||C"), sha("A"), sha("B||C"), "b0"), (sha("A||B"), sha("A"), sha("B"), "b1")])
    assert sorted(map(tuple, hub.select("hk_ab", "a", "b").collect())) == sorted([(sha("A||B||C"), "a", "b||c"), (sha("A||B"), "a", "B")])
    st = st.where("a <> 'a||b'")  # its link hash is another pair's, so a stored link has only one of both
    other = vault.link(st, "bp", {"y": ["b"], "z": ["p"]})
    stored = vault.bridge(vault.hub(st, "x", ["a"]), "x", [vault.link(st, "ab", {"x": ["a"], "y": ["b"]}), other])
    texts = vault.bridge(vault.key_texts(st, {"x": ["a"]}), "x", [vault.key_texts(st, {"x": ["a"], "y": ["b"]}), vault.key_texts(st, {"y": ["b"], "z": ["p"]})], hashed=False)
    assert texts.columns == ["hk_x", "hk_y", "hk_z"] and sorted(map(tuple, texts.collect())) == sorted(tuple(r[c] for c in texts.columns) for r in stored.collect())
    for made, below in ((hub, "Aggregate"), (link, "Aggregate"), (texts, "Join")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "sha1" in plan and "sha1" not in plan[plan.index(below) :]
