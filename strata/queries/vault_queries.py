"""Vault and model queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strata.operators import models, vault
from strata.operators.tables import last_per_key, merge
from strata.operators.versions import Versions
from strata.sources import serving
from strata.plans.pipeline import Pipeline, build, load_raw_vault, materialise
from strata.queries.base import BRONZE_EVENTS, BRONZE_ORDERS, ORDERS_CUT, bronze_events, bronze_orders, diff_sql, key_sql, table
from strata.session import shared_dir



def _orders(s, d):
    return vault.stage(bronze_orders(s, d), "orders")


def _cut(df, after):
    at = F.lit(ORDERS_CUT).cast("timestamp_ntz")
    return df.where(F.col("load_date") >= at if after else F.col("load_date") < at)


def hub_customer(s, d):
    return vault.hub(_orders(s, d), "customer", ["o_custkey"])


def hub_customer_delta(s, d):
    """Keys that come behind the high-water mark of the first load and aren't in its hub."""
    rows = _orders(s, d)
    first = _cut(rows, False)
    return vault.hub(vault.since(rows, vault.high_mark(first, None)), "customer", ["o_custkey"], vault.hub(first, "customer", ["o_custkey"]))


def link_customer_order(s, d):
    return vault.link(_orders(s, d), "customer_order", {"customer": ["o_custkey"], "order": ["o_orderkey"]})


def _lines(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_shipdate").alias("_load_ts"), F.lpad(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"), 30, "0").alias("_batch_id"))
    return vault.stage(li, "lineitem")


def link_order_part(s, d):
    return vault.link(_lines(s, d), "order_part", {"order": ["l_orderkey"], "part": ["l_partkey"]})


def _priority(rows, target=None):
    return vault.satellite(rows, "customer", ["o_custkey"], ["o_orderpriority"], target)


def sat_customer_priority(s, d):
    return _priority(_orders(s, d))


def _interleaved(rows):
    return rows.where("o_orderkey % 3 = 0"), rows.where("o_orderkey % 3 <> 0")


def sat_customer_priority_delta(s, d):
    old, new = _interleaved(_orders(s, d))
    return _priority(new, _priority(old))


def sat_customer_status_multi(s, d):
    return vault.satellite(_orders(s, d), "customer", ["o_custkey"], ["o_orderpriority"], active=["o_orderstatus"])


def sat_user_status(s, d):
    return vault.status_satellite(vault.stage(bronze_events(s, d), "events"), "user", ["user_id"])


def _status_of_orders(rows):
    return vault.satellite(rows, "customer", ["o_custkey"], ["o_orderstatus"])


def pit_customer(s, d):
    rows = _orders(s, d)
    return vault.pit(vault.hub(rows, "customer", ["o_custkey"]), "customer", {"priority": _priority(rows), "status": _status_of_orders(rows)})


def bridge_customer_part(s, d):
    rows, customer, order = _orders(s, d), {"customer": ["o_custkey"]}, {"order": ["o_orderkey"]}
    links = [vault.key_texts(rows, customer | order), vault.key_texts(_lines(s, d), {"order": ["l_orderkey"], "part": ["l_partkey"]})]
    return vault.bridge(vault.key_texts(rows, customer), "customer", links, hashed=False)


def raw_vault_counts(s, d):
    """Rows to add per table, of one description over orders."""
    spec = {"hub": ("order", ["o_orderkey"]), "satellites": {"order_price": ["o_totalprice", "o_orderstatus"]}, "track_deletes": True, "links": {"order_customer": {"order": ["o_orderkey"], "customer": ["o_custkey"]}}}
    made = load_raw_vault(bronze_orders(s, d), "orders", spec)
    out = [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, t in made.items()]
    first = out[0]
    for o in out[1:]:
        first = first.unionByName(o)
    return first


def _dim(s, d):
    rows = _orders(s, d)
    sat = models.with_hub_keys(_priority(rows), vault.hub(rows, "customer", ["o_custkey"]), "customer")
    return models.scd2(sat, ["o_custkey"], ["o_orderpriority"], "load_date", ["_batch_id"])


def dim_customer_scd2(s, d):
    return _dim(s, d)


def dim_user_scd2_deletes(s, d):
    e = bronze_events(s, d)
    return models.scd2(e.where("_op <> 'd'"), ["user_id"], ["event_type"], "_source_ts", ["_batch_id"], e.where("_op = 'd'"))


def _shipped(s, d):
    li, o = table(s, d, "lineitem"), table(s, d, "orders").select("o_orderkey", "o_custkey")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice", "l_discount").join(o, F.col("l_orderkey") == F.col("o_orderkey"))


def fct_lineitem_asof(s, d):
    f = models.lookup(_shipped(s, d).withColumn("ship_before", F.col("l_shipdate") - F.expr("interval 200 days")), _dim(s, d), {"o_custkey": "o_custkey"}, "customer_sk", "ship_before")
    return f.select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey", "l_shipdate", "customer_sk")


def fct_orders_current(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return models.lookup(o, _dim(s, d), {"o_custkey": "o_custkey"}, "customer_sk")


def revenue_by_priority(s, d):
    """The flagship: revenue by the customer's order priority as of the ship date."""
    dim = _dim(s, d)
    named = models.lookup(_shipped(s, d), dim, {"o_custkey": "o_custkey"}, "customer_sk", "l_shipdate", {"o_orderpriority": "o_orderpriority"})
    return named.groupBy(F.coalesce("o_orderpriority", F.lit("none")).alias("priority")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("lines"))


def dim_date(s, d):
    """Days from the first to the last order."""
    r = table(s, d, "orders").agg(F.min("o_orderdate").cast("date").cast("string").alias("a"), F.max("o_orderdate").cast("date").cast("string").alias("b")).first()
    return models.calendar(s, r.a, r.b)


def _split(s, d):
    o = bronze_orders(s, d).select("o_orderkey", "o_custkey", "o_totalprice", "_load_ts")
    at = F.lit(ORDERS_CUT).cast("timestamp_ntz")
    return o.where(F.col("_load_ts") < at), o.where(F.col("_load_ts") >= at)


def model_incremental_merge(s, d):
    old, new = _split(s, d)
    last = lambda x: last_per_key(x, ["o_custkey"], ["_load_ts", "o_orderkey"])
    return materialise(new, last(old), "incremental", ["o_custkey"], ["_load_ts", "o_orderkey"])


def model_incremental_append(s, d):
    old, new = _split(s, d)
    return materialise(new, old.drop("o_totalprice"), "incremental")


def promote_silver(s, d):
    return models.promote(bronze_orders(s, d))


def pipeline_revenue(s, d):
    """The last of three models; a broken one beside them blocks nothing else."""

    def broken(x):
        return x.select("no_such_column")

    p = Pipeline({
        "priced": ({"lineitem"}, lambda lineitem: lineitem.withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))),
        "by_order": ({"priced"}, lambda priced: priced.groupBy("l_orderkey").agg(F.sum("revenue").alias("revenue"))),
        "by_status": ({"by_order", "orders"}, lambda by_order, orders: by_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderstatus").agg(F.round(F.sum("revenue"), 2).alias("revenue"))),
        "broken": ({"priced"}, lambda priced: broken(priced)),
        "after_broken": ({"broken"}, lambda broken: broken),
    })
    frames, _ = p.run({"lineitem": table(s, d, "lineitem"), "orders": table(s, d, "orders")})
    return frames["by_status"]


MODEL = """
select o_custkey, max(o_orderdate) as last_order, count(*) as orders from {{ source('tpch', 'orders') }} o
{% if is_incremental() %} where o_orderdate > (select max(last_order) from {{ this }}) {% endif %} group by o_custkey
"""


def model_templated(s, d):
    """A templated model built twice: in full over the orders up to a day, then over what is newer, merged by its key."""
    o, key = table(s, d, "orders"), ("source", "tpch", "orders")
    first = build(s, MODEL, {key: _upto(o)})
    return materialise(build(s, MODEL, {key: o}, first), first, "incremental", ["o_custkey"], ["last_order"])


def _upto(o):
    return o.where(F.col("o_orderdate") < F.lit(ORDERS_CUT).cast("timestamp_ntz"))


def watermark_delta(s, d):
    """Orders past the watermark."""
    from strata.sources.incremental import after

    o = table(s, d, "orders")
    return after(o, "o_orderdate", F.lit(ORDERS_CUT).cast("timestamp_ntz")).select("o_orderkey", "o_orderdate")


def versions_upsert(s, d):
    """A full load, then upserts: one with fewer columns, which keep their values, and one after a compaction."""
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    held = o.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.lit(0.0)).withColumn("o_orderstatus", F.lit("?"))
    t, keys = Versions(s, f"{shared_dir(s)}/versions-{uuid.uuid4().hex}"), ["o_orderkey"]
    t.write(held, keys=keys)
    t.upsert(o.where("o_orderkey % 3 = 0"), keys)
    t.compact(fold=0.0)
    t.upsert(o.where("o_orderkey % 5 = 0").select("o_orderkey", "o_totalprice"), keys)
    return t.read()


def serving_upsert(s, d):
    """A serving table replaced by a model, then upserted with what changed; read back from the database.

    The database is the session's `strata.serving.url`. Without one it is in the driver's memory in local sessions, and on
    a cluster, whose executors don't reach that, the shared folder.
    """
    url = s.conf.get("strata.serving.url", None)
    if url is None:
        local = s.sparkContext.master.startswith("local[")
        url = f"jdbc:derby:memory:serving{uuid.uuid4().hex};create=true" if local else f"{serving.SHARED}{shared_dir(s)}/serving"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver" if ":derby:" in url else None
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    held = o.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.lit(0.0)).withColumn("o_orderstatus", F.lit("?"))
    name, keys = f"orders_{uuid.uuid4().hex[:8]}", ["o_orderkey"]
    serving.serve(held, None, url, name, keys, driver)
    serving.serve(held, o.where("o_orderkey % 3 = 0"), url, name, keys, driver)
    return serving.served(s, url, name, driver).withColumn("o_orderstatus", F.col("o_orderstatus").cast("string"))


def merge_delete_flag(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    return merge(o.where("o_orderkey % 2 = 0"), o.withColumn("gone", F.col("o_orderstatus") == "F"), ["o_orderkey"], "gone")


QUERIES = {f.__name__: f for f in (hub_customer, hub_customer_delta, link_customer_order, link_order_part, sat_customer_priority, sat_customer_priority_delta, sat_customer_status_multi, sat_user_status, pit_customer, bridge_customer_part, raw_vault_counts, dim_customer_scd2, dim_user_scd2_deletes, fct_lineitem_asof, fct_orders_current, revenue_by_priority, dim_date, model_incremental_merge, model_incremental_append, model_templated, promote_silver, pipeline_revenue, watermark_delta, serving_upsert, versions_upsert, merge_delete_flag)}

_CK = key_sql("o_custkey")
_O = f"{BRONZE_ORDERS}, st as (select *, _load_ts as load_date, _source as record_source from bronze_orders)"


def _hub_sql(name, source):
    return f"{name} as (select {_CK} as hk_customer, cast(o_custkey as varchar) as o_custkey, load_date, record_source, _batch_id from {source} qualify row_number() over (partition by {_CK} order by load_date, _batch_id) = 1)"


def _sat_sql(name, source, attr, target=None, extra=(), hk=None, diff=None, where="true"):
    hk, diff = hk or f"{_CK} as hk_customer", diff or diff_sql(attr)
    k = hk.rsplit(" ", 1)[-1]
    keys = ", ".join([k, *extra])
    ded = f"select {hk}, load_date, {diff} as hashdiff, {''.join(e + ', ' for e in extra)}{attr}, record_source, _batch_id from {source} where {where}"
    ded = f"select * from ({ded}) qualify row_number() over (partition by {keys}, load_date order by _batch_id desc) = 1"
    anti = f" where not exists (select 1 from {target} t where t.{k} = x.{k} and t.load_date = x.load_date)" if target else ""
    lag = f"select *, lag(hashdiff) over (partition by {keys} order by load_date) as prev from ({ded}) x{anti}"
    name_attr = attr.rsplit(" ", 1)[-1]
    cols = f"{k}, load_date, hashdiff, {''.join(e + ', ' for e in extra)}{name_attr}, record_source, _batch_id"
    if not target:
        return f"{name} as (select {cols} from ({lag}) where prev is distinct from hashdiff)"
    return f"{name} as (select {', '.join('b.' + c for c in cols.split(', '))} from ({lag}) b asof left join (select {k}, load_date, hashdiff from {target}) t on b.{k} = t.{k} and b.load_date > t.load_date where coalesce(b.prev, t.hashdiff) is distinct from b.hashdiff)"


_DIM = f"""{_O}, {_hub_sql('hub', 'st')}, {_sat_sql('sat', 'st', 'o_orderpriority')},
dim0 as (select h.o_custkey, o_orderpriority, s.load_date as valid_from, md5(coalesce(trim(o_orderpriority, ' '), '')) as row_hash from sat s join hub h using (hk_customer)),
dim1 as (select *, lag(row_hash) over (partition by o_custkey order by valid_from) as b from dim0),
dim as (select md5(o_custkey || '||' || cast(valid_from as varchar)) as sk, o_custkey, o_orderpriority, valid_from, lead(valid_from) over (partition by o_custkey order by valid_from) as valid_to, lead(valid_from) over (partition by o_custkey order by valid_from) is null as is_current, row_hash from dim1 where b is distinct from row_hash)"""
_LINK1 = f"l1 as (select {key_sql('o_custkey', 'o_orderkey')} as hk_customer_order, {_CK} as hk_customer, {key_sql('o_orderkey')} as hk_order, load_date, record_source, _batch_id from st qualify row_number() over (partition by {key_sql('o_custkey', 'o_orderkey')} order by load_date, _batch_id) = 1)"
_LINK2 = f"li as (select l_orderkey, l_partkey, l_shipdate as load_date, 'lineitem' as record_source, lpad(concat_ws('-', l_orderkey, l_linenumber, l_partkey), 30, '0') as _batch_id from lineitem), l2 as (select {key_sql('l_orderkey', 'l_partkey')} as hk_order_part, {key_sql('l_orderkey')} as hk_order, {key_sql('l_partkey')} as hk_part, load_date, record_source, _batch_id from li qualify row_number() over (partition by {key_sql('l_orderkey', 'l_partkey')} order by load_date, _batch_id) = 1)"
_CUT = f"timestamp '{ORDERS_CUT}'"
_PIT = f"with {_O}, {_hub_sql('hub', 'st')}, {_sat_sql('p', 'st', 'o_orderpriority')}, {_sat_sql('q', 'st', 'o_orderstatus')}, u as (select distinct hk_customer, load_date as snapshot_date from (select hk_customer, load_date from p union all select hk_customer, load_date from q)) select u.hk_customer, u.snapshot_date, p.load_date as priority_load_date, q.load_date as status_load_date from u asof left join p on u.hk_customer = p.hk_customer and u.snapshot_date >= p.load_date asof left join q on u.hk_customer = q.hk_customer and u.snapshot_date >= q.load_date where u.hk_customer in (select hk_customer from hub)"

ORACLES = {
    "hub_customer": f"with {_O}, {_hub_sql('h', 'st')} select * from h",
    "hub_customer_delta": f"with {_O}, a as (select * from st where load_date < {_CUT}), b as (select * from st where load_date >= {_CUT}), {_hub_sql('t', 'a')}, {_hub_sql('n', 'b')} select * from n where hk_customer not in (select hk_customer from t)",
    "link_customer_order": f"with {_O}, {_LINK1} select * from l1",
    "link_order_part": f"with {_LINK2} select * from l2",
    "sat_customer_priority": f"with {_O}, {_sat_sql('s', 'st', 'o_orderpriority')} select * from s",
    "sat_customer_priority_delta": f"with {_O}, a as (select * from st where o_orderkey % 3 = 0), b as (select * from st where o_orderkey % 3 <> 0), {_sat_sql('t', 'a', 'o_orderpriority')}, {_sat_sql('s', 'b', 'o_orderpriority', 't')} select * from s",
    "sat_customer_status_multi": f"with {_O}, {_sat_sql('s', 'st', 'o_orderpriority', extra=('o_orderstatus',))} select * from s",
    "sat_user_status": f"with {BRONZE_EVENTS}, st as (select *, coalesce(_source_ts, _load_ts) as load_date, 'events' as record_source from bronze_events), {_sat_sql('s', 'st', chr(40) + '_op = ' + chr(39) + 'd' + chr(39) + ') as is_deleted', hk=key_sql('user_id') + ' as hk_user', diff='sha1(cast(_op = ' + chr(39) + 'd' + chr(39) + ' as varchar))')} select * from s",
    "pit_customer": _PIT,
    "bridge_customer_part": f"with {_O}, {_LINK1}, {_LINK2} select distinct l1.hk_customer, l1.hk_order, l2.hk_part from l1 join l2 using (hk_order)",
    "raw_vault_counts": "select * from (values ('hub_order'), ('hub_customer'), ('sat_order_price'), ('sat_order_status'), ('link_order_customer')) t(\"table\"), lateral (select count(distinct case \"table\" when 'hub_customer' then o_custkey else o_orderkey end) as rows from orders)",
    "dim_customer_scd2": f"with {_DIM} select * from dim",
    "dim_user_scd2_deletes": f"""with {BRONZE_EVENTS}, r as (select cast(user_id as varchar) as user_id, _source_ts as valid_from, _op = 'd' as gone, case when _op <> 'd' then event_type end as event_type, _batch_id from bronze_events),
d as (select *, case when gone then 'deleted' else md5(event_type) end as h from r qualify row_number() over (partition by user_id, valid_from order by gone desc, _batch_id desc) = 1),
c as (select *, lag(h) over (partition by user_id order by valid_from) as b from d), k as (select * from c where b is distinct from h),
v as (select *, lead(valid_from) over (partition by user_id order by valid_from) as valid_to from k)
select md5(user_id || '||' || cast(valid_from as varchar)) as sk, user_id, event_type, valid_from, valid_to, valid_to is null as is_current, h as row_hash from v where not gone""",
    "fct_lineitem_asof": f"with {_DIM}, f as (select l.*, o_custkey, l_shipdate - interval 200 day as sb from lineitem l join orders on l_orderkey = o_orderkey) select l_orderkey, l_linenumber, l_partkey, f.o_custkey, l_shipdate, coalesce(sk, '-1') as customer_sk from f left join dim d on cast(f.o_custkey as varchar) = d.o_custkey and sb >= valid_from and (sb < valid_to or valid_to is null)",
    "fct_orders_current": f"with {_DIM} select o_orderkey, o.o_custkey, o_totalprice, coalesce(sk, '-1') as customer_sk from orders o left join dim d on cast(o.o_custkey as varchar) = d.o_custkey and is_current",
    "revenue_by_priority": f"with {_DIM} select coalesce(d.o_orderpriority, 'none') as priority, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as lines from lineitem join orders o on l_orderkey = o_orderkey left join dim d on cast(o.o_custkey as varchar) = d.o_custkey and l_shipdate >= valid_from and (l_shipdate < valid_to or valid_to is null) group by 1",
    "dim_date": "with r as (select cast(min(o_orderdate) as date) as a, cast(max(o_orderdate) as date) as b from orders), x as (select cast(unnest(range(a, b + interval 1 day, interval 1 day)) as date) as d from r) select cast(strftime(d, '%Y%m%d') as int) as date_key, d as date, year(d) as year, quarter(d) as quarter, month(d) as month, monthname(d) as month_name, day(d) as day, isodow(d) as day_of_week, dayname(d) as day_name, weekofyear(d) as week, isodow(d) >= 6 as is_weekend from x",
    "model_incremental_merge": f"with {BRONZE_ORDERS} select o_orderkey, o_custkey, o_totalprice, _load_ts from bronze_orders qualify row_number() over (partition by o_custkey order by (_load_ts >= {_CUT}) desc, _load_ts desc, o_orderkey desc) = 1",
    "model_incremental_append": f"with {BRONZE_ORDERS} select o_orderkey, o_custkey, case when _load_ts >= {_CUT} then o_totalprice end as o_totalprice, _load_ts from bronze_orders",
    "promote_silver": f"with {BRONZE_ORDERS} select * exclude (_load_ts, _source, _batch_id) from bronze_orders",
    "pipeline_revenue": "select o_orderstatus, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey group by 1",
    "watermark_delta": f"select o_orderkey, o_orderdate from orders where o_orderdate > {_CUT}",
    "model_templated": f"with a as (select o_custkey, max(o_orderdate) as last_order, count(*) as orders from orders where o_orderdate < timestamp '{ORDERS_CUT}' group by 1), b as (select o_custkey, max(o_orderdate) as last_order, count(*) as orders from orders where o_orderdate >= timestamp '{ORDERS_CUT}' group by 1) select o_custkey, coalesce(b.last_order, a.last_order) as last_order, coalesce(b.orders, a.orders) as orders from a full join b using (o_custkey)",
    "versions_upsert": "select o_orderkey, case when o_orderkey % 3 = 0 then o_orderstatus when o_orderkey % 2 = 0 then '?' end as o_orderstatus, case when o_orderkey % 3 = 0 or o_orderkey % 5 = 0 then o_totalprice else 0.0 end as o_totalprice from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0 or o_orderkey % 5 = 0",
    "serving_upsert": "select o_orderkey, case when o_orderkey % 3 = 0 then o_orderstatus else '?' end as o_orderstatus, case when o_orderkey % 3 = 0 then o_totalprice else 0.0 end as o_totalprice from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0",
    "merge_delete_flag": "select o_orderkey, o_orderstatus from orders where o_orderstatus <> 'F'",
}
