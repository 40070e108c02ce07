"""Queries over tables written and read back: versioned tables, file formats, landed topics and documents, lineage marks."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators import governance as gov
from strata.operators import lineage as lin
from strata.operators import quality as q
from strata.operators.tables import conform, storable, with_audit
from strata.operators.versions import Versions
from strata.plans import pipeline as plan
from strata.queries.base import bronze_orders, table
from strata.queries.stream_queries import FIELDS, raw_events
from strata.session import shared_dir
from strata.sources import files, incremental
from strata.sources.topic_log import TopicLog
from strata.streaming import changes as ch

AT = datetime(2026, 3, 5, 14, 30)


def _folder(s, name):
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def versions_travel(s, d):
    """A table's first and last version beside each other, after an append with one more column and a second full load."""
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    t = Versions(s, _folder(s, "travel"))
    t.write(o.where("o_orderkey % 2 = 0"))
    t.append(o.where("o_orderkey % 2 = 1").withColumn("late", F.lit(True)))
    t.write(o.where("o_orderkey % 3 = 0"))
    parts = [t.read(n).select(F.lit(n).alias("version"), "o_orderkey", "o_orderstatus", "late" if n == 1 else F.lit(None).cast("boolean").alias("late")) for n in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def versions_history(s, d):
    """What each version did, and the rows it has: appends by quarter of the keys, an upsert with deletes, a compaction."""
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    t = Versions(s, _folder(s, "history"))
    for k in range(4):
        t.append(o.where(f"o_orderkey % 4 = {k}"), ("load", k))
    t.upsert(o.withColumn("gone", F.col("o_orderstatus") == "F"), ["o_orderkey"], "gone")
    t.compact(fold=0.0)
    counts = [t.read(n).agg(F.count("*").alias("rows")).withColumn("version", F.lit(n).cast("long")) for n in range(6)]
    rows = counts[0]
    for c in counts[1:]:
        rows = rows.unionByName(c)
    return t.history().select("version", "op", "txn").join(rows, "version")


def versions_compacted(s, d):
    """Rows after many small appends, upserts between them, and compactions that merge parts and deltas apart."""
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice")
    t = Versions(s, _folder(s, "compact"))
    t.write(o.where("o_orderkey % 8 = 0"), keys=["o_orderkey"])
    for k in range(1, 4):
        t.append(o.where(f"o_orderkey % 8 = {k}"))
        t.upsert(o.where(f"o_orderkey % 8 = {k - 1}").withColumn("o_totalprice", -F.col("o_totalprice")), ["o_orderkey"])
    t.compact(fold=100.0)
    t.upsert(o.where("o_orderkey % 8 = 0"), ["o_orderkey"])
    return t.read()


def versions_stats(s, d):
    """Rows of a table from footers, of one with deltas by reading it."""
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice")
    t = Versions(s, _folder(s, "stats"))
    t.write(o)
    plain = t.stats().select(F.lit("plain").alias("state"), "rows", "parts")
    t.upsert(o.where("o_orderkey % 5 = 0").withColumn("gone", F.lit(True)), ["o_orderkey"], "gone")
    return plain.unionByName(t.stats().select(F.lit("after deletes").alias("state"), "rows", "parts"))


def audited_storage(s, d):
    """Audit columns in the place of the source's own, odd types as text."""
    e = table(s, d, "events").select("event_id", F.col("event_type").alias("_source"), F.lit(None).alias("nothing"), F.expr("make_dt_interval(0, 0, 0, cast(event_id % 60 as decimal(18,6)))").alias("span"))
    return storable(with_audit(e, AT, "events", "b1")).select("event_id", "nothing", (F.col("span").isNotNull()).alias("has_span"), "_source", "_batch_id", "_file")


def conformed(s, d):
    """Texts and wide numbers cast to a table's types, where nothing is lost."""
    o = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_custkey").cast("double").alias("o_custkey"), F.col("o_orderdate").cast("string").alias("o_orderdate"), "o_orderstatus")
    return conform(o, T.StructType().add("o_orderkey", "long").add("o_custkey", "integer").add("o_orderdate", "date"))


def load_plan_vault(s, d):
    """Two loads of one source through a plan of hub, link and satellite, and a dependent that is rebuilt when they have new rows."""
    from strata.operators import vault

    o, folder = bronze_orders(s, d), _folder(s, "plan")
    tables = {n: Versions(s, f"{folder}/{n}") for n in ("hub_customer", "link_order", "sat_priority", "counts")}
    maps = [
        plan.Mapping("satellite", "sat_priority", lambda st, held: vault.satellite(st, "customer", ["o_custkey"], ["o_orderpriority"], held)),
        plan.Mapping("link", "link_order", lambda st, held: vault.link(st, "customer_order", {"customer": ["o_custkey"], "order": ["o_orderkey"]}, held)),
        plan.Mapping("hub", "hub_customer", lambda st, held: vault.hub(st, "customer", ["o_custkey"], held)),
    ]
    build = lambda f: f["hub_customer"].agg(F.count("*").alias("hubs")).crossJoin(f["sat_priority"].agg(F.count("*").alias("versions"))).crossJoin(f["link_order"].agg(F.count("*").alias("links")))  # noqa: E731  one row each
    after = {"counts": ({"hub_customer", "sat_priority", "link_order"}, build)}
    for k, part in enumerate(("_load_ts < '1998-01-01'", "_load_ts >= '1998-01-01'")):
        plan.load_plan(o.where(part), "orders", maps, tables, after, f"t{k}")
    plan.load_plan(o, "orders", maps, tables, after, "t1")  # again: nothing new
    return tables["counts"].read()


def csv_files(s, d):
    """Parts as CSV files under a dated template, two lines of junk in front of each, read back with their types."""
    folder = _folder(s, "csv")
    p = table(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("p_retailprice"))
    for sep, name in ((",", "parts_20260305_a.csv"), (",", "parts_20260305_b.csv"), (",", "parts_20260304_c.csv")):
        rows = p.where(F.col("p_partkey") % 3 == "abc".index(name[-5]))
        line = F.concat_ws(sep, "p_partkey", F.concat(F.lit('"'), "p_name", F.lit('"')), "p_brand", "p_size", F.coalesce(F.col("p_retailprice").cast("string"), F.lit("NULL")))
        head = F.lit(f"made by hand\n\np_partkey{sep}p_name{sep}p_brand{sep}p_size{sep}p_retailprice\n")
        text = rows.select((F.col("p_partkey") % 2).alias("file"), line.alias("line")).groupBy("file").agg(F.concat(head, F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("value"))
        text.repartition("file").write.partitionBy("file").text(f"{folder}/{name}", lineSep="\n")
    path = files.resolve(folder, "parts_{yyyyMMdd}_*.csv", AT)
    return files.read_csv(s, f"{path}/*/*.txt", skip_rows=2)


#: Events of which one set of documents is made: a document is one value to its reader, so it must not grow with the table.
DOCUMENT_EVENTS = 500_000


def json_documents(s, d):
    """Events as JSON documents with their records under a key, read back as rows.

    A document for each type and hour of day, of every so many events; each is written as a file of its own by the task that made it.
    """
    folder = _folder(s, "documents")
    e = table(s, d, "events")
    record = F.struct("event_id", "user_id", F.struct(F.col("event_type").alias("type"), "value").alias("what"))
    sets = F.pmod(F.hash("event_id"), F.lit(e.count() // DOCUMENT_EVENTS + 1))
    docs = e.groupBy("event_type", F.hour("ts").alias("h"), sets.alias("k")).agg(F.to_json(F.struct(F.collect_list(record).alias("data"))).alias("value"))
    docs.write.partitionBy("event_type", "h", "k").text(f"{folder}/events.json")
    return files.read_document(s, f"{folder}/events.json", "data").select("event_id", "user_id", F.get_json_object("what", "$.type").alias("event_type"))


def json_lines(s, d):
    folder = _folder(s, "lines")
    table(s, d, "events").select("event_id", "event_type", F.struct("user_id").alias("who")).write.json(f"{folder}/e.jsonl")
    return files.read(s, f"{folder}/e.jsonl").select("event_id", "event_type", "who.user_id")


def _one_file(rows, path):
    """The rows as one file of JSON lines, whose bytes depend on nothing but the rows.

    Parquet's don't: its footer lists a column's encodings in an order that differs from one executor to the next.
    """
    rows.coalesce(1).sortWithinPartitions(*rows.columns).write.json(path, compression="none")


def new_files_manifest(s, d):
    """Files that came or changed since a listing, and what the manifest says of all: rows, and whether digests tell contents apart."""
    folder = _folder(s, "manifest")
    p = table(s, d, "part").select("p_partkey", "p_name")
    for k in range(3):
        _one_file(p.where(f"p_partkey % 4 = {k}"), f"{folder}/{k}")
    seen = files.listing(s, f"{folder}/*/*.json")
    seen = s.createDataFrame(seen.collect(), seen.schema)  # a row a file, as it was then
    _one_file(p.where("p_partkey % 4 = 3"), f"{folder}/3")
    _one_file(p.where("p_partkey % 4 = 3"), f"{folder}/4")  # the same content
    fresh = files.new_files(files.listing(s, f"{folder}/*/*.json"), seen)
    rows = s.read.schema(p.schema).json(f"{folder}/*/*.json").select("*", "_metadata")
    m = files.manifest(s, f"{folder}/*/*.json", rows).join(fresh.select("path", F.lit(True).alias("new")), "path", "left")
    return m.agg(F.count("*").alias("files"), F.count("new").alias("new_files"), F.sum("rows").alias("rows"), F.count_distinct("sha256").alias("contents"))


def landed_documents(s, d):
    """Orders as landed documents with object ids: one status, past a watermark."""
    o = table(s, d, "orders")
    doc = F.to_json(F.struct(F.struct(F.col("o_orderkey").cast("string").alias("$oid")).alias("_id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"), F.array("o_orderpriority").alias("tags")))
    return incremental.documents(o.select(doc.alias("value")), {"status": "F"}, "customer", 100).select("_id", "customer", "tags")


def landed_pages(s, d):
    """Orders as pages of responses, one for each customer, a list under a path; past a watermark."""
    o = table(s, d, "orders")
    page = F.to_json(F.struct(F.struct(F.collect_list(F.struct("o_orderkey", "o_orderstatus")).alias("rows")).alias("page")))
    return incremental.pages(o.groupBy("o_custkey").agg(page.alias("value")), "$.page.rows", mark_column="o_orderkey", mark=50).select("o_orderkey", "o_orderstatus")


def cdc_key_fields(s, d):
    """Fields of event keys: {id} stands for _id where the value has no id; broken keys have none."""
    e = table(s, d, "events")
    key = F.when(F.col("event_id") % 5 == 0, F.lit("broken")).otherwise(F.to_json(F.struct(F.col("user_id").alias("id"))))
    value = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("event_id").alias("id")))).otherwise(F.to_json(F.struct(F.col("event_id").alias("n"))))
    m = ch.key_fields(key, value)
    return e.select("event_id", m["id"].alias("id"), m["_id"].alias("mongo_id"), F.size(m).alias("fields"))


def topic_stream(s, d):
    """Events landed as a topic, read as a stream of bounded batches that is stopped and started again; a partition comes later."""
    folder = _folder(s, "topic")
    s.dataSource.register(TopicLog)
    raw = raw_events(s, d).select("key", "value", "partition", "offset", "timestamp")

    def land(rows):
        rows.repartitionByRange(4, "offset").sortWithinPartitions("offset").write.format("topic_log").mode("append").save(f"{folder}/events")

    n = raw.count()
    land(raw.where("partition < 2"))
    stream = lambda: s.readStream.format("topic_log").option("maxRecords", n // 2 + 1).option("checkpoint", f"{folder}/cp").load(f"{folder}/events")
    write = ch.write_changelog(f"{folder}/out", "g1")

    def run():
        query = ch.start(ch.decode(stream(), FIELDS), write, f"{folder}/cp")
        query.awaitTermination()
        return any(p.numInputRows for p in query.recentProgress)

    run()
    land(raw.where("partition = 2"))
    while run():
        pass
    return s.read.parquet(f"{folder}/out/generation=g1/epoch=*").select(*FIELDS, "_op", "_offset")


def topic_bounded(s, d):
    """A topic from committed offsets to its end; the partition that the offsets don't name from its start."""
    folder = _folder(s, "topic")
    s.dataSource.register(TopicLog)
    raw = raw_events(s, d).select("key", "value", "partition", "offset", "timestamp")
    raw.repartitionByRange(4, "offset").sortWithinPartitions("offset").write.format("topic_log").mode("append").save(f"{folder}/events")
    rows = s.read.format("topic_log").option("startingOffsets", '{"0": 100, "1": 200}').load(f"{folder}/events")
    return incremental.topic_rows(rows, ["user_id", "value"]).select("_kafka_partition", "_kafka_offset", "user_id", "value")


def profile_temporal(s, d):
    """Ranges of dates and times as text, and the share of true values."""
    o = table(s, d, "orders").select("o_orderdate", F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderstatus") == "F").alias("done"))
    return q.profile(o, exact=True).select("column", "nulls", "distinct", F.left("min", F.lit(10)).alias("min"), F.left("max", F.lit(10)).alias("max"), "true_pct")


def profile_heavy_values(s, d):
    """The most frequent values of events' columns: proven by sketches where they can be, else counted."""
    e = table(s, d, "events").select("event_type", F.col("user_id"), F.floor("value").alias("value"), F.date_trunc("day", F.col("ts").cast("timestamp")).cast("date").alias("day"))
    return q.heavy_values(e)


def model_preview(s, d):
    """A templated model seen by a viewer whose policies mask a column and filter rows."""
    sql, names = plan.render("select c_name, c_mktsegment, c_custkey from {{ ref('customer') }} where c_custkey < 100", False)
    rows = gov.secured(table(s, d, "customer"), {"c_name": "partial"}, ("c_nationkey <> 3",), "k")
    return gov.ask(s, sql, {n: rows for n in names}, 5000)[0]


def _marks(s, d):
    """Parts, orders and suppliers of line items as datasets; apps read suppliers."""
    li = table(s, d, "lineitem").where("l_partkey % 2 = 0")
    parts = li.select(F.concat(F.lit("dataset:p"), "l_partkey").alias("source"), F.concat(F.lit("dataset:o"), "l_orderkey").alias("target"))
    return parts.unionByName(li.select(F.concat(F.lit("dataset:o"), "l_orderkey"), F.concat(F.lit("dataset:s"), "l_suppkey")).toDF("source", "target")).distinct()


def lineage_governed(s, d):
    """Tags and scores of parts on everything that is made from them."""
    g = _marks(s, d)
    p = table(s, d, "part")
    node = F.concat(F.lit("dataset:p"), "p_partkey")
    tags = p.where("p_partkey % 50 = 0").select(node.alias("node"), F.concat(F.lit("pii."), (F.col("p_partkey") % 3).cast("string")).alias("tag"), F.when(F.col("p_partkey") % 100 == 0, "active").otherwise("suggested").alias("status"))
    scores = p.where("p_partkey % 10 = 0").select(node.alias("node"), (F.col("p_partkey") % 7 * 10).cast("double").alias("score"))
    nodes = g.select(F.col("source").alias("node")).unionByName(g.select(F.col("target").alias("node"))).distinct()
    out = lin.governed(g, nodes, tags, scores)
    return out.select("node", F.array_join("tags", ",").alias("tags"), F.array_join("inherited", ",").alias("inherited"), "score", "weakest")


def lineage_app_impact(s, d):
    """Everything downstream of a dataset in table edges of events, apps included."""
    o = table(s, d, "orders")
    events = o.select(
        F.col("o_orderdate").alias("event_time"), F.when(F.col("o_orderstatus") == "P", "START").otherwise("COMPLETE").alias("kind"), F.concat(F.lit("j"), F.col("o_custkey") % 20).alias("job"),
        F.array(F.concat(F.lit("d"), F.col("o_custkey") % 20)).alias("inputs"), F.array(F.struct(F.concat(F.lit("d"), F.col("o_custkey") % 20 + 1).alias("name"))).alias("outputs"),
    )
    apps = o.select(F.concat(F.lit("a"), F.col("o_custkey") % 4).alias("app"), F.concat(F.lit("d"), F.col("o_custkey") % 4 * 5 + 1).alias("dataset")).distinct()
    return lin.dataset_impact(lin.table_edges(events, apps=apps), "dataset:d15")


QUERIES = {
    f.__name__: f
    for f in (versions_travel, versions_history, versions_compacted, versions_stats, audited_storage, conformed, load_plan_vault, csv_files, json_documents, json_lines, new_files_manifest, landed_documents, landed_pages, cdc_key_fields, topic_stream, topic_bounded, profile_temporal, profile_heavy_values, model_preview, lineage_governed, lineage_app_impact)
}

_RAW = "case when event_id % 21 = 0 then '[1, 2]' when event_id % 21 = 7 then 'not json' when event_id % 21 = 14 then null else event_id::varchar end"
_DEC = "select cast(user_id as varchar) as user_id, event_type, cast(event_id as varchar) as value, case when event_type = 'error' then 'd' when event_type = 'signup' then 'c' else 'u' end as _op, cast(user_id % 3 as varchar) || ':' || event_id as _offset from events where event_id % 7 <> 0"
_M = "g as (select distinct 'dataset:p' || l_partkey as source, 'dataset:o' || l_orderkey as target from lineitem where l_partkey % 2 = 0 union select distinct 'dataset:o' || l_orderkey, 'dataset:s' || l_suppkey from lineitem where l_partkey % 2 = 0), n as (select source as node from g union select target from g), up as (select node, node as anc, 0 as dist from n union all select target, source, 1 from g union all select b.target, a.source, 2 from g a join g b on a.target = b.source), r as (select node, anc, min(dist) as dist from up group by 1, 2)"

ORACLES = {
    "versions_travel": "select 0 as version, o_orderkey, o_orderstatus, cast(null as boolean) as late from orders where o_orderkey % 2 = 0 union all select 1, o_orderkey, o_orderstatus, case when o_orderkey % 2 = 1 then true end from orders union all select 2, o_orderkey, o_orderstatus, null from orders where o_orderkey % 3 = 0",
    "versions_history": "select v as version, case when v < 4 then 'append' when v = 4 then 'upsert' else 'compact' end as op, case when v < 4 then 'load:' || v else '' end as txn, (select count(*) from orders where case when v < 4 then o_orderkey % 4 <= v else o_orderstatus <> 'F' end) as rows from (select unnest(range(6)) as v)",
    "versions_compacted": "select o_orderkey, case when o_orderkey % 8 in (0, 3) then o_totalprice else -o_totalprice end as o_totalprice from orders where o_orderkey % 8 < 4",
    "versions_stats": "select 'plain' as state, count(*) as rows, cast(1 as bigint) as parts from orders union all select 'after deletes', count(*), 2 from orders where o_orderkey % 5 <> 0",
    "audited_storage": "select event_id, cast(null as varchar) as nothing, true as has_span, 'events' as _source, 'b1' as _batch_id, cast(null as varchar) as _file from events",
    "conformed": "select o_orderkey, cast(o_custkey as integer) as o_custkey, cast(o_orderdate as date) as o_orderdate, o_orderstatus from orders",
    "load_plan_vault": "with b as (select o_custkey, o_orderdate, o_orderpriority, o_orderkey from orders), one as (select * from b qualify row_number() over (partition by o_custkey, o_orderdate order by lpad(cast(o_orderkey as varchar), 10, '0') desc) = 1), v as (select *, lag(o_orderpriority) over (partition by o_custkey order by o_orderdate) as p from one) select (select count(distinct o_custkey) from orders) as hubs, (select count(*) from v where p is null or p <> o_orderpriority) as versions, (select count(*) from orders) as links",
    "csv_files": "select p_partkey, p_name, p_brand, cast(p_size as bigint) as p_size, case when p_partkey % 7 <> 0 then p_retailprice end as p_retailprice from part where p_partkey % 3 < 2",
    "json_documents": "select event_id, user_id, event_type from events",
    "json_lines": "select event_id, event_type, user_id from events",
    "new_files_manifest": "select cast(5 as bigint) as files, cast(2 as bigint) as new_files, count(*) + count(*) filter (p_partkey % 4 = 3) as rows, cast(4 as bigint) as contents from part",
    "landed_documents": "select cast(o_orderkey as varchar) as _id, o_custkey as customer, '[\"' || o_orderpriority || '\"]' as tags from orders where o_orderstatus = 'F' and o_custkey > 100",
    "landed_pages": "select o_orderkey, o_orderstatus from orders where o_orderkey > 50",
    "cdc_key_fields": "select event_id, case when event_id % 5 <> 0 and event_id % 2 = 0 then cast(user_id as varchar) end as id, case when event_id % 5 <> 0 and event_id % 2 = 1 then cast(user_id as varchar) end as mongo_id, case when event_id % 5 <> 0 then 1 else 0 end as fields from events",
    "topic_stream": _DEC,
    "topic_bounded": f"with x as (select cast(user_id % 3 as integer) as p, event_id, {_RAW} as v, user_id from events) select p as _kafka_partition, event_id as _kafka_offset, case when event_id % 7 <> 0 then cast(user_id as varchar) end as user_id, v as value from x where event_id >= case p when 0 then 100 when 1 then 200 else 0 end",
    "profile_temporal": "select 'o_orderdate' as \"column\", count(*) filter (o_orderdate is null) as nulls, count(distinct o_orderdate) as \"distinct\", left(cast(min(o_orderdate) as varchar), 10) as min, left(cast(max(o_orderdate) as varchar), 10) as max, cast(null as double) as true_pct from orders union all select 'day', count(*) filter (o_orderdate is null), count(distinct cast(o_orderdate as date)), cast(min(cast(o_orderdate as date)) as varchar), cast(max(cast(o_orderdate as date)) as varchar), null from orders union all select 'done', 0, count(distinct o_orderstatus = 'F'), null, null, round(100.0 * count(*) filter (o_orderstatus = 'F') / count(*), 6) from orders",
    "profile_heavy_values": "with m as (select 'event_type' as \"column\", event_type as value from events union all select 'user_id', cast(user_id as varchar) from events union all select 'value', cast(cast(floor(value) as bigint) as varchar) from events union all select 'day', cast(cast(ts as date) as varchar) from events), g as (select \"column\", value, count(*) as \"count\" from m where value is not null group by 1, 2) select *, row_number() over (partition by \"column\" order by \"count\" desc, value) as rank from g qualify rank <= 5",
    "model_preview": "select repeat('*', greatest(length(c_name) - 4, 0)) || right(c_name, 4) as c_name, c_mktsegment, c_custkey from customer where c_nationkey <> 3 and c_custkey < 100",
    "lineage_governed": f"with {_M}, tg as (select 'dataset:p' || p_partkey as node, 'pii.' || (p_partkey % 3) as tag from part where p_partkey % 100 = 0), sc as (select 'dataset:p' || p_partkey as node, cast(p_partkey % 7 * 10 as double) as score from part where p_partkey % 10 = 0), t as (select r.node, tag, min(dist) as dist from r join tg on r.anc = tg.node group by 1, 2), a as (select node, string_agg(tag, ',' order by tag) filter (dist = 0) as tags, string_agg(tag, ',' order by tag) filter (dist > 0) as inherited from t group by 1), w as (select r.node, min(score) as weakest from r join sc on r.anc = sc.node group by 1) select n.node, coalesce(tags, '') as tags, coalesce(inherited, '') as inherited, score, weakest from n left join a using (node) left join sc using (node) left join w using (node)",
    "lineage_app_impact": "with recursive j as (select distinct o_custkey % 20 as k from orders where o_orderstatus <> 'P'), e as (select 'dataset:d' || k as source, 'job:j' || k as target from j union select 'job:j' || k, 'dataset:d' || (k + 1) from j union select distinct 'dataset:d' || (o_custkey % 4 * 5 + 1), 'app:a' || (o_custkey % 4) from orders), w as (select 'dataset:d15' as node, 0 as distance union all select target, distance + 1 from w join e on w.node = e.source where distance < 50), m as (select node, min(distance) as distance from w group by 1) select split_part(node, ':', 1) as kind, split_part(node, ':', 2) as name, distance from m where distance > 0",
}
