"""Change stream, lineage, catalog and operations queries."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators import lineage as lin
from strata.operators.versions import Versions
from strata.plans.pipeline import columns, maintain
from strata.queries.base import BRONZE_ORDERS, bronze_orders, table
from strata.session import shared_dir
from strata.streaming import changes as ch

FIELDS = ["user_id", "event_type", "value"]
#: Messages in a landed file, about.
FILE_ROWS = 500_000


def raw_events(s, d):
    """Events as topic messages: key and value JSON, every seventh value broken in one of three ways."""
    return _messages(table(s, d, "events"))


def _messages(e):
    gone = F.when(F.col("event_type") == "error", F.lit("true")).otherwise(F.lit("false"))
    good = F.to_json(F.struct(F.col("user_id").cast("string").alias("user_id"), "event_type", F.col("event_id").cast("string").alias("value"), F.when(F.col("event_type") == "signup", "c").otherwise("u").alias("__op"), F.unix_millis(F.col("ts").cast("timestamp")).alias("__source_ts_ms"), gone.alias("__deleted")))
    n = F.col("event_id") % 21
    value = F.when(n == 0, "[1, 2]").when(n == 7, "not json").when(n == 14, F.lit(None).cast("string")).otherwise(good)
    return e.select(F.to_json(F.struct(F.col("user_id").cast("string").alias("user_id"))).alias("key"), value.alias("value"), F.lit("events").alias("topic"), (F.col("user_id") % 3).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("timestamp"))


def _decoded(s, d):
    return ch.decode(raw_events(s, d), FIELDS)


def cdc_decode(s, d):
    return _decoded(s, d).select(*FIELDS, "_op", F.unix_millis("_source_ts").alias("source_ms"), "_offset")


def cdc_dead_letters(s, d):
    return ch.dead_letters(raw_events(s, d)).select("partition", "offset", "error")


def cdc_event_decode(s, d):
    return ch.decode(raw_events(s, d), FIELDS, cdc=False).select(*FIELDS, "_op", F.unix_millis("_source_ts").alias("source_ms"))


def cdc_latest(s, d):
    return ch.latest_changes(_decoded(s, d), ["user_id"]).select(*FIELDS, "_op", "_offset")


def cdc_mirror(s, d):
    """A mirror after two batches."""
    rows = _decoded(s, d)
    first = ch.mirror(None, rows.where("_offset_no % 2 = 0"), ["user_id"])
    return ch.mirror(first, rows.where("_offset_no % 2 = 1"), ["user_id"]).select(*FIELDS, "_op", "_offset")


def _landed(s, d):
    """The messages landed as files for the streaming twins, in the shared folder: three times so many files, by offset.

    A third has a file for each core (four at least), and more where they would pass `FILE_ROWS`: an epoch uses the whole
    cluster, and no task's share of it grows with the table.
    """
    folder = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    e = table(s, d, "events").select("event_id", "user_id", "event_type", "ts")
    top, rows = e.agg(F.max("event_id") + 1, F.count("*")).first()
    files = max(4, s.sparkContext.defaultParallelism, math.ceil(rows / 3 / FILE_ROWS))
    for k in range(3):
        third = e.where((F.col("event_id") >= k * top // 3) & (F.col("event_id") < (k + 1) * top // 3))
        _messages(third.repartition(files)).write.mode("append").parquet(f"{folder}/in")
    return folder, files


def _stream(s, folder, files):
    """The landed files as a stream, a third of them a batch: the reader's bound."""
    schema = s.read.parquet(f"{folder}/in").schema
    return ch.bounded(s.readStream.schema(schema), "file", files).parquet(f"{folder}/in")


def cdc_changelog_stream(s, d):
    """A file stream into a changelog: every change is a row, whatever the batches."""
    folder, files = _landed(s, d)
    ch.start(ch.decode(_stream(s, folder, files), FIELDS), ch.write_changelog(f"{folder}/out", "g1"), f"{folder}/cp").awaitTermination()
    return s.read.parquet(f"{folder}/out/generation=g1/epoch=*").select(*FIELDS, "_op", "_offset")


def cdc_mirror_stream(s, d):
    """A mirror that starts from a full load (a snapshot: users as they were halfway), followed by a file stream in three epochs.

    Columns are typed; the epochs write what they bring, and parts are merged after every second one.
    """
    folder, files = _landed(s, d)
    versions, kinds = Versions(s, f"{folder}/mirror"), T.StructType().add("user_id", "long").add("event_type", "string").add("value", "long")
    half = s.read.parquet(f"{folder}/in")
    half = half.where(F.col("offset") < half.agg(F.expr("max(offset) div 2")).first()[0])
    old = ch.mirror(None, ch.decode(half, FIELDS), ["user_id"])
    versions.write(old.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds), "_op", "_source_ts", "_offset"), keys=["user_id"])
    write = ch.write_mirror(versions, ["user_id"], "g1", kinds, compact_every=2)
    ch.start(ch.decode(_stream(s, folder, files), FIELDS), write, f"{folder}/cp").awaitTermination()
    return versions.read().select(*FIELDS, "_op", "_offset")


def stream_vault(s, d):
    """A file stream into the raw vault in three epochs, and models kept up to date from the rows that each epoch adds.

    By user: the latest event type and the number of versions. By event type: users and versions, from the users' rows
    before and after.
    """
    folder, files = _landed(s, d)
    spec = {"hub": ("user", ["user_id"]), "satellites": {"user_event": ["event_type"]}, "track_deletes": True}
    tables = {n: Versions(s, f"{folder}/{n}") for n in ("hub_user", "sat_user_event", "sat_user_status")}
    users, model = Versions(s, f"{folder}/users"), Versions(s, f"{folder}/model")

    def last(rows):
        return rows.groupBy("hk_user").agg(F.max_by("event_type", "load_date").alias("event_type"), F.max("load_date").alias("load_date"), F.sum("versions").alias("versions"))

    def total(rows):
        return rows.groupBy("event_type").agg(F.sum("users").alias("users"), F.sum("versions").alias("versions"))

    def then(added, epoch):
        new = last(added["sat_user_event"].withColumn("versions", F.lit(1).cast("long")))
        before, now = maintain(users, new, ["hk_user"], last, ("g1:users", epoch))
        change = [rows.select("event_type", F.lit(k).cast("long").alias("users"), (F.col("versions") * k).alias("versions")) for rows, k in ((before, -1), (now, 1))]
        maintain(model, total(change[0].unionByName(change[1])), ["event_type"], total, ("g1:model", epoch))

    rows = ch.decode(_stream(s, folder, files), FIELDS).withColumns({"_load_ts": F.col("_source_ts"), "_batch_id": F.lpad(F.col("_offset_no").cast("string"), 10, "0")})
    rows = rows.select(*(c for c in rows.columns if c in columns(spec)))  # an epoch's frame holds what the stream has, used or not
    ch.start(rows, ch.propagate(tables, "events", spec, "g1", then, compact_every=2), f"{folder}/cp").awaitTermination()
    return model.read().where("users > 0")


def _stats(s, d):
    e = table(s, d, "events")
    return e.select(F.col("event_type").alias("stream"), F.col("ts").cast("timestamp").alias("at"), F.lit(1).cast("long").alias("records"), (F.col("value") > 90).cast("long").alias("dlq"), F.col("event_id").alias("p50"), (F.col("event_id") * 2).alias("p95"), F.col("user_id").alias("lag"))


def stream_minutes_upsert(s, d):
    """A rollup after two batches of stats; the second falls into the same minutes in part."""
    x = _stats(s, d)
    held = ch.minutes_upsert(None, x.where("p50 % 3 <> 0"))
    return ch.minutes_upsert(held, x.where("p50 % 3 = 0"))


def stream_series(s, d):
    """A stream's metrics of the last days' minutes."""
    return ch.series(ch.minutes(_stats(s, d)), "click", "2024-01-20 12:00:00", 5 * 24 * 60)


def stream_minutes(s, d):
    e = table(s, d, "events")
    per = e.groupBy(F.col("event_type").alias("stream"), F.col("ts").alias("at")).agg(F.count("*").alias("records"), F.sum((F.col("value") > 90).cast("long")).alias("dlq"), F.max("event_id").alias("p50"), F.max("event_id").alias("p95"), F.max("user_id").alias("lag"))
    return ch.minutes(per)


def stream_latency(s, d):
    e = table(s, d, "events").select((F.col("user_id") % 50).alias("batch"), (F.col("event_id") % 977 - 20).alias("latency_ms"))
    return ch.latency(e)


def stream_status(s, d):
    e = table(s, d, "events")
    end = e.agg(F.max("ts").cast("timestamp").cast("string").alias("t")).first().t
    roll = ch.minutes(e.select(F.col("event_type").alias("stream"), F.col("ts").cast("timestamp").alias("at"), F.lit(1).alias("records"), F.lit(0).alias("dlq"), F.lit(0).alias("p50"), F.lit(0).alias("p95"), F.lit(0).alias("lag")))
    streams = e.groupBy(F.col("event_type").alias("stream")).agg(F.max("ts").cast("timestamp").alias("heartbeat")).withColumn("state", F.lit("running"))
    return ch.status(streams, roll, end)


def _runs(s, d):
    return table(s, d, "events").select(F.col("event_type").alias("job"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"), F.col("value").alias("seconds"))


def run_summary(s, d):
    return lin.run_summary(_runs(s, d).withColumn("at", F.col("at").cast("timestamp")), "2024-01-05 00:00:00", "2024-01-06 23:59:59")


def run_last_status(s, d):
    return lin.last_status(_runs(s, d).withColumn("job", F.concat_ws("-", "job", (F.hour("at") % 5).cast("string"))))


def freshness_alerts(s, d):
    """Event types as datasets with a limit of a few minutes: stale ones as alerts, after an earlier state."""
    e = table(s, d, "events")
    sets = e.groupBy(F.col("event_type").alias("dataset")).agg(F.max("ts").cast("timestamp").alias("last_load"))
    end = e.agg(F.max("ts").cast("timestamp").cast("string").alias("t")).first().t
    stale = lin.freshness(sets.withColumn("sla_minutes", F.when(F.col("dataset") == "view", 100000).otherwise(-1)), end)
    old = s.createDataFrame([("freshness", "view", "late"), ("freshness", "click", "late")], "kind string, target string, message string").withColumns({"opened_at": F.lit("2024-01-01").cast("timestamp"), "resolved_at": F.lit(None).cast("timestamp")})
    made = lin.alert_state(stale.select(F.lit("freshness").alias("kind"), F.col("dataset").alias("target"), F.lit("stale").alias("message")), old, end)
    return made.select("kind", "target", "message", (F.col("opened_at") == F.lit("2024-01-01").cast("timestamp")).alias("old"), F.col("resolved_at").isNotNull().alias("resolved"))


def _graph(s, d):
    """Parts and suppliers of line items as a graph: an order is computed from its parts, a supplier from the orders."""
    li = table(s, d, "lineitem")
    return li.select(F.concat(F.lit("p|"), "l_partkey").alias("source"), F.concat(F.lit("o|"), "l_orderkey").alias("target"), F.lit("j1").alias("job")).unionByName(li.select(F.concat(F.lit("o|"), "l_orderkey"), F.concat(F.lit("s|"), "l_suppkey"), F.lit("j2")).toDF("source", "target", "job")).distinct()


def lineage_trace(s, d):
    return lin.reach(_graph(s, d), ["p|1", "p|2"])


def lineage_subgraph(s, d):
    return lin.subgraph(_graph(s, d), ["p|3"], 2, "downstream")


def restricted_graph(s, d):
    g = _graph(s, d)
    return lin.restricted(g, g.where("source like 'o|%1'").select(F.col("source").alias("node")))


def lineage_steps(s, d):
    """A column trace with the job and statement of every step."""
    statements = s.createDataFrame([("j1", "select part from line"), ("j2", "select supplier from line")], "job string, sql string")
    return lin.trace(_graph(s, d), ["p|5"], statements, 2, "downstream")


def _event_nodes(s, d):
    """Event types as jobs and users as datasets, with runs and alerts laid over."""
    e = table(s, d, "events")
    jobs = e.select(F.concat(F.lit("job:"), "event_type", F.lit("-"), F.col("user_id") % 5).alias("node"))
    return jobs.unionByName(e.select(F.concat(F.lit("dataset:u"), "user_id").alias("node"))).distinct()


def lineage_overlay(s, d):
    """Nodes with the last run of a job and the open alert of a dataset."""
    runs = _runs(s, d).join(table(s, d, "events").select(F.col("ts").alias("at"), "user_id"), "at").withColumn("job", F.concat("job", F.lit("-"), F.col("user_id") % 5))
    e = table(s, d, "events")
    alerts = e.where("event_type = 'error'").select(F.concat(F.lit("u"), "user_id").alias("target"), F.when(F.col("user_id") % 2 == 0, "freshness").otherwise("dq_failed").alias("kind"), F.when(F.col("user_id") % 3 == 0, F.col("ts")).alias("resolved_at"))
    return lin.annotate(_event_nodes(s, d), runs, alerts)


def _lineage_events(s, d):
    """Runs of jobs over orders' priorities: inputs and outputs with column facets, the latest definition differs."""
    o = table(s, d, "orders")
    job = F.concat(F.lit("load-"), (F.col("o_custkey") % 7).cast("string"))
    col = lambda n: F.struct(F.lit("raw").alias("dataset"), n.alias("column"))
    columns = F.create_map(F.lit("price"), F.array(col(F.concat(F.lit("c"), (F.col("o_orderkey") % 3).cast("string"))), col(F.lit("rate"))))
    out = F.array(F.struct(F.concat(F.lit("t"), (F.col("o_custkey") % 4).cast("string")).alias("name"), columns.alias("columns")))
    kind = F.when(F.col("o_orderstatus") == "P", "START").otherwise("COMPLETE")
    return o.select((F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey"))).alias("event_time"), kind.alias("kind"), job.alias("job"), F.array(F.lit("raw"), F.concat(F.lit("ref"), (F.col("o_custkey") % 2).cast("string"))).alias("inputs"), out.alias("outputs"))


def lineage_edges(s, d):
    return lin.table_edges(_lineage_events(s, d))


def lineage_column_edges(s, d):
    return lin.column_edges(_lineage_events(s, d))


def lineage_impact(s, d):
    apps = s.createDataFrame([("board", "t0"), ("board", "t1"), ("other", "none")], "app string, dataset string")
    return lin.impact(lin.column_edges(_lineage_events(s, d)), "raw|rate", apps)


def batch_trace(s, d):
    b = bronze_orders(s, d)
    return lin.batch_trace({"orders": b, "big_orders": b.where("o_totalprice > 100000"), "none": table(s, d, "nation")}, "0000000007")


def schema_drift(s, d):
    """One column per order, named by its key and typed by its status, as known and as it is now."""
    o, k = table(s, d, "orders"), F.col("o_orderkey")
    name, kind = F.concat(F.lit("c"), k).alias("column"), F.col("o_orderstatus")
    known = o.where("o_orderkey % 7 <> 0").select(name, kind.alias("type"))
    now = o.where("o_orderkey % 5 <> 0").select(name, F.when(k % 11 == 0, "X").otherwise(kind).alias("type"))
    return lin.drift(known, now, o.where("o_orderkey % 14 = 0").select(name))


def catalog_search(s, d):
    """One dataset per part, described by its type, with a column named by its brand, and one per supplier."""
    p, n = table(s, d, "part"), table(s, d, "supplier")
    name = F.concat(F.lit("part_"), "p_partkey").alias("dataset")
    layer = F.when(F.col("p_size") > 25, "silver").otherwise("bronze").alias("layer")
    sets = p.select(name, F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).alias("description"), layer)
    sets = sets.unionByName(n.select("s_name", F.lit("a supplier").alias("d"), F.lit("silver").alias("l")).toDF("dataset", "description", "layer"))
    columns = p.select(name, F.concat("p_brand", F.lit("_tin")).alias("column")).where("p_partkey % 4 = 0")
    return lin.search(sets, columns, "TIN", "silver")


QUERIES = {f.__name__: f for f in (cdc_decode, cdc_dead_letters, cdc_event_decode, cdc_latest, cdc_mirror, cdc_changelog_stream, cdc_mirror_stream, stream_vault, stream_minutes, stream_minutes_upsert, stream_series, stream_latency, stream_status, run_summary, run_last_status, freshness_alerts, lineage_trace, lineage_subgraph, lineage_steps, lineage_overlay, restricted_graph, lineage_edges, lineage_column_edges, lineage_impact, batch_trace, schema_drift, catalog_search)}
_DEC = "d as (select cast(user_id as varchar) as user_id, event_type, cast(event_id as varchar) as value, case when event_type = 'error' then 'd' when event_type = 'signup' then 'c' else 'u' end as _op, epoch_us(ts) // 1000 as source_ms, cast(user_id % 3 as varchar) || ':' || event_id as _offset, user_id % 3 as p, event_id from events where event_id % 7 <> 0)"
_G = "li as (select * from lineitem), g as (select distinct 'p|' || l_partkey as source, 'o|' || l_orderkey as target, 'j1' as job from li union select distinct 'o|' || l_orderkey, 's|' || l_suppkey, 'j2' from li)"
_EV = "ev as (select o_orderdate + to_seconds(o_orderkey) as event_time, 'load-' || (o_custkey % 7) as job, 'ref' || (o_custkey % 2) as ref, 't' || (o_custkey % 4) as t, 'c' || (o_orderkey % 3) as c from orders where o_orderstatus <> 'P')"
_CE = "ce as (select *, row_number() over (partition by job, t order by event_time desc) as n from ev), cols as (select from_column, t, min(job) as job from (select c as from_column, t, job from ce where n = 1 union all select 'rate', t, job from ce where n = 1) group by 1, 2)"

ORACLES = {
    "cdc_decode": f"with {_DEC} select user_id, event_type, value, _op, source_ms, _offset from d",
    "cdc_dead_letters": "select cast(user_id % 3 as int) as partition, event_id as \"offset\", case when event_id % 21 = 0 then 'not a JSON object' else 'not JSON' end as error from events where event_id % 7 = 0",
    "cdc_event_decode": f"with {_DEC} select user_id, event_type, value, 'c' as _op, source_ms from d",
    "cdc_latest": f"with {_DEC} select user_id, event_type, value, _op, _offset from d qualify row_number() over (partition by user_id order by p desc, event_id desc) = 1",
    "cdc_mirror": f"with {_DEC}, l as (select *, event_id % 2 as b from d qualify row_number() over (partition by user_id, event_id % 2 order by event_id desc) = 1), m as (select * from l qualify row_number() over (partition by user_id order by b desc) = 1) select user_id, event_type, value, _op, _offset from m where _op <> 'd'",
    "cdc_changelog_stream": f"with {_DEC} select user_id, event_type, value, _op, _offset from d",
    "cdc_mirror_stream": f"with {_DEC}, l as (select * from d qualify row_number() over (partition by user_id order by p desc, event_id desc) = 1) select cast(user_id as bigint) as user_id, event_type, cast(value as bigint) as value, _op, _offset from l where _op <> 'd'",
    "stream_vault": f"with {_DEC}, v as (select *, lag(event_type) over (partition by user_id order by event_id) as b from d where _op <> 'd'), k as (select *, row_number() over (partition by user_id order by event_id desc) as n from v where b is null or b <> event_type), c as (select user_id, count(*) as versions from k group by 1) select event_type, count(*) as users, cast(sum(versions) as bigint) as versions from k join c using (user_id) where n = 1 group by 1",
    "stream_minutes_upsert": "select event_type as stream, date_trunc('minute', ts) as minute, count(*) as records, count(*) as batches, cast(sum(case when value > 90 then 1 else 0 end) as bigint) as dlq, max_by(event_id, ts) as p50, max_by(event_id * 2, ts) as p95, max_by(user_id, ts) as lag, max(ts) as \"at\" from events group by 1, 2",
    "stream_series": "select event_type as stream, date_trunc('minute', ts) as minute, count(*) as records, count(*) as batches, cast(sum(case when value > 90 then 1 else 0 end) as bigint) as dlq, max_by(event_id, ts) as p50, max_by(event_id * 2, ts) as p95, max_by(user_id, ts) as lag from events where event_type = 'click' and date_trunc('minute', ts) > timestamp '2024-01-15 12:00:00' and date_trunc('minute', ts) <= timestamp '2024-01-20 12:00:00' group by 1, 2",
    "stream_minutes": "with p as (select event_type as stream, ts, count(*) as records, cast(sum(case when value > 90 then 1 else 0 end) as bigint) as dlq, max(event_id) as e, max(user_id) as u from events group by 1, 2) select stream, date_trunc('minute', ts) as minute, cast(sum(records) as bigint) as records, count(*) as batches, cast(sum(dlq) as bigint) as dlq, max_by(e, ts) as p50, max_by(e, ts) as p95, max_by(u, ts) as lag from p group by 1, 2",
    "stream_latency": "with x as (select user_id % 50 as batch, greatest(event_id % 977 - 20, 0) as ms from events) select batch, count(*) as records, cast(floor(median(ms)) as bigint) as p50, list_sort(list(ms))[greatest(cast(floor(count(*) * 0.95) as int) - 1, 0) + 1] as p95 from x group by 1",
    "stream_status": "with t as (select max(ts) as e from events), m as (select event_type as stream, date_trunc('minute', ts) as minute, count(*) as n from events group by 1, 2) select event_type as stream, case when date_diff('microsecond', max(ts), any_value(e)) // 1000000 > 30 then 'stalled' else 'running' end as state, (select cast(round_even(coalesce(sum(n) filter (minute > e - interval 5 minute), 0) / 5, 0) as bigint) from m, t where m.stream = event_type) as records_per_minute, count(*) as records, 0 as dlq from events, t group by 1, t.e",
    "run_summary": "with b as (select unnest(generate_series(timestamp '2024-01-05', timestamp '2024-01-06 23:00:00', interval 1 hour)) as bucket), n as (select date_trunc('hour', ts) as bucket, count(*) as runs, count(*) filter (event_type = 'error') as failed, list_sort(list(value))[count(value) // 2 + 1] as p50, max(value) as longest from events where ts between timestamp '2024-01-05' and timestamp '2024-01-06 23:59:59' group by 1) select bucket, coalesce(runs, 0) as runs, coalesce(failed, 0) as failed, p50, longest from b left join n using (bucket)",
    "run_last_status": "select event_type || '-' || (hour(ts) % 5) as job, max_by(case event_type when 'error' then 'failed' else 'succeeded' end, ts) as status, max(ts) as \"at\" from events group by 1",
    "freshness_alerts": "select 'freshness' as kind, event_type as target, case event_type when 'view' then 'late' else 'stale' end as message, event_type in ('view', 'click') as old, event_type = 'view' as resolved from (select distinct event_type from events)",
    "lineage_trace": f"with {_G} select node, min(distance) as distance from (select 'p|1' as node, 0 as distance union all select 'p|2', 0 union all select target, 1 from g where source in ('p|1', 'p|2') union all select b.target, 2 from g a join g b on a.target = b.source where a.source in ('p|1', 'p|2')) group by 1",
    "lineage_subgraph": f"with {_G}, n as (select 'p|3' as node union select target from g where source = 'p|3' union select b.target from g a join g b on a.target = b.source where a.source = 'p|3') select * from g where source in (select node from n) and target in (select node from n)",
    "restricted_graph": f"with {_G}, h as (select distinct source as node from g where source like 'o|%1') select case when source in (select node from h) then 'restricted:' || left(sha1(source), 12) else source end as source, case when target in (select node from h) then 'restricted:' || left(sha1(target), 12) else target end as target, job from g",
    "lineage_edges": f"with {_EV} select distinct 'dataset:' || unnest(['raw', ref]) as source, 'job:' || job as target, job from ev union select distinct 'job:' || job, 'dataset:' || t, job from ev",
    "lineage_column_edges": f"with {_EV}, {_CE} select 'raw' as from_dataset, from_column, t as to_dataset, 'price' as to_column, job from cols",
    "lineage_impact": f"with {_EV}, {_CE}, r as (select * from cols where from_column = 'rate') select 'column' as kind, t || '|price' as name from r union select 'dataset', t from r union select 'job', job from cols where t in (select t from r) union select 'app', 'board' from r where t in ('t0', 't1')",
    "batch_trace": f"with {BRONZE_ORDERS} select 'orders' as dataset, count(*) as rows from bronze_orders where _batch_id = '0000000007' union all select 'big_orders', count(*) from bronze_orders where _batch_id = '0000000007' and o_totalprice > 100000",
    "lineage_steps": f"with {_G}, n as (select 'p|5' as node union select target from g where source = 'p|5' union select b.target from g a join g b on a.target = b.source where a.source = 'p|5') select source, target, job, case job when 'j1' then 'select part from line' else 'select supplier from line' end as sql from g where source in (select node from n) and target in (select node from n)",
    "lineage_overlay": "with n as (select distinct 'job:' || event_type || '-' || (user_id % 5) as node from events union select 'dataset:u' || user_id from events), r as (select 'job:' || event_type || '-' || (user_id % 5) as node, max_by(case event_type when 'error' then 'failed' else 'succeeded' end, ts) as status from events group by 1), a as (select distinct 'dataset:u' || user_id as node, case when user_id % 2 = 0 then 'late' else 'dq_failed' end as alert from events where event_type = 'error' and user_id % 3 <> 0) select node, status, alert from n left join r using (node) left join a using (node)",
    "schema_drift": "with x as (select 'c' || o_orderkey as \"column\", case when o_orderkey % 7 <> 0 then o_orderstatus end as old, case when o_orderkey % 5 <> 0 then case when o_orderkey % 11 = 0 then 'X' else o_orderstatus end end as new, o_orderkey % 14 = 0 as e from orders) select \"column\", case when old is null then case when e then 're-added' else 'added' end when new is null then 'removed' else 'type_changed' end as change, old, new from x where (old is not null or new is not null) and old is distinct from new",
    "catalog_search": "select 'part_' || p_partkey as dataset, case when p_partkey % 3 > 0 then p_type end as description, 'silver' as layer from part where p_size > 25 and (p_partkey % 4 = 0 or (p_partkey % 3 > 0 and contains(lower(p_type), 'tin'))) union all select s_name, 'a supplier', 'silver' from supplier where contains(lower(s_name), 'tin')",
}
