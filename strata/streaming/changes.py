"""Change streams: decode, dead letters, changelog, mirror and rollups.

The decoders work on batch and streaming frames of key, value, topic, partition, offset, timestamp. Writers run in
foreachBatch: an epoch writes to a path of its own, or under a transaction id of its own, so a replay changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from strata.operators.lineage import at_rank, ranked
from strata.operators.tables import conform, last_per_key, merge
from strata.operators.versions import Versions
from strata.plans.pipeline import columns, load_raw_vault

OP, SOURCE_TS, DELETED = "__op", "__source_ts_ms", "__deleted"
STALE_SECONDS = 30


def is_object(text: Column) -> Column:
    """Whether a text is a JSON object (repeated keys are allowed): one parser takes it, and it begins as one."""
    return F.coalesce(text.rlike(r"\A\s*\{") & (_fields(text).isNotNull() | F.try_parse_json(text).isNotNull()), F.lit(False))


def dead_letters(raw: DataFrame) -> DataFrame:
    """topic, partition, offset, value, error of values that aren't JSON objects."""
    v = F.col("value").cast("string")
    why = F.when(v.isNull() | F.try_parse_json(v).isNull(), "not JSON").otherwise("not a JSON object")
    return raw.where(~is_object(v)).select("topic", "partition", "offset", v.alias("value"), F.left(why, F.lit(500)).alias("error"))


def _fields(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def key_fields(key: Column, value: Column) -> Column:
    """The key's fields as a map; {id} becomes _id when the value has no id; a bad key has none."""
    k, v = _fields(key), _fields(value)
    k = F.when(is_object(key), k)
    moved = F.when((F.size(k) == 1) & F.map_contains_key(k, "id") & ~F.coalesce(F.map_contains_key(v, "id"), F.lit(False)), F.map_from_arrays(F.array(F.lit("_id")), F.array(k["id"]))).otherwise(k)
    return F.coalesce(moved, F.create_map().cast("map<string,string>"))


def decode(raw: DataFrame, fields: list[str], cdc: bool = True) -> DataFrame:
    """fields (text), _op, _source_ts, _offset, _partition, _offset_no, _key of the values that are objects.

    cdc: control fields are taken off, the key's fields fill in what the value lacks. Else every row is a 'c'.
    """
    key, value = F.col("key").cast("string"), F.col("value").cast("string")
    rows = raw.where(is_object(value)).withColumn("_v", _fields(value))
    if cdc:  # the key is parsed for rows that lack a field
        lacks = reduce(Column.__or__, (F.col("_v")[f].isNull() for f in fields), F.lit(False))
        rows = rows.withColumn("_k", F.when(lacks, key_fields(key, value)))
    at = F.when(F.unix_millis("timestamp") > 0, F.col("timestamp"))
    if cdc:
        gone = F.lower(F.coalesce(F.col("_v")[DELETED], F.lit("false"))) == "true"
        op, at = F.when(gone, F.lit("d")).otherwise(F.coalesce(F.col("_v")[OP], F.lit("r"))), F.timestamp_millis(F.col("_v")[SOURCE_TS].try_cast("long"))
    else:
        op = F.lit("c")
    get = lambda f: F.coalesce(F.col("_v")[f], F.col("_k")[f]) if cdc else F.col("_v")[f]
    return rows.select(*(get(f).alias(f) for f in fields), op.alias("_op"), at.alias("_source_ts"), F.concat_ws(":", "partition", "offset").alias("_offset"), F.col("partition").alias("_partition"), F.col("offset").alias("_offset_no"), F.map_keys(key_fields(key, value)).alias("_key"))


def latest_changes(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last change per key, by partition and offset as numbers."""
    return last_per_key(changes, keys, ["_partition", "_offset_no"])


def mirror(state: DataFrame | None, changes: DataFrame, keys: list[str]) -> DataFrame:
    """A table after the changes: the last one per key is upserted, or deletes."""
    if not keys:
        raise ValueError("a mirror needs keys")
    now = latest_changes(changes, keys).withColumn("_gone", F.col("_op") == "d").withColumnRenamed("_gone", "__gone")
    return merge(state, now.drop("_partition", "_offset_no", "_key"), keys, "__gone")


def write_changelog(path: str, generation: str):
    """foreachBatch function: every change is a row under generation and epoch; a replayed epoch overwrites itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/generation={generation}/epoch={epoch}")

    return write


def write_mirror(table: Versions, keys: list[str], generation: str, schema: T.StructType | None = None, compact_every: int = 0):
    """foreachBatch function: the batch's last change per key as one upsert; an epoch that the log has is skipped.

    The table may hold a full load. An epoch writes as much as it has rows and reads no old ones; every `compact_every`-th
    merges small parts. `schema`: types that fields are cast to; a value that isn't one fails the batch, as nothing may be lost.
    """
    if not keys:
        raise ValueError("a mirror needs keys")

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch if schema is None else conform(batch, schema)
        now = latest_changes(rows, keys).withColumn("__deleted", F.col("_op") == "d").drop("_partition", "_offset_no", "_key")
        table.upsert(now, keys, "__deleted", (generation, epoch))
        if compact_every and epoch % compact_every == compact_every - 1:
            table.compact()

    return write


def propagate(tables: dict[str, Versions], name: str, spec: dict, generation: str, then: Callable[[dict[str, DataFrame], int], None] | None = None, compact_every: int = 0):
    """foreachBatch function: the batch's rows to every table of a vault description, then what is built on them.

    Each table is appended to under the epoch and its own name, so a replayed epoch adds what it lacks and no more. Held
    rows are filtered by the batch's keys where they are read. The batch is decoded once, before anything is built on it (jobs
    that run at the same time would each decode what the other's executor has not stored yet), and only the columns that the
    vault takes are. `then` gets the rows that the epoch added to each table,
    and the epoch; a replayed one too, as it may have died before: the rows come from the log, so they are the same ones.
    tables: one Versions per name that `load_raw_vault` gives.
    """
    taken = columns(spec)

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.select(*(c for c in batch.columns if c in taken)).persist()
        try:
            rows.count()
            held = {n: t.read() for n, t in tables.items() if t.latest() is not None}
            for n, add in load_raw_vault(rows, name, spec, held, small=True).items():
                tables[n].append(add, (f"{generation}:{n}", epoch))
        finally:
            rows.unpersist()
        if then is not None:
            then({n: t.added(t.made_by((f"{generation}:{n}", epoch))) for n, t in tables.items() if t.latest() is not None}, epoch)
        if compact_every and epoch % compact_every == compact_every - 1:
            for t in tables.values():
                t.compact()

    return write


#: Options by which a source keeps a micro-batch to a number of records; file and delta sources count files instead.
BOUNDS = {"kafka": "maxOffsetsPerTrigger", "topic_log": "maxRecords", "rate-micro-batch": "rowsPerBatch", "file": "maxFilesPerTrigger", "delta": "maxFilesPerTrigger"}


def bounded(reader: DataStreamReader, kind: str, records: int) -> DataStreamReader:
    """A stream's reader whose micro-batches hold at most so many records (files, for file and delta sources)."""
    return reader.option(BOUNDS[kind], records)


def start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, seconds: float | None = None) -> StreamingQuery:
    """Runs a foreachBatch function: every `seconds`, or without them over what is there, in batches as the reader bounds them."""
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if seconds is None else w.trigger(processingTime=f"{seconds} seconds")).start()


def latency(batches: DataFrame) -> DataFrame:
    """batch, records, p50 (median cut to a whole number), p95 (element max(int(0.95 n) - 1, 0)) of latency_ms."""
    ms = F.greatest(F.col("latency_ms"), F.lit(0))
    n = F.col("_of")
    p50 = F.floor((at_rank(F.floor((n - 1) / 2)) + at_rank(F.floor(n / 2))) / 2).cast("long")
    p95 = at_rank(F.greatest(F.floor(n * 0.95) - 1, F.lit(0)))
    counted = ranked(batches.groupBy("batch", ms.alias("_v")).agg(F.count("*").alias("_c")), "batch")
    return counted.groupBy("batch").agg(F.sum("_c").alias("records"), p50.alias("p50"), p95.alias("p95"))


def minutes(stats: DataFrame) -> DataFrame:
    """stream, minute: sums of records, batches and dlq, the last p50, p95 and lag of the minute."""
    last = lambda c: F.max_by(c, "at").alias(c)
    return stats.groupBy("stream", F.date_trunc("minute", "at").alias("minute")).agg(F.sum("records").alias("records"), F.count("*").alias("batches"), F.sum("dlq").alias("dlq"), last("p50"), last("p95"), last("lag"))


def minutes_upsert(held: DataFrame | None, stats: DataFrame) -> DataFrame:
    """A rollup (as `minutes`, with the time `at` of its last row) after more stats: sums grow, the last p50, p95 and lag win."""
    new = stats.select("stream", F.date_trunc("minute", "at").alias("minute"), "records", F.lit(1).cast("long").alias("batches"), "dlq", "p50", "p95", "lag", "at")
    both = new if held is None else held.select(new.columns).unionByName(new)
    last = lambda c: F.max_by(c, "at").alias(c)
    sums = (F.sum(c).alias(c) for c in ("records", "batches", "dlq"))
    return both.groupBy("stream", "minute").agg(*sums, last("p50"), last("p95"), last("lag"), F.max("at").alias("at"))


def series(rollup: DataFrame, stream: str, as_of, minutes: int) -> DataFrame:
    """A stream's rollup of the last minutes, in order."""
    since = F.lit(as_of).cast("timestamp") - F.make_interval(mins=F.lit(minutes))
    return rollup.where((F.col("stream") == stream) & (F.col("minute") > since) & (F.col("minute") <= F.lit(as_of).cast("timestamp"))).orderBy("minute")


def status(streams: DataFrame, rollup: DataFrame, as_of) -> DataFrame:
    """stream, state (stalled: running, but silent for over 30 s), records_per_minute over five minutes, totals."""
    now = F.lit(as_of).cast("timestamp")
    n = rollup.groupBy("stream").agg(F.bround(F.coalesce(F.sum(F.when(F.col("minute") > now - F.expr("interval 5 minutes"), F.col("records"))), F.lit(0)) / 5, 0).cast("long").alias("records_per_minute"), F.sum("records").alias("records"), F.sum("dlq").alias("dlq"))
    late = (F.col("state") == "running") & (F.timestamp_diff("SECOND", F.col("heartbeat").cast("timestamp"), now) > STALE_SECONDS)
    return streams.join(n, "stream", "left").withColumn("state", F.when(late, "stalled").otherwise(F.col("state"))).select("stream", "state", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("records_per_minute", "records", "dlq")))
