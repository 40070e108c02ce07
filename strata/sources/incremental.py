"""JDBC scans, watermarks, landed pages and bounded topics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.sources.files import normalize


def jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, driver: str | None = None, split: tuple[str, int, int, int] | None = None, fetch: int = 10_000) -> DataFrame:
    """A table or query; `split`: column, lower, upper, partitions to read it in parallel."""
    r = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch)
    r = r.option("dbtable" if table else "query", table or query)
    r = r.option("driver", driver) if driver else r
    if split:
        r = r.options(partitionColumn=split[0], lowerBound=split[1], upperBound=split[2], numPartitions=split[3])
    return r.load()


def after(df: DataFrame, column: str, mark) -> DataFrame:
    """Rows past a watermark (a plain filter, pushed to the source); all on a first run."""
    return df if mark is None else df.where(F.col(column) > F.lit(mark))


def advance(df: DataFrame, column: str, mark):
    """The new watermark: the largest non-null one seen, never below the old."""
    top = df.agg(F.max(column)).first()[0]
    return mark if top is None else top if mark is None else max(mark, top)


def pages(landed: DataFrame, records_path: str, column: str = "value", mark_column: str | None = None, mark=None) -> DataFrame:
    """Rows of landed response pages: the list at a JSON path, flattened; those past a watermark, if a column is named."""
    items = F.variant_get(F.parse_json(F.get_json_object(column, records_path)), "$", "array<variant>")
    rows = normalize(landed.select(F.explode(F.transform(items, lambda x: F.to_json(x))).alias("value")))
    return after(rows, mark_column, mark) if mark_column else rows


def documents(landed: DataFrame, where: dict | None = None, mark_column: str | None = None, mark=None, column: str = "value") -> DataFrame:
    """Rows of landed documents (one JSON object each): equal to `where`'s values, past a watermark; _id as text, {"$oid": x} as x."""
    rows = normalize(landed, column)
    for name, value in (where or {}).items():
        rows = rows.where(F.col(f"`{name}`") == F.lit(value))
    if mark_column:
        rows = after(rows, mark_column, mark)
    if "_id" not in rows.columns:
        return rows
    text = F.col("_id").cast("string")
    return rows.withColumn("_id", F.coalesce(F.get_json_object(F.when(text.startswith("{"), text), "$['$oid']"), text))


def topic_rows(raw: DataFrame, fields: list[str]) -> DataFrame:
    """Fields of topic messages with _kafka_* columns; a value that is no object has its text in `value`."""
    v = F.col("value").cast("string")
    m = F.coalesce(F.from_json(F.when(v.rlike(r"\A\s*\{"), v), "map<string,string>"), F.create_map(F.lit("value"), v))
    return raw.select(*(m[f].alias(f) for f in fields), F.col("partition").alias("_kafka_partition"), F.col("offset").alias("_kafka_offset"), F.unix_millis("timestamp").alias("_kafka_timestamp_ms"), F.col("key").cast("string").alias("_kafka_key"))


def topic(spark: SparkSession, servers: str, name: str, bounded: bool = True, offsets: dict[int, int] | None = None) -> DataFrame:
    """A Kafka topic; bounded: from the committed offsets (by partition; without any, the start) to the present end. Needs Spark's Kafka package."""
    r = (spark.read if bounded else spark.readStream).format("kafka")
    begin = "earliest" if not offsets else json.dumps({name: {str(p): o for p, o in offsets.items()}})
    return r.option("kafka.bootstrap.servers", servers).option("subscribe", name).option("startingOffsets", begin).load()


def uncommitted(raw: DataFrame, offsets: dict[int, int]) -> DataFrame:
    """Messages (partition, offset) at or after the committed offsets; partitions without any from their start."""
    from_ = F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv)) if offsets else None
    return raw if from_ is None else raw.where(F.col("offset") >= F.coalesce(F.get(F.map_values(F.map_filter(from_, lambda p, o: p == F.col("partition"))), 0), F.lit(0)))


def next_offsets(rows: DataFrame, offsets: dict[int, int]) -> dict[int, int]:
    """The offsets to commit once the rows (with _kafka_ columns) are written: one behind the last of each partition, never lower."""
    seen = {r[0]: r[1] + 1 for r in rows.groupBy("_kafka_partition").agg(F.max("_kafka_offset")).collect()}  # a row per partition
    return {p: max(offsets.get(p, 0), seen.get(p, 0)) for p in {*offsets, *seen}}


def preview(df: DataFrame, n: int = 50) -> DataFrame:
    return df.limit(n)
