"""Lineage as edge frames: from events to edges, sub-graphs, impact, restricted views; catalog drift and search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.session import cut

#: event_time timestamp, kind string, job string, inputs array<string>, outputs array<struct<name, columns: map<string, array<struct<dataset, column>>>>>
DEPTH = 50


def table_edges(events: DataFrame, as_of=None, apps: DataFrame | None = None) -> DataFrame:
    """source, target, job of every input and output a job ever had, from COMPLETE events; apps (app, dataset) read datasets.

    An app's edges have no job and don't depend on `as_of`: they are what is registered now.
    """
    done = events.where("kind = 'COMPLETE'")
    done = done if as_of is None else done.where(F.col("event_time") <= F.lit(as_of).cast("timestamp"))
    job = F.concat(F.lit("job:"), "job")
    named = lambda x: F.explode(F.transform(x, lambda n: F.concat(F.lit("dataset:"), n)))
    reads = done.select(named(F.col("inputs")).alias("source"), job.alias("target"), "job")
    writes = done.select(job.alias("source"), named(F.col("outputs.name")).alias("target"), "job")
    edges = reads.unionByName(writes).distinct()
    if apps is None:
        return edges
    used = apps.where("dataset is not null").select(F.concat(F.lit("dataset:"), "dataset").alias("source"), F.concat(F.lit("app:"), "app").alias("target"), F.lit(None).cast("string").alias("job"))
    return edges.unionByName(used.distinct())


def column_edges(events: DataFrame) -> DataFrame:
    """from/to dataset and column, job: of each (job, output) only the latest definition counts; the first job wins an edge."""
    out = events.where("kind = 'COMPLETE'").select("event_time", "job", F.explode("outputs").alias("o")).select("event_time", "job", F.col("o.name").alias("to_dataset"), F.col("o.columns").alias("columns"))
    last = out.groupBy("job", "to_dataset").agg(F.max_by("columns", "event_time").alias("columns"))
    each = last.select("job", "to_dataset", F.explode("columns").alias("to_column", "ins")).select("job", "to_dataset", "to_column", F.explode("ins").alias("i"))
    return each.select(F.col("i.dataset").alias("from_dataset"), F.col("i.column").alias("from_column"), "to_dataset", "to_column", "job").groupBy("from_dataset", "from_column", "to_dataset", "to_column").agg(F.min("job").alias("job"))


def reach(edges: DataFrame, start: list[str], depth: int = DEPTH, direction: str = "downstream") -> DataFrame:
    """node, distance of everything within `depth` steps of the start nodes along edges (source, target).

    One join per step; a node already met isn't followed again. Each step is written to the shared folder, so it reads its
    predecessor alone. The driver holds no nodes, only whether a step found any.
    """
    spark = edges.sparkSession
    way = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    back = edges.select(F.col("target").alias("a"), F.col("source").alias("b"))
    way = cut({"downstream": way, "upstream": back, "both": way.unionByName(back)}[direction].distinct())
    front = seen = spark.createDataFrame([(s, 0) for s in start], "node string, distance int")
    for step in range(1, depth + 1):
        front = front.join(way, front.node == way.a).select(F.col("b").alias("node")).distinct()
        front = cut(front.join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(step)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def trace(edges: DataFrame, start: list[str], statements: DataFrame, depth: int = DEPTH, direction: str = "both") -> DataFrame:
    """source, target, job, sql of the edges among the nodes within reach; statements: job, sql."""
    near = subgraph(edges, start, depth, direction)
    return near.join(statements.select("job", "sql").dropDuplicates(["job"]), "job", "left").select("source", "target", "job", "sql")


def subgraph(edges: DataFrame, start: list[str], depth: int = DEPTH, direction: str = "both") -> DataFrame:
    """Edges among the nodes within reach."""
    nodes = reach(edges, start, depth, direction).select("node")
    return edges.join(nodes.withColumnRenamed("node", "source"), "source", "left_semi").join(nodes.withColumnRenamed("node", "target"), "target", "left_semi").select(edges.columns)


def column_graph(edges: DataFrame) -> DataFrame:
    """column_edges as (source, target, job) of `dataset|column` nodes."""
    return edges.select(F.concat_ws("|", "from_dataset", "from_column").alias("source"), F.concat_ws("|", "to_dataset", "to_column").alias("target"), "job")


def impact(edges: DataFrame, column: str, apps: DataFrame | None = None) -> DataFrame:
    """kind, name: downstream columns of a column, their datasets, the jobs that compute them, apps reading those datasets."""
    graph = column_graph(edges)
    nodes = reach(graph, [column]).where("distance > 0").select("node")
    sets = nodes.select(F.substring_index("node", "|", 1).alias("name")).distinct()
    jobs = graph.join(nodes.withColumnRenamed("node", "target"), "target", "left_semi").select(F.col("job").alias("name")).distinct()
    parts = [("column", nodes.withColumnRenamed("node", "name")), ("dataset", sets), ("job", jobs)]
    if apps is not None:
        parts.append(("app", apps.join(sets.withColumnRenamed("name", "dataset"), "dataset", "left_semi").select(F.col("app").alias("name")).distinct()))
    return reduce(DataFrame.unionByName, (p.select(F.lit(k).alias("kind"), "name") for k, p in parts))


def dataset_impact(edges: DataFrame, node: str) -> DataFrame:
    """kind, name, distance of everything downstream of a dataset (or job) in table edges: datasets, jobs and apps."""
    found = reach(edges, [node]).where("distance > 0")
    return found.select(F.substring_index("node", ":", 1).alias("kind"), F.expr("substr(node, instr(node, ':') + 1)").alias("name"), "distance")


def propagated(edges: DataFrame, marks: DataFrame, depth: int = DEPTH) -> DataFrame:
    """node, mark, distance: every mark (node, mark) at all nodes downstream of its own, by the shortest way.

    A fixpoint: a step moves along edges only the marks that were new in the one before, all marks together. Each step is
    written to the shared folder.
    """
    way = cut(edges.select(F.col("source").alias("node"), F.col("target").alias("_to")).distinct())
    front = seen = cut(marks.select("node", "mark").distinct().withColumn("distance", F.lit(0)))
    for step in range(1, depth + 1):
        front = front.join(way, "node").select(F.col("_to").alias("node"), "mark").distinct()
        front = cut(front.join(seen.select("node", "mark"), ["node", "mark"], "left_anti").withColumn("distance", F.lit(step)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def governed(edges: DataFrame, nodes: DataFrame, tags: DataFrame, scores: DataFrame) -> DataFrame:
    """nodes (node) with own and inherited tags (sorted), their own score, and the lowest score upstream of them.

    tags: node, tag, status (active ones count). scores: node, score. A dataset is no better than what it is made from:
    `weakest` is the least of its own score and those of all datasets upstream; null where none of them has a score.
    """
    active = tags.where("status = 'active'").select("node", F.col("tag").alias("mark"))
    spread = propagated(edges, active)
    own = F.sort_array(F.collect_set(F.when(F.col("distance") == 0, F.col("mark")))).alias("tags")
    inherited = F.sort_array(F.collect_set(F.when(F.col("distance") > 0, F.col("mark")))).alias("inherited")
    # a score goes downstream as a mark of its value: equal ones are one
    least = propagated(edges, scores.where("score is not null").select("node", F.col("score").alias("mark"))).groupBy("node").agg(F.min("mark").alias("weakest"))
    out = nodes.join(spread.groupBy("node").agg(own, inherited), "node", "left").join(scores.groupBy("node").agg(F.min("score").alias("score")), "node", "left").join(least, "node", "left")
    none = F.array().cast("array<string>")
    return out.select("node", F.coalesce("tags", none).alias("tags"), F.array_except(F.coalesce("inherited", none), F.coalesce("tags", none)).alias("inherited"), "score", "weakest")


def batch_trace(tables: dict[str, DataFrame], batch_id: str) -> DataFrame:
    """dataset, rows that carry a batch id; tables without the column are left out."""
    parts = [df.where(F.col("_batch_id") == batch_id).agg(F.count("*").alias("rows")).select(F.lit(n).alias("dataset"), "rows") for n, df in tables.items() if "_batch_id" in df.columns]
    return reduce(DataFrame.unionByName, parts)


def anonymous(node: Column) -> Column:
    return F.concat(F.lit("restricted:"), F.left(F.sha1(node), F.lit(12)))


def restricted(edges: DataFrame, hidden: DataFrame) -> DataFrame:
    """Edges with hidden nodes under stable anonymous ids."""
    out = edges
    for end in ("source", "target"):
        h = hidden.select(F.col("node").alias(end), F.lit(True).alias("_h")).distinct()
        out = out.join(h, end, "left").withColumn(end, F.when(F.col("_h"), anonymous(F.col(end))).otherwise(F.col(end))).drop("_h")
    return out.select(edges.columns)


def annotate(nodes: DataFrame, runs: DataFrame, alerts: DataFrame) -> DataFrame:
    """nodes with the last run's status of a job and the open alert of a dataset (freshness shows as late)."""
    last = runs.groupBy(F.concat(F.lit("job:"), "job").alias("node")).agg(F.max_by("status", "at").alias("status"))
    open_ = alerts.where("resolved_at is null").groupBy(F.concat(F.lit("dataset:"), "target").alias("node")).agg(F.min(F.when(F.col("kind") == "freshness", "late").otherwise(F.col("kind"))).alias("alert"))
    return nodes.join(last, "node", "left").join(open_, "node", "left")


def drift(known: DataFrame, now: DataFrame, ever: DataFrame | None = None) -> DataFrame:
    """column, change (added, re-added, type_changed, removed) between two frames of column, type; `ever`: columns once removed."""
    a, b = known.select("column", F.col("type").alias("old")), now.select("column", F.col("type").alias("new"))
    both = a.join(b, "column", "full_outer")
    both = both.join(ever.select("column").distinct().withColumn("_e", F.lit(True)), "column", "left") if ever is not None else both.withColumn("_e", F.lit(None).cast("boolean"))
    change = F.when(F.col("old").isNull(), F.when(F.col("_e"), "re-added").otherwise("added")).when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "type_changed")
    return both.select("column", change.alias("change"), "old", "new").where("change is not null")


def search(datasets: DataFrame, columns: DataFrame, text: str, layer: str | None = None) -> DataFrame:
    """Datasets whose name, description or a column's name holds the text, whatever its case."""
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    hit = columns.where(has(F.col("column"))).select("dataset").distinct().withColumn("_c", F.lit(True))
    found = datasets.join(hit, "dataset", "left").where(has(F.col("dataset")) | has(F.col("description")) | F.coalesce("_c", F.lit(False))).drop("_c")
    return found if layer is None else found.where(F.col("layer") == layer)


def freshness(datasets: DataFrame, as_of) -> DataFrame:
    """Datasets (dataset, last_load, sla_minutes) that were never loaded or are older than their limit."""
    age = F.timestamp_diff("MINUTE", F.col("last_load").cast("timestamp"), F.lit(as_of).cast("timestamp"))
    return datasets.where(F.col("sla_minutes").isNotNull() & (F.col("last_load").isNull() | (age > F.col("sla_minutes")))).withColumn("age_minutes", age)


def alert_state(conditions: DataFrame, alerts: DataFrame, as_of) -> DataFrame:
    """Alerts after a check: at most one open per (kind, target); conditions (kind, target, message) open or keep, their absence resolves."""
    now = F.lit(as_of).cast("timestamp")
    open_, closed = alerts.where("resolved_at is null"), alerts.where("resolved_at is not null")
    c = conditions.groupBy("kind", "target").agg(F.max("message").alias("_m"))
    both = open_.join(c, ["kind", "target"], "full_outer")
    kept = both.select("kind", "target", F.coalesce("_m", "message").alias("message"), F.coalesce("opened_at", now).alias("opened_at"), F.when(F.col("_m").isNull(), now).alias("resolved_at"))
    return closed.select(kept.columns).unionByName(kept)


def ranked(counted: DataFrame, by: str) -> DataFrame:
    """Adds _upto and _of to distinct values (by, _v, _c rows with the value): the running and the whole number of known values."""
    known, w = F.sum(F.when(F.col("_v").isNotNull(), F.col("_c")).otherwise(0)), Window.partitionBy(by)
    return counted.withColumns({"_upto": known.over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)), "_of": known.over(w)})


def at_rank(rank: Column) -> Column:
    """Aggregate of ranked rows: the element of that index of the sorted values."""
    return F.min(F.when(F.col("_upto") > rank, F.col("_v")))


def run_summary(runs: DataFrame, first, last, unit: str = "hour") -> DataFrame:
    """bucket, runs, failed, p50 (element n // 2 of the sorted durations), longest; empty buckets are filled."""
    t = F.date_trunc(unit, "at")
    n = runs.where(F.col("at").between(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp"))).groupBy(t.alias("bucket"), F.col("seconds").alias("_v"))
    n = ranked(n.agg(F.count("*").alias("_c"), F.count_if(F.col("status") == "failed").alias("_f")), "bucket").groupBy("bucket")
    n = n.agg(F.sum("_c").alias("runs"), F.sum("_f").alias("failed"), at_rank(F.floor(F.col("_of") / 2)).alias("p50"), F.max("_v").alias("longest"))
    step = F.expr(f"interval 1 {unit}")
    every = runs.sparkSession.range(1).select(F.explode(F.sequence(F.date_trunc(unit, F.lit(first).cast("timestamp")), F.date_trunc(unit, F.lit(last).cast("timestamp")), step)).alias("bucket"))
    return every.join(n, "bucket", "left").select("bucket", F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("failed", F.lit(0)).alias("failed"), "p50", "longest")


def last_status(runs: DataFrame) -> DataFrame:
    return runs.groupBy("job").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))


def last_failures(runs: DataFrame, n: int = 20) -> DataFrame:
    """A report of the latest failures."""
    return runs.where("status = 'failed'").orderBy(F.desc("at"), "job").limit(n)


