"""Landed topics: bounded batches, restarts, new partitions, segments that appear whole."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.sources import topic_log as tl


@pytest.fixture
def topic(spark, tmp_path):
    spark.dataSource.register(tl.TopicLog)
    path = str(tmp_path / "orders")

    def land(partition, low, high, step=1):
        rows = spark.range(low, high, step).selectExpr("cast(id as string) as key", "concat('v', id) as value", f"{partition} as partition", "id as offset", "timestamp_millis(id) as timestamp")
        rows.coalesce(1).write.format("topic_log").mode("append").save(path)

    return path, land


def offsets(df):
    return sorted((r.partition, r.offset) for r in df.collect())


def test_bounded_reads(spark, topic):
    path, land = topic
    land(0, 0, 10)
    land(0, 10, 14)
    land(3, 100, 110, 3)
    read = spark.read.format("topic_log")
    every = [(0, i) for i in range(14)] + [(3, i) for i in (100, 103, 106, 109)]
    assert offsets(read.load(path)) == every
    first = read.load(path).where("partition = 0 and offset = 11").first()
    assert (first.key, first.value, first.topic, first.timestamp.microsecond) == ("11", "v11", "orders", 11_000)
    assert offsets(read.option("startingOffsets", '{"0": 9}').load(path)) == every[9:]  # the other partition from its start
    assert offsets(read.option("startingOffsets", '{"0": 9, "3": 104}').option("endingOffsets", '{"0": 12, "3": 109}').load(path)) == [(0, 9), (0, 10), (0, 11), (3, 106)]
    assert offsets(read.load(path + "-none")) == []


def test_a_stream_resumes_with_a_new_partition(spark, topic, tmp_path):
    """Bounded batches, a restart after each run, a partition that comes later, and a batch whose end Spark lost."""
    path, land = topic
    seen, checkpoint = [], str(tmp_path / "cp")

    def run(die=False):
        def write(batch, epoch):
            if die:
                raise RuntimeError("dies in the batch")
            seen.append((epoch, offsets(batch)))

        s = spark.readStream.format("topic_log").option("maxRecords", 6).option("checkpoint", checkpoint).load(path)
        q = s.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        if die:
            with pytest.raises(Exception, match="dies in the batch"):
                q.awaitTermination()
        else:
            q.awaitTermination()

    land(0, 0, 10)
    run()
    assert seen == [(0, [(0, i) for i in range(6)])]
    run(die=True)
    land(1, 50, 53)
    run()
    while len(rows := [x for _, some in seen for x in some]) < 13:
        before = len(rows)
        run()
        assert len(seen) < 12 and before <= 13
    assert sorted(rows) == [(0, i) for i in range(10)] + [(1, i) for i in range(50, 53)] and max(len(x) for _, x in seen) <= 6
    last = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    n = len(seen)
    run()
    assert seen[n] == seen[n - 1]  # the same batch again, under the same epoch
    assert tl.logged(checkpoint) == {"0": 10, "1": 53}


def test_a_batch_closes_by_records_or_time(spark, topic, tmp_path):
    path, land = topic
    land(0, 0, 5)
    checkpoint = tmp_path / "cp"
    r = tl._Stream(tl.Topic(path), {}, 10, 0.5, str(checkpoint))
    assert tl.logged(str(checkpoint)) is None and r.latestOffset() == {"0": 5}  # the first at once
    land(0, 5, 8)
    assert r.latestOffset() == {"0": 5}  # too few, too early
    time.sleep(0.6)
    assert r.latestOffset() == {"0": 8}  # the time is over
    land(0, 8, 30)
    assert r.latestOffset() == {"0": 18}  # enough of them
    (checkpoint / "offsets").mkdir(parents=True)
    for n, end in ((9, 8), (10, 18)):
        (checkpoint / "offsets" / str(n)).write_text(f'v1\n{{"batchTimestampMs":0}}\n{{"0": {end}}}')
    assert tl._Stream(tl.Topic(path), {}, 10, 0.5, str(checkpoint)).latestOffset() == {"0": 28}  # from what was logged
    with pytest.raises(ValueError):
        tl._Stream(tl.Topic(path), {}, 10, 0.5, None)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 6).map(str), st.tuples(st.integers(0, 50), st.integers(0, 50)), max_size=6), st.integers(1, 120))
def test_admission(parts, most):
    """Never beyond the bound or the ends, never behind, and as many as there may be."""
    start, ends = {p: a for p, (a, _) in parts.items()}, {p: a + n for p, (a, n) in parts.items()}
    got = tl.admitted(start, ends, start, most)
    assert all(start[p] <= got[p] <= ends[p] for p in ends)
    assert sum(got[p] - start[p] for p in got) == min(most, sum(ends.values()) - sum(start.values()))


def test_only_whole_and_ascending_segments(spark, topic):
    path, land = topic
    land(0, 0, 4)
    rows = spark.range(4, 8).selectExpr("cast(id as string) as key", "if(id = 7, raise_error('x'), 'v') as value", "0 as partition", "id as offset", "timestamp_millis(id) as timestamp")
    for bad in (rows, rows.withColumn("value", F.lit("v")).orderBy(F.desc("offset"))):
        with pytest.raises(Exception):  # noqa: B017
            bad.coalesce(1).write.format("topic_log").mode("append").save(path)
    assert offsets(spark.read.format("topic_log").load(path)) == [(0, i) for i in range(4)]
    with pytest.raises(Exception, match="appended"):
        rows.write.format("topic_log").mode("overwrite").save(path)
