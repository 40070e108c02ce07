"""Topics landed as files: a source and a sink with partitions, offsets and bounded micro-batches, by Spark's data source API.

A topic is a folder `partition=<p>/<first>-<end>.parquet` of segments: key, value, offset, timestamp of the messages with
first <= offset < end. Offsets ascend and may have gaps. A segment appears whole (it is moved to its name) and never changes.

    spark.dataSource.register(TopicLog)
    df.write.format("topic_log").mode("append").save(path)          # partition, offset, key, value, timestamp
    spark.read.format("topic_log").option("startingOffsets", '{"0": 17}').load(path)
    spark.readStream.format("topic_log").option("maxRecords", 1000).option("maxSeconds", 5).option("checkpoint", folder).load(path)

Partitions that the offsets don't name are read from their start, so a new one is part of the next batch. A stream with
`maxRecords` closes a batch at that many offsets; with `maxSeconds` too, it waits until there are so many or the time
since the last batch is over. Where a query goes on is said by Spark's checkpoint, which a Python source isn't told: so a
bounded stream names the query's checkpoint folder and reads the last logged end there, from which the next batch is
measured (a batch that was logged and not finished is run again by Spark as it was). Paths are any that pyarrow's file
systems read. With the trigger availableNow a run is one bounded batch: run again until it has none.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

SCHEMA = "key string, value string, topic string, partition int, offset bigint, timestamp timestamp"
_SEGMENT = re.compile(r"partition=(\d+)/(\d+)-(\d+)\.parquet")


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Segment(InputPartition):
    """Messages of one file with low <= offset < high."""

    file: str
    partition: int
    low: int
    high: int


class Topic:
    """A topic's segments."""

    def __init__(self, path: str):
        self.fs, self.path = _opened(path)
        self.path = self.path.rstrip("/")
        self.name = self.path.rpartition("/")[2]

    def segments(self) -> dict[int, list[tuple[int, int, str]]]:
        """(first, end, file) of every partition, ascending."""
        out: dict[int, list[tuple[int, int, str]]] = {}
        for f in self.fs.get_file_info(fs.FileSelector(self.path, allow_not_found=True, recursive=True)):
            if m := _SEGMENT.fullmatch(f.path[len(self.path) + 1 :]):
                out.setdefault(int(m[1]), []).append((int(m[2]), int(m[3]), f.path))
        return {p: sorted(s) for p, s in out.items()}

    def between(self, start: dict[str, int], end: dict[str, int] | None = None) -> list[Segment]:
        """What is to be read from start to end (by partition; without one: to the present end)."""
        out = []
        for p, some in self.segments().items():
            low, high = start.get(str(p), some[0][0]), some[-1][1] if end is None else end.get(str(p), 0)
            out += [Segment(f, p, max(low, a), min(high, b)) for a, b, f in some if max(low, a) < min(high, b)]
        return out

    def read(self, part: Segment) -> Iterator[pa.RecordBatch]:
        with self.fs.open_input_file(part.file) as file:
            for b in pq.ParquetFile(file).iter_batches(batch_size=8192):
                b = b.filter(pc.and_(pc.greater_equal(b["offset"], part.low), pc.less(b["offset"], part.high)))
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([b["key"], b["value"], pa.array([self.name] * n, pa.string()), pa.array([part.partition] * n, pa.int32()), b["offset"], b["timestamp"]], ["key", "value", "topic", "partition", "offset", "timestamp"])


def logged(checkpoint: str, source: int = 0) -> dict[str, int] | None:
    """The end of the last batch that a query's checkpoint has logged for its n-th source; None before the first."""
    store, folder = _opened(checkpoint)
    files = store.get_file_info(fs.FileSelector(f"{folder}/offsets", allow_not_found=True))
    numbers = [int(f.base_name) for f in files if f.base_name.isdigit()]
    if not numbers:
        return None
    with store.open_input_file(f"{folder}/offsets/{max(numbers)}") as f:
        line = f.read().decode().split("\n")[2 + source]  # behind the format's version and the batch's settings
    return None if line == "-" else json.loads(line)


def admitted(start: dict[str, int], ends: dict[str, int], firsts: dict[str, int], most: int) -> dict[str, int]:
    """Ends of a batch of at most `most` offsets: each partition's share of what is pending, the rest to the first ones that have more."""
    pending = {p: ends[p] - start.get(p, firsts[p]) for p in ends}
    total = sum(pending.values())
    share = {p: n if total <= most else n * most // total for p, n in pending.items()}
    rest = min(most, total) - sum(share.values())
    for p in sorted(pending, key=int):
        more = min(rest, pending[p] - share[p])
        share[p] += more
        rest -= more
    return {p: start.get(p, firsts[p]) + n for p, n in share.items()}


class _Batch(DataSourceReader):
    def __init__(self, topic: Topic, start: dict[str, int], end: dict[str, int] | None):
        self.topic, self.start, self.end = topic, start, end

    def partitions(self) -> list[Segment]:
        return self.topic.between(self.start, self.end) or [Segment("", 0, 0, 0)]

    def read(self, part: Segment) -> Iterator[pa.RecordBatch]:
        return self.topic.read(part) if part.file else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, topic: Topic, start: dict[str, int], most: int | None, seconds: float, checkpoint: str | None):
        if most is not None and not checkpoint:
            raise ValueError("a bounded stream needs the option checkpoint")
        self.topic, self.start, self.most, self.seconds, self.checkpoint = topic, start, most, seconds, checkpoint
        self.given, self.at = None, 0.0

    def initialOffset(self) -> dict:
        return self.start

    def latestOffset(self) -> dict:
        some = self.topic.segments()
        firsts, ends = {str(p): s[0][0] for p, s in some.items()}, {str(p): s[-1][1] for p, s in some.items()}
        if self.most is None:
            return ends
        if self.given is None:  # a new run
            self.given = logged(self.checkpoint) or self.start
        pending = sum(ends[p] - self.given.get(p, firsts[p]) for p in ends)
        if pending < self.most and time.time() - self.at < self.seconds:
            return self.given
        self.given, self.at = self.given | admitted(self.given, ends, firsts, self.most), time.time()
        return self.given

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return self.topic.between(start, end) or [Segment("", 0, 0, 0)]

    def read(self, part: Segment) -> Iterator[pa.RecordBatch]:
        return self.topic.read(part) if part.file else iter(())


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """Each task's rows as one draft per partition; drafts take their names once all tasks are done."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        topic, kind = Topic(self.path), pa.schema([("key", pa.string()), ("value", pa.string()), ("offset", pa.int64()), ("timestamp", pa.timestamp("us", "UTC"))])
        open_: dict[int, list] = {}
        for b in iterator:
            for p in pc.unique(b["partition"]).to_pylist():
                own = b.filter(pc.equal(b["partition"], p))
                rows = pa.RecordBatch.from_arrays([own[f.name].cast(f.type) for f in kind], schema=kind)
                if p not in open_:
                    topic.fs.create_dir(f"{topic.path}/partition={p}", recursive=True)
                    draft = f"{topic.path}/partition={p}/_{uuid.uuid4().hex}"
                    open_[p] = [draft, pq.ParquetWriter(topic.fs.open_output_stream(draft), kind), None, -1]
                at = open_[p]
                offsets = rows["offset"].to_pylist()
                if offsets != sorted(offsets) or offsets and offsets[0] <= at[3]:
                    raise ValueError("a task's rows must ascend by offset in every partition")
                at[1].write_batch(rows)
                at[2], at[3] = offsets[0] if at[2] is None else at[2], offsets[-1]
        for _, writer, _, _ in open_.values():
            writer.close()
        return _Written([(d, f"{topic.path}/partition={p}/{first:020d}-{last + 1:020d}.parquet") for p, (d, _, first, last) in open_.items()])

    def commit(self, messages: list[_Written | None]) -> None:
        store = Topic(self.path).fs
        for draft, name in (f for m in messages if m for f in m.files):
            store.move(draft, name)

    def abort(self, messages: list[_Written | None]) -> None:
        store = Topic(self.path).fs
        for draft, _ in (f for m in messages if m for f in m.files):
            store.delete_file(draft)


class TopicLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "topic_log"

    def schema(self) -> str:
        return SCHEMA

    def _offsets(self, option: str) -> dict[str, int] | None:
        given = self.options.get(option)
        return None if given in (None, "earliest", "latest") else {str(int(p)): int(o) for p, o in json.loads(given).items()}

    def reader(self, schema) -> _Batch:
        return _Batch(Topic(self.options["path"]), self._offsets("startingOffsets") or {}, self._offsets("endingOffsets"))

    def streamReader(self, schema) -> _Stream:
        most = self.options.get("maxRecords")
        return _Stream(Topic(self.options["path"]), self._offsets("startingOffsets") or {}, int(most) if most else None, float(self.options.get("maxSeconds", 0)), self.options.get("checkpoint"))

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("a topic is appended to")
        return _Writer(self.options["path"])
