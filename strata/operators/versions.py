"""Versioned tables: a log of small files, parts of rows, upserts that write only what changed, compaction.

A version is the log up to its number. An entry of the log is written under a name that nobody reads and then published
under its number, whole, and by one writer alone: a writer that dies leaves nothing that others see or wait for. A
writer whose number is taken reads what came in between, among it whether its own transaction is in there already.

Rows lie in parts, one folder of Parquet files each, which never change. A base part has rows, a delta part has the last
row per key of an upsert, sorted by key, and marks what is deleted. A delta hides rows of its keys in parts before it,
so an upsert writes its own rows and reads nothing, and a full load, an append or a compaction may come before or after.
Reading joins base parts against the deltas behind them whose key ranges overlap theirs (left anti, and Spark broadcasts
deltas that are small), and takes each key's last delta row. Compaction merges small parts and folds deltas that have
grown into the rows; nothing else is rewritten.
"""

from __future__ import annotations

import json
import math
import os
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from functools import reduce
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.tables import conform

#: The flag of deleted keys in delta parts; no table has a column of this name.
GONE = "__gone"
#: Types whose least and largest value a part has in the log.
RANGED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.DateType)
#: A transaction: who writes and, ascending for each, which of its writes. A text alone is a writer's only write.
Txn = str | tuple[str, int] | None


class Conflict(RuntimeError):
    """Another writer replaced what this write was to follow."""


class Log:
    """Entries 0, 1, 2, ... as files of one folder, with the whole state beside every `EVERY`-th."""

    EVERY = 16

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = self.fs.makeQualified(p).toString()

    def at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def has(self, number: int) -> bool:
        return self.fs.exists(self.at(f"{number:020d}.json"))

    def read(self, number: int, kind: str = "json") -> dict:
        stream = self.fs.open(self.at(f"{number:020d}.{kind}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def states(self) -> list[int]:
        """Numbers that have a state, ascending; from names alone."""
        if not self.fs.exists(self.at(".").getParent()):
            return []
        names = (s.getPath().getName() for s in self.fs.globStatus(self.at("*.state")) or [])
        return sorted(int(n[:20]) for n in names if re.fullmatch(r"\d{20}\.state", n))

    def put(self, number: int, content: dict, kind: str = "json") -> bool:
        """Publishes an entry; whether this writer was the one."""
        draft, to = self.at(f"_{uuid.uuid4().hex}"), self.at(f"{number:020d}.{kind}")
        out = self.fs.create(draft, True)
        out.write(json.dumps(content).encode())
        out.close()
        try:
            return self._linked(draft, to) if urlparse(self.path).scheme == "file" else self._renamed(draft, to)
        finally:
            self.fs.delete(draft, False)

    def _linked(self, draft, to) -> bool:
        """On a local disk: a second name, which the system refuses where there is one."""
        try:
            os.link(urlparse(draft.toString()).path, urlparse(to.toString()).path)
            return True
        except FileExistsError:
            return False

    def _renamed(self, draft, to) -> bool:
        """Elsewhere: a rename that doesn't overwrite. (HDFS does it in one step; an object store needs a file system that does.)"""
        jvm = self.spark._jvm
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, to, how)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception.getClass()):
                return False
            raise


@dataclass(frozen=True)
class State:
    """A version: its parts, columns, keys, and each writer's last write with the version it made."""

    version: int = -1
    parts: tuple[dict, ...] = ()
    schema: dict | None = None
    keys: tuple[str, ...] | None = None
    txns: dict[str, list[int]] = field(default_factory=dict)

    def after(self, entry: dict) -> State:
        gone = entry["remove"]
        kept = () if gone == "all" else tuple(p for p in self.parts if p["path"] not in set(gone))
        added = tuple({"seq": entry["version"], **p} for p in entry["add"])
        txns = self.txns | ({entry["txn"][0]: [entry["txn"][1], entry["version"]]} if entry["txn"] else {})
        return State(entry["version"], kept + added, entry["schema"], None if entry["keys"] is None else tuple(entry["keys"]), txns)

    def done(self, txn: tuple[str, int] | None) -> int | None:
        """The version that a transaction, or a later one of the same writer, made."""
        have = self.txns.get(txn[0]) if txn else None
        return have[1] if have and have[0] >= txn[1] else None

    @property
    def types(self) -> T.StructType | None:
        return None if self.schema is None else T.StructType.fromJson(self.schema)


def _txn(txn: Txn) -> tuple[str, int] | None:
    return (txn, 0) if isinstance(txn, str) else txn


def _overlap(a: dict, b: dict) -> bool:
    """Whether two parts may share a key: unless their ranges are known and apart."""
    if "low" not in a or "low" not in b:
        return True
    if a["low"] is None or b["low"] is None:
        return False
    order = (lambda x: x.encode()) if isinstance(a["low"], str) else (lambda x: x)
    return order(a["low"]) <= order(b["high"]) and order(b["low"]) <= order(a["high"])


class Versions:
    """A table as numbered versions in one folder: full loads, appends, upserts, time travel, history, statistics."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Log(spark, f"{self.path}/_log")
        self._known = State()

    # -- the log

    def _state(self, version: int | None = None) -> State:
        """The latest version's state, or that of an earlier one: from the nearest stored state on, entry by entry."""
        state = self._known
        if state.version < 0 or version is not None and version < state.version:
            stored = [n for n in self.log.states() if version is None or n <= version]
            state = State() if not stored else State(**{k: tuple(v) if k in ("parts", "keys") and v is not None else v for k, v in self.log.read(stored[-1], "state").items()})
        while state.version != version and self.log.has(state.version + 1):
            state = state.after(self.log.read(state.version + 1))
        if version is not None and state.version != version:
            raise ValueError(f"no version {version}")
        if version is None:
            self._known = state
        return state

    def _publish(self, op: str, txn: tuple[str, int] | None, change: Callable[[State], dict]) -> int:
        """The number of the version that `change` (of the state it is to follow) makes; of an earlier one, if the transaction is done."""
        while True:
            state = self._state()
            if (done := state.done(txn)) is not None:
                return done
            number = state.version + 1
            entry = {"version": number, "at": datetime.now(UTC).isoformat(), "op": op, "txn": txn, "remove": [], **change(state)}
            if self.log.put(number, entry):
                new = self._state(number)
                if number % Log.EVERY == 0:
                    self.log.put(number, vars(new) | {"parts": list(new.parts)}, "state")
                return number

    def latest(self) -> int | None:
        version = self._state().version
        return None if version < 0 else version

    def history(self) -> DataFrame:
        """version, op, txn, at, parts added: one row per version."""
        rows = "version long, op string, txn array<string>, at timestamp, add array<struct<path:string>>"
        if self.latest() is None:
            return self.spark.createDataFrame([], "version long, op string, txn string, at timestamp, parts int")
        log = self.spark.read.schema(rows).option("pathGlobFilter", "*.json").json(self.log.path)
        return log.select("version", "op", F.concat_ws(":", "txn").alias("txn"), "at", F.size("add").alias("parts"))

    def made_by(self, txn: Txn) -> int | None:
        """The version that a transaction made, if it is its writer's last."""
        app, number = _txn(txn)
        have = self._state().txns.get(app)
        return have[1] if have and have[0] == number else None

    def added(self, version: int | None) -> DataFrame:
        """Rows that a version's own parts have (deleted keys left out); none for None."""
        state = self._state()
        parts = [] if version is None else self.log.read(version)["add"]
        return self._scan(state, parts, True).where(F.col(GONE).isNull() | ~F.col(GONE)).drop(GONE)

    # -- parts

    def _store(self, df: DataFrame, kind: str, keys: tuple[str, ...] | None) -> dict:
        """Writes a part. Bloom filters on a base part's keys let a look-up skip row groups; a delta is sorted by them."""
        path = f"{self.path}/data-{uuid.uuid4().hex}"
        writer = df.write.option("parquet.bloom.filter.adaptive.enabled", "true")  # as large as the keys ask for
        for k in (keys or ()) if kind == "base" else ():
            writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
        writer.parquet(path)
        out = {"path": path, "kind": kind}
        size = self.log.fs.getContentSummary(self.spark._jvm.org.apache.hadoop.fs.Path(path))
        out |= {"bytes": size.getLength(), "files": max(0, size.getFileCount() - 1)}  # without Spark's mark of success
        if keys and isinstance(df.schema[keys[0]].dataType, RANGED):
            low, high = self.spark.read.schema(df.schema).parquet(path).agg(F.min(keys[0]), F.max(keys[0])).first()
            out |= {"low": low, "high": high} if low is None or isinstance(low, (int, str)) else {"low": low.isoformat(), "high": high.isoformat()}
        return out

    def _drop(self, part: dict) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(part["path"])
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _scan(self, state: State, parts: list[dict], gone: bool = False) -> DataFrame:
        schema = T.StructType([*state.types.fields, T.StructField(GONE, T.BooleanType())]) if gone else state.types
        paths = [p["path"] for p in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _last(self, state: State, deltas: list[dict]) -> DataFrame:
        """Each key's last row in the deltas, deleted ones too, and all rows with a null key."""
        columns, keys = [f.name for f in state.types] + [GONE], list(state.keys)
        if len(deltas) == 1:
            return self._scan(state, deltas, True)
        rows = reduce(DataFrame.unionByName, (self._scan(state, [d], True).withColumn("__seq", F.lit(d["seq"])) for d in deltas))
        known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
        last = rows.where(known).groupBy(*keys).agg(F.max_by(F.struct(*(c for c in columns if c not in keys)), "__seq").alias("__r"))
        return last.select(*keys, "__r.*").select(columns).unionByName(rows.where(~known).select(columns))

    def _visible(self, state: State, parts: list[dict]) -> DataFrame:
        """Rows of base parts that no delta hides."""
        deltas, groups = [p for p in state.parts if p["kind"] == "delta"], {}
        for p in parts:
            over = tuple(d["path"] for d in deltas if d["seq"] > p["seq"] and _overlap(p, d))
            groups.setdefault(over, []).append(p)
        out = []
        for over, some in groups.items():
            rows = self._scan(state, some)
            if over:
                keys = self._scan(state, [d for d in deltas if d["path"] in over]).select(*state.keys)
                rows = rows.join(keys, list(state.keys), "left_anti").select(rows.columns)
            out.append(rows)
        return reduce(DataFrame.unionByName, out) if out else self._scan(state, [])

    def _rows(self, state: State) -> DataFrame:
        base, deltas = ([p for p in state.parts if p["kind"] == k] for k in ("base", "delta"))
        rows = self._visible(state, base)
        return rows.unionByName(self._last(state, deltas).where(~F.col(GONE)).drop(GONE)) if deltas else rows

    def read(self, version: int | None = None) -> DataFrame:
        """A version's rows; columns that a part lacks are null."""
        state = self._state(version)
        if state.version < 0:
            raise ValueError("no version")
        return self._rows(state)

    # -- writes

    @staticmethod
    def _columns(state: State, new: T.StructType) -> dict:
        """The table's columns and the new ones; a type that differs is a conflict (it was checked before another writer came)."""
        have = {f.name: f.dataType for f in state.types or []}
        if any(have.get(f.name, f.dataType) != f.dataType for f in new):
            raise Conflict("another writer gave a column another type")
        fields = [*(state.types or []), *(f for f in new if f.name not in have)]
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields]).jsonValue()

    def write(self, df: DataFrame, txn: Txn = None, keys: list[str] | None = None) -> int:
        """A full load: the next version holds these rows alone. keys: those of later upserts, by default the ones known."""
        txn, state = _txn(txn), self._state()
        if (done := state.done(txn)) is not None:
            return done
        own = tuple(keys) if keys else state.keys if state.keys and set(state.keys) <= set(df.columns) else None
        part = self._store(df, "base", own)
        return self._publish("write", txn, lambda s: {"add": [part], "remove": "all", "schema": self._columns(State(), df.schema), "keys": own})

    def append(self, df: DataFrame, txn: Txn = None) -> int | None:
        """The latest rows and these, which alone are written; a batch without rows writes nothing."""
        txn, state = _txn(txn), self._state()
        if (done := state.done(txn)) is not None:
            return done
        rows = df if state.types is None else conform(df, state.types)
        part = self._store(rows, "base", state.keys)
        if not footer_rows(self.spark, part["path"], rows.schema):
            self._drop(part)
            return self.latest()
        return self._publish("append", txn, lambda s: {"add": [part], "schema": self._columns(s, rows.schema), "keys": s.keys})

    def upsert(self, batch: DataFrame, keys: list[str], delete_flag: str | None = None, txn: Txn = None) -> int | None:
        """The latest rows after updates of the batch's keys, inserts of new ones and deletes of flagged ones.

        Keys must be unique in the batch; a null key is always inserted. Columns that the batch lacks keep their values:
        only then are old rows read, those of the batch's keys. A batch without rows writes nothing.
        """
        txn = _txn(txn)
        while True:
            state = self._state()
            if (done := state.done(txn)) is not None:
                return done
            if state.keys not in (None, tuple(keys)):
                raise ValueError(f"the table's keys are {state.keys}")
            flag = F.coalesce(F.col(delete_flag), F.lit(False)) if delete_flag else F.lit(False)
            rows = batch.select(*(c for c in batch.columns if c != delete_flag), flag.alias(GONE))
            rows = rows if state.types is None else conform(rows, state.types)
            keyed = replace(state, keys=tuple(keys))
            lacks = [f.name for f in state.types or [] if f.name not in rows.columns]
            if lacks and state.parts:
                old = self._rows(keyed).join(rows.select(*keys), keys, "left_semi").select(*keys, *lacks)
                rows = rows.join(old, keys, "left")
            part = self._store(rows.sort(*keys), "delta", tuple(keys))
            if not part["bytes"] or not footer_rows(self.spark, part["path"], rows.schema):
                self._drop(part)
                return self.latest()
            kinds = T.StructType([f for f in rows.schema if f.name != GONE])

            def change(s: State) -> dict:
                if lacks and s.version != state.version:
                    raise Conflict("rows that were read may have changed")
                return {"add": [part], "schema": self._columns(s, kinds), "keys": keys}

            try:
                return self._publish("upsert", txn, change)
            except Conflict:
                self._drop(part)
                if not lacks:
                    raise

    # -- maintenance

    def stats(self) -> DataFrame:
        """rows, bytes, files and parts of the latest version. Rows come from footers, unless deltas hide some."""
        state = self._state()
        if any(p["kind"] == "delta" for p in state.parts):
            rows = self._rows(state).count()
        else:
            rows = sum(footer_rows(self.spark, p["path"], state.types) for p in state.parts)
        total = (rows, *(sum(p[k] for p in state.parts) for k in ("bytes", "files")), len(state.parts))
        return self.spark.createDataFrame([total], "rows long, bytes long, files long, parts long")

    def compact(self, file_bytes: int = 128 << 20, fold: float = 0.25) -> int | None:
        """Small parts merged, and deltas folded into the rows once they have `fold` times the rows' bytes.

        Base parts whose files are small are packed, in order of their key ranges, into parts of about `file_bytes`;
        deltas that follow each other with no part between them become one. Parts that aren't merged stay as they are.
        None: there is nothing to merge. A concurrent writer that replaces the same parts is a Conflict; others aren't.
        """
        state = self._state()
        base, deltas = ([p for p in state.parts if p["kind"] == k] for k in ("base", "delta"))
        old, new = [], []

        def merged(rows: DataFrame, some: list[dict], kind: str, seq: int) -> None:
            n = max(1, math.ceil(sum(p["bytes"] for p in some) / file_bytes))
            dealt = rows.repartitionByRange(n, *state.keys).sortWithinPartitions(*state.keys) if state.keys else rows.coalesce(n)
            new.append(self._store(dealt, kind, state.keys) | {"seq": seq})
            old.extend(p["path"] for p in some)

        if deltas and sum(p["bytes"] for p in deltas) >= fold * sum(p["bytes"] for p in base):
            merged(self._rows(state), [*base, *deltas], "base", state.version)
        else:
            small = [p for p in base if p["files"] and p["bytes"] / p["files"] < file_bytes / 2]
            order = sorted(small, key=lambda p: (str(p.get("low")) if isinstance(p.get("low"), str) else "", p["low"] if isinstance(p.get("low"), int) else 0))
            for some in _bins(order, file_bytes):
                if len(some) > 1 or some[0]["files"] > math.ceil(some[0]["bytes"] / file_bytes):
                    merged(self._visible(state, some), some, "base", max(p["seq"] for p in some))
            places = sorted(p["seq"] for p in base)
            run: list[dict] = []
            for d in [*sorted(deltas, key=lambda p: p["seq"]), None]:
                if run and (d is None or any(run[-1]["seq"] <= b < d["seq"] for b in places)):
                    if len(run) > 1:
                        merged(self._last(state, run), run, "delta", run[-1]["seq"])
                    run = []
                run.append(d)
        if not old:
            return None

        def change(s: State) -> dict:
            if not {*old} <= {p["path"] for p in s.parts}:
                raise Conflict("parts to merge are no longer there")
            return {"add": new, "remove": old, "schema": s.schema, "keys": s.keys}

        try:
            return self._publish("compact", None, change)
        except Conflict:
            for part in new:
                self._drop(part)
            raise


def _bins(parts: list[dict], most: int) -> list[list[dict]]:
    """Neighbours together until they have about `most` bytes."""
    out, size = [], most
    for p in parts:
        if size + p["bytes"] > most:
            out.append([])
            size = 0
        out[-1].append(p)
        size += p["bytes"]
    return out


def footer_rows(spark: SparkSession, path: str, schema: T.StructType) -> int:
    """Rows of a Parquet folder; a count that the scan answers from footers (an aggregate pushed down)."""
    keys = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        return spark.read.schema(schema).parquet(path).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
