import gzip
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators import tables as t
from strata.operators.versions import Versions
from strata.plans import pipeline as p
from strata.sources import files, incremental, serving
from strata.streaming import changes as ch

AT = datetime(2026, 3, 5, 14, 30)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_merge_rules(spark):
    old = spark.createDataFrame([(1, 10.0, "k"), (2, 5.0, "k"), (None, 1.0, "k")], "id int, v double, extra string")
    new = spark.createDataFrame([(2, 7.5, False), (3, 1.0, False), (None, 2.0, False), (1, 0.0, True), (9, 0.0, True)], "id int, v double, gone boolean")
    got = t.merge(old, new, ["id"], "gone")
    assert sorted(map(str, got.collect())) == sorted(map(str, [T.Row(id=2, v=7.5, extra="k"), T.Row(id=3, v=1.0, extra=None), T.Row(id=None, v=1.0, extra="k"), T.Row(id=None, v=2.0, extra=None)]))
    assert t.merge(None, new, ["id"], "gone").count() == 3
    with pytest.raises(ValueError):
        t.last_per_key(old, ["id"], [])


def test_conform_and_storage(spark):
    df = spark.createDataFrame([(1.0, "a")], "x double, s string").withColumn("n", F.lit(None))
    assert dict(t.storable(df).dtypes)["n"] == "string"
    to = T.StructType([T.StructField("x", T.IntegerType())])
    assert t.conform(df, to).first().x == 1
    with pytest.raises(Exception, match="not a int"):
        t.conform(df.withColumn("x", F.lit(1.5)), to).collect()
    audited = t.with_audit(df.withColumn("_source", F.lit("old")), AT, "s", "b1")
    assert audited.columns[-4:] == ["_load_ts", "_source", "_batch_id", "_file"] and audited.first()._source == "s"
    assert t.append(df.select("x"), df).columns == ["x", "s", "n"]


@pytest.mark.parametrize("template, want", [("a_{yyyyMMdd}.csv", "a_20260305.csv"), ("{yyyy}/{MM}/x", "2026/03/x"), ("{yyyyMMdd-1d}", "20260304"), ("{yyyy-MM-dd+1w}", "2026-03-12"), ("{HHmm-90m}", "1300"), ("*.csv", "*.csv")])
def test_templates(template, want):
    assert files.render(template, AT) == want


def test_templates_to_refuse():
    for bad in ("{yyyyQQ}", "{}", "{-1d}"):
        with pytest.raises(ValueError):
            files.render(bad, AT)
    with pytest.raises(ValueError):
        files.resolve("/data/in", "../other/{yyyy}", AT)
    with pytest.raises(ValueError):
        files.infer_format("x.doc")


def test_files(spark, tmp_path):
    (tmp_path / "orders_20260305_a.csv").write_text("id,amount,email\n1,2.5,a@b.c\n2,NULL,\n")
    (tmp_path / "orders_20260305_b.csv.gz").write_bytes(gzip.compress(b"id,amount,email\n3,1,x@y.z\n"))
    path = files.resolve(str(tmp_path), "orders_{yyyyMMdd}*.csv*", AT)
    df = files.read_csv(spark, path)
    assert rows(df, "id") == [(1,), (2,), (3,)] and dict(df.dtypes)["amount"] == "double" and df.where("amount is null and email is null").count() == 1
    (tmp_path / "skip.tsv").write_text("junk\nk\tv\n1\tx\n2\ty\n")
    assert rows(files.read_csv(spark, str(tmp_path / "skip.tsv"), skip_rows=1)) == [(1, "x"), (2, "y")]
    (tmp_path / "api.json").write_text('{"data": [{"id": 1, "tags": ["x"]}, {"id": 2, "o": {"b": 1}}]}')
    assert [tuple(r) for r in files.read_document(spark, str(tmp_path / "api.json"), "data").orderBy("id").collect()] == [(1, None, '["x"]'), (2, '{"b":1}', None)]
    (tmp_path / "e.jsonl").write_text('{"k": 1, "s": {"a": 1}}\n{"k": 2}\n')
    assert rows(files.read(spark, str(tmp_path / "e.jsonl")), "k") == [(1,), (2,)]
    seen = files.listing(spark, str(tmp_path / "*.csv*"))
    assert files.new_files(seen, seen.limit(0)).count() == seen.count() and files.new_files(seen, seen).count() == 0
    m = files.manifest(spark, str(tmp_path / "*.jsonl"), spark.read.json(str(tmp_path / "e.jsonl")).select("*", "_metadata"))
    assert m.count() == 1 and len(m.first().sha256) == 64


def test_pages_topics_and_watermarks(spark):
    landed = spark.createDataFrame([('{"page": {"rows": [{"id": 1}, {"id": 2, "n": {"x": 1}}]}}',)], "value string")
    assert rows(incremental.pages(landed, "$.page.rows"), "id") == [(1,), (2,)]
    assert rows(incremental.pages(landed, "$.page.rows", mark_column="id", mark=1), "id") == [(2,)]
    raw = spark.createDataFrame([("k", '{"a": "1"}', 0, 5, AT), (None, "text", 1, 6, AT)], "key string, value string, partition int, offset long, timestamp timestamp")
    assert sorted(map(str, (tuple(r) for r in incremental.topic_rows(raw, ["a", "value"]).select("a", "value", "_kafka_offset").collect()))) == sorted(map(str, [("1", None, 5), (None, "text", 6)]))
    df = spark.createDataFrame([(1,), (5,), (None,)], "wm int")
    assert incremental.after(df, "wm", 1).count() == 1 and incremental.advance(df, "wm", 9) == 9 and incremental.advance(df, "wm", None) == 5


DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def test_serving_on_derby(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    read = lambda: sorted((r[0], r[1]) for r in incremental.jdbc(spark, url, "served", driver=DERBY).collect())
    frame = lambda rows, kinds="id int, v string": spark.createDataFrame(rows, kinds)
    with pytest.raises(LookupError):
        serving.upsert(frame([(1, "a")]), url, "served", ["id"], DERBY)
    serving.replace(frame([(1, "a"), (2, "b")]), url, "served", DERBY, ["id"])
    assert rows(incremental.after(incremental.jdbc(spark, url, "served", driver=DERBY), "ID", 1)) == [(2, "b")]
    serving.upsert(frame([(2, "z"), (3, "c"), (4, None)]), url, "served", ["id"], DERBY)
    assert read() == [(1, "a"), (2, "z"), (3, "c"), (4, None)]
    with pytest.raises(ValueError):
        serving.upsert(frame([(2, 5)], "id int, w int"), url, "served", ["id"], DERBY)
    with pytest.raises(Exception, match="duplicate key"):
        serving.upsert(frame([(9, "x"), (9, "y")]), url, "served", ["id"], DERBY)
    assert read() == [(1, "a"), (2, "z"), (3, "c"), (4, None)]
    assert serving.serve(frame([(7, "n")]), frame([(1, "m")]), url, "served", ["id"], DERBY) == "upsert" and (1, "m") in read()
    assert serving.serve(frame([(7, 1.5)], "id int, w double"), frame([(7, 1.5)], "id int, w double"), url, "served", ["id"], DERBY) == "replace" and read() == [(7, 1.5)]
    tables = incremental.jdbc(spark, url, query="select tablename as t from sys.systables where tabletype = 'T'", driver=DERBY)
    assert [r.T for r in tables.collect()] == ["SERVED"]  # no staging table is left


def test_a_failed_look_loses_nothing(spark, tmp_path, monkeypatch):
    """The catalogue fails once: the upsert is an error, and the table keeps all rows."""
    url, many = f"jdbc:derby:{tmp_path}/db;create=true", spark.range(5).selectExpr("cast(id as int) as id", "'v' as v")
    serving.replace(many, url, "served", DERBY)

    def broken(self, table):
        raise RuntimeError("connection lost")

    with monkeypatch.context() as m:
        m.setattr(serving.Database, "columns", broken)
        for call in (lambda: serving.upsert(many.limit(1), url, "served", ["id"], DERBY), lambda: serving.serve(many, many.limit(1), url, "served", ["id"], DERBY)):
            with pytest.raises(RuntimeError):
                call()
    assert incremental.jdbc(spark, url, "served", driver=DERBY).count() == 5


def test_serving_types_and_statements(spark):
    kinds = [T.BooleanType(), T.ShortType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.DecimalType(9, 2), T.TimestampType(), T.TimestampNTZType(), T.DateType(), T.BinaryType(), T.StringType(), T.ArrayType(T.IntegerType())]
    assert [serving.column_type(k, "jdbc:postgresql://h/d") for k in kinds] == ["boolean", "smallint", "integer", "bigint", "double precision", "numeric(9,2)", "timestamptz", "timestamp", "date", "bytea", "text", "text"]
    db = serving.Database(spark, "jdbc:postgresql://h/d")
    assert db.merge("t", "s", ["k", "v"], ["k"]) == 'INSERT INTO t ("k", "v") SELECT "k", "v" FROM s ON CONFLICT ("k") DO UPDATE SET "v" = excluded."v"'
    assert db.merge("t", "s", ["k"], ["k"]).endswith('ON CONFLICT ("k") DO NOTHING')
    assert serving.Database(spark, "jdbc:mysql://h/d").merge("t", "s", ["k", "v"], ["k"]).endswith("ON DUPLICATE KEY UPDATE `v` = VALUES(`v`)")


def test_records_keep_their_types(spark):
    texts = ['{"a": 1, "b": 1.5, "c": true, "d": "x", "e": {"z": 1, "y": [2]}, "m": 1}', '{"a": 2, "m": "two", "we ird`s": null}', "7", "not json", None]
    df = files.normalize(spark.createDataFrame([(x,) for x in texts], "value string"))
    kinds = dict(df.dtypes)
    assert df.columns == ["a", "b", "c", "d", "e", "m", "value", "we ird`s"]
    assert (kinds["a"], kinds["c"], kinds["d"], kinds["e"], kinds["m"]) == ("bigint", "boolean", "string", "string", "string")
    got = {r.a: r for r in df.where("a is not null").collect()}
    assert (got[1].c, got[1].e, float(got[1].b), got[1].m, got[2].m) == (True, '{"y":[2],"z":1}', 1.5, "1", "two")
    assert sorted(r["value"] for r in df.where("a is null and value is not null").collect()) == ["7", "not json"]


def test_skipped_lines_keep_quoted_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("junk\n\xe9 junk\nk,v\n1,\"x\ny\"\n2,\xe9\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes(b"junk\njunk\nv,w\nz,9\n")
    df = files.read_csv(spark, str(tmp_path / "*.csv"), skip_rows=2, encoding="latin-1")
    assert sorted(map(str, (tuple(r) for r in df.select("k", "v", "w").collect()))) == sorted(map(str, [(1, "x\ny", None), (2, "\u00e9", None), (None, "z", 9)]))


def test_documents_offsets_and_arrival(spark, tmp_path):
    landed = spark.createDataFrame([('{"_id": {"$oid": "ab"}, "n": 1, "k": "x"}',), ('{"_id": 7, "n": 2, "k": "x", "o": {"b": 1}}',), ('{"_id": "q", "n": 3, "k": "y"}',)], "value string")
    assert rows(incremental.documents(landed), "_id") == [("7",), ("ab",), ("q",)]
    assert rows(incremental.documents(landed, {"k": "x"}, "n", 1), "_id", "o") == [("7", '{"b":1}')]
    raw = spark.createDataFrame([(p, o) for p in (0, 1, 2) for o in range(3)], "partition int, offset long")
    assert rows(incremental.uncommitted(raw, {0: 2, 1: 3})) == [(0, 2), (2, 0), (2, 1), (2, 2)] and incremental.uncommitted(raw, {}).count() == 9
    read = raw.toDF("_kafka_partition", "_kafka_offset")
    assert incremental.next_offsets(read, {0: 9, 5: 1}) == {0: 9, 1: 3, 2: 3, 5: 1} and incremental.next_offsets(read.limit(0), {1: 4}) == {1: 4}
    (tmp_path / "x.csv").write_text("a\n1\n")
    seen = files.listing(spark, str(tmp_path / "*.csv"))
    assert files.arrived(seen, seen.limit(0)) and not files.arrived(seen, seen)


def test_load_plan(spark, tmp_path):
    """Order of loads, disabled mappings, dependents of tables with new rows only, no rows from a second run."""
    src = spark.createDataFrame([(1, 5, AT), (2, 5, AT)], "id int, g int, _load_ts timestamp")
    tables = {n: Versions(spark, str(tmp_path / n)) for n in ("b", "a", "l", "s", "off", "pit", "other")}
    seen = []

    def load(name, keys):
        def run(staged, held):
            seen.append(name)
            rows = staged.select(*keys).distinct()
            return rows if held is None else rows.join(held, keys, "left_anti")

        return run

    maps = [p.Mapping("satellite", "s", load("s", ["id", "g"])), p.Mapping("link", "l", load("l", ["id", "g"])), p.Mapping("hub", "b", load("b", ["g"])), p.Mapping("hub", "a", load("a", ["id"])), p.Mapping("hub", "off", load("off", ["id"]), False)]
    after = {"pit": ({"s", "a"}, lambda f: f["a"].join(f["s"], "id")), "other": ({"off"}, lambda f: f["off"])}
    assert p.load_plan(src, "src", maps, tables, after, "t1") == (["a", "b", "l", "s"], ["pit"]) == (seen, ["pit"])
    assert p.load_plan(src, "src", maps, tables, after, "t2") == (["a", "b", "l", "s"], [])
    assert tables["pit"].read().count() == 2 and tables["off"].latest() is None
    with pytest.raises(ValueError):
        p.load_plan(src.drop("_load_ts"), "src", maps, tables, after, "t3")


def test_templates_of_models(spark):
    sql, names = p.render("select * from {{ ref('a') }} join {{ source('s', 't') }} using (id) {% if is_incremental() %} where x > (select max(x) from {{ this }}) {% endif %}", True)
    assert "this" in sql and names == {"ref__a": ("ref", "a"), "source__s__t": ("source", "s", "t")}
    assert "where" not in p.render("select 1 {% if is_incremental() %} where 1=0 {% endif %}")[0]
    for bad in ("{{ evil() }}", "{% for x in y %}"):
        with pytest.raises(ValueError):
            p.render(bad)
    with pytest.raises(ValueError):
        p.select(spark, "drop table x")
    assert p.select(spark, "select 1 as a").first().a == 1


def test_pipeline_states(spark):
    one = spark.range(3)
    fail = lambda a: a.select("nope")
    pipe = p.Pipeline({"a": ({"in"}, lambda **k: k["in"]), "b": ({"a"}, lambda a: a), "bad": ({"a"}, fail), "c": ({"bad"}, lambda bad: bad), "d": ({"absent"}, lambda absent: absent)})
    pipe.models["late"] = ({"a"}, lambda a: a.select(F.raise_error(F.lit("at run time")).alias("x")))
    states = pipe.run({"in": one})[1]
    assert [states[k].split(":")[0] for k in ("a", "b", "bad", "c", "d", "late")] == ["succeeded", "succeeded", "failed", "skipped", "skipped", "failed"]
    with pytest.raises(ValueError):
        p.order({"a": {"b"}, "b": {"a"}})


def message(key, value, offset, partition=0):
    return (key, value, "t", partition, offset, AT)


RAW = "key string, value string, topic string, partition int, offset long, timestamp timestamp"


def test_decode_rules(spark):
    raw = spark.createDataFrame(
        [
            message('{"id": 1}', '{"id": 1, "v": "a", "__op": "c", "__source_ts_ms": 5}', 0),
            message('{"id": 1}', '{"__deleted": "true"}', 1),
            message("bad", '{"id": 2, "v": {"x": 1}, "v2": 1, "v2": 2}', 9),
            message(None, "[1]", 10),
            message(None, "null", 11),
            message(None, None, 12),
            message(None, "{}", 13),
        ],
        RAW,
    )
    got = {r._offset: r for r in ch.decode(raw, ["id", "_id", "v"]).collect()}
    assert (got["0:0"]._op, got["0:0"].v, got["0:0"]._source_ts.microsecond) == ("c", "a", 5000)
    assert (got["0:1"]._op, got["0:1"]._id, got["0:1"].id) == ("d", "1", None)
    assert (got["0:9"]._op, got["0:9"].v, got["0:13"]._op) == ("r", '{"x":1}', "r")
    assert sorted(r.offset for r in ch.dead_letters(raw).collect()) == [10, 11, 12]


def test_stream_replays_nothing(spark, tmp_path):
    """Two rounds of files, the last commit taken back in between: every change once, the mirror right."""
    schema = spark.createDataFrame([], RAW).schema
    put = lambda n, lo: spark.createDataFrame([message(f'{{"id": {i % 4}}}', f'{{"id": {i % 4}, "v": {i}, "__op": "u"}}', i) for i in range(lo, lo + 10)], RAW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = Versions(spark, str(tmp_path / "mirror"))

    def run(name, writer):
        s = ch.decode(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), ["id", "v"])
        q = s.writeStream.foreachBatch(writer).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
        q.awaitTermination()

    put(0, 0)
    for again in range(2):
        run("log", ch.write_changelog(str(tmp_path / "log"), "g"))
        run("mirror", ch.write_mirror(table, ["id"], "g"))
        if not again:
            for name in ("log", "mirror"):
                last = max((tmp_path / f"cp-{name}" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
                last.unlink()
                (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
            put(1, 10)
    log = spark.read.parquet(str(tmp_path / "log" / "generation=g" / "epoch=*"))
    assert (log.count(), log.select("_offset").distinct().count()) == (20, 20)
    assert rows(table.read(), "id", "v") == [("0", "16"), ("1", "17"), ("2", "18"), ("3", "19")]


def test_propagation_replays_nothing(spark, tmp_path):
    """An epoch that comes again adds no row, and what is built behind the vault is built again."""
    rows = lambda ids: spark.createDataFrame([(str(i), f"v{i}", "u", datetime(2026, 1, 1, 0, i), f"{i:04d}") for i in ids], "id string, v string, _op string, _load_ts timestamp, _batch_id string")
    tables = {n: Versions(spark, str(tmp_path / n)) for n in ("hub_x", "sat_x", "sat_x_status")}
    built = []
    write = ch.propagate(tables, "src", {"hub": ("x", ["id"]), "satellites": {"x": ["v"]}, "track_deletes": True}, "g", lambda added, epoch: built.append((epoch, added["hub_x"].count())), compact_every=2)
    for epoch, ids in ((0, (1, 2)), (0, (1, 2)), (1, (2, 3)), (1, (2, 3))):
        write(rows(ids), epoch)
    assert built == [(0, 2), (0, 2), (1, 1), (1, 1)]  # the rows an epoch added, a replayed one too
    assert [tables[n].read().count() for n in tables] == [3, 3, 3]


def test_propagation_takes_what_the_vault_reads(spark, tmp_path):
    """A column that no table of the vault has is neither held nor computed."""
    rows = spark.createDataFrame([("1", "a", "u", datetime(2026, 1, 1), "0")], "id string, v string, _op string, _load_ts timestamp, _batch_id string")
    tables = {n: Versions(spark, str(tmp_path / n)) for n in ("hub_x", "sat_x", "sat_x_status")}
    write = ch.propagate(tables, "src", {"hub": ("x", ["id"]), "satellites": {"x": ["v"]}, "track_deletes": True}, "g")
    write(rows.withColumn("other", F.raise_error(F.concat("id", F.lit(" was read")))), 0)
    assert [tables[n].read().count() for n in tables] == [1, 1, 1]


def test_objects_begin_as_one(spark):
    texts = {"{}": True, ' \t{"a": 1}': True, '{"a": 1, "a": 2}': True, "{'a': 1}": True, '{"a": {"b": [1]}}': True, "[1]": False, '[{"a": 1}]': False, '"{"': False, "1": False, "null": False, "": False, "{": False, '{"a": 1,}': False, None: False}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ch.is_object(F.col("t")).alias("o")).collect()
    assert {r.t: r.o for r in got} == texts


def test_landed_files_grow_in_number(spark, monkeypatch):
    """An epoch is a third of the files: as many as the cluster has cores, and no file grows with the table."""
    from strata.queries import stream_queries as sq

    monkeypatch.setattr(sq, "FILE_ROWS", 20)
    folder, files = sq._landed(spark, "/root/testdata/sf0.001")
    seen = spark.read.parquet(f"{folder}/in").groupBy(F.input_file_name().alias("f")).count().collect()
    assert files >= spark.sparkContext.defaultParallelism and files > 4 and len(seen) == 3 * files and max(r["count"] for r in seen) <= 40
    assert sum(r["count"] for r in seen) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    epochs = []
    ch.start(sq._stream(spark, folder, files), lambda batch, epoch: epochs.append((batch.agg(F.min("offset"), F.max("offset")).first())), f"{folder}/cp").awaitTermination()
    assert len(epochs) == 3 and all(a[1] < b[0] for a, b in zip(epochs, epochs[1:]))


def test_mirror_refuses_lossy_values(spark, tmp_path):
    table, kinds = Versions(spark, str(tmp_path / "m")), T.StructType().add("id", "long").add("v", "integer")
    put = ch.write_mirror(table, ["id"], "g", kinds)
    rows = lambda v: spark.createDataFrame([("7", v, "u", None, "0:1", 0, 1, ["id"])], "id string, v string, _op string, _source_ts timestamp, _offset string, _partition int, _offset_no long, _key array<string>")
    put(rows("5"), 0)
    with pytest.raises(Exception, match="not a int"):
        put(rows("five"), 1)
    assert dict(table.read().dtypes)["v"] == "int" and rows_of(table) == [(7, 5)] and table.latest() == 0


def rows_of(table):
    return rows(table.read(), "id", "v")


def test_bounds_and_series(spark, tmp_path):
    spark.range(10).repartition(5).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = ch.bounded(spark.readStream.schema("id long"), "file", 2).parquet(str(tmp_path / "in"))
    ch.start(stream, lambda batch, epoch: seen.append((epoch, batch.count())), str(tmp_path / "cp")).awaitTermination()
    files_ = len(list((tmp_path / "in").glob("*.parquet")))
    assert files_ > 2 and len(seen) == -(-files_ // 2) and sum(n for _, n in seen) == 10
    roll = spark.createDataFrame([("a", datetime(2026, 1, 1, 0, m), m) for m in range(10)] + [("b", datetime(2026, 1, 1, 0, 9), 1)], "stream string, minute timestamp, records int")
    assert [r.records for r in ch.series(roll, "a", datetime(2026, 1, 1, 0, 8), 3).collect()] == [6, 7, 8]


def test_large_files_are_read_in_buffers(spark, tmp_path):
    """A sparse file of 3 GB has its digest, in a worker that holds a buffer."""
    import hashlib

    big = tmp_path / "big.bin"
    with open(big, "wb") as f:
        f.truncate(3 << 30)
        f.seek(1 << 30)
        f.write(b"x")
    (tmp_path / "small.bin").write_bytes(b"abc")
    got = {r.path.rpartition("/")[2]: r.sha256 for r in files.digests(files.listing(spark, str(tmp_path / "*.bin"))).collect()}
    with open(big, "rb") as f:
        assert got == {"big.bin": hashlib.file_digest(f, "sha256").hexdigest(), "small.bin": hashlib.sha256(b"abc").hexdigest()}


def test_json_documents_are_bounded(spark, tmp_path, monkeypatch):
    """No document holds more than its share of the events, and none is sent to the driver as a range's bound."""
    from strata.queries import table_queries as tq

    events = spark.range(4000).selectExpr("id as event_id", "id % 7 as user_id", "'view' as event_type", "1.5 as value", "timestamp_ntz '2024-01-01 05:00:00' as ts")
    events.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(tq, "DOCUMENT_EVENTS", 500)
    monkeypatch.setattr(tq, "_folder", lambda s, name: str(tmp_path / name))
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", lambda *a: pytest.fail("values as bounds"))
    assert rows(tq.json_documents(spark, str(tmp_path)), "event_id", "user_id", "event_type") == [(k, k % 7, "view") for k in range(4000)]
    assert max(map(len, (r.value.split('"event_id"') for r in spark.read.text(str(tmp_path / "documents/events.json"), wholetext=True).collect()))) < 800


def test_serving_from_a_shared_folder(spark, tmp_path):
    url, frame = f"versions:{tmp_path}/serving", lambda rows, kinds="id int, v string": spark.createDataFrame(rows, kinds)
    read = lambda: rows(serving.served(spark, url, "t"))
    assert serving.serve(frame([(1, "a"), (2, "b")]), frame([(9, "x")]), url, "t", ["id"]) == "replace" and read() == [(1, "a"), (2, "b")]
    assert serving.serve(frame([(7, "n")]), frame([(2, "z"), (3, "c")]), url, "t", ["id"]) == "upsert" and read() == [(1, "a"), (2, "z"), (3, "c")]
    with pytest.raises(ValueError, match="duplicate key"):
        serving.serve(frame([(7, "n")]), frame([(9, "x"), (9, "y")]), url, "t", ["id"])
    assert read() == [(1, "a"), (2, "z"), (3, "c")]
    wide = frame([(7, 1.5)], "id int, w double")
    assert serving.serve(wide, wide, url, "t", ["id"]) == "replace" and read() == [(7, 1.5)]


def test_serving_upsert_on_a_cluster(spark, monkeypatch):
    """Executors that don't share the driver's memory, and no database: the rows are those of a local session."""
    from strata.queries.vault_queries import serving_upsert

    data = "/root/testdata/sf0.001"
    want = rows(serving_upsert(spark, data))
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    assert want and rows(serving_upsert(spark, data)) == want


def test_equal_rows_are_equal_files(spark, tmp_path):
    from strata.queries.table_queries import _one_file

    there, back = spark.range(1000).selectExpr("id", "id % 3 as k").orderBy("id"), spark.range(1000).selectExpr("id", "id % 3 as k").orderBy(F.desc("id"))
    _one_file(there, str(tmp_path / "0"))
    _one_file(back, str(tmp_path / "1"))
    assert files.digests(files.listing(spark, str(tmp_path / "*/*.json"))).select("sha256").distinct().count() == 1
