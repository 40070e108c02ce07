"""Versioned tables: exclusive commits, dead and racing writers, upserts that follow what changed, compaction."""

import random
from pathlib import Path

import pytest

from strata.operators import versions as vs
from strata.operators.tables import merge
from strata.plans.pipeline import maintain
from strata.streaming import changes as ch


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def frame(spark, data, kinds="k int, v string"):
    return spark.createDataFrame(data, kinds)


def test_commit_once_and_travel(spark, tmp_path):
    v = vs.Versions(spark, str(tmp_path / "t"))
    assert v.latest() is None and v.history().count() == 0
    with pytest.raises(ValueError):
        v.read()
    assert v.write(spark.range(3).toDF("x"), "a") == 0 and v.write(spark.range(9).toDF("x"), "a") == 0
    assert v.write(spark.range(5).toDF("x"), "b") == 1
    assert (v.read().count(), v.read(0).count(), v.stats().first().rows, v.history().count()) == (5, 3, 5, 2)
    assert v.compact() == 2 and v.compact() is None
    assert v.read().count() == 5 and v.stats().first().files == 1
    with pytest.raises(ValueError):
        v.read(7)


def test_append_merges_columns(spark, tmp_path):
    v = vs.Versions(spark, str(tmp_path / "t"))
    one = frame(spark, [(1, "a")])
    assert v.append(one, "x") == 0 and v.append(one, "x") == 0 and v.append(one.limit(0), "y") == 0
    assert v.append(frame(spark, [(2, 5)], "k int, w int"), "z") == 1
    assert rows(v.read(), "k", "v", "w") == [(1, "a", None), (2, None, 5)]
    with pytest.raises(Exception, match="not a int"):
        v.append(frame(spark, [("x",)], "k string"))
    assert v.latest() == 1 and rows(v.read(0)) == [(1, "a")]


def kill(*_):
    raise KeyboardInterrupt


@pytest.mark.parametrize("point", ["_store", "put", "_linked", "after"])
def test_a_writer_that_dies(spark, tmp_path, monkeypatch, point):
    """Wherever it dies, the next writers go on, and the write counts once or not at all."""
    v = vs.Versions(spark, str(tmp_path / "t"))
    v.append(frame(spark, [(1, "a")]), ("w", 0))
    with monkeypatch.context() as m:
        if point == "_store":
            m.setattr(vs.Versions, "_store", lambda *a: kill())
        elif point == "after":
            done = vs.Log.put
            m.setattr(vs.Log, "put", lambda self, *a: done(self, *a) and kill())
        else:
            m.setattr(vs.Log, point, kill)
        with pytest.raises(KeyboardInterrupt):
            v.append(frame(spark, [(2, "b")]), ("w", 1))
    for name in ("_half", "00000000000000000009.json.tmp"):  # what a killed process leaves
        (Path(tmp_path) / "t" / "_log" / name).write_text("")
    fresh = vs.Versions(spark, str(tmp_path / "t"))
    assert fresh.append(frame(spark, [(2, "b")]), ("w", 1)) == 1
    assert fresh.append(frame(spark, [(3, "c")]), ("w", 2)) == 2
    assert fresh.upsert(frame(spark, [(3, "d")]), ["k"], txn=("m", 0)) == 3
    assert rows(fresh.read()) == [(1, "a"), (2, "b"), (3, "d")] == rows(v.read())


@pytest.mark.parametrize("how", ["append", "upsert", "write"])
def test_two_attempts_of_an_epoch(spark, tmp_path, monkeypatch, how):
    """A second attempt commits between the first one's writing and its commit: the epoch is in once."""
    path = str(tmp_path / "t")
    first, second = vs.Versions(spark, path), vs.Versions(spark, path)
    first.append(frame(spark, [(0, "z")]), ("g", 0))
    act = {"append": lambda t: t.append(frame(spark, [(10, "x"), (11, "y")]), ("g", 1)), "upsert": lambda t: t.upsert(frame(spark, [(10, "x"), (None, "n")]), ["k"], txn=("g", 1)), "write": lambda t: t.write(frame(spark, [(5, "w")]), ("g", 1))}[how]
    store, raced = vs.Versions._store, []

    def late(self, *a):
        part = store(self, *a)
        if self is first and not raced:
            raced.append(act(second))
        return part

    monkeypatch.setattr(vs.Versions, "_store", late)
    assert act(first) == raced[0] == 1 and first.latest() == 1
    assert rows(first.read()) == {"append": [(0, "z"), (10, "x"), (11, "y")], "upsert": [(0, "z"), (10, "x"), (None, "n")], "write": [(5, "w")]}[how]


def test_many_writers_make_every_version_once(spark, tmp_path):
    """Writers that don't know of each other, each with a number already taken."""
    path = str(tmp_path / "t")
    writers = [vs.Versions(spark, path) for _ in range(4)]
    made = [writers[i % 4].append(frame(spark, [(i, "a")]), (f"w{i % 4}", i)) for i in range(2 * vs.Log.EVERY + 3)]
    assert made == list(range(len(made))) and writers[0].log.states() == [0, vs.Log.EVERY, 2 * vs.Log.EVERY]
    fresh = vs.Versions(spark, path)
    assert fresh.latest() == made[-1] and rows(fresh.read(), "k") == sorted(((i,) for i in made), key=str) and fresh.read(vs.Log.EVERY + 2).count() == vs.Log.EVERY + 3
    assert fresh.append(frame(spark, [(0, "a")]), ("w1", 5)) == max(i for i in made if i % 4 == 1)  # an older write of one that went on


def test_publishing_by_rename(spark, tmp_path):
    log = vs.Log(spark, str(tmp_path / "l"))
    for n, text in (("_a", "one"), ("_b", "two")):
        out = log.fs.create(log.at(n), True)
        out.write(text.encode())
        out.close()
    assert log._renamed(log.at("_a"), log.at("x.json")) and not log._renamed(log.at("_b"), log.at("x.json"))
    assert (tmp_path / "l" / "x.json").read_text() == "one"


def bytes_of(v, version):
    return sum(p["bytes"] for p in v.log.read(version)["add"])


def test_an_upsert_writes_what_changed(spark, tmp_path):
    """Bytes of an epoch follow the batch, whatever the table holds; it starts from a full load."""
    v = vs.Versions(spark, str(tmp_path / "t"))
    v.write(spark.range(200_000).selectExpr("cast(id as int) as k", "sha1(cast(id as string)) as v"), keys=["k"])
    v.upsert(frame(spark, [(7, "x"), (300_000, "y")]), ["k"])
    v.upsert(frame(spark, [(7, "z", False), (8, "", True), (9_999_999, "", True)], "k int, v string, gone boolean"), ["k"], "gone")
    assert bytes_of(v, 0) > 5_000_000 and max(bytes_of(v, 1), bytes_of(v, 2)) < 20_000
    assert v.read().count() == 200_000 and rows(v.read().where("k in (7, 8, 300000)")) == [(300000, "y"), (7, "z")]
    assert v.read(1).count() == 200_001 and v.stats().first().rows == 200_000
    with pytest.raises(ValueError):
        v.upsert(frame(spark, [(7, "x")]), ["v"])


def test_deltas_apart_from_a_part_are_not_joined(spark, tmp_path):
    v = vs.Versions(spark, str(tmp_path / "t"))
    v.write(spark.range(100).selectExpr("cast(id as int) as k", "'a' as v"), keys=["k"])
    v.append(spark.range(500, 600).selectExpr("cast(id as int) as k", "'b' as v"))
    v.upsert(frame(spark, [(550, "c")]), ["k"])
    plan = v.read()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1 and v.read().count() == 200


@pytest.mark.parametrize("seed", range(2))
def test_any_order_of_writes_against_merge(spark, tmp_path, seed):
    """Full loads, appends, upserts with and without all columns, deletes, null keys and compactions, against whole-table merges."""
    rng = random.Random(seed)
    v, held = vs.Versions(spark, str(tmp_path / "t")), None
    key = lambda: rng.choice([None, *range(12)])
    for step in range(14):
        do = rng.choice(["write", "append", "upsert", "upsert", "delete", "narrow", "compact", "fold"]) if step else rng.choice(["write", "upsert"])
        some = {key(): f"s{step}" for _ in range(rng.randint(1, 5))}
        batch = frame(spark, [(k, x, step) for k, x in some.items()], "k int, v string, w int")
        if do == "write":
            v.write(batch, keys=["k"])
            held = batch
        elif do == "append":
            batch = frame(spark, [(100 + step * 10 + i, "a", step) for i in range(3)], "k int, v string, w int")
            v.append(batch)
            held = held.unionByName(batch)
        elif do == "upsert":
            v.upsert(batch, ["k"])
            held = merge(held, batch, ["k"])
        elif do == "delete":
            flagged = batch.selectExpr("*", "k % 2 = 0 as gone")
            v.upsert(flagged, ["k"], "gone")
            held = merge(held, flagged, ["k"], "gone")
        elif do == "narrow":
            v.upsert(batch.select("k", "v"), ["k"])
            held = merge(held, batch.select("k", "v"), ["k"])
        else:
            v.compact(fold=0.0 if do == "fold" else 1e9, file_bytes=rng.choice([1, 1 << 20]))
        held = spark.createDataFrame(held.select("k", "v", "w").collect(), "k int, v string, w int")
        assert rows(v.read(), "k", "v", "w") == rows(held), (seed, step, do)
    assert rows(vs.Versions(spark, v.path).read(), "k", "v", "w") == rows(held)


def test_compaction_replaces_small_parts_only(spark, tmp_path):
    v = vs.Versions(spark, str(tmp_path / "t"))
    v.write(spark.range(100_000).selectExpr("cast(id as int) as k", "sha1(cast(id as string)) as v").coalesce(1), keys=["k"])
    (big,) = v._state().parts
    for i in range(5):
        v.append(frame(spark, [(1_000_000 + i, "s")]))
    v.upsert(frame(spark, [(1, "u")]), ["k"])
    v.upsert(frame(spark, [(1, "w"), (1_000_002, "w")]), ["k"])
    before = rows(v.read().where("k < 3 or k >= 1000000"))
    assert v.compact(file_bytes=1 << 20) == 8
    parts = v._state().parts
    assert big in parts and sorted(p["kind"] for p in parts) == ["base", "base", "delta"]
    assert rows(v.read().where("k < 3 or k >= 1000000")) == before and v.read().count() == 100_005
    v.upsert(frame(spark, [(1, "x"), (1_000_003, "x")]), ["k"])
    assert rows(v.read().where("v = 'x'"), "k") == [(1,), (1_000_003,)] and v.read().count() == 100_005


def test_compaction_beside_another_writer(spark, tmp_path, monkeypatch):
    """An upsert that comes in between is kept; a full load makes it a conflict, and nothing is left behind."""
    path = str(tmp_path / "t")
    v, other = vs.Versions(spark, path), vs.Versions(spark, path)
    for i in range(3):
        v.append(frame(spark, [(i, "a")]))
    store, todo = vs.Versions._store, [lambda: other.upsert(frame(spark, [(1, "b")]), ["k"]), lambda: other.write(frame(spark, [(9, "n")]))]

    def late(self, *a):
        part = store(self, *a)
        if self is v and todo:
            todo.pop(0)()
        return part

    monkeypatch.setattr(vs.Versions, "_store", late)
    assert v.compact() == 4 and rows(v.read()) == [(0, "a"), (1, "b"), (2, "a")]
    with pytest.raises(vs.Conflict):
        v.compact(fold=0.0)
    assert rows(v.read()) == [(9, "n")]


def test_a_mirror_from_a_snapshot(spark, tmp_path):
    """Snapshot, changes, compaction, changes again; each epoch twice."""
    v = vs.Versions(spark, str(tmp_path / "m"))
    v.write(frame(spark, [(str(i), "old") for i in range(6)], "id string, v string"))
    write = ch.write_mirror(v, ["id"], "g", compact_every=2)
    kinds = "id string, v string, _op string, _source_ts timestamp, _offset string, _partition int, _offset_no long, _key array<string>"
    for epoch, some in enumerate([[("1", "a", "u"), ("1", "b", "u"), ("2", None, "d")], [("7", "c", "c"), ("3", "d", "u")], [("1", None, "d"), ("2", "e", "c")], [("7", "f", "u")]]):
        for _ in range(2):
            write(spark.createDataFrame([(*x, None, f"0:{i}", 0, i + 10 * epoch, ["id"]) for i, x in enumerate(some)], kinds), epoch)
    assert rows(v.read(), "id", "v") == [("0", "old"), ("2", "e"), ("3", "d"), ("4", "old"), ("5", "old"), ("7", "f")]


def test_an_aggregate_kept_up_to_date(spark, tmp_path):
    """After every epoch it equals one over all rows; a replayed epoch gives the same rows before and after."""
    v, all_rows = vs.Versions(spark, str(tmp_path / "a")), []
    total = lambda df: df.groupBy("k").sum("n").toDF("k", "n")
    for epoch, some in enumerate([[("a", 1), ("b", 2)], [("a", 5)], [], [("c", 1), ("b", 1)]]):
        added = total(spark.createDataFrame(some, "k string, n long"))
        once, again = ([rows(f) for f in maintain(v, added, ["k"], total, ("g", epoch))] for _ in range(2))
        all_rows += some
        assert once == again and [k for k, _ in once[1]] == sorted({k for k, _ in some})
        assert rows(v.read()) == rows(total(spark.createDataFrame(all_rows, "k string, n long")))
