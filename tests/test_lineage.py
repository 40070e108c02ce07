"""The lineage queries over whole tables against brute force, on rows beyond the ids that the queries on a cut keep."""

import datetime

import pytest

from strata import registry
from strata.operators import lineage as lin

LINES = [(1, 1, 1), (1, 50, 9), (500, 2, 3), (500, 77, 4), (501, 90, 9), (7, 3, 5), (7, 60, 6)]  # order, part, supplier
ORDERS = [(3, 1, "O"), (401, 1, "F"), (900, 8, "O"), (901, 6, "F"), (902, 5, "P"), (3000, 13, "O")]  # order, customer, status


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("lineage"))
    spark.createDataFrame(LINES, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{d}/lineitem.parquet")
    day = datetime.date(1995, 1, 1)
    spark.createDataFrame([(*o, day) for o in ORDERS], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date").write.parquet(f"{d}/orders.parquet")
    return lambda name: sorted(tuple(r) for r in registry.queries()[name](spark, d).collect())


def graph():
    return {(f"p|{p}", f"o|{o}", "j1") for o, p, _ in LINES} | {(f"o|{o}", f"s|{s}", "j2") for o, _, s in LINES}


def near(start):
    """Node -> steps downstream."""
    seen = dict.fromkeys(start, 0)
    for step in (1, 2):
        for a, b, _ in graph():
            if seen.get(a) == step - 1:
                seen.setdefault(b, step)
    return seen


def test_whole_graph(run):
    assert run("lineage_trace") == sorted(near(["p|1", "p|2"]).items())
    nodes = near(["p|3"])
    assert run("lineage_subgraph") == sorted(e for e in graph() if e[0] in nodes and e[1] in nodes)
    shown = run("restricted_graph")
    assert len(shown) == len(graph()) and {e for e in graph() if "o|1" not in e[:2] and "o|501" not in e[:2]} == {e for e in shown if "restricted:" not in e[0] + e[1]}


def test_whole_events(run):
    done = [(o, c) for o, c, status in ORDERS if status != "P"]
    edges = {(f"dataset:{x}", f"job:load-{c % 7}", f"load-{c % 7}") for _, c in done for x in ("raw", f"ref{c % 2}")} | {(f"job:load-{c % 7}", f"dataset:t{c % 4}", f"load-{c % 7}") for _, c in done}
    assert run("lineage_edges") == sorted(edges)
    last = {(f"load-{c % 7}", f"t{c % 4}"): f"c{o % 3}" for o, c in sorted(done)}  # one day: the later order is the later event
    first = {}
    for (job, t), column in last.items():
        for x in (column, "rate"):
            first[x, t] = min(job, first.get((x, t), job))
    assert run("lineage_column_edges") == sorted(("raw", x, t, "price", job) for (x, t), job in first.items())
    tables = {t for x, t in first if x == "rate"}
    jobs = {job for (_, t), job in first.items() if t in tables}
    assert run("lineage_impact") == sorted([("column", f"{t}|price") for t in tables] + [("dataset", t) for t in tables] + [("job", j) for j in jobs] + ([("app", "board")] if tables & {"t0", "t1"} else []))


def test_marks_go_downstream_once(spark):
    """Diamonds and cycles: every mark at the shortest distance; suggestions don't count; scores fall to the weakest source."""
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "b"), ("x", "e")], "source string, target string")
    marks = spark.createDataFrame([("a", "m"), ("c", "m"), ("x", "n"), ("x", "n"), ("z", "q")], "node string, mark string")
    got = sorted(map(tuple, lin.propagated(edges, marks).collect()))
    assert got == sorted([("a", "m", 0), ("c", "m", 0), ("b", "m", 1), ("d", "m", 1), ("e", "m", 2), ("x", "n", 0), ("e", "n", 1), ("b", "n", 2), ("d", "n", 3), ("z", "q", 0)])
    nodes = spark.createDataFrame([(n,) for n in "abcdex"], "node string")
    tags = spark.createDataFrame([("a", "pii", "active"), ("d", "pii", "active"), ("b", "no", "rejected")], "node string, tag string, status string")
    scores = spark.createDataFrame([("a", 90.0), ("x", 40.0), ("d", 99.0), ("c", None)], "node string, score double")
    out = {r.node: (r.tags, r.inherited, r.score, r.weakest) for r in lin.governed(edges, nodes, tags, scores).collect()}
    assert out["a"] == (["pii"], [], 90.0, 90.0) and out["x"] == ([], [], 40.0, 40.0) and out["c"] == ([], ["pii"], None, 90.0)
    assert out["d"] == (["pii"], [], 99.0, 40.0) and out["e"] == ([], ["pii"], None, 40.0)


def test_apps_in_table_edges_and_impact(spark):
    events = spark.createDataFrame([("2026-01-01 00:00:00", "COMPLETE", "j", ["in"], [("out",)]), ("2026-01-02 00:00:00", "START", "k", ["out"], [("more",)])], "event_time string, kind string, job string, inputs array<string>, outputs array<struct<name:string>>")
    apps = spark.createDataFrame([("report", "out"), ("report", "out"), ("lost", None)], "app string, dataset string")
    edges = lin.table_edges(events, apps=apps)
    assert sorted((r.source, r.target) for r in edges.collect()) == [("dataset:in", "job:j"), ("dataset:out", "app:report"), ("job:j", "dataset:out")]
    assert sorted((r.kind, r.name, r.distance) for r in lin.dataset_impact(edges, "dataset:in").collect()) == [("app", "report", 3), ("dataset", "out", 2), ("job", "j", 1)]
