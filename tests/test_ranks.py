"""Ranks in groups, without any group's rows in one array."""

import random
from datetime import datetime

from strata.operators import lineage as lin
from strata.streaming import changes as ch


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_latency(spark):
    rng = random.Random(2)
    rows = [(b, rng.choice([None, -5, rng.randrange(400)])) for b, n in ((0, 1), (1, 2), (2, 21), (3, 500), (None, 40)) for _ in range(n)]
    df = ch.latency(spark.createDataFrame(rows, "batch long, latency_ms long"))
    assert "collect_list" not in plan(df) and "percentile" not in plan(df)
    for r in df.collect():
        v = sorted(max(x or 0, 0) for b, x in rows if b == r.batch)
        n = len(v)
        assert (r.records, r.p50, r.p95) == (n, (v[(n - 1) // 2] + v[n // 2]) // 2, v[max(int(0.95 * n) - 1, 0)])
    assert df.count() == 5


def test_run_summary(spark):
    rng = random.Random(3)
    rows = [(datetime(2026, 1, 1, h, rng.randrange(60)), rng.choice(["failed", "ok"]), rng.choice([None, rng.randrange(50) / 4]) if h else None) for h, n in ((0, 3), (1, 2), (3, 300)) for _ in range(n)]
    df = lin.run_summary(spark.createDataFrame(rows, "at timestamp, status string, seconds double"), "2026-01-01 00:00:00", "2026-01-01 03:59:59")
    assert "collect_list" not in plan(df)
    for r in df.collect():
        own = [x for x in rows if x[0].hour == r.bucket.hour]
        v = sorted(x[2] for x in own if x[2] is not None)
        assert (r.runs, r.failed, r.p50, r.longest) == (len(own), sum(x[1] == "failed" for x in own), v[len(v) // 2] if v else None, v[-1] if v else None)
    assert df.count() == 4
