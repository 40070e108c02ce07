import pytest
from pyspark.sql import functions as F

from strata.llm import urls


@pytest.mark.parametrize("segment_bits", [urls.SEGMENT_BITS, 128])
def test_cascade_is_exact_for_the_universe(spark, segment_bits):
    """Whatever the number of segments of a level."""
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    c = urls.Cascade(keys.unionByName(keys.where("listed")), bits_per_key=2, segment_bits=segment_bits)
    assert len(c.levels) > 2 and (c.levels[0].segments > 1) == (segment_bits == 128)
    got = c.flag(keys.drop("listed"), "key", "out").collect()
    assert len(got) == 3000 and all(r.out == (int(r.key[1:]) % 7 == 0) for r in got)


def test_hosts_are_listed_by_all_their_pages(spark):
    rows = [(k, f"http://{h}/x", html) for k, (h, html) in enumerate([("a.b", "<p>Casino</p>")] + [("a.b", "x")] * 4 + [("c.d", "casino")] + [("c.d", None)] * 5 + [("e.f", "casinos")])]
    got = {r.host: r.listed for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {"a.b": True, "c.d": False, "e.f": False}


def test_rules_and_edges(spark):
    rows = [
        ("http://EXAMPLE.org/es/x", "example.org", "/es/x", "example.org/es/", "block"),
        ("http://a.example.org/en/12?q#f", "a.example.org", "/en/12", "example.org/en/1", "block"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://x.org", "x.org", "", None, "allow"),
        ("http://free-bets.net/a", "free-bets.net", "/a", None, "block"),
        ("http://bets.x.com/de/?u=http://y.org/", "bets.x.com", "/de/", "com/de/", "block"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("x://h?a/b", "h", "", None, "allow"),
        ("http://h.net/" + "a" * 300_000, "h.net", "/" + "a" * 300_000, None, "allow"),
    ]
    df = spark.createDataFrame([(i, r[0], "c", None) for i, r in enumerate(rows + rows[:1])], "page_id long, url string, host string, html string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert len(got) == len(rows) + 1
    for i, r in enumerate(rows):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == r[1:]
    assert urls.judge(df.limit(0)).collect() == []


def test_very_long_and_odd_html(spark):
    """A listed word at the end of 3 MB of html counts; so do null urls and pages, and other columns don't matter."""
    rows = [(1, "http://long.example/a", "<p>" + "word " * 600_000 + "casino</p>", "x"), (2, "http://short.example/a", "<p>casino</p>", "x"), (3, None, "casino", "x"), (4, "http://none.example/", None, "x"), (4, "http://none.example/", None, "x")]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert got[1] == got[2] and got[4] == "allow"
