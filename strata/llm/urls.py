"""URL filters: host and path rules, then exact membership in a listed set by a Bloom filter cascade.

A host is listed by what all its pages show together: one of `LISTED` words is a part of its name, or stands in the html
of at least one page in `LEAST_PAGES`. So the list comes from the corpus, and the cascade tells it to every page.

Level 1 encodes the listed keys, level 2 the universe's unlisted keys that pass level 1, level 3 the listed
keys that pass level 2, and so on until none is left over. A key is listed when the first level it fails is
an even one (a key that passes all levels: when the number of levels is odd). This is exact for every key of
the universe, which must hold all keys that are asked for. A level is bit arrays of at most `SEGMENT_BITS` (1 MB): a key
belongs to one of them by its hash. Each is one row, read through a scalar subquery, so asking costs no join and no
shuffle at any size: `BITS_PER_KEY` to twice as many bits a listed key.

Null urls have an empty host and path, which aren't listed. Repeated rows are judged each by itself; an empty table gives
no row; very long urls and htmls are read whole; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import LOWER, UPPER, cut, table

BITS_PER_KEY, HASHES, SEGMENT_BITS = 12, 4, 1 << 23

#: Fixed values: (verdict, host, path) rules of the query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Words that list a host: as a part of its name between dots and hyphens, or between other characters than a-z in the
#: html of at least one in LEAST_PAGES of its pages.
LISTED, LEAST_PAGES = ("adult", "bets", "casino", "spam"), 5


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null. `rules` is a short configured list."""
    if not rules:
        return F.lit(None).cast("struct<size: int, rule: string, verdict: string>")
    tried = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.array_max(F.array(*tried))


def _bits(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(16 * level + i)), F.lit(bits)) for i in range(HASHES)]


class Level:
    """The keys of a frame as bit arrays; `rows` has one row (segment, words) each."""

    def __init__(self, keys: DataFrame, number: int, count: int, bits_per_key: int, segment_bits: int):
        self.number, self.segments = number, -(-count * bits_per_key // segment_bits)
        self.bits = 64
        while self.bits < -(-count * bits_per_key // self.segments):
            self.bits *= 2
        each = F.explode(F.array(*_bits(F.col("key"), number, self.bits))).alias("at")
        at = keys.select(self.segment(F.col("key")).alias("segment"), each)
        own = at.groupBy("segment", F.shiftright("at", 6).alias("id")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("w"))
        size = self.bits // 64
        none = keys.sparkSession.range(self.segments * size).select(F.floor(F.col("id") / size).alias("segment"), (F.col("id") % size).alias("id"), F.expr("0L").alias("w"))
        dense = own.unionByName(none).groupBy("segment", "id").agg(F.expr("bit_or(w)").alias("w"))
        words = F.transform(F.array_sort(F.collect_list(F.struct("id", "w"))), lambda x: x["w"])  # one segment's, 1 MB at most
        self.rows = cut(dense.groupBy("segment").agg(words.alias("words")))

    def segment(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(16 * self.number + HASHES)), F.lit(self.segments)).cast("long")

    def passes(self, key: Column) -> Column:
        own = [self.rows.where(F.col("segment") == s).select("words").scalar() for s in range(self.segments)]
        words = own[-1]
        for s in range(self.segments - 2, -1, -1):
            words = F.when(self.segment(key) == s, own[s]).otherwise(words)
        test = F.lit(True)
        for at in _bits(key, self.number, self.bits):
            word = F.element_at(words, (F.shiftright(at, 6) + 1).cast("int"))
            test = test & (F.expr("1L") == F.getbit(word, (at % 64).cast("int")))
        return test


class Cascade:
    """Exact membership for the keys of a universe."""

    def __init__(self, keys: DataFrame, bits_per_key: int = BITS_PER_KEY, segment_bits: int = SEGMENT_BITS):
        """keys: key string, listed boolean; the complete universe, repeats allowed (listed once is listed)."""
        self.levels: list[Level] = []
        keys = cut(keys.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("listed").alias("listed")))
        inside, outside = keys.where("listed"), keys.where("not listed")
        while n := inside.count():
            level = Level(inside, len(self.levels) + 1, n, bits_per_key, segment_bits)
            self.levels.append(level)
            inside, outside = cut(outside.where(level.passes(F.col("key")))), inside

    def contains(self, key: Column) -> Column:
        """Whether the key is listed. Only for keys of the universe."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(level.passes(key), out).otherwise(F.lit(level.number % 2 == 0))
        return out

    def flag(self, df: DataFrame, key: str, out: str) -> DataFrame:
        """df and a boolean column `out`; a null key is not listed."""
        return df.withColumn(out, F.coalesce(self.contains(F.col(key)), F.lit(False)))


def listed_hosts(pages: DataFrame, words=LISTED, least: int = LEAST_PAGES) -> DataFrame:
    """key, listed of every host of pages (host, html)."""
    named = F.arrays_overlap(F.split("host", r"[.-]"), F.array(*map(F.lit, words)))
    text = F.translate(F.coalesce("html", F.lit("")), UPPER, LOWER)
    shown = text.rlike(f"(^|[^a-z])({'|'.join(words)})([^a-z]|$)")
    by = pages.groupBy(F.col("host").alias("key")).agg(F.max(named).alias("named"), F.count_if(shown).alias("shown"), F.count("*").alias("n"))
    return by.select("key", ((F.col("key") != "") & (F.col("named") | (F.col("shown") * least >= F.col("n")))).alias("listed"))


def judge(pages: DataFrame, rules=RULES, words=LISTED, least: int = LEAST_PAGES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed."""
    pages = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.col("html").cast("string").alias("html"))
    cascade = Cascade(listed_hosts(pages, words, least))
    judged = cascade.flag(pages.drop("html").withColumn("_r", rule(F.col("host"), F.col("path"), rules)), "host", "listed")
    own = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(F.col("_r.verdict"), own).alias("verdict"), "listed")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


ORACLE = r"""
with u as (select page_id, html, case when url is not null and contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, html, regexp_extract(rest, '^[^/?#]*') as raw, rest from u),
p as (select page_id, html, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
r(v, rh, rp) as (values ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
f as (select page_id, max_by(rh || rp, length(rh || rp)) as rule, max_by(v, length(rh || rp)) as v from p, r where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id),
s as (select host, host <> '' and (regexp_matches(host, '(^|[.-])(adult|bets|casino|spam)([.-]|$)') or 5 * count(*) filter (regexp_matches(translate(coalesce(html, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z])(adult|bets|casino|spam)([^a-z]|$)')) >= count(*)) as listed from p group by host),
l as (select p.page_id, p.host, path, listed from p join s using (host))
select l.page_id, host, path, rule, coalesce(v, case when listed then 'block' else 'allow' end) as verdict, listed from l left join f using (page_id)
"""
