"""Spelling variant grouping: words of a corpus that differ by one code point, found by search schemes on FM-indexes.

Words are counted over all texts. Two words of 2k or more code points that differ by one inserted, deleted or replaced
code point agree in their first k or in their last k code points, where 2k or 2k + 1 is the length of the shorter one.
So every word goes to the groups of its first and of its last k code points (k for its own length, and k for a partner
that is one shorter), and near words meet in a group. Groups are dealt by their key; those of more than `HOT` words are
dealt finer: the error is in what the group doesn't fix, and either the next part of that or its far end is free of it,
so two finer groups take the place of one. A pair belongs to the first group that it agrees in, and is counted there.

A task builds a bidirectional FM-index over runs of whole groups: the words, each behind a delimiter, as one text whose
rotations are sorted; the Burrows-Wheeler transforms of the text and of its reverse are wavelet matrices, by which an
interval of rotations that begin with a pattern is extended to either side by one code point, or by all that occur.
Every word is asked: one half is matched exactly, from the middle out to the delimiter, then the pattern grows to the
other side, once with another code point, one too many or one too few. When the second delimiter is reached, the
interval's place is the near word's number. A group beyond `BLOCK` words is indexed in parts, and asked of each.

A word's count and best near word leave a task as one row per word and run; no pair is written out.

Null texts have no word, whatever their doc_id; a null doc_id counts as an empty one. Repeated rows count again. Very
long texts and runs are taken whole. An empty table gives no row. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import LOWER, UPPER, release, stored, table

LEAST_CHARS, LEAST_COUNT, RATIO, NOISE = 6, 5, 5, 199
#: Words of a group that is dealt finer, words in one index, words asked together.
HOT, BLOCK, ASKED = 50_000, 40_000, 8_192
BITS = 7
#: Delimiter 0, a-z 1 to 26, U+00C0 to U+00FF 27 to 90.
_CODE = np.zeros(256, np.uint8)
_CODE[97:123], _CODE[192:256] = np.arange(1, 27), np.arange(27, 91)


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: lower-cased runs of letters, some with one code point deleted, of at least LEAST_CHARS and LEAST_COUNT."""
    run = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(rf"[A-Za-zÀ-ÿ]{{{LEAST_CHARS},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), run.alias("run"))
    runs = runs.select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run"))
    at = F.pmod(h, F.length("run")).cast("int")
    word = F.when(h % NOISE == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= LEAST_CHARS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _groups(words: DataFrame, hot: int) -> DataFrame:
    """word, n, kind, k, key: the groups of every word. kind: p or s for equal beginnings or ends; pa, pb, sa, sb for finer ones."""
    own = F.expr("""explode(flatten(transform(array_distinct(array(length(word) div 2, (length(word) - 1) div 2)), k -> if(k < 3, array(),
        array(named_struct('kind', 'p', 'k', k, 'key', substr(word, 1, k)), named_struct('kind', 's', 'k', k, 'key', substr(word, -k, k)))))))""")
    rows = words.select("word", "n", own.alias("g")).select("word", "n", "g.*")
    full = rows.groupBy("kind", "k", "key").count().where(F.col("count") > hot).select("kind", "k", "key", F.lit(True).alias("full"))
    finer = F.expr("""explode(case when full is null then array(named_struct('kind', kind, 'key', key)) when kind = 'p' then
        array(named_struct('kind', 'pa', 'key', substr(word, 1, k + k div 2)), named_struct('kind', 'pb', 'key', concat(key, '-', substr(word, -(k - k div 2), k)))) else
        array(named_struct('kind', 'sa', 'key', substr(word, -(k + k div 2), k + k div 2)), named_struct('kind', 'sb', 'key', concat(substr(word, 1, k - k div 2), '-', key))) end)""")
    return rows.join(full, ["kind", "k", "key"], "left").select("word", "n", "k", finer.alias("f")).select("word", "n", "f.kind", "k", "f.key")


class Wavelet:
    """A sequence of codes that answers, for a range: how often each code stands before it and in it, and how many smaller ones."""

    def __init__(self, codes: np.ndarray):
        self.zeros, self.first = [], []
        for b in range(BITS - 1, -1, -1):
            bit = (codes >> b) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(bit == 0)]).astype(np.int32))
            self.first.append(int(self.zeros[-1][-1]))
            codes = np.concatenate([codes[bit == 0], codes[bit == 1]])
        at = np.zeros(1 << BITS, np.int64)
        for b, zeros, first in zip(range(BITS - 1, -1, -1), self.zeros, self.first):
            bit, before = (np.arange(1 << BITS) >> b) & 1, zeros[at]
            at = np.where(bit == 1, first + at - before, before)
        self.begin = at

    def one(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often each range's code stands before the range's ends, and how many smaller codes the range has."""
        less = np.zeros(len(low), np.int64)
        for b, zeros, first in zip(range(BITS - 1, -1, -1), self.zeros, self.first):
            up, l0, h0 = (code >> b) & 1 == 1, zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            less += np.where(up, h0 - l0, 0)
            low, high = np.where(up, first + low - l0, l0), np.where(up, first + high - h0, h0)
        return low - self.begin[code], high - self.begin[code], less

    def all(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same for every code that a range has: the range's number, the code, and the three numbers."""
        source, code, less = np.arange(len(low)), np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        for zeros, first in zip(self.zeros, self.first):
            l0, h0 = zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            a, b = np.flatnonzero(h0 > l0), np.flatnonzero(high - h0 > low - l0)
            low, high = np.concatenate([l0[a], first + (low - l0)[b]]), np.concatenate([h0[a], first + (high - h0)[b]])
            less = np.concatenate([less[a], (less + h0 - l0)[b]])
            source, code = np.concatenate([source[a], source[b]]), np.concatenate([code[a] << 1, (code[b] << 1) + 1])
        return source, code, low - self.begin[code], high - self.begin[code], less


def rotations(codes: np.ndarray) -> np.ndarray:
    """Beginnings of all rotations of a text, sorted: eight codes at first, then twice as many in every round."""
    rank = np.zeros(len(codes), np.int64)
    for i in range(8):
        rank = rank << BITS | np.roll(codes, -i)
    width = 8
    while True:
        order = np.argsort(rank, kind="stable")
        new = np.cumsum(np.concatenate([[0], np.diff(rank[order]) > 0]))
        rank[order] = new
        if new[-1] == len(codes) - 1 or width >= 2 * len(codes):
            return order
        rank = rank * len(codes) + np.roll(rank, -width)
        width *= 2


#: An interval of the sorted rotations of the text, that of its reverse, and their common size.
State = tuple[np.ndarray, np.ndarray, np.ndarray]


class Index:
    """A bidirectional FM-index over distinct words, sorted; code 0 stands before each."""

    def __init__(self, words: list[bytes]):
        text = _CODE[np.frombuffer(b"\n" + b"\n".join(words), np.uint8)].astype(np.int64)
        self.size = len(text)
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << BITS))])
        self.sides = [Wavelet(t[rotations(t) - 1]) for t in (text, text[::-1].copy())]

    def start(self, n: int) -> State:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, self.size)

    def _state(self, state: State, side: int, code, low, high, less) -> State:
        out = [state[0] + less, state[1] + less]
        out[side] = self.begin[code] + low
        return out[0], out[1], high - low

    def extend(self, state: State, side: int, code: np.ndarray) -> State:
        """Patterns with one more code to the left (side 0) or to the right (1)."""
        return self._state(state, side, code, *self.sides[side].one(code, state[side], state[side] + state[2]))

    def extensions(self, state: State, side: int) -> tuple[np.ndarray, np.ndarray, State]:
        """Every way to extend patterns by one code: the pattern's number, the code, and the new pattern."""
        source, code, low, high, less = self.sides[side].all(state[side], state[side] + state[2])
        return source, code, self._state(pick(state, source), side, code, low, high, less)


def pick(state: State, which: np.ndarray) -> State:
    return state[0][which], state[1][which], state[2][which]


def near(index: Index, codes: np.ndarray, exact: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row of codes (words of one length) and the number of a word with one error behind the exact part.

    side 1: the first `exact` codes are the exact part and the search ends on the right; side 0: the last ones, on the left.
    """
    words = codes if side == 1 else codes[:, ::-1]
    n, length = words.shape
    row, state = np.arange(n), index.start(n)
    for i in range(exact - 1, -2, -1):  # from the middle out to the delimiter
        state = index.extend(state, 1 - side, words[row, i] if i >= 0 else np.zeros(len(row), np.int64))
        live = np.flatnonzero(state[2] > 0)
        row, state = row[live], pick(state, live)
    wrong: tuple[np.ndarray, State] = (np.zeros(0, np.int64), index.start(0))
    join = lambda *parts: (np.concatenate([p[0] for p in parts]), tuple(map(np.concatenate, zip(*(p[1] for p in parts)))))

    def step(some: tuple[np.ndarray, State], code: np.ndarray) -> tuple[np.ndarray, State]:
        to = index.extend(some[1], side, code)
        live = np.flatnonzero(to[2] > 0)
        return some[0][live], pick(to, live)

    for i in range(exact, length + 1):
        source, code, grown = index.extensions(state, side)
        mine = words[row[source], i] if i < length else np.full(len(source), -1)
        other = np.flatnonzero((code != 0) & (code != mine))
        changed = (row[source[other]], pick(grown, other))
        wrong = join(wrong, changed)  # one too many; before an equal one it is the same as behind it
        if i == length:
            break
        wrong = join(step(wrong, words[wrong[0], i]), changed, (row, state))  # another one; one too few
        same = np.flatnonzero(code == mine)
        row, state = row[source[same]], pick(grown, same)
    row, state = step(wrong, np.zeros(len(wrong[0]), np.int64))
    both = np.unique(row * index.size + state[0])
    return both // index.size, both % index.size


def _ask(words: pa.Array, n: np.ndarray, kind: np.ndarray, k: np.ndarray, block: int) -> pa.RecordBatch:
    """word, n_near, near_n, near of rows of whole groups: pairs that belong to a row's group."""
    distinct = words.unique()
    distinct = distinct.take(pc.sort_indices(distinct))
    size = len(distinct)
    spelled = [w.encode("latin-1") for w in distinct.to_pylist()]
    lengths = np.fromiter(map(len, spelled), np.int64, size)
    whole, begin = _CODE[np.frombuffer(b"".join(spelled), np.uint8)], np.concatenate([[0], np.cumsum(lengths)])
    at = np.asarray(pc.index_in(words, value_set=distinct), np.int64)
    count = np.zeros(size, np.int64)
    count[at] = n
    better = np.empty(size, np.int64)  # place by count, then by spelling
    better[np.lexsort((np.arange(size), -count))] = np.arange(size)
    by_rank = np.argsort(better)

    def matrix(which: np.ndarray, length: int) -> np.ndarray:
        return whole[begin[which][:, None] + np.arange(length)].astype(np.int64)

    def same(a: np.ndarray, b: np.ndarray, width: int, ends: bool) -> np.ndarray:
        """Whether words agree in the first (or last) `width` codes."""
        x, y = (begin[w + 1] - width if ends else begin[w] for w in (a, b))
        out = np.ones(len(a), bool)
        for i in range(width):
            out &= whole[x + i] == whole[y + i]
        return out

    total, best = np.zeros(size, np.int64), np.full(size, size)
    for low in range(0, size, block):
        index = Index(spelled[low : low + block])
        shape = np.stack([np.unique(kind, return_inverse=True)[1], k, lengths[at]], 1)
        order = np.lexsort(shape.T)
        for run in np.split(order, np.flatnonzero(np.any(np.diff(shape[order], axis=0) != 0, axis=1)) + 1):
            form, half, length = str(kind[run[0]]), int(k[run[0]]), int(lengths[at[run[0]]])
            side, wide = int(form[0] == "p"), half + half // 2
            for some in np.split(run, range(ASKED, len(run), ASKED)):
                asked = at[some]
                row, found = near(index, matrix(asked, length), wide if form[1:] == "a" else half, side)
                mine, found = asked[row], found + low
                own = np.minimum(lengths[mine], lengths[found]) // 2 == half
                if side == 0:
                    own &= ~same(mine, found, half, False)
                if form[1:] == "b":
                    own &= ~same(mine, found, wide, side == 0)
                mine, found = mine[own], found[own]
                total += np.bincount(mine, minlength=size)
                np.minimum.at(best, mine, better[found])
    have = np.flatnonzero(total)
    form = by_rank[best[have]]
    return pa.RecordBatch.from_arrays([distinct.take(pa.array(have)), pa.array(total[have]), pa.array(count[form]), distinct.take(pa.array(form))], ["word", "n_near", "near_n", "near"])


def near_words(words: DataFrame, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """word, n_near, near, near_n of the words (word, n) that have near ones; near: that of largest n, ties the smallest."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def ask() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            return _ask(t["word"].chunk(0), np.asarray(t["n"]), np.array(t["kind"].to_pylist()), np.asarray(t["k"], np.int64), block)

        last, size = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = pc.binary_join_element_wise(b.column(2), b.column(3).cast(pa.string()), b.column(4), "\n")
            new = np.flatnonzero(np.append(True, np.asarray(pc.not_equal(keys[1:], keys[:-1]))))
            if keys[0].as_py() == last:
                new = new[1:]
            begin = 0
            for i in new.tolist():  # a group ends before i
                if size + i - begin >= block:
                    if i > begin:
                        held.append(b.slice(begin, i - begin))
                    yield ask()
                    begin, size = i, 0
            held.append(b.slice(begin))
            size += b.num_rows - begin
            last = keys[-1].as_py()
        if held:
            yield ask()
        release()

    dealt = _groups(words, hot).repartition("kind", "k", "key").sortWithinPartitions("kind", "k", "key")
    found = dealt.select("word", "n", "kind", F.col("k").cast("int").alias("k"), "key").mapInArrow(each, "word string, n_near bigint, near_n bigint, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.m")).alias("near_n"))


def _roots(links: DataFrame) -> DataFrame:
    """word, root: forms followed to the last, twice as far in every round. A form's count is RATIO times the word's, so chains are short."""
    links = stored(links.select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = links.join(on, "root", "left")
        if moved.where("next is not null").isEmpty():
            return links
        links = stored(moved.select("word", F.coalesce("next", "root").alias("root")))


def group(docs: DataFrame, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents (doc_id, text)."""
    words = stored(vocabulary(docs))
    known = stored(words.join(near_words(words, hot, block), "word", "left"))
    good = F.col("near_n") >= RATIO * F.col("n")
    rows = known.select("word", F.when(good, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("near_n")).alias("form_n"))
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents"))
