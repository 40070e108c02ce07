"""Token files: ids of a public tokenizer, Re-Pair compressed shard by shard, readable at any position.

A shard holds whole documents in ascending doc_id order, about `SHARD_IDS` ids (a longer document is a shard by
itself). Re-Pair works in rounds: count all adjacent pairs (by hash; of pairs in one bucket one is counted, the others
wait for the next round; once that finds fewer than `PER_ROUND`, exactly), give each of the `PER_ROUND` most frequent ones that stand
at least `LEAST` times a nonterminal, replace from left to right (in a run of overlapping places every other one),
until no pair stands `LEAST` times. No pair crosses a document's end. A file row holds the rules, every rule's
expansion length, the symbols and where each document starts in them, so a span of a document is decoded by walking
symbol lengths and expanding only what it needs.

Files are Parquet written by Spark into the shared folder: a lost executor's rows are written again by another.
Documents are dealt by ranges of doc_id (ties by text). Null text counts as empty: its only id is the end id.
Repeated rows are written once each; an empty table makes no shard; other columns are left out.

Where the tokenizer is built as `SHORTCUT` says, encoding a text equals encoding its pieces between blanks and line
ends (white space is dropped and pieces never look at each other), so a distinct piece is encoded once and looked up
afterwards, and pieces of small Latin letters alone need no normalising. Any other tokenizer file encodes whole texts. A
string of a special token in a text gives that token's id, as the library's plain call does; with `plain` as False it is
ordinary text, so that no text can forge an id.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from functools import cached_property, lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import batch_bytes, raw, shared_dir, slices, table

END = 1
SHARD_IDS, PER_ROUND, LEAST = 1 << 19, 2048, 8
#: Distinct pieces that a Python worker knows before it forgets those it hasn't met since it last forgot some.
CACHE_PIECES = 600_000
FILE = "range int, before bigint, doc_ids array<bigint>, starts array<int>, counts array<int>, n_ids bigint, rules binary, lengths binary, symbols binary"


#: A sign that is one id by itself and parts pieces that are encoded together.
SEPARATOR = "|"
#: Lead bytes below this: no character from U+0300, so nothing combines. Then A-Z can be lower-cased (as the
#: tokenizer does next) and a letter be parted from the sign behind it (which always ends a piece), so that
#: fewer distinct pieces are left.
BELOW_MARKS = 0xCC
LETTER_THEN_MARK = "([a-z\u00df-\u00f6\u00f8-\u00ff])([.,!?;:%*#$&])"
LETTERS = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"


#: The parts of a tokenizer file for which texts may be cut at blanks.
SHORTCUT = {
    "normalizers": ["NFC", "Replace", "Lowercase"],
    "pre_tokenizers": ["Split", "ByteLevel"],
    "split": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}


def _shortcut(spec: dict) -> bool:
    """Whether a tokenizer file drops white space and takes pieces one by one, as SHORTCUT says."""
    norm, pre = (spec.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
    steps = pre.get("pretokenizers") or [{}]
    same = [x.get("type") for x in norm.get("normalizers", [])] == SHORTCUT["normalizers"]
    same &= [x.get("type") for x in steps] == SHORTCUT["pre_tokenizers"]
    return same and (steps[0].get("pattern") or {}).get("Regex") == SHORTCUT["split"] and steps[0].get("invert") is True


class Encoder:
    """Ids (uint32) of text arrays by one tokenizer file; one per Python worker."""

    def __init__(self, path: str, plain: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        spec = json.loads(Path(path).read_text())
        self.special = [t["content"] for t in spec.get("added_tokens", [])] if plain else []
        self.path, self.shortcut = path, _shortcut(spec)
        self.letters = Tokenizer(self.tokenizer.model)  # for pieces of LETTERS, which the other steps leave alone
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.separator = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids[0] if self.shortcut else None
        self.bar = self.letters.encode(SEPARATOR, add_special_tokens=False).ids[0] if self.shortcut else None
        self.known = pa.array([], pa.string())
        #: Of each known piece: where its ids begin in `ids`, how many they are, and whether it was met since the last forgetting.
        self.begin, self.size, self.met, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint32)

    def _alone(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [e.ids for e in self.tokenizer.encode_batch_fast(distinct, add_special_tokens=False)]
        return np.array([x for ids in each for x in ids], np.uint32), np.array([len(ids) for ids in each], np.int64)

    def _joined(self, distinct: pa.Array, tokenizer, separator: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces without the separator, encoded as one text (much cheaper than as many texts), and how many each has."""
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), f" {SEPARATOR} ")[0].as_py()
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        apart = ids == separator
        cut = np.flatnonzero(apart)
        if len(cut) != len(distinct) - 1:
            return self._alone(distinct.to_pylist())
        return ids[~apart], np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1

    def _learn(self, new: pa.Array) -> None:
        """Encodes pieces that aren't known."""
        letters, bar = (np.asarray(x) for x in (pc.match_substring_regex(new, LETTERS), pc.match_substring(new, SEPARATOR)))
        begin, size, parts, total = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), [self.ids], len(self.ids)
        for rows, tokenizer, separator in ((letters, self.letters, self.bar), (~letters & ~bar, self.tokenizer, self.separator), (bar, None, None)):
            rows = np.flatnonzero(rows)
            for i in range(0, len(rows), 5_000):
                own = rows[i : i + 5_000]
                some = new.take(pa.array(own))
                ids, n = self._joined(some, tokenizer, separator) if tokenizer else self._alone(some.to_pylist())
                begin[own], size[own] = total + np.cumsum(n) - n, n
                parts.append(ids)
                total += len(ids)
        self.known, self.ids = pa.concat_arrays([self.known, new]), np.concatenate(parts)
        self.begin, self.size, self.met = (np.concatenate(x) for x in ((self.begin, begin), (self.size, size), (self.met, np.ones(len(new), bool))))

    def _forget(self) -> None:
        """Leaves the pieces that were met since the last time."""
        kept = np.flatnonzero(self.met)
        self.known, size = self.known.take(pa.array(kept)), self.size[kept]
        self.ids, self.begin, self.size, self.met = self.ids[ragged(self.begin[kept], size)], np.cumsum(size) - size, size, np.zeros(len(kept), bool)

    def pieces(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct piece, where its ids begin in `ids`, and how many they are."""
        distinct = distinct.cast(pa.string())
        if len(self.known) > CACHE_PIECES:
            self._forget()
        at = pc.index_in(distinct, value_set=self.known)
        new = np.asarray(at.is_null())
        at = np.array(at.fill_null(0), np.int64)
        if new.any():
            at[new] = len(self.known) + np.arange(int(new.sum()))
            self._learn(distinct.filter(pa.array(new)))
        self.met[at] = True
        return self.begin[at], self.size[at]

    def encode(self, texts: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by `end`, and the number of each text's ids."""
        texts = texts.fill_null("")
        if not self.shortcut:
            return self._whole(texts, end)
        odd = np.zeros(len(texts), bool)
        for token in self.special:
            odd |= np.asarray(pc.match_substring(texts, token))
        if not odd.any():
            return self._pieced(texts, end)
        ids, counts = self._pieced(pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts), end)
        each = np.split(ids, np.cumsum(counts)[:-1])
        for i in np.flatnonzero(odd):
            each[i], counts[i : i + 1] = self._whole(texts.slice(i, 1), end)
        return np.concatenate(each), counts

    @cached_property
    def plain(self):
        """The tokenizer as its file has it, for texts that hold a special token's string."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path) if self.special else self.tokenizer

    def _whole(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        each = [np.append(np.array(e.ids, np.uint32), np.uint32(end)) for e in self.plain.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *each]), np.array([len(x) for x in each], np.int64)

    def _pieced(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        if raw(texts)[0].max(initial=0) < BELOW_MARKS:
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), LETTER_THEN_MARK, r"\1 \2")
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        flat = split.flatten().dictionary_encode()
        begin, size = self.pieces(flat.dictionary)
        at = np.asarray(flat.indices, np.int64)
        words = np.diff(np.asarray(split.offsets, np.int64))
        per_word = size[at]
        ends = np.concatenate([[0], np.cumsum(per_word)])[np.concatenate([[0], np.cumsum(words)])]
        counts = np.diff(ends) + 1
        out = np.full(int(counts.sum()), end, np.uint32)
        free = np.ones(len(out), bool)
        free[np.cumsum(counts) - 1] = False
        out[free] = self.ids[ragged(begin[at], per_word)]
        return out, counts


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... size[0] of them, then those of start[1], and so on."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - size), size)


@lru_cache(maxsize=2)
def encoder(path: str, plain: bool = True) -> Encoder:
    return Encoder(path, plain)


def compress(ids: np.ndarray, last: np.ndarray, per_round: int = PER_ROUND, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols, where documents end in them (bool), rules (n, 2), and the first nonterminal; `last` marks documents' last ids."""
    s, end, first = ids.astype(np.uint32), last, int(ids.max(initial=0)) + 1
    rules: list[np.ndarray] = []
    total, bits, exactly = first, 18, False
    while len(s) > 1:
        a, b = s[:-1], s[1:]
        h = a * np.uint32(0x9E3779B1)
        h += b * np.uint32(0x85EBCA6B)
        h = (h >> np.uint32(32 - bits)).astype(np.intp)
        h[end[:-1]] = 1 << bits  # what crosses a document's end has a bucket of its own, which never counts
        count = np.bincount(h, minlength=(1 << bits) + 1)
        count[-1] = 0
        full, floor = count[count >= least], least
        if not exactly and len(full) > 2 * per_round:
            floor = max(least, int(np.partition(full, -2 * per_round)[-2 * per_round]))
        place = np.flatnonzero((count >= floor)[h])
        if exactly:  # every pair of a full bucket has a number of its own
            h = np.unique(a[place].astype(np.uint64) << np.uint64(32) | b[place], return_inverse=True)[1]
            of = np.zeros(int(h.max(initial=-1)) + 1, np.int64)
            of[h] = place
        else:  # a full bucket stands for one of its pairs; only that pair's places count
            h, of = h[place], np.zeros(1 << bits, np.int64)
            of[h] = place
            same = (a[place] == a[of[h]]) & (b[place] == b[of[h]])
            place, h = place[same], h[same]
        exact = np.bincount(h, minlength=len(of))
        best = np.flatnonzero(exact >= least)
        best = best[np.lexsort((best, -exact[best]))][:per_round]
        if not len(best):
            if exactly:
                break
            exactly = True
            continue
        exactly = exactly or len(best) < per_round  # few are left that a bucket can tell
        number = np.zeros(len(of), np.uint32)
        number[best] = total + np.arange(len(best))
        given = number[h]
        place, given = place[given > 0], given[given > 0]
        run = np.flatnonzero(np.concatenate([[True], np.diff(place) > 1]))  # overlapping places: every other one
        nth = np.arange(len(place)) - np.repeat(run, np.diff(np.concatenate([run, [len(place)]])))
        place, given = place[nth % 2 == 0], given[nth % 2 == 0]
        rules.append(np.stack([a[of[best]], b[of[best]]], 1).astype(np.int64))
        s, end = s.copy(), end.copy()
        s[place] = given
        end[place] = end[place + 1]
        stay = np.ones(len(s), bool)
        stay[place + 1] = False
        s, end = s[stay], end[stay]
        total += len(best)
    return s, end, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), first


class Shard:
    """One file row, opened for reading."""

    def __init__(self, rules: bytes, lengths: bytes, symbols: bytes):
        head = np.frombuffer(rules, "<u4")
        self.first, self.rules = int(head[0]), head[1:].reshape(-1, 2)
        self.lengths = np.frombuffer(lengths, "<u4").astype(np.int64)
        wide = symbols[0]
        self.symbols = np.frombuffer(symbols, "<u4" if wide == 4 else "<u2", offset=4).astype(np.int64)
        self.sizes = np.ones(len(self.symbols), np.int64)
        rule = self.symbols >= self.first
        self.sizes[rule] = self.lengths[self.symbols[rule] - self.first]
        self.flat: np.ndarray | None = None

    @staticmethod
    def row(symbols: np.ndarray, rules: np.ndarray, first: int) -> tuple[bytes, bytes, bytes]:
        size: list[int] = []
        for a, b in rules.tolist():
            size.append((size[a - first] if a >= first else 1) + (size[b - first] if b >= first else 1))
        wide = 4 if first + len(rules) > 1 << 16 else 2
        return np.concatenate([[first], rules.ravel()]).astype("<u4").tobytes(), np.array(size, "<u4").tobytes(), bytes([wide, 0, 0, 0]) + symbols.astype("<u4" if wide == 4 else "<u2").tobytes()

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of symbols: few are expanded by passes that put a rule's two sides in its place, many from all rules' expansions."""
        if len(symbols) > len(self.rules):
            return self._copied(symbols)
        while (rule := symbols >= self.first).any():
            at = np.arange(len(symbols)) + np.cumsum(rule) - rule
            out = np.empty(len(symbols) + int(rule.sum()), np.int64)
            out[at[~rule]] = symbols[~rule]
            out[at[rule]], out[at[rule] + 1] = self.rules[symbols[rule] - self.first].T
            symbols = out
        return symbols.astype(np.uint32)

    def _copied(self, symbols: np.ndarray) -> np.ndarray:
        """Every rule is written out once, those of one depth together; then each symbol copies its ids."""
        if self.flat is None:
            first, size = self.first, self.lengths
            begin, depth = np.cumsum(size) - size, [0] * len(size)
            for i, (a, b) in enumerate(self.rules.tolist()):
                depth[i] = 1 + max(depth[x - first] if x >= first else 0 for x in (a, b))
            self.flat, level = np.empty(int(size.sum()), np.uint32), np.array(depth, np.int64)
            for d in range(1, level.max(initial=0) + 1):
                (own,) = np.nonzero(level == d)
                to = begin[own]
                for side in self.rules[own].astype(np.int64).T:
                    rule = side >= first
                    long, known = np.ones(len(side), np.int64), side[rule] - first
                    long[rule] = size[known]
                    self.flat[to[~rule]] = side[~rule]
                    self.flat[ragged(to[rule], size[known])] = self.flat[ragged(begin[known], size[known])]
                    to = to + long
        rule = symbols >= self.first
        long, start = np.ones(len(symbols), np.int64), len(self.flat) + np.arange(len(symbols))
        known = symbols[rule] - self.first
        long[rule], start[rule] = self.lengths[known], (np.cumsum(self.lengths) - self.lengths)[known]
        return np.concatenate([self.flat, symbols.astype(np.uint32)])[ragged(start, long)]

    def document(self, start: int, stop: int) -> np.ndarray:
        """Ids of the symbols [start, stop), such as a document's."""
        return self.expand(self.symbols[start:stop])

    def span(self, start: int, stop: int, low: int, high: int) -> np.ndarray:
        """Ids [low, high) of the document with the symbols [start, stop), expanding only what covers them."""
        ends = np.cumsum(self.sizes[start:stop])
        a, b = int(np.searchsorted(ends, low, "right")), min(int(np.searchsorted(ends, high, "left")) + 1, stop - start)
        skip = int(ends[a - 1]) if a else 0
        return self.expand(self.symbols[start + a : start + b])[low - skip : high - skip]


def write(docs: DataFrame, tokenizer: str, folder: str, shard_ids: int = SHARD_IDS, ranges: int | None = None, plain: bool = True) -> None:
    """Token files of doc_id and text, in `folder` (which all executors share), as rows of FILE."""
    batch_bytes(docs.sparkSession, "32m")
    ranges = ranges or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def shard() -> pa.RecordBatch:
            nonlocal before
            names, counts = [x for h in held for x in h[0]], np.concatenate([h[2] for h in held])
            ids, last = np.concatenate([h[1] for h in held]), np.zeros(int(counts.sum()), bool)
            last[np.cumsum(counts) - 1] = True
            symbols, end, rules, first = compress(ids, last)
            starts = np.concatenate([[0], np.flatnonzero(end) + 1]).astype(np.int32)
            row = (part, before, names, starts, counts.astype(np.int32), len(ids), *Shard.row(symbols, rules, first))
            before += len(ids)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], [x.split()[0] for x in FILE.split(", ")])

        size = 0
        for b in (x for batch in batches for x in slices(batch, 1, 12 << 20)):
            ids, counts = encoder(tokenizer, plain).encode(b.column(1))
            names, ends, i = b.column(0).to_pylist(), np.cumsum(counts), 0
            while i < len(counts):  # up to the document with which the shard is full
                done = int(ends[i - 1]) if i else 0
                j = min(len(counts), int(np.searchsorted(ends, done + shard_ids - size, "left")) + 1)
                held.append((names[i:j], ids[done : int(ends[j - 1])], counts[i:j]))
                size += int(ends[j - 1]) - done
                if size >= shard_ids:
                    yield shard()
                    held, size = [], 0
                i = j
        if held:
            yield shard()

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(pack, FILE).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian uint32) from token files; start counts all ids before."""
    files = spark.read.schema(FILE).parquet(folder)
    totals = sorted(files.groupBy("range").agg(F.sum("n_ids").alias("n")).collect())  # one row per range, however many files
    before = np.concatenate([[0], np.cumsum([r.n for r in totals])[:-1]]).astype(int).tolist() if totals else []
    offset = spark.createDataFrame([(r["range"], b) for r, b in zip(totals, before)], "range int, offset bigint")  # one row per range, too
    schema = "range int, doc_id bigint, inside bigint, n_tokens bigint, ids binary"

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {n: c[i].as_py() for n, c in zip(b.schema.names, b.columns)}
                shard, starts, counts = Shard(r["rules"], r["lengths"], r["symbols"]), r["starts"], np.array(r["counts"], np.int64)
                ids, n = shard.document(starts[0], starts[-1]), len(counts)
                end = np.cumsum(counts)
                data = [ids[e - c : e].astype("<u4").tobytes() for e, c in zip(end.tolist(), counts.tolist())]
                arrays = [pa.array([r["range"]] * n, pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(r["before"] + end - counts), pa.array(counts), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in schema.split(", ")])

    docs = files.select("range", "before", "doc_ids", "starts", "counts", "rules", "lengths", "symbols").mapInArrow(unpack, schema)
    return docs.join(F.broadcast(offset), "range").select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids")


def spans(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """doc_id, low, high, ids (binary) of the wanted spans (doc_id, low, high) of documents' ids, without expanding the rest.

    A span beyond the document's end is cut there. Shards that hold no wanted document aren't opened.
    """
    files = spark.read.schema(FILE).parquet(folder)
    index = files.select("range", "before", F.posexplode("doc_ids").alias("k", "doc_id"))
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))
    hit = asked.join(index, "doc_id").groupBy("range", "before").agg(F.collect_list(F.struct("doc_id", "k", "low", "high")).alias("asked"))  # one shard's

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {n: c[i].as_py() for n, c in zip(b.schema.names, b.columns)}
                shard, starts, counts = Shard(r["rules"], r["lengths"], r["symbols"]), r["starts"], r["counts"]
                rows = []
                for x in r["asked"]:
                    high = min(x["high"], counts[x["k"]])
                    ids = shard.span(starts[x["k"]], starts[x["k"] + 1], x["low"], high) if x["low"] < high else np.zeros(0, np.uint32)
                    rows.append((x["doc_id"], x["low"], x["high"], ids.astype("<u4").tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "low", "high", "ids"])

    rows = files.join(hit, ["range", "before"]).select("starts", "counts", "rules", "lengths", "symbols", "asked")
    return rows.mapInArrow(unpack, "doc_id bigint, low bigint, high bigint, ids binary")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), default_path(), folder)
    return read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
