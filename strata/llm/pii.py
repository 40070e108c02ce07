r"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

Base spans are those of the patterns, found in time linear in the text: a run of characters that can't begin a match
isn't tried again from each of its places.

Texts are read whole in windows of `WINDOW` characters every `STRIDE`, so neighbours overlap; every window is decoded
by Viterbi. Reconciling is global: each position takes its tag from the window in which it lies deepest, runs of one
tag in the whole text become spans, which grow to whole numbers or names. An added span must have a looser shape of
its kind (`LOOSE`: letters beyond ASCII, hosts of one label, "at" and "dot" spelled out, other separators), pass its
kind's check (digits, Luhn, parts), be no longer than `MAX_SPAN` and overlap no base span.

Training is in numpy on the driver, from the base spans of stretches of at most `SAMPLE_CHARS` characters of at most
`SAMPLE_DOCS` documents with a digit or @ (those with the smallest hash) and from variants of these spans that the patterns don't match: a fixed number of steps,
whatever the corpus. Without any span there is no model.

Null text counts as empty; an empty text has no spans, nor has an empty table a model. Repeated rows are found each by
itself, very long texts take time in proportion, other columns don't matter. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import batch_bytes, blocks, release, table, thin

#: Kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Characters of an email's name and host, of a run of digit groups, and possible places of cards and phones.
_NAME, _HOST = re.compile(r"[A-Za-z0-9._%+-]+@?"), re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_GROUPS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
#: Shapes of added spans. A phone may lack the plus sign, not the separators.
_AT, _DOT = r"(?:@|\s?[\[(]\s?at\s?[\])]\s?|\sat\s)", r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)"
LOOSE = {
    "email": re.compile(rf"[\w.%+-]+(?:@[\w-]+|{_AT}[\w-]+(?:{_DOT}[\w-]+)+)", re.I),
    "ip": PATTERNS["ip"],
    "card": re.compile(r"[0-9](?:[\x20._/-]{0,2}[0-9])+"),
    "phone": re.compile(r"[+(]{0,2}[0-9]+(?:[\x20()./-]+[0-9]+)+"),
}
MAX_SPAN = 256
HIDDEN, WINDOW, STRIDE, BATCH = 8, 128, 96, 2048
SAMPLE_DOCS, SAMPLE_CHARS, STEPS = 1_500, 2_000, 500
SPANS = "array<struct<kind: string, start: int, end: int, base: boolean>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    """Whether a match of a kind's pattern or looser shape passes its check."""
    if kind == "ip":
        return all(len(n := x.lstrip("0")) < 4 and int(n or 0) <= 255 for x in found.split("."))
    if kind == "card":
        return len(found) >= 13 and 13 <= len(d := re.sub(r"[^0-9]", "", found)) <= 19 and luhn(d)
    return kind == "email" or 9 <= sum(c.isdigit() for c in found) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: before each @ the run of name characters that no match has taken, if a host follows."""
    at = 0
    for m in _NAME.finditer(text):
        start, end = max(at, m.start()), m.end()
        if text[end - 1] == "@" and start < end - 1 and (host := _HOST.match(text, end)):
            at = host.end()
            yield start, at


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: four groups after four in every run of digit groups with single dots."""
    for m in _GROUPS.finditer(text):
        at, groups = m.start(), m[0].split(".")
        for i in range(0, len(groups) - 3, 4):
            end = at + sum(map(len, groups[i : i + 4])) + 3
            yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; what fails its check is dropped, without a retry inside it."""
    found = {"email": _emails(text) if "@" in text else (), "ip": _ips(text) if "." in text else ()}
    found |= {k: (m.span() for m in PATTERNS[k].finditer(text)) for k in ("card", "phone")}
    return [(k, s, e) for k in KINDS for s, e in found[k] if valid(k, text[s:e])]


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|); its derivative is (1 - |result|) squared."""
    return x / (1 + np.abs(x))


def _lstm(a: np.ndarray, u, keep: list | None = None) -> np.ndarray:
    """States (T, H, N) of one direction over character classes a (T, N); u: input table (4H, 128), recurrent (4H, H)."""
    given, rec = u
    hid, n = rec.shape[1], a.shape[1]
    h, c, out = np.zeros((hid, n), np.float32), np.zeros((hid, n), np.float32), np.empty((len(a), hid, n), np.float32)
    g, x, s, room = (np.empty((k * hid, n), np.float32) for k in (4, 4, 1, 1))
    for t in range(len(a)):
        np.take(given, a[t], axis=1, out=x, mode="clip")
        np.matmul(rec, h, out=g)
        g += x
        np.abs(g, out=x)
        x += 1
        g /= x
        if keep is not None:
            keep.append((h.copy(), c.copy(), g.copy()))
        gates = g[: 3 * hid]
        gates += 1
        gates *= 0.5
        i, f, o = gates[:hid], gates[hid : 2 * hid], gates[2 * hid :]
        c *= f
        i *= g[3 * hid :]
        c += i
        np.abs(c, out=room)
        room += 1
        np.divide(c, room, out=s)
        if keep is not None:
            keep[-1] += (s.copy(),)
        np.multiply(o, s, out=out[t])
        h = out[t]
    return out


def _lstm_back(a, u, keep, d_out):
    given, rec = u
    hid = rec.shape[1]
    d_given, d_rec = np.zeros_like(given), np.zeros_like(rec)
    d_h, d_c = np.zeros(d_out.shape[1:], np.float32), np.zeros(d_out.shape[1:], np.float32)
    each = np.empty((len(a), 4 * hid, a.shape[1]), np.float32)
    for t in range(len(a) - 1, -1, -1):
        h, before, g, s = keep[t]
        i, f, o = (0.5 * (1 + g[k * hid : (k + 1) * hid]) for k in range(3))
        d = d_h + d_out[t]
        d_c = d_c + d * o * (1 - np.abs(s)) ** 2
        d_g = np.concatenate([0.5 * d_c * g[3 * hid :], 0.5 * d_c * before, 0.5 * d * s, d_c * i]) * (1 - np.abs(g)) ** 2
        each[t] = d_g
        d_rec += d_g @ h.T
        d_h, d_c = rec.T @ d_g, d_c * f
    for k in range(4 * hid):
        d_given[k] = np.bincount(a.ravel(), each[:, k].ravel(), 128)
    return d_given, d_rec


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def crf(emit: np.ndarray, move: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood a position of tags (T, N), and its gradients by emit (T, K, N) and move (K, K)."""
    steps, kinds, n = emit.shape
    fwd, bwd = np.empty(emit.shape, np.float64), np.zeros(emit.shape, np.float64)
    fwd[0] = emit[0]
    for t in range(1, steps):
        fwd[t] = emit[t] + _log_sum(fwd[t - 1][:, None] + move[:, :, None], 0)
    for t in range(steps - 2, -1, -1):
        bwd[t] = _log_sum(move[:, :, None] + (emit[t + 1] + bwd[t + 1])[None], 1)
    z = _log_sum(fwd[-1], 0)
    at = np.arange(n)
    gold = sum(emit[t, tags[t], at] for t in range(steps)) + sum(move[tags[t - 1], tags[t]] for t in range(1, steps))
    d_emit = np.exp(fwd + bwd - z)
    d_move = np.zeros_like(move, np.float64)
    for t in range(1, steps):
        d_move += np.exp(fwd[t - 1][:, None] + move[:, :, None] + (emit[t] + bwd[t])[None] - z).sum(2)
        np.add.at(d_move, (tags[t - 1], tags[t]), -1)
    for t in range(steps):
        d_emit[t, tags[t], at] -= 1
    size = steps * n
    return float((z - gold).sum() / size), (d_emit / size).astype(np.float32), (d_move / size).astype(np.float32)


def classes(text: str) -> np.ndarray:
    """Code points below 128 as they are, all others 1."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 128, c, 1).astype(np.uint8)


@dataclass
class Model:
    forward: tuple[np.ndarray, np.ndarray]
    backward: tuple[np.ndarray, np.ndarray]
    head: np.ndarray  # (kinds + 1, 2H + 1)
    move: np.ndarray

    def decode(self, a: np.ndarray) -> np.ndarray:
        """Best tags (T, N) of character classes (T, N): 0 for none, else 1 + the kind."""
        fwd, bwd = _lstm(a, self.forward), _lstm(a[::-1], self.backward)[::-1]
        hid = fwd.shape[1]
        emit = np.matmul(self.head[:, :hid], fwd) + np.matmul(self.head[:, hid : 2 * hid], bwd) + self.head[:, -1][:, None]
        best, back = emit[0].copy(), np.zeros(emit.shape, np.int8)
        kinds, n = best.shape
        score, higher, new = np.empty(n, np.float32), np.empty(n, bool), np.empty_like(best)
        for t in range(1, len(a)):
            for k in range(kinds):
                top = np.add(best[0], self.move[0, k], out=new[k])
                for j in range(1, kinds):
                    np.add(best[j], self.move[j, k], out=score)
                    np.greater(score, top, out=higher)
                    np.copyto(top, score, where=higher)
                    np.copyto(back[t, k], j, where=higher)
            np.add(new, emit[t], out=best)
        tags, at = np.empty(a.shape, np.int8), np.arange(a.shape[1])
        tags[-1] = best.argmax(0)
        for t in range(len(a) - 1, 0, -1):
            tags[t - 1] = back[t, tags[t], at]
        return tags

    def tags(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Tags of whole texts, given as classes."""
        data = np.concatenate([*texts, np.zeros(WINDOW, np.uint8)]).astype(np.intp)
        size = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(size) - size
        count = np.where(size > 0, 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE)), 0)
        doc = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start, stop = first[doc] + nth * STRIDE, (first + size)[doc]
        edge = (WINDOW - STRIDE) // 2
        low = np.where(nth == 0, start, start + edge)
        high = np.where(nth == count[doc] - 1, stop, start + edge + STRIDE)
        out, steps = np.zeros(len(data), np.int8), np.arange(WINDOW)[:, None]
        for i in range(0, len(doc), BATCH):
            s, part = start[i : i + BATCH], slice(i, i + BATCH)
            place = s + steps
            inside = place < stop[part]
            tags = self.decode(np.where(inside, data[np.minimum(place, len(data) - 1)], 0))
            core = (place >= low[part]) & (place < high[part])
            out[place[core]] = tags[core]
        return [out[f : f + n] for f, n in zip(first, size)]


def _grown(text: str, kind: str, a: int, b: int) -> tuple[int, int]:
    """A tagged run, trimmed to a number or name and grown to a whole one; at most MAX_SPAN more on each side."""
    if kind == "email":
        inner = lambda c: c.isalnum() or c in "%+-._@"
    else:
        inner = lambda c: "0" <= c <= "9"
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while a < b and not text[b - 1].isalnum():
        b -= 1
    low, high = max(0, a - MAX_SPAN), min(len(text), b + MAX_SPAN)
    while low < a < b and inner(text[a]) and inner(text[a - 1]):
        a -= 1
    while a < b < high and inner(text[b - 1]) and inner(text[b]):
        b += 1
    while a < b and kind == "email" and not text[b - 1].isalnum():
        b -= 1
    return a, b


def added_spans(text: str, tags: np.ndarray, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs of one tag, grown to whole numbers or names, that have a loose shape, pass the check and overlap no base span.

    They tell apart what a pattern swallows as one (a card behind another number, a phone before an address, an ip in a
    longer run of groups) and find what no pattern matches.
    """
    edge = np.flatnonzero(np.diff(tags, prepend=0, append=0))
    out: list[tuple[str, int, int]] = []
    taken = bytearray(len(text) if len(edge) else 0)
    for _, a, b in base if taken else ():
        taken[a:b] = b"\1" * (b - a)
    for a, b in zip(edge.tolist(), edge[1:].tolist()):
        if not tags[a]:
            continue
        kind = KINDS[tags[a] - 1]
        a, b = _grown(text, kind, a, b)
        if not 0 < b - a <= MAX_SPAN:
            continue
        places = [(a, b)]
        if kind == "ip":  # four groups of the run, wherever they begin
            groups = list(re.finditer(r"[0-9]+", text[a:b]))
            places = [(a + x.start(), a + y.end()) for x, y in zip(groups, groups[3:])]
        for s, e in places:
            if taken.find(1, s, e) < 0 and LOOSE[kind].fullmatch(text, s, e) and valid(kind, text[s:e]):
                out.append((kind, s, e))
                taken[s:e] = b"\1" * (e - s)
    return out


def variant(kind: str, span: str, rng: np.random.Generator) -> tuple[str, str, str]:
    """What stands before, the span, and what stands behind: a form of a base span that its pattern misses."""
    how = int(rng.integers(3))
    if kind == "email":
        name, host = span.split("@", 1)
        if how == 0:
            return "", f"{name} at {host.replace('.', ' dot ')}", ""
        return ("", f"{name}\u00e9@{host}", "") if how == 1 else ("", f"{name}@{host.split('.')[0]}", " ")
    if kind == "ip":
        return (f"{rng.integers(256, 1000)}.", span, "") if how < 2 else ("", span, f".{rng.integers(256, 1000)}")
    if kind == "card":
        digits = re.sub(r"[^0-9]", "", span)
        four = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return (f"{rng.integers(10**9, 10**13)} ", span, "") if how == 0 else ("", ("." if how == 1 else "/").join(four), "")
    bare = span.lstrip("+")
    return ("", bare, "") if how == 0 else ("", re.sub(r"[ .-]+", "/" if how == 1 else ".", bare), "")


def train(texts: list[str], steps: int = STEPS, span: int = 80, batch: int = 64, seed: int = 11) -> Model | None:
    """From the texts' base spans: of four windows one holds no span but a digit or @, three hold one, half of them as a variant."""
    rng = np.random.default_rng(seed)
    data, tags, centres, others = [], [], [[] for _ in KINDS], []
    for k, text in enumerate(texts):
        a, y = classes(text), np.zeros(len(text), np.int64)
        for kind, s, e in base_spans(text):
            y[s:e] = 1 + KINDS.index(kind)
            centres[KINDS.index(kind)].append((k, s, e))
        others += [(k, int(i), int(i)) for i in np.flatnonzero(((a >= 48) & (a <= 57) | (a == 64)) & (y == 0))[:8]]
        data.append(a)
        tags.append(y)
    known = [c for c in centres if c]
    if not known:
        return None
    unit = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    kinds = len(KINDS) + 1
    p = [unit(4 * HIDDEN, 128), unit(4 * HIDDEN, HIDDEN), unit(4 * HIDDEN, 128), unit(4 * HIDDEN, HIDDEN), unit(kinds, 2 * HIDDEN + 1), unit(kinds, kinds)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for step in range(1, steps + 1):
        a, y = np.zeros((span, batch), np.intp), np.zeros((span, batch), np.int64)
        for j in range(batch):
            pool = others if others and j % 4 == 0 else known[rng.integers(len(known))]
            k, s, e = pool[rng.integers(len(pool))]
            piece, own, at = data[k], tags[k], (s + e) // 2
            if s < e and e - s < span and rng.integers(2):
                kind = KINDS[own[s] - 1] if own[s] else KINDS[0]
                before, new, behind = variant(kind, texts[k][s:e], rng)
                cut = max(0, s - span)
                piece = np.concatenate([piece[cut:s], classes(before + new + behind), piece[e : e + span]])
                mark = np.repeat([0, 1 + KINDS.index(kind), 0], [len(before), len(new), len(behind)])
                own = np.concatenate([own[cut:s], mark, own[e : e + span]])
                at = s - cut + len(before) + len(new) // 2
            s = max(0, at - int(rng.integers(span // 4, 3 * span // 4)))
            piece, own = piece[s : s + span], own[s : s + span]
            a[: len(piece), j], y[: len(piece), j] = piece, own
        kf: list = []
        kb: list = []
        fwd, bwd = _lstm(a, (p[0], p[1]), kf), _lstm(a[::-1], (p[2], p[3]), kb)[::-1]
        both = np.concatenate([fwd, bwd, np.ones((span, 1, batch), np.float32)], 1)
        _, d_emit, d_move = crf(np.matmul(p[4], both), p[5], y)
        d_both = np.matmul(p[4].T, d_emit)
        grads = [*_lstm_back(a, (p[0], p[1]), kf, d_both[:, :HIDDEN]), *_lstm_back(a[::-1], (p[2], p[3]), kb, d_both[::-1, HIDDEN : 2 * HIDDEN]), np.einsum("tkn,thn->kh", d_emit, both), d_move]
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
        for i, g in enumerate(grads):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            p[i] = (p[i] - 0.04 * (1 - 0.9 * step / steps) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Model((p[0], p[1]), (p[2], p[3]), p[4], p[5])


def fit(docs: DataFrame, text: str = "text", most: int = SAMPLE_DOCS) -> Model | None:
    """From at most `most` documents that hold a digit or @, those with the smallest hash of their text: one stretch of
    at most SAMPLE_CHARS characters of each, around one of its digits or @, picked by the hash."""
    batch_bytes(docs.sparkSession, "4m")
    held = docs.select(F.col(text).cast("string").alias("t")).where(F.col("t").rlike("[0-9@]")).select(F.xxhash64("t").alias("h"), "t")
    near = F.regexp_extract_all("t", F.lit(f"(?s).{{0,{SAMPLE_CHARS // 4}}}[0-9@].{{0,{SAMPLE_CHARS - SAMPLE_CHARS // 4 - 1}}}"), F.lit(0))
    few = thin(held, "h", most).select("h", near.alias("p")).select("h", F.get("p", F.pmod("h", F.size("p")).cast("int")).alias("t"))
    return train([r.t for r in few.dropDuplicates(["h"]).orderBy("h").limit(most).collect()])


def _all_spans(model: Model | None, texts: pa.Array) -> Iterator[tuple[str, list[tuple[str, int, int, bool]]]]:
    """(text, spans by kind, start and end) of every text."""
    for part in blocks(texts.fill_null("") if texts.null_count else texts, 1 << 20):
        part = part.to_pylist()
        base = [base_spans(t) for t in part]
        more = [added_spans(t, y, b) for t, y, b in zip(part, model.tags([classes(t) for t in part]), base)] if model else [[] for _ in part]
        release()
        for t, b, a in zip(part, base, more):
            yield t, sorted([(*x, True) for x in b] + [(*x, False) for x in a], key=lambda x: (KINDS.index(x[0]), *x[1:]))


def find(model: Model | None, text: Column) -> Column:
    """SPANS of a text: base and added, by kind as listed, then start."""

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        return pa.array([[dict(zip(("kind", "start", "end", "base"), x)) for x in s] for _, s in _all_spans(model, texts)], kind)

    return spans(text)


def redact(model: Model | None, text: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by its first span's kind in angle brackets; null stays null."""

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        out: list[str] = []
        for t, spans in _all_spans(model, texts):
            kept, at = [], 0
            for kind, s, e, _ in sorted(spans, key=lambda x: x[1:3]):
                if s >= at:
                    kept += [t[at:s], f"<{kind}>"]
                at = max(at, e)
            out.append("".join([*kept, t[at:]]))
        return pa.array(out, pa.string())

    return F.when(text.isNotNull(), masked(text))


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", find(fit(docs), F.col("text").cast("string")).alias("s"))
    said = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("s", lambda x: x["base"])
    counts = [F.size(F.filter(base, _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("s")).alias("spans"), F.size("s").cast("long").alias("n_spans"))


def _of(kind: str):
    return lambda x: x["kind"] == kind
