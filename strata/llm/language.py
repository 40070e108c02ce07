"""Language ID: a bidirectional GRU over bytes labels every position; documents pool the probabilities.

Texts are read whole, as UTF-8 windows of `WINDOW` bytes; each window starts both directions from a zero
state. A document's probabilities are the mean over all its positions. Prediction uses the text alone.

Training: backpropagation through time in numpy on the driver, from at most `SAMPLE_DOCS` labelled rows per
label (those with the smallest hash of their id) and one span of `SAMPLE_BYTES` of each, so its size is
bounded. Null text, or a text without any letter: label `und`, score 0. With no labelled row everything is `und`.
Repeated rows are predicted each by itself; an empty table gives no row; other columns are neither read nor in the way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import batch_bytes, blocks, raw, release, table, thin

HIDDEN, WINDOW, BATCH = 8, 128, 2048
SAMPLE_DOCS, SAMPLE_BYTES, STEPS = 256, 1_024, 260
UND = "und"


def squash(x: np.ndarray, scratch: np.ndarray) -> None:
    """x / (1 + |x|) in place; its derivative is (1 - |result|) squared."""
    np.abs(x, out=scratch)
    scratch += 1
    x /= scratch


def _gru(a: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (T, H, N) of one direction; a (T, N) bytes index the input table u[0] (3H, 256), u[1] is (3H, H).

    Squashing is x / (1 + |x|), several times cheaper in numpy than tanh; gates are (1 + that) / 2.
    """
    table_, rec = u
    hid, n = rec.shape[1], a.shape[1]
    whole = bool(mask.all())
    h, out = np.zeros((hid, n), np.float32), np.empty((len(a), hid, n), np.float32)
    x, g, scratch = (np.empty((3 * hid, n), np.float32) for _ in range(3))
    for t in range(len(a)):
        np.take(table_, a[t], axis=1, out=x, mode="clip")
        np.matmul(rec, h, out=g)
        gates = g[: 2 * hid]
        gates += x[: 2 * hid]
        squash(gates, scratch[: 2 * hid])
        gates += 1
        gates *= 0.5
        z, r = gates[:hid], gates[hid:]
        c = g[2 * hid :]
        if keep is not None:
            keep.append((h.copy(), z.copy(), r.copy(), c.copy()))
        c *= r
        c += x[2 * hid :]
        squash(c, scratch[2 * hid :])
        if keep is not None:
            keep[-1] += (c.copy(),)
        h -= c
        h *= z
        h += c
        if not whole:
            h *= mask[t]
        out[t] = h
    return out


def _gru_back(a, u, mask, keep, d_out):
    """Gradients of table and recurrent weights from d_out (T, H, N)."""
    table_, rec = u
    hid = rec.shape[1]
    d_table, d_rec, d_h = np.zeros_like(table_), np.zeros_like(rec), np.zeros(d_out.shape[1:], np.float32)
    each = np.empty((len(a), 3 * hid, a.shape[1]), np.float32)
    for t in range(len(a) - 1, -1, -1):
        h, z, r, gc, c = keep[t]
        d = (d_h + d_out[t]) * mask[t]
        d_c = d * (1 - z) * (1 - np.abs(c)) ** 2
        d_g = np.concatenate([d * (h - c) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2, d_c * gc * 0.5 * (1 - np.abs(2 * r - 1)) ** 2, d_c * r])
        d_x = np.concatenate([d_g[: 2 * hid], d_c])
        each[t] = d_x
        d_rec += d_g @ h.T
        d_h = rec.T @ d_g + d * z
    for k in range(3 * hid):
        d_table[k] = np.bincount(a.ravel(), each[:, k].ravel(), 256)
    return d_table, d_rec


@dataclass
class Model:
    labels: list[str]
    forward: tuple[np.ndarray, np.ndarray]
    backward: tuple[np.ndarray, np.ndarray]
    head: np.ndarray  # (labels, 2H + 1)

    def positions(self, a: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Label probabilities (T, labels, N) of bytes (T, N)."""
        hid = self.forward[1].shape[1]
        fwd, bwd = _gru(a, self.forward, mask), _gru(a[::-1], self.backward, mask[::-1])[::-1]
        p = np.matmul(self.head[:, :hid], fwd) + np.matmul(self.head[:, hid : 2 * hid], bwd) + self.head[:, -1][:, None]
        np.exp(p, out=p)  # states are below 1, so the sums are bounded by the head's weights
        p /= p.sum(1, keepdims=True)
        return p

    def documents(self, texts: pa.Array) -> np.ndarray:
        """Mean label probabilities (texts, labels); 0 for an empty text."""
        total = np.zeros((len(texts), len(self.labels)), np.float64)
        done = 0
        for part in blocks(texts, 1 << 20):
            data, offsets = raw(part)
            size = np.diff(offsets)
            count = -(-size // WINDOW)
            doc = np.repeat(np.arange(len(part)), count)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = offsets[:-1][doc] + nth * WINDOW
            length = np.minimum(WINDOW, offsets[1:][doc] - start)
            order = np.argsort(-length, kind="stable")  # whole windows together need no mask
            doc, start, length = doc[order], start[order], length[order]
            padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
            for i in range(0, len(doc), BATCH):
                s, n = start[i : i + BATCH], length[i : i + BATCH]
                steps = np.arange(n.max())[:, None]
                mask = (steps < n).astype(np.float32)
                p = self.positions(padded[steps + s].astype(np.intp), mask)
                pooled = np.einsum("tkn,tn->nk", p, mask)
                np.add.at(total, done + doc[i : i + BATCH], pooled)
            total[done : done + len(part)] /= np.maximum(size, 1)[:, None]
            done += len(part)
        release()
        return total


def train(rows: list[tuple[bytes, str]], steps: int = STEPS, span: int = 48, batch: int = 128, seed: int = 7) -> Model | None:
    """Adam on the mean cross entropy of every position; labels are drawn evenly. None without rows."""
    rows = [(b, k) for b, k in rows if b]
    if not rows:
        return None
    rng, labels = np.random.default_rng(seed), sorted({k for _, k in rows})
    by = [[np.frombuffer(b, np.uint8) for b, k in rows if k == x] for x in labels]
    unit = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    p = [unit(3 * HIDDEN, 256), unit(3 * HIDDEN, HIDDEN), unit(3 * HIDDEN, 256), unit(3 * HIDDEN, HIDDEN), unit(len(labels), 2 * HIDDEN + 1)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(labels), batch)
        a, mask = np.zeros((span, batch), np.intp), np.zeros((span, batch), np.float32)
        for j, k in enumerate(y):
            doc = by[k][rng.integers(len(by[k]))]
            at = rng.integers(0, max(1, len(doc) - span))
            piece = doc[at : at + span]
            a[: len(piece), j], mask[: len(piece), j] = piece, 1
        kf: list = []
        kb: list = []
        fwd, bwd = _gru(a, (p[0], p[1]), mask, kf), _gru(a[::-1], (p[2], p[3]), mask[::-1], kb)[::-1]
        both = np.concatenate([fwd, bwd, np.ones((span, 1, batch), np.float32)], 1)
        q = np.matmul(p[4], both)
        q = np.exp(q - q.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[:, y, np.arange(batch)] -= 1
        q *= mask[:, None] / mask.sum()
        d_both = np.matmul(p[4].T, q)
        grads = [*_gru_back(a, (p[0], p[1]), mask, kf, d_both[:, :HIDDEN]), *_gru_back(a[::-1], (p[2], p[3]), mask[::-1], kb, d_both[::-1, HIDDEN : 2 * HIDDEN]), np.einsum("tkn,thn->kh", q, both)]
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
        for i, g in enumerate(grads):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            p[i] = (p[i] - 0.03 * (1 - 0.9 * step / steps) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Model(labels, (p[0], p[1]), (p[2], p[3]), p[4])


def sample(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", docs: int = SAMPLE_DOCS, size: int = SAMPLE_BYTES) -> list[tuple[bytes, str]]:
    """At most `docs` rows per label, one span of `size` bytes of each, picked by hash."""
    h = F.xxhash64(F.col(key).cast("string"), F.col(text))
    data = F.encode(F.col(text), "UTF-8")
    at = F.pmod(h, F.greatest(F.octet_length(F.col(text)) - size, F.lit(1))).cast("int") + 1
    picked = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), h.alias("h"), F.substring(data, at, F.lit(size)).alias("b"))
    picked = thin(picked, "h", docs, "label").dropDuplicates(["label", "h"])
    first = picked.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy("h", "b"))).where(F.col("nth") <= docs)
    return sorted((bytes(r.b), r.label) for r in first.select("b", "label").collect())


def predict(model: Model | None, text: Column) -> Column:
    """struct<lang: string, score: double>."""
    if model is None:
        return F.struct(F.lit(UND).alias("lang"), F.lit(0.0).alias("score"))

    @F.arrow_udf("struct<lang: string, score: double>")
    def pooled(texts: pa.Array) -> pa.Array:
        p = model.documents(texts)
        best = p.argmax(1)
        return pa.StructArray.from_arrays([pa.array([model.labels[k] for k in best], pa.string()), pa.array(np.minimum(p[np.arange(len(p)), best], 1.0), pa.float64())], ["lang", "score"])

    seen = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    guess = pooled(text)
    return F.when(seen, guess).otherwise(F.struct(F.lit(UND).alias("lang"), F.lit(0.0).alias("score")))


def held_out(key: Column) -> Column:
    """Rows never learned from: crc32 of the id's text mod 4 is 2 (null id: no)."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame) -> Model | None:
    """From documents' text and non-null lang outside the held-out fold."""
    batch_bytes(docs.sparkSession, "4m")
    return train(sample(docs.where(~held_out(F.col("doc_id")))))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(model, F.col("text")).alias("p")).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
