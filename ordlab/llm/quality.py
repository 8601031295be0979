"""Quality classifier: a byte-level convolutional network in numpy (operator 5).

A text is cut into blocks of 64 bytes; a chunk is four blocks and the next chunk
starts two blocks later, so chunks overlap by half and together cover the whole
text.  Each of ``FILTERS`` learned filters reads ``WIDTH`` bytes (a table of
weights for each byte value at each place) at every second byte; a chunk's
feature is the largest response inside it, after a rectifier.  The mean and the
maximum of each feature over all chunks give one probability by a logistic unit.

Training is Adam on the driver over a sample of labelled rows of ``train_rows``
in expectation, chosen by a hash of doc_id, whole texts.  Only text is an input
of a score.  Scoring runs over Arrow batches in slices of a few hundred KB.

Null or empty text: one block of zero bytes, so the score of no evidence.  Null
doc_id: held out and scored.  Labels that are null, repeated or of unknown
documents: null ones are dropped, each other row counts.  Without any label of
either kind every score is 0.5.  Extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordlab.llm import kernels
from ordlab.llm.common import batch, materialize, narrow

WIDTH, FILTERS, STRIDE = 8, 16, 2
BLOCK, CHUNK, HOP = 64, 4, 2  # bytes, blocks, blocks
TRAIN_ROWS = 3000
THRESHOLD = 0.3
EPOCHS, STEPS, RATE, SEED = 6, 400, 0.01, 11  # at least EPOCHS passes and STEPS steps of 32 texts
SLICE = 256 << 10


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % n


def blocks(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid out in whole blocks with at least ``WIDTH`` zero bytes after
    each; and the first block of each text (one more at the end)."""
    size = np.diff(off)
    first = np.concatenate(([0], np.cumsum((size + WIDTH + BLOCK - 1) // BLOCK)))
    out = np.zeros(first[-1] * BLOCK + WIDTH, np.uint8)
    out[np.arange(len(buf)) + np.repeat(first[:-1] * BLOCK - off[:-1], size)] = buf
    return out, first


def responses(x: np.ndarray, table: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Filter responses, (blocks, places in a block, filters); places whose
    bytes run past a text's last block (they start behind the text) are out."""
    n = (len(x) - WIDTH) // STRIDE
    out = table[0][x[0:n * STRIDE:STRIDE]]
    for j in range(1, WIDTH):
        out += table[j][x[j:j + n * STRIDE:STRIDE]]
    out = out.reshape(-1, BLOCK // STRIDE, table.shape[2])
    out[first[1:] - 1, (BLOCK - WIDTH) // STRIDE + 1:] = -np.inf
    return out


def chunk_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first block of each chunk, first chunk of each text)."""
    n = np.maximum((np.diff(first) - CHUNK + HOP - 1) // HOP + 1, 1)
    start = np.concatenate(([0], np.cumsum(n)))
    at = (np.arange(start[-1]) - np.repeat(start[:-1], n)) * HOP + np.repeat(first[:-1], n)
    return at, start


def chunk_max(m: np.ndarray, at: np.ndarray, start: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Maximum over the blocks of each chunk, never past the text's end."""
    last = np.repeat(first[1:], np.diff(start)) - 1
    out = m[at]
    for j in range(1, CHUNK):
        np.maximum(out, m[np.minimum(at + j, last)], out=out)
    return out


def features(buf: np.ndarray, off: np.ndarray, model: dict) -> np.ndarray:
    """Mean and maximum over chunks of each pooled filter, per text."""
    x, first = blocks(buf, off)
    m = responses(x, model["table"], first).max(1)
    at, start = chunk_of(first)
    a = np.maximum(chunk_max(m, at, start, first) + model["bias"], 0)
    mean = np.add.reduceat(a, start[:-1], axis=0) / np.diff(start)[:, None]
    return np.concatenate([mean, np.maximum.reduceat(a, start[:-1], axis=0)], 1)


def probability(buf: np.ndarray, off: np.ndarray, model: dict) -> np.ndarray:
    if len(off) < 2:
        return np.zeros(0)
    z = features(buf, off, model) @ model["w"] + model["w0"]
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def train(texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """Fit by Adam; the gradient of a maximum goes to the place that gave it."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    p = {"table": rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(f32), "bias": np.zeros(FILTERS, f32),
         "w": rng.normal(0, 0.3, 2 * FILTERS).astype(f32), "w0": np.zeros((), f32)}
    y = np.asarray(y, f32)
    if not len(y) or y.min() == y.max():
        return p | {"w": np.zeros(2 * FILTERS, f32)}
    p["w0"] = f32(np.log(y.mean() / (1 - y.mean())))
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    step, epochs = 0, max(epochs, -(-STEPS * 32 // len(texts)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(texts))
        for i in range(0, len(order), 32):
            rows = order[i:i + 32]
            part = [texts[r] for r in rows]
            off = np.concatenate(([0], np.cumsum([len(t) for t in part])))
            x, first = blocks(np.frombuffer(b"".join(part), np.uint8), off)
            r = responses(x, p["table"], first)
            place = r.argmax(1)
            m = np.take_along_axis(r, place[:, None], 1)[:, 0]
            at, start = chunk_of(first)
            doc = np.repeat(np.arange(len(rows)), np.diff(start))
            last = first[1:][doc] - 1
            cand = np.minimum(at[:, None] + np.arange(CHUNK), last[:, None])
            best = m[cand].argmax(1)
            block = np.take_along_axis(cand, best, 1)  # (chunks, filters)
            cols = np.arange(FILTERS)
            pre = m[block, cols] + p["bias"]
            a = np.maximum(pre, 0)
            mean = np.add.reduceat(a, start[:-1], axis=0) / np.diff(start)[:, None]
            top = np.maximum.reduceat(a, start[:-1], axis=0)
            h = np.concatenate([mean, top], 1)
            z = h @ p["w"] + p["w0"]
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            is_top = (a == top[doc]) & (a > 0)
            share = is_top / np.maximum(np.add.reduceat(is_top.astype(f32), start[:-1], axis=0), 1)[doc]
            g = d[doc][:, None] * (p["w"][:FILTERS] / np.diff(start)[doc][:, None] + p["w"][FILTERS:] * share) * (pre > 0)
            where = (block * (BLOCK // STRIDE) + place[block, cols]) * STRIDE
            grad = {"w": h.T @ d + f32(1e-4) * p["w"], "w0": d.sum(), "bias": g.sum(0)}
            t = np.empty_like(p["table"])
            for j in range(WIDTH):
                key = x[where + j].astype(np.int64) * FILTERS + cols
                t[j] = np.bincount(key.ravel(), g.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            grad["table"] = t + f32(1e-5) * p["table"]
            step += 1
            for k in p:
                m1[k] = 0.9 * m1[k] + 0.1 * grad[k]
                m2[k] = 0.999 * m2[k] + 0.001 * np.square(grad[k])
                p[k] = (p[k] - rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)).astype(f32)
    return p


def labelled_sample(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id",
                    text_col: str = "text", label_col: str = "quality") -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of the training fold: all of it if it has at most
    ``train_rows`` rows, else a hash sample of that size in expectation."""
    lab = narrow(labels, doc_id="doc_id", y=F.col(label_col).cast("int")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    lab = lab.filter(fold(F.col("doc_id"), 5) != 0)
    lab = materialize(lab.distinct(), "quality-labels")
    d = narrow(docs, doc_id=id_col, text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    n = d.select("doc_id").join(lab, "doc_id").count()
    if not n:
        return [], np.zeros(0)
    # the draw hangs on id and text, so that rows under one id are drawn one by one; equal rows count once
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, train_rows / n))
    rows = sorted(d.filter(draw).join(lab, "doc_id").select("doc_id", "text", "y").distinct().collect())  # train_rows in expectation
    return [r[1].encode() for r in rows], np.array([r[2] for r in rows], np.float32)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])
    src = narrow(docs, doc_id=F.col(f"`{id_col}`").cast("bigint"), held_out=F.coalesce(fold(F.col(f"`{id_col}`"), 5) == 0, F.lit(True)), text=text_col)

    def run(batches):
        for b in batches:
            for i, buf, off in kernels.slices(b.column(2), SLICE):
                n = len(off) - 1
                yield batch(schema, b.column(0).slice(i, n), b.column(1).slice(i, n), probability(buf, off, model))

    out = src.mapInArrow(run, "doc_id bigint, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    return train(*labelled_sample(docs, labels, train_rows))


def keep_good(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold."""
    col = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            for i, buf, off in kernels.slices(b.column(col), SLICE):
                yield b.slice(i, len(off) - 1).filter(pa.array(probability(buf, off, model) >= threshold))

    return docs.mapInArrow(run, docs.schema)
