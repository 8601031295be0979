"""Language identification: averaged hashed subword embeddings with a linear
softmax, trained by stochastic gradient descent in numpy (operator 8).

Subwords are the 2-, 3- and 4-byte strings of the text with A-Z lower-cased and
every byte that is neither a letter nor part of a longer code point read as a
space.  Each is hashed to one of ``BUCKETS`` embeddings; their average over the
whole text goes through a linear softmax.  For scoring, embeddings and softmax
weights are multiplied once, so a text's logits are the mean of table rows.

The training sample holds about ``ROWS_PER_LANG`` rows of each language, by a
hash of doc_id, whole texts.  A fifth of it sets the temperature that calibrates
the probabilities, and the confidence below which a prediction is not accepted
(the level that the least sure ``REJECT`` of its right predictions fall below).

Null text or a text without any Unicode letter: ``und`` with score 0, not
accepted.  Null lang or null doc_id: never learned from.  Without any labelled
row every text is ``und``.  Extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordlab.llm import kernels
from ordlab.llm.common import batch, materialize, narrow
from ordlab.llm.quality import fold

BUCKETS, DIM = 1 << 15, 16
ROWS_PER_LANG = 600
EPOCHS, RATE, SEED = 4, 0.5, 5
REJECT = 0.01
SLICE = 256 << 10

CLASS = np.full(256, 32, np.uint8)
CLASS[97:123] = np.arange(97, 123)
CLASS[65:91] = np.arange(97, 123)
CLASS[128:] = np.arange(128, 256)
LETTER = (CLASS >= 97) & (CLASS < 123)


def subwords(buf: np.ndarray) -> list[np.ndarray]:
    """Bucket of the 2-, 3- and 4-byte string that starts at each byte."""
    x = np.concatenate((CLASS[buf], np.full(3, 32, np.uint8))).astype(np.uint32)
    n, out, h = len(buf), [], x[:len(buf)]
    for j in range(1, 4):
        h = h * np.uint32(0x01000193) ^ x[j:n + j]
        out.append((((h ^ np.uint32(j)) * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64))
    return out


def spaced(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with four spaces after each; the strings that start in a text or at
    the first space after it never span two."""
    size = np.diff(off)
    new = off + 4 * np.arange(len(off))
    out = np.full(new[-1], 32, np.uint8)
    out[np.arange(len(buf)) + np.repeat(new[:-1] - off[:-1], size)] = buf
    return out, new


def logits(buf: np.ndarray, off: np.ndarray, model: dict) -> np.ndarray:
    """Mean of the table rows of all subwords, per text."""
    x, new = spaced(buf, off)
    n = np.diff(off) + 1
    ends = np.stack([new[:-1], new[:-1] + n], 1).ravel()
    total = np.zeros((len(n), len(model["langs"])), np.float64)
    for h in subwords(x):
        total += np.add.reduceat(model["table"][h], ends, axis=0)[::2]
    return total / (3 * n)[:, None] + model["bias"]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[bytes], y: list[str], epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """Embeddings, weights, temperature and the level of acceptance."""
    langs = sorted(set(y))
    if not langs:
        return {"langs": [], "table": np.zeros((BUCKETS, 0), np.float32), "bias": np.zeros(0), "temperature": 1.0, "accept": 1.0}
    rng = np.random.default_rng(seed)
    E = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    W, b = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    label = np.searchsorted(langs, y)
    bags = []
    for t in texts:
        x, _ = spaced(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        ids, n = np.unique(np.concatenate([h[:len(t) + 1] for h in subwords(x)]), return_counts=True)
        bags.append((ids, (n / n.sum()).astype(np.float32)))
    order = rng.permutation(len(bags))
    held, fit = order[:len(order) // 5], order[len(order) // 5:]
    for epoch in range(epochs):
        for i in rng.permutation(fit):
            ids, n = bags[i]
            v = n @ E[ids]
            p = softmax((v @ W + b)[None])[0]
            p[label[i]] -= 1
            rate = RATE * (1 - epoch / epochs)
            back = W @ p
            W -= rate * np.outer(v, p)
            b -= rate * p
            E[ids] -= rate * np.outer(n, back) * min(len(ids), 64)
    model = {"langs": langs, "table": E @ W, "bias": b, "temperature": 1.0, "accept": 0.0}
    if len(held):
        z = np.array([bags[i][1] @ model["table"][bags[i][0]] + b for i in held])
        grid = np.geomspace(0.05, 20, 60)
        model["temperature"] = float(min(grid, key=lambda t: -np.log(softmax(z / t)[np.arange(len(held)), label[held]] + 1e-12).sum()))
        p = softmax(z / model["temperature"])
        right = p.max(1)[p.argmax(1) == label[held]]
        model["accept"] = float(np.quantile(right, REJECT)) if len(right) else 1.0
    return model


def labelled_sample(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang") -> tuple[list[bytes], list[str]]:
    """Training texts and languages, ``rows_per_lang`` of each in expectation."""
    d = narrow(docs, doc_id=id_col, lang=lang_col, text=text_col)
    d = d.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").filter(fold(F.col("doc_id"), 4) != 2)
    per = materialize(d.groupBy("lang").count(), "langid-counts")  # a row per language
    # the draw hangs on id and text, so that rows under one id are drawn one by one; equal rows count once
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED)), F.lit(1 << 40))
    rate = F.least(F.lit(1.0), F.lit(float(rows_per_lang)) / F.col("count")) * float(1 << 40)
    drawn = d.withColumn("u", u).join(per, "lang").filter(F.col("u") < rate)
    rows = sorted(drawn.select("doc_id", "lang", "text").distinct().collect())
    return [r[2].encode() for r in rows], [r[1] for r in rows]


def fit(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> dict:
    return train(*labelled_sample(docs, rows_per_lang))


def has_letter(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text holds a Unicode letter; ASCII letters decide most."""
    n = np.concatenate(([0], np.cumsum(LETTER[buf])))
    out = n[off[1:]] > n[off[:-1]]
    for i in np.flatnonzero(~out & (np.diff(off) > 0)):
        out[i] = any(c.isalpha() for c in buf[off[i]:off[i + 1]].tobytes().decode(errors="replace"))
    return out


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])
    src = narrow(docs, doc_id=F.col(f"`{id_col}`").cast("bigint"), held_out=F.coalesce(fold(F.col(f"`{id_col}`"), 4) == 2, F.lit(True)), text=text_col)
    names = np.array([*model["langs"], "und"], object)

    def run(batches):
        for b in batches:
            for i, buf, off in kernels.slices(b.column(2), SLICE):
                n = len(off) - 1
                ok = has_letter(buf, off) if model["langs"] else np.zeros(n, bool)
                best, p = np.full(n, len(names) - 1), np.zeros(n)
                if ok.any():
                    prob = softmax(logits(buf, off, model) / model["temperature"])
                    best, p = np.where(ok, prob.argmax(1), best), np.where(ok, prob.max(1), 0.0)
                yield batch(schema, b.column(0).slice(i, n), b.column(1).slice(i, n), names[best], p, ok & (p >= model["accept"]))

    return src.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, accepted boolean")
