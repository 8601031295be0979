"""Benchmark decontamination by CGK embeddings and bit-sampling LSH (operator 9).

Texts are sequences of words (lower-cased, white-space separated).  A
document leaks an item if some stretch of it is within ``edits(len(item))`` word
edits (insertions, deletions, substitutions) of the item.

1. Windows of the item's length are taken at every word.  A q-gram count that no
   true match can miss (an edit destroys at most q grams) leaves those windows
   that share enough grams with the item; the others cannot match.
2. The CGK random walk copies a sequence into a longer one: at step ``j`` it
   writes the word under its pointer and moves on if the random bit of (j, word)
   says so.  Sequences at a small edit distance fall into step again, so their
   images have a small Hamming distance.
3. Each of ``tables`` repetitions has its own walk and samples ``SAMPLED`` places
   of the image; equal samples make a candidate.  The number of tables follows
   from collision rates measured on the items themselves with the greatest
   number of edits allowed, so that the chance of missing one such match is at
   most ``1 - RECALL``.  Equal sequences always collide.
4. Candidates are verified by the exact edit distance to the best stretch.

The items are the stated query set, taken in blocks of ``BLOCK`` items, each
block one pass over the documents.

Null text, empty text: no words, no leaks.  Null item text or item without
words: matches nothing.  Items that repeat are found each under its own id.
Null doc_id: kept.  Repeated rows give the same rows again.  Very long texts are
read whole.  Empty tables give no rows.  Extra columns are ignored by
``find_leaks`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordlab.llm import kernels
from ordlab.llm.common import batch, narrow

U = np.uint64
EDIT_SHARE = 0.15
Q, SHORT = 3, 7
SAMPLED, RECALL, BLOCK, SEED = 4, 0.99, 20_000, 13
PAD = U(1)
HASH_BITS = 22


def edits(n: int) -> int:
    return int(EDIT_SHARE * n)


def gram_size(n: int) -> int:
    """Items of fewer than ``SHORT`` words allow no edit and go by single words."""
    return Q if n >= SHORT else 1


def needed(n: int) -> int:
    """Grams that a window of ``n`` words shares with an item at the greatest
    distance: an edit spoils at most q grams and pushes at most one out."""
    q, e = gram_size(n), edits(n)
    return max(1, n - q + 1 - (q + 1) * e)


def grams(h: np.ndarray, q: int) -> np.ndarray:
    """Hash of the ``q`` words from each place on."""
    out = np.full(max(len(h) - q + 1, 0), U(q))
    for j in range(q):
        out = kernels.mix(out * U(0x9FB21C651E98DF25) + h[j:j + len(out)])
    return out


def lower(col: pa.Array) -> pa.Array:
    return pc.utf8_lower(col)


def words(text: str | None) -> np.ndarray:
    buf, off = kernels.text_arrays(lower(pa.array([text], pa.string())))
    return kernels.word_hashes(buf, off)[0]


def samples(n: int, tables: int) -> np.ndarray:
    """Sampled places of the image of ``n`` words, for each table."""
    rng = np.random.default_rng([SEED, n])
    return np.array([np.sort(rng.choice(2 * n, min(SAMPLED, 2 * n), replace=False)) for _ in range(tables)])


def signatures(w: np.ndarray, places: np.ndarray) -> np.ndarray:
    """LSH keys (rows, tables) of sequences of words (rows, n): the CGK walk of
    each table, read at that table's places."""
    rows, n = w.shape
    tables = np.arange(len(places))
    padded = np.concatenate([w, np.full((rows, 1), PAD)], 1)
    r, at = np.arange(rows)[:, None], np.zeros((rows, len(places)), np.int64)
    key = np.tile(tables.astype(U), (rows, 1))
    for j in range(int(places.max()) + 1):
        if j % 64 == 0:  # 64 random bits of each word and table, for 64 steps
            seeds = (tables * 1000 + (SEED + j // 64)).astype(U) * U(0xD6E8FEB86659FD93)
            bits = kernels.mix(padded[:, None, :] + seeds[None, :, None])
        read = np.flatnonzero((places == j).any(1))
        if len(read):
            key[:, read] = kernels.mix(key[:, read] * U(0x9FB21C651E98DF25) + padded[r, at[:, read]])
        at += (bits[r, tables, at] >> U(j % 64) & U(1)).astype(np.int64)
        np.minimum(at, n, out=at)
    return key


def edited(w: np.ndarray, e: int, rng) -> np.ndarray:
    """The sequence after ``e`` random edits, followed by foreign words."""
    x = list(w)
    for _ in range(e):
        i, what = int(rng.integers(len(x))), rng.integers(3)
        if what == 0:
            x[i] = U(rng.integers(2, 1 << 62))
        elif what == 1:
            x.insert(i, U(rng.integers(2, 1 << 62)))
        elif len(x) > 1:
            del x[i]
    x += [U(v) for v in rng.integers(2, 1 << 62, e + 1)]
    return np.array(x[:len(w)], U)


def tables_needed(items: list[np.ndarray], recall: float = RECALL, trials: int = 300, probe: int = 24) -> int:
    """Tables for which a match with the greatest number of edits is missed with
    a probability of at most ``1 - recall``, by measured collisions."""
    rng = np.random.default_rng(SEED)
    some = [w for w in items if edits(len(w))]
    if not some:
        return 1
    hits = []
    for k in rng.integers(len(some), size=trials):
        w = some[k]
        s = signatures(np.stack([w, edited(w, edits(len(w)), rng)]), samples(len(w), probe))
        hits.append((s[0] == s[1]).mean())
    p, k = np.array(hits), 1
    while np.mean((1 - np.clip(p, 0.5 / probe, 1)) ** k) > 1 - recall:
        k += 1
    return k


def distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of ``item`` to a stretch of ``region``; its bounds."""
    m = len(region)
    cost, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    at = np.arange(m + 1)
    for i in range(len(item)):
        new = np.empty(m + 1, np.int64)
        new[0] = i + 1
        up, diag = cost[1:] + 1, cost[:-1] + (region != item[i])
        new[1:] = np.minimum(up, diag)
        s = np.concatenate(([0], np.where(diag <= up, start[:-1], start[1:])))
        # insertions run along the row: the best earlier cell plus the way from it
        lead = new - at
        best = np.minimum.accumulate(lead)
        src = np.maximum.accumulate(np.where(lead == best, at, 0))
        cost, start = best + at, s[src]
    j = int(cost.argmin())
    return int(cost[j]), int(start[j]), j


class Items:
    """A block of items: their grams and, by length, their LSH keys."""

    def __init__(self, rows: list[tuple]):
        self.items = [(i, w) for i, w in ((r[0], words(r[1])) for r in rows) if len(w)]
        self.tables = tables_needed([w for _, w in self.items])
        self.grams: dict[int, dict[int, list[int]]] = {}
        self.places, self.keys = {}, defaultdict(list)
        for k, (_, w) in enumerate(self.items):
            q = gram_size(len(w))
            table = self.grams.setdefault(q, defaultdict(list))
            for g in np.unique(grams(w, q)).tolist():
                table[g].append(k)
        self.bits = {}
        for q, table in self.grams.items():
            self.bits[q] = np.zeros(1 << HASH_BITS, bool)
            self.bits[q][np.fromiter(table, U, len(table)) & U((1 << HASH_BITS) - 1)] = True
        for n in sorted({len(w) for _, w in self.items}):
            self.places[n] = samples(n, self.tables)
        self.signature = [signatures(w[None], self.places[len(w)])[0] for _, w in self.items]

    def leaks(self, h: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, distance, first word, end word) of each leak in one document."""
        out, places = [], defaultdict(list)
        for q, table in self.grams.items():
            g = grams(h, q)
            for at in np.flatnonzero(self.bits[q][g & U((1 << HASH_BITS) - 1)]):
                for k in table.get(int(g[at]), ()):
                    places[k].append(int(at))
        for k, at in places.items():
            w = self.items[k][1]
            n = len(w)
            if len(at) < needed(n):
                continue
            count = np.zeros(len(h) + 1, np.int64)
            count[np.array(at) + 1] = 1
            count = np.cumsum(count)
            s = np.arange(len(h))
            starts = np.flatnonzero(count[np.minimum(s + n - gram_size(n) + 1, len(h))] - count[s] >= needed(n))
            if not len(starts):
                continue
            hit = []
            for i in range(0, len(starts), 128):
                part = starts[i:i + 128]
                idx = part[:, None] + np.arange(n)
                win = np.where(idx < len(h), h[np.minimum(idx, len(h) - 1)], PAD)
                hit.append(part[(signatures(win, self.places[n]) == self.signature[k]).any(1)])
            hit, e = np.concatenate(hit), edits(n)
            for group in np.split(hit, np.flatnonzero(np.diff(hit) > n) + 1) if len(hit) else ():
                a, b = max(0, int(group[0]) - e), min(len(h), int(group[-1]) + n + e)
                d, x, y = distance(w, h[a:b])
                if d <= e:
                    out.append((k, d, a + x, a + y))
        return out

    def scan(self, col: pa.Array):
        """Yield (row, item id, distance, first word, end word) of a text column."""
        least = min((needed(len(w)) for _, w in self.items), default=1)
        for i, buf, off in kernels.slices(lower(col)):
            h, doc = kernels.word_hashes(buf, off)
            maybe = np.zeros(len(h), bool)
            for q in self.grams:
                g = grams(h, q)
                maybe[:len(g)] |= self.bits[q][g & U((1 << HASH_BITS) - 1)]
            n = np.bincount(doc[maybe], minlength=len(off) - 1)
            first = np.searchsorted(doc, np.arange(len(off)))
            for k in np.flatnonzero(n >= least):
                for item, d, x, y in self.leaks(h[first[k]:first[k + 1]]):
                    yield i + int(k), self.items[item][0], d, x, y


def blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """The query set, a bounded block of items at a time."""
    held = []
    for r in narrow(benchmark, i=F.col(f"`{id_col}`").cast("bigint"), t=text_col).filter("t IS NOT NULL").toLocalIterator():
        held.append((r[0], r[1]))
        if len(held) == BLOCK:
            yield Items(held)
            held = []
    if held:
        yield Items(held)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, start_word, end_word), a row per leak."""
    spark = docs.sparkSession
    src = narrow(docs, doc_id=F.col(f"`{id_col}`").cast("bigint"), text=text_col)
    ddl = "doc_id bigint, item_id bigint, distance int, start_word bigint, end_word bigint"
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start_word", pa.int64()), ("end_word", pa.int64())])
    out = spark.createDataFrame([], ddl)
    for items in blocks(benchmark, item_col, item_text_col):
        bc = spark.sparkContext.broadcast(items)  # BLOCK items at most

        def run(batches, bc=bc):
            for b in batches:
                rows = list(bc.value.scan(b.column(1)))
                if rows:
                    k, *rest = zip(*rows)
                    yield batch(schema, b.column(0).take(pa.array(k)), *rest)

        out = out.unionByName(src.mapInArrow(run, ddl))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those that leak an item."""
    col = docs.columns.index(text_col)
    for items in blocks(benchmark, item_col, item_text_col):
        bc = docs.sparkSession.sparkContext.broadcast(items)  # BLOCK items at most

        def run(batches, bc=bc):
            for b in batches:
                keep = np.ones(len(b), bool)
                keep[[r[0] for r in bc.value.scan(b.column(col))]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
