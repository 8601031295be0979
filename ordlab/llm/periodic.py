"""Runs of periodic repetition in the words of a text (operator 12).

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) and at least max(6, 4q) words, which no neighbouring word
extends.  A word is dropped if a run holds it after that run's first q words.

1. Words become numbers; equal numbers mean equal bytes.
2. Recursive frequency splitting, for all texts of a slice at once: in a run
   every word stands four times or more, so a word that stands less often within
   its segment belongs to no run and splits the segment.  The parts are split
   again until nothing changes; parts of fewer than six words go.
3. Lag scan of what is left.  A run of period q holds three pairs of equal words
   in a row at places that are multiples of q, so lag q needs one look at every
   q-th word (n ln n looks in all).  A prefix hash thins the candidates (equal
   words always pass), and words themselves decide.

Nothing is shuffled; a text is held by one task, whose work does not depend on
other texts.

Null or empty text, or one without words: no runs, an empty collapsed text.
Very long texts: whole, a slice of their own.  Null or repeated ids: a row
each.  Empty table: no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordlab.llm import kernels
from ordlab.llm.common import narrow

U = np.uint64
LEAST_WORDS, LEAST_TIMES = 6, 4
SLICE = 4 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
SPARK_SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and a number for its bytes."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    gap = kernels.SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(~gap & (np.concatenate(([True], gap[:-1])) | edge[:-1]))
    end = np.flatnonzero(~gap & (np.concatenate((gap[1:], [True])) | edge[1:])) + 1
    at = np.concatenate(([0], np.cumsum(end - start)))
    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(buf[~gap])])
    return start, end, packed.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def segments(word: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [a, b) of words that rare words do not split any more.
    ``part`` numbers the texts; segments never cross from one to the next."""
    at = np.arange(len(word))
    while len(at):
        _, group, times = np.unique(part * (int(word.max()) + 1) + word[at], return_inverse=True, return_counts=True)
        keep = times[group] >= LEAST_TIMES
        left, left_part = at[keep], part[keep]
        new = np.cumsum(np.concatenate(([True], (np.diff(left) != 1) | (np.diff(left_part) != 0)))) - 1 if len(left) else left
        long = np.bincount(new)[new] >= LEAST_WORDS if len(left) else keep[:0]
        if keep.all() and long.all():
            break
        at, part = left[long], new[long]
    if not len(at):
        return []
    first = np.flatnonzero(np.concatenate(([True], np.diff(part) != 0)))
    return list(zip(at[first].tolist(), (at[np.append(first[1:], len(at)) - 1] + 1).tolist()))


def agree(w: np.ndarray, i: int, q: int, step: int) -> int:
    """How many words from ``i`` on (``step`` 1), or before it (-1), equal the word q later."""
    n, size = 0, 16
    while True:
        if step > 0:
            a = w[i + n:min(i + n + size, len(w) - q)]
            b = w[i + n + q:i + n + q + len(a)]
        else:
            lo = max(i - n - size, 0)
            a, b = w[lo:i - n][::-1], w[lo + q:i - n + q][::-1]
        miss = np.flatnonzero(a != b)
        if len(miss):
            return n + int(miss[0])
        n += len(a)
        if len(a) < size:
            return n
        size *= 2


def lag_scan(w: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of one segment of word numbers."""
    n = len(w)
    power = np.full(n + 1, kernels._BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(kernels.mix(w.astype(np.uint64) + U(1)) * power[:-1], dtype=np.uint64)))
    found: list[tuple[int, int, int]] = []
    by_period: dict[int, np.ndarray] = {}  # start and end of its runs, in order
    for q in range(1, n // LEAST_TIMES + 1):
        x = w[::q]
        same = x[1:] == x[:-1]
        j = np.flatnonzero(same[2:] & same[1:-1] & same[:-2]) * q
        if len(j):
            # the words [j, j+2q) equal those q later: necessary, seen by hash
            j = j[(total[j + 2 * q] - total[j]) * power[q] == total[j + 3 * q] - total[j + q]]
        for p, runs in by_period.items():
            if not len(j):
                break
            if q % p == 0:  # within a run of a period that divides q, lag q finds that run again
                i = np.searchsorted(runs[:, 0], j, "right") - 1
                j = j[(i < 0) | (j + 3 * q >= runs[i, 1])]
        past, new = -1, []
        for a in j.tolist():
            if a < past:
                continue
            s = a - agree(w, a, q, -1)
            e = a + agree(w, a, q, 1) + q
            past = e - 3 * q  # a later candidate of this stretch lies before it
            if e - s >= max(LEAST_WORDS, LEAST_TIMES * q):
                new.append((s, e))
        if new:
            by_period[q] = np.array(new)
            found += [(s, e - s, q) for s, e in new]
    return found


def runs_of(word: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs of the texts of a slice, by start and period; starts count over the slice."""
    return sorted(((a + s, n, q) for a, b in segments(word, doc) for s, n, q in lag_scan(word[a:b])), key=lambda r: (r[0], r[2]))


def join_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[bytes, np.ndarray]:
    """The words of each text joined by one space, and the place where each text begins."""
    size = end - start
    space = np.append(doc[1:] == doc[:-1], False).astype(np.int64) if len(doc) else size
    total = size + space
    done = np.cumsum(total)
    padded = np.append(buf, np.uint8(0x20))
    take = np.arange(int(total.sum())) + np.repeat(start - (done - total), total)
    take[(done - 1)[space > 0]] = len(buf)
    return padded[take].tobytes(), np.concatenate(([0], done))[np.searchsorted(doc, np.arange(n_docs + 1))]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every document: its runs by start,
    then period, and the kept words joined by one space."""

    def run(batches):
        for b in batches:
            for i, buf, off in kernels.slices(b.column(1), SLICE):
                n = len(off) - 1
                start, end, word = words_of(buf, off)
                doc = np.searchsorted(off, start, "right") - 1
                first = np.searchsorted(doc, np.arange(n + 1))
                drop = np.zeros(len(word) + 1, np.int64)
                runs: list[list] = [[] for _ in range(n)]
                for s, length, q in runs_of(word, doc):
                    d = int(doc[s])
                    runs[d].append({"start": s - int(first[d]), "length": length, "period": q})
                    drop[s + q] += 1
                    drop[s + length] -= 1
                keep = np.cumsum(drop)[:-1] == 0
                raw, at = join_words(buf, start[keep], end[keep], doc[keep], n)
                text = [raw[x:y].decode() for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), pa.array(np.diff(first)), pa.array(runs, SCHEMA.field(2).type),
                                                  pa.array(text, pa.string())], schema=SCHEMA)

    src = narrow(docs, doc_id=F.col(f"`{id_col}`").cast("bigint"), text=text_col)
    return src.mapInArrow(run, SPARK_SCHEMA)


def with_planted_run(doc_id: Column, text: Column) -> Column:
    """Text of a document in whose tail a run is planted, for the tenth of the
    documents that crc32(doc_id) picks: word i >= a becomes word a + (i-a) % p.
    Other texts, and those of null ids, stay as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    a = (g % n).cast("int")
    times = (F.lit(3) + g % 8).cast("int")
    p = (F.floor((n - a) / times) + 1).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.concat_ws(" ", F.slice(F.concat(F.slice(words, F.lit(1), a), tail), F.lit(1), n))
    return F.when((h % 10 == 0) & (n > 0), planted).otherwise(text)


def summary(docs: DataFrame) -> DataFrame:
    """``find_runs`` over the documents with planted runs, as counts, the run of
    greatest exponent (exact; ties: smallest start, then period) and digests."""
    found = find_runs(narrow(docs, doc_id="doc_id", text=with_planted_run(F.col("`doc_id`"), F.col("`text`"))))
    best = F.aggregate("runs", F.element_at("runs", 1), lambda b, r: F.when(r.length * b.period > b.length * r.period, r).otherwise(b))
    best = F.when(F.size("runs") > 0, best)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start"), F.col("best.length"), F.col("best.period"),
        F.expr("1000 * best.length div best.period").cast("bigint").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
