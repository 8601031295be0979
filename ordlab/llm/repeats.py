"""Removal of repeated byte windows by a depth-limited radix sort of suffixes
(operator 7).

Two equal windows of ``length`` bytes hold equal least-hash grams of ``gram``
bytes at equal places, so only suffixes that start at such a gram (an anchor)
need sorting, and only through the window.  The passes go from the most
significant digit on:

1. The first digit is the anchor gram.  Anchors that occur once in all documents
   are settled: their windows occur once.  A bitmap of fixed size of the others
   spares most settled suffixes the shuffle; an exact join follows it.
2. The second digit is the whole stretch of bytes that shares an anchor (its
   run).  Equal runs are settled: all their windows repeat.
3. Runs with equal anchors and different bytes are compared by the last digit,
   the windows themselves.  A small bucket is finished inside one task, one of
   more than ``local`` different runs by a distributed aggregate over window
   hashes.  Equal groups are exactly the repeated windows.

Digits are compared by 64-bit hashes, two of them (128 bits) wherever equality
decides.  Matches never cross documents.  Spans are joined back to the texts.

Null text: empty.  Texts below ``length`` bytes: nothing removed, though nothing
can match them either.  Rows that repeat a doc_id are one document each, told
apart by a checksum of the text; repeated rows repeat each other.  Null doc_id:
kept.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordlab.llm import kernels
from ordlab.llm.common import batch, bitmap, hits, narrow, pin, shuffle_partitions

U = np.uint64
LENGTH, GRAM = 200, 64
LOCAL = 4096
SLICE = 512 << 10
HIGH = U(0xFFFFFFFF00000000)


def runs(buf: np.ndarray, off: np.ndarray, length: int, gram: int):
    """Maximal stretches of window starts with a common anchor.

    Returns (text, first start, number of starts, anchor place after the first
    start, anchor hash, run hash); starts count from the text's first byte."""
    n, w = len(buf), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.view(U), none.view(U)
    c = kernels.prefix_hash(buf)
    _, inv = kernels.powers(n + 1)
    h = kernels.mix((c[gram:] - c[:-gram]) * inv[:n - gram + 1])
    v, width = (h & HIGH) | np.arange(len(h), dtype=U), 1
    while width * 2 <= w:
        v, width = np.minimum(v[:-width], v[width:]), width * 2
    m = n - length + 1
    if w > width:
        v = np.minimum(v[:m], v[w - width:w - width + m])
    p = (v & U(0xFFFFFFFF)).astype(np.int64)
    ok = np.ones(m, bool)
    for e in off[1:-1]:
        ok[max(0, e - length + 1):e] = False
    change = p[1:] != p[:-1]
    first, last = ok.copy(), ok.copy()
    first[1:] &= change | ~ok[:-1]
    last[:-1] &= change | ~ok[1:]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    doc = np.searchsorted(off, a, "right") - 1
    return doc, a - off[doc], b - a + 1, p[a] - a, h[p[a]], kernels.span_hash(c, a, b + length)


def pack(a, n, at):
    """Start, number of starts and anchor place in one integer."""
    return (a << 20) | (n << 10) | at


def unpack(pos):
    return pos >> 20, (pos >> 10) & 1023, pos & 1023


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return narrow(docs, doc_id=F.col(f"`{id_col}`").cast("bigint"), crc=F.crc32(F.encode(t, "UTF-8")), text=t)


def suffixes(src: DataFrame, length: int, gram: int, only_anchor: bool, bits=None) -> DataFrame:
    """Anchors of all windows; with ``bits`` those that its bitmap lets pass."""
    fields = [("anchor", pa.int64())] if only_anchor else [("doc_id", pa.int64()), ("crc", pa.int64()), ("pos", pa.int64()), ("anchor", pa.int64()), ("seg", pa.int64())]
    schema = pa.schema(fields)

    def run(batches):
        for b in batches:
            for i, buf, off in kernels.slices(b.column(2), SLICE):
                doc, a, n, at, anchor, seg = runs(buf, off, length, gram)
                if bits is not None:
                    keep = np.flatnonzero(hits(bits, anchor))
                    doc, a, n, at, anchor, seg = doc[keep], a[keep], n[keep], at[keep], anchor[keep], seg[keep]
                if only_anchor:
                    yield batch(schema, anchor.view(np.int64))
                else:
                    k = pa.array(doc + i)
                    yield batch(schema, b.column(0).take(k), b.column(1).take(k), pack(a, n, at), anchor.view(np.int64), seg.view(np.int64))

    return src.mapInArrow(run, ", ".join(f"{k} bigint" for k, _ in fields))


def windows(ctx: list[bytes], n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, hash) of every window of every run."""
    size = np.array([len(x) for x in ctx])
    first = np.cumsum(size) - size
    c = kernels.prefix_hash(np.frombuffer(b"".join(ctx), np.uint8))
    run = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + first[run]
    return run, kernels.span_hash(c, at, at + length)


def stretches(flag: np.ndarray, run: np.ndarray, n: np.ndarray):
    """(run, from, to) of the stretches of set flags inside each run."""
    cut = run[1:] != run[:-1]
    up, down = flag.copy(), flag.copy()
    up[1:] &= ~flag[:-1] | cut
    down[:-1] &= ~flag[1:] | cut
    a, b = np.flatnonzero(up), np.flatnonzero(down) + 1
    base = (np.cumsum(n) - n)[run[a]]
    return run[a], a - base, b - base


SPANS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
RESOLVED = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("spans", SPANS)])
RESOLVED_DDL = "anchor bigint, seg bigint, spans array<struct<s: bigint, e: bigint>>"


def finish(anchor, seg, pos, copies, ctx, length):
    """Last digit of whole buckets: the window spans that repeat, per run."""
    n = unpack(pos)[1]
    run, h = windows(ctx, n, length)
    key = kernels.mix(kernels.mix(anchor.view(U))[run] + h)
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    which, s, e = stretches((count[inverse] > 1) | (copies[run] > 1), run, n)
    rows: list[list] = [[] for _ in anchor]
    for k, x, y in zip(which.tolist(), s.tolist(), e.tolist()):
        rows[k].append({"s": x, "e": y})
    return batch(RESOLVED, anchor, seg, rows)


def finish_sorted(length: int):
    """Task function over rows sorted by anchor: ``finish`` bucket after bucket."""

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks().to_batches()
            if not t:
                continue
            held, anchors = t[0], t[0].column(0).to_numpy()
            cut = int(np.searchsorted(anchors, anchors[-1]))  # the last bucket may go on
            for part in ([held.slice(0, cut)] if cut else []):
                yield finish(*[part.column(k).to_numpy() for k in range(4)], part.column(4).to_pylist(), length)
            held = held.slice(cut)
        if held is not None and len(held):
            yield finish(*[held.column(k).to_numpy() for k in range(4)], held.column(4).to_pylist(), length)

    return run


def contexts(src: DataFrame, variants: DataFrame, length: int) -> DataFrame:
    """The bytes of one example of each run."""
    per_doc = variants.groupBy(F.col("ex.doc_id").alias("__d"), F.col("ex.crc").alias("__c")).agg(
        F.collect_list(F.struct(F.col("ex.pos").alias("pos"), "anchor", "seg", "copies", "variants")).alias("want"))
    j = src.join(per_doc, src["doc_id"].eqNullSafe(F.col("__d")) & (src["crc"] == F.col("__c"))).select("text", "want")
    names = ("anchor", "seg", "pos", "copies", "variants")
    schema = pa.schema([(k, pa.int64()) for k in names] + [("ctx", pa.binary())])

    def run(batches):
        for b in batches:
            for i, buf, off in kernels.slices(b.column(0), SLICE):
                rows, raw = [], buf.tobytes()
                for k, want in enumerate(b.column(1).slice(i, len(off) - 1).to_pylist()):
                    for x in want:
                        a, n, _ = unpack(x["pos"])
                        x["ctx"] = raw[off[k] + a:off[k] + a + n - 1 + length]
                        rows.append(x)
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # repeated rows of a document would give an example twice
    return j.mapInArrow(run, ", ".join(f"{k} bigint" for k in names) + ", ctx binary").dropDuplicates(["anchor", "seg"])


def finish_large(ctx: DataFrame, length: int) -> DataFrame:
    """Last digit of large buckets: count each window hash over the cluster."""
    schema = pa.schema([(k, pa.int64()) for k in ("anchor", "seg", "at", "copies", "h")])

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 512):
                p = b.slice(i, 512)
                anchor, seg, pos, copies = [p.column(k).to_numpy() for k in range(4)]
                n = unpack(pos)[1]
                which, h = windows(p.column(4).to_pylist(), n, length)
                at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                yield batch(schema, anchor[which], seg[which], at, copies[which], h.view(np.int64))

    w = pin(ctx.mapInArrow(run, ", ".join(f"{k} bigint" for k in schema.names)), "repeat-windows")
    again = w.groupBy("anchor", "h").agg(F.sum("copies").alias("c")).filter("c > 1").drop("c")
    hit = w.join(again, ["anchor", "h"], "left_semi")
    # a window start is a span of its own; the spans of a text are merged later
    return hit.groupBy("anchor", "seg").agg(F.collect_list(F.struct(F.col("at").alias("s"), (F.col("at") + 1).alias("e"))).alias("spans"))


def repeated_spans(src: DataFrame, length: int = LENGTH, gram: int = GRAM, local: int = LOCAL) -> DataFrame:
    """(doc_id, crc, spans) with the byte spans covered by repeated windows."""
    spark = src.sparkSession
    first = suffixes(src, length, gram, True)
    again = pin(first.groupBy("anchor").count().filter("count > 1").select("anchor"), "repeat-anchors")
    occ = pin(suffixes(src, length, gram, False, bitmap(again, "anchor")).join(again, "anchor", "left_semi"), "repeat-runs")
    var = occ.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "crc", "pos")).alias("ex"))
    var = pin(var, "repeat-variants")
    many = var.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants"))
    var = var.join(many, "anchor")
    alone = var.filter("variants = 1").select("anchor", "seg", F.array(F.struct(
        F.lit(0).cast("bigint").alias("s"), F.shiftright("ex.pos", 10).bitwiseAND(F.lit(1023)).alias("e"))).alias("spans"))
    ctx = pin(contexts(src, var.filter("variants > 1"), length), "repeat-contexts")
    cols = ["anchor", "seg", "pos", "copies", "ctx"]
    small = (ctx.filter(F.col("variants") <= local).select(*cols).repartition(shuffle_partitions(spark), "anchor")
             .sortWithinPartitions("anchor").mapInArrow(finish_sorted(length), RESOLVED_DDL))
    solved = small.unionByName(finish_large(ctx.filter(F.col("variants") > local).select(*cols), length)).unionByName(alone)
    solved = pin(solved.filter(F.size("spans") > 0), "repeat-solved")
    a = F.shiftright("pos", 20)
    spans = occ.join(solved, ["anchor", "seg"]).select("doc_id", "crc", F.transform("spans", lambda x: F.struct(
        (a + x["s"]).alias("s"), (a + x["e"] - 1 + length).alias("e"))).alias("spans"))
    return spans.groupBy("doc_id", "crc").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, local: int = LOCAL, with_kept: bool = False,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every document."""
    src = keyed(docs, id_col, text_col)
    sp = repeated_spans(src, length, gram, local).select(F.col("doc_id").alias("__d"), F.col("crc").alias("__c"), "spans")
    j = src.join(sp, src["doc_id"].eqNullSafe(F.col("__d")) & (src["crc"] == F.col("__c")), "left").select("doc_id", "text", "spans")
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept", pa.binary())] * with_kept)

    def run(batches):
        for b in batches:
            for i, buf, off in kernels.slices(b.column(1), SLICE):
                rows = []
                for k, spans in enumerate(b.column(2).slice(i, len(off) - 1)):
                    x, n = buf[off[k]:off[k + 1]], int(off[k + 1] - off[k])
                    gone = spans_n = 0
                    if spans.is_valid:
                        f = spans.values.flatten()
                        edge = np.zeros(n + 1, np.int32)
                        np.add.at(edge, f[0].to_numpy(), 1)
                        np.add.at(edge, f[1].to_numpy(), -1)
                        cover = np.cumsum(edge[:n]) > 0
                        gone, spans_n = int(cover.sum()), int((cover & ~np.concatenate(([False], cover[:-1]))).sum())
                        x = x[~cover]
                    kept = x.tobytes()
                    rows.append((n, gone, spans_n, hashlib.sha256(kept).hexdigest(), kept)[:len(schema) - 1])
                yield batch(schema, b.column(0).slice(i, len(rows)), *zip(*rows))

    return j.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_kept)
