"""N-gram Jaccard join with a token-group matrix (operator 6).

A document's set holds its distinct ``k``-word shingles; two documents link when
``den * |A & B| >= num * |A | B|``, decided on the exact sets of 64-bit shingle
hashes.  Documents with equal sets are one node (told apart by 128 bits).

1. A global order of tokens puts rare ones first, by counts over all documents
   in ``BUCKETS`` buckets; any order gives the same links.  Two sets that link
   share ``SHARED`` tokens among the first ``n - ceil(num * n / den) + SHARED``
   of each (fewer where the sets are that small).
2. Tokens that no other node has among its first ones are settled.
3. Similar nodes are partitioned into groups of about ``GROUP`` nodes: first by
   the least values of two hashes, where each chunk also holds a few nodes common to
   all chunks of those.  (A passage that many texts share often holds the least value
   of one hash, seldom of both; such texts would be fetched in vain.)  Linked nodes
   inside a group become one class.
4. The groups of the matrix are the classes so far, and the remaining nodes by
   the shared token that most nodes hold, in chunks of about ``GROUP``.  The
   matrix holds the union of a group's first tokens with the least and greatest
   set size.  A node queries the groups, but those of its own class, that share
   enough tokens and have fitting sizes.  There the overlap
   with the union of the group's whole sets bounds that with any member; only
   groups whose bound reaches the threshold are opened and compared exactly.
5. Classes are joined by the links found.  Nodes of one class are never compared
   again, so a large group of near copies costs far less than all its pairs.

Nothing is capped: groups and query blocks are split by size, never cut.  Each
comparison fetches the texts that it needs once; a bitmap of fixed size keeps
most others out of that shuffle.

Null or empty text, or one without words: an empty set, linked with nothing.
Null doc_id: kept; it is never a component_id unless all ids of the class are
null.  Repeated rows and equal texts fall into one node.  Very long texts are
read whole.  An empty table gives no rows.  Extra columns are ignored by
``classes`` and kept by ``one_per_class``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from ordlab.llm import kernels
from ordlab.llm.common import batch, bitmap, fresh, may_contain, narrow, pin, shuffle_partitions
from ordlab.llm.graph import components

U = np.uint64
BUCKETS, PARTS = 1 << 20, 64
GROUP, PIVOTS, QUERIES = 200, 8, 500
SHARED = 3
TOKEN = U((1 << 48) - 1)  # tokens of the matrix only point at candidates


def least_overlap(n: int, num: int, den: int) -> int:
    """Least overlap of a set of ``n`` tokens with any set that it links to."""
    return -(-num * n // den)


def bucket_counts(src: DataFrame, k: int) -> np.ndarray:
    """Documents per bucket of shingle hashes (a table of fixed size)."""
    schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, buf, off in kernels.slices(b.column(0)):
                sets = list(kernels.shingle_sets(buf, off, k))
                total += np.bincount((np.concatenate(sets) >> U(44)).astype(np.int64), minlength=BUCKETS)
        for i, c in enumerate(np.split(total, PARTS)):
            yield batch(schema, [i], [c.tobytes()])

    def add(key, pdf):
        import pandas as pd
        c = np.zeros(BUCKETS // PARTS, np.int64)
        for x in pdf["counts"]:
            c += np.frombuffer(x, np.int64)
        return pd.DataFrame({"part": [key[0]], "counts": [c.tobytes()]})

    parts = src.select("text").mapInArrow(run, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary")
    out = np.zeros((PARTS, BUCKETS // PARTS), np.int64)
    for r in parts.toLocalIterator():
        out[r[0]] = np.frombuffer(r[1], np.int64)
    return np.minimum(out.ravel(), (1 << 31) - 1).astype(np.int32)


def describe(src: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, tx, n, d1, d2, least, first) of every document: set size, set
    digest, hash of the least values of two hashes and the first tokens in the global order."""
    bc = src.sparkSession.sparkContext.broadcast(bucket_counts(src, k))  # BUCKETS counts
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "tx", "n", "d1", "d2", "least")] + [("first", pa.list_(pa.int64()))])

    def run(batches):
        count = bc.value
        for b in batches:
            for i, buf, off in kernels.slices(b.column(2)):
                rows = [[], [], [], [], []]
                for s in kernels.shingle_sets(buf, off, k):
                    n = len(s)
                    least = least_overlap(n, num, den)
                    p = n - least + min(SHARED, least)
                    order = np.lexsort((s, count[(s >> U(44)).astype(np.int64)]))[:p]
                    d = [kernels.mix(s + U(c)).sum(dtype=U).astype(np.int64) for c in (1, 2)]
                    low = kernels.mix(kernels.mix(s).min(keepdims=True) ^ ~kernels.mix(s + U(3)).min(keepdims=True)).view(np.int64)[0] if n else 0
                    for r, x in zip(rows, (n, *d, low, (s[order] & TOKEN).astype(np.int64))):
                        r.append(x)
                yield batch(schema, b.column(0).slice(i, len(off) - 1), b.column(1).slice(i, len(off) - 1), *rows)

    return pin(src.select("doc_id", "tx", "text").mapInArrow(run, ", ".join(f"{f.name} bigint" for f in schema if f.name != "first") + ", first array<bigint>"), "jaccard-sets")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of a group, by a product of the
    incidence matrix of tokens that occur more than once."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    col = np.cumsum(new) - 1
    many = np.bincount(col)[col] > 1
    col, owner = np.unique(col[many], return_inverse=True)[1], owner[many]
    out = np.zeros((len(sets), len(sets)), np.float64)
    width = int(col.max()) + 1 if len(col) else 0
    for a in range(0, width, 1 << 14):  # columns in blocks
        at = (col >= a) & (col < a + (1 << 14))
        m = np.zeros((len(sets), min(width - a, 1 << 14)), np.float32)
        m[owner[at], col[at] - a] = 1
        out += m @ m.T
    return out.astype(np.int64)


def linked(inter: np.ndarray, n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    return den * inter >= num * (n[:, None] + m[None, :] - inter)


def link_members(nodes: np.ndarray, sets: list[np.ndarray], num: int, den: int):
    """Links that span the classes inside a group: (node, least node)."""
    n = np.array([len(s) for s in sets])
    adj = linked(overlaps(sets), n, n, num, den)
    np.fill_diagonal(adj, True)
    label = np.arange(len(nodes))
    while True:
        new = np.where(adj, label[None, :], len(nodes)).min(1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def link_queries(nodes: np.ndarray, sets: list[np.ndarray], queries: np.ndarray, asked: list[np.ndarray], num: int, den: int):
    """Links that span the classes of queries and members of one group; only
    queries whose bound qualifies open the group."""
    union, again = np.unique(np.concatenate(sets), return_counts=True)
    inside = np.isin(queries, nodes)  # a query's own tokens say nothing about other members
    bound = np.array([np.isin(q, union[again > 1] if own else union, assume_unique=True).sum() for q, own in zip(asked, inside)])
    opened = np.flatnonzero([b >= least_overlap(len(q), num, den) for b, q in zip(bound, asked)])
    if not len(opened):
        return queries[:0], queries[:0]
    part, who = [asked[i] for i in opened], queries[opened]
    inter = overlaps(part + sets)[:len(part), len(part):]
    adj = linked(inter, np.array([len(s) for s in part]), np.array([len(s) for s in sets]), num, den)
    adj |= who[:, None] == nodes[None, :]
    far = np.int64((1 << 63) - 1)
    ask, mem = who.copy(), nodes.copy()
    while True:  # the least node that each can reach inside this group
        new_ask = np.minimum(ask, np.where(adj, mem[None, :], far).min(1))
        new_mem = np.minimum(mem, np.where(adj, new_ask[:, None], far).min(0))
        if (new_ask == ask).all() and (new_mem == mem).all():
            return np.concatenate([who, nodes]), np.concatenate([ask, mem])
        ask, mem = new_ask, new_mem


def compare(rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(u, v) links of groups.  ``rows``: (g, block, query, node, packed text); the
    members of a group (``query`` 0) stand in each of its blocks."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def solve(t: pa.Table):
        g, block, query, node = [t.column(c).to_numpy() for c in range(4)]
        sets = []
        for i in range(0, len(t), 100):
            text = pa.array([zlib.decompress(x) for x in t.column(4).slice(i, 100).to_pylist()], pa.large_binary())
            for _, buf, off in kernels.slices(text):
                sets += kernels.shingle_sets(buf, off, k)
        cut = np.flatnonzero((g[1:] != g[:-1]) | (block[1:] != block[:-1])) + 1
        u, v = [], []
        for a, b in zip(np.concatenate(([0], cut)).tolist(), np.concatenate((cut, [len(g)])).tolist()):
            own = a + int(np.searchsorted(query[a:b], 1))
            if own == b and b - a > 1:
                got = link_members(node[a:b], sets[a:b], num, den)
            elif a < own < b:
                got = link_queries(node[a:own], sets[a:own], node[own:b], sets[own:b], num, den)
            else:
                continue
            u.append(got[0])
            v.append(got[1])
        if u:
            u, v = np.concatenate(u), np.concatenate(v)
            yield batch(schema, u[u != v], v[u != v])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for i in range(0, len(b), 1000):
                held.append(b.slice(i, 1000))
                size += held[-1].nbytes
                if size >= 4 << 20:
                    t = pa.Table.from_batches(held).combine_chunks()
                    g, block = t.column(0).to_numpy(), t.column(1).to_numpy()
                    last = np.flatnonzero((g != g[-1]) | (block != block[-1]))
                    cut = int(last[-1]) + 1 if len(last) else 0
                    if cut:
                        yield from solve(t.slice(0, cut))
                    held = t.slice(cut).combine_chunks().to_batches()
                    size = sum(x.nbytes for x in held)
        if held:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    n = shuffle_partitions(rows.sparkSession)
    rows = rows.repartition(n, "g", "block").sortWithinPartitions("g", "block", "query", "node")
    return rows.select("g", "block", "query", "node", "text").mapInArrow(run, "u bigint, v bigint")


def _chunk(size, per: int, salt: int):
    return F.pmod(F.xxhash64("node", F.lit(salt)), F.ceil(size / F.lit(per))).cast("bigint")


def _packed(text: str):
    """Texts move twice (to their places, then to the groups), so they are compressed."""
    @F.pandas_udf("binary")
    def udf(raw: pd.Series) -> pd.Series:
        return pd.Series([zlib.compress(x) for x in raw], dtype=object)

    return udf(F.col(text).cast("binary"))


def fetch(src: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of ``places`` (node, doc_id, tx, at) with their texts, one for
    each entry (g, block, query) of ``at``.  Rows that repeat a document repeat
    a node; comparing it twice does no harm."""
    places = pin(places.withColumn("key", F.xxhash64("doc_id", "tx")), "jaccard-places")
    some = src.filter(may_contain(bitmap(places, "key"))(F.xxhash64("doc_id", "tx"))).select("doc_id", "tx", _packed("text").alias("text"))
    p = places.select("node", F.col("doc_id").alias("__d"), F.col("tx").alias("__t"), "at")
    rows = some.join(p, some["doc_id"].eqNullSafe(F.col("__d")) & (some["tx"] == F.col("__t")))
    return rows.select("node", "text", F.explode("at").alias("at")).select("at.g", "at.block", "at.query", "node", "text")


def _place(g, block, query: int):
    return F.struct(g.alias("g"), block.alias("block"), F.lit(query).alias("query"))


def classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tx, n_shingles, component_id, rep_id, rep_tx) of every document;
    (rep_id, rep_tx) tells the document that stands for its class."""
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    src = narrow(docs, doc_id=F.col(f"`{id_col}`").cast("bigint"), tx=F.xxhash64(t), text=t)
    sets = describe(src, k, num, den)
    # null ids sort last among the rows that may stand for a node
    key = F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "tx")
    nodes = sets.filter("n > 0").groupBy("d1", "d2").agg(F.min(key).alias("ex"), F.first("n").alias("n"), F.first("least").alias("least"))
    nodes = pin(nodes.withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")
    ex = nodes.select("node", "n", "least", F.col("ex.doc_id").alias("doc_id"), F.col("ex.tx").alias("tx"))
    place = ex.select("node", "doc_id", "tx")

    # inside groups of equal least hashes
    size = ex.groupBy("least").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    chunks = F.ceil(F.col("size") / F.lit(GROUP)).cast("bigint")
    pivot = (chunks > 1) & (F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.col("size") / F.lit(PIVOTS))) == 0)
    at = F.when(pivot, F.sequence(F.lit(0).cast("bigint"), chunks - 1)).otherwise(F.array(_chunk(F.col("size"), GROUP, 1)))
    member = ex.join(size, "least").select("node", "doc_id", "tx", F.transform(at, lambda b: _place(F.col("least"), b, 0)).alias("at"))
    inner = pin(compare(fetch(src, member), k, num, den), "jaccard-inner")
    comp = pin(components(inner), "jaccard-classes")

    # the matrix: first tokens that two classes share.  A node of a class of its own belongs to the
    # group of the token, among its shared first ones, that most nodes hold
    first = sets.select(F.col("doc_id").alias("__d"), F.col("tx").alias("__t"), "first")
    post = first.join(ex, ex["doc_id"].eqNullSafe(F.col("__d")) & (ex["tx"] == F.col("__t"))).join(comp, "node", "left")
    post = post.select("node", "n", "comp", F.explode("first").alias("token"))
    # most tokens occur once: rows are sent by token one time, and only those of shared tokens are written
    same, comp = Window.partitionBy("token"), F.coalesce("comp", "node")
    post = post.select("*", F.min(comp).over(same).alias("a"), F.max(comp).over(same).alias("b"), F.count(F.lit(1)).over(same).alias("df"))
    post = pin(post.filter("a <> b").select("node", "n", comp.alias("comp"), F.col("comp").isNull().alias("single"), "token", "df"), "jaccard-shared")
    label = post.groupBy("node").agg(F.max(F.struct("df", "token"))["token"].alias("token"), F.first("comp").alias("comp"), F.first("single").alias("single"))
    label = pin(label.withColumn("label", F.when(F.col("single"), F.col("token")).otherwise(F.col("comp"))).select("node", "single", "label"), "jaccard-labels")
    sizes = label.groupBy("single", "label").agg(F.count(F.lit(1)).alias("size"))
    group = label.join(sizes, ["single", "label"]).select("node", F.xxhash64("single", "label", _chunk(F.col("size"), GROUP, 2)).alias("g"))
    group = pin(group, "jaccard-group-of-node")
    post = pin(post.drop("df").join(group, "node"), "jaccard-matrix")
    matrix = post.groupBy("token", "g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count(F.lit(1)).alias("held"),
                                            F.min(F.when(~F.col("single"), F.col("comp"))).alias("g_comp"))
    matrix = matrix.withColumnRenamed("g", "to")
    ask = post.select("token", "node", "n", "comp", "g").join(matrix, "token").filter(
        ((F.col("g") < F.col("to")) & (F.col("g_comp").isNull() | (F.col("g_comp") != F.col("comp")))
         | (F.col("g") == F.col("to")) & F.col("g_comp").isNull() & (F.col("held") > 1))
        & (F.col("n") * den >= F.col("lo") * num) & (F.col("hi") * den >= F.col("n") * num))
    ask = ask.groupBy("node", "to").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n"), F.min("lo").alias("lo"))
    floor = F.least(F.lit(SHARED), F.ceil(F.col("n") * num / F.lit(den)), F.ceil(F.col("lo") * num / F.lit(den)))
    ask = pin(ask.filter(F.col("shared") >= floor).select("node", F.col("to").alias("g")), "jaccard-queries")

    # queries and members of the groups asked, each text fetched once
    groups = pin(ask.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERIES)).cast("bigint").alias("blocks")), "jaccard-groups")
    asking = ask.join(groups, "g").select("node", _place(F.col("g"), F.pmod(F.xxhash64("node", F.lit(4)), F.col("blocks")), 1).alias("at"))
    blocks = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    member = group.join(groups, "g").select("node", F.explode(F.transform(blocks, lambda b: _place(F.col("g"), b, 0))).alias("at"))
    wanted = asking.unionByName(member).groupBy("node").agg(F.collect_list("at").alias("at")).join(place, "node")
    outer = pin(compare(fetch(src, wanted), k, num, den), "jaccard-outer")
    final = components(inner.unionByName(outer))

    # back to the documents
    whole = nodes.join(final, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    whole = pin(whole.select("d1", "d2", "comp", "ex"), "jaccard-node-classes")
    rep = whole.groupBy("comp").agg(F.min("ex").alias("rep"))
    known = whole.join(rep, "comp").select("d1", "d2", "rep")
    out = sets.select("doc_id", "tx", "n", "d1", "d2").join(known, ["d1", "d2"], "left")
    alone = F.col("n") == 0
    return out.select("doc_id", "tx", F.col("n").alias("n_shingles"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("rep.doc_id")).alias("component_id"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("rep.doc_id")).alias("rep_id"),
                      F.when(alone, F.col("tx")).otherwise(F.col("rep.tx")).alias("rep_tx"))


def one_per_class(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each class: the
    one with the least doc_id (of rows equal in doc_id and text, that of the least
    hash of all columns).  Documents without words all stay."""
    ident, tx, gd, gt, wd, wt, n = fresh(docs, "_id", "_tx", "_gd", "_gt", "_wd", "_wt", "_n")
    found = classes(docs, k, num, den, id_col, text_col)
    gone = found.filter(~(F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("tx") == F.col("rep_tx"))))
    gone = gone.select(F.col("doc_id").alias(gd), F.col("tx").alias(gt)).distinct()
    words = found.filter("n_shingles > 0").select(F.col("doc_id").alias(wd), F.col("tx").alias(wt))
    twice = words.groupBy(wd, wt).agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > 1)
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.withColumns({ident: F.col(f"`{id_col}`").cast("bigint"), tx: F.xxhash64(t)})
    rows = rows.join(gone, F.col(ident).eqNullSafe(F.col(gd)) & (F.col(tx) == F.col(gt)), "left_anti")
    rows = rows.join(twice, F.col(ident).eqNullSafe(F.col(wd)) & (F.col(tx) == F.col(wt)), "left")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    order = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))])
    again = rows.filter(F.col(n) > 1).groupBy(ident, tx).agg(F.min_by(F.struct(*cols), order).alias(gd)).select(f"{gd}.*")
    return rows.filter(F.col(n).isNull()).select(*cols).unionByName(again)
