"""Document fingerprints: one-permutation MinHash with optimal densification
and packed low-order bits (operator 1).  DataFrame functions only.

The shingles are ``k`` words of the lower-cased text, each hashed once.  The top
8 bits of a hash choose one of 256 bins, which keeps its least hash.  An empty
bin copies the bin that its own random sequence of bins meets first that is not
empty, so copies agree between documents as often as their sets do.  The low
4 bits of each bin, hashed with the bin's number so that copies of one value
agree by chance no more than others, are packed, 16 bins to a 64-bit word; a fingerprint is the
hexadecimal text of the 16 words.  The likeness of two fingerprints is the share
of equal 4-bit values, corrected for those that agree by chance.

Null text: an empty text.  A text without words has the empty fingerprint; it is
like another such text (1.0) and unlike any other (0.0).  A text with fewer than
``k`` words is one shingle.  Equal texts have equal fingerprints.  Rows are in
order of (doc_id, hash of the text, rank among equal rows), null doc_id lowest;
repeated rows are neighbours.  An empty table gives no rows; a single document
is its own next one.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordlab.llm.common import narrow, pin
from ordlab.operators.rank import position

BINS, BITS, K = 256, 4, 5
PER_WORD = 64 // BITS
ROUNDS = 6
BLOCK = 128  # documents that one window sees, with one neighbour
LOW = (1 << 56) - 1


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def shingles(text: Column, k: int = K) -> Column:
    """Hashes of the ``k``-word shingles."""
    words = F.filter(F.split(F.lower(text), "[ \\t-\\r]+"), lambda w: w != "")

    def of(w):
        whole = F.array(F.xxhash64(F.concat_ws(" ", w)))
        each = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        return F.when(F.size(w) >= k, each).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    # words are hashed first, so that a shingle hashes numbers
    return let(words, lambda w: F.when(F.size(w) >= k, let(F.transform(w, lambda x: F.xxhash64(x)), of)).otherwise(of(w)))


def bins(hashes: Column) -> Column:
    """Least hash of each bin, null where a bin is empty, in bin order."""
    marks = F.transform(F.sequence(F.lit(-(BINS // 2)), F.lit(BINS // 2 - 1)),
                        lambda b: F.shiftleft(b.cast("bigint"), 56).bitwiseOR(F.lit(LOW)))
    ordered = F.sort_array(F.concat(hashes, marks))
    first = let(ordered, lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(s, i - 1), 56))))
    return F.transform(first, lambda x: F.when(x.bitwiseAND(F.lit(LOW)) != LOW, x))


def densify(own: Column) -> Column:
    """Fill the empty bins.  ``ROUNDS`` tries at pseudo-random bins come first,
    then the bin that is least in a pseudo-random order of all bins."""

    def attempt(b, now, r):
        return F.transform(now, lambda x, j: F.coalesce(x, F.get(b, F.pmod(F.hash(j, F.lit(r)), F.lit(BINS)))))

    def rest(b, now):
        full = F.filter(F.transform(b, lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())
        return let(full, lambda at: F.transform(now, lambda x, j: F.coalesce(x, F.get(b, F.array_min(F.transform(
            at, lambda i: F.struct(F.hash(i, j).alias("h"), i.alias("i"))))["i"]))))

    def gaps(a):
        return F.exists(a, lambda x: x.isNull())

    def fill(b, now, r):
        if r == ROUNDS:
            return F.when(gaps(now), rest(b, now)).otherwise(now)
        return F.when(gaps(now), let(attempt(b, now, r), lambda a: fill(b, a, r + 1))).otherwise(now)

    return let(own, lambda b: fill(b, b, 0))


def pack(filled: Column) -> Column:
    """The low bits of all bins in 64-bit words."""

    def word(b, k):
        out = None
        for j in range(PER_WORD):
            at = k * PER_WORD + j
            x = F.shiftleft(F.hash(F.get(b, at), at).bitwiseAND(F.lit((1 << BITS) - 1)).cast("bigint"), BITS * j)
            out = x if out is None else out.bitwiseOR(x)
        return out

    return let(filled, lambda b: F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_WORD - 1)), lambda k: word(b, k)))


def fingerprint(text: Column, k: int = K) -> Column:
    """Packed fingerprint of a text: 16 words of 64 bits; empty without words."""
    return let(shingles(F.coalesce(text, F.lit("")), k),
               lambda h: F.when(F.size(h) > 0, pack(densify(bins(h)))).otherwise(F.array().cast("array<bigint>")))


def to_hex(words: Column) -> Column:
    return F.lower(F.array_join(F.transform(words, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, in [0, 1]."""

    def differ(x, y):  # one bit for each 4-bit value that differs
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    miss = F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << BITS)
    share = ((BINS - miss) / F.lit(float(BINS)) - chance) / (1 - chance)
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).otherwise((F.size(a) == F.size(b)).cast("double"))


def ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, pos, total): the place of each document by falling doc_id."""
    # keys without nulls, so that the window and the join share one shuffle of the texts
    src = narrow(docs, doc_id=id_col, text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    src = src.withColumns({"kid": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))), "h": F.xxhash64("text", F.col("doc_id").isNull())})
    keys = position(src.select("doc_id", "kid", "h"), [F.col("doc_id").desc_nulls_last(), F.col("h")], "pos")
    keys = pin(keys.select("kid", "h", "pos"), "fingerprint-order")
    first = keys.groupBy("kid", "h").agg(F.min("pos").alias("first"))
    equal = Window.partitionBy("kid", "h").orderBy(F.lit(0))  # rows equal in both
    j = src.withColumn("k", F.row_number().over(equal)).join(first, ["kid", "h"])
    return j.select("doc_id", "text", (F.col("first") + F.col("k") - 1).alias("pos"), F.lit(keys.count()).alias("total"))


def fingerprints(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every document, words and hexadecimal text."""
    fp = narrow(docs, doc_id=id_col, words=fingerprint(F.col(f"`{text_col}`"), k))
    return fp.withColumn("fingerprint", to_hex(F.col("words")))


def neighbours(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its fingerprint, that of its edited text and the
    likeness to the edited text and to the next document's (falling doc_id)."""
    d = ordered(docs, id_col, text_col).withColumn("fp", fingerprint(F.col("text"), k))
    # each block also sees the first document after it
    block = F.floor(F.col("pos") / BLOCK)
    last = F.floor((F.col("total") - 1) / BLOCK)
    before = F.when(F.col("pos") == 0, last).otherwise(block - 1)
    sees = F.when(F.col("pos") % BLOCK == 0, F.array(F.struct(block.alias("b"), F.lit(False).alias("guest")),
                                                     F.struct(before.alias("b"), F.lit(True).alias("guest"))))
    sees = F.coalesce(sees, F.array(F.struct(block.alias("b"), F.lit(False).alias("guest"))))
    d = d.withColumn("at", F.explode(sees)).select("doc_id", "text", "fp", "pos", "at.b", "at.guest")
    w = Window.partitionBy("b").orderBy("guest", "pos")
    d = d.select("doc_id", "text", "fp", "guest", F.lead("text").over(w).alias("next"), F.lead("fp").over(w).alias("next_fp")).filter("NOT guest")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half)))
    d = d.select("doc_id", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp",
                 fingerprint(F.col("edited"), k).alias("edited_fp"))
    return d.select("doc_id", "n_chars", "edited_sha256", to_hex(F.col("fp")).alias("fingerprint"), to_hex(F.col("edited_fp")).alias("edited_fingerprint"),
                    likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
