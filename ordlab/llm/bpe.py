"""Byte-level BPE encoding and decoding in two tiers (operator 11).

1. A text is split into pre-tokens by the public byte-level pattern, on whole
   arrays: four character classes and their changes give every match.  The
   classes are asked from the tiktoken library's own pattern engine, because
   Unicode tables differ between libraries.
2. First tier: a minimal perfect hash (levels of bit arrays, a key stands in the
   first level where it is alone; its place is the rank of its bit) names the
   one vocabulary entry a pre-token can be; the bytes decide.
3. Second tier: what is not an entry is merged bottom up, the pair of lowest
   rank first and the leftmost of equals, with a heap over linked bytes.
4. Equal pre-tokens of a slice are resolved once.  They are brought together by
   a 64-bit hash and compared by their bytes, so a collision costs time only.

The vocabulary is read once on the driver and broadcast (its size is fixed by
the file).  Nothing is shuffled.

Null or empty text: no ids.  Very long texts are read in windows that end where
a pre-token surely starts; ids are those of the whole text.  Null or repeated
doc_ids: a row each.  Empty table: no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordlab.llm import kernels
from ordlab.llm.common import batch, narrow
from ordlab.llm.kernels import spans

U = np.uint64
LETTER, NUMBER, OTHER, SPACE = range(4)
#: pieces whose ids a worker remembers (about 250 bytes each), once more if they were asked for
#: since; results do not depend on it
REMEMBERED = 150_000
#: bytes of text looked at together
WINDOW = 2 << 20


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Vocabulary file (base64 bytes and rank per line) -> rank of each entry."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}


def character_classes() -> np.ndarray:
    """Class of every code point, as tiktoken's patterns see it."""
    import tiktoken
    single = {bytes([i]): i for i in range(256)}
    text = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, cls in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        enc = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = bytes(enc.encode_ordinary(text)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), "<u4")] = cls
    return out


def piece_starts(buf: np.ndarray, off: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte places where the pre-tokens of the texts start.

    A pre-token is a run of one class with one space (U+0020) before it; a run
    of white space leaves its last character to what follows; an apostrophe
    that starts a pre-token takes one of seven endings with it."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    cp = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), "<u4")
    n = len(cp)
    if not n:
        return lead
    cls = classes[cp]
    first = np.ones(n + 3, bool)
    first[:n] = False
    first[np.searchsorted(lead, off)] = True
    start = first.copy()
    start[1:n] |= cls[1:] != cls[:-1]
    blank = cls == SPACE
    last_blank = blank[:-1] & ~blank[1:] & ~first[1:n]
    start[np.flatnonzero(last_blank)] = True
    start[np.flatnonzero(last_blank & (cp[:-1] == 0x20)) + 1] = False
    quote = np.flatnonzero((cp == 0x27) & start[:n])
    after = np.concatenate((cp, np.zeros(3, "<u4")))
    x = np.where(first[quote + 1], 0, after[quote + 1])
    y = np.where(first[quote + 1] | first[quote + 2], 0, after[quote + 2])
    one = np.isin(x, [ord(c) for c in "stmd"])
    two = ((y == ord("e")) & ((x == ord("r")) | (x == ord("v")))) | ((x == ord("l")) & (y == ord("l")))
    for at, size in ((quote[one], 2), (quote[two], 3)):
        start[at + 1] = False
        start[at + size] = True
    return lead[start[:n]]


class MinimalHash:
    """Minimal perfect hash of distinct 64-bit keys: 0 to n-1, each once.  Any
    other key gets some number of these, or -1."""

    def __init__(self, keys: np.ndarray):
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two vocabulary entries have one 64-bit hash")
        self.levels, self.size, rest = [], 0, keys
        while len(rest):
            slot = self.slots(rest, len(self.levels), 2 * len(rest))
            alone = np.bincount(slot, minlength=2 * len(rest)) == 1
            self.levels.append((alone, np.cumsum(alone) - 1 + self.size))
            self.size += int(alone.sum())
            rest = rest[~alone[slot]]

    @staticmethod
    def slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (kernels.mix(keys + U(0x9E3779B97F4A7C15 * (level + 1) % 2**64)) % U(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1)
        left = np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            slot = self.slots(keys[left], level, len(alone))
            hit = alone[slot]
            out[left[hit]] = rank[slot[hit]]
            left = left[~hit]
        return out


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``a[at:at+size]`` equals ``b[bt:bt+size]``, for each of the spans (of one byte or more)."""
    if not len(size):
        return np.zeros(0, bool)
    return np.logical_and.reduceat(a[spans(at, size)] == b[spans(bt, size)], np.cumsum(size) - size)


def merge(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of one pre-token: parts are linked by their ends, a heap holds the
    pairs that form an entry.  A pair is out of date if its parts have changed."""
    n, get = len(piece), ranks.get
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i:i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, e = heappop(heap)
        j = end[i]
        if not 0 < j < n or end[j] != e:
            continue
        end[i], end[j] = e, 0
        if e < n:
            before[e], k = i, end[e]
            if k - i <= longest and (r := get(piece[i:k])) is not None:
                heappush(heap, (r, i, k))
        k = before[i]
        if k >= 0 and e - k <= longest and (r := get(piece[k:e])) is not None:
            heappush(heap, (r, k, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class Bpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], classes: np.ndarray):
        self.ranks, self.classes = ranks, classes
        self.longest = max(map(len, ranks))
        entries = sorted(ranks, key=ranks.get)
        self.ids = np.array([ranks[e] for e in entries], np.uint32)
        self.blob = np.frombuffer(b"".join(entries), np.uint8)
        self.off = np.concatenate(([0], np.cumsum([len(e) for e in entries])))
        keys = kernels.span_hash(kernels.prefix_hash(self.blob), self.off[:-1], self.off[1:])
        self.hash = MinimalHash(keys)
        self.entry = np.empty(len(entries), np.int64)  # entry at each place of the hash
        self.entry[self.hash(keys)] = np.arange(len(entries))
        self.young: dict[bytes, tuple[int, ...]] = {}
        self.old: dict[bytes, tuple[int, ...]] = {}

    def miss(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a pre-token that is no entry (second tier), remembered if short."""
        ids = self.young.get(piece)
        if ids is None:
            ids = self.old.get(piece)
            if ids is None:
                ids = tuple(merge(piece, self.ranks, self.longest))
            if len(piece) <= 64:
                if len(self.young) >= REMEMBERED:
                    self.young, self.old = {}, self.young
                self.young[piece] = ids
        return ids

    def entries(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Entry that each pre-token is, or -1 (first tier)."""
        place = self.hash(keys)
        e = np.where(place >= 0, self.entry[place], -1)
        may = np.flatnonzero((e >= 0) & (self.off[e + 1] - self.off[e] == size))
        ok = may[same_bytes(buf, start[may], self.blob, self.off[e[may]], size[may])]
        out = np.full(len(keys), -1)
        out[ok] = e[ok]
        return out

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, one after another, and where each text's begin."""
        start = piece_starts(buf, off, self.classes)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        size = np.append(start[1:], len(buf)) - start
        h = kernels.span_hash(kernels.prefix_hash(buf), start, start + size)
        keys, one, group = np.unique(h, return_index=True, return_inverse=True)
        rep = one[group]
        other = np.flatnonzero(size != size[rep])
        same = size == size[rep]
        at = np.flatnonzero(same & (rep != np.arange(len(rep))))
        other = np.concatenate((other, at[~same_bytes(buf, start[at], buf, start[rep[at]], size[at])]))
        entry = self.entries(buf, start[one], size[one], keys)
        raw = buf.tobytes()

        def missed(i):
            return self.miss(raw[start[i]:start[i] + size[i]])

        def ids_of(i):  # of a piece that shares a hash with another one
            piece = raw[start[i]:start[i] + size[i]]
            return (self.ranks[piece],) if piece in self.ranks else self.miss(piece)

        known = entry >= 0
        pool = [(x,) for x in self.ids[entry[known]].tolist()]
        order = np.empty(len(keys), np.int64)
        order[known] = np.arange(len(pool))
        order[~known] = np.arange(len(pool), len(keys))
        pool += [missed(i) for i in one[~known]]
        slot = order[group]
        if len(other):
            slot[other] = np.arange(len(pool), len(pool) + len(other))
            pool += [ids_of(i) for i in other]
        num = np.fromiter(map(len, pool), np.int64, len(pool))
        flat = np.fromiter(chain.from_iterable(pool), np.uint32, int(num.sum()))
        first = np.cumsum(num) - num
        n = num[slot]
        return flat[spans(first[slot], n)], np.concatenate(([0], np.cumsum(n)))[np.searchsorted(start, off)]

    def encode_long(self, buf: np.ndarray) -> np.ndarray:
        """Ids of one text of any length, window by window."""
        return np.concatenate([self.encode(w, np.array([0, len(w)]))[0] for w in windows(buf)] or [np.zeros(0, np.uint32)])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids; an id that no entry has is an error."""
        at = np.searchsorted(self.ids, ids)
        if len(ids) and (at.max() == len(self.ids) or (self.ids[at] != ids).any()):
            raise ValueError("id outside the vocabulary")
        return self.blob[spans(self.off[at], self.off[at + 1] - self.off[at])]


def windows(buf: np.ndarray, size: int = 0) -> Iterator[np.ndarray]:
    """Parts of a text that end before a space or line end which follows a
    visible ASCII character: a pre-token starts there whatever surrounds it."""
    size = size or WINDOW
    a = 0
    while a < len(buf):
        b = a + size
        while b < len(buf):
            part = buf[a + size // 2:b]
            cut = np.flatnonzero(((part[1:] == 0x20) | (part[1:] == 0x0A)) & (part[:-1] > 0x20) & (part[:-1] < 0x7F))
            if len(cut):
                b = a + size // 2 + int(cut[-1]) + 1
                break
            b += size
        yield buf[a:b]
        a = min(b, len(buf))


_ready: dict[int, Bpe] = {}


def _coder(shared) -> Bpe:
    """The worker's encoder of a broadcast vocabulary, built once per worker."""
    lines, classes, mark = shared.value
    if mark not in _ready:
        _ready.clear()
        _ready[mark] = Bpe(read_ranks(lines), classes)
    return _ready[mark]


def load(spark, path: str):
    """Broadcast the vocabulary file (read here, on the driver) and the character classes."""
    with open(path, "rb") as f:
        lines = f.read()
    return spark.sparkContext.broadcast((lines, character_classes(), zlib.crc32(lines)))


def encode(docs: DataFrame, vocab, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every document; ids are little-endian unsigned 32-bit
    integers, one after another.  ``vocab`` comes from ``load``."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        bpe = _coder(vocab)
        for b in batches:
            for i, buf, off in kernels.slices(b.column(1), WINDOW):
                n = len(off) - 1
                if n == 1:
                    yield batch(schema, b.column(0).slice(i, 1), [bpe.encode_long(buf).astype("<u4").tobytes()])
                    continue
                ids, first = bpe.encode(buf, off)
                raw = ids.astype("<u4").tobytes()
                yield batch(schema, b.column(0).slice(i, n), [raw[4 * x:4 * y] for x, y in zip(first[:-1].tolist(), first[1:].tolist())])

    src = narrow(docs, doc_id=F.col(f"`{id_col}`").cast("bigint"), text=text_col)
    return src.mapInArrow(run, "doc_id bigint, ids binary")


def decode(tokens: DataFrame, vocab) -> DataFrame:
    """``encode``'s rows with the bytes that their ids stand for, as ``decoded``."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches):
        bpe = _coder(vocab)
        for b in batches:
            for i, buf, off in kernels.slices(b.column(1), WINDOW):
                n = len(off) - 1
                out = [bpe.decode(np.frombuffer(buf[x:y].tobytes(), "<u4")).tobytes() for x, y in zip(off[:-1], off[1:])]
                yield batch(schema, b.column(0).slice(i, n), b.column(1).slice(i, n), out)

    return narrow(tokens, doc_id="doc_id", ids="ids").mapInArrow(run, "doc_id bigint, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number and digest of its ids, digest of what they decode to."""
    vocab = load(docs.sparkSession, path)
    return decode(encode(docs, vocab), vocab).select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
