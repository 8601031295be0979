"""Token-id output in frequency-ranked variable-length bytes (operator 4).

1. Documents are range-partitioned by doc_id and sorted; each task encodes whole
   texts with the tokenizers library.  Byte-level BPE never merges across
   pre-tokens, so a text is cut where a pre-token starts whatever surrounds it,
   the library encodes each distinct piece once per worker, and the ids of a
   text are those of its pieces.  A text that holds one of the vocabulary's added
   tokens, and every text if the tokenizer is not the plain byte-level one, goes
   to the library whole.  The ids are written once to the shared folder.
2. Token counts over all documents give each id its frequency rank.
3. Each writer task stores the ranks of the runs of documents that it reads: a
   control byte holds the byte lengths (1 to 4) of four ranks, the rank bytes
   follow apart from it.  A manifest names the files that were committed.
4. Readers stream the files block by block and decode by table lookup.

What the driver holds is bounded by the vocabulary and by the number of tasks.

Null or empty text: only the end id.  Null doc_id: sorts first and is kept.
Rows that repeat a doc_id follow each other, equal texts together.  Very
long texts: one block each, never cut.  An empty table gives no files and no
rows.  Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordlab.llm import kernels
from ordlab.llm.common import batch, filesystem, narrow, pin, scratch, shuffle_partitions, write_bytes

END_ID = 0
#: pieces whose ids a worker remembers (about 100 MB); results do not depend on it
PIECES = 2_000_000
SLICE = 1 << 20
BLOCK_TOKENS = 1 << 20
MAGIC = b"OLT1"
HEAD = struct.Struct("<4sIQQQ")  # magic, documents, tokens, control bytes, data bytes


class PieceEncoder:
    """Ids of texts by way of their distinct pieces; see the module text.

    Pieces are told apart by a 62-bit hash at two points of a prime field.  Known ones stand in two
    sorted tables of (hash, first id, number of ids): a small one that grows
    slice by slice and a large one that takes it up from time to time."""

    def __init__(self, text: str, kind: tuple[str, bool] | None = None):
        """``text``: the tokenizer file; ``kind``: what ``kind_of`` says of it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(text)
        dtype, self.cuttable = kind or kind_of(text)
        self.type = np.dtype(dtype)
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.line = self.encode(["\n"])[0] if self.cuttable else None
        self.forget()

    def forget(self) -> None:
        self.tables = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2
        self.pool, self.used = np.zeros(1 << 16, self.type), 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        enc = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        return [np.array(e.ids, self.type) for e in enc(texts, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Runs of letters, each perhaps after a space, encoded as the lines of
        one text: a line end between them is always an id of its own."""
        out = []
        for i in range(0, len(words), 4096):
            part = words[i:i + 4096]
            ids = self.encode(["\n".join(part)])[0]
            cut = np.flatnonzero(ids == self.line[0])
            if len(cut) == len(part) - 1:
                out += [x[1:] if k else x for k, x in enumerate(np.split(ids, cut))]
            else:
                out += self.encode(part)
        return out

    def learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Encode new pieces and enter them in the small table."""
        plain = [len(x) > 0 and x.isalpha() and (x.isascii() or max(x) <= "ɏ") for x in (p[1:] if p[0] == " " else p for p in pieces)]
        words = iter(self.encode_words([p for p, w in zip(pieces, plain) if w]))
        rest = iter(self.encode([p for p, w in zip(pieces, plain) if not w]))
        ids = [next(words) if w else next(rest) for w in plain]
        n = np.array([len(x) for x in ids])
        flat = np.concatenate(ids)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.used], np.zeros(len(flat) + self.used, self.type)])
        self.pool[self.used:self.used + len(flat)] = flat
        new = (hashes, self.used + np.cumsum(n) - n, n)
        self.used += len(flat)
        k = 1 if len(self.tables[1][0]) < PIECES // 8 else 0
        if not k:  # the large table takes up the small one
            new = tuple(np.concatenate(x) for x in zip(self.tables[1], new))
            self.tables[1] = tuple(x[:0] for x in new)
        merged = [np.concatenate(x) for x in zip(self.tables[k], new)]
        order = np.argsort(merged[0], kind="stable")
        self.tables[k] = tuple(x[order] for x in merged)

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first id, number of ids) of sorted hashes; number -1: not known."""
        first, n = np.zeros(len(h), np.int64), np.full(len(h), -1)
        for keys, at, num in self.tables:
            if len(keys):
                i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[i] == h
                first[hit], n[hit] = at[i[hit]], num[i[hit]]
        return first, n

    def ids(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, one after another, and the first of each."""
        raw = buf.tobytes()
        whole = self.with_added(raw, off) if self.cuttable else range(len(off) - 1)
        if not whole:
            return self.piece_ids(buf, off)
        texts = self.encode([raw[off[d]:off[d + 1]].decode() for d in whole])
        if not self.cuttable:
            got = texts
        else:
            flat, first = self.piece_ids(buf, off)
            got = [flat[a:b] for a, b in zip(first, first[1:])]
            for d, x in zip(whole, texts):
                got[d] = x
        return (np.concatenate(got) if got else np.zeros(0, self.type)), np.concatenate(([0], np.cumsum([len(x) for x in got], dtype=np.int64)))

    def with_added(self, raw: bytes, off: np.ndarray) -> list[int]:
        """Texts that hold an added token."""
        found = set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                d = int(np.searchsorted(off, at, "right")) - 1
                if at + len(token) <= off[d + 1]:
                    found.add(d)
                    at = raw.find(token, int(off[d + 1]))
                else:
                    at = raw.find(token, at + 1)
        return sorted(found)

    def piece_ids(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` by way of the pieces."""
        if sum(len(t[0]) for t in self.tables) > PIECES:
            self.forget()
        start = cuts(buf, off)
        if not len(start):
            return np.zeros(0, self.type), np.zeros(len(off), np.int64)
        end = np.append(start[1:], len(buf))
        h = kernels.byte_hash(buf, start, end)
        keys, one, inverse = np.unique(h, return_index=True, return_inverse=True)
        first, n = self.look(keys)
        new = np.flatnonzero(n < 0)
        if len(new):
            raw = buf.tobytes()
            self.learn(keys[new], [raw[x:y].decode() for x, y in zip(start[one[new]].tolist(), end[one[new]].tolist())])
            first[new], n[new] = self.look(keys[new])
        num = n[inverse]
        last = np.cumsum(num)
        flat = self.pool[np.arange(last[-1]) + np.repeat(first[inverse] - (last - num), num)]
        return flat, np.concatenate(([0], last))[np.searchsorted(start, off)]


# byte classes: what surely starts a pre-token after a space (printable ASCII, Latin letters),
# ASCII letters, and marks that never belong to the pre-token of a letter before them
STARTS = np.zeros(256, bool)
STARTS[0x21:0x7F] = True
STARTS[0xC3:0xCA] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
MARK = np.zeros(256, bool)
MARK[list(b".,;:!?|*#$%&-()")] = True


def cuts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """First bytes of pieces: places where a pre-token starts whatever the rest
    of the text is.  These are a text's start; a space before a printable
    character; a line end between a printable and a printable character, and
    what follows it; a mark after a letter."""
    n = len(buf)
    cut = np.zeros(n + 1, bool)
    if n:
        nxt, prev = np.append(buf[1:], 32), np.append(32, buf[:-1])
        cut[:-1] = (buf == 32) & STARTS[nxt]
        ink = (prev > 32) & (prev < 127)
        line = (buf == 10) & STARTS[nxt] & ink
        cut[:-1] |= line | (MARK[buf] & LETTER[prev])
        cut[1:] |= line
        cut[off] = True
    return np.flatnonzero(cut[:-1])


_encoders: dict[int, PieceEncoder] = {}


def encoder(shared) -> PieceEncoder:
    """The worker's encoder of a broadcast tokenizer; its memory of pieces outlives a task."""
    text, kind, mark = shared.value
    if mark not in _encoders:
        _encoders.clear()
        _encoders[mark] = PieceEncoder(text, kind)
    return _encoders[mark]


def load(path: str) -> str:
    """The tokenizer file, read on the driver."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def kind_of(text: str) -> tuple[str, bool]:
    """Type of the ids of a tokenizer file, and whether its texts may be cut into
    pieces.  Asked on the driver only: parsing the file takes many times its size."""
    from tokenizers import Tokenizer
    ids = Tokenizer.from_str(text).get_vocab(with_added_tokens=True).values()
    parts = json.loads(text)
    pre = parts.get("pre_tokenizer") or {}
    cuttable = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
                and not parts.get("normalizer") and parts.get("model", {}).get("type", "BPE") == "BPE")
    return "<u2" if max(ids, default=0) < 1 << 16 else "<u4", bool(cuttable)


def encode(docs: DataFrame, tokenizer: str, kind: tuple[str, bool], end_id: int = END_ID, id_col: str = "doc_id",
           text_col: str = "text", num_partitions: int | None = None) -> DataFrame:
    """(part, idx, doc_id, ids): ids as little-endian bytes, in doc_id order.
    ``tokenizer`` is the text of a tokenizer file, whose size is fixed."""
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer, kind, zlib.crc32(tokenizer.encode())))
    schema = pa.schema([("part", pa.int32()), ("idx", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        from pyspark import TaskContext
        part, idx, enc = TaskContext.get().partitionId(), 0, encoder(shared)
        end = np.array([end_id], enc.type).tobytes()
        for b in batches:
            for i, buf, off in kernels.slices(b.column(1), SLICE):
                flat, first = enc.ids(buf, off)
                raw, at = flat.tobytes(), (first * flat.itemsize).tolist()
                got = [raw[x:y] + end for x, y in zip(at, at[1:])]
                yield batch(schema, np.full(len(got), part, np.int32), np.arange(idx, idx + len(got)), b.column(0).slice(i, len(got)), got)
                idx += len(got)

    n = num_partitions or shuffle_partitions(docs.sparkSession)
    src = narrow(docs, doc_id=F.col(f"`{id_col}`").cast("bigint"), text=text_col)
    src = src.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    return pin(src.mapInArrow(run, "part int, idx bigint, doc_id bigint, ids binary"), "token-ids")


def ranks(encoded: DataFrame, dtype: str) -> np.ndarray:
    """Ids by falling count over all documents, ties by id (a row per distinct id)."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for i in range(0, len(b), 256):
                got = np.bincount(np.frombuffer(b"".join(b.column(0).slice(i, 256).to_pylist()), dtype))
                if len(got) > len(total):
                    got, total = total, got
                total[:len(got)] += got
        at = np.flatnonzero(total)
        yield batch(schema, at, total[at])

    rows = encoded.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return np.array([r[0] for r in sorted(rows.collect(), key=lambda r: (-r[1], r[0]))], np.int64)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    quads = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    quads[:len(v)] = code
    control = quads[0::4] | quads[1::4] << 2 | quads[2::4] << 4 | quads[3::4] << 6
    return control.astype(np.uint8).tobytes(), data.tobytes()


_LEN = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_SUM = _LEN.sum(1)
_AT = np.cumsum(_LEN, 1) - _LEN
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """Inverse of ``pack`` by lookup in tables of the 256 control bytes."""
    c = np.frombuffer(control, np.uint8)
    first = np.cumsum(_SUM[c]) - _SUM[c]
    at = (first[:, None] + _AT[c]).ravel()[:n]
    d = np.frombuffer(data + b"\0" * 4, np.uint8)
    v = d[at].astype(np.uint32)
    for j in range(1, 4):
        v |= d[at + j].astype(np.uint32) << np.uint32(8 * j)
    return v & _MASK[_LEN[c].ravel()[:n]]


def block(doc_ids: list, ids: list[np.ndarray], rank_of: np.ndarray) -> bytes:
    flat = np.concatenate(ids)
    control, data = pack(rank_of[flat])
    known = np.array([d is not None for d in doc_ids], np.uint8)
    table = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + known.tobytes() + np.array([len(x) for x in ids], "<u8").tobytes()
    return HEAD.pack(MAGIC, len(ids), len(flat), len(control), len(data)) + table + control + data


def blocks(stream):
    """Yield (doc_ids, known, lengths, ranks) of each block of an open file."""
    while head := stream.read(HEAD.size):
        magic, n, tokens, nc, nd = HEAD.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a token file")
        body = stream.read(n * 17 + nc + nd)
        ids, known = np.frombuffer(body, "<i8", n), np.frombuffer(body, np.uint8, n, n * 8)
        lens = np.frombuffer(body, "<u8", n, n * 9).astype(np.int64)
        at = n * 17
        yield ids, known, lens, unpack(body[at:at + nc], body[at + nc:at + nc + nd], tokens)


def write(encoded: DataFrame, folder: str, order: np.ndarray, dtype: str) -> DataFrame:
    """Write the token files; returns the manifest (part, idx, name, n_docs, n_tokens)."""
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    bc = encoded.sparkSession.sparkContext.broadcast(rank_of)  # at most the vocabulary
    schema = pa.schema([("part", pa.int32()), ("idx", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        import uuid

        def rows():
            for b in batches:
                step = max(1, min(512, (4 << 20) * len(b) // max(b.column(3).nbytes, 1)))
                for i in range(0, len(b), step):
                    yield from zip(*[c.to_pylist() for c in b.slice(i, step).columns])

        it, row = rows(), None
        row = next(it, None)
        while row:
            start, n_docs, n_tokens = row[:2], 0, 0

            def chunks():  # one file: the run of consecutive documents of a part
                nonlocal row, n_docs, n_tokens
                ids, got, size = [], [], 0
                while row and row[0] == start[0] and row[1] == start[1] + n_docs:
                    x = np.frombuffer(row[3], dtype)
                    ids.append(row[2])
                    got.append(x)
                    size += len(x)
                    n_docs, n_tokens = n_docs + 1, n_tokens + len(x)
                    row = next(it, None)
                    if size >= BLOCK_TOKENS:
                        yield block(ids, got, bc.value)
                        ids, got, size = [], [], 0
                if ids:
                    yield block(ids, got, bc.value)

            name = f"{start[0]:06d}-{start[1]:012d}-{uuid.uuid4().hex}.tok"
            write_bytes(folder, name, chunks())
            yield batch(schema, [start[0]], [start[1]], [name], [n_docs], [n_tokens])

    manifest = encoded.select("part", "idx", "doc_id", "ids").mapInArrow(run, "part int, idx bigint, name string, n_docs bigint, n_tokens bigint")
    return pin(manifest, "token-manifest")


def read(manifest: DataFrame, folder: str, order: np.ndarray, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the files."""
    spark = manifest.sparkSession
    files, base = [], 0
    for part, idx, name, _, n in sorted(manifest.collect(), key=lambda r: (r[0], r[1])):  # a row per file
        files.append((name, base))
        base += n
    todo = spark.createDataFrame(files, "name string, base bigint").repartition(max(1, min(len(files), 4 * shuffle_partitions(spark))))
    bc = spark.sparkContext.broadcast(order.astype("<u4"))  # at most the vocabulary
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def run(batches):
        for b in batches:
            for name, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f, path = filesystem(folder)
                with f.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for ids, known, lens, rk in blocks(stream):
                        flat = bc.value[rk]
                        ends = np.cumsum(lens)
                        raw = memoryview(flat.tobytes())
                        crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lens.tolist())]
                        doc = pa.array(ids.astype(np.int64), mask=known == 0)
                        more = [[bytes(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lens.tolist())]] * with_ids
                        yield batch(schema, doc, at + ends - lens, lens, crc, *more)
                        at += int(lens.sum())

    return todo.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, with_ids: bool = False,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, rank, write and read back; ``folder`` is a URI that all executors share."""
    folder = folder or scratch(docs.sparkSession, "token-files")
    tokenizer = load(tokenizer_path)
    kind = kind_of(tokenizer)
    dtype = kind[0]
    encoded = encode(docs, tokenizer, kind, id_col=id_col, text_col=text_col)
    order = ranks(encoded, dtype)
    return read(write(encoded, folder, order, dtype), folder, order, with_ids)
