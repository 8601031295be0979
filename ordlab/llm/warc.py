"""WARC archives with a Zstandard dictionary (operator 3).

Records of equal payloads (SHA-1 and length) are written once: the one with the
smallest page_id is a ``response``, the others are ``revisit`` records that name
it.  The smallest page_id of each payload that occurs more than once is found
by a partial aggregate; only the rows that become revisits are joined back.

Each task writes one archive for every ``ARCHIVE_BYTES`` of payload: first a
skippable frame (magic 0x184D2A5D) with a dictionary built from records of this
archive, then each record as a frame of its own, so any record can be read by
its offset.  The dictionary is trained on at most ``SAMPLE_BYTES`` of an
archive's records, taken at even distances through it; it decides the size of
the archive, never its content.  The manifest names the archives committed.

Null payload: empty.  Null page_id: an archive record without a page id; it is
never the first of a group unless all ids of the group are null.  Null url: no
target line.  Rows that repeat the response's page_id and payload are responses
too.  Payloads below ``min_bytes`` are always responses.  Extra columns are
ignored; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordlab.llm.common import batch, filesystem, narrow, pin, scratch, shuffle_partitions, write_bytes

# fixed values: WARC 1.1 and Zstandard dictionary frame
DICT_MAGIC = 0x184D2A5D
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

ARCHIVE_BYTES = 24 << 20
FEED = 64 << 10  # compressed bytes given to the decompressor at a time
DICT_BYTES = 16 << 10
SAMPLE_BYTES = 1 << 20
LEVEL = 3


def record_id(page_id) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'page:null')}>"


def page_of(value: str | None):
    return int(value[len("<urn:page:"):-1]) if value and value.startswith("<urn:page:") else None


def make_record(page_id, url, payload: bytes, revisit_of) -> bytes:
    """One WARC record; a revisit keeps the response's headers and no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = "response" if revisit_of is None else "revisit"
    block = HTTP % len(payload) + (payload if revisit_of is None else b"")
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit_of is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(revisit_of)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one record; ``payload`` is None for a revisit, whose
    ``payload_bytes`` are those that its kept HTTP headers state."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a WARC record")
    f = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(f["Content-Length"])]
    if len(block) != int(f["Content-Length"]) or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = f["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a payload does not match its digest")
    return {"page_id": page_of(f["WARC-Record-ID"]), "url": f.get("WARC-Target-URI"), "payload_bytes": size,
            "payload_digest": digest, "record_type": f["WARC-Type"], "refers_to": page_of(f.get("WARC-Refers-To")),
            "payload": None if revisit else payload}


def archive(records: list[bytes]):
    """Yield the dictionary frame and the frames of the records."""
    import zstandard as zstd
    per = SAMPLE_BYTES // max(1, len(records))
    size = sum(map(len, records))
    step = max(1, -(-size // SAMPLE_BYTES))
    samples = [r[:max(per, 64 << 10)] for r in records[::step]]
    raw = b""
    if len(samples) >= 8 and sum(map(len, samples)) >= 8 * DICT_BYTES:
        raw = zstd.train_dictionary(DICT_BYTES, samples, k=512, d=8).as_bytes()
    yield struct.pack("<II", DICT_MAGIC, len(raw)) + raw
    c = zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(raw) if raw else None,
                            write_content_size=True)
    for r in records:
        yield c.compress(r)


def _reader(data):
    """Decompressor of an archive, from its dictionary frame, and that frame's size."""
    import zstandard as zstd
    magic, n = struct.unpack_from("<II", data)
    if magic != DICT_MAGIC:
        raise ValueError("no dictionary frame")
    raw = bytes(data[8:8 + n])
    return zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw) if raw else None), 8 + n


def records_of(data: bytes):
    """Yield every record of an archive.  Frames are fed in small parts, so that
    what lies behind a frame's end is never copied as a whole."""
    d, at = _reader(data)
    view = memoryview(data)
    while at < len(view):
        one, out = d.decompressobj(), []
        while not one.eof:
            part = view[at:at + FEED]
            if not len(part):
                raise ValueError("a frame is cut short")
            out.append(one.decompress(part))
            at += len(part) - len(one.unused_data)
        yield b"".join(out)


def record_at(folder: str, name: str, offset: int, size: int) -> dict:
    """One record of an archive by the place of its frame (see ``write``): the
    dictionary frame and the record's own are all that is read."""
    f, path = filesystem(folder)
    with f.open_input_file(f"{path}/{name}") as src:
        head = src.read_at(8, 0)
        d, _ = _reader(head + src.read_at(struct.unpack("<II", head)[1], 8))
        return parse_record(d.decompress(src.read_at(size, offset)))


def revisits(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(page_id, digest, refers_to) of the rows whose payload an earlier page holds."""
    p = F.encode(F.coalesce(F.col(f"`{payload_col}`"), F.lit("")), "UTF-8")
    keys = narrow(pages, page_id=id_col, digest=F.sha1(p), n=F.octet_length(p)).filter(F.col("n") >= min_bytes)
    keys = pin(keys, "warc-keys")
    first = keys.groupBy("digest", "n").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    out = keys.join(first, ["digest", "n"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull())
    return pin(out.select("page_id", "digest", "refers_to").distinct(), "warc-revisits")


def write(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
          payload_col: str = "html") -> DataFrame:
    """Write the archives; returns the manifest (name, n_records, n_bytes,
    offsets): the frame of record i lies from offsets[i] to offsets[i + 1]."""
    rows = narrow(pages, page_id=F.col(f"`{id_col}`").cast("bigint"), url=url_col,
                  payload=F.encode(F.coalesce(F.col(f"`{payload_col}`"), F.lit("")), "UTF-8"))
    r = revisits(pages, min_bytes, id_col, payload_col).select(F.col("page_id").alias("__p"), F.col("digest").alias("__d"), "refers_to")
    rows = rows.withColumn("__digest", F.sha1("payload"))
    rows = rows.join(r, rows["page_id"].eqNullSafe(r["__p"]) & (rows["__digest"] == r["__d"]), "left").select("page_id", "url", "payload", "refers_to")
    schema = pa.schema([("name", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("offsets", pa.list_(pa.int64()))])

    def run(batches):
        held, size = [], 0

        def close():
            name = f"{uuid.uuid4().hex}.warc.zst"
            ends = [0]

            def frames():
                for x in archive(held):
                    ends.append(ends[-1] + len(x))
                    yield x

            n_bytes = write_bytes(folder, name, frames())
            return batch(schema, [name], [len(held)], [n_bytes], [ends[1:]])

        for b in batches:
            for i in range(0, len(b), 64):
                for page_id, url, payload, ref in zip(*[c.to_pylist() for c in b.slice(i, 64).columns]):
                    held.append(make_record(page_id, url, payload, ref))
                    size += len(held[-1])
                    if size >= ARCHIVE_BYTES:
                        yield close()
                        held, size = [], 0
        if held:
            yield close()

    return pin(rows.mapInArrow(run, "name string, n_records bigint, n_bytes bigint, offsets array<bigint>"), "warc-manifest")


def read(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives that the manifest names."""
    spark = manifest.sparkSession
    names = manifest.select("name").repartition(4 * shuffle_partitions(spark), "name")
    cols = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload
    schema = pa.schema(cols)

    def run(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                f, path = filesystem(folder)
                with f.open_input_file(f"{path}/{name}") as src:
                    data = src.read()
                got = []
                for raw in records_of(data):
                    got.append(parse_record(raw))
                    if not with_payload:
                        del got[-1]["payload"]
                    if len(got) >= 256:
                        yield pa.RecordBatch.from_pylist(got, schema=schema)
                        got = []
                if got:
                    yield pa.RecordBatch.from_pylist(got, schema=schema)

    ddl = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return names.mapInArrow(run, ddl + ", payload binary" * with_payload)


def warc_files(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Write the archives of ``pages`` and read them back."""
    folder = folder or scratch(pages.sparkSession, "warc")
    return read(write(pages, folder, min_bytes), folder, with_payload)


SQL = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, b32 AS payload_digest,
        min(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS first
      FROM (SELECT *, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v AS INTEGER) + 1, 1), '' ORDER BY k)
                       FROM (SELECT k, ((('0x' || substr(sha1(coalesce(html, '')), 10 * (k // 8) + 1, 10))::BIGINT) >> (35 - 5 * (k % 8))) & 31 AS v
                             FROM (SELECT unnest(range(0, 32)) AS k))) AS b32
            FROM pages))
"""
