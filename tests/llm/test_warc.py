"""Operator 3: an exact round trip, revisits, and an archive read by hand."""

import base64
import hashlib
import os
import struct

import zstandard

from ordlab.llm import warc
from ordlab.llm.common import scratch

PAGES = "page_id bigint, url string, html string, digest int, name string"
BIG = "<p>" + "long " * 200_000


def pages(spark):
    rows = [(3, "http://a/", "<p>one</p>"), (1, "http://b/ü\n", "<p>one</p>"), (2, None, "<p>one</p>"), (4, "u", None), (5, "u", ""),
            (None, "u", "<p>one</p>"), (6, "u", BIG), (7, "u", "tail\r\n\r\nmore"), (7, "u2", "tail\r\n\r\nmore"), (8, "u", "x"), (8, "u", "y"),
            (None, None, "lonely"), (None, "v", "lonely")]
    rows += [(100 + i, f"http://h/{i}", f"<html><title>{i}</title>" + "same words again " * 20) for i in range(200)]
    return spark.createDataFrame([(*r, 1, "n") for r in rows], PAGES), rows


def test_round_trip_and_revisits(spark):
    df, rows = pages(spark)
    folder = scratch(spark, "warc-test")
    got = warc.warc_files(df.repartition(3), folder, with_payload=True).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        f = first.get(h or "")
        kind = "response" if f is None or f == i else "revisit"
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, f if kind == "revisit" else None,
                     raw if kind == "response" else None))
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    keys = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    assert sorted([tuple(None if r[k] is None else bytes(r[k]) if k == "payload" else r[k] for k in keys) for r in got], key=order) == sorted(want, key=order)
    assert {r["url"] for r in got if r["page_id"] == 3} == {"http://a/"}


def test_each_record_is_a_frame_behind_a_dictionary(spark):
    df, rows = pages(spark)
    folder = scratch(spark, "warc-test")
    manifest = warc.write(df.coalesce(1), folder).collect()
    for m in manifest:
        data = open(os.path.join(folder.removeprefix("file://"), m["name"]), "rb").read()
        assert len(data) == m["n_bytes"]
        magic, n = struct.unpack_from("<II", data)
        assert magic == 0x184D2A5D and len(list(warc.records_of(data))) == m["n_records"]
        if n:
            d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + n]))
            assert d.decompressobj().decompress(data[8 + n:]).startswith(b"WARC/1.1\r\n")
    assert any(m["n_records"] > 100 for m in manifest)


def test_min_bytes_and_empty(spark):
    df, _ = pages(spark)
    got = warc.warc_files(df, min_bytes=1000).collect()
    assert {r["record_type"] for r in got} == {"response"}
    assert warc.warc_files(df.limit(0)).collect() == []


def test_reading_is_linear_and_a_record_can_be_read_alone(spark, monkeypatch):
    df, rows = pages(spark)
    folder = scratch(spark, "warc-test")
    manifest = warc.write(df.coalesce(1), folder).collect()
    seen = 0
    for m in manifest:
        data = open(os.path.join(folder.removeprefix("file://"), m["name"]), "rb").read()
        whole = list(warc.records_of(data))
        for feed in (7, 1000):  # a frame's end anywhere in what is fed
            monkeypatch.setattr(warc, "FEED", feed)
            assert list(warc.records_of(data)) == whole
        assert len(m["offsets"]) == m["n_records"] + 1 and m["offsets"][-1] == m["n_bytes"]
        for i, raw in enumerate(whole):
            assert warc.record_at(folder, m["name"], m["offsets"][i], m["offsets"][i + 1] - m["offsets"][i]) == warc.parse_record(raw)
            seen += 1
    assert seen == len(rows)


def test_several_archives_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    df, rows = pages(spark)
    folder = scratch(spark, "warc-test")
    manifest = warc.write(df.coalesce(1), folder)
    assert manifest.count() > 5
    got = warc.read(manifest, folder).collect()
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(r[0]) for r in rows)
