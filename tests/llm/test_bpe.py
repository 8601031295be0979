"""Operator 11: ids equal the tiktoken library's, bytes come back."""

import hashlib
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import types as T

import public_tokenizers as P
from ordlab.llm import bpe, kernels

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return bpe.read_ranks(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder(ranks):
    return bpe.Bpe(ranks, bpe.character_classes())


def encoded(coder, texts):
    out = []
    for _, buf, off in kernels.slices(pa.array(texts)):
        ids, first = coder.encode(buf, off)
        out += [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    return out


def thue_morse(n):
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x


def test_ids_equal_the_library(coder, library):
    rng = random.Random(5)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "7", "²", "٣", "é", "ß", "漢字",
             "!", "..", "\U0001f600", "́", "࢏", "K", "the", " of", "\r\n", "<|endoftext|>"]
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(5000)]
    texts += ["".join(rng.choices(every, k=15)) for _ in range(1000)]
    texts += ["", " ", "a" * 3000, "ab" * 2000, " " * 500, "\n" * 7 + "x", "'s't're've'm'll'd'", "''s"]
    got = encoded(coder, texts)
    assert got == [library.encode_ordinary(t) for t in texts]
    assert all(coder.decode(np.array(g, np.uint32)).tobytes() == t.encode() for g, t in zip(got, texts))


def test_pieces_of_one_hash_are_told_apart(coder, library):
    one = thue_morse(2048)
    texts = [one, one.translate(str.maketrans("ab", "ba"))]
    assert encoded(coder, texts) == [library.encode_ordinary(t) for t in texts]


def test_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64))
    h = bpe.MinimalHash(keys)
    assert sorted(h(keys).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError):
        bpe.MinimalHash(np.array([3, 3], np.uint64))


def test_windows_give_the_ids_of_the_whole(coder):
    buf = np.frombuffer(("word 12 'tis  über\n" * 3000 + "x" * 5000 + " end").encode(), np.uint8)
    whole = coder.encode(buf, np.array([0, len(buf)]))[0]
    parts = list(bpe.windows(buf, 700))
    assert len(parts) > 20 and b"".join(p.tobytes() for p in parts) == buf.tobytes()
    assert (np.concatenate([coder.encode(p, np.array([0, len(p)]))[0] for p in parts]) == whole).all()


def test_unknown_id_is_an_error(coder):
    with pytest.raises(ValueError):
        coder.decode(np.array([60000], np.uint32))


def test_rows(spark, library):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType()),
                           T.StructField("decoded", T.StringType())])
    long = "éa b'll 12\n" * 400_000  # longer than two windows
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (3, "Hello, world's", None, None), (3, "Hello, world's", None, None), (None, "x", "", ""), (4, long, "", "")]
    got = bpe.round_trip(spark.createDataFrame(rows, schema).repartition(2), PATH).collect()
    want = []
    for doc, text, _, _ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert bpe.round_trip(spark.createDataFrame([], schema), PATH).collect() == []
