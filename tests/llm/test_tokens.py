"""Operator 4: ids of the library itself, the coding, and the files."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ordlab.llm import kernels, tokens

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def by_pieces(enc, texts, size):
    out = []
    for _, buf, off in kernels.slices(pa.array(texts), size):
        flat, at = enc.ids(buf, off)
        out += [flat[a:b].tolist() for a, b in zip(at, at[1:])]
    return out


def test_pieces_give_the_ids_of_whole_texts(library, monkeypatch):
    r = random.Random(5)
    marks = ["a", "b", " ", "  ", "\n", ".", ",", "'s", "é", "1", "!", "\t", "-", "日", " ", "　", "\r", "$", "(", "Z", "'", "\x85", "😀", "<|endoftext|>"]
    texts = ["".join(r.choice(marks) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    enc = tokens.PieceEncoder(tokens.load(PATH))
    assert by_pieces(enc, texts, 1 << 20) == want
    monkeypatch.setattr(tokens, "PIECES", 300)  # a memory that is emptied again and again
    assert by_pieces(tokens.PieceEncoder(tokens.load(PATH)), texts, 2000) == want


def test_coding_round_trip():
    for n in (0, 1, 3, 4, 5, 1001):
        v = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) >> np.random.default_rng(n + 1).integers(0, 32, n).astype(np.uint32)
        control, data = tokens.pack(v)
        assert len(control) == -(-n // 4) and (tokens.unpack(control, data, n) == v).all()
    assert len(tokens.pack(np.array([0, 255, 256, 65536], np.uint32))[1]) == 1 + 1 + 2 + 3


def test_files_hold_every_document(spark, docs, rows, library):
    got = tokens.token_files(docs, PATH, with_ids=True).collect()
    from pyspark.sql import functions as F
    h = {r["t"]: r["h"] for r in docs.select(F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h[r[1] or ""]))
    want, start = [], 0
    for r in ordered:
        ids = np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        want.append((r[0], start, len(ids) // 4, zlib.crc32(ids), ids))
        start += len(ids) // 4
    assert sorted([(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in got], key=lambda r: r[1]) == want


def test_empty(empty):
    assert tokens.token_files(empty, PATH).collect() == []


def thue_morse(n):
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x


def test_structured_words_and_added_tokens(library):
    one = thue_morse(4096)
    two = one.translate(str.maketrans("ab", "ba"))
    texts = [one, two, f"x {one} y", f"x {two} y", "a<|endoftext|>b", "<|endoftext|>", "x<|endoftext", "|>y", " <|endoftext|>\n<|endoftext|> end", ""]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert want[4] == [64, 50256, 65] and want[0] != want[1]
    for size in (1 << 20, 3000):
        assert by_pieces(tokens.PieceEncoder(tokens.load(PATH)), texts, size) == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_tokenizers_get_whole_texts(name):
    from tokenizers import Tokenizer
    enc = tokens.PieceEncoder(tokens.load(P.path(name)))
    assert not enc.cuttable
    texts = ["Hello, World!", "", "a  b\nc", "<|startoftext|> it's"]
    t = Tokenizer.from_file(P.path(name))
    assert by_pieces(enc, texts, 1 << 20) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
