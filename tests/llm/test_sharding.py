"""Operator 10: the law of equal bytes, gapless slots, groups of equal texts."""

import zlib
from collections import defaultdict

import pytest

from ordlab.llm import sharding
from ordlab.llm.common import scratch
from tests.conftest import SF_MID
from tests.llm.conftest import DOC, doc


def check(got, rows, n):
    size = lambda t: len((t or "").encode()) + 8
    assert sorted([(r["doc_id"], r["size"], r["text_crc32"]) for r in got], key=str) == sorted(
        [(i, size(t), zlib.crc32((t or "").encode())) for i, t in rows], key=str)
    assert {(r["law"], r["grown_shard"]) for r in got} <= {("bytes", None)}
    slots, total = defaultdict(list), defaultdict(int)
    for r in got:
        assert 0 <= r["shard"] < n
        slots[r["shard"]].append(r["slot"])
        total[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share, largest = sum(total.values()) / n, max(size(t) for _, t in rows)
    assert all(abs(total[s] - share) <= largest for s in range(n))


def test_defined_cases(docs, rows, empty):
    check(sharding.place(docs).collect(), [r[:2] for r in rows], 24)
    check(sharding.place(docs, 3, 5).collect(), [r[:2] for r in rows], 3)
    assert sharding.place(empty).collect() == []


def test_one_group_holds_a_third_of_all_rows(spark):
    rows = [doc(i, "the same text again" if i % 3 == 0 else f"text {i} " * (i % 40)) for i in range(3000)]
    got = sharding.place(spark.createDataFrame(rows, DOC)).collect()
    check(got, [r[:2] for r in rows], 24)
    groups = defaultdict(set)
    for r in got:
        groups[r["text_crc32"]].add(r["shard"])
    assert sum(len(s) > 1 for s in groups.values()) <= 23  # a boundary splits one group at most


def test_small_groups_stay_whole_and_overfull_ranges_are_divided(spark):
    rows = [doc(i, f"one of {i // 4}") for i in range(4000)] + [doc(None, "hot " * 20)] * 3000 + [doc(9999, "long " * 20000)]
    df = spark.createDataFrame(rows, DOC)
    got = sharding.place(df, 4).collect()
    check(got, [r[:2] for r in rows], 4)
    groups = defaultdict(set)
    for r in got:
        groups[r["text_crc32"]].add(r["shard"])
    assert [c for c, s in groups.items() if len(s) > 1] == [zlib.crc32(b"hot " * 20)]
    keys = sharding._keys(df, "doc_id", "text")
    total = keys.agg({"size": "sum"}).first()[0]
    _, per = sharding.ranges(keys, 128, total)
    assert all(n == 1 or b <= sharding.OVERFULL * total / 128 for _, b, n in per)
    assert (sum(b for _, b, _ in per), sum(n for *_, n in per)) == (total, len(rows))


def test_records_of_more_than_a_range(spark):
    rows = [doc(i, "x") for i in range(500)] + [doc(1000 + i, f"{i} " * 300000) for i in range(3)]
    check(sharding.place(spark.createDataFrame(rows, DOC), 5).collect(), [r[:2] for r in rows], 5)


@pytest.mark.parametrize("ranges", [None, 100])
def test_table_and_any_partitioning(spark, ranges):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    got = sorted(map(str, sharding.place(docs, 24, ranges).collect()))
    assert got == sorted(map(str, sharding.place(docs.repartition(7), 24, ranges).collect()))
    check(sharding.place(docs, 24, ranges).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], 24)


def test_written_shards_hold_all_rows(spark, docs, rows):
    back = sharding.write_shards(docs, scratch(spark, "shards"), 4)
    assert set(DOC.names) <= set(back.columns)
    assert sorted([str((r["doc_id"], r["text"], r["lang"], r["size"])) for r in back.collect()]) == sorted(str((r[0], r[1], r[2], "x")) for r in rows)
    assert back.select("__shard", "__slot").distinct().count() == len(rows)


def test_columns_of_any_name_come_through(spark):
    names = ["__id", "__crc", "__k", "__slot", "_id", "_k"]
    rows = [(i, f"text {i % 7}", *[f"{c}-{i}" for c in names]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    got = sharding.write_shards(df, scratch(spark, "shards-test"), 5)
    assert sorted(tuple(r) for r in got.select(*df.columns).collect()) == sorted(rows)
    assert "___slot" in got.columns and {r[0] for r in got.select("__shard").distinct().collect()} <= set(range(5))
