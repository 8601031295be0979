"""Operator 13 against a search over all edits of each conversation."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import types as T

from ordlab.llm import conversations as C

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                       T.StructField("text", T.StringType()), T.StructField("pos", T.StringType()), T.StructField("copies", T.StringType()),
                       T.StructField("code", T.IntegerType()), T.StructField("block", T.StringType())])
SHOWN = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def best_edits(rows, faults):
    """(cost, audit) over all edits, by search over suffixes; an insertion is never needed three times in a row."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def search(i, state, inserted):
        ways = []
        if i == len(rows):
            if state in ("", "a"):
                ways.append((0, "", None))
        else:
            if faults[i] not in ("blank", "duplicate"):
                cut = 5 * (faults[i] == "truncated")
                init, to = rows[i][2][:1], follow[state]
                if init == to or (init == "s" and state == ""):
                    ways.append((cut, "K", (i + 1, init, 0)))
                ways.append((1 + cut, "R", (i + 1, to, 0)))
            ways.append((2, "D", (i + 1, state, 0)))
        if inserted < 2:
            ways.append((5, "I", (i, follow[state], inserted + 1)))
        found = []
        for cost, letter, to in ways:
            c, a = (0, "") if to is None else search(*to)
            if c is not None:
                found.append((cost + c, letter + a))
        return min(found, default=(None, ""))

    return search(0, "", 0)


def expected(all_rows):
    groups = defaultdict(list)
    for r in damaged(all_rows):
        groups[r[0]].append(r)
    out = []
    for conv in {r[0] for r in all_rows}:
        rows = sorted(groups[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in rows:
            shown = SHOWN.findall(text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = {r[1] for r in rows} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit = best_edits(rows, faults)
        lines, state, left = [], "", iter(rows)
        for e in audit:
            row = None if e == "I" else next(left)
            if e == "D":
                continue
            to = row[2][:1] if e == "K" else {"": "u", "s": "u", "u": "a", "a": "u"}[state]
            lines.append(("" if e == "I" else row[3], row[2] if e == "K" else {"u": "user", "a": "assistant"}[to]))
            state = to
        sha = hashlib.sha256("\n".join(f"{role}:{text}" for text, role in lines).encode()).hexdigest()
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def cases():
    rng = random.Random(11)
    texts = ["Yes.", "No!", "what?", "cut", " \t", "", "so. \n", "Ünï.", None]
    rows = []
    for conv in range(220):
        for turn in range(rng.randrange(1, 14)):
            if rng.random() < 0.9:
                role = rng.choice(["system", "user", "assistant", "user", "assistant", "user", "assistant", "tool", None, "", "User"])
                rows.append((conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 2]), role, rng.choice(texts) if rng.random() < 0.4 else f"t{rng.random()}."))
    rows += rows[5:40]  # repeated rows
    for turn in range(130):  # longer than many blocks of the small setting
        rows.append((None, turn, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"c{turn}."])))
        rows.append((-7, turn, rng.choice(["user", "user", "assistant"]), f"x{turn}" + rng.choice([".", "", "."])))
    rows += [(900, t, "user", f"long {t} " * 2000 + ".") for t in range(3)]
    return [(*r, "x", "y", 1, None) for r in rows]


@pytest.mark.parametrize("block,fan", [(C.BLOCK, C.FAN), (4, 3)])
def test_report_equals_the_search(spark, monkeypatch, block, fan):
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "FAN", fan)
    rows = cases()
    got = sorted(map(tuple, C.damage_and_repair(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == expected(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be nice."), (1, 1, "tool", "cut off"), (1, 2, "assistant", "Yes."), (1, 3, "user", "Why?"), (2, 0, "user", " "), (3, 0, "user", "Hi.")]
    out = C.repaired(C.edit_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).orderBy("conv_id", "line").collect()
    # KDRR costs 4: the cut off row goes, two rows are renamed; a lone row is deleted (2) sooner than answered (5)
    assert [(r.conv_id, r.role, r.text) for r in out] == [(1, "system", "Be nice."), (1, "user", "Yes."), (1, "assistant", "Why?")]


def test_prices_are_distances():
    rng = random.Random(2)
    for _ in range(200):
        codes = [rng.choice([-1, 0, 1, 2, 3, 4, 5, 6, 7]) for _ in range(rng.randrange(1, 60))]
        ends = [rng.randrange(12) for _ in range(4)]
        dist = list(ends)
        for code in reversed(codes):
            arcs = C.lattice([code], dist)[:4]
            new = [min(c + dist[to - 4] for _, c, to in out if to >= 4) for out in arcs]
            for _ in range(3):  # insertions stay in the column
                new = [min([new[s]] + [c + new[to] for _, c, to in arcs[s] if to < 4]) for s in range(4)]
            dist = new
        assert C.solve(codes, ends)[1] == dist
        assert C.follow(C.distances(codes), ends) == dist


def test_empty(spark):
    assert C.damage_and_repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_many_copies_of_one_row(spark):
    rows = [(None, None, None, None)] * 3000 + [(1, 1, "user", "Hi.")] * 3000
    got = {r.conv_id: r for r in C.report(C.edit_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert (got[None].blank, got[None].cost, got[None].illegal, got[None].audit) == (3000, 6000, 2999, "D" * 3000)
    assert (got[1].duplicate, got[1].cost, got[1].audit) == (2999, 6000, "D" * 3000)
