"""Conversation structure repair by an auction shortest path (operator 13).

The rows of a conversation, by turn, are to become one whose role initials read
``(s?(ua)+)?``, at the least cost: keep 0, change the role to user or assistant
1, delete 2, insert an empty user or assistant row 5, and 5 for each row that
stays though its text is cut off.  Blank and repeated rows must go.

1. Equal rows are counted first, so that copies are one row from then on.
2. Rows are numbered in the order of (conversation, turn, role, SHA-256 of the
   text) by ranges, and blocks of 2,048 consecutive rows are the unit of work: a
   conversation of any length is spread over as many blocks as it fills.
3. Nodes of the lattice are (rows done, state), a state being what the output
   ends in: nothing, s, u or a.  The auction raises node prices and extends or
   contracts a path until it reaches the end; at the end the price of its first
   node is its distance.  Prices only rise, so paths from all four states of a
   strip of 16 rows are found one after another, strips from the last to the first.
4. All cheapest paths run along tight arcs (price = cost + price of the target).
   Tight arcs that lead to the end are traced by least initial: D < I < K < R.
5. Conversations that touch a block's edge are put together by the 4 x 4
   distances of their pieces (backwards, for the prices at each piece's end) and by
   the state that each piece's trace ends in (forwards).  Both are scans in
   levels of 2,048 pieces, so that no group grows with a conversation.

The digest of a repaired conversation needs its rows in order; one task streams
them from a sorted partition and holds one row at a time.

Nulls: text and role are one space; null turns come first; null conv_ids are one
conversation.  Rows of one turn follow by role, then by the text's SHA-256; equal
ones are copies.  Empty and very long texts are rows like others.  Empty table:
no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordlab.llm.common import batch, materialize, narrow
from ordlab.operators.frame import match
from ordlab.operators.rank import position

BLOCK, FAN, STRIP = 2048, 2048, 16
STATES = NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: what follows each state: an inserted or renamed row takes that role
NEXT = (USER, USER, ASSISTANT, USER)
MADE = "-sua"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
#: letters that end a conversation in each state, and their cost; the fifth number marks the end
TAIL = ("", "II", "I", "")
END = [0, 2 * INSERT, INSERT, 0, 1]
FORCED = -1
WHITE = " \t\n\x0b\x0c\r"


def lattice(codes: list[int], ends: list) -> list[list[tuple]]:
    """Arcs (initial, cost, target) of the nodes of a strip; node 4 i + s is
    state s after i rows.  ``ends`` are the costs from its end, None for no way."""
    arcs, sink = [], 4 * (len(codes) + 1)
    for i, code in enumerate(codes):
        for s in STATES:
            below = 4 * (i + 1)
            if code == FORCED:  # its own cost is the same on every path
                out = [("D", 0, below + s)]
            else:
                cut, init = divmod(code, 4)
                out = [("D", DELETE, below + s), ("R", REROLE + CUT_OFF * cut, below + NEXT[s])]
                if init == NEXT[s] or (init == SYSTEM and s == NOTHING):
                    out.append(("K", KEEP + CUT_OFF * cut, below + init))
            arcs.append([*out, ("I", INSERT, 4 * i + NEXT[s])])
    return arcs + [[("", c, sink)] if c is not None else [] for c in ends]


def reaching(arcs: list[list[tuple]]) -> list[list[tuple]]:
    """Only the arcs that lead on to the end."""
    good = [False] * len(arcs) + [True]
    for first in range(len(arcs) - 4, -1, -4):
        for _ in STATES:  # inserted rows stay in one column
            for node in range(first, first + 4):
                good[node] = good[node] or any(good[a[2]] for a in arcs[node])
    return [[a for a in out if good[a[2]]] for out in arcs]


def auction(arcs: list[list[tuple]], origin: int, price: list[int]) -> None:
    """Raise ``price`` until a cheapest path from ``origin`` to the end is tight.
    Keeps price[i] <= cost + price[j] on all arcs, with equality on the path."""
    path, sink = [origin], len(arcs)
    while path[-1] != sink:
        i = path[-1]
        least, best = min((cost + price[j], j) for _, cost, j in arcs[i])
        if price[i] < least:
            price[i] = least
            if len(path) > 1:
                path.pop()
        else:
            path.append(best)


def solve(codes: list[int], ends: list) -> tuple[list, list]:
    """Converged (arcs, prices) of the strips in order, and the distance to the
    end from each state at the start (None: no way there)."""
    strips = []
    for a in range((max(len(codes), 1) - 1) // STRIP * STRIP, -1, -STRIP):
        base = min(e for e in ends if e is not None)
        arcs = reaching(lattice(codes[a:a + STRIP], [None if e is None else e - base for e in ends]))
        price = [0] * (len(arcs) + 1)
        for s in STATES:
            if arcs[s]:
                auction(arcs, s, price)
        ends = [price[s] + base if arcs[s] else None for s in STATES]
        strips.append((arcs, price))
    return strips[::-1], ends


def trace(codes: list[int], ends: list, start: int) -> tuple[list[str], list[str], int]:
    """Per row the initials of its edits and what they made, and the last state."""
    edits, made, state = [], [], start
    for arcs, price in solve(codes, ends[:4])[0]:
        tight = reaching([[a for a in out if price[i] == a[1] + price[a[2]]] for i, out in enumerate(arcs)])
        node, e, m = state, "", ""
        while True:
            initial, _, to = min(tight[node])
            if not initial:
                state = node % 4
                break
            e += initial
            m += "" if initial == "D" else MADE[to % 4]
            if initial != "I":
                edits.append(e)
                made.append(m)
                e = m = ""
            node = to
    return edits, made, state


def distances(codes: list[int]) -> list[int]:
    """Distance from each state before the rows to each state after them (-1: no way)."""
    columns = [solve(codes, [0 if s == t else None for s in STATES])[1] for t in STATES]
    return [-1 if columns[t][s] is None else columns[t][s] for s in STATES for t in STATES]


def follow(m: list[int], ends: list[int]) -> list[int]:
    """Distance to the end from each state before a piece with distances ``m``."""
    return [min(m[4 * s + t] + ends[t] for t in STATES if m[4 * s + t] >= 0) for s in STATES]


def chain_distances(ms: list[list[int]]) -> list[int]:
    """Distances over pieces that follow each other."""
    out = [0 if s == t else -1 for s in STATES for t in STATES]
    for m in ms:
        out = [min((out[4 * s + k] + m[4 * k + t] for k in STATES if out[4 * s + k] >= 0 and m[4 * k + t] >= 0), default=-1)
               for s in STATES for t in STATES]
    return out


def sweep_ends(ms: list[list[int]], ends: list[int]) -> list[list[int]]:
    """Distance to the end from each state after each piece; ``ends`` holds after the last one."""
    out = [list(ends)]
    for m in ms[:0:-1]:
        out.append([*follow(m, out[-1]), 0])
    return out[::-1]


def chain_states(maps: list[list[int]]) -> list[int]:
    """Last state for each first one, over pieces that follow each other."""
    out = list(STATES)
    for m in maps:
        out = [m[s] for s in out]
    return out


def sweep_states(maps: list[list[int]], start: list[int]) -> list[list[int]]:
    """State before each piece; ``start`` holds before the first one."""
    out = [list(start)]
    for m in maps[:-1]:
        out.append([m[out[-1][0]]])
    return out


def _udf(fn, returns: str):
    return F.udf(fn, returns, useArrow=True)


def scan(pieces: DataFrame, chain, sweep, seed: list[int], levels: int) -> DataFrame:
    """For pieces (conv, block, v) what ``sweep`` hands to each, as (conv, block,
    got).  Groups hold ``FAN`` pieces at most; their chains are the next level's pieces."""
    groups = materialize(pieces.groupBy("conv", F.expr(f"block div {FAN}").alias("up"))
                         .agg(F.sort_array(F.collect_list(F.struct("block", "v"))).alias("xs")), "scan")
    values = F.col("xs.v")
    if levels:
        above = groups.select("conv", F.col("up").alias("block"), _udf(chain, "array<bigint>")(values).alias("v"))
        seeds = scan(above, chain, sweep, seed, levels - 1).withColumnRenamed("block", "up").withColumnRenamed("got", "seed")
        groups = match(groups, seeds, ["conv", "up"], "inner")
    else:
        groups = groups.withColumn("seed", F.array(*[F.lit(x).cast("bigint") for x in seed]))
    got = _udf(sweep, "array<array<bigint>>")(values, F.col("seed"))
    return groups.select("conv", F.explode(F.arrays_zip(F.col("xs.block").alias("block"), got.alias("got"))).alias("x")).select("conv", "x.block", "x.got")


def _traced(open_pieces: bool):
    """Arrow function: pieces (conv, block, rows[, ends, start]) -> (pos, edits, made, tail) of every row."""
    schema = pa.schema([("pos", pa.int64()), ("edits", pa.string()), ("made", pa.string()), ("tail", pa.string())])

    def run(batches):
        for b in batches:
            cols = [[], [], [], []]
            for r in b.to_pylist():
                ends, start = (r["ends"], r["start"][0]) if open_pieces else (END, NOTHING)
                edits, made, last = trace([x["code"] for x in r["rows"]], ends, start)
                cols[0] += [x["pos"] for x in r["rows"]]
                cols[1] += edits
                cols[2] += made
                cols[3] += [""] * (len(edits) - 1) + [TAIL[last] if ends[4] else ""]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def edit_rows(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as distinct rows in order with their
    edits: conv, pos, turn, role, text, copies, code, fault (of the first copy),
    edits (initials up to the row's own), made (initials of the rows that these make;
    "u" and "a" of I and R are user and assistant) and tail (insertions at the end)."""
    src = narrow(rows, conv="conv_id", turn="turn", role=F.coalesce(F.col("`role`"), F.lit(" ")), text=F.coalesce(F.col("`text`"), F.lit(" ")))
    counted = src.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    placed = position(counted, ["conv", "turn", "role", "digest"], "pos")
    firsts = placed.groupBy("conv", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    shown = F.rtrim("text", F.lit(WHITE))
    last = F.right(shown, F.lit(1))
    init = F.substring("role", 1, 1)
    code = F.when(init == "s", SYSTEM).when(init == "u", USER).when(init == "a", ASSISTANT).otherwise(NOTHING)
    plain = placed.select("pos", "conv", code.alias("init"), (shown == "").alias("blank"), (~last.isin(*".!?")).cast("int").alias("cut"))
    codes = plain.join(firsts, "pos", "left").select(
        "pos", "conv", F.when(F.col("blank") | F.col("is_first").isNull(), FORCED).otherwise(F.col("init") + 4 * F.col("cut")).alias("code"),
        F.when(F.col("blank"), "blank").when(F.col("is_first").isNull(), "duplicate").when(F.col("cut") == 1, "truncated").alias("fault"))
    codes = materialize(codes, "codes")
    block = F.expr(f"pos div {BLOCK}").alias("block")
    pieces = materialize(codes.groupBy(block, "conv").agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("rows")), "pieces")
    at_edge = (F.col("rows")[0]["pos"] % BLOCK == 0) | (F.element_at("rows", -1)["pos"] % BLOCK == BLOCK - 1)
    out_schema = "pos bigint, edits string, made string, tail string"
    whole = pieces.filter(~at_edge).mapInArrow(_traced(False), out_schema)
    cut = pieces.filter(at_edge)
    blocks = (codes.agg(F.max("pos")).collect()[0][0] or 0) // BLOCK + 1
    levels = 0
    while FAN ** (levels + 1) < blocks:
        levels += 1
    key = ["conv", "block"]
    only_codes = F.col("rows.code")
    ends = scan(cut.select(*key, _udf(distances, "array<bigint>")(only_codes).alias("v")), chain_distances, sweep_ends, END, levels)
    cut = materialize(match(cut, ends.withColumnRenamed("got", "ends"), key, "inner"), "ends")
    last_states = _udf(lambda c, e: [trace(c, e, s)[2] for s in STATES], "array<bigint>")(only_codes, F.col("ends"))
    starts = scan(cut.select(*key, last_states.alias("v")), chain_states, sweep_states, [NOTHING], levels)
    pieced = match(cut, starts.withColumnRenamed("got", "start"), key, "inner").mapInArrow(_traced(True), out_schema)
    return placed.drop("digest").join(codes.drop("conv"), "pos").join(whole.unionByName(pieced), "pos")


def repaired(edited: DataFrame) -> DataFrame:
    """The repaired conversations as rows (conv_id, line, role, text); lines of
    a conversation are in the order of ``line`` = (pos, place)."""
    names = F.when(F.col("m") == "u", "user").otherwise("assistant")
    letters = F.concat(F.translate("edits", "D", ""), "tail")
    made = F.concat("made", F.when(F.col("tail") == "II", "ua").when(F.col("tail") == "I", "a").otherwise(""))
    r = edited.withColumn("letters", letters).withColumn("made", made).filter("letters <> ''")
    r = r.select("*", F.explode(F.sequence(F.lit(1), F.length("letters"))).alias("place"))
    r = r.withColumn("e", F.expr("substring(letters, place, 1)")).withColumn("m", F.expr("substring(made, place, 1)"))
    return r.select(F.col("conv").alias("conv_id"), F.struct("pos", "place").alias("line"),
                    F.when(F.col("e") == "K", F.col("role")).otherwise(names).alias("role"),
                    F.when(F.col("e") == "I", "").otherwise(F.col("text")).alias("text"))


class Report:
    """Running figures of one conversation, fed row by row."""

    COST = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
    LEGAL = {"su", "ua", "au"}
    NAMES = {"u": "user", "a": "assistant"}

    def __init__(self):
        self.low = self.high = self.turn = None
        self.turns = self.illegal = self.cost = 0
        self.fault = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.audit, self.hash, self.lines, self.before = [], hashlib.sha256(), 0, None

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def add(self, turn, role: str, text: str, copies: int, fault, edits: str, made: str, tail: str) -> None:
        if turn is not None:
            self.low, self.high = min(turn, turn if self.low is None else self.low), max(turn, turn if self.high is None else self.high)
            self.turns += turn != self.turn
            self.turn = turn
        if fault:
            self.fault[fault] += copies if fault != "truncated" else 1
        if fault not in ("blank", "duplicate"):
            self.fault["duplicate"] += copies - 1
        init = role[:1]
        self.illegal += (self.before is not None and self.before + init not in self.LEGAL) + (copies - 1) * (init + init not in self.LEGAL)
        self.before = init
        self.audit += [edits, "D" * (copies - 1), tail]
        self.cost += sum(map(self.COST.get, edits + tail)) + DELETE * (copies - 1) + CUT_OFF * (fault == "truncated" and edits[-1] != "D")
        names = iter(made)
        for e in edits:
            if e != "D":
                name = next(names)
                self.line(role if e == "K" else self.NAMES[name], "" if e == "I" else text)
        for name in ("user", "assistant")[2 - len(tail):]:
            self.line(name, "")

    def row(self, conv) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (conv, gaps, *self.fault.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def report(edited: DataFrame) -> DataFrame:
    """Per conversation: gaps, faults, illegal neighbours, cost, audit and the
    digest of the repaired rows, streamed from sorted partitions."""
    cols = ["turn", "role", "text", "copies", "fault", "edits", "made", "tail"]
    conv_type = edited.schema["conv"].dataType.simpleString()
    fields = [pa.field(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    fields += [pa.field(c, pa.string()) for c in ("audit", "repaired_sha256")]

    def run(batches):
        conv, now, schema = None, None, None
        for b in batches:
            schema = pa.schema([pa.field("conv_id", b.schema.field("conv").type), *fields])
            out = []
            for r in b.to_pylist():
                if now is None or r["conv"] != conv:
                    if now is not None:
                        out.append(now.row(conv))
                    conv, now = r["conv"], Report()
                now.add(*[r[c] for c in cols])
            if out:
                yield batch(schema, *zip(*out))
        if now is not None:
            yield batch(schema, *zip(now.row(conv)))

    rows = edited.select("conv", "pos", *cols).repartition("conv").sortWithinPartitions("conv", "pos")
    return rows.mapInArrow(run, f"conv_id {conv_type}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """The conversations with the faults that crc32(conv_id:turn) mod 20 names."""
    def blank(c):
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))

    d = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    r = narrow(rows, conv_id="conv_id", turn="turn", role=blank("role"), text=blank("text"), d=d).filter("d <> 0")
    text: Column = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return r.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    F.explode(F.when(F.col("d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def damage_and_repair(rows: DataFrame) -> DataFrame:
    """``report`` of every conversation of the table, also of those that lost all rows."""
    ids = narrow(rows, conv_id="conv_id").distinct()
    done = match(ids, report(edit_rows(damage(rows))), ["conv_id"], "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return done.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
