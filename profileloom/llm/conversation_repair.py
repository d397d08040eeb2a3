"""Repair of damaged conversations: cheapest edits to a legal order of roles, found by Hirschberg's halving."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profileloom.llm.common import Remembered, hot_hashes, on_worker, salted_join, stored

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a conversation that one task repairs; longer conversations are repaired piece by piece.
PIECE = 4096
#: Pieces whose repairs a worker remembers, twice over.
REMEMBERED = 50_000
FAR = 1 << 60

#: States between rows, after: nothing, a system row, a user row, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The row that may follow a state with a role of its own, and the state it leads to: the other one of user and assistant.
NEXT = (USER, USER, ASSISTANT, USER)
#: Cost and edits of the insertions that end a conversation, by state; only START and ASSISTANT may end one.
ENDS = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))

#: A row's code: s, u, a or o (the first letter of its role, or another), upper case if truncated, and x for a row that must go.
CODES = "suaoSUAOx"


def _moves(code: str) -> list[list[tuple[int, str]]]:
    """For a row's code, by state before and after: the least cost and, of its edits, the ASCII-least; insertions come before the row's own edit."""
    table = [[(FAR, "")] * 4 for _ in STATES]
    role = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(code.lower())
    extra = TRUNCATED if code.isupper() else 0

    def offer(at: int, to: int, cost: int, edits: str) -> None:
        table[at][to] = min(table[at][to], (cost, edits))

    for at in STATES:
        state, cost, edits = at, 0, ""
        for _ in range(4):  # more insertions come back to the same states
            offer(at, state, cost + DELETE, edits + "D")
            if code != "x":
                if role == NEXT[state] or role == SYSTEM and state == START:
                    offer(at, role, cost + extra, edits + "K")
                offer(at, NEXT[state], cost + REROLE + extra, edits + "R")
            state, cost, edits = NEXT[state], cost + INSERT, edits + "I"
    return table


MOVES = {code: _moves(code) for code in CODES}

#: For a state: the least cost of a way to it, and the rank of its edits among those of all states, ASCII-least first.
#: Ways to different states never have edits of which one starts with the other, so ranks go on as rows are added.
Front = list[tuple[int, int]]


def _ranked(ways: list[tuple[int, tuple]]) -> Front:
    order = sorted({edits for cost, edits in ways if cost < FAR})
    return [(cost, order.index(edits) if cost < FAR else 0) for cost, edits in ways]


def _forward(front: Front, code: str) -> Front:
    table = MOVES[code]
    return _ranked([min((front[s][0] + table[s][to][0], (front[s][1], table[s][to][1])) if front[s][0] < FAR and table[s][to][0] < FAR else (FAR, ()) for s in STATES) for to in STATES])


def _backward(costs: list[int], code: str) -> list[int]:
    table = MOVES[code]
    return [min(table[s][to][0] + costs[to] for to in STATES) for s in STATES]


def _from(state: int) -> Front:
    return [(0 if s == state else FAR, 0) for s in STATES]


def edits_between(codes: str, first: int, last: int) -> str:
    """The ASCII-least of the cheapest edits of the rows `codes` that lead from state `first` to `last`, by halves and in linear space.

    Forward costs of the first half and backward costs of the second meet in the middle. Of the states on a cheapest way, the one
    whose edits so far come first is crossed; each half is then solved by itself.
    """
    out, todo = [], [(0, len(codes), first, last)]
    while todo:
        a, b, s, t = todo.pop()
        if b - a == 1:
            out.append(MOVES[codes[a]][s][t][1])
        elif b > a:
            middle = (a + b) // 2
            front = _from(s)
            for i in range(a, middle):
                front = _forward(front, codes[i])
            rest = [0 if x == t else FAR for x in STATES]
            for i in range(b - 1, middle - 1, -1):
                rest = _backward(rest, codes[i])
            _, _, state = min((front[x][0] + rest[x], front[x][1], x) for x in STATES)
            todo += [(middle, b, state, t), (a, middle, s, state)]
    return "".join(out)


def crossing(codes: str) -> list[tuple[int, int]]:
    """By state before and after a piece, 16 times: the least cost, and the rank of its edits among those from the same state."""
    out: list[tuple[int, int]] = []
    for s in STATES:
        front = _from(s)
        for c in codes:
            front = _forward(front, c)
        out += front
    return out


def crossed_states(pieces: list[list[tuple[int, int]]]) -> tuple[int, list[int]]:
    """The least cost of a conversation of such pieces, and the state after each piece on the ASCII-least cheapest way.

    The same halving as within a piece, over pieces instead of rows. `pieces` may be empty.
    """

    def forward(front: Front, piece: list[tuple[int, int]]) -> Front:
        return _ranked([min((front[s][0] + piece[4 * s + to][0], (front[s][1], piece[4 * s + to][1])) if front[s][0] < FAR and piece[4 * s + to][0] < FAR else (FAR, ()) for s in STATES) for to in STATES])

    def meet(a: int, b: int, s: int, ends: list[int]) -> tuple[int, int]:
        """Cost and state in the middle of pieces a to b, from state s to any with the cost that follows it."""
        middle = (a + b + 1) // 2
        front, rest = _from(s), ends
        for i in range(a, middle):
            front = forward(front, pieces[i])
        for i in range(b - 1, middle - 1, -1):
            rest = [min(pieces[i][4 * x + to][0] + rest[to] for to in STATES) for x in STATES]
        cost, _, state = min((front[x][0] + rest[x], front[x][1], x) for x in STATES)
        return cost, state

    states = [START] * len(pieces)
    total, todo = 0, [(0, len(pieces), START, [cost for cost, _ in ENDS])] if pieces else []
    while todo:
        a, b, s, ends = todo.pop()
        cost, state = meet(a, b, s, ends)
        if (a, b) == (0, len(pieces)):
            total = cost
        middle = (a + b + 1) // 2
        states[middle - 1] = state
        fixed = [0 if x == state else FAR for x in STATES]
        if middle - a > 1:
            todo.append((a, middle, s, fixed))
        if b > middle:
            todo.append((middle, b, state, ends))
    return total, states


def repair(codes: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    cost, states = crossed_states([crossing(codes)] if codes else [])
    last = states[-1] if codes else START
    return cost, edits_between(codes, START, last) + ENDS[last][1]


def _key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of conversations, damaged by the CRC-32 of conv_id:turn modulo 20; null roles and texts are one space.

    0 drops the row, 1 empties its text, 2 removes marks that end sentences, 3 repeats the row, 4 sets its role to user.
    """
    kind = F.crc32(F.concat_ws(":", _key("conv_id"), _key("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _key("role").alias("role"), _key("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_n")).drop("_n")


def _digest() -> Column:
    """Tells rows of one conversation and turn apart, and orders them."""
    return F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))


def faulty_rows(rows: DataFrame) -> DataFrame:
    """(conv, at, piece, turn, code, fault) of rows (conv_id, turn, role, text); fault is blank, duplicate, truncated or null.

    conv is conv_id as text, empty for null. `at` numbers rows in the order of conversation, turn (nulls first) and digest. Rows are
    dealt by ranges of that order, so that a conversation of any length is spread over tasks; a piece has PIECE rows of one task at
    most. Texts stay where they are: later steps see a digest.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    small = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "turn", _digest().alias("digest"), F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    order = ["conv", F.asc_nulls_first("turn"), "digest"]
    placed = stored(small.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    many = placed.groupBy("conv", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    seen = salted_join(placed, many, ["conv", "digest"], hot_hashes(placed, ["conv", "digest"]), ["at"], "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("at") > F.col("first"), "duplicate").when(F.col("cut"), "truncated")
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    code = F.when(F.col("_fault").isin("blank", "duplicate"), "x").when(F.col("_fault") == "truncated", F.upper(letter)).otherwise(letter)
    return seen.withColumn("_fault", fault).select("conv", "at", F.shiftright("at", PIECE.bit_length() - 1).alias("piece"), "turn", letter.alias("letter"), code.alias("code"), F.col("_fault").alias("fault"))


def _pieces(rows: DataFrame) -> DataFrame:
    """(conv, piece, codes, letters) of faulty_rows; a piece is bounded, so it is collected."""
    own = F.array_sort(F.collect_list(F.struct("at", "code", "letter")))
    out = rows.groupBy("conv", "piece").agg(own.alias("own"))
    return out.select("conv", "piece", F.array_join(F.transform("own", lambda r: r["code"]), "").alias("codes"), F.array_join(F.transform("own", lambda r: r["letter"]), "").alias("letters"))


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = on_worker("crossing", lambda: Remembered(crossing, REMEMBERED))
    for batch in batches:
        both = [known[c] for c in batch.column("codes").to_pylist()]
        arrays = [pa.array([[x[k] for x in row] for row in both], pa.list_(pa.int64())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("piece"), *arrays], ["conv", "piece", "costs", "ranks"])


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a row for each conversation with its pieces, a row for each piece with the states before and after it."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("conv", "piece", "first", "last", "cost", "ends")}
        for conv, pieces in zip(batch.column("conv").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
            cost, states = crossed_states([list(zip(p["costs"], p["ranks"], strict=True)) for p in pieces])
            for k, p in enumerate(pieces):
                row = (conv, p["piece"], states[k - 1] if k else START, states[k], cost if not k else 0, k == len(pieces) - 1)
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()), strict=True)], list(out))


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = on_worker("edits", lambda: Remembered(lambda key: edits_between(*key), REMEMBERED))
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("codes", "first", "last", "ends")]
        audits = [known[c, s, t] + (ENDS[t][1] if end else "") for c, s, t, end in zip(*cols, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("piece"), pa.array(audits, pa.string())], ["conv", "piece", "audit"])


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a conversation's edits and then its rows, in order: its audit and the hash of the repaired lines. Texts are streamed, not held."""
    conv, audit, state, edits, digest, lines = None, [], START, iter(()), None, 0

    def line(role: str, text: str) -> None:
        nonlocal lines
        digest.update((("\n" if lines else "") + role + ":" + text).encode())
        lines += 1

    def insert(times: int) -> None:
        nonlocal state
        for _ in range(times):
            state = NEXT[state]
            line(("user", "assistant")[state == ASSISTANT], "")

    def end() -> tuple[str, str, str]:
        for step in edits:  # only insertions are left
            insert(len(step))
        return conv, "".join(audit), digest.hexdigest()

    for batch in batches:
        done = []
        for c, part, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv", "audit", "role", "text")), strict=True):
            if c != conv:
                if conv is not None:
                    done.append(end())
                conv, audit, state, edits, digest, lines = c, [], START, None, hashlib.sha256(), 0
            if part is not None:
                audit.append(part)
                continue
            if edits is None:
                edits = iter(re.findall("I*[DKR]|I+", "".join(audit)))
            step = next(edits)
            insert(len(step) - 1)
            if step[-1] == "K":
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                line(role, text)
            elif step[-1] == "R":
                state = NEXT[state]
                line(("user", "assistant")[state == ASSISTANT], text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done, strict=True)], ["conv", "audit", "repaired_sha256"])
    if conv is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in end()], ["conv", "audit", "repaired_sha256"])


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of rows (conv_id, turn, role, text).

    Rows stand in the order of their turns, nulls first; rows of one turn in the order of a digest of role and text, so that
    repeated rows are neighbours. A row is blank, else a duplicate of an earlier role and text, else truncated. Edits are the cheapest that
    give a legal order (a system row at most, then user and assistant in turn, or nothing), the ASCII-least of those. A null conv_id is
    a conversation; null turns count in no gap; roles and texts mustn't be null (damage() gives a space). Roles that start with another letter than s, u
    or a must be changed or go. An empty table gives no rows; other columns aren't read.

    A conversation is repaired in pieces of at most PIECE rows: costs between states are found for each piece by itself, the states between pieces by
    halving the conversation, the edits by halving the piece. Only the hash of the repaired text, which has to follow its lines,
    is one task's work for each conversation; it streams them.
    """
    faults = stored(faulty_rows(rows))
    pieces = stored(_pieces(faults))
    count = lambda kind: F.count(F.when(F.col("fault") == kind, 1)).alias(kind)
    counts = faults.groupBy("conv").agg(count("blank"), count("duplicate"), count("truncated"))
    turns = faults.where("turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    # within pieces, and from each piece's last row to the next one's first
    legal = lambda pair: pair.isin("su", "ua", "au")
    inner = F.when(F.length("letters") > 1, F.size(F.filter(F.sequence(F.lit(1), F.length("letters") - 1), lambda k: ~legal(F.substring("letters", k, F.lit(2)))))).otherwise(0)
    ends = F.array_sort(F.collect_list(F.struct("piece", F.substring("letters", 1, 1).alias("a"), F.substring("letters", -1, 1).alias("b"))))
    illegal = pieces.groupBy("conv").agg(F.sum(inner).alias("inner"), ends.alias("e"))
    seams = F.when(F.size("e") > 1, F.size(F.filter(F.sequence(F.lit(1), F.size("e") - 1), lambda k: ~legal(F.concat(F.element_at("e", k)["b"], F.element_at("e", k + 1)["a"]))))).otherwise(0)
    illegal = illegal.select("conv", (F.col("inner") + seams).alias("illegal"))

    tables = pieces.mapInArrow(_cross, "conv string, piece long, costs array<long>, ranks array<long>")
    chains = tables.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("piece", "costs", "ranks"))).alias("pieces"))
    chosen = stored(chains.mapInArrow(_choose, "conv string, piece long, first int, last int, cost long, ends boolean"))
    audits = pieces.join(chosen, ["conv", "piece"]).select("conv", "piece", "codes", "first", "last", "ends").mapInArrow(_edit, "conv string, piece long, audit string")
    costs = chosen.groupBy("conv").agg(F.sum("cost").alias("cost"))

    none = lambda kind: F.lit(None).cast(kind)
    lines = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), none("long").alias("piece"), none("string").alias("audit"), "turn", "role", "text", _digest().alias("digest"))
    both = audits.select("conv", "piece", "audit", none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("binary").alias("digest")).union(lines)
    both = both.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_last("piece"), F.asc_nulls_first("turn"), "digest")
    written = both.select("conv", "audit", "role", "text").mapInArrow(_write, "conv string, audit string, repaired_sha256 string")

    out = counts.join(turns, "conv", "left").join(illegal, "conv").join(costs, "conv").join(written, "conv")
    long = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(F.nullif("conv", F.lit("")).cast("long").alias("conv_id"), *map(long, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), "audit", "repaired_sha256")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """A row of repaired_conversations for every conv_id of `conversations` after damage(); zeros and empty text where no row is left."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = repaired_conversations(damage(conversations)).withColumnRenamed("conv_id", "_id")
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    empty = hashlib.sha256(b"").hexdigest()
    fill = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.withColumns(fill | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(empty))})
