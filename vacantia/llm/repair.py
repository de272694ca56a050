"""Conversation structure repair by a run-length DP.

A row is one symbol: its role's initial (s, u, a or other) and whether it is truncated, or the one
symbol of rows that must go (blank, or equal in role and text to an earlier row).  What a symbol can do
to the state of ``(s?(ua)+)?`` is a 4 x 4 min-plus matrix that counts edits; equal consecutive symbols are a
run, and a run of m moves the costs through the cached powers M, M^2, M^4, ...  The cheapest edits
are then unrolled front to back: of those that keep to the least cost, the smallest letter.  Every edit leads from a
state to one state only, so letters fix the outcome, and the smallest letter each time gives the smallest audit.

No conversation is gathered in one task.  Rows that are equal in all are counted before they are
sorted; rows, without their texts, are dealt out by ranges of (conv_id, turn, role, digest), so a
conversation of any size lies in consecutive partitions, one row ("chunk") in each.  A conversation within one
partition is solved there; of one that spans several, the matrices of its chunks (at most one a
partition) are composed, and each chunk then gets the costs behind it and the state before it.  Texts meet only the rows that are kept.

Order: turn (nulls first), role, SHA-256 of the text; ties beyond that are equal rows.  Null text or role: one space;
rows of null conv_id are one conversation.  An empty table gives an empty result; texts may be of any length.
Columns beside conv_id, turn, role and text are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import WORD, partitions, stored

#: States of the grammar: nothing yet, after s, after u, after a.  The first and the last may end.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Where a role leads from each state; None: not allowed there.
STEPS = {"s": (AFTER_S, None, None, None), "u": (AFTER_U, AFTER_U, None, AFTER_U), "a": (None, None, AFTER_A, None)}
INITIALS = "sua?"
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)  # the only role that may be put in, from each state
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
GONE = 8
FAR = 1 << 40
#: Costs from each state to the end of a conversation.
END = (0, 2 * INSERT, INSERT, 0)
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)


def edits(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done to a row of this symbol, insertions aside, letters in order."""
    yield "D", DELETE, state
    if symbol != GONE:
        more = CUT_OFF * (symbol % 2)
        if symbol < 6 and (to := STEPS[INITIALS[symbol // 2]][state]) is not None:
            yield "K", KEEP + more, to
        yield "R", REROLE + more, NEXT[state]


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> tuple[tuple[int, ...], ...]:
    """Least cost from state to state over 2**k rows of one symbol, insertions before each row included."""
    if k:
        half = power(symbol, k - 1)
        return product(half, half)
    out = []
    for state in range(4):
        row, at, cost = [FAR] * 4, state, 0
        for _ in range(4):
            for _, c, to in edits(symbol, at):
                row[to] = min(row[to], cost + c)
            at, cost = NEXT[at], cost + INSERT
        out.append(tuple(row))
    return tuple(out)


def product(a, b) -> tuple[tuple[int, ...], ...]:
    return tuple(tuple(min(a[i][j] + b[j][k] for j in range(4)) for k in range(4)) for i in range(4))


def before(matrix, goal) -> tuple[int, ...]:
    """Costs in front of what ``matrix`` does, from the costs behind it."""
    return tuple(min(m + g for m, g in zip(row, goal, strict=True)) for row in matrix)


def bits(n: int) -> list[int]:
    """The powers of two that make up n, the largest first."""
    return [k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def runs_of(codes: bytes, copies: list[int]) -> list[tuple[int, int]]:
    """(symbol, rows) of consecutive equal symbols; codes are initial * 4 + fault, further copies of a row must go."""
    out: list[list[int]] = []

    def add(symbol: int, n: int) -> None:
        if out and out[-1][0] == symbol:
            out[-1][1] += n
        elif n:
            out.append([symbol, n])

    for code, n in zip(codes, copies, strict=True):
        fault = code & 3
        if fault in (BLANK, DUPLICATE):
            add(GONE, n)
        else:
            add((code >> 2) * 2 + (fault == TRUNCATED), 1)
            add(GONE, n - 1)
    return [tuple(x) for x in out]


def costs_before(runs: list[tuple[int, int]], goal) -> list[tuple[int, ...]]:
    """Costs in front of each run, and behind the last."""
    out = [tuple(goal)]
    for symbol, n in reversed(runs):
        for k in bits(n):
            goal = before(power(symbol, k), goal)
        out.append(tuple(goal))
    return out[::-1]


def matrix_of(runs: list[tuple[int, int]]) -> tuple[tuple[int, ...], ...]:
    out = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))
    for symbol, n in runs:
        for k in bits(n):
            out = product(out, power(symbol, k))
    return out


def least(goal) -> tuple[int, ...]:
    low = min(goal)
    return tuple(x - low for x in goal)


@lru_cache(maxsize=1 << 16)
def unrolled(symbol: int, k: int, state: int, goal: tuple[int, ...]) -> tuple[str, int]:
    """Letters of 2**k rows of one symbol and the state behind them; ``goal`` are the costs behind, its least taken off."""
    if k:
        first, state = unroll(symbol, k - 1, state, before(power(symbol, k - 1), goal))
        second, state = unroll(symbol, k - 1, state, goal)
        return first + second, state
    rest = before(power(symbol, 0), goal)
    letters = ""
    while True:
        left = rest[state]
        for letter, cost, to in sorted([*edits(symbol, state), ("I", INSERT, None)]):
            if to is None and rest[NEXT[state]] + cost == left:
                letters, state = letters + "I", NEXT[state]
                break
            if to is not None and cost + goal[to] == left:
                return letters + letter, to


def unroll(symbol: int, k: int, state: int, goal: tuple[int, ...]) -> tuple[str, int]:
    """As ``unrolled``, which keeps short stretches only."""
    return (unrolled if k <= 10 else unrolled.__wrapped__)(symbol, k, state, least(goal))


def solve(runs: list[tuple[int, int]], goal, state: int) -> tuple[str, int]:
    """Letters of all runs and the state behind them."""
    behind = costs_before(runs, goal)
    out = []
    for (symbol, n), end in zip(runs, behind[1:], strict=True):
        ks = bits(n)
        ends = [end]
        for k in reversed(ks[1:]):
            ends.append(before(power(symbol, k), ends[-1]))
        for k, g in zip(ks, reversed(ends), strict=True):
            letters, state = unroll(symbol, k, state, g)
            out.append(letters)
    return "".join(out), state


def damage(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, left without ends of sentences, repeated or made the user's, by crc32 of ``conv_id:turn``."""
    blank = F.lit(" ")
    said = [F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")]
    by = F.crc32(F.encode(F.concat(said[0], F.lit(":"), said[1]), "utf-8")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), by.alias("by")).where("by != 0")
    text = F.when(F.col("by") == 1, F.lit("")).when(F.col("by") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("by") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(F.when(F.col("by") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again")).drop("again")


def keyed(rows: DataFrame) -> DataFrame:
    blank = F.lit(" ")
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))


def faulty(keys: DataFrame) -> DataFrame:
    """Distinct rows without their texts: conv_id, turn, role, digest, copies, code (initial * 4 + first fault)."""
    no_words = ~F.col("text").rlike(WORD)
    ends = F.regexp_extract("text", rf"({WORD})[\x20\x09-\x0D]*\z", 1)
    counted = keys.select("conv_id", "turn", "role", "digest", no_words.alias("blank"), (~ends.isin(".", "!", "?")).alias("cut")).groupBy(
        "conv_id", "turn", "role", "digest", "blank", "cut").agg(F.count(F.lit(1)).alias("copies"))
    again = (counted.where(~F.col("blank")).groupBy("conv_id", "role", "digest")
             .agg(F.min(F.struct(F.col("turn").isNotNull().alias("stated"), "turn")).alias("first"), F.count(F.lit(1)).alias("turns"))
             .where("turns > 1").select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), F.col("first.turn").alias("_first")))
    d = counted.join(again, counted["conv_id"].eqNullSafe(again["_c"]) & (counted["role"] == again["_r"]) & (counted["digest"] == again["_d"]), "left")
    later = F.col("_d").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first"))
    fault = F.when(F.col("blank"), BLANK).when(later, DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(CLEAN)
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return d.select("conv_id", "turn", "role", "digest", "copies", (place * 4 + fault).alias("code"))


def chunked(rows: DataFrame) -> DataFrame:
    """One row per conversation and partition it lies in, in order; ``edge``: it may go on in a neighbour."""
    key = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {key}, part int, edge boolean, turns array<bigint>, roles array<string>, digests array<binary>, copies array<bigint>, codes array<int>"
    names = ["turn", "role", "digest", "copies", "code"]
    out_names = ["conv_id", "part", "edge", "turns", "roles", "digests", "copies", "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def made(batch: pa.RecordBatch, cuts: np.ndarray, edges: list[bool]) -> pa.RecordBatch:
            """Chunks that begin at ``cuts``, to the batch's end."""
            offsets = pa.array(np.append(cuts, batch.num_rows).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, batch[c]) for c in names]
            return pa.RecordBatch.from_arrays([batch["conv_id"].take(pa.array(cuts)), pa.array([part] * len(cuts), pa.int32()), pa.array(edges), *lists], names=out_names)

        held: list[pa.RecordBatch] = []  # pieces of the conversation that is still open
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            of = pc.dictionary_encode(batch["conv_id"], null_encoding="encode").indices.to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1])
            if held and held[0]["conv_id"][0] == batch["conv_id"][0]:
                if len(cuts) == 1:
                    held.append(batch)
                    continue
                held.append(batch.slice(0, int(cuts[1])))
                cuts = cuts[1:]
            if held:
                yield made(pa.concat_batches(held), np.zeros(1, np.int64), [first])
                first = False
            if len(cuts) > 1:
                yield made(batch.slice(int(cuts[0]), int(cuts[-1] - cuts[0])), cuts[:-1] - cuts[0], [first] + [False] * (len(cuts) - 2))
                first = False
            held = [batch.slice(int(cuts[-1]))]
        if held:
            yield made(pa.concat_batches(held), np.zeros(1, np.int64), [True])

    order = ["conv_id", "turn", "role", "digest"]
    return rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(run, schema)


def over(df: DataFrame, schema: str, row) -> DataFrame:
    """``row(**columns)`` of every row; ``schema`` is that of the dict it gives, conv_id and part aside."""
    kept = df.select("conv_id", "part").schema
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    to = StructType([*kept.fields, *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [{"conv_id": x.pop("conv_id"), "part": x.pop("part"), **row(**x)} for x in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, to)


def spanning(chunks: DataFrame) -> DataFrame:
    """Chunks of the conversations that lie in several partitions, with the costs behind, the state before, and what is between two chunks."""
    key = chunks.schema["conv_id"].dataType.simpleString()
    edges = chunks.where("edge")
    several = edges.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("_c"))
    spans = edges.join(several, edges["conv_id"].eqNullSafe(several["_c"]), "left_semi").select("conv_id", "part", "turns", "copies", "codes")

    def matrix(turns, copies, codes) -> dict:
        flat = [x for r in matrix_of(runs_of(bytes(codes), copies)) for x in r]
        return {"m": flat, "turn_0": turns[0], "turn_1": turns[-1], "initial_0": codes[0] >> 2, "initial_1": codes[-1] >> 2}

    matrices = over(spans, "m array<bigint>, turn_0 bigint, turn_1 bigint, initial_0 int, initial_1 int", matrix)

    def behind(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        goal, out = END, []
        for k in range(len(rows) - 1, -1, -1):
            r = rows[k]
            out.append({"conv_id": r["conv_id"], "part": r["part"], "goal": goal, "last": k == len(rows) - 1,
                        "joined": int(k > 0 and r["turn_0"] is not None and r["turn_0"] == rows[k - 1]["turn_1"]),
                        "cross": int(k > 0 and not legal(rows[k - 1]["initial_1"], r["initial_0"]))})
            goal = before([r["m"][i:i + 4] for i in range(0, 16, 4)], goal)
        return pa.Table.from_pylist(out, schema=goals_schema)

    kind = chunks.select("conv_id").schema
    from pyspark.sql.pandas.types import to_arrow_type

    own = to_arrow_type(kind["conv_id"].dataType)
    goals_schema = pa.schema([("conv_id", own), ("part", pa.int32()), ("goal", pa.list_(pa.int64())), ("last", pa.bool_()), ("joined", pa.int64()), ("cross", pa.int64())])
    goals = matrices.groupBy("conv_id").applyInArrow(behind, f"conv_id {key}, part int, goal array<bigint>, last boolean, joined bigint, cross bigint")
    g = goals.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), "goal", "last", "joined", "cross")
    met = spans.drop("turns").join(g, spans["conv_id"].eqNullSafe(F.col("_c")) & (spans["part"] == F.col("_p"))).drop("_c", "_p")

    def ways(copies, codes, goal, **rest) -> dict:
        runs = runs_of(bytes(codes), copies)
        return {"ways": [solve(runs, goal, s)[1] for s in range(4)], "goal": goal, **rest}

    exits = over(met, "ways array<int>, goal array<bigint>, last boolean, joined bigint, cross bigint", ways)

    def ahead(group: pa.Table) -> pa.Table:
        state, out = START, []
        for r in sorted(group.to_pylist(), key=lambda r: r["part"]):
            out.append({c: r[c] for c in ("conv_id", "part", "goal", "last", "joined", "cross")} | {"state": state})
            state = r["ways"][state]
        return pa.Table.from_pylist(out, schema=goals_schema.append(pa.field("state", pa.int32())))

    return exits.groupBy("conv_id").applyInArrow(ahead, f"conv_id {key}, part int, goal array<bigint>, last boolean, joined bigint, cross bigint, state int")


def legal(a: int, b: int) -> bool:
    return INITIALS[a] + INITIALS[b] in ("su", "ua", "au")


MENDED = ("blank bigint, duplicate bigint, truncated bigint, illegal bigint, turn_0 bigint, turn_1 bigint, turns bigint, cost bigint, audit string,"
          " kept array<struct<place:bigint,turn:bigint,role:string,digest:binary,to:string,edit:string>>")


def mend(turns, roles, digests, copies, codes, goal, last, joined, cross, state) -> dict:
    """Counts, edits and kept rows of one chunk."""
    goal, last, state = (END, True, START) if goal is None else (goal, last, state)
    runs = runs_of(bytes(codes), copies)
    audit, end = solve(runs, goal, state)
    cost = costs_before(runs, goal)[0][state] - (0 if last else goal[end])
    if last:
        audit += "I" * (END[end] // INSERT)
    n = np.array(copies)
    code = np.array(codes)
    fault, initial = code & 3, code >> 2
    pairs = sum(not legal(a, b) for a, b in zip(initial.tolist(), initial[1:].tolist(), strict=False)) + int((n - 1).sum())
    stated = [t for t in turns if t is not None]
    kept, at, row, of_row = [], state, 0, 0
    for place, letter in enumerate(audit):
        if letter == "I":
            at = NEXT[at]
            kept.append({"place": place, "turn": None, "role": None, "digest": None, "to": "user" if at == AFTER_U else "assistant", "edit": "I"})
            continue
        if letter != "D":
            role = roles[row]
            if letter == "R":
                at = NEXT[at]
                role = "user" if at == AFTER_U else "assistant"
            else:
                at = STEPS[INITIALS[codes[row] >> 2]][at]
            kept.append({"place": place, "turn": turns[row], "role": roles[row], "digest": digests[row], "to": role, "edit": letter})
        of_row += 1
        if of_row == copies[row]:
            row, of_row = row + 1, 0
    whole = np.isin(fault, (CLEAN, TRUNCATED))
    return {"blank": int(n[fault == BLANK].sum()), "duplicate": int(n[fault == DUPLICATE].sum() + (n[whole] - 1).sum()), "truncated": int((fault == TRUNCATED).sum()),
            "illegal": pairs + (cross or 0), "turn_0": stated[0] if stated else None, "turn_1": stated[-1] if stated else None,
            "turns": len(set(stated)) - (joined or 0), "cost": cost, "audit": audit, "kept": kept}


def mended(rows: DataFrame) -> DataFrame:
    """Every chunk of every conversation with its counts, its part of the audit and the rows it keeps."""
    chunks = stored(chunked(faulty(keyed(rows))))
    s = spanning(chunks)
    s = s.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), "goal", "last", "joined", "cross", "state")
    both = chunks.drop("edge").join(s, chunks["conv_id"].eqNullSafe(F.col("_c")) & (chunks["part"] == F.col("_p")), "left").drop("_c", "_p")
    return stored(over(both, MENDED, mend))


def verdicts(chunks: DataFrame) -> DataFrame:
    """Per conversation: its faults, the least cost and the audit of the cheapest edits."""
    out = chunks.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost", "turns")], F.min("turn_0").alias("turn_0"), F.max("turn_1").alias("turn_1"),
        F.array_sort(F.collect_list(F.struct("part", "audit"))).alias("audits"))  # one part of it a partition at most
    return out.select("conv_id", F.coalesce(F.col("turn_1") - F.col("turn_0") + 1 - F.col("turns"), F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost",
                      F.array_join("audits.audit", "").alias("audit"))


def repaired(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows that remain, in the order of (part, place) within their conversation: conv_id, part, place, role, text, edit."""
    k = chunks.select("conv_id", "part", F.explode("kept").alias("k")).select("conv_id", "part", "k.*")
    t = keyed(rows).dropDuplicates(["conv_id", "turn", "role", "digest"])
    t = t.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "text")
    out = k.join(t, k["conv_id"].eqNullSafe(F.col("_c")) & k["turn"].eqNullSafe(F.col("_t")) & (k["role"] == F.col("_r")) & (k["digest"] == F.col("_d")), "left")
    return out.select("conv_id", "part", "place", F.col("to").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")


def hashed(rows: DataFrame) -> DataFrame:
    """SHA-256 of ``role:text`` lines of each conversation.

    A digest has to see a conversation's bytes one after the other, so its rows pass one task, in order and as a
    stream: memory does not grow with them.
    """
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string"
    from pyspark.sql.pandas.types import to_arrow_type

    own = to_arrow_type(rows.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, done = None, None, []
        for batch in batches:
            for c, role, text in zip(*(batch[n].to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                if digest is None or c != at:
                    if digest is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], own), pa.array([x for _, x in done])], names=["conv_id", "repaired_sha256"])
                done = []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], own), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

    n = partitions(rows.sparkSession)
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "place").select("conv_id", "role", "text").mapInArrow(run, schema)


def audited(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for every conv_id of ``conversations`` on the repair of ``rows``, which may hold none of it."""
    chunks = mended(rows)
    v = verdicts(chunks).withColumnRenamed("conv_id", "_v")
    h = hashed(repaired(chunks, rows)).withColumnRenamed("conv_id", "_h")
    ids = conversations.select("conv_id").distinct()
    out = ids.join(v, ids["conv_id"].eqNullSafe(F.col("_v")), "left").join(h, F.col("conv_id").eqNullSafe(F.col("_h")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
