"""Conversation structure repair: the cheapest edits that make the roles an optional system turn and user-assistant pairs.

A conversation's rows are one dimension of a shortest path, four states of the role pattern the other. Backward costs go row by
row from the end; the audit then goes forward and takes, of the edits that reach the least cost, the first by its letter
(Delete, Insert, Keep, Rerole), which gives the least audit string of all cheapest ones.

Rows are numbered in their order over all conversations and cut into chunks of at most CHUNK_ROWS rows of one conversation, so
a conversation of any length is spread over tasks. Most conversations are one chunk. The chunks of longer ones run by rank
convergence: each starts from a speculative cost vector, then from its successor's in fix-up passes, which stop inside the
chunk as soon as the vector differs from the last pass's by a constant only, and as a whole when no chunk's end vector changes.
Every chunk then knows its exact backward costs; what each of the four entry states leads to is composed over the chunks, and
each chunk is traced from its entry state.

Faults of a row, the first counts: blank (no word), duplicate (role and text seen earlier in the conversation), truncated (its
last character that is not white space does not end a sentence). Blank and duplicate rows are deleted.

Defined cases: null roles and texts are one space, so such a role is no known role and such a text is blank; null turns come
first, rows of one turn go by role and by the digest of their text; a null conv_id is a conversation of its own; repeated rows
are duplicates; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.tables import numbered

from .common import discard, materialize

CHUNK_ROWS = 256
COMPOSED = 1024  # chunks whose entry states one task composes at a time
SPACES = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SYSTEM, USER, ASSISTANT, OTHER = range(4)
# states: nothing yet, after system, after user, after assistant
START = 0
FINISH = (0, 6, 3, 0)  # inserts that end the pattern
FORCED = (2, 2, 3, 2)  # the state that an inserted or reroled row leads to
NAMES = (None, None, "user", "assistant")
KEPT = {(0, SYSTEM): 1, (0, USER): 2, (1, USER): 2, (3, USER): 2, (2, ASSISTANT): 3}
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
CUT, GONE = 4, 8  # bits of a row's code above its role

Vector = tuple[int, int, int, int]


@cache
def before_row(code: int, after: Vector) -> Vector:
    """Costs from before a row, for each state, given those from behind it."""
    role, cut = code % 4, TRUNCATED if code & CUT else 0
    costs = []
    for q in range(4):
        choice = [DELETE + after[q]]
        if not code & GONE:
            choice.append(REROLE + cut + after[FORCED[q]])
            if (q, role) in KEPT:
                choice.append(KEEP + cut + after[KEPT[q, role]])
        costs.append(min(choice))
    # up to two inserts in front of the row; a third would come back to a state seen before
    return tuple(min(costs[q], INSERT + costs[FORCED[q]], 2 * INSERT + costs[FORCED[FORCED[q]]]) for q in range(4))


def level(v: Vector) -> Vector:
    """The vector up to a constant."""
    least = min(v)
    return tuple(x - least for x in v)


def backward(codes: bytes, end: Vector, known: list[Vector] | None = None) -> list[Vector]:
    """Levelled costs behind each row, the first before all rows. With those of an earlier pass it stops where both agree."""
    at = [end]
    for i in range(len(codes) - 1, -1, -1):
        at.append(level(before_row(codes[i], at[-1])))
        if known is not None and at[-1] == known[i]:
            return known[:i] + at[::-1]
    return at[::-1]


def trace(codes: bytes, costs: list[Vector], state: int, last: bool) -> tuple[str, list[tuple[int, int]], int, int]:
    """(audit, kept or new rows as (row or -1, state it leads to or 0 for its own role), cost, state behind)."""
    audit, rows, cost = [], [], 0
    for i, code in enumerate(codes):
        after, cut = costs[i + 1], TRUNCATED if code & CUT else 0
        own = before_row(code, after)
        while True:
            forced = FORCED[state]
            if own[state] == DELETE + after[state]:
                audit.append("D")
                cost += DELETE
            elif own[state] == INSERT + own[forced]:
                audit.append("I")
                rows.append((-1, forced))
                cost, state = cost + INSERT, forced
                continue
            elif (state, code % 4) in KEPT and own[state] == KEEP + cut + after[KEPT[state, code % 4]]:
                audit.append("K")
                rows.append((i, 0))
                cost, state = cost + cut, KEPT[state, code % 4]
            else:
                audit.append("R")
                rows.append((i, forced))
                cost, state = cost + REROLE + cut, forced
            break
    while last and FINISH[state]:
        state = FORCED[state]
        audit.append("I")
        rows.append((-1, state))
        cost += INSERT
    return "".join(audit), rows, cost, state


def row_codes(kinds: list[int], flags: list[int], keys: list[bytes], late: set[bytes]) -> tuple[bytes, list[int]]:
    """A code for each row, and the numbers of blank, duplicate and truncated rows; ``late``: keys seen in earlier chunks."""
    codes, faults, seen = bytearray(), [0, 0, 0], set(late)
    for kind, flag, key in zip(kinds, flags, keys, strict=True):
        fault = 1 if flag & 2 else 2 if key in seen else 3 if flag & 1 else 0
        seen.add(key)
        codes.append(kind + (GONE if fault in (1, 2) else CUT if fault == 3 else 0))
        if fault:
            faults[fault - 1] += 1
    return bytes(codes), faults


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, nth, block) of every row, numbered in order over all conversations."""
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return numbered(plain, "conv_id", "turn", "role", "md5(text)").withColumn("block", F.expr(f"nth div {CHUNK_ROWS}"))


def _facts() -> list[Column]:
    """A row's number, role, flags (1 truncated, 2 blank) and key of role and text."""
    tail = F.rtrim("text", F.lit(SPACES))
    first = F.substring("role", 1, 1)
    kind = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)
    flags = F.when(tail == "", 2).when(F.substring(tail, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    return [F.col("nth"), kind.alias("kind"), flags.alias("flags"), F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("key")]


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _beside(rows: DataFrame, other: DataFrame, step: int, *columns: str) -> DataFrame:
    """``rows`` with columns of the chunk of the same conversation ``step`` blocks further on; null where there is none."""
    o = other.select(F.col("conv_id").alias("o_id"), (F.col("block") - step).alias("o_block"), *columns)
    return rows.join(o, (F.col("block") == F.col("o_block")) & _same("conv_id", "o_id"), "left").drop("o_id", "o_block")


def _pass(codes: pa.Array, path: pa.Array, end: pa.Array) -> pa.Array:
    """A pass over chunks: start vector and path from the end vector; chunks without a new end stay as they are."""
    out = []
    for c, p, e in zip(codes.to_pylist(), path.to_pylist(), end.to_pylist(), strict=True):
        known = None if p is None else [tuple(p[i : i + 4]) for i in range(0, len(p), 4)]
        costs = known if e is None else backward(c, tuple(e), known)
        out.append({"start": list(costs[0]), "path": b"".join(bytes(v) for v in costs)})
    return pa.array(out, pa.struct([("start", pa.list_(pa.int32())), ("path", pa.binary())]))


def converge(chunks: DataFrame) -> tuple[DataFrame, int]:
    """Exact (conv_id, block, last, codes, end, path) of chunks (conv_id, block, last, codes), and the number of passes."""
    step = F.arrow_udf(_pass, "struct<start: array<int>, path: binary>")
    guess = F.array(*(F.lit(x) for x in FINISH))
    columns = ("conv_id", "block", "last", "codes", "end", "pass.start", "pass.path")
    first = chunks.withColumn("end", guess).withColumn("pass", step("codes", F.lit(None).cast("binary"), "end"))
    now, passes = materialize(first.select(*columns), "costs"), 1
    while True:
        nearer = _beside(now, now.withColumnRenamed("start", "next"), 1, "next").withColumn("new", F.when(~F.col("last") & (F.col("next") != F.col("end")), F.col("next")))
        if nearer.where("new IS NOT NULL").isEmpty():
            return now, passes
        fixed = nearer.withColumn("pass", step("codes", "path", "new")).withColumn("end", F.coalesce("new", "end"))
        before, now = now, materialize(fixed.select(*columns), "costs")
        discard(before)
        passes += 1


def _exits(codes: pa.Array, path: pa.Array, last: pa.Array) -> pa.Array:
    out = []
    for c, p, z in zip(codes.to_pylist(), path.to_pylist(), last.to_pylist(), strict=True):
        costs = [tuple(p[i : i + 4]) for i in range(0, len(p), 4)]
        out.append([trace(c, costs, q, z)[3] for q in range(4)])
    return pa.array(out, pa.list_(pa.int32()))


def entries(exits: DataFrame) -> DataFrame:
    """(conv_id, block, entry): each chunk's entry state, from what every state leads to in the chunks (conv_id, block, exits).

    Groups of COMPOSED chunks are composed in order, then groups of groups, until a conversation is one group.
    """
    follow = lambda q, x: F.element_at(x["exits"], q + 1)
    grouped = materialize(
        exits.groupBy("conv_id", F.expr(f"block div {COMPOSED}").alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.col("block").alias("at"), "exits"))).alias("parts")), "composed"
    )
    if grouped.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        placed = grouped.withColumn("entry", F.lit(START))
    else:
        whole = F.aggregate("parts", F.array(*(F.lit(q) for q in range(4))), lambda acc, x: F.transform(acc, lambda q: follow(q, x)))
        placed = _beside(grouped, entries(grouped.select("conv_id", "block", whole.alias("exits"))), 0, "entry")
    states = F.aggregate("parts", F.array("entry"), lambda acc, x: F.concat(acc, F.array(follow(F.element_at(acc, -1), x))))
    return placed.select("conv_id", F.inline(F.arrays_zip(F.transform("parts", lambda x: x["at"]).alias("block"), F.slice(states, F.lit(1), F.size("parts")).alias("entry"))))


def long_chunks(messages: DataFrame) -> DataFrame | None:
    """What the chunks of conversations of several chunks have to know: (conv_id, block, late, end, last, entry, prior)."""
    pieces = messages.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    spans = pieces.groupBy(F.col("conv_id").alias("s_id")).agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high")
    listed = materialize(pieces.join(spans, _same("conv_id", "s_id")).select("conv_id", "block", (F.col("block") == F.col("high")).alias("last")), "long")
    if listed.isEmpty():
        return None
    facts = _beside(messages.select("conv_id", "block", F.struct(*_facts()).alias("row")), listed, 0, "last").where("last IS NOT NULL")
    rows = materialize(facts.groupBy("conv_id", "block", "last").agg(F.array_sort(F.collect_list("row")).alias("rows")), "long_rows")
    keys = rows.select("conv_id", "block", F.explode(F.array_distinct(F.col("rows.key"))).alias("key"))
    firsts = keys.groupBy(F.col("conv_id").alias("f_id"), F.col("key").alias("f_key")).agg(F.min("block").alias("first"), F.count("*").alias("n")).where("n > 1")
    late = keys.join(firsts, (F.col("key") == F.col("f_key")) & _same("conv_id", "f_id")).where("block > first").groupBy("conv_id", "block").agg(F.collect_list("key").alias("late"))
    known = _beside(rows, late, 0, "late").withColumn("late", F.coalesce("late", F.array().cast("array<binary>")))
    coded = known.select("conv_id", "block", "last", "late", F.element_at("rows.kind", -1).alias("kind"), F.arrow_udf(_codes, "binary")("rows.kind", "rows.flags", "rows.key", "late").alias("codes"))
    chunks = materialize(coded, "coded")
    costs, _ = converge(chunks.select("conv_id", "block", "last", "codes"))
    exits = materialize(costs.select("conv_id", "block", F.arrow_udf(_exits, "array<int>")("codes", "path", "last").alias("exits")), "exits")
    told = _beside(_beside(chunks, costs, 0, "end"), entries(exits), 0, "entry")
    out = materialize(_beside(told, chunks.withColumnRenamed("kind", "prior"), -1, "prior").select("conv_id", "block", "late", "end", "last", "entry", "prior"), "long_info")
    discard(listed, rows, chunks, costs, exits)
    return out


def _codes(kinds: pa.Array, flags: pa.Array, keys: pa.Array, late: pa.Array) -> pa.Array:
    return pa.array([row_codes(*x[:3], set(x[3]))[0] for x in zip(*(a.to_pylist() for a in (kinds, flags, keys, late)), strict=True)], pa.binary())


RESULT = "struct<blank: bigint, duplicate: bigint, truncated: bigint, illegal: bigint, cost: bigint, audit: string, repaired: array<struct<role: string, text: string>>>"
_RESULT = pa.struct([*((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])


def _repaired(rows: pa.Array, late: pa.Array, end: pa.Array, last: pa.Array, entry: pa.Array, prior: pa.Array) -> pa.Array:
    out = []
    for own, seen, e, z, q, p in zip(*(a.to_pylist() for a in (rows, late, end, last, entry, prior)), strict=True):
        kinds = [r["kind"] for r in own]
        codes, faults = row_codes(kinds, [r["flags"] for r in own], [r["key"] for r in own], set(seen or ()))
        whole = e is None  # the conversation's only chunk
        audit, edits, cost, _ = trace(codes, backward(codes, FINISH if whole else tuple(e)), q or START, whole or z)
        chain = kinds if p is None else [p, *kinds]
        illegal = sum(pair not in LEGAL for pair in zip(chain, chain[1:], strict=False))
        new = [{"role": NAMES[state] if state else own[i]["role"], "text": own[i]["text"] if i >= 0 else ""} for i, state in edits]
        out.append({"blank": faults[0], "duplicate": faults[1], "truncated": faults[2], "illegal": illegal, "cost": cost, "audit": audit, "repaired": new})
    return pa.array(out, _RESULT)


def repair_chunks(messages: DataFrame) -> DataFrame:
    """(conv_id, block, fault counts, cost, audit, repaired) of every chunk of ``ordered`` messages; blocks order a conversation's chunks."""
    chunks = messages.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct(*_facts(), "role", "text"))).alias("rows"))
    info = long_chunks(messages)
    if info is None:
        kinds = {"late": "array<binary>", "end": "array<int>", "last": "boolean", "entry": "int", "prior": "int"}
        known = chunks.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items()})
    else:
        known = _beside(chunks, info, 0, "late", "end", "last", "entry", "prior")
    found = F.arrow_udf(_repaired, RESULT)("rows", "late", "end", "last", "entry", "prior")
    return known.select("conv_id", "block", found.alias("found")).select("conv_id", "block", "found.*")


def repaired_rows(chunks: DataFrame) -> DataFrame:
    """(conv_id, block, pos, role, text): the repaired conversations' rows, in the order of block and pos."""
    return chunks.select("conv_id", "block", F.posexplode("repaired").alias("pos", "r")).select("conv_id", "block", "pos", "r.*")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's parts, which come in order; constant memory however long a conversation is."""
    now, digest, ids, out = None, None, None, []
    for b in batches:
        for i, (conv, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            if digest is None or conv != now:
                if digest is not None:
                    out.append((ids, digest.hexdigest()))
                now, ids, digest, began = conv, b.column(0).slice(i, 1), hashlib.sha256(), False
            if text is not None:
                digest.update((("\n" if began else "") + text).encode())
                began = True
    if digest is not None:
        out.append((ids, digest.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([x for x, _ in out]), pa.array([x for _, x in out])], names=["conv_id", "sha256"])


def digests(chunks: DataFrame) -> DataFrame:
    """(conv_id, sha256) of `role:text` of the repaired rows, joined by newlines.

    A digest reads its conversation in order, so each conversation goes through one task, as a stream.
    """
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    parts = chunks.select("conv_id", F.when(F.size("repaired") > 0, lines).alias("text"), "block")
    kind = chunks.schema["conv_id"].dataType.simpleString()
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "block").select("conv_id", "text").mapInArrow(_hashed, f"conv_id {kind}, sha256 string")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row for each conversation: gaps between its turns, fault counts, cost, audit and the digest of the repaired rows."""
    messages = ordered(rows)
    chunks = materialize(repair_chunks(messages), "repaired")
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    parts = F.array_sort(F.collect_list(F.struct("block", "audit")))
    told = chunks.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in counts), F.array_join(F.transform(parts, lambda x: x["audit"]), "").alias("audit"))
    turns = messages.groupBy(F.col("conv_id").alias("t_id")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    hashed = digests(chunks).select(F.col("conv_id").alias("h_id"), F.col("sha256").alias("repaired_sha256"))
    return told.join(turns, _same("conv_id", "t_id")).join(hashed, _same("conv_id", "h_id")).select("conv_id", "gaps", *counts, "audit", "repaired_sha256")
