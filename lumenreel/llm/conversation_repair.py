"""Repair of conversations by a rank-convergence parallel Viterbi.

A conversation's turns are kept, given another role, deleted, or have turns put before them, so that the roles become an
optional system turn and then user and assistant by turns, at the least cost. What has been kept leaves one of four states,
so the cheapest rest of a conversation is a vector of four costs, and a turn makes its vector from the one after it.

Turns are sorted over all tasks by conversation and turn, and cut into chunks of consecutive rows; a conversation may have
any number of chunks. Every chunk starts from a speculative vector, as if the conversation ended there. Fix-up passes then give
each chunk the vector that its right neighbours have made, and stop inside a chunk where the old and the new vector differ
by a constant only: from there on nothing changes. Passes go on until no chunk gets another vector. Vectors stand without
their constants, which don't matter for choices. Then each chunk says which state it turns each state into, the
states are carried from left to right, and every chunk traces the least audit string of its turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, cut, table

RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Consecutive rows of a chunk, as a power of two.
CHUNK_BITS = 16
#: States: nothing kept yet, after a system turn, after a user turn, after an assistant turn. A role's class is its initial's
#: place in INITIALS; any other initial, or none, is class 3.
INITIALS = "sua"
NEXT = (2, 2, 3, 2)
KEPT = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
NAMES = {"u": "user", "a": "assistant"}
#: A row's code is its class and four times its fault.
SOUND, CUT_OFF, BLANK, DUPLICATE = range(4)


@cache
def _step(after: tuple[int, ...], code: int) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """The vector before a row, less its least cost, and for each state the edits that a least-audit trace takes there and
    the state that they leave. Edits are letters of the audit, each but D followed by the initial of the turn it gives."""
    fault, kind = divmod(code, 4)
    forced, extra = fault in (BLANK, DUPLICATE), TRUNCATED * (fault == CUT_OFF)
    ways: list[list[tuple[int, str, int]]] = []
    for state in range(4):
        some = [(DELETE + after[state], "D", state)]
        if not forced:
            if kind in KEPT[state]:
                some.append((extra + after[KEPT[state][kind]], f"K{INITIALS[kind]}", KEPT[state][kind]))
            some.append((RENAME + extra + after[NEXT[state]], f"R{INITIALS[NEXT[state] - 1]}", NEXT[state]))
        ways.append(some)
    cost = [min(some)[0] for some in ways]
    for state in (2, 3, 0, 1, 2):
        cost[state] = min(cost[state], INSERT + cost[NEXT[state]])

    def taken(state: int) -> tuple[str, int]:
        before = ""
        while True:
            some = [(edit, to) for c, edit, to in ways[state] if c == cost[state]]
            if INSERT + cost[NEXT[state]] == cost[state] and "D" not in (edit for edit, _ in some):
                state = NEXT[state]
                before += f"I{INITIALS[state - 1]}"
            else:
                edit, to = min(some)
                return before + edit, to

    return tuple(c - min(cost) for c in cost), tuple(map(taken, range(4)))


#: The vector at a conversation's end, and what is still put there from each state.
END = (0, 2 * INSERT, INSERT, 0)
TAILS = ("", "IuIa", "Ia", "")


def _pack(vector: tuple[int, ...]) -> int:
    return int.from_bytes(bytes(vector), "little")


def _unpack(number: int) -> tuple[int, ...]:
    return tuple(number.to_bytes(4, "little"))


def backward(codes: bytes, used: tuple[int, ...]) -> tuple[int, ...]:
    """The vector before a chunk from the one after it."""
    for code in reversed(codes):
        used = _step(used, code)[0]
    return used


def fixed(codes: bytes, used: tuple[int, ...], made: tuple[int, ...], want: tuple[int, ...]) -> tuple[int, ...]:
    """The vector before a chunk from `want` after it, where `used` has given `made`: both are carried on until they agree."""
    for code in reversed(codes):
        if used == want:
            return made
        used, want = _step(used, code)[0], _step(want, code)[0]
    return want


def decisions(codes: bytes, used: tuple[int, ...]) -> list[tuple[tuple[str, int], ...]]:
    """For each row of a chunk, what a trace does there in each state."""
    out = []
    for code in reversed(codes):
        used, choice = _step(used, code)
        out.append(choice)
    return out[::-1]


def trace(codes: bytes, used: tuple[int, ...], state: int) -> tuple[list[str], int]:
    """A chunk's edits row by row, and the state after it."""
    edits = []
    for choice in decisions(codes, used):
        edit, state = choice[state]
        edits.append(edit)
    return edits, state


def _cost(edits: list[str], codes: bytes, tail: str) -> int:
    spent = INSERT * len(tail) // 2
    for edit, code in zip(edits, codes, strict=True):
        if edit == "D":
            spent += DELETE
        else:
            spent += INSERT * (len(edit) // 2 - 1) + RENAME * (edit[-2] == "R") + TRUNCATED * (code // 4 == CUT_OFF)
    return spent


_SEGMENT = pa.schema([("key", pa.string()), ("chunk", pa.int64()), ("place", pa.int64()), ("codes", pa.binary()), ("open", pa.bool_()), ("digests", pa.binary())])


def _segmented(bits: int):
    """Rows (key, place, code, digest) by place as segments, the rows of one conversation in one chunk. A row whose digest a
    segment has had is a duplicate; segments at a chunk's ends, which may go on beyond it, carry their digests along."""

    def segments(batches):
        key, chunk, first, codes, digests, seen, begins = None, None, 0, bytearray(), [], set(), True
        for batch in batches:
            for now, place, code, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                here = place >> bits
                if codes and (now != key or here != chunk):
                    last = here != chunk
                    yield key, chunk, first, bytes(codes), begins or last, b"".join(digests) if begins or last else b""
                    begins = last
                    codes, digests, seen = bytearray(), [], set()
                if not codes:
                    key, chunk, first = now, here, place
                if code // 4 != BLANK:
                    if digest in seen:
                        code = code % 4 + 4 * DUPLICATE
                    seen.add(digest)
                codes.append(code)
                digests.append(digest)
        if codes:
            yield key, chunk, first, bytes(codes), True, b"".join(digests)

    return lambda batches: batches_of(segments(batches), _SEGMENT, size=20_000)


_FIRST = pa.schema([("key", pa.string()), ("chunk", pa.int64()), ("nth", pa.int32()), ("digest", pa.binary())])


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments as their rows that are neither blank nor duplicates within it."""

    def rows():
        for batch in batches:
            for key, chunk, codes, digests in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for nth, code in enumerate(codes):
                    if code // 4 not in (BLANK, DUPLICATE):
                        yield key, chunk, nth, digests[16 * nth : 16 * nth + 16]

    return batches_of(rows(), _FIRST, size=20_000)


_SOLID = pa.schema([("key", pa.string()), ("chunk", pa.int64()), ("place", pa.int64()), ("codes", pa.binary())])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments whose rows `nths` are duplicates of rows in earlier segments."""

    def rows():
        for batch in batches:
            for key, chunk, place, codes, nths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                changed = bytearray(codes)
                for nth in nths or ():
                    changed[nth] = changed[nth] % 4 + 4 * DUPLICATE
                yield key, chunk, place, bytes(changed)

    return batches_of(rows(), _SOLID, size=20_000)


def _rows_of(function, schema: pa.Schema):
    """An Arrow function that gives one row for each row."""
    return lambda batches: batches_of((function(*row) for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)), schema, size=20_000)


_STATE = pa.schema([("key", pa.string()), ("chunk", pa.int64()), ("used", pa.int64()), ("made", pa.int64())])
_ENDS = pa.schema([("key", pa.string()), ("chunk", pa.int64()), ("used", pa.int64()), ("ends", pa.list_(pa.int32()))])


def _speculative(key, chunk, codes):
    return key, chunk, _pack(END), _pack(backward(codes, END))


def _fixed(key, chunk, codes, used, made, want):
    return key, chunk, want, _pack(fixed(codes, _unpack(used), _unpack(made), _unpack(want)))


def _ends(key, chunk, codes, used):
    states = range(4)
    for choice in decisions(codes, _unpack(used)):
        states = [choice[s][1] for s in states]
    return key, chunk, used, list(states)


_START = pa.schema([("key", pa.string()), ("chunk", pa.int64()), ("used", pa.int64()), ("start", pa.int32()), ("last", pa.bool_())])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments (key, chunk, used, ends) by key and chunk with the states that they start in, and whether they are the last."""

    def rows():
        held, state = None, 0
        for batch in batches:
            for key, chunk, used, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held:
                    yield (*held, held[0] != key)
                    if held[0] != key:
                        state = 0
                held = (key, chunk, used, state)
                state = ends[state]
        if held:
            yield (*held, True)

    return batches_of(rows(), _START, size=20_000)


_TRACED = pa.schema([
    ("key", pa.string()), ("chunk", pa.int64()), ("place", pa.int64()), ("edits", pa.list_(pa.string())), ("tail", pa.string()), ("audit", pa.string()), ("cost", pa.int64()),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.int32()), ("final", pa.int32()),
])

#: Classes of neighbouring roles that are in order: system and user, user and assistant, assistant and user.
LEGAL = ((0, 1), (1, 2), (2, 1))


def _traced(key, chunk, place, codes, used, start, last):
    edits, state = trace(codes, _unpack(used), start)
    tail = TAILS[state] if last else ""
    faults, kinds = [c // 4 for c in codes], [c % 4 for c in codes]
    illegal = sum(pair not in LEGAL for pair in zip(kinds, kinds[1:], strict=False))
    audit = "".join(edits) + tail
    return (
        key, chunk, place, edits, tail, "".join(c for c in audit if c.isupper()), _cost(edits, codes, tail),
        faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT_OFF), illegal, kinds[0], kinds[-1],
    )


_TYPES = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int32()): "array<int>", pa.list_(pa.string()): "array<string>"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{field.name} {_TYPES[field.type]}" for field in schema)


def sorted_turns(turns: DataFrame) -> DataFrame:
    """Turns (key, turn, role, text) as a table with place, a number that rises with key, turn (nulls first), role and the
    text's hash, and each row's code and digest. Places are dealt over all tasks, whatever the size of a conversation."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("key"), F.asc_nulls_first("turn"), F.col("role"), F.col("hash"), F.col("uid")]
    trimmed = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    fault = F.when(trimmed == "", BLANK).when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), SOUND).otherwise(CUT_OFF)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    digest = F.substring(F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)), 1, 16)
    rows = turns.withColumns({"hash": F.xxhash64("text"), "uid": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return cut(rows.select("key", "turn", "role", "text", F.monotonically_increasing_id().alias("place"), (fault * 4 + kind).alias("code"), digest.alias("digest")), "turns")


def _across(segments: DataFrame, several: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments (a table) of conversations in one chunk, and those in several with the duplicates of earlier chunks marked."""
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    single = segments.join(several, "key", "left_anti").select(_SOLID.names)
    many = segments.filter("open").join(several, "key")
    firsts = cut(many.select("key", "chunk", "codes", "digests").mapInArrow(_firsts, _ddl(_FIRST)), "turn-firsts")
    least = firsts.groupBy("key", "digest").agg(F.min("chunk").alias("least"), F.count(F.lit(1)).alias("chunks")).filter("chunks > 1").drop("chunks")
    late = firsts.join(least, ["key", "digest"]).filter("chunk > least").groupBy("key", "chunk").agg(F.collect_list("nth").alias("nths"))
    marked = many.select(_SOLID.names).repartition(n, "key", "chunk").join(late, ["key", "chunk"], "left").select(*_SOLID.names, "nths")
    return single, cut(marked.mapInArrow(_marked, _ddl(_SOLID)), "turn-chunks")


def converged(chunks: DataFrame) -> DataFrame:
    """For chunks (a table: key, chunk, codes), the vector `used` after each, right but for a constant.

    In a pass each chunk gets what the nearest chunk to its right has made that changed its vector at all; those between, which gave
    back what they got, are taken to do so again. A chunk keeps its vector only if that is its right neighbour's, so the last
    pass proves them all. Long stretches that change nothing, such as copies, therefore take a pass, not one for each chunk.
    """
    codes = chunks.select("key", "chunk", "codes")
    state = cut(codes.mapInArrow(_rows_of(_speculative, _STATE), _ddl(_STATE)), "vectors")
    right = Window.partitionBy("key").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    while True:
        changed = F.last(F.when(F.col("used") != F.col("made"), F.col("made")), ignorenulls=True).over(right)
        wanted = cut(state.withColumn("want", F.coalesce(changed, F.lit(_pack(END)))), "wanted")
        todo = wanted.filter("want <> used")
        if todo.isEmpty():
            return state.select("key", "chunk", "used")
        again = codes.join(todo, ["key", "chunk"]).select("key", "chunk", "codes", "used", "made", "want")
        done = again.mapInArrow(_rows_of(_fixed, _STATE), _ddl(_STATE))
        state = cut(wanted.filter("want = used").select(_STATE.names).unionByName(done), "vectors")


def traced(rows: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Rows of sorted_turns as segments with their edits, audit, cost and counts (a table)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    light = rows.select("key", "place", "code", "digest").repartition(n, F.shiftright("place", chunk_bits)).sortWithinPartitions("place")
    segments = cut(light.mapInArrow(_segmented(chunk_bits), _ddl(_SEGMENT)), "segments")
    several = cut(segments.filter("open").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "long-conversations")
    trace_all = _rows_of(_traced, _TRACED)
    given = (F.lit(_pack(END)).alias("used"), F.lit(0).alias("start"), F.lit(True).alias("last"))
    if several.isEmpty():
        return cut(segments.select(*_SOLID.names, *given).mapInArrow(trace_all, _ddl(_TRACED)), "traced")
    single, chunks = _across(segments, several)
    used = converged(chunks)
    ends = chunks.join(used, ["key", "chunk"]).select("key", "chunk", "codes", "used").mapInArrow(_rows_of(_ends, _ENDS), _ddl(_ENDS))
    starts = ends.repartition(n, "key").sortWithinPartitions("key", "chunk").mapInArrow(_starts, _ddl(_START))
    long = chunks.join(starts, ["key", "chunk"]).select(*_SOLID.names, "used", "start", "last")
    return cut(single.select(*_SOLID.names, *given).unionByName(long).mapInArrow(trace_all, _ddl(_TRACED)), "traced")


def repaired_turns(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """key, place, nth, edit, role, text of what the repair leaves: turns kept (K) or renamed (R) with their text, and empty
    turns that are inserted (I) before place, or after the last of a conversation. nth orders the turns of one place."""
    each = segments.select("key", F.col("place").alias("first"), F.posexplode("edits").alias("at", "edit")).select((F.col("first") + F.col("at")).alias("place"), "edit")
    own = rows.select("key", "place", "role", "text").join(each.filter("edit <> 'D'"), "place")
    last = F.col("place") + F.size("edits")
    tails = segments.filter("tail <> ''").select(last.alias("place"), "key", F.lit("").alias("role"), F.lit("").alias("text"), F.col("tail").alias("edit"))
    both = own.unionByName(tails)
    step = F.posexplode(F.expr("transform(sequence(0, length(edit) div 2 - 1), i -> substring(edit, 2 * i + 1, 2))")).alias("nth", "step")
    steps = both.select("key", "place", "role", "text", step)
    edit, named = F.substring("step", 1, 1), F.when(F.substring("step", 2, 1) == "u", NAMES["u"]).otherwise(NAMES["a"])
    # a conversation's tail stands after its last row, so before any other's first
    return steps.select(
        "key", "place", "nth", edit.alias("edit"),
        F.when(edit == "K", F.col("role")).otherwise(named).alias("role"),
        F.when(edit == "I", F.lit("")).otherwise(F.col("text")).alias("text"),
    )


def report(segments: DataFrame) -> DataFrame:
    """One row per conversation with a turn: key, blank, duplicate, truncated, illegal, cost, audit."""
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    parts = segments.groupBy("key").agg(*sums, F.sort_array(F.collect_list(F.struct("chunk", "first", "final", "audit"))).alias("parts"))
    fine = " OR ".join(f"(parts[i].final = {a} AND parts[i + 1].first = {b})" for a, b in LEGAL)
    border = F.expr(f"IF(size(parts) < 2, 0, size(filter(sequence(0, size(parts) - 2), i -> NOT ({fine}))))")
    return parts.select(
        "key", "blank", "duplicate", "truncated", (F.col("illegal") + border).alias("illegal"), "cost",
        F.concat_ws("", F.transform("parts", lambda p: p.audit)).alias("audit"),
    )


def repair(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk_bits: int = CHUNK_BITS
) -> tuple[DataFrame, DataFrame]:
    """The repaired turns (as repaired_turns gives them) and the report (as report does) of conversations.

    key is the conversation's id as a string. Null ids, roles and texts count as one space; a null turn comes before all others.
    Turns of one number are in the order of their roles, then of a hash of their texts; equal rows in any. A role is known by
    its first letter: s, u, a; turns of other roles, or with an empty one, are renamed or deleted. A row's first fault counts: blank (no
    other characters than space and \\x09-\\x0D), duplicate (role and text, by 128 bits over both, have come before), truncated
    (the last other character isn't one of .!?). Blank and duplicate rows are deleted. A conversation of no rows isn't in the
    results, one whose rows are all deleted only in the report. Other columns aren't read; empty tables give empty ones.
    """
    space = F.lit(" ")
    named = turns.select(
        F.coalesce(F.col(id_col).cast("string"), space).alias("key"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), space).alias("role"), F.coalesce(F.col(text_col).cast("string"), space).alias("text"),
    )
    rows = sorted_turns(named)
    segments = traced(rows, chunk_bits)
    return repaired_turns(rows, segments), report(segments)


_HASH = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, line) in order as one hash per key over its lines; no more than a batch is held."""

    def rows():
        key, state = None, None
        for batch in batches:
            for now, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or now != key:
                    if state is not None:
                        yield key, state.hexdigest()
                    key, state = now, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.encode())
        if state is not None:
            yield key, state.hexdigest()

    return batches_of(rows(), _HASH, size=20_000)


def _dealt(conversations: DataFrame) -> DataFrame:
    """The rows with what a hash of conversation and turn makes of them in `damage`; nulls are one space."""
    space = F.lit(" ")
    key = F.coalesce(F.col("conv_id").cast("string"), space)
    named = F.concat(key, F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    return conversations.select(
        "conv_id", key.alias("key"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(named.cast("binary")) % 20).alias("damage"),
    )


def _damaged(dealt: DataFrame) -> DataFrame:
    def when(kind: int, changed: Column, else_: str) -> Column:
        return F.when(F.col("damage") == kind, changed).otherwise(F.col(else_))

    text = F.when(F.col("damage") == 1, F.lit("")).otherwise(when(2, F.translate("text", ".!?", ""), "text"))
    rows = dealt.filter("damage <> 0").select("key", "turn", when(4, F.lit("user"), "role").alias("role"), text.alias("text"), "damage")
    return rows.select("key", "turn", "role", "text", F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def query(spark, sf_dir):
    dealt = _dealt(table(spark, sf_dir, "conversations"))
    turns, found = repair(_damaged(dealt), "key")
    there = F.when(F.col("damage") != 0, F.col("turn"))
    ids = dealt.groupBy("key").agg(F.max("conv_id").alias("conv_id"), (F.max(there) - F.min(there) + 1 - F.count_distinct(there)).alias("gaps"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a SHA-256 takes its bytes one after another, so a conversation's lines pass through one task; it holds one batch of them
    lines = turns.select("key", "place", "nth", F.concat("role", F.lit(":"), "text").alias("line")).repartition(n, "key").sortWithinPartitions("key", "place", "nth")
    hashes = lines.select("key", "line").mapInArrow(_hashed, _ddl(_HASH))
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found, "key", "left").join(hashes, "key", "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


#: The same by dynamic programming from the first turn on, in one recursion over all conversations: for each state the
#: cheapest way there, with its audit and its lines. A hash table gives CRC-32, which DuckDB lacks.
ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))
), named AS (
  SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations
), dealt AS (
  SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(name, ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS damage
  FROM named, crc
), damaged AS (
  SELECT key, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text
  FROM dealt, unnest(CASE WHEN damage = 3 THEN [0, 1] ELSE [0] END) AS copies(copy)
  WHERE damage <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged
), judged AS (
  SELECT key, turn, role, text, i, left(role, 1) AS initial,
    CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY key ORDER BY i) AS before
  FROM placed
), counted AS (
  SELECT key, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY key
), inserted(state, into_state, audit, cost, lines) AS (
  VALUES (0, 0, '', 0, []::VARCHAR[]), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []), (0, 2, 'I', 5, ['user:']), (0, 3, 'II', 10, ['user:', 'assistant:']),
    (1, 2, 'I', 5, ['user:']), (1, 3, 'II', 10, ['user:', 'assistant:']), (2, 3, 'I', 5, ['assistant:']), (3, 2, 'I', 5, ['user:'])
), moves(state, into_state, edit, cost, initial, name) AS (
  VALUES (0, 1, 'K', 0, 's', NULL), (0, 2, 'K', 0, 'u', NULL), (1, 2, 'K', 0, 'u', NULL), (2, 3, 'K', 0, 'a', NULL), (3, 2, 'K', 0, 'u', NULL), (0, 2, 'R', 1, NULL, 'user'),
    (1, 2, 'R', 1, NULL, 'user'), (2, 3, 'R', 1, NULL, 'assistant'), (3, 2, 'R', 1, NULL, 'user'), (0, 0, 'D', 2, NULL, NULL), (1, 1, 'D', 2, NULL, NULL), (2, 2, 'D', 2, NULL, NULL), (3, 3, 'D', 2, NULL, NULL)
), ways(key, i, state, cost, audit, lines) AS (
  SELECT key, CAST(0 AS BIGINT), into_state, cost, audit, lines FROM counted, inserted WHERE state = 0
  UNION ALL
  SELECT key, i, state, cost, audit, lines FROM (
    SELECT w.key, w.i + 1 AS i, x.into_state AS state, w.cost + m.cost + x.cost + CASE WHEN m.edit <> 'D' AND j.fault = 'truncated' THEN 5 ELSE 0 END AS cost, w.audit || m.edit || x.audit AS audit,
      list_concat(w.lines, CASE WHEN m.edit = 'D' THEN [] ELSE [coalesce(m.name, j.role) || ':' || j.text] END, x.lines) AS lines
    FROM ways w JOIN judged j ON j.key = w.key AND j.i = w.i + 1
      JOIN moves m ON m.state = w.state AND (m.edit = 'D' OR j.fault NOT IN ('blank', 'duplicate') AND (m.edit = 'R' OR m.initial = j.initial))
      JOIN inserted x ON x.state = m.into_state
  ) QUALIFY row_number() OVER (PARTITION BY key, state ORDER BY cost, audit) = 1
), solved AS (
  SELECT w.key, w.cost, w.audit, w.lines FROM ways w JOIN counted c ON c.key = w.key AND c.n = w.i
  WHERE w.state IN (0, 3) QUALIFY row_number() OVER (PARTITION BY w.key ORDER BY w.cost, w.audit) = 1
), ids AS (SELECT key, max(conv_id) AS conv_id FROM named GROUP BY key)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN counted USING (key) LEFT JOIN solved USING (key)
"""
