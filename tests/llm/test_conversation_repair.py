import hashlib
import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import duckdb
import pytest
import xxhash

from lumenreel.llm import conversation_repair as C

SEPARATORS = " \t\n\x0b\x0c\r"


def least(rows):
    """Cost, audit and repaired lines of rows (role, text, fault), by trying everything from every place and state."""
    goal = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    free = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}

    @cache
    def best(i, state, inserted):
        found = []
        if i == len(rows):
            if state in (0, 3):
                found.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            c, audit, lines = best(i + 1, state, 0)
            found.append((c + 2, "D" + audit, lines))
            if fault not in ("blank", "duplicate"):
                late = 5 * (fault == "truncated")
                if role[:1] in goal[state]:
                    c, audit, lines = best(i + 1, goal[state][role[:1]], 0)
                    found.append((c + late, "K" + audit, (f"{role}:{text}", *lines)))
                name, to = free[state]
                c, audit, lines = best(i + 1, to, 0)
                found.append((c + 1 + late, "R" + audit, (f"{name}:{text}", *lines)))
        if inserted < 3:
            name, to = free[state]
            c, audit, lines = best(i, to, inserted + 1)
            found.append((c + 5, "I" + audit, (f"{name}:", *lines)))
        return min(found, default=(10**9, "", ()))

    out = best(0, 0, 0)
    best.cache_clear()
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SEPARATORS)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def model(turns):
    """What repair gives for rows (turn, role, text) of one conversation: report and lines."""
    order = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], xxhash.xxh64_intdigest(r[2].encode(), 42) + (1 << 63) & (1 << 64) - 1))
    rows = faults([r[1:] for r in order])
    cost, audit, lines = least(rows)
    count = Counter(f for *_, f in rows)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit), lines


def conversations(rng, count, longest=9):
    words = ["Yes.", "no", "Well then!", "", " \n", "Is it? ", "日本。", "one two three.", "and", "x" * 50 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "Assistant", "ua", "sys"]
    for conv in range(count):
        regular = rng.random() < 0.5
        for turn in range(rng.randint(1, longest)):
            role = ("user", "assistant")[turn % 2] if regular and rng.random() < 0.8 else rng.choice(roles)
            yield conv, rng.choice([turn, turn, turn, turn + 5, None]), role, rng.choice(words)


def got(spark, rows, **options):
    turns, found = C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5), **options)
    lines = defaultdict(list)
    for r in sorted(turns.collect(), key=lambda r: (r.key, r.place, r.nth)):
        lines[r.key].append(f"{r.role}:{r.text}")
    return {r.key: ((r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit), tuple(lines.get(r.key, ()))) for r in found.collect()}


def wanted(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[" " if conv is None else str(conv)].append((turn, " " if role is None else role, " " if text is None else text))
    return {key: model(turns) for key, turns in by.items()}


def test_repairs_equal_the_exhaustive_search(spark):
    rows = list(conversations(random.Random(1), 400))
    rows += [(None, 1, "user", "Nobody."), (None, None, None, None), (None, 2, "assistant", None), (900, 0, "user", "Same."), (900, 0, "user", "Same."), (901, 3, "system", "Only this.")]
    assert got(spark, rows) == wanted(rows)


@pytest.mark.parametrize("bits", [3, 6])
def test_conversations_over_many_chunks(spark, bits):
    rng = random.Random(2 + bits)
    rows = list(conversations(rng, 12, 60))
    rows += [(50, None, rng.choice(["user", "assistant"]), f"{rng.choice('abcde')} {i}{rng.choice(['.', ''])}") for i in range(200)]
    rows += [(51, i, "user", "The same again.") for i in range(150)] + [(51, 150, "assistant", "An answer.")]
    rows += [(52, i, "assistant", f"cut off {i}") for i in range(100)]
    assert got(spark, rows, chunk_bits=bits) == wanted(rows)


def test_passes_end_in_the_vectors_of_one_long_pass(spark):
    rng = random.Random(7)
    codes = {str(k): [bytes(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 9, 13] if k % 3 else [13, 5, 9]) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 40))] for k in range(30)}
    frame = spark.createDataFrame([(k, i, c) for k, parts in codes.items() for i, c in enumerate(parts)], "key string, chunk long, codes binary")
    used = {(r.key, r.chunk): C._unpack(r.used) for r in C.converged(C.cut(frame, "test")).collect()}
    for key, parts in codes.items():
        vector = C.END
        for i in range(len(parts) - 1, -1, -1):
            assert used[key, i] == vector
            vector = C.backward(parts[i], vector)


def test_insertions_where_deleting_is_dear(monkeypatch):
    monkeypatch.setattr(C, "DELETE", 20)
    monkeypatch.setattr(C, "RENAME", 20)
    C._step.cache_clear()
    try:
        codes = bytes([1, 1, 2, 6])
        edits, state = C.trace(codes, C.END, 0)
        assert (edits, C.TAILS[state]) == (["Ku", "IaKu", "Ka", "IuKa"], "") and C._cost(edits, codes, "") == 15
        edits, state = C.trace(bytes([0]), C.END, 0)
        assert (edits, C.TAILS[state]) == (["Ks"], "IuIa") and C._cost(edits, bytes([0]), "IuIa") == 10
    finally:
        C._step.cache_clear()


def test_stopping_early_changes_nothing():
    rng = random.Random(9)
    vectors = [C.backward(bytes(rng.choices(range(16), k=5)), C.END) for _ in range(20)]
    for _ in range(300):
        codes, a, b = bytes(rng.choices(range(16), k=rng.randint(0, 12))), *rng.sample(vectors, 2)
        assert C.fixed(codes, a, C.backward(codes, a), b) == C.backward(codes, b)
    assert all(max(v) < 256 for v in vectors)


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    turns, found = C.repair(empty)
    assert turns.count() == 0 and found.count() == 0
    frame = spark.createDataFrame([("c", 1, "user", "Hi.", 7, "x"), ("c", 2, "tool", "Ho.", 7, "x")], "c string, t int, r string, key string, place int, audit string")
    turns, found = C.repair(frame, "c", "t", "r", "key")
    assert [(r.key, r.edit, r.role, r.text) for r in turns.orderBy("place", "nth").collect()] == [("c", "K", "user", "Hi."), ("c", "R", "assistant", "Ho.")]
    assert found.first().cost == 1 and found.first().audit == "KR"


def damaged(conv, turn, role, text):
    key = " " if conv is None else str(conv)
    role, text = " " if role is None else role, " " if text is None else text
    kind = zlib.crc32(f"{key}:{' ' if turn is None else turn}".encode()) % 20
    if kind == 0:
        return []
    text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def expected(table):
    by = defaultdict(list)
    for conv, *rest in table:
        by[conv] += damaged(conv, *rest)
    for conv, turns in by.items():
        (*counts, audit), lines = model(turns)
        numbers = {t for t, *_ in turns if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        yield (conv, gaps, *counts, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_query_against_the_exhaustive_search(spark, tmp_path):
    table = [(conv if conv % 9 else None if conv else 0, turn, role if conv % 7 else None, text if conv % 5 else None) for conv, turn, role, text in conversations(random.Random(4), 300)]
    table = list(dict.fromkeys(table))
    spark.createDataFrame(table, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert Counter(map(tuple, C.query(spark, str(tmp_path)).collect())) == Counter(expected(table))


def test_query_and_its_sql_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    found = C.query(spark, sf)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = Counter(map(tuple, found.collect()))
    assert rows == Counter(expected([tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert Counter(c.sql(C.ORACLE).select(*found.columns).fetchall()) == rows
