import random
import re

import pytest
import xxhash

from lumenreel.llm import simhash as S


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def brute_components(fps, bits=3):
    fps, parent = sorted(set(fps)), {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= bits:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in fps}


def signed(x):
    x &= 2**64 - 1
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one two", "One  two\nthree", "a b c d a b c d", "É é È x\x0by\x1cz " * 50])
def test_fingerprint_of_a_text(text):
    assert S.simhash_text(text) == brute_fingerprint(text)


@pytest.mark.parametrize("pairs", [0, 300])
def test_links_connect_what_brute_force_connects(spark, pairs):
    rng = random.Random(pairs)
    fps = {0, -1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(14):
            mask = 0
            for _ in range(rng.randint(0, 4)):
                mask |= 1 << rng.randrange(64)
            fps.add(signed(centre ^ mask))
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = S.fingerprint_links(df, pairs=pairs)
    for row in links.collect():
        assert ((row.a ^ row.b) & (2**64 - 1)).bit_count() <= 3
    found = {r.node: r.component for r in S.components(links).collect()}
    want = brute_components(fps)
    assert all(found.get(f, f) == want[f] for f in fps)


def test_long_chain_is_one_component(spark):
    n = 60
    links = spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b")
    found = S.components(links).collect()
    assert len(found) == n and {r.component for r in found} == {0}


def test_groups_with_odd_rows(spark):
    rows = [(5, "a b c d", 1), (3, "A b  C d", 2), (9, None, 3), (7, "", 4), (None, "x y z", 5), (None, "x y z", 6), (3, "A b  C d", 2)]
    found = S.near_groups(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    got = sorted(((r.doc_id, r.component_id) for r in found), key=repr)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (9, 7), (7, 7), (None, None), (None, None)], key=repr)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_groups(empty).count() == 0


def test_a_crowded_half_and_what_lies_beside_it(spark):
    """3,000 fingerprints of one upper half in one component, and probes that all meet at a half with a single owner."""
    crowd = [(5 << 40) | i for i in range(3000)]
    beside = [(5 << 40) ^ (1 << 33) | (1 << 20), (5 << 40) ^ (1 << 33) | 77, (9 << 50) | (1 << 20), (5 << 40) ^ (15 << 33) | 3]
    df = spark.createDataFrame([(f,) for f in crowd + beside], "fp long").repartition(4)
    found = {r.node: r.component for r in S.components(S.fingerprint_links(df)).collect()}
    want = {f: min(crowd) for f in crowd} | {beside[0]: min(crowd), beside[1]: min(crowd)}
    assert {f: found.get(f, f) for f in crowd + beside[:2]} == {f: min([*crowd, *beside[:2]]) for f in want}
    assert found.get(beside[2], beside[2]) == beside[2] and found.get(beside[3], beside[3]) == beside[3]


def test_hubs_of_many_links(spark):
    """Two nodes with all links, which are dealt to several tasks."""
    links = spark.createDataFrame([(0, i) for i in range(1, 400)] + [(400, i) for i in range(401, 500)], "a long, b long")
    found = {r.node: r.component for r in S.components(links).collect()}
    assert found == {i: 0 if i < 400 else 400 for i in range(500)}
