import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from lumenreel.llm import periodic_runs as R


def plain_runs(words, exponent=4, least=6):
    """Every maximal stretch for every period, the smallest period of a stretch only."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        start = 0
        while start < len(words) - q:
            end = start
            while end < len(words) - q and words[end] == words[end + q]:
                end += 1
            if end > start and end + q - start >= max(least, exponent * q):
                found.setdefault((start, end + q - start), q)
            start = end + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def samples(rng, count):
    for _ in range(count):
        letters = "abcdefgh"[: rng.randint(1, 8)]
        words = []
        while len(words) < rng.randint(0, 120):
            if rng.random() < 0.4:
                unit = [rng.choice(letters) for _ in range(rng.randint(1, 14))]
                words += (unit * rng.randint(1, 9))[rng.randint(0, 3) :]
            else:
                words += [rng.choice(letters + "xyz") + str(rng.randint(0, 3)) for _ in range(rng.randint(1, 6))]
        yield words


def test_scan_finds_every_run():
    rng = random.Random(3)
    for words in samples(rng, 1500):
        codes = np.unique(words, return_inverse=True)[1] if words else np.zeros(0, np.int64)
        for exponent, least in ((4, 6), (2, 4), (3, 1)):
            found = sorted(R.scan(codes, exponent, least), key=lambda r: (r[0], r[2]))
            assert found == plain_runs(words, exponent, least), (words, exponent, least)


def test_words_of_strings_with_many_periods():
    a, b = "a", "b"
    for _ in range(9):
        a, b = a + b, a
    for text in (a, "a" * 300, "ab" * 200 + "a" * 50, "aab" * 40 + "aabaab" * 20, ("a" * 7 + "b") * 30):
        codes = np.frombuffer(text.encode(), np.uint8).astype(np.int64)
        assert sorted(R.scan(codes), key=lambda r: (r[0], r[2])) == plain_runs(text)


def test_segments_keep_all_that_may_repeat():
    words = np.array([9, 1, 2, 1, 2, 1, 2, 1, 2, 8, 3, 3, 3, 3, 3, 3, 7, 4, 4, 4])
    parts = [p.tolist() for p in R.segments(words, np.zeros(len(words), np.int64))]
    assert parts == [[1, 2, 3, 4, 5, 6, 7, 8], [10, 11, 12, 13, 14, 15]]
    # what is frequent in the whole becomes rare in the parts, again and again
    words = np.array([1, 2, 5, 1, 2, 6, 1, 2, 7, 1, 2, 1, 3, 1, 3, 1, 3])
    assert R.segments(words, np.zeros(len(words), np.int64)) == []
    # groups are never joined
    assert R.segments(np.ones(10, np.int64), np.repeat([0, 1], 5)) == []


ODD = [None, "", " ", "a", "a a a a a", "a a a a a a", "x\ta\na\x0ba a\x0ca\ra y", "a\xa0a a a a a a", "A a A a A a A a", "日本 語 " * 5, "w " * 20_000, "n" + " ".join(map(str, range(5000)))]


def check(got, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = plain_runs(words)
    assert [tuple(r) for r in got.runs] == runs and got.collapsed == collapsed(words, runs)


def test_rows(spark):
    rng = random.Random(4)
    texts = [*ODD[:-2], *(" ".join(w) for w in samples(rng, 150))]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "b b b b b b", "x"), (3, "b b b b b b", "x"), (3, "b b b b b b", "x")]
    got = R.find_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3), keep=("doc_id", "runs", "text")).collect()
    assert sorted((repr(r.doc_id), r.text or "") for r in got) == sorted((repr(k), t or "") for k, t, _ in rows)
    for row in got:
        check(row, row.text)
    got = R.find_runs(spark.createDataFrame([(i, t) for i, t in enumerate(ODD[-2:])], "doc_id long, text string")).collect()
    assert {r.doc_id: (list(map(tuple, r.runs)), r.collapsed) for r in got} == {0: ([(0, 20_000, 1)], "w"), 1: ([], ODD[-1])}
    empty = R.find_runs(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.columns == ["doc_id", "runs", "collapsed"] and empty.count() == 0
    with pytest.raises(ValueError):
        R.find_runs(empty, "collapsed", exponent=1)


def test_long_texts_take_little_time():
    rng = np.random.default_rng(1)
    unit = rng.integers(0, 50, 20_000)
    for words, want in ((np.zeros(200_000, np.int64), 1), (np.tile(unit, 5), 1), (np.tile(np.arange(7), 30_000), 1)):
        assert len([r for r in R.scan(words) if r[1] > 1000]) == want


def model(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed(words, runs))]
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], *sha)


def test_query_against_a_plain_model(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", *(" ".join(w) for w in samples(rng, 300))]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = R.query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = Counter(model(i, t) for i, t, _ in rows)
    assert Counter(map(tuple, got.collect())) == want and sum(1 for row in want if row[1] > 1) > 20


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 12_000]
    got = {r.doc_id: tuple(r) for r in R.query(spark, sf).collect()}
    assert all(got[key] == model(key, text) for key, text in rows)
