import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenreel.llm import exact_dedup as X
from lumenreel.llm import fm_index as I
from lumenreel.llm import substring_dedup as S
from lumenreel.llm import url_filter as U

SCHEMA = "doc_id long, text string, norm int, digest string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_groups_with_odd_rows(spark):
    rows = [(1, "Abc", 0, "x"), (2, "aBC", 0, "x"), (3, "É", 0, "x"), (4, "é", 0, "x"), (5, None, 0, "x"), (6, "", 0, "x"), (None, "abc", 0, "x"), (7, "dup", 0, "x"), (7, "dup", 0, "x"), (8, "y" * 300_000, 0, "x")]
    got = X.exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows)
    groups = {}
    for key, text, *_ in rows:
        groups.setdefault(lower(text), []).append(key)
    for r in got:
        members = next(m for t, m in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(members) and r.keep_id == max(k for k in members if k is not None)
        assert r.kept == (r.doc_id == r.keep_id)
    assert X.exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = X.drop_exact_copies(spark.createDataFrame(rows[:6], SCHEMA)).collect()
    assert sorted(r.doc_id for r in kept) == [2, 3, 4, 6] and kept[0].asDict().keys() == {"doc_id", "text", "norm", "digest"}


def test_a_group_of_a_third_of_all_rows(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    big = X.exact_groups(df.repartition(16)).filter("group_size > 1").agg(F.count(F.lit(1)).alias("n"), F.max("keep_id").alias("k"), F.count_if("kept").alias("kept")).first()
    assert tuple(big) == (1000, 2997, 1)


def brute_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = lower(rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
    fit = [(h + p, len(h), v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, key=lambda r: (len(r[0]), r[1], r[2])) if fit and host else None
    return host, path, best and best[0], best[2] if best else default


def test_urls_against_brute_force(spark):
    rng = random.Random(3)
    hosts = ["org", "example.org", "www.example.org", "EXAMPLE.org", "notexample.org", "a.b.com", "com", "x.y.z.com", ""]
    paths = ["", "/", "/en", "/en/1", "/en/12/x", "/es/", "/fr/a?b=/de/", "/de/#x", "/é/ü"]
    urls = [None, "", "no scheme", "http://", "x://example.org?/en/1", "http://a/b://c"]
    urls += [f"{rng.choice(['http', 'https', 'ftp'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    rules = [*U.RULES, ("example.org", "", "block"), ("www.example.org", "/en", "allow"), ("b.com", "/", "block"), ("b.com", "/en/12", "allow"), ("com", "/é", "block"), ("com", "/é", "allow"), ("", "/x", "block")]
    used = [(h, p, v) for h, p, v in rules if h]
    df = spark.createDataFrame([(i, u, "host?", "s") for i, u in enumerate(urls)] + [(0, None, "again", "s")], "page_id long, url string, host string, salt string")
    for n in (1, 7):
        got = U.judge_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string"), partitions=n).collect()
        assert len(got) == len(urls) + 1
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == brute_verdict(r.url, used), r.url
    long = spark.createDataFrame([(1, "http://example.org/" + "es/" * 300_000), (2, "http://" + "a." * 300_000 + "com/fr/")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in U.judge_urls(long, spark.createDataFrame(U.RULES, "host string, path string, verdict string")).orderBy("page_id").collect()] == [("example.org/es/", "block"), ("com/fr/", "allow")]
    none = U.judge_urls(df, spark.createDataFrame([], "host string, path string, verdict string"))
    assert {r.verdict for r in none.collect()} == {"allow"}
    assert U.judge_urls(df.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_index_finds_repeated_windows():
    import numpy as np

    rng = random.Random(3)
    for trial in range(40):
        window, letters = rng.choice([2, 3, 5, 9, 63, 64, 80, 130]), rng.choice([2, 3, 10, 50])
        seqs = [np.array([rng.randint(1, letters) for _ in range(rng.randint(1, 30))]) for _ in range(rng.randint(1, 15))]
        if trial % 3 == 0:
            seqs += [s.copy() for s in seqs[:2]] + [np.ones(40, int)]
        if window > 60:  # long common beginnings that part late
            stem = [rng.randint(1, letters) for _ in range(rng.randint(window - 20, window + 20))]
            seqs += [np.array(stem + [rng.randint(1, letters) for _ in range(rng.randint(0, 40))]) for _ in range(6)]
        count = Counter(tuple(s[i : i + window]) for s in seqs for i in range(len(s) - window + 1))
        want = [[i for i in range(len(s) - window + 1) if count[tuple(s[i : i + window])] > 1] for s in seqs]
        assert [x.tolist() for x in I.FMIndex(seqs, window).repeated_windows(seqs, window)] == want


def brute_removal(texts, window):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        out.append((len(w), b" ".join(x for x, k in zip(w, keep, strict=True) if k).decode()))
    return out


def test_kept_words_of_the_query(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(40))
    texts = ["a b \u2028", " a\u0085 b \u0085", "\t" + passage + " end \u2029", passage + "  \x0b", None, "", " ", "x\r\ny \n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.query(spark, str(tmp_path)).collect()}
    for i, (n, kept) in enumerate(brute_removal(texts, 35)):
        assert got[i] == (n, n - len(kept.encode().split()), hashlib.sha256(kept.encode()).hexdigest()), texts[i]


def test_columns_named_like_results(spark):
    df = spark.createDataFrame([(1, "a b", 7, "x"), (2, None, 8, "y")], "doc_id long, text string, N_words int, uid string")
    assert S.remove_repeats(df, keep=("doc_id", "N_words", "uid")).columns == ["doc_id", "uid", "text", "n_words", "n_removed"]
    kept = S.remove_repeats(df, keep=("doc_id", "N_words", "uid"), counts=("w", "r"))
    assert sorted(map(tuple, kept.collect())) == [(1, 7, "x", "a b", 2, 0), (2, 8, "y", None, 0, 0)]


@pytest.mark.parametrize("crowd", [1, 2, 1000])
def test_repeats_against_brute_force(spark, crowd):
    rng = random.Random(crowd)
    text = lambda n, v=400: [f"w{rng.randrange(v)}" for _ in range(n)]
    passages = [text(n) for n in (11, 12, 13, 40)]
    docs = []
    for _ in range(60):
        words = text(rng.randrange(0, 60))
        for p in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = p
        docs.append(rng.choice([" ", "\n", "  "]).join(words))
    docs += [docs[3], docs[3], None, "", " \t", " ".join(["a"] * 50), " ".join(text(30, 2)), "é ü\x0bx " * 30, " ".join(text(20_000, 3000) + passages[3])]
    df = spark.createDataFrame([(i % 65, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, n_words int")
    got = S.remove_repeats(df, window=12, crowd=crowd).collect()
    want = Counter((i % 65, n, n - len(kept.split())) for i, (n, kept) in enumerate(brute_removal(docs, 12)))
    assert Counter((r.doc_id, r.n_words, r.n_removed) for r in got) == want
    texts = Counter(" ".join((r.text or "").encode().split() and [w.decode() for w in (r.text or "").encode().split()]) for r in got)
    assert texts == Counter(kept for _, kept in brute_removal(docs, 12))
    assert S.remove_repeats(df.limit(0)).count() == 0
