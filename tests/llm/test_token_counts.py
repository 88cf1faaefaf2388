import random
from collections import Counter

import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lumenreel.llm import token_counts as T

JSON = P.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n", "\n\n", "a", " a  b\n\nc \n d", "it's we'll 'x", "日本語 🙂 été", "x" * 3000, "ab" * 20_000, " " * 500 + "z", "a\x1cb\x85c\xa0d", "<|endoftext|> x",
    "a <|endoftext|><|endoftext|>\n b  <|endoftext", " lead", "trail ", "\nlead\n", "one\ntwo three\n four", "x\n", "a\tb c", "a \n", " \n a", "aaaa aaa aaaaaaa", "\x00\x01 \x7f",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def expected(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_counts_equal_the_library(library):
    rng = random.Random(5)
    letters = " \n\t\r  '’sdtréßü日🙂0123abcXYZ.,!-_ \x1c\x85　"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcdefghij") for _ in range(2000)), " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 12))) for _ in range(3000))]
    counter = T._counter(JSON, P.PATTERN)
    assert counter.merges.ordered
    assert counter.texts(pa.array(texts, pa.large_string())).tolist() == [expected(library, t) for t in texts]


def test_merging_one_place_at_a_time_gives_the_same(library):
    counter = T._counter(JSON, P.PATTERN)
    rng = random.Random(6)
    pieces = ["".join(rng.choice("aabthe ") for _ in range(rng.randint(1, 30))).encode() for _ in range(500)]
    together = counter.merges.counts(pieces).tolist()
    counter.merges.ordered = False
    try:
        assert counter.merges.counts(pieces).tolist() == together
    finally:
        counter.merges.ordered = True


def test_small_blocks_and_forgetting(library, monkeypatch):
    monkeypatch.setattr(T, "SYMBOLS", 7)
    monkeypatch.setattr(T, "MEMO", 3)
    counter = T.Counter(T._counter(JSON, P.PATTERN).merges, P.PATTERN, T._counter(JSON, P.PATTERN).added)
    texts = ["one two three four five", "five four three", "one one", ""]
    assert counter.texts(pa.array(texts, pa.large_string())).tolist() == [expected(library, t) for t in texts]
    assert len(counter) <= 12


def test_merges_that_undo_the_order_are_seen():
    letters = T._byte_letters()
    vocabulary = {letters[b]: b for b in range(256)} | {"ab": 256, "abc": 257, "bc": 258}
    assert T.Merges(vocabulary, [("a", "b"), ("ab", "c"), ("b", "c")]).ordered
    early = T.Merges(vocabulary, [("ab", "c"), ("a", "b"), ("b", "c")])
    assert not early.ordered and early.counts([b"ababcab", b"bc", b"x"]).tolist() == [3, 1, 1]


def test_rows(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "a b", "x"), (7, "again", "x"), (7, "again", "x"), (8, " word" * 30_000, "x")]
    got = T.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3), JSON, P.PATTERN).collect()
    assert Counter(map(tuple, got)) == Counter((k, len((t or "").encode()), expected(library, t)) for k, t, _ in rows)
    empty = T.count_tokens(spark.createDataFrame([], "doc_id long, text string"), JSON, P.PATTERN)
    assert empty.columns == ["doc_id", "n_bytes", "n_tokens"] and empty.count() == 0


def test_query_over_the_table(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in T.query(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for key, text in texts.items():
        n = expected(library, text)
        assert (got[key].n_bytes, got[key].n_tokens, got[key].over_limit) == (len(text.encode()), n, n > 1024)


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        T._counter(P.path("word_bpe_49k.json"), P.PATTERN)


def test_letters_that_the_library_does_not_know_yet():
    library = Tokenizer.from_file(JSON)
    texts = ["plain text", "it \U00010944'll be ՘ <|endoftext|>\U00010eed1\n₏ a౜b", "a  \U00010952'll\t՘"]
    assert T._counter(JSON, P.PATTERN).texts(pa.array(texts, pa.large_string())).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
