import base64
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from lumenreel.llm import byte_bpe as B
from lumenreel.llm import packing as K

RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "a", " a  b\n\nc \n d", "it's we'll", "日本語 🙂 été", "x" * 3000, "ab" * 20_000, " " * 500 + "z", "a\x1cb\x85c\xa0d", "<|endoftext|> x", "a <|endoftext|><|endoftext|>\n b  <|endoftext", " lead", "trail ", "\nlead\n", "one\ntwo three\n four", "x\n", "\n", "a\tb c"]


@pytest.fixture(scope="module")
def encoder():
    return B.Encoder(RANKS, P.PATTERN)


def test_ids_equal_the_library(encoder):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    letters = " \n\t\r  '’sdtréßü日🙂0123abcXYZ.,!-_ \x1c\x85"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for text in texts:
        ids = encoder.encode(text)
        assert ids.tolist() == library.encode_ordinary(text), repr(text[:80])
        assert encoder.decode(ids) == text.encode()


def test_prefix_table_appends_and_edits(encoder):
    rng = random.Random(2)
    table = B.PrefixTable(encoder.vocabulary, b"hello wonderful ththththwh")
    for _ in range(200):
        table.replace(rng.randint(0, len(table.data)), rng.randint(0, 4), bytes(rng.choice(b"abcth \xc3\xa9") for _ in range(3)))
        assert table.ids() == B.PrefixTable(encoder.vocabulary, table.data).ids() == encoder.vocabulary.merged(table.data)


def test_encoded_rows(spark, encoder):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "a b", "x"), (None, "a b", "x")]
    got = B.encode_texts(spark.createDataFrame(rows, "doc_id long, text string, ids string"), RANKS, P.PATTERN).collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == Counter((k, tuple(encoder.encode(t or "").tolist()), (t or "").encode()) for k, t, _ in rows)
    assert B.encode_texts(spark.createDataFrame([], "doc_id long, text string"), RANKS, P.PATTERN).count() == 0


def check_plan(counts, **caps):
    bins, placed = defaultdict(list), Counter()
    for size, first, last, sequence, offset in K.plan_packing(counts, **caps):
        placed[size] += last - first
        for i in range(last - first):
            bins[sequence + i].append((offset, size))
    assert placed == Counter(counts)
    for pieces in bins.values():
        end = 0
        for offset, size in sorted(pieces):
            assert offset == end
            end += size
        assert end <= caps.get("tokens", K.TOKENS) and len(pieces) <= caps.get("documents", K.DOCUMENTS)
        assert sum(s * s for _, s in pieces) <= caps.get("attention", K.ATTENTION)
    return len(bins)


def test_plans_keep_every_capacity():
    rng = random.Random(1)
    counts = Counter(min(1500, int(rng.lognormvariate(5.5, 1)) + 1) for _ in range(5000))
    total = sum(k * n for k, n in counts.items())
    assert check_plan(counts) <= total / 2048 * 1.01 + 1
    for select in ("norm", "dot"):
        check_plan(counts, documents=6, attention=1500 * 1600, select=select)
    assert check_plan({2048: 3}) == 3 and check_plan({}) == 0 and check_plan({1: 5000}) == 3
    with pytest.raises(ValueError):
        K.plan_packing({5: 1}, tokens=4)


def test_documents_are_packed_whole(spark):
    coder = Tokenizer.from_file(JSON)
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(99, " word" * 5000, 1), (99, "again", 1), (None, "no id", 1)]
    got = K.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3), JSON, P.PATTERN).collect()
    want = Counter()
    for key, text, _ in rows:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 0]
        start, stop, piece = 0, len(ids) % 2048 or 2048, 0
        while start < len(ids):
            want[key, piece, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())] += 1
            start, stop, piece = stop, stop + 2048, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        assert [o for o, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 2048
    assert K.pack_documents(spark.createDataFrame([], "doc_id long, text string"), JSON, P.PATTERN).count() == 0


def test_packed_rows_keep_their_document_over_blocks_of_texts(spark):
    rows = [(i, " word" * (500_000 + i)) for i in range(12)]  # a batch of several blocks
    got = K.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), JSON, P.PATTERN).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in got} == {i: 500_001 + i for i in range(12)}


def test_letters_that_the_library_does_not_know_yet():
    coder, library = K._encoder(JSON, P.PATTERN), Tokenizer.from_file(JSON)
    texts = ["plain text", "x\U00010940y", "it \U00010944'll be \u0558 <|endoftext|>\U00010eed1\n\u208f a\u0c5cb", "a  \U00010952'll\t\u0558"]
    assert [ids.tolist() for ids in coder.ids(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
