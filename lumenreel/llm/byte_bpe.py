"""Byte-level BPE encoding and decoding by prefix dynamic programming.

A token sequence is the BPE encoding of its bytes exactly when each two neighbours are: merging the bytes of the
pair alone gives the pair back. So every prefix of a piece has one valid last token, and the encoder stores just
that token for each prefix. The encoding is read off backwards; appending bytes extends the table without
touching what is there, and an edit re-computes from the first changed byte only (`PrefixTable`).
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunked import Chunked, blocks
from .common import table


class Vocabulary:
    """Ranks by token bytes, tokens by id, and the test for valid neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.suffixes = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.suffixes.add_word(token.decode("latin-1"), (rank, len(token)))
        self.suffixes.make_automaton()
        self.longest = max(map(len, ranks), default=1)
        self.valid: dict[tuple[int, int], bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))})

    def merged(self, data: bytes, least: int = 1) -> list[int]:
        """Plain rank-order merging down to `least` parts; used on single tokens and in tests."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            pairs = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
            low = min(pairs)
            if low == 1 << 60:
                break
            at = pairs.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens of the last merge that makes this one; none for a byte or a token no merges make."""
        if token not in self._halves:
            parts = self.merged(self.tokens[token], 2)
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def reachable(self, token: int) -> bool:
        return self.halves(token) is not None or len(self.tokens[token]) == 1

    def neighbours(self, left: int, right: int) -> bool:
        """Whether `right` may follow `left`, which is -1 at the start of a piece."""
        found = self.valid.get((left, right))
        if found is None:
            if len(self.valid) > 500_000:
                self.valid.clear()
            found = self.valid[left, right] = self.reachable(right) and (left < 0 or self._neighbours(left, right))
        return found

    def _neighbours(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives just these two: undo their merges, latest first, and see that
        at no moment a merge across the border would have come before the merge undone there."""
        ranks, tokens, bar = self.ranks, self.tokens, 1 << 60
        while True:
            if ranks.get(tokens[left] + tokens[right], bar) < bar:
                return False
            parts = self.halves(max(left, right)) or self.halves(min(left, right))
            if parts is None:
                return True
            if parts == self.halves(left) and (left > right or self.halves(right) is None):
                bar, left = left, parts[1]
            else:
                bar, right = right + 1, parts[0]


class PrefixTable:
    """The valid last token of every prefix of `data`; grows by append, shrinks by cut."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Tokens that end in the new bytes, found by one automaton, longest first at each end."""
        v, last, old = self.vocabulary, self.last, len(self.data)
        self.data += more
        neighbours, valid = v.neighbours, v.valid
        add, done = last.append, old
        for end, (token, size) in v.suffixes.iter(self.data.decode("latin-1"), max(0, old + 1 - v.longest)):
            if end >= done:
                left = last[end + 1 - size]
                found = valid.get((left, token))
                if neighbours(left, token) if found is None else found:
                    add(token)
                    done = end + 1

    def replace(self, at: int, removed: int, added: bytes) -> None:
        """Re-encode near an edit: prefixes before `at` keep their tokens."""
        rest = added + self.data[at + removed :]
        self.data = self.data[:at]
        del self.last[at + 1 :]
        self.append(rest)

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class Encoder:
    """Texts to ids: pattern pieces, whole-piece tokens first, else the prefix table."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary.load(path)
        self.chunked = Chunked(self.piece, pattern)

    def piece(self, piece: str) -> bytes:
        """A piece's ids as little-endian 32-bit bytes."""
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)
        ids = [whole] if whole is not None else PrefixTable(self.vocabulary, data).ids()
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        return [ids.view("<i4") for ids in self.chunked.ids(texts)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids.tolist()))


@cache
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, ids (array of int), decoded (binary: the ids' bytes).

    Null text counts as empty and gives an empty array and empty bytes. The pattern is one of those in which a
    space goes with the word after it, as encoding by chunks relies on that. Text that isn't valid UTF-8 can't occur in a
    Spark string column read from Parquet. Long texts are encoded whole. Rows keep their order and number.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            keys = iter(batch.column(0).to_pylist())
            for block in blocks(t.as_py() or "" for t in batch.column(1)):
                yield _coded(encoder, [next(keys) for _ in block], encoder.encode_all(block))

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(
        run, "id long, ids array<int>, decoded binary"
    ).withColumnRenamed("id", id_col)


def _coded(encoder: Encoder, keys: list, ids: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, ids)]).astype("i4")
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
    decoded = pa.array(map(encoder.decode, ids), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists, decoded], ["id", "ids", "decoded"])


def query(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = encode_texts(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
