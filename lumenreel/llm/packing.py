"""Best-fit packing of token pieces into sequences under several capacities.

Sequences have three capacities: tokens, documents and attention cost (the sum of squared piece lengths). Pieces
are taken by falling length; each goes to the open sequence that it fits under every capacity and that the
selection rule prefers: the smallest residual norm after placing ("norm"), or the largest weighted dot product of
the piece with the residual ("dot"). All pieces of one length, and all sequences with equal residuals, are alike,
so the rule runs on counts: a histogram with at most one entry per length goes to the driver, and the plan that
comes back says which ranks of a length go to which range of sequences. The pieces themselves stay distributed;
each finds its place from its rank within its length.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunked import Chunked, blocks, unlike
from .common import cut, releasing, table

TOKENS, DOCUMENTS, ATTENTION = 2048, 2048, 2048 * 2048
#: What residual tokens, documents and attention count for, each as a share of its capacity.
WEIGHTS = (1.0, 1.0, 1.0)
PIECES = "id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes stand for themselves, the others,
    in order, for the characters from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


@cache
def _encoder(path: str, pattern: str) -> Chunked:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    merge = tokenizer.model.tokenize  # the steps before it are the added tokens, the pattern and the letters below
    letters = _byte_letters()

    def encode(piece: str) -> bytes:
        ids = [t.id for t in merge(piece.encode().decode("latin-1").translate(letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    whole = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
    return Chunked(encode, pattern, _added_tokens(tokenizer.get_added_tokens_decoder()), (unlike(tokenizer.pre_tokenizer), whole))


def _added_tokens(added: dict) -> tuple[re.Pattern, Callable[[re.Match], int]] | None:
    """The expression for a tokenizer's added tokens, the longest first, and the id of each of its matches."""
    if any(token.single_word or token.normalized for token in added.values()):
        raise ValueError("added tokens that stand for whole words or are normalized aren't supported")
    order = sorted(added.items(), key=lambda item: -len(item[1].content))
    if not order:
        return None
    forms = [r"\s*" * t.lstrip + f"({re.escape(t.content)})" + r"\s*" * t.rstrip for _, t in order]
    return re.compile("|".join(forms)), lambda found: order[found.lastindex - 1][0]


def cut_pieces(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = TOKENS, end_id: int = 0) -> DataFrame:
    """Documents as pieces of at most `tokens` ids; only the first piece of a cut document is shorter.

    path names a byte-level tokenizer file and pattern the expression it splits texts by before merging. A string
    that the file lists as an added token is that token's id wherever a text holds it, as the library has it. Null
    text counts as empty: one piece with the end id alone. part and nth number the pieces of one length
    inside an input partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seen, rows = _encoder(path, pattern), TaskContext.get().partitionId(), {}, []
        end = np.array([end_id], "<u4")
        for batch in batches:
            keys, texts = iter(batch.column(0).to_pylist()), (t.as_py() or "" for t in batch.column(1))
            for block in blocks(texts):
                for key, ids in zip([next(keys) for _ in block], coder.ids(block), strict=True):
                    ids = np.append(ids, end)
                    n = len(ids)
                    start, stop = 0, n % tokens or tokens
                    for piece in range(-(-n // tokens)):
                        size = stop - start
                        nth = seen[size] = seen.get(size, -1) + 1
                        rows.append((key, piece, start, size, zlib.crc32(ids[start:stop]), part, nth))
                        start, stop = stop, stop + tokens
            if len(rows) > 10_000:
                yield _arrow(rows)
                rows = []
        if rows:
            yield _arrow(rows)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(releasing(run, lambda: _encoder(path, pattern).clear()), PIECES)


_ARROW = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def plan_packing(
    counts: dict[int, int], tokens: int = TOKENS, documents: int = DOCUMENTS, attention: int = ATTENTION,
    select: str = "norm", weights: tuple[float, float, float] = WEIGHTS,
) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, last rank + 1, first sequence, offset): where the pieces of a length go.

    The state is one row per range of sequences with equal residuals: tokens, documents and attention that are left,
    the first sequence and the one after the last. A step places pieces in one range or a part of it, so a length adds
    a few ranges at most, however many pieces there are. Ties go to the older range. Every length must fit an empty
    sequence.
    """
    empty = np.array([tokens, documents, attention], np.int64)
    w = np.array(weights, float) / empty.astype(float) ** 2
    rest, first, last, n = np.zeros((1024, 3), np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0
    plan, made = [], 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        item = np.array([size, 1, size * size], np.int64)
        if (item > empty).any():
            raise ValueError(f"a piece of {size} tokens fits no sequence")
        while left:
            fits = np.flatnonzero((last[:n] > first[:n]) & (rest[:n] >= item).all(axis=1))
            if len(fits):
                residual = rest[fits] - item * (select == "norm")
                score = -(residual * residual) @ w if select == "norm" else (residual * item) @ w
                at = int(fits[np.argmax(score)])
                start, take, residual = int(first[at]), min(left, int(last[at] - first[at])), rest[at] - item
                first[at] += take
            else:
                # as many of one length as an empty sequence takes go on in the next turns of the loop
                start, take, residual = made, -(-left // _alike(size, tokens, documents, attention)), empty - item
                made += take
            plan.append((size, rank, rank + take, start, tokens - int(residual[0]) - size))
            if (residual > 0).all():
                if n == len(rest):
                    alive = np.flatnonzero(last > first)
                    n, more = len(alive), np.zeros((max(1024, len(alive)), 3), np.int64)
                    rest, first, last = np.vstack([rest[alive], more]), np.append(first[alive], more[:, 0]), np.append(last[alive], more[:, 0])
                rest[n], first[n], last[n], n = residual, start, start + take, n + 1
            rank, left = rank + take, left - take
    return plan


def _alike(size: int, tokens: int, documents: int, attention: int) -> int:
    """How many pieces of one length a sequence takes."""
    return min(tokens // size, documents, attention // (size * size))


def pack(
    pieces: DataFrame, tokens: int = TOKENS, documents: int = DOCUMENTS, attention: int = ATTENTION,
    select: str = "norm", weights: tuple[float, float, float] = WEIGHTS,
) -> DataFrame:
    """Pieces (as cut_pieces gives them) with sequence_id and offset.

    Every piece is placed once, no sequence exceeds a capacity, and offsets have no gaps. What goes to the driver
    is one count per length (at most `tokens`), what goes to the tasks is the plan. An empty table stays empty.
    """
    spark = pieces.sparkSession
    per_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = np.array(plan_packing(counts, tokens, documents, attention, select, weights), np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast(plan[np.lexsort((plan[:, 1], plan[:, 0]))])
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    # Lengths reach tokens, so length and rank fit one sortable number.
    ranked = pieces.join(offsets, ["length", "part"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")
    )

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sent.value
        keys = (rows[:, 0] << 44) + rows[:, 1]
        for frame in frames:
            at = np.searchsorted(keys, (frame.length.to_numpy() << 44) + frame["rank"].to_numpy(), side="right") - 1
            frame["sequence_id"] = rows[at, 3] + frame.pop("rank").to_numpy() - rows[at, 1]
            frame["offset"] = rows[at, 4]
            yield frame

    return ranked.mapInPandas(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", **capacities) -> DataFrame:
    """All documents cut and packed: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    Null ids stay null; repeated rows are packed as often as they occur; other columns aren't read.
    """
    pieces = cut(cut_pieces(docs, path, pattern, id_col, text_col, capacities.get("tokens", TOKENS)), "pieces")
    return pack(pieces, **capacities).withColumnRenamed("id", id_col)


def query(spark, sf_dir):
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
