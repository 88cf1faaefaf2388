"""Token counts by rank-synchronous merging of ragged arrays.

The different pieces of a block of texts stand end to end in one numpy array, a symbol for each byte. In every round each
piece finds the lowest rank among its neighbouring pairs and applies that pair wherever it has it; all pieces do so at
once. A piece without a pair that the vocabulary merges is done, and its symbols are counted. Ids are never put together.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunked import LONGEST, MEMO, _ODD, _segments, unlike
from .common import table
from .packing import _added_tokens, _byte_letters

LIMIT = 1024
#: Bytes of texts that are looked at together, a longer text alone, and bytes of pieces that are merged together.
BLOCK, SYMBOLS = 8 << 20, 1 << 20
NONE = np.iinfo(np.int32).max


class Merges:
    """The merges of a byte-level vocabulary: a rank and a symbol for each pair that merges."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.size = np.int64(max(vocabulary.values()) + 1)
        letters = _byte_letters()
        self.byte = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        pairs = {}
        for rank, (left, right) in enumerate(merges):
            pairs.setdefault((vocabulary[left], vocabulary[right]), (rank, vocabulary[left + right]))
        left, right = np.array(list(pairs), np.int64).reshape(-1, 2).T
        rank, made = np.array(list(pairs.values()), np.int64).reshape(-1, 2).T
        order = np.argsort(left * self.size + right)
        self.keys = np.append((left * self.size + right)[order], -1)
        self.ranks, self.made = np.append(rank[order], NONE), np.append(made[order], -1)
        # a pair's places may be merged together only if what it makes never joins a pair that comes before it
        born = np.full(self.size, -1, np.int64)
        np.maximum.at(born, made, rank)
        self.ordered = bool((rank > np.maximum(born[left], born[right])).all())

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in ranks and made; the last place is that of pairs which don't merge."""
        key = left * self.size + right
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols of each piece are left when no pair merges any more."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = sizes.copy()
        ends = np.cumsum(sizes)
        first = 0
        while first < len(pieces):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + SYMBOLS, side="right")))
            out[first:last] = self._merged(b"".join(pieces[first:last]), sizes[first:last])
            first = last
        return out

    def _merged(self, data: bytes, sizes: np.ndarray) -> np.ndarray:
        left_over = sizes.copy()
        which = np.flatnonzero(sizes > 1)  # the pieces under way
        owner = np.repeat(np.arange(len(sizes)), sizes)
        symbols = self.byte[np.frombuffer(data, np.uint8)][sizes[owner] > 1]
        sizes = sizes[which]
        pair = None
        while len(which):
            starts = np.cumsum(sizes) - sizes
            if pair is None:
                pair = self.look_up(symbols, np.append(symbols[1:], 0))
                pair[starts + sizes - 1] = len(self.keys) - 1
            rank = self.ranks[pair]
            least = np.minimum.reduceat(rank, starts)
            busy = least < NONE
            if not busy.all():
                left_over[which[~busy]] = sizes[~busy]
                stay = np.repeat(busy, sizes)
                symbols, pair, rank = symbols[stay], pair[stay], rank[stay]
                which, sizes, least = which[busy], sizes[busy], least[busy]
                starts = np.cumsum(sizes) - sizes
                if not len(which):
                    break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            piece = np.searchsorted(starts, at, side="right") - 1
            if self.ordered:
                # of neighbouring places, as in a run of one symbol, every other one from the left
                begins = np.append(True, np.diff(at) > 1)
                begins = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
                merge = (np.arange(len(at)) - begins) % 2 == 0
            else:
                merge = np.append(True, np.diff(piece) > 0)
            at, piece = at[merge], piece[merge]
            symbols[at] = self.made[pair[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            last = np.zeros(len(symbols), bool)
            last[starts + sizes - 1] = True
            last[at] |= last[at + 1]
            place = np.cumsum(keep) - 1
            symbols, pair, last = symbols[keep], pair[keep], last[keep]
            sizes = sizes - np.bincount(piece, minlength=len(sizes))
            changed = place[at]
            changed = np.unique(np.append(changed, np.maximum(changed - 1, 0)))
            pair[changed] = self.look_up(symbols[changed], symbols[np.minimum(changed + 1, len(symbols) - 1)])
            pair[last] = len(self.keys) - 1
        return left_over


class Counter(dict):
    """Tokens of pieces, and of texts as sums over their pieces. Pieces are what `pattern` finds; the strings that `added`
    matches stand for one token each, and the text before and after one is split apart. Parts of texts with a code point that
    the library takes for another kind than the pattern (`strange`, see `unlike`) are split by the library."""

    def __init__(self, merges: Merges, pattern: str, added: re.Pattern | None, strange: str | None = None, split: Callable[[str], list[str]] = list):
        self.merges, self.pieces, self.added = merges, regex.compile(pattern).findall, added
        self.strange, self.split = strange and re.compile(strange), split
        self.other = _ODD + (f"|{strange}" if strange else "")

    def learn(self, pieces: list[str]) -> np.ndarray:
        """The tokens of each piece; those that aren't known are merged together."""
        new = [p for p in dict.fromkeys(pieces) if p not in self]
        found = dict(zip(new, self.merges.counts([p.encode() for p in new]).tolist(), strict=True))
        out = np.fromiter((found[p] if p in found else self[p] for p in pieces), np.int64, len(pieces))
        if len(self) + len(found) > MEMO:
            self.clear()
        self.update((p, n) for p, n in found.items() if len(p) <= LONGEST)
        return out

    def _odd(self, text: str) -> int:
        """A text of any kind, in parts that pieces don't cross."""
        parts, strings = [text], 0
        if self.added:
            parts, at = [], 0
            for found in self.added.finditer(text):
                parts.append(text[at : found.start()])
                at, strings = found.end(), strings + 1
            parts.append(text[at:])
        return strings + sum(int(self.learn((self.split if self.strange and self.strange.search(s) else self.pieces)(s)).sum()) for part in parts for s in _segments(part))

    def texts(self, texts: pa.Array) -> np.ndarray:
        """The tokens of each text. A space goes with the word after it, so texts are cut at spaces and line ends by Arrow
        and only their different chunks are split into pieces; texts with other white space are split whole."""
        out = np.zeros(len(texts), np.int64)
        odd = pc.match_substring_regex(texts, self.other).to_numpy(zero_copy_only=False)
        if self.added:
            odd |= pc.match_substring_regex(texts, self.added.pattern).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._odd(texts[i].as_py())
        plain = np.flatnonzero(~odd)
        if len(plain):
            # a tab leads the first chunk of a text or line, a line end is a chunk, and the rest follow a space
            marked = pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n \t")
            lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\t", pa.large_string()), marked, pa.scalar("", pa.large_string())), " ")
            chunks = lists.values.dictionary_encode()
            sums = np.append(0, np.cumsum(self._chunks(chunks.dictionary.to_pylist())[chunks.indices.to_numpy()]))
            bounds = lists.offsets.to_numpy()
            out[plain] = sums[bounds[1:]] - sums[bounds[:-1]]
        return out

    def _chunks(self, chunks: list[str]) -> np.ndarray:
        texts = [c[1:] if c[:1] == "\t" else c if c == "\n" else " " + c for c in chunks]
        pieces = list(map(self.pieces, texts))
        found = np.append(0, np.cumsum(self.learn([p for some in pieces for p in some])))
        ends = np.append(0, np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))))
        return found[ends[1:]] - found[ends[:-1]]


@cache
def _counter(path: str, pattern: str) -> Counter:
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    model, before = said["model"], said["pre_tokenizer"] or {}
    plain = said["normalizer"] is None and before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True)
    if not plain or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        raise ValueError(f"{path} isn't a plain byte-level vocabulary")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    library = Tokenizer.from_file(path)
    added, splitter = _added_tokens(library.get_added_tokens_decoder()), library.pre_tokenizer
    split = lambda text: [text[a:b] for _, (a, b) in splitter.pre_tokenize_str(text)]
    return Counter(Merges(model["vocab"], merges), pattern, added and added[0], unlike(splitter), split)


def _blocks(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of together at most BLOCK bytes, one text at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + BLOCK, side="right")))
        yield texts.slice(first, last - first)
        first = last


def count_tokens(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_bytes (of UTF-8), n_tokens.

    path names a byte-level tokenizer file (no normalizer, no prefix space) and pattern the expression it splits texts by.
    A string that the file lists as an added token is one token wherever a text holds it, as the library has it; none are
    added at the ends, and nothing is cut or filled up. Null and empty texts have 0 of both. Texts are read whole, however
    long; the time of a piece grows with its length times the number of different ranks that it merges. Ids may be null,
    and repeated rows stay repeated; other columns aren't read. An empty table stays empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, pattern)
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            found = [counter.texts(block) for block in _blocks(texts)]
            columns = [batch.column(0), pc.binary_length(texts), pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_tokens"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = source.select("id").schema.add("n_bytes", "long").add("n_tokens", "long")
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def query(spark, sf_dir):
    import public_tokenizers

    found = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return found.withColumn("over_limit", F.col("n_tokens") > LIMIT)
