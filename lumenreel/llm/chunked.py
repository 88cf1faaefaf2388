"""Encoding texts chunk by chunk, for patterns in which a space goes with the next word.

Texts are encoded a block at a time: Arrow splits a block's texts into chunks and finds the different ones, only those are
split into pieces and encoded, and numpy puts each text's ids together from them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Code points of one block of texts; a longer text is a block of its own.
BLOCK = 12 << 20
#: Code points after which an odd text is cut at the next place where a piece always begins.
SEGMENT = 1 << 16

#: Pieces that a task remembers, and the longest of them; they are forgotten when there are more, so memory is bounded.
MEMO, LONGEST = 500_000, 48

#: White space next to white space, or other than a plain space or line end, for Arrow's own expressions.
_ODD = r"[ \n][ \n]|[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Where a piece always begins: at a space or a line end between two characters that aren't white space, and right
#: after such a line end.
_BREAK = regex.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")


def blocks(texts: Iterable[str], size: int = BLOCK) -> Iterator[list[str]]:
    """Consecutive texts of together at most `size` code points, one at least."""
    held, load = [], 0
    for text in texts:
        if held and load + len(text) > size:
            yield held
            held, load = [], 0
        held.append(text)
        load += len(text)
    if held:
        yield held


def unlike(splitter) -> str | None:
    """An expression for the code points that a library's own splitter takes for another kind (letter, number, white space, rest)
    than `regex` does: each goes by the Unicode version that it was built with."""
    known = "".join(map(chr, [*range(0xD800), *range(0xF900, 0x40000)]))  # beyond lie no letters, numbers or white space
    strange: list[str] = []
    for kind, one in ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", "\t"), (r"[^\s\p{L}\p{N}]", "!")):
        alike = "".join(regex.findall(kind + "+", known))
        parts = [alike[a:b] for _, (a, b) in splitter.pre_tokenize_str(alike)]
        strange += (c for p in parts if len(splitter.pre_tokenize_str(one + p)) > 1 for c in p)
    codes = np.sort(np.array([ord(c) for c in strange], np.int64))
    if not len(codes):
        return None
    first = np.append(True, np.diff(codes) > 1)
    spans = zip(codes[first].tolist(), codes[np.append(first[1:], True)].tolist(), strict=True)
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in spans) + "]"


class Chunked(dict):
    """A dictionary of pieces with their ids as little-endian 32-bit bytes; pieces are what `pattern` finds, and
    encode is asked for each piece that isn't there.

    added: an expression for strings that stand for one id wherever they occur, and the id of each of its matches; the
    text before and after one is encoded apart.
    library: an expression for code points that the library takes for another kind than `pattern` (see `unlike`), and what gives a
    text's ids as the library does; parts of texts that have such a code point are left to it.
    """

    def __init__(
        self, encode: Callable[[str], bytes], pattern: str, added: tuple[re.Pattern, Callable[[re.Match], int]] | None = None,
        library: tuple[str | None, Callable[[str], np.ndarray]] = (None, bytes),
    ):
        self.encode, self.pieces, self.added = encode, regex.compile(pattern).findall, added
        self.strange, self.library = library[0] and re.compile(library[0]), library[1]
        self.odd = _ODD + (f"|{library[0]}" if library[0] else "")
        self.newline, self.space = self._plain("\n"), self._plain(" ")

    def __missing__(self, piece: str) -> bytes:
        coded = self.encode(piece)
        if len(piece) <= LONGEST:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = coded
        return coded

    def _plain(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.pieces(text))), "<u4")

    def _lines(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """For lines joined by line ends, all ids but those of the line ends, and how many each line has."""
        pieces = self.pieces(text)
        coded = list(map(self.__getitem__, pieces))
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        ends = np.fromiter(map("\n".__eq__, pieces), bool, len(pieces))
        ids = np.frombuffer(b"".join(coded), "<u4")
        return ids[np.repeat(~ends, sizes)], np.bincount(np.cumsum(ends)[~ends], sizes[~ends], minlength=ends.sum() + 1).astype(np.int64)

    def ids(self, texts: Iterable[str]) -> list[np.ndarray]:
        """Each whole text's ids."""
        return [ids for block in blocks(texts) for ids in self._block(block)]

    def _segment(self, text: str) -> np.ndarray:
        return self.library(text) if self.strange and self.strange.search(text) else self._plain(text)

    def _one(self, text: str) -> np.ndarray:
        out, at = [], 0
        for found in self.added[0].finditer(text) if self.added else ():
            out += map(self._segment, _segments(text[at : found.start()]))
            out.append(np.array([self.added[1](found)], "<u4"))
            at = found.end()
        out += map(self._segment, _segments(text[at:]))
        return np.concatenate(out).astype("<u4") if out else np.zeros(0, "<u4")

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        odd = pc.match_substring_regex(pa.array(texts, pa.large_string()), self.odd).to_numpy(zero_copy_only=False)
        if self.added:
            odd = [o or bool(self.added[0].search(text)) for o, text in zip(odd.tolist(), texts, strict=True)]
        plain = []
        for i, text in enumerate(texts):
            if odd[i]:
                out[i] = self._one(text)
            else:
                plain.append(i)
        if plain:
            # a tab leads the first chunk of a text or line, a line end is a chunk, and the rest follow a space
            marked = pa.array(["\t" + texts[i].replace("\n", " \n \t") for i in plain], pa.large_string())
            lists = pc.split_pattern(marked, " ")
            chunks = lists.values.dictionary_encode()
            ids, first, sizes = self._chunks(chunks.dictionary)
            which = chunks.indices.to_numpy()
            length = sizes[which]
            ends = np.cumsum(length)
            flat = ids[np.repeat(first[which] - (ends - length), length) + np.arange(ends[-1])]
            bounds = np.append(0, ends)[lists.offsets.to_numpy()].tolist()
            for i, a, b in zip(plain, bounds, bounds[1:], strict=False):
                out[i] = flat[a:b]
        return out

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different chunks end to end, and each chunk's first place and number of them."""
        first, sizes = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        special = pc.index_in(chunks, pa.array(["\t", "\n", ""], pa.large_string()))
        normal = np.flatnonzero(special.is_null().to_numpy(zero_copy_only=False))
        words = chunks.take(pa.array(normal))
        words = pc.if_else(pc.starts_with(words, "\t"), pc.utf8_replace_slice(words, 0, 1, ""), pc.utf8_replace_slice(words, 0, 0, " "))
        ids = np.zeros(0, "<u4")
        if len(words):
            line = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
            ids, sizes[normal] = self._lines(pc.binary_join(line, pa.scalar("\n", pa.large_string()))[0].as_py())
            first[normal] = np.cumsum(sizes[normal]) - sizes[normal]
        for kind, more in ((1, self.newline), (2, self.space)):
            at = pc.index(special, kind).as_py()
            if at >= 0:
                first[at], sizes[at] = len(ids), len(more)
                ids = np.concatenate([ids, more])
        return ids, first, sizes


def _segments(text: str) -> Iterator[str]:
    """A text in parts of about SEGMENT code points that pieces never cross."""
    start = 0
    while len(text) - start > SEGMENT:
        found = _BREAK.search(text, start + SEGMENT)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    if start < len(text):
        yield text[start:]
