"""Language ID with word-first backoff.

A text's words are scored by their log frequency in each language where they are known; a word no language knows
is scored by its character n-grams, the longest ones that are known first, falling back to shorter ones. The
tables are counted by Spark over labelled rows and kept to a documented number of words and n-grams per language.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, cut, held_out, releasing, table

#: Most labelled rows that are read per language, and most words and n-grams of each length kept per language.
ROWS, WORDS, GRAMS, LONGEST = 8000, 20_000, 5_000, 4
#: Most words and n-grams of all languages together; with many languages each one keeps its share of them, evenly.
ITEMS = 1_000_000
#: Languages up to which their counts are broadcast.
FEW = 10_000
#: Unknown words and letter windows that a task remembers; they are forgotten when there are more.
MEMO = 200_000
#: Tokens of letters; everything else separates.
_WORD = re.compile(r"[^\W\d_]+")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and boundary-marked n-grams counted per language, a batch at a time."""
    for batch in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words.setdefault(lang, Counter()).update(_WORD.findall((text.as_py() or "").lower()))
        rows = []
        for lang, counted in words.items():
            grams: Counter = Counter()
            for word, n in counted.items():
                rows.append((lang, 0, word, n))
                for gram in _grams(word):
                    grams[gram] += n
            rows += [(lang, len(gram), gram, n) for gram, n in grams.items()]
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())], ["lang", "size", "item", "n"])


def _grams(word: str) -> Iterator[str]:
    """The n-grams of all of a word; a run of letters without separators may be as long as its text."""
    marked = f" {word} "
    return (marked[i : i + k] for k in range(1, LONGEST + 1) for i in range(len(marked) - k + 1))


class Model:
    """Log frequencies of words and n-grams by language, and the scoring of one text.

    Item i is known in the languages lang[ptr[i] : ptr[i + 1]], where its log frequency is gain above the floor that
    its size (0 for words, else letters of the n-gram) has in that language; elsewhere it is at the floor.
    """

    def __init__(self, rows: list[tuple[str, int, str, int]], totals: dict[tuple[str, int], int]):
        self.langs = sorted({lang for lang, *_ in rows})
        column = {lang: i for i, lang in enumerate(self.langs)}
        kinds = Counter(size for _, size, _, _ in rows)
        self.floors = np.array([[-math.log(totals.get((lang, size), 0) + kinds[size] + 1) for lang in self.langs] for size in range(LONGEST + 1)]).reshape(LONGEST + 1, -1)
        rows = sorted(rows, key=lambda r: (r[1], r[2]))
        self.tables: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        ptr, sizes = [], []
        for at, (_, size, item, _) in enumerate(rows):
            if item not in self.tables[size]:
                self.tables[size][item] = len(ptr)
                ptr.append(at)
                sizes.append(size)
        self.ptr, self.size = np.array([*ptr, len(rows)], np.int64), np.array(sizes, np.int64)
        self.lang = np.array([column[lang] for lang, *_ in rows], np.int64)
        self.gain = np.log(np.array([n for *_, n in rows], float) + 1)
        self.backoff, self.window = _Memo(self._grams_of), _Memo(self._longest)

    def forget(self) -> None:
        """Drops what is remembered of words and places in them."""
        self.backoff.clear()
        self.window.clear()

    def _longest(self, window: str) -> int:
        """The longest known n-gram that a window starts with; -1 for none."""
        return next((found for size in range(len(window), 0, -1) if (found := self.tables[size].get(window[:size])) is not None), -1)

    def _grams_of(self, word: str) -> list[int]:
        """The longest known n-gram at each place of a whole word."""
        marked, window = f" {word} ", self.window
        return [found for i in range(len(marked) - 1) if (found := window[marked[i : i + LONGEST]]) >= 0]

    def scores(self, words: dict[str, int]) -> np.ndarray:
        """Log scores of counted words in each language. A known word counts as itself, an unknown one as the mean of its
        n-grams, which is about a word's weight."""
        names, times = list(words), np.fromiter(words.values(), float, len(words))
        items = np.fromiter(map(self.tables[0].get, names, repeat(-1)), np.int64, len(names))
        grams: list[int] = []
        sizes, unknown = [], np.flatnonzero(items < 0)
        for i in unknown.tolist():
            found = self.backoff[names[i]]
            grams += found
            sizes.append(len(found))
        known = items >= 0
        at = np.concatenate([items[known], np.array(grams, np.int64)])
        sizes = np.array(sizes, np.int64)
        weight = np.concatenate([times[known], np.repeat(times[unknown] / np.maximum(sizes, 1), sizes)])
        first, many = self.ptr[at], self.ptr[at + 1] - self.ptr[at]
        ends = np.cumsum(many)
        where = np.repeat(first - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)
        gained = np.bincount(self.lang[where], self.gain[where] * np.repeat(weight, many), len(self.langs))
        return np.bincount(self.size[at], weight, LONGEST + 1) @ self.floors + gained

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _WORD.findall((text or "").lower())
        if not words or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        score = self.scores(Counter(words))
        weights = np.exp(score - score.max())
        best = int(weights.argmax())
        return self.langs[best], float(weights[best] / weights.sum())


class _Memo(dict):
    """Remembers what `find` gives for strings of up to 64 letters; longer ones hardly come again and would fill memory."""

    def __init__(self, find):
        self.find = find

    def __missing__(self, key: str):
        found = self.find(key)
        if len(key) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[key] = found
        return found

    def __reduce__(self):
        return _Memo, (self.find,)


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", order: Column | None = None, most: int = ROWS) -> Model:
    """A model of the labelled rows; rows whose lang is null are left out.

    Every language is learned. Of each about `most` rows are read, chosen by a hash of order, or else of doc_id and text,
    so that training stays of one size and copies of a text aren't all in or all out. What comes to the driver and
    goes to the tasks is at most WORDS words and GRAMS n-grams of each length per language, and ITEMS in all (or one word and
    one n-gram of each length for each language, if that is more).
    """
    order = F.xxhash64(*(c for c in ("doc_id", text_col) if c in rows.columns)) if order is None else F.xxhash64(order)
    known = rows.filter(F.col(lang_col).isNotNull())
    per_lang = cut(known.groupBy(lang_col).agg(F.count(F.lit(1)).alias("rows_of")), "languages")
    langs = per_lang.count()
    words, grams = (max(1, min(most, ITEMS // 2 // max(langs, 1) // lengths)) for most, lengths in ((WORDS, 1), (GRAMS, LONGEST)))
    share = F.least(F.lit(1.0), F.lit(float(most)) / F.col("rows_of"))
    sampled = known.join(F.broadcast(per_lang) if langs <= FEW else per_lang, lang_col).filter(F.pmod(order, F.lit(1 << 20)) < share * F.lit(1 << 20))
    counted = sampled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(releasing(_counts), "lang string, size int, item string, n long")
    counted = counted.groupBy("lang", "size", "item").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "item")
    top = counted.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= F.when(F.col("size") == 0, words).otherwise(grams))
    kept = [(r.lang, r.size, r["item"], r.n) for r in top.collect()]
    totals: Counter = Counter()
    for lang, size, _, n in kept:
        totals[lang, size] += n
    return Model(kept, totals)


def identify(
    docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """The columns of keep, lang_pred and score (the posterior of the prediction, 0 to 1), named by names, for every
    whole text.

    lang_pred is `und` and score 0 for null, empty or letterless text; ties go to the language first by name.
    A column of keep that is named like a result gives way to it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = apart(keep, *names)
    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value
        for batch in batches:
            said = [found.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            langs, scores = (list(x) for x in zip(*said, strict=True)) if said else ([], [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, *names])

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(releasing(run, lambda: sent.value.forget()), schema)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    found = identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
