"""Toxicity by a counterfactual-regularised classifier.

Logistic regression on the words a text contains and their beginnings. Each labelled text that mentions an identity term is also seen
with that term swapped for the others of its list, and the squared change of its score is a penalty, so a mention
of a group alone can't move a score much whatever the labels suggest. The model is fitted on a bounded sample of
labelled rows; Spark counts the words that become features and scores all texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, cut, held_out, table

#: Most labelled rows that the fit reads, features it keeps, and rows a word must be in to become one.
ROWS, FEATURES, LEAST = 12_000, 6_000, 4
#: Least smoothed z-score of a word (presence by chance alone passes it about once in 400 words) and of a beginning, which
#: many words share.
CLEAR, CLEAR_START = 3.0, 5.0
THRESHOLD = 0.3
#: Terms that name groups; a term is swapped for the others of its list.
IDENTITY = (
    ("men", "women", "boys", "girls"),
    ("man", "woman", "boy", "girl"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("hommes", "femmes"),
    ("musulmans", "chrétiens", "juifs"),
    ("männer", "frauen"),
    ("muslime", "christen", "juden"),
    ("hombres", "mujeres"),
    ("musulmanes", "cristianos", "judíos"),
)
_WORD = re.compile(r"[^\W\d_]+")


_LISTED = frozenset(term for group in IDENTITY for term in group)


def words_of(text: str | None) -> set[str]:
    """A text's different words and, with a star behind them, the beginnings of longer words, so that forms of a word
    that the labels don't show count too. Identity terms have no beginnings, as swaps are of whole terms."""
    words = set(_WORD.findall((text or "").lower()))
    longer = words - _LISTED
    return words | {w[:4] + "*" for w in longer if len(w) > 4} | {w[:6] + "*" for w in longer if len(w) > 6}


class Model:
    """Feature words with weights, and a bias."""

    def __init__(self, words: list[str], weights: np.ndarray, bias: float):
        self.weights, self.bias = dict(zip(words, weights.tolist(), strict=True)), float(bias)

    def score(self, text: str | None) -> float:
        known = self.weights
        total = self.bias + sum(known[w] for w in words_of(text) if w in known)
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def fit_weights(
    rows: list[tuple[list[str], int]], words: list[str], identity=IDENTITY, penalty: float = 10.0, ridge: float = 0.2, steps: int = 300
) -> Model:
    """Full-batch proximal fit of logistic loss + ridge + penalty * mean squared score change under swaps.

    A swap of term a by b in a text that has a and not b changes the score by w_b - w_a, so the penalty is a
    quadratic form in the identity words' weights, weighted by how many texts allow each swap.
    """
    at = {w: i for i, w in enumerate(words)}
    n, k = len(rows), len(words)
    cols = [np.array([at[w] for w in ws if w in at], np.int64) for ws, _ in rows]
    y = np.array([label for _, label in rows], float)
    lens = np.array([len(c) for c in cols], np.int64)
    flat, owner = np.concatenate(cols) if cols else np.zeros(0, np.int64), np.repeat(np.arange(n), lens)
    swaps: dict[tuple[int, int], int] = {}
    for ws, _ in rows:
        have = set(ws)
        for group in identity:
            for a in have.intersection(group):
                for b in group:
                    if b not in have and a in at and b in at:
                        swaps[at[a], at[b]] = swaps.get((at[a], at[b]), 0) + 1
    left = np.array([a for a, _ in swaps], np.int64)
    right = np.array([b for _, b in swaps], np.int64)
    times = np.array(list(swaps.values()), float) / max(sum(swaps.values()), 1)
    w, bias = np.zeros(k), float(np.log((y.mean() + 1e-3) / (1.001 - y.mean()))) if n else 0.0
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for step in range(1, steps + 1):
        z = bias + np.bincount(owner, w[flat], minlength=n)
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / max(n, 1)
        grad = np.bincount(flat, error[owner], minlength=k) + ridge * w / max(n, 1)
        if len(left):
            change = penalty * times * (w[right] - w[left])
            grad += np.bincount(right, change, minlength=k) - np.bincount(left, change, minlength=k)
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        rate = 0.1 * (1 - step / (steps + 1))
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return Model(words, w, bias)


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, label) with the text's different words in its place."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([sorted(words_of(t.as_py())) for t in batch.column(0)], pa.list_(pa.string())), batch.column(1)], ["words", "y"])


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", order: Column | None = None, most: int = ROWS, features: int = FEATURES, **options) -> Model:
    """A model of labelled rows (text, 0/1); rows without a label are left out.

    About `most` rows are read, chosen by a hash. Features are the words whose presence tells labels apart best
    (by a smoothed z-score over the sampled rows, in at least LEAST rows), and all identity terms. To the driver
    come at most `features` words and, for each sampled row, which of them it has.
    """
    known = labelled.filter(F.col(label_col).isNotNull()).select(
        (F.xxhash64(text_col) if order is None else F.xxhash64(order)).alias("h"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("y")
    )
    total = known.count()
    drawn = known.filter(F.pmod("h", F.lit(1 << 20)) < int(min(1.0, most / max(total, 1)) * (1 << 20)))
    sample = cut(drawn.select("text", "y").mapInArrow(_worded, "words array<string>, y int"), "toxicity-sample")
    exploded = sample.select("y", F.explode("words").alias("word"))
    counted = exploded.groupBy("word").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q")).filter(F.col("p") + F.col("q") >= LEAST)
    sizes = sample.agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q")).first()
    odds = F.log((F.col("p") + 0.5) / (sizes.p + 1.0)) - F.log((F.col("q") + 0.5) / (sizes.q + 1.0))
    z = F.abs(odds) / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("q") + 0.5))
    chosen = [r.word for r in counted.filter(z >= F.when(F.col("word").endswith("*"), CLEAR_START).otherwise(CLEAR)).orderBy(z.desc(), "word").limit(features).collect()]
    words = sorted(set(chosen) | _LISTED)
    sent = labelled.sparkSession.sparkContext.broadcast(set(words))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            have = [sorted(sent.value.intersection(w.as_py())) for w in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(have, pa.list_(pa.string())), batch.column(1)], ["words", "y"])

    rows = [(r.words, r.y) for r in sample.mapInArrow(present, "words array<string>, y int").collect()]
    return fit_weights(rows, words, **options)


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep and score (0 to 1, higher: likelier toxic) for every whole text; null and empty texts
    get the score of a text without known words. A column of keep that is named like a result gives way to it."""
    keep = apart(keep, "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value
        for batch in batches:
            scores = [found.score(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*keep, "score"])

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    model = fit(docs.select("doc_id", "text").join(labels, "doc_id"), order=F.col("doc_id"))
    scored = score_texts(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
