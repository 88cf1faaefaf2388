"""Corpus jobs: copied phrases, language gates, word error rates, dialogue and excerpts, as joins and groupings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.batches import give_back, pieces
from .selection import cut

PHRASE, CONTENT, LINE = 5, 2, 3
_COMMON = frozenset(T.HEADLINE_COMMON)
#: Seconds of the bins in which spans and segments meet.
BIN = 30.0


def corpus_word_errors(pairs: DataFrame, reference: str, hypothesis: str, by: list[str]) -> DataFrame:
    """Word errors of pairs summed per group; the rate is errors over reference words and may pass 1."""
    e = pairs.withColumn("e", T.word_errors(F.col(reference), F.col(hypothesis)))
    sums = e.groupBy(*by).agg(*(F.sum(f"e.{k}").alias(k) for k in ("substitutions", "deletions", "insertions", "reference_words")))
    return sums.withColumn("rate", F.try_divide(F.col("substitutions") + F.col("deletions") + F.col("insertions"), F.col("reference_words")))


def lexicon(spark) -> DataFrame:
    """(word, language) of every listed function word; a fixed small table."""
    rows = [(w, lang) for lang, text in T.LANGUAGE_WORDS.items() for w in text.split()]
    return spark.createDataFrame(rows, "word string, language string").distinct()


def discriminative_words(words: DataFrame) -> DataFrame:
    """Words of a (word, language) table that one language alone has."""
    return words.groupBy("word").agg(F.count_distinct("language").alias("n"), F.min("language").alias("language")).filter("n = 1").drop("n")


def language_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document and language the number of its discriminative words; the lexicon is fixed, so it is broadcast."""
    tokens = docs.select(id_col, F.explode(T.edge_stripped(F.col(text_col))).alias("word"))
    listed = F.broadcast(discriminative_words(lexicon(docs.sparkSession)))
    return tokens.join(listed, "word").groupBy(id_col, "language").agg(F.count(F.lit(1)).alias("hits"))


def language_gate(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """docs with `reads`: whether each text plausibly is in its language. Tokens are made once per row, and only those
    that are a listed word are looked at for each language."""
    lists = T.discriminative_words()
    listed = sorted({w for ws in lists.values() for w in ws})
    primary = F.split_part(F.lower(F.trim(F.col(lang_col))), F.lit("-"), F.lit(1))
    tokens = docs.withColumn("__tokens", T.edge_stripped(F.col(text_col)))
    few = tokens.select(*docs.columns, F.size("__tokens").alias("__n"), F.filter("__tokens", lambda w: w.isin(*listed)).alias("__words"))
    hits = F.array(*(F.size(F.filter("__words", _one_of(ws))) for ws in lists.values()))
    counted = few.select(*docs.columns, "__n", hits.alias("__hits"))
    mine = F.try_element_at("__hits", F.nullif(F.array_position(T.literals(lists), primary).cast("int"), F.lit(0)))
    best = F.array_max("__hits")
    reads = mine.isNull() | (F.col("__n") < 6) | (best == 0) | (mine == best)
    return counted.select(*docs.columns, reads.alias("reads"))


def _one_of(listed: list[str]):
    return lambda w: w.isin(*listed)


_WORD = re.compile("[a-z0-9]+(?:'[a-z]+)?")
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the filters of phrases, 4 MB each. With very many phrases more pass that needn't; none is lost.
FILTER_BITS = 25
PHRASES = pa.schema([("kind", pa.string()), ("phrase", pa.string())])


class _Phrases:
    """Runs of five words of which two at least say something, and whole lines, as 64-bit hashes of a batch of texts at once.
    Words of different parts (lines, or whole texts) are in no run together."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            # the lowest bit is whether the word says something
            found = self.known[word] = xxhash.xxh64_intdigest(word) & ~1 | (word not in _COMMON)
        return found

    def words(self, parts: list[str]) -> list[list[str]]:
        return [_WORD.findall(part.replace("’", "'").lower()) for part in parts]

    def runs(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, part and first word of each run."""
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        h = np.fromiter((self._hash(w) for words in parts for w in words), np.uint64, int(sizes.sum()))
        if len(h) < PHRASE:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        part = np.repeat(np.arange(len(parts)), sizes)
        said = np.append(0, np.cumsum(h & np.uint64(1)).astype(np.int64))
        good = np.flatnonzero((part[PHRASE - 1 :] == part[: len(part) - PHRASE + 1]) & (said[PHRASE:] - said[:-PHRASE] >= CONTENT))
        with np.errstate(over="ignore"):
            run = h[good]
            for k in range(1, PHRASE):
                run = (run ^ (run >> np.uint64(29))) * _STEP + h[good + k]
            run = (run ^ (run >> np.uint64(32))) * _STEP
        return run, part[good], good - (np.cumsum(sizes) - sizes)[part[good]]


def _line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line, 1)


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a filter has a hash's two bits: 64-bit words, and the bits in them (both in one)."""
    slot = (hashes >> np.uint64(70 - FILTER_BITS)).astype(np.int64)
    bits = (np.uint64(1) << (hashes & np.uint64(63))) | (np.uint64(1) << ((hashes >> np.uint64(6)) & np.uint64(63)))
    return slot, bits


def _filter_rows(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The filter of a task's hashes, as rows (slot, bits)."""
    held = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for hashes in parts:
        np.bitwise_or.at(held, *_slots(np.unique(hashes)))
    at = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at].view(np.int64))], ["slot", "bits"])
    give_back()


def _filter(rows: DataFrame) -> np.ndarray:
    """The filter that rows (slot, bits) make together."""
    found = rows.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _passes(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot, bits = _slots(hashes)
    return held[slot] & bits == bits


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _in_pieces(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into pieces by the bytes of a column: a text's words are many times its size."""
    for batch in batches:
        for first, n in pieces(batch.column(text)):
            yield batch.slice(first, n)
        give_back()


def _their_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Originals as filter rows: runs of the whole text, and lines."""
    phrases = _Phrases()

    def parts() -> Iterator[np.ndarray]:
        for batch in _in_pieces(batches, 0):
            texts = _texts(batch.column(0))
            yield phrases.runs(phrases.words(texts))[0]
            lines = {" ".join(words) for words in phrases.words([line for t in texts for line in t.split("\n")]) if len(words) >= LINE}
            yield np.fromiter(map(_line_hash, lines), np.uint64, len(lines))

    yield from _filter_rows(parts())


def _their_phrases(held):
    """The phrases of originals that pass a filter, as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = _Phrases()
        for batch in _in_pieces(batches, 0):
            texts = _texts(batch.column(0))
            words = phrases.words(texts)
            found, part, first = phrases.runs(words)
            at = np.flatnonzero(_passes(held.value, found))
            rows = {("run", " ".join(words[p][i : i + PHRASE])) for p, i in zip(part[at].tolist(), first[at].tolist(), strict=True)}
            lines = [" ".join(w) for w in phrases.words([line for t in texts for line in t.split("\n")]) if len(w) >= LINE]
            passed = _passes(held.value, np.fromiter(map(_line_hash, lines), np.uint64, len(lines)))
            rows |= {("line", line) for line, ok in zip(lines, passed.tolist(), strict=True) if ok}
            yield _phrase_batch(list(rows), PHRASES)

    return run


def _phrase_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _our_phrases(held):
    """Rows (id, text) as (id, kind, phrase) of phrases that pass a filter: runs within lines, and lines of three words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = _Phrases()
        for batch in _in_pieces(batches, 1):
            lines, owner = [], []
            for i, text in enumerate(_texts(batch.column(1))):
                some = [line for line in text.split("\n") if line.strip(" ") and not line.startswith("[")]
                lines += some
                owner += [i] * len(some)
            words = phrases.words(lines)
            found, part, first = phrases.runs(words)
            at = np.flatnonzero(_passes(held.value, found))
            rows = {(owner[p], "run", " ".join(words[p][i : i + PHRASE])) for p, i in zip(part[at].tolist(), first[at].tolist(), strict=True)}
            long = [(o, " ".join(w)) for o, w in zip(owner, words, strict=True) if len(w) >= LINE]
            passed = _passes(held.value, np.fromiter((_line_hash(line) for _, line in long), np.uint64, len(long)))
            rows |= {(o, "line", line) for (o, line), ok in zip(long, passed.tolist(), strict=True) if ok}
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            keys = batch.column(0).take(pa.array(list(columns[0]), pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(list(columns[1]), pa.string()), pa.array(list(columns[2]), pa.string())], [batch.schema.names[0], "kind", "phrase"])

    return run


def _phrase_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases (kind, phrase) as filter rows."""
    phrases = _Phrases()

    def parts() -> Iterator[np.ndarray]:
        for batch in _in_pieces(batches, 1):
            kinds, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield phrases.runs([t.split(" ") for k, t in zip(kinds, texts, strict=True) if k == "run"])[0]
            yield np.array([_line_hash(t) for k, t in zip(kinds, texts, strict=True) if k == "line"], np.uint64)

    yield from _filter_rows(parts())


def shared_phrases(candidates: DataFrame, originals: DataFrame, id_col: str, text_col: str, original_col: str) -> DataFrame:
    """Distinct phrases of candidates that an original has: runs of five words that say something, or whole lines of
    three words or more.

    Runs are hashed from their words' hashes, a batch at a time. The originals' hashes make a filter of fixed size, which candidates
    are held against before any phrase is put together; what passes makes a filter for the originals in turn, and only
    phrases that pass both are compared as text, by a join that moves both sides.
    """
    spark, rows = candidates.sparkSession, "slot long, bits long"
    theirs = originals.select(F.col(original_col).cast("string").alias("text"))
    sent = spark.sparkContext.broadcast(_filter(theirs.mapInArrow(_their_hashes, rows)))
    ours = candidates.select(id_col, F.col(text_col).cast("string").alias("__text"))
    ours = cut(ours.mapInArrow(_our_phrases(sent), ours.select(id_col).schema.add("kind", "string").add("phrase", "string")))
    back = spark.sparkContext.broadcast(_filter(ours.select("kind", "phrase").distinct().mapInArrow(_phrase_hashes, rows)))
    known = theirs.mapInArrow(_their_phrases(back), "kind string, phrase string").distinct()
    return ours.join(known, ["kind", "phrase"], "left_semi").select(id_col, "phrase").distinct()


def blocked_names(docs: DataFrame, names: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Which listed one-word names occur as whole words, by an equi-join on distinct tokens."""
    token = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(r"(?U)[\p{L}\p{N}_]+"), F.lit(0)))).alias("token")
    wanted = names.select(F.lower("name").alias("token"), "name").distinct()
    return docs.select(id_col, token).join(wanted, "token").groupBy(id_col).agg(F.sort_array(F.collect_set("name")).alias("names"))


#: Ends of lines as a text editor has them, and a row that names its speaker: a letter first, no colon, 40 characters at most.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
NAMED = r"(?U)^([A-Za-z][^:]{0,39}?)\s*:\s*(\S.*)$"


def parse_dialogue(scripts: DataFrame, id_col: str, text_col: str, longest: int = 300, narrator: str = "Narrator") -> DataFrame:
    """Rows (id, speech, part, speaker, text): "Name: words" starts a speech, a nameless row continues it, and the first nameless
    rows are the narrator's; long speeches split at sentences. A name begins with a letter a to z of either case and has anything but
    a colon; no space is needed after that."""
    rows = scripts.select(id_col, F.posexplode(F.split(text_col, LINE_ENDS)).alias("at", "raw")).withColumn("raw", T.strip(F.col("raw"))).filter("raw <> ''")
    named = F.regexp_extract("raw", NAMED, 1)
    rows = rows.select(id_col, "at", "raw", named.alias("name")).select(id_col, "at", "name", F.when(F.col("name") != "", F.regexp_extract("raw", NAMED, 2)).otherwise(F.col("raw")).alias("said"))
    w = Window.partitionBy(id_col).orderBy("at")
    rows = rows.withColumn("speech", F.sum(F.when(F.col("name") != "", 1).otherwise(0)).over(w))
    speech = rows.groupBy(id_col, "speech").agg(
        F.max("name").alias("name"), T.squeeze(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "said"))), lambda x: x.said), " ")).alias("text")
    )
    pieces = F.when(F.length("text") <= longest, F.array("text")).otherwise(T.pack_sentences(F.col("text"), longest))
    parts = speech.select(id_col, "speech", F.when(F.col("name") == "", narrator).otherwise(T.squeeze(F.col("name"))).alias("speaker"), F.posexplode(pieces).alias("part", "text"))
    return parts.select(id_col, "speech", "part", "speaker", "text")


def source_excerpt(segments: DataFrame, spans: DataFrame, limit: int = 600) -> DataFrame:
    """Per span the text of the source's segments that overlap it, cut with an ellipsis."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BIN), F.floor(F.col(b) / BIN))).alias("bin")
    met = spans.select("*", cells("span_start", "span_end")).join(segments.select("*", cells("seg_start", "seg_end")), ["source_id", "bin"]).filter("seg_end > span_start AND seg_start < span_end")
    met = met.filter(F.col("bin") == F.floor(F.greatest("seg_start", "span_start") / BIN)).drop("bin")  # the first they share
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg_start", "segment", "text"))), lambda x: x.text), " ")
    return met.groupBy("source_id", "span_id").agg(T.squeeze(said).alias("text")).withColumn(
        "text", F.when(F.length("text") > limit, F.concat(F.rtrim(F.substring("text", 1, limit)), F.lit("…"))).otherwise(F.col("text"))
    )
