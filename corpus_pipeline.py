"""A corpus pipeline over the documents table: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run() writes each stage's result as Parquet in the shared folder and reads it again for the next. Null texts,
null ids, empty tables and repeated rows pass through as the operators' docstrings say; ids are taken to be unique.
Further columns of documents, whatever their names, go through all stages but the last.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.llm import exact_dedup, language_id, packing, simhash, substring_dedup
from lumenreel.llm.common import cut, held_out, importable, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those in which no learned language has half of the posterior."""
    model = language_id.fit(docs.filter(~held_out(F.col("doc_id"))))
    found = language_id.identify(docs, model, keep=tuple(docs.columns), names=("__lang", "__score"))
    return found.filter("__lang <> 'und' AND __score >= 0.5").select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal after lower-casing A-Z the document with the largest id stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints the document with the smallest id stays."""
    gone = simhash.near_groups(docs).filter("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that occur elsewhere go; a document that loses words has its length counted anew."""
    rest = tuple(c for c in docs.columns if c != "text")
    found = substring_dedup.remove_repeats(docs, keep=rest, counts=("__words", "__removed"))
    counted = F.when(F.col("__removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", counted).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def _stage(function):
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        importable(spark)
        return function(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", _stage(identify_language)),
    ("exact_dedup", _stage(drop_exact_copies)),
    ("simhash_near_dedup", _stage(drop_near_copies)),
    ("substring_dedup", _stage(remove_repeated_passages)),
    ("best_fit_packing", _stage(pack_sequences)),
]

#: SQL expresses neither the fingerprints nor the tokenizer; tests hold each stage against a plain model of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
