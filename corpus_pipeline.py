"""The corpus pipeline: five stages from raw documents to tokens, each one operator of linkloom.llm.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet
to the shared folder and reads again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import exact_dedup, langid, mixing, near_copies, pieces
from linkloom.llm.common import materialise, table
from linkloom.llm.queries import piece_model


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier can tell; those it rejects go. A document that repeats an id and a text
    stays or goes with its copies."""
    found = langid.filter_rejected(docs, langid.train(langid.labelled_sample(docs)))
    return found.select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.keep_one(docs).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash, or 0.8 Jaccard similarity on five words), the document with the smallest id. Texts
    without words, null ones included, are one group. A document without an id stays only where its whole group has none; ties
    go to the smallest content hash; of rows that repeat both id and text one stays. An empty table gives an empty one."""
    return near_copies.keep_one(docs).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document once for each pass in which the mix takes words of it, in the order of the curriculum."""
    return mixing.read_in_order(docs).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document, as digests: one row for each row, repeated ones included; a null text counts as empty and has no
    tokens."""
    return pieces.piece_digests(docs, piece_model())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode),
]

#: SQL has neither the classifier nor XXH64 nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
