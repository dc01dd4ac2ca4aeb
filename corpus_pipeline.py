"""A corpus pipeline over ``documents``: quality rules, line dedup, near-duplicate join, substring dedup, packing.

Each stage reads the table that the one before it wrote. All but the last return
the columns of ``documents``, with ``n_chars`` of the text as it now stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.line_dedup import dedup_lines
from lodestack.llm.ngram_join import one_of_each
from lodestack.llm.packing import pack_documents
from lodestack.llm.quality import kept_documents
from lodestack.llm.suffix_dedup import dedup_substrings
from lodestack.runtime import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the measures or are depleted of their own lines go."""
    return kept_documents(docs).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents stay only in the first document that holds them."""
    return _documents(dedup_lines(docs, min_docs=10, min_chars=1, keep_first=True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by five-word shingles at a similarity of 0.8, the one with the smallest id stays."""
    return one_of_each(docs, size=5, percent=80).select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier go."""
    return _documents(dedup_substrings(docs, 100))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document with their places in sequences of 1,024."""
    return pack_documents(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", substrings), ("packing", packing)]

#: SQL has no means for suffix arrays and byte-level BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
