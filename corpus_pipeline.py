"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, token shards.

Each stage takes the documents that its predecessor kept, as a table read from Parquet.  All but the last return
the columns of ``documents``.  Mixing decides the order in which rows are stored; the last stage writes the token
shards in the stored order and reports per document where its ids start in them.

Null and empty texts have no words, so the quality rules drop them; null languages and sources are groups of their
own.  Of equal texts, repeated rows and texts with equal shingles one row stays.  Ids may repeat or be null.  Extra
columns of the input are left out.  Texts of any length are kept whole.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm import chosenpath, decontaminate, mixing, quality, tokens
from placeloom.llm.common import shared_dir, staged, table
from placeloom.llm.queries import TARGETS, vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosenpath.keep_one(docs.select(*COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), action="documents")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_mixed_order(docs.select(*COLUMNS), TARGETS)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in the order in which ``docs`` is stored: by file, then by row of the file."""
    folder = shared_dir(spark)
    stored = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_index"))
    tokens.write_shards(stored, folder, vocabulary_path(), order=("file_name", "row_index"))
    return tokens.read_shards(spark, folder)


STAGES = [
    ("quality rules", good_documents),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", token_shards),
]

#: Neither the chosen paths nor the tokenizer can be stated in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each one's result written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, "snappy")
    return docs
