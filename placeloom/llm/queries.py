"""The registered queries of this subpackage: thin digests of the operators' results, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import automata, chosenpath, decontaminate, html, mixing, pii, quality, runindex, tokens, urls
from .common import shared_dir, table
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES", "vocabulary_path"]

#: The tokenizer's vocabulary, by its name in the installed collection.
VOCABULARY = "word_bpe_49k.json"


#: Target weights of the mix; sources that are not named weigh 1.
TARGETS = {"src0": 4, "src1": 2.5, "src2": 1.5, "src3": 0.25}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    tokens.write_shards(table(spark, sf_dir, "documents"), folder, vocabulary_path())
    return tokens.read_shards(spark, folder)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), TARGETS, 64, "doc_id")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.byte_dedup(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automata.substring_dedup(table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_ngram_jaccard_join,
        op3_token_shards,
        op4_pii,
        op5_mix_sources,
        op6_html_extraction,
        op7_suffix_array_dedup,
        op8_substring_dedup,
        op9_url_filters,
        op10_decontaminate,
    )
}
