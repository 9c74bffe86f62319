"""Registered queries of the corpus operators, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tracewise.llm import decontaminate, hardnegatives, htmlcut, licenses, lines, mixing, prefixtrie, privacy, randomindex, simhash, suffixes, tokencount, toxicity
from tracewise.llm.words import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_crf_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_random_index_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return randomindex.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_grammar_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_mincut_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlcut.main_texts(table(spark, sf_dir, "pages"))


@query
def op6_minhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op6_minhash_decontamination"] = decontaminate.SQL


@query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


ORACLES["op4_mix_sources"] = mixing.SQL


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


@query
def op10_boosted_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.personal_data(table(spark, sf_dir, "documents"))


@query
def op7_bwt_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(table(spark, sf_dir, "documents")).drop("kept")


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardnegatives.hard_negatives(table(spark, sf_dir, "embeddings"))


ORACLES["op11_hard_negatives"] = hardnegatives.SQL


@query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_tree(table(spark, sf_dir, "conversations"))


ORACLES["op13_prefix_trie"] = prefixtrie.SQL


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
