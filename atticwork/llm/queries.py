"""The thin queries over the driver tables and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chaining, class_lm, cover_tree, cross_polytope, gnat_codes, line_dedup, mixing, ngram_join, packing, prefix_trie, quality, secrets_forest, url_filter
from .common import table


def op1_cover_tree(spark: SparkSession, directory: str) -> DataFrame:
    return cover_tree.query(table(spark, directory, "embeddings"))


def op2_ngram_join(spark: SparkSession, directory: str) -> DataFrame:
    return ngram_join.query(table(spark, directory, "documents"))


def op3_line_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return line_dedup.query(table(spark, directory, "documents"))


def op4_best_fit_packing(spark: SparkSession, directory: str) -> DataFrame:
    return packing.query(table(spark, directory, "documents"))


def op5_quality(spark: SparkSession, directory: str) -> DataFrame:
    return quality.query(table(spark, directory, "documents"), table(spark, directory, "labels"))


def op6_secret_scan(spark: SparkSession, directory: str) -> DataFrame:
    return secrets_forest.query(table(spark, directory, "documents"))


def op7_class_lm(spark: SparkSession, directory: str) -> DataFrame:
    return class_lm.query(table(spark, directory, "documents"))


def op8_mixing(spark: SparkSession, directory: str) -> DataFrame:
    return mixing.query(table(spark, directory, "documents"))


def op9_substring_chaining(spark: SparkSession, directory: str) -> DataFrame:
    return chaining.query(table(spark, directory, "documents"))


def op10_cross_polytope(spark: SparkSession, directory: str) -> DataFrame:
    return cross_polytope.query(table(spark, directory, "embeddings"))


def op11_url_filter(spark: SparkSession, directory: str) -> DataFrame:
    return url_filter.query(spark, table(spark, directory, "pages"))


def op12_gnat_codes(spark: SparkSession, directory: str) -> DataFrame:
    return gnat_codes.query(table(spark, directory, "embeddings"))


def op13_prefix_trie(spark: SparkSession, directory: str) -> DataFrame:
    return prefix_trie.query(table(spark, directory, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_cover_tree, op2_ngram_join, op3_line_dedup, op4_best_fit_packing, op5_quality,
        op6_secret_scan, op7_class_lm, op8_mixing, op9_substring_chaining, op10_cross_polytope,
        op11_url_filter, op12_gnat_codes, op13_prefix_trie,
    )
}
#: The others cannot be written in SQL; tests hold them against brute force, round trips or held-out rows.
SQL = {
    "op1_cover_tree": cover_tree.ORACLE, "op3_line_dedup": line_dedup.ORACLE, "op11_url_filter": url_filter.ORACLE,
    "op12_gnat_codes": gnat_codes.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE,
}
