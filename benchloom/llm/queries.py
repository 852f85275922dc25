"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from benchloom.llm import mixing, nearpairs, oracle, quantiles, sampling, sentences, tokens
from benchloom.session import table


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.percentiles(table(spark, sf_dir, "sample_results"), table(spark, sf_dir, "category_aliases"))


def p2_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summaries themselves, to be kept and merged later."""
    return quantiles.daily(table(spark, sf_dir, "sample_results"), table(spark, sf_dir, "category_aliases"))


def p2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.totals(table(spark, sf_dir, "sample_results"), table(spark, sf_dir, "category_aliases"))


def _plans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf_dir, "samples"), table(spark, sf_dir, "sampling_plans"), table(spark, sf_dir, "category_aliases")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.found(*_plans(spark, sf_dir))


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample(*_plans(spark, sf_dir))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.cell_report(*_plans(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearpairs.found(table(spark, sf_dir, "samples"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearpairs.groups(table(spark, sf_dir, "samples"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.selection(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p2_percentiles, p2_daily, p2_totals, p3_found, p3_sample, p3_report, p4_found, p4_groups, p6_ids, p7_found, p7_report, p7_selection, p8_found)}
ORACLE_SQL = oracle.SQL
