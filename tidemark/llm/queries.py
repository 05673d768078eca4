"""The queries of this subpackage: ``opN_<name>`` on the whole of its table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bytebpe, html, importance, langid, media, neighbours, packing, periodic, pii, simhash, substring, toxicity, urlfilter
from tidemark.llm.runtime import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digests(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.encoding_digests(table(spark, sf_dir, "documents"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeat_digests(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_rows(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_rows(table(spark, sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_digests(table(spark, sf_dir, "documents"), width=3)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_packing": op2_packing,
    "op3_bytebpe": op3_bytebpe,
    "op4_substring": op4_substring,
    "op5_html": op5_html,
    "op6_media": op6_media,
    "op7_langid": op7_langid,
    "op8_neighbours": op8_neighbours,
    "op9_simhash": op9_simhash,
    "op10_url_filter": op10_url_filter,
    "op11_periodic": op11_periodic,
    "op12_toxicity": op12_toxicity,
    "op13_importance": op13_importance,
}

ORACLE_SQL: dict[str, str] = {
    "op4_substring": substring.REPEATS_SQL,
    "op8_neighbours": neighbours.NEAREST_SQL,
    "op10_url_filter": urlfilter.judge_sql(),
    "op13_importance": importance.RESAMPLE_SQL,
}
