"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from telesift.llm import align, bpe, chat, embeddings, langid, mixing, neardup, packing, pages, scoring, substrings, topk, whitening
from telesift.llm.common import table
from telesift.llm.sql import ORACLE


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digest(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_digest(table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(chat.prefix_targets(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_digest(table(spark, sf_dir, "documents"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_digest(table(spark, sf_dir, "embeddings"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link_documents(table(spark, sf_dir, "documents"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_digest(table(spark, sf_dir, "documents"))


def op8_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_digest(table(spark, sf_dir, "pages"))


def op9_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scoring_digest(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk_digest(table(spark, sf_dir, "embeddings"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digest(table(spark, sf_dir, "documents"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment_digest(table(spark, sf_dir, "documents"))


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_digest(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_pack": op1_pack, "op2_language": op2_language, "op3_chat": op3_chat, "op4_substrings": op4_substrings, "op5_embeddings": op5_embeddings, "op6_neardup": op6_neardup, "op7_mix": op7_mix, "op8_pages": op8_pages, "op9_score": op9_score, "op10_topk": op10_topk, "op11_bpe": op11_bpe, "op12_align": op12_align, "op13_whiten": op13_whiten}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
