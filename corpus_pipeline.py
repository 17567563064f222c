"""From raw documents to packed token sequences: language, near duplicates, repeated passages, mix, packing.

Every stage takes all rows that the one before it kept, as a written table, and all but the last return the
columns of documents. Stages do not swallow errors; null, empty or repeated rows are treated as each
operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telesift.llm.common import table, written
from telesift.llm.langid import UNKNOWN, identify
from telesift.llm.mixing import mix_sources
from telesift.llm.neardup import linked_rows, text_key
from telesift.llm.packing import pack_documents
from telesift.llm.substrings import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.5
# The rows of run() come from a fitted model, an iterative solver and a tokenizer: no SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach, with that language; those without a letter or in doubt go."""
    named = identify(docs.select(COLUMNS), docs.select("doc_id", "lang", "text"))
    kept = named.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, of the smallest doc_id; texts of one doc_id that are not alike all stay, one text of one
    doc_id stays once, a null doc_id has no group."""
    kept = linked_rows(docs).filter("head and doc_id is not null").select("doc_id", "text_key").distinct()
    docs = docs.select(COLUMNS)
    rows = docs.withColumn("text_key", text_key()).join(kept, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    return rows.select(COLUMNS).union(docs.filter("doc_id is null"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; a document of nothing else goes."""
    rows = remove_repeats(docs.select(COLUMNS))
    rows = rows.filter("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    return rows.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    mixed = mix_sources(docs.select(COLUMNS)).filter("copies > 0")
    return mixed.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 2048 ids."""
    return pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
