"""Training-corpus pipeline over ``documents``: five stages, each written as Parquet and read again.

All stages but the last return the columns of ``documents``, whatever further
columns there are, take an empty table to an empty one, and judge rows that
repeat an id and text alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadspan.llm import bpe, decontam, langid, ngram_join, toxicity
from roadspan.llm._scratch import unused, written
from roadspan.ship import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those with a null or empty text or without any letter go. Null ids and languages are kept, and not learned from."""
    return langid.identify(docs).where(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose highest window scores below 0.5; null texts, null ids and unlabelled ones are judged as any other. Without labels of both kinds nothing goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.assess(docs, labels).where("toxicity < 0.5").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies; of rows with one id the first by text. Rows with a null id stay."""
    groups = written(ngram_join.jaccard_components(docs), "groups")
    firsts = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n_rows"))
    once = docs.join(firsts.where("n_rows = 1").select("doc_id"), "doc_id", "left_semi")
    order, at = Window.partitionBy("doc_id").orderBy("text"), unused(docs.columns, "place")
    again = docs.join(firsts.where("n_rows > 1").select("doc_id"), "doc_id", "left_semi").withColumn(at, F.row_number().over(order)).where(F.col(at) == 1).drop(at)
    return once.union(again).union(docs.where("doc_id is null")).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none. A null id is an id as any other."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of token ids and decoded text, one row per row; a null text is encoded as the empty one."""
    return bpe.digests(docs, bpe.default_path(spark))


STAGES = [
    (name, lambda spark, docs, sf_dir, f=f: f(ship(spark), docs, sf_dir))
    for name, f in (("language ID", language_id), ("toxicity", not_toxic), ("n-gram Jaccard join", one_of_each_group), ("benchmark decontamination", without_benchmark), ("BPE encoding and decoding", encoded))
]
#: Language ID, toxicity and BPE have no SQL form; tests hold the stages against plain versions of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
