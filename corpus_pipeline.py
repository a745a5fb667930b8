"""Corpus pipeline: each stage takes what the stage before it kept and returns the columns of documents, but for the last, which packs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnspark.llm import langid, minhash, packing, substrings, toxicity
from firnspark.llm.common import materialize, read, settle


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject. Null and empty texts are judged as any other."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"), cut=0.7, most=12_000)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known. The least score comes from all labelled documents that the model has not learned from: about one in
    200 of those that it names rightly scores lower, so as many clean documents go.
    Texts without a letter, null ones among them, go."""
    settle(spark)
    return langid.in_known_language(docs, most=1500)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id. Of rows with one id and one text the one with the
    smallest other columns stays; different texts under one id are one document and go or stay together. Rows without an id stay."""
    settle(spark)
    groups = minhash.near_duplicates(docs, size=5, percent=80).where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("rows"))
    groups = materialize(groups.where("not kept or rows > 1"), "not_alone")
    alone = docs.join(groups, "doc_id", "left_anti")
    again = docs.join(groups.where("kept").select("doc_id"), "doc_id", "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = F.min(F.struct(*rest) if rest else F.lit(1)).alias("first")
    once = again.groupBy("doc_id", "text").agg(first).select(*[F.col(f"first.`{c}`").alias(c) if c in rest else F.col(c) for c in docs.columns])
    return alone.unionByName(once)


def substring_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has too; one of which nothing is left goes. Null texts stay."""
    settle(spark)
    return substrings.without_passages(docs, substrings.shared_passages(docs, least=45))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, a row for each piece. A null text has the end token alone; repeated rows are packed as often."""
    settle(spark)
    return packing.pack_best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, capacity=2048, end_id=0)


STAGES = [("toxicity", toxic), ("language", language), ("near_duplicates", near_duplicates), ("substring_duplicates", substring_duplicates), ("packing", packed)]
#: Classifiers and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again. An empty table gives no rows."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return materialize(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
