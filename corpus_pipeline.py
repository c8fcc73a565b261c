"""Corpus pipeline: language ID, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and gives the documents it keeps, with the columns of
``documents``; the last one gives a row for each packed piece.  Stages are written as Parquet and
read again, so each one works on all that its predecessor kept.

* language ID: the model learns from the documents with a non-null lang; documents that it
  rejects go (null texts, texts without a letter, and a narrow margin).
* near duplicates: five words, similarity 0.8 or more; the document with the smallest id of each
  group stays, and one row of an id.  Rows with a null id stay.
* decontamination: documents that hold 80 % of a benchmark item's words in runs of five or more go.
* secrets: reported spans are replaced in the text, and n_chars is set anew where it changes.
* packing: sequences of 2048 ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, langid, neardup, packing, secrets, shared

TOKENIZER = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = neardup.groups(docs, width=5, percent=80).filter("kept and doc_id is not null").select("doc_id").distinct()
    out = docs.join(kept, "doc_id", "left_semi")
    again = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    again = shared.written(again, "repeated-ids")
    if again.take(1):  # rows that share an id are one group: the one with the smallest text stays
        several = out.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("row"))
        out = out.join(again, "doc_id", "left_anti").unionByName(several.select("row.*"))
    return out.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redact(docs, flag="_changed")
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.when(F.col("_changed"), length).otherwise(F.col("n_chars"))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pieces(docs, public_tokenizers.path(TOKENIZER))
    return packing.pack(shared.written(pieces, "pieces"))


STAGES = [
    ("language ID", language_id),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: Most stages can't be told in SQL; tests/llm holds the whole pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
