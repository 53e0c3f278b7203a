"""The corpus pipeline: documents pass five stages, each an operator of tessera.llm, and leave as token ids.

Every stage works on all that the one before kept. Rows with a null text keep it until the last stage, which gives them null ids;
an empty table stays empty. Only the columns of documents are read and kept, whatever else an input has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import small, stage
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.mix import mix_sources, repeated
from tessera.llm.ngram_join import near_duplicates
from tessera.llm.quality import fit_quality, predicted, score_quality
from tessera.llm.sentencepiece_codec import encode_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from labels, does not reject."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model, COLUMNS).where(predicted() == 1).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many sources carry; a document of which no other line is left goes."""
    out = dedup_lines(docs)
    return out.where((F.col("n_removed") == 0) | (F.trim("text") != "")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest doc_id, of repeated rows one. Rows without an id or without
    words stay; texts under one doc_id are told apart by their hash."""
    docs = docs.select(*COLUMNS)
    found = stage(near_duplicates(docs), "found")
    key, text = F.col("doc_id").eqNullSafe(F.col("_id")), F.xxhash64("text") == F.col("_th")
    gone = stage(found.where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th")).distinct(), "copies")
    left = docs.join(small(gone, gone.count()), key & text, "left_anti")
    again = found.where("kept and doc_id is not null and n_shingles > 0").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th")).count().where("count > 1")
    again = stage(again.select("_id", "_th"), "repeated")
    n = again.count()
    if not n:
        return left
    once = left.join(small(again, n), key & text).groupBy("_id", "_th").agg(F.min(F.struct(*COLUMNS)).alias("d")).select("d.*")
    return left.join(small(again, n), key & text, "left_anti").unionByName(once)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it."""
    return repeated(mix_sources(docs)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_documents(docs, ("doc_id", "lang", "source")).withColumn("n_ids", F.size("ids").cast("long"))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("tokens", tokens)]

#: A learned score, a random draw within a source and a Viterbi search: not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
