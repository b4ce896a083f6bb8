"""Corpus pipeline: quality rules, quality classifier, line dedup, MinHash near-dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; the rows are
written as Parquet in the shared folder and read again between stages.  All stages but the last
return the columns of their input.

In every stage a null text counts as empty, rows that repeat an id or another row are documents
like others, an empty table gives an empty one, other columns come along as they are, and a text of any
length is read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyspark.llm import bag_minhash, bin_slack, byte_cnn, line_templates, quality_forest
from storyspark.llm.common import table
from storyspark.session import shared_folder

import public_tokenizers  # isort: skip  (after the subpackage, whose absence the entry file allows for)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the forest; the forest is grown on labelled rows of the corpus.

    An empty or null text has under 20 words and goes; equal texts are judged alike.
    """
    forest = quality_forest.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_forest.passing(docs, forest)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores 0.5 or more; it learns from labelled rows of the whole corpus,
    since the rules have left few bad ones here.  Without labels of both classes it scores 0.5 and all stay."""
    net = byte_cnn.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return byte_cnn.passing(docs, net)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose template an earlier one has; ``n_chars`` follows the text.

    Earlier is the smaller id (null ids last, then by text); a null text stays null, a text of dropped lines becomes empty.
    """
    cut = line_templates.drop_recurring(docs)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else cut


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the smallest id (null ids last); those left without a word are one class."""
    return bag_minhash.distinct_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 1024 tokens; an empty or null text is its end token alone."""
    return bin_slack.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("packing", packing)]
ORACLE_SQL = None  # the fitted stages have no SQL; tests/llm compares the run with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the documents of ``sf_dir``."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
