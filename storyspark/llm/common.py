"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyspark.session import shared_folder

#: The white space that separates words: space and U+0009 to U+000D (what ``bytes.split`` takes).
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table of its own in the shared folder: packed, unlike a checkpoint, and of a size that Spark knows."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hash_sample(df: DataFrame, rows: int, by: Sequence[str | Column]) -> DataFrame:
    """At most ``rows`` rows, those with the least hash of ``by``: the same rows in every run and partitioning."""
    return df.orderBy(F.xxhash64(*by), *by).limit(rows)


def class_labels(labels: DataFrame, target: str) -> DataFrame:
    """(doc_id, label): one 0/1 label per document; repeated rows count once and the lower label wins."""
    known = labels.select(F.col("doc_id"), F.col(target).cast("int").alias("label"))
    return known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"))


def struct_type(spec: str) -> T.StructType:
    """Schema from ``"name type, ..."``."""
    return T.StructType.fromDDL(spec)
