"""Connected components by repeated contraction along random priorities."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyspark.session import cut_lineage, shared_folder


class _Tables:
    """Tables in a folder of their own below the shared one.

    A checkpoint keeps the size that Spark estimated for it, and estimates multiply from join to
    join: in a loop they become numbers of millions of digits.  A written table is measured anew.
    """

    def __init__(self, spark):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/contract-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def contract(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): nodes share a root if and only if edges connect them.

    In each round every node points to the neighbour, or itself, of least random priority (a hash
    that changes with the round); edges are then drawn between the targets, and loops and copies
    fall away.  A constant share of the nodes is expected to vanish per round.  Every step is a
    minimum per node or a join with one row per node, so a node that a third of the edges touch is
    pre-aggregated or split.  Edge tables are written to the shared folder and dropped at the end;
    none reaches the driver.
    """
    tables = _Tables(edges.sparkSession)
    live = tables.keep(edges.select("a", "b").where("a <> b").distinct())
    maps = []
    while not live.isEmpty():
        if len(maps) == rounds:
            raise RuntimeError("contraction did not end")
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), c).alias("rank"), F.col(c).alias("node"))  # noqa: B023, E731
        least = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        to = tables.keep(least.select(F.col("a").alias("node"), F.least(rank("a"), F.col("best"))["node"].alias("to")))
        maps.append(to)
        moved = live.join(to.withColumnsRenamed({"node": "a", "to": "ra"}), "a").join(to.withColumnsRenamed({"node": "b", "to": "rb"}), "b")
        live = tables.keep(moved.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not maps:
        tables.drop()
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    # what a round merged follows what became of its target in the later ones
    out = maps[-1].withColumnRenamed("to", "root")
    for earlier in reversed(maps[:-1]):
        later = out.withColumnsRenamed({"node": "to", "root": "later"})
        out = earlier.join(later, "to", "left").select("node", F.coalesce("later", "to").alias("root"))
    out = cut_lineage(out)
    tables.drop()
    return out
