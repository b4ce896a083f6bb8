"""A keyed table that streaming jobs update in place: hash buckets, replaced one by one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BucketTable:
    """Rows by key in ``buckets`` hash buckets below ``folder``.

    A batch writes new versions of the buckets that its keys fall into, in a folder of its own, and
    then a manifest that names the newest version of every bucket.  It reads nothing but those
    buckets as the manifest before it lists them, so a batch that is run again replaces its own
    output and finds the same input.  Two manifests and the versions they name are kept.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = 16):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), keys, buckets

    def _path(self, *parts: object):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *map(str, parts)]))

    def _files(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> dict[int, dict[int, int]]:
        """Versions of the buckets, by the batch that wrote the manifest; a manifest has one row a bucket at most."""
        if not self._files(path := self._path("manifest")).exists(path):
            return {}
        out: dict[int, dict[int, int]] = {}
        schema = T.StructType.fromDDL("bucket int, version long, batch long")
        for bucket, version, batch in self.spark.read.schema(schema).parquet(f"{self.folder}/manifest").collect():
            out.setdefault(batch, {})[bucket] = version
        return out

    def _stored(self, versions: dict[int, int], schema: T.StructType) -> DataFrame:
        paths = [f"{self.folder}/data/version={v}/bucket={b}" for b, v in versions.items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def upsert(self, rows: DataFrame, number: int, merge: Callable[[DataFrame], DataFrame]) -> None:
        """Fold the rows of batch ``number`` in: ``merge`` turns stored and new rows of a key into its new rows (of the same columns)."""
        placed = rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")).persist()
        try:
            touched = [r["bucket"] for r in placed.select("bucket").distinct().collect()]
            manifests = {n: m for n, m in self._manifests().items() if n < number}
            before = manifests[max(manifests)] if manifests else {}
            new = placed.drop("bucket")
            stored = self._stored({b: before[b] for b in touched if b in before}, rows.schema)
            merged = merge(stored.unionByName(new)).withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
            if touched:
                merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/version={number}")
            now = {**before, **dict.fromkeys(touched, number)}
            self.spark.createDataFrame(list(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(
                f"{self.folder}/manifest/batch={number}")
            self._forget(manifests, before)
        finally:
            placed.unpersist()

    def _forget(self, manifests: dict[int, dict[int, int]], before: dict[int, int]) -> None:
        """Drop the manifests older than the last one, and the versions that only they name."""
        for batch in sorted(manifests)[:-1]:
            for bucket, version in manifests[batch].items():
                if before.get(bucket) != version:
                    path = self._path("data", f"version={version}", f"bucket={bucket}")
                    self._files(path).delete(path, True)
            path = self._path("manifest", f"batch={batch}")
            self._files(path).delete(path, True)

    def read(self, schema: T.StructType) -> DataFrame:
        """All rows, each key as its last batch left it."""
        manifests = self._manifests()
        return self._stored(manifests[max(manifests)] if manifests else {}, schema)
