"""Session helpers: sensible defaults, and reliable lineage cuts."""

from __future__ import annotations

import functools
import os
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def build_session(app: str = "storyspark", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the operators expect (UTC, AQE on)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the workers of ``spark`` this package, so that tasks can import it wherever they run; once per application."""
    _shipped(spark.sparkContext.applicationId, spark)
    return spark


@functools.lru_cache(maxsize=4)
def _shipped(application: str, spark: SparkSession) -> None:
    home = pathlib.Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="storyspark-"), "storyspark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as packed:
        for file in sorted(home.rglob("*.py")):
            packed.write(file, file.relative_to(home.parent))
    spark.sparkContext.addPyFile(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder the cluster names.

    The folder comes from ``spark.checkpoint.dir``.  Only a session on a local master may leave
    it unset (tests): it gets a folder of its own.  Elsewhere executors could not read such a
    folder, so a missing setting is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def packed(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: a fraction of a checkpoint, whose rows are not packed; its place in partitions is not kept.

    What Parquet cannot hold (columns without a type, intervals, names that differ in case only) becomes a checkpoint.
    """
    def holds(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return len({f.name.lower() for f in kind}) == len(kind) and all(holds(f.dataType) for f in kind)
        if isinstance(kind, T.MapType):
            return holds(kind.keyType) and holds(kind.valueType)
        return holds(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.NullType, T.CalendarIntervalType, T.VariantType))

    if not df.columns or not holds(df.schema):
        return cut_lineage(df)
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/packed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``, or a temporary one on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="storyspark-shared-", dir=os.environ.get("TMPDIR"))
