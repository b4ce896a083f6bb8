"""Incremental forms of three batch operators, as Structured Streaming jobs.

Memory and status are keyed tables that each micro-batch updates in place.  Scoring keeps its look-back
in the state store, so rows may arrive late and out of order within the watermark.  Every batch
replaces its own output when it is run again after a lost executor or driver.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from storyspark.operators.audit import repetition_columns
from storyspark.session import shared_folder
from storyspark.streaming.tables import BucketTable

STORE = "spark.sql.streaming.stateStore.providerClass"
NUMBERED = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "last_us")])
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def job_folder(spark: SparkSession, name: str) -> str:
    """Folder for a job's checkpoint and output, below the shared checkpoint folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table's parquet files as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema if name else spark.read.parquet(folder).schema
    reader = spark.readStream.schema(schema)
    if name:
        reader = reader.option("pathGlobFilter", f"{name}.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def drain(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Give all available input to ``write``, batch by batch; a later call with the same folder goes on where this one ended."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()


# ---- R1, R3: keyed tables --------------------------------------------------------------------------

def _upserted(stream: DataFrame, folder: str, keys: list[str], shape: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame],
              buckets: int) -> DataFrame:
    """Rows of each key after all available input.  A batch is aggregated on its own before it meets the stored rows of its buckets."""
    table = BucketTable(stream.sparkSession, f"{folder}/table", keys, buckets)
    drain(stream, folder, lambda batch, number: table.upsert(shape(batch), number, merge))
    return table.read(shape(stream).schema)


def asset_memory(stream: DataFrame, folder: str, asset: str = "asset_id", key: str = "script_id", at: str = "ts", buckets: int = 16) -> DataFrame:
    """R1: first seen, last seen and uses per asset; memory of an asset never expires, and late rows count whenever they come."""
    shape = lambda df: df.groupBy(key, asset).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("times_used"))
    merge = lambda df: df.groupBy(key, asset).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("times_used").alias("times_used"))
    return _upserted(stream, folder, [key, asset], shape, merge, buckets)


def session_status(stream: DataFrame, folder: str, session: str = "session_id", at: str = "ts", tie: str = "seq", buckets: int = 16) -> DataFrame:
    """R3: newest stage and status per session, with the time and number that made it the newest."""
    newest = lambda df: df.groupBy(session).agg(F.max_by(F.struct("stage", "status", at, tie), F.struct(at, tie)).alias("s")).select(session, "s.*")
    return _upserted(stream, folder, [session], newest, newest, buckets)


# ---- R2: keyed state ---------------------------------------------------------------------------------

class LookbackProcessor(StatefulProcessor):
    """Numbers the rows of a key in event order and gives each the values of the rows before it.

    ``open`` holds the rows that a late one may still precede, ``settled`` the last ones before them and
    ``numbered`` how many have settled.  A new row moves those after it: all from the first new
    one on are given out again.  Rows settle as the watermark passes them, in the batch that
    brings the key's next rows or by a timer.  A key whose last row lies ``forget_us`` behind the
    watermark is forgotten; it would start again from 0.
    """

    def __init__(self, key: str, order: list[str], values: list[str], lookback: int, row: T.StructType, forget_us: int | None):
        self.key, self.order, self.values, self.lookback, self.row, self.forget_us = key, order, values, lookback, row, forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", self.row)
        self.settled = handle.getListState("settled", self.row)
        self.numbered = handle.getValueState("numbered", NUMBERED)

    def _rank(self, row: tuple) -> tuple:
        """Place in event order; nulls come first."""
        return tuple((v is not None, v) for v in row[:len(self.order)])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [*self.order, *self.values]
        new = [tuple(None if v is None or v is pd.NA or v != v else v for v in r)
               for pdf in rows for r in pdf[names].astype(object).itertuples(index=False, name=None)]
        held = [tuple(r) for r in self.open.get()]
        came = [self._rank(r) for r in new]
        ranked = sorted(zip([*map(self._rank, held), *came], [*held, *new]), key=itemgetter(0))
        start = bisect_left(ranked, min(came), key=itemgetter(0))
        every = [r for _, r in ranked]
        tail = [tuple(r) for r in self.settled.get()]
        n, last = self.numbered.get() if self.numbered.exists() else (0, 0)
        line = [*tail, *every]
        out = []
        for i in range(start, len(every)):
            at = len(tail) + i
            back = [line[at - k][len(self.order):] if at >= k else (None,) * len(self.values) for k in range(1, self.lookback + 1)]
            out.append((*key, *every[i][:len(self.order)], n + i, *every[i][len(self.order):], *(b[v] for v in range(len(self.values)) for b in back)))
        self._settle(tail, every, n, max(last, max(r[0] for r in new)), timerValues)
        columns = [self.key, *self.order, "idx", *self.values, *(f"{v}_{k}" for v in self.values for k in range(1, self.lookback + 1))]
        yield pd.DataFrame(out, columns=columns)

    def _settle(self, tail: list[tuple], every: list[tuple], n: int, last: int, timer_values) -> None:
        passed = timer_values.getCurrentWatermarkInMs() * 1000
        done = sum(1 for r in every if r[0] <= passed)
        if self.forget_us is not None and done == len(every) and last + self.forget_us <= passed:
            for state in (self.open, self.settled, self.numbered):
                state.clear()
            return
        for state, rows in ((self.settled, [*tail, *every[:done]][-self.lookback:]), (self.open, every[done:])):
            state.put(rows) if rows else state.clear()
        self.numbered.update((n + done, last))
        if done < len(every):
            self.handle.registerTimer(every[-1][0] // 1000 + 1)
        elif self.forget_us is not None:
            self.handle.registerTimer((last + self.forget_us) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.numbered.exists():
            n, last = self.numbered.get()
            self._settle([tuple(r) for r in self.settled.get()], [tuple(r) for r in self.open.get()], n, last, timerValues)
        return iter([])

    def close(self) -> None:
        pass


def lookback_stream(stream: DataFrame, dims: dict[str, Column], order_by: list[str], lookback: int = 3, key: str = "script_id", delay: str = "1 day",
                    forget: str | None = None) -> DataFrame:
    """(key, order, idx, d_<dim>, d_<dim>_1 ...) of new rows and of those that they move; ``order_by`` starts with the event time, whose rows are told
    apart by the other columns.  Rows later than ``delay`` are dropped."""
    at, *rest = order_by
    values = [f"d_{d}" for d in dims]
    slim = stream.withWatermark(at, delay).select(key, at, F.unix_micros(at).alias("at_us"), *rest, *[c.cast("string").alias(f"d_{d}") for d, c in dims.items()])
    kind = {f.name: f.dataType for f in slim.schema}
    row = T.StructType([T.StructField(c, kind[c]) for c in ("at_us", *rest, *values)])
    out = T.StructType([T.StructField(c, kind[c]) for c in (key, "at_us", *rest)] + [T.StructField("idx", T.LongType())]
                       + [T.StructField(c, T.StringType()) for c in (*values, *(f"{v}_{k}" for v in values for k in range(1, lookback + 1)))])
    quiet = None if forget is None else int(pd.Timedelta(forget).total_seconds() * 1_000_000)
    return slim.groupBy(key).transformWithStateInPandas(
        LookbackProcessor(key, ["at_us", *rest], values, lookback, row, quiet), outputStructType=out, outputMode="Update", timeMode="EventTime")


def score_new_beats(stream: DataFrame, folder: str, order_by: list[str], lookback: int = 3, key: str = "script_id", dims: dict[str, Column] | None = None,
                    delay: str = "1 day", forget: str | None = None, **kw) -> DataFrame:
    """R2: repetition score of arriving beats against the ``lookback`` beats before them in event order.

    Returns the newest version of each row.  Rows may come in any order within ``delay``; a row that comes
    between others gives them new numbers and scores, and only those are written again.  A batch
    reads and writes the state of its own scripts.  The score is the batch operator's expression.
    """
    dims = dims or {"character": F.col("character"), "arc": F.col("arc"), "emotion": F.col("emotion")}
    spark = stream.sparkSession
    found = lookback_stream(stream, dims, order_by, lookback, key, delay, forget)
    back = {d: [F.col(f"d_{d}_{k}") for k in range(1, lookback + 1)] for d in dims}
    scored = repetition_columns(found, back, **kw).select(key, "at_us", *order_by[1:], "idx", "repetition_score", "rejected")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        drain(scored, folder, write, "update")
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    versions = spark.read.option("basePath", f"{folder}/out").schema(T.StructType([*scored.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/out")
    newest = Window.partitionBy(key, "at_us", *order_by[1:]).orderBy(F.desc("batch"))
    return versions.withColumn("_v", F.row_number().over(newest)).filter("_v = 1").drop("_v").withColumnRenamed("at_us", f"{order_by[0]}_us")
