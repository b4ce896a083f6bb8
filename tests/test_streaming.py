"""Keyed tables and keyed state: late, shuffled and repeated input."""

import random
import time

import pytest
from pyspark.sql import functions as F

from storyspark.operators import audit
from storyspark.operators.ordered import number_rows
from storyspark.streaming import jobs as streaming
from storyspark.streaming.tables import BucketTable

COLUMNS = "script_id string, at long, seq long, character string, arc string"


def dims():
    return {"character": F.col("character"), "arc": F.col("arc")}


def beats(n=60):
    return [(f"s{i % 3}", 1_000 + i // 2 * 10, i, ["x", "y", None][i % 7 % 3], ["p", "q"][i % 5 == 0]) for i in range(n)]


def feed(spark, rows, folder, files):
    size = -(-len(rows) // files)
    for n in range(files):
        part = rows[n * size:(n + 1) * size]
        spark.createDataFrame(part, COLUMNS).withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)  # files are taken in order of their time


def batch_scores(spark, rows):
    df = number_rows(spark.createDataFrame(rows, COLUMNS), "script_id", ["at", "seq"])
    return sorted((r.script_id, r.seq, r.idx, r.repetition_score, r.rejected) for r in audit.diversity_scores(df, dims()).collect())


def streamed(spark, folder, job, **kw):
    stream = streaming.read_table_stream(spark, folder, "", 1)
    return streaming.score_new_beats(stream, job, ["ts", "seq"], dims=dims(), **kw)


@pytest.mark.parametrize("order", ["in order", "shuffled"])
def test_streamed_scores_equal_batch(spark, tmp_path, order):
    rows = beats()
    arriving = list(rows)
    if order == "shuffled":
        random.Random(2).shuffle(arriving)
    feed(spark, arriving, str(tmp_path / "in"), 5)
    got = streamed(spark, str(tmp_path / "in"), str(tmp_path / "job"), delay="1 day")
    assert sorted((r.script_id, r.seq, r.idx, r.repetition_score, r.rejected) for r in got.collect()) == batch_scores(spark, rows)


def test_settled_rows_leave_the_state_and_late_ones_are_dropped(spark, tmp_path):
    rows = beats()
    late = [("s0", 1_000, 99, "x", "p")]  # far behind the watermark when it comes
    feed(spark, rows, str(tmp_path / "in"), 5)
    first = streamed(spark, str(tmp_path / "in"), str(tmp_path / "job"), delay="30 seconds")
    assert sorted((r.script_id, r.seq, r.idx, r.repetition_score, r.rejected) for r in first.collect()) == batch_scores(spark, rows)
    states = spark.read.format("statestore").option("stateVarName", "open").load(str(tmp_path / "job/checkpoint"))
    assert 0 < states.count() < 15  # rows within the delay, of 60
    feed(spark, late, str(tmp_path / "in"), 1)
    again = streamed(spark, str(tmp_path / "in"), str(tmp_path / "job"), delay="30 seconds")
    assert sorted((r.script_id, r.seq, r.idx, r.repetition_score, r.rejected) for r in again.collect()) == batch_scores(spark, rows)


def test_a_batch_writes_only_what_it_moves(spark, tmp_path):
    rows = beats()
    feed(spark, rows, str(tmp_path / "in"), 1)
    streamed(spark, str(tmp_path / "in"), str(tmp_path / "job"))
    more = [("s1", 5_000, 100, "x", "p"), ("s1", 1_000 + 28 * 10, 101, "x", "p")]  # one at the end, one late
    feed(spark, more, str(tmp_path / "in"), 1)
    got = streamed(spark, str(tmp_path / "in"), str(tmp_path / "job"))
    assert sorted((r.script_id, r.seq, r.idx, r.repetition_score, r.rejected) for r in got.collect()) == batch_scores(spark, rows + more)
    new = got.filter("batch > 0").collect()
    moved = {r[2] for r in [*rows, *more] if r[0] == "s1" and (r[1], r[2]) >= (1_280, 101)} | {101}
    assert {r.script_id for r in new} == {"s1"} and {r.seq for r in new} == moved


def test_forgotten_scripts_start_again(spark, tmp_path):
    feed(spark, [("a", 1_000, 1, "x", "p"), ("a", 1_001, 2, "x", "p")], str(tmp_path / "in"), 1)
    kw = {"delay": "10 seconds", "forget": "1 minute"}
    streamed(spark, str(tmp_path / "in"), str(tmp_path / "job"), **kw)
    for at in (5_000, 6_000):  # the watermark passes, then the timer
        feed(spark, [("b", at, at, "x", "p")], str(tmp_path / "in"), 1)
        streamed(spark, str(tmp_path / "in"), str(tmp_path / "job"), **kw)
    feed(spark, [("a", 7_000, 3, "x", "p")], str(tmp_path / "in"), 1)
    got = {r.seq: (r.idx, r.repetition_score) for r in streamed(spark, str(tmp_path / "in"), str(tmp_path / "job"), **kw).filter("script_id = 'a'").collect()}
    assert got[3] == (0, 0.0) and got[2][0] == 1


def events(spark, rows):
    return spark.createDataFrame(rows, "script_id string, asset_id string, ts timestamp")


def test_bucket_table_is_idempotent_and_reads_touched_buckets_only(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ["k"], 4)
    merge = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    frame = lambda rows: spark.createDataFrame(rows, "k string, n long")
    read = lambda: {r.k: r.n for r in table.read(frame([]).schema).collect()}
    assert read() == {}
    table.upsert(frame([(f"k{i}", 1) for i in range(20)]), 0, merge)
    table.upsert(frame([("k1", 5), (None, 2)]), 1, merge)
    want = {**{f"k{i}": 1 for i in range(20)}, "k1": 6, None: 2}
    assert read() == want
    table.upsert(frame([("k1", 5), (None, 2)]), 1, merge)  # run again
    assert read() == want
    written = {p.name for p in (tmp_path / "t/data/version=1").iterdir() if p.name.startswith("bucket=")}
    assert 1 <= len(written) <= 2  # the buckets of two keys
    table.upsert(frame([]), 2, merge)
    for n in range(3, 9):
        table.upsert(frame([(f"k{i}", 1) for i in range(20)]), n, merge)
    assert read() == {k: (v if k is None else v + 6) for k, v in want.items()}
    assert len(list((tmp_path / "t/manifest").glob("batch=*"))) <= 2
    assert sum(1 for p in (tmp_path / "t/data").glob("*/bucket=*")) <= 8  # the newest version of each bucket, and the one before


def test_memory_and_status_follow_batches(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = [(f"s{i % 2}", f"a{i % 5}", i) for i in range(40)]
    random.Random(1).shuffle(rows)
    for n in range(4):
        spark.createDataFrame(rows[n * 10:(n + 1) * 10], "script_id string, asset_id string, t long").withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    stream = streaming.read_table_stream(spark, str(tmp_path / "in"), "", 1)
    got = {(r.script_id, r.asset_id): (r.f, r.l, r.times_used) for r in streaming.asset_memory(stream, str(tmp_path / "m")).selectExpr(
        "script_id", "asset_id", "unix_seconds(first_seen) f", "unix_seconds(last_seen) l", "times_used").collect()}
    want = {}
    for s, a, t in rows:
        f, last, n = want.get((s, a), (t, t, 0))
        want[s, a] = (min(f, t), max(last, t), n + 1)
    assert got == want
    named = stream.select(F.col("script_id").alias("session_id"), F.col("asset_id").alias("stage"), F.lit("ok").alias("status"), "ts", F.col("t").alias("seq"))
    status = {r.session_id: r.stage for r in streaming.session_status(named, str(tmp_path / "s")).collect()}
    newest = {s: max((t, a) for s2, a, t in rows if s2 == s)[1] for s in ("s0", "s1")}
    assert status == newest
