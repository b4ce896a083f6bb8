"""Block primitives against plain loops, with blocks small enough to be crossed."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from storyspark.operators.ordered import Blocks, label_runs, number_rows


def _rows(seed=3, n=300):
    rng = random.Random(seed)
    return [(rng.choice("aaab"), rng.randrange(40), i, rng.choice(["x", "x", "y", ""])) for i in range(n)]


def test_number_rows_hot_key(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "script_id string, ts long, event_id long, v string")
    want = {}
    for k in "ab":
        for pos, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))):
            want[r[2]] = pos
    for size in (None, 7):
        got = number_rows(df, "script_id", ["ts", "event_id"], block_rows=size)
        assert {r.event_id: r.idx for r in got.collect()} == want


def test_neighbours_and_scan_cross_blocks(spark):
    rows = [("a", i, i * 7 % 11) for i in range(50)] + [("b", i, i) for i in range(3)]
    df = spark.createDataFrame(rows, "script_id string, idx long, x long")
    b = Blocks.dense(df, block_rows=4).neighbours(p2=("x", -2), n1=("x", 1))
    b = b.scan(running={"s": ("sum", "x"), "m": ("max", "x", "before"), "l": ("last", F.when(F.col("x") > 5, F.col("idx")))},
               totals={"n": ("count", F.lit(1)), "f": ("first", "x")})
    for r in b.df.collect():
        seq = [x for k, _, x in rows if k == r.script_id]
        i = r.idx
        assert r.p2 == (seq[i - 2] if i >= 2 else None)
        assert r.n1 == (seq[i + 1] if i + 1 < len(seq) else None)
        assert r.s == sum(seq[: i + 1]) and r.m == (max(seq[:i]) if i else None)
        assert r.l == max([j for j in range(i + 1) if seq[j] > 5], default=None)
        assert r.n == len(seq) and r.f == seq[0]


def test_runs_same_in_both_plans(spark):
    rows = _rows(5)
    df = spark.createDataFrame(rows, "script_id string, ts long, event_id long, v string")
    numbered = number_rows(df, "script_id", ["ts", "event_id"])
    one = {(r.script_id, r.idx): r.run_start for r in label_runs(numbered, "v").collect()}
    cut = {(r.script_id, r.idx): r.run_start for r in label_runs(numbered, "v", block_rows=5).collect()}
    assert one == cut


INF, NAN = float("inf"), float("nan")


@pytest.mark.parametrize("kind, values", [
    ("double", [i / 12 for i in range(12)] + [1e5, 1e12]),
    ("double", [None, -INF, -1e308, 0.0, 1e-300, 2e-300, 1e308, INF, NAN, NAN] + [5.0] * 12),
    ("long", [-(2**63), 2**63 - 1, 2**53, 2**53 + 1, 2**53 + 2, 2**53 + 3, 0] + [7] * 15),
    ("string", ["", "a", "a", "ab", "abc", "abd", "abcd", "b", "\U0001f600", "\uffee", None] + ["prefix" + str(i) for i in range(14)]),
    ("timestamp", [datetime.datetime(2020, 1, 1, 0, 0, 0, i) for i in range(12)] + [datetime.datetime(2999, 1, 1), datetime.datetime(1900, 1, 1), None]),
    ("date", [datetime.date(2020, 1, 1 + i % 3) for i in range(20)] + [datetime.date(9999, 1, 1)]),
    ("int", [3] * 30),
])
def test_uneven_order_values_number_like_a_plain_window(spark, kind, values):
    rng = random.Random(1)
    rows = [("k", v, rng.randrange(5), -i) for i, v in enumerate(values)] + [("other", values[0], 0, 0), (None, values[0], 0, 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, f"script_id string, x {kind}, y int, z int")
    by = ["x", "y", "z"]
    plain = df.withColumn("want", F.row_number().over(Window.partitionBy("script_id").orderBy(*by)) - 1)
    for size in (4,):
        b = Blocks.adaptive(df, "script_id", by, size)
        fullest = b.raw.groupBy("script_id", "_blk").count().agg(F.max("count")).first()[0]
        assert fullest <= size  # z tells all rows apart
        got = {(r.script_id, r.z): r.idx for r in number_rows(df, "script_id", by, block_rows=size).collect()}
        assert got == {(r.script_id, r.z): r.want for r in plain.collect()}


def test_equal_rows_end_the_cutting(spark):
    df = spark.createDataFrame([("k", 1.0, 1)] * 20 + [("k", 2.0, 1)] * 3, "script_id string, x double, y int")
    got = number_rows(df, "script_id", ["x", "y"], block_rows=4).collect()
    assert sorted(r.idx for r in got) == list(range(23)) and {r.x for r in got if r.idx >= 20} == {2.0}
