"""Sequential folds over ordered sequences, without one task per long sequence.

Some rules depend on the whole history of a sequence (a greedy choice, a no-repeat rule).
The fold itself is a small Python step on a small state.  Spark shuffles rows to
(key, block), sorts them there, and a ``mapInPandas`` pass streams each block through the
step; no group is ever held in memory.

A key that spans several blocks is folded exactly by guess and check:

1. every block is traced from a few guesses, the states after the rows before it when the fold
   starts afresh at ``phases`` successive rows: a greedy grouping is in one of few phases, so the
   true entry is nearly always among them;
2. the traces (one row per block and guess) are chained in order: the exit of a block picks the
   trace of the next one with that entry;
3. blocks without such a trace are traced again from the exit before them, until none is left;
4. one last pass emits the rows from the agreed entries.

Counters in the state never forget, so they are kept apart: block entries get the sum of what
the blocks before added, along the chain.  That is one number, or a vector of counts by name of
which a step tells values up to ``cap`` apart only: saturating vectors add up in any grouping, so
the blocks after one without a fitting trace already get nearly the counts that they will have.

The number of rounds does not depend on the number of blocks where the guesses hold the true
entry.  In the worst case it degrades to one round per block, never to a wrong answer.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyspark.operators.ordered import BLOCK_ROWS, LONGEST
from storyspark.session import cut_lineage

K, O = "script_id", "idx"
WARMUP_ROWS = 64


@dataclass(frozen=True)
class Fold:
    """``start`` is a JSON-able state; ``step(state, row)`` returns (state, output tuple or None)."""

    start: list
    step: Callable[[list, tuple], tuple[list, tuple | None]]
    columns: Sequence[str]          # inputs, in the order of ``row``
    schema: str                     # output columns, DDL
    counted: bool = False           # last state item is a counter a row can only add to, or {name: counter}
    cap: int | None = None          # counters over it are alike
    phases: int = 1                 # rows before a block at which a trace of it starts afresh


def sequence_fold(df: DataFrame, fold: Fold, keep: Sequence[str] = (), key: Sequence[str] | str = K, order: str = O,
                  block_rows: int | None = None, warmup: int = WARMUP_ROWS) -> DataFrame:
    """Fold each key in order; output is key, order, ``keep`` and the fold's columns."""
    size = block_rows or BLOCK_ROWS
    key = [key] if isinstance(key, str) else list(key)
    cols = list(dict.fromkeys([*key, order, *keep, *fold.columns]))
    rows = df.select(*cols)
    longest = df.schema[order].metadata.get(LONGEST)
    if longest is None:
        longest = (rows.agg(F.max(order)).first()[0] or 0) + 1
    out = T.StructType([f for f in rows.schema.fields if f.name in {*key, order, *keep}])
    out = T.StructType([*[out[c] for c in dict.fromkeys([*key, order, *keep])], *T.StructType.fromDDL(fold.schema).fields])
    if longest <= size:
        placed = rows.repartition(*key).sortWithinPartitions(*key, order)
        return placed.mapInPandas(_emitter(fold, key, list(out.names), entries=False), out)

    rows = cut_lineage(rows.withColumn("_blk", F.floor(F.col(order) / size).cast("long")))  # traced, and then folded
    entries = _agreed_entries(rows, fold, cols, key, order, size, min(warmup, size))
    placed = rows.join(entries, [*key, "_blk"]).repartition(*key, "_blk").sortWithinPartitions(*key, order)
    return placed.mapInPandas(_emitter(fold, key, list(out.names), entries=True), out)


def _agreed_entries(rows, fold, cols, key, order, size, warmup) -> DataFrame:
    group = [*key, "_blk"]
    phases = max(1, min(fold.phases, warmup))
    none = {"_entry": F.lit(None).cast("string"), "_count": F.lit(None).cast("string")}
    # the rows before a block warm its traces up; trace p leaves out the first p of them
    spot = F.pmod(F.col(order), F.lit(size)) - (size - warmup)
    here = F.transform(F.sequence(F.lit(0), F.lit(phases - 1)), lambda p: F.struct(p.alias("p"), F.lit(0).alias("c")))
    ahead = F.filter(F.transform(F.sequence(F.lit(0), F.lit(phases - 1)), lambda p: F.struct(p.alias("p"), F.lit(1).alias("c"))), lambda x: x["p"] <= spot)
    halo = rows.withColumn("_x", F.explode(F.when(spot >= 0, F.concat(here, ahead)).otherwise(here)))
    halo = halo.withColumns({"_blk": F.col("_blk") + F.col("_x.c"), "_c": F.col("_x.c"), "_phase": F.col("_x.p"), **none}).drop("_x")
    halo = halo.filter((F.col("_blk") > 0) | (F.col("_phase") == 0))  # a sequence has one start
    schema = T.StructType([*[rows.schema[c] for c in key], T.StructField("_blk", T.LongType()), T.StructField("_phase", T.IntegerType()),
                           *[T.StructField(c, T.StringType()) for c in ("_entry", "_count", "_exit", "_added")]])

    def traced(source: DataFrame) -> DataFrame:
        placed = source.repartition(*group, "_phase").sortWithinPartitions(*group, "_phase", order)
        return cut_lineage(placed.mapInPandas(_tracer(fold, key), schema).filter(F.col("_entry").isNotNull()).dropDuplicates([*group, "_entry", "_count"]))

    states, rounds = traced(halo), 0
    while True:
        chain = states.repartition(*key).sortWithinPartitions(*group, "_phase")
        chained = cut_lineage(chain.mapInPandas(_chain(key, fold), T.StructType([*schema.fields[:len(key) + 1], *schema.fields[len(key) + 2:len(key) + 4],
                                                                                         T.StructField("_met", T.BooleanType())])))
        missing = chained.filter(~F.col("_met"))
        if missing.isEmpty():
            _ROUNDS.append(rounds)
            return chained.drop("_met")
        rounds += 1
        again = rows.withColumns({"_c": F.lit(0), "_phase": F.lit(phases + rounds)}).join(missing.drop("_met"), group)
        states = states.unionByName(traced(again))


#: Extra rounds of the latest folds over long keys, for tests.
_ROUNDS: deque = deque(maxlen=16)


def _chain(key: list[str], fold: Fold):
    """Entry of every block along the chain of exits, and whether a trace has it.

    After a block without one, the nearest trace stands in, so that the rest of the chain is still looked at.
    """
    names = [*key, "_blk", "_entry", "_count", "_met"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, want, total, block, traces = None, None, "", None, []
        done: list[tuple] = []

        def close() -> None:
            nonlocal want, total
            if not traces:
                return
            if want is None:  # the first block of a key has one trace
                met, trace = True, traces[0]
            else:
                fit = [t for t in traces if t[0] == want and t[1] == total]
                # the trace of the same state, or the latest one, comes nearest to what the block will do
                near = [t for t in traces if t[0] == want] or traces
                met, trace = bool(fit), fit[0] if fit else near[-1]
            entry, count = (trace[0], trace[1]) if want is None else (want, total)
            done.append((*now, block, entry, count, met))
            want, total = trace[2], _sum(fold, count, trace[3])

        for pdf in batches:
            for *group, blk, _, entry, count, leave, added in zip(*[pdf[c].tolist() for c in pdf.columns]):
                if tuple(group) != now or blk != block:
                    close()
                    traces = []
                    if tuple(group) != now:
                        now, want, total = tuple(group), None, ""
                    block = blk
                traces.append((entry, count, leave, added))
            if len(done) > 10_000:
                yield pd.DataFrame(done, columns=names)
                done = []
        close()
        yield pd.DataFrame(done, columns=names)

    return run


def _spell(fold: Fold, counter) -> str:
    """A counter as text; equal texts are alike to the fold."""
    cap = fold.cap if fold.cap is not None else float("inf")
    if isinstance(counter, dict):
        return json.dumps({name: min(n, cap) for name, n in counter.items() if n}, sort_keys=True)
    return json.dumps(min(counter, cap))


def _sum(fold: Fold, one: str, other: str) -> str:
    if not fold.counted:
        return ""
    a, b = json.loads(one), json.loads(other)
    return _spell(fold, {name: a.get(name, 0) + b.get(name, 0) for name in {*a, *b}} if isinstance(a, dict) else a + b)


def _pack(fold: Fold, state: list) -> tuple[str, str]:
    """State without its counter, and the counter."""
    return (json.dumps(state[:-1], sort_keys=True), _spell(fold, state[-1])) if fold.counted else (json.dumps(state, sort_keys=True), "")


def _gained(fold: Fold, before, after) -> str:
    """What a block added to the counter."""
    if not fold.counted:
        return ""
    return _spell(fold, {name: n - before.get(name, 0) for name, n in after.items()} if isinstance(after, dict) else after - before)


def _unpack(fold: Fold, text: str | None, count: str | None) -> list:
    if text is None:
        return list(fold.start)
    state = json.loads(text)
    return [*state, json.loads(count)] if fold.counted else state


def _tracer(fold: Fold, key: list[str]):
    """Entry and exit state of each block; rows copied from the block before only warm it up."""
    step, picks = fold.step, list(fold.columns)
    names = [*key, "_blk", "_phase", "_entry", "_count", "_exit", "_added"]

    def closed(group, entry, state):
        if entry is None:  # only warm-up rows: the block does not exist
            return (*group, None, None, None, None)
        (text, count), before = entry
        return (*group, text, count, _pack(fold, state)[0], _gained(fold, before, state[-1]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, entry = None, None, None
        for pdf in batches:
            done = []
            data = zip(zip(*[pdf[c].tolist() for c in [*key, "_blk", "_phase"]]), pdf["_c"].tolist(), pdf["_entry"].tolist(),
                       pdf["_count"].tolist(), zip(*[_plain(pdf[c]) for c in picks]))
            for group, copied, given, count, row in data:
                if group != current:
                    if current is not None:
                        done.append(closed(current, entry, state))
                    current, entry, state = group, None, _unpack(fold, given, count)
                if not copied and entry is None:
                    if given is None and fold.counted:
                        state = [*state[:-1], fold.start[-1]]
                    entry = _pack(fold, state), state[-1]
                state, _ = step(state, row)
            if done:
                yield pd.DataFrame(done, columns=names)
        if current is not None:
            yield pd.DataFrame([closed(current, entry, state)], columns=names)

    return run


def _emitter(fold: Fold, key: list[str], names: list[str], entries: bool):
    step, picks = fold.step, list(fold.columns)
    group_cols = [*key, "_blk"] if entries else key
    carried = names[: len(names) - len(T.StructType.fromDDL(fold.schema).fields)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            out = []
            size = len(pdf)
            given = pdf["_entry"].tolist() if entries else [None] * size
            counts = pdf["_count"].tolist() if entries else [None] * size
            data = zip(zip(*[pdf[c].tolist() for c in group_cols]), given, counts, zip(*[_plain(pdf[c]) for c in picks]),
                       zip(*[_plain(pdf[c]) for c in carried]))
            for group, entry, count, row, kept in data:
                if group != current:
                    current, state = group, _unpack(fold, entry, count)
                state, made = step(state, row)
                if made is not None:
                    out.append((*kept, *made))
            yield pd.DataFrame(out, columns=names)

    return run


def _plain(column: pd.Series) -> list:
    """Python values with None for missing ones."""
    values = column.tolist()
    if column.dtype.kind == "f" or column.dtype == object:
        return [None if v is None or v != v else v for v in values] if column.dtype.kind == "f" else values
    return values
