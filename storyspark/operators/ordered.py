"""Ordered sequences cut into bounded blocks.

``Window.partitionBy(key)`` sends all rows of one key to one task.  When a single key can
hold a third of a 100 TB table that task never ends, so the sequence operators of this
package do not use it on raw rows.  They cut every key into blocks of consecutive rows and
only ever partition by ``(key, block)``:

* fixed look-back / look-ahead: rows next to a block edge are copied to the neighbour block
  (a halo), the window runs inside the block, the copies are dropped;
* running aggregates: inside the block by a window, across blocks by a carry computed from
  one summary row per block;
* per-key totals: from the same summary rows, joined back on ``(key, block)`` - never on the
  bare key, so no join task sees a whole hot key either.

``Blocks.dense`` needs a dense 0-based position (block = position div size).
``Blocks.adaptive`` takes any order: keys above the block size are cut by value range, again
inside a range that is still too full, and by the next order column where the ones before are
constant.
Both are pure functions of the data, so a recomputed task gives the same block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyspark.session import cut_lineage

BLOCK_ROWS = 1 << 16
HEAVY_BROADCAST_ROWS = 200_000  # a few tens of bytes each
MIN_PARTS = 64  # into which a block that is too full is cut at least
LONGEST = "longest_sequence"  # column metadata written by number_rows
_BLK = "_blk"
_HALO = "_halo"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


class _Cut:
    """How one order column cuts a block: statistics of the block, and the part that a row falls into.

    Parts never decrease with the column, in the order that Spark sorts by (nulls first, NaN last);
    the least and the greatest value of a block that varies fall into different parts.  Whole
    numbers, dates and times are cut in exact arithmetic, text by the character after the common
    beginning.
    """

    def __init__(self, df: DataFrame, column: str, tag: str):
        self.column, kind = F.col(column), df.schema[column].dataType
        self.text = isinstance(kind, T.StringType)
        self.exact = not self.text and not isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType))
        self.low, self.high, self.nulls, self.least, self.most = (f"{n}{tag}" for n in ("_lo", "_hi", "_nulls", "_min", "_max"))
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            value = F.unix_micros(self.column.cast("timestamp"))
        elif isinstance(kind, T.DateType):
            value = F.unix_date(self.column)
        else:
            value = self.column
        if self.exact:
            self.value = value.cast("decimal(20,0)")
        elif self.text:
            self.value = value
        else:  # halves, so that the difference of any two is finite
            finite = ~F.isnan(value.cast("double")) & (F.abs(value.cast("double")) != F.lit(float("inf")))
            self.value = F.when(finite, value.cast("double") / 2)

    def aggregates(self) -> list[Column]:
        return [F.min(self.value).alias(self.low), F.max(self.value).alias(self.high), F.count(F.when(self.column.isNull(), 1)).alias(self.nulls),
                F.min(self.column).alias(self.least), F.max(self.column).alias(self.most)]

    def varies(self) -> Column:
        nulls = F.col(self.nulls)
        return (F.col(self.least) != F.col(self.most)) | ((nulls > 0) & (nulls < F.col("_n")))

    def part(self, parts: Column) -> Column:
        low, high = F.col(self.low), F.col(self.high)
        if self.text:
            same = F.transform(F.sequence(F.lit(1), F.least(F.length(low), F.length(high)) + 1), lambda i: F.substring(low, i, 1) == F.substring(high, i, 1))
            start = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)), F.size(same))
            here = F.substring(self.column, start.cast("int"), 1)
            inner = F.when(here == "", F.lit(0)).otherwise(F.ascii(here) + 1).cast("long")
            return F.when(self.column.isNull(), F.lit(0).cast("long")).otherwise(inner + 1)
        if self.exact:
            width = F.greatest(F.ceil((high - low + 1) / parts), F.lit(1)).cast("decimal(20,0)")
            return F.when(self.column.isNull(), F.lit(0).cast("long")).otherwise(F.floor((self.value - low) / width).cast("long") + 1)
        inner = F.when(high > low, F.least(F.floor((self.value - low) / (high - low) * parts), parts - 1)).otherwise(F.lit(0)).cast("long")
        beyond = F.when(F.isnan(self.column.cast("double")), parts + 3).when(self.column > 0, parts + 2).otherwise(F.lit(1)).cast("long")
        return F.when(self.column.isNull(), F.lit(0).cast("long")).when(self.value.isNull(), beyond).otherwise(inner + 2)


class Blocks:
    """A keyed, ordered table with a block column; each step returns a new ``Blocks``."""

    def __init__(self, df: DataFrame, key: Sequence[str], by: Sequence[str], block_rows: int,
                 placed: bool = False, whole: bool = False, longest: int | None = None):
        self._df, self.key, self.by, self.block_rows = df, list(key), list(by), block_rows
        self._placed = placed  # rows already sit in (key, block) partitions
        self._whole = whole    # every key is known to fit one block: no block column
        self._longest = longest

    # ---- construction -------------------------------------------------------------

    @classmethod
    def dense(cls, df: DataFrame, key="script_id", order: str = "idx", block_rows: int | None = None) -> Blocks:
        """Blocks over a dense position.  When the position column records the longest
        sequence (``number_rows`` does) and it fits a block, the plan is a plain window."""
        size = block_rows or BLOCK_ROWS
        key = [key] if isinstance(key, str) else list(key)
        longest = df.schema[order].metadata.get(LONGEST)
        if longest is not None and longest <= size:
            return cls(df, key, [order], size, whole=True)
        cut = df.withColumn(_BLK, F.floor(F.col(order) / F.lit(size)).cast("long"))
        return cls(cut, key, [order], size)

    @classmethod
    def adaptive(cls, df: DataFrame, key, by, block_rows: int | None = None, rounds: int = 64) -> Blocks:
        """Blocks by value for keys over ``block_rows``; every other key is one block.

        One aggregate job (map-side combined, key column only) finds the longest key.  If it
        fits a block the plan stays a plain window plan.  Otherwise blocks that are too full are
        cut along the first order column that varies inside them, round by round, until all fit
        or hold equal rows only (a round narrows a range by MIN_PARTS or more, so evenly spread
        values take one).  A later column cuts only where all earlier ones are constant, so
        blocks are always consecutive; a block's name is the path of its cuts and sorts so.  The
        table of full blocks is joined: broadcast while under ``HEAVY_BROADCAST_ROWS`` rows.
        """
        size = block_rows or BLOCK_ROWS
        key = [key] if isinstance(key, str) else list(key)
        by = [by] if isinstance(by, str) else list(by)
        longest = df.groupBy(*key).count().agg(F.max("count")).first()[0] or 0
        if longest <= size:
            return cls(df, key, by, size, whole=True, longest=longest)
        cuts = [_Cut(df, c, f"_{i}") for i, c in enumerate(by)]
        out = df.withColumn(_BLK, F.lit(""))
        group = [*key, _BLK]
        for _ in range(rounds):
            full = out.dropna(subset=key).groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), *[a for c in cuts for a in c.aggregates()]).filter(F.col("_n") > size)
            which = F.coalesce(*[F.when(c.varies(), F.lit(i)) for i, c in enumerate(cuts)])
            full = cut_lineage(full.withColumn("_which", which).filter("_which IS NOT NULL"))
            found = full.limit(HEAVY_BROADCAST_ROWS + 1).count()
            if not found:
                break
            parts = F.least(F.greatest(F.ceil(2 * F.col("_n") / size), F.lit(MIN_PARTS)), F.lit(1 << 20))
            step = F.coalesce(*[F.when(F.col("_which") == i, F.lpad(F.hex(c.part(parts)), 6, "0")) for i, c in enumerate(cuts)], F.lit(""))
            out = out.join(F.broadcast(full) if found <= HEAVY_BROADCAST_ROWS else full, group, "left")
            out = out.withColumn("_cut", F.concat(F.col(_BLK), step)).select(*df.columns, F.col("_cut").alias(_BLK))
        return cls(out, key, by, size, longest=longest)

    # ---- steps --------------------------------------------------------------------

    @property
    def group(self) -> list[str]:
        return list(self.key) if self._whole else [*self.key, _BLK]

    def _window(self) -> Window:
        return Window.partitionBy(*self.group).orderBy(*self.by)

    def _with(self, df: DataFrame, placed: bool | None = None) -> Blocks:
        return Blocks(df, self.key, self.by, self.block_rows,
                      self._placed if placed is None else placed, self._whole, self._longest)

    def place(self) -> Blocks:
        """Shuffle to (key, block).  Explicit, because Spark would accept an existing
        partitioning on the bare key for a window on (key, block)."""
        return self if self._placed or self._whole else self._with(self._df.repartition(*self.group), True)

    def select(self, **cols: Column) -> Blocks:
        """Add row-local columns."""
        return self._with(self._df.withColumns({k: _col(v) for k, v in cols.items()}))

    def filter(self, cond: Column) -> Blocks:
        return self._with(self._df.filter(cond))

    def neighbours(self, **cols: tuple[str | Column, int]) -> Blocks:
        """Values of rows at a fixed distance: ``prev=("x", -1)``, ``nxt=("x", 1)``.

        Needs dense blocks: the row ``n`` places away is then inside the block or its halo.
        """
        before = max([-o for _, o in cols.values() if o < 0], default=0)
        after = max([o for _, o in cols.values() if o > 0], default=0)
        if max(before, after) > self.block_rows:
            raise ValueError("look-back is longer than a block")
        over = {
            name: (F.lag(_col(c), -o) if o < 0 else F.lead(_col(c), o)).over(self._window())
            for name, (c, o) in cols.items()
        }
        return self._with(self._df.withColumns(over)) if self._whole else self._halo(before, after, over)

    def numbered(self, out: str = "idx") -> Blocks:
        """Adds the dense position and goes on with blocks over it."""
        b = self.scan(running={out: ("count", F.lit(1))})
        place = (F.col(out) - 1).cast("long")
        df = b._df.withColumn(out, place.alias(out, metadata={LONGEST: self._longest} if self._longest else {}))
        if self._whole:
            return Blocks(df, self.key, [out], self.block_rows, whole=True, longest=self._longest)
        return Blocks.dense(df.drop(_BLK), self.key, out, self.block_rows)

    def _halo(self, before: int, after: int, over: Mapping[str, Column]) -> Blocks:
        pos = F.pmod(F.col(self.by[0]), F.lit(self.block_rows))
        blk = F.col(_BLK)
        copies = [F.struct(blk.alias("b"), F.lit(False).alias("h"))]
        if before:
            copies.append(F.when(pos >= self.block_rows - before, F.struct((blk + 1).alias("b"), F.lit(True).alias("h"))))
        if after:
            copies.append(F.when((pos < after) & (blk > 0), F.struct((blk - 1).alias("b"), F.lit(True).alias("h"))))
        spread = (
            self._df.withColumn("_copy", F.explode(F.array_compact(F.array(*copies))))
            .withColumn(_BLK, F.col("_copy.b")).withColumn(_HALO, F.col("_copy.h")).drop("_copy")
            .repartition(*self.group)
        )
        return self._with(spread.withColumns(dict(over)).filter(~F.col(_HALO)).drop(_HALO), True)

    def scan(self, running: Mapping[str, tuple] | None = None, totals: Mapping[str, tuple] | None = None) -> Blocks:
        """Running and whole-key aggregates in one pass.

        ``running``: name -> (kind, column[, "before"]); ``totals``: name -> (kind, column).
        Kinds: sum, count, min, max, last, first (last/first skip nulls).  "before" leaves
        the current row out.
        """
        running, totals = dict(running or {}), dict(totals or {})
        if not self._placed and not self._whole:
            return self.place().scan(running, totals)
        w = self._window()
        local, parts, carry, carried = {}, [], [], {}
        for name, spec in running.items():
            kind, column = spec[0], _col(spec[1])
            end = -1 if len(spec) > 2 and spec[2] == "before" else 0
            frame = w.rowsBetween(Window.unboundedPreceding, end)
            local[name] = _agg(kind, column).over(frame) if kind not in ("last", "first") else (
                (F.last if kind == "last" else F.first)(column, ignorenulls=True).over(frame))
            parts.append(self._partial(kind, column).alias(f"_p_{name}"))
            kw = Window.partitionBy(*self.key).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
            carry.append(_merge(kind, F.col(f"_p_{name}")).over(kw).alias(f"_c_{name}"))
            carried[name] = _combine(kind, F.col(f"_c_{name}"), F.col(name))
        for name, spec in totals.items():
            kind, column = spec[0], _col(spec[1])
            parts.append(self._partial(kind, column).alias(f"_p_{name}"))
            kw = Window.partitionBy(*self.key).orderBy(_BLK).rowsBetween(
                Window.unboundedPreceding, Window.unboundedFollowing)
            carry.append(_merge(kind, F.col(f"_p_{name}")).over(kw).alias(name))
        keep = self._df.columns
        if self._whole:
            whole = Window.partitionBy(*self.group)
            per_key = {n: self._partial(s[0], _col(s[1])).over(whole) for n, s in totals.items()}
            return self._with(self._df.withColumns({**local, **per_key}))
        summary = self._df.groupBy(*self.group).agg(*parts).select(*self.group, *carry)
        if not totals:
            # the first block of a key has nothing to carry in
            lowest = Window.partitionBy(*self.key).orderBy(_BLK)
            summary = summary.withColumn("_rank", F.row_number().over(lowest)).filter("_rank > 1").drop("_rank")
        out = self._df.withColumns(local).join(summary, self.group, "left").withColumns(carried)
        return self._with(out.select(*keep, *running, *totals))

    def _partial(self, kind: str, column: Column) -> Column:
        if kind == "last":
            return F.max_by(column, F.when(column.isNotNull(), F.struct(*self.by)))
        if kind == "first":
            return F.min_by(column, F.when(column.isNotNull(), F.struct(*self.by)))
        return _agg(kind, column)

    def runs(self, same: Column, start: str = "run_start") -> Blocks:
        """Island start per row: ``same`` says the row continues the previous one."""
        here = F.when(F.coalesce(same, F.lit(False)), F.lit(None)).otherwise(F.col(self.by[0]))
        return self.scan(running={start: ("last", here)})

    @property
    def df(self) -> DataFrame:
        return self._df.drop(_BLK)

    @property
    def raw(self) -> DataFrame:
        """The frame with its block column, for a join or grouping on (key, block)."""
        return self._df


def _agg(kind: str, c: Column) -> Column:
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind](c)


def _merge(kind: str, c: Column) -> Column:
    if kind in ("sum", "count"):
        return F.sum(c)
    if kind == "last":
        return F.last(c, ignorenulls=True)
    if kind == "first":
        return F.first(c, ignorenulls=True)
    return _agg(kind, c)


def _combine(kind: str, carry: Column, here: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(carry.isNull(), here).otherwise(carry + F.coalesce(here, F.lit(0)))
    if kind == "max":
        return F.greatest(carry, here)
    if kind == "min":
        return F.least(carry, here)
    if kind == "first":
        return F.coalesce(carry, here)
    return F.coalesce(here, carry)


def number_rows(df: DataFrame, key="script_id", by=("ts",), out: str = "idx", block_rows: int | None = None) -> DataFrame:
    """Dense 0-based position per key, without one task per key."""
    return Blocks.adaptive(df, key, by, block_rows).numbered(out).df


def from_one_row(df: DataFrame, order: str = "idx") -> DataFrame:
    """Marks a position that came from exploding one row's array.

    Such a sequence has been in one row of one task already, so it fits a block.
    """
    return df.withColumn(order, F.col(order).cast("long").alias(order, metadata={LONGEST: 1}))


def label_runs(df: DataFrame, value: str, key: str = "script_id", order: str = "idx",
               block_rows: int | None = None) -> DataFrame:
    """Adds ``run_start`` and ``run_pos`` (0-based) for runs of equal non-empty ``value``."""
    val = F.coalesce(F.col(value), F.lit(""))
    b = Blocks.dense(df, key, order, block_rows).neighbours(_prev=(val, -1))
    b = b.runs((F.col("_prev") == val) & (val != ""))
    return b.df.withColumn("run_pos", F.col(order) - F.col("run_start")).drop("_prev")
