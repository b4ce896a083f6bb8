"""Hard-negative mining by rotated one-bit codes.

Each vector is rotated and kept as the signs of its components, one bit each, with its alignment:
the length of the vector along its own code.  What the code leaves over is rotated and coded again,
a few levels deep, and the length of the last remainder is stored.  For an anchor, quantised to a
few bits a component, the inner product with a code is a sum of popcounts; Cauchy-Schwarz on the
remainder turns the estimate into an interval that holds the true score for certain.  Only rows
whose interval can still change the result are scored, in integers.

Anchors meet rows in cells of bounded size.  A cell gives the few best rows of each anchor, so what
comes back does not grow with the cells' pairs, and hot labels are spread over many cells.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from storyspark.session import cut_lineage

#: One-bit codes per vector, each of what the one before left over, and bits a component of an anchor.
LEVELS, QUERY_BITS = 5, 6
#: Rows and anchors of a cell, and of a tile of it that is compared at once.
ROWS, ANCHORS = 8192, 8192
TILE_ROWS, TILE_ANCHORS = 2048, 128
#: Largest magnitude of an integer component; beyond, it is cut to this (sums stay far from 64 bits).
LARGEST = 1 << 26


class Code:
    """Rotations for vectors of ``dim`` components; the same for the same arguments.

    A level flips the signs of some components and then turns by a matrix that all levels share.
    """

    def __init__(self, dim: int, levels: int = LEVELS, seed: int = 17):
        rng = np.random.default_rng([seed, dim])
        self.dim, self.levels, self.words = dim, levels, -(-dim // 64)
        self.matrix = np.linalg.qr(rng.normal(size=(dim, dim)))[0] if dim else np.zeros((0, 0))
        self.flips = [rng.choice([-1.0, 1.0], dim) for _ in range(levels)] if dim else []

    def pack(self, bits: np.ndarray) -> np.ndarray:
        """Rows of booleans as 64-bit words."""
        padded = np.zeros((len(bits), self.words * 64), bool)
        padded[:, :self.dim] = bits
        return np.packbits(padded, axis=1, bitorder="little").view("<u8")

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes: rows x levels x words, alignments: rows x (levels + 1)); the last number is the length of the remainder."""
        rest = vectors.astype(float)
        codes = np.zeros((len(rest), self.levels, self.words), "<u8")
        align = np.zeros((len(rest), self.levels + 1))
        for k, flip in enumerate(self.flips):
            turned = (rest * flip) @ self.matrix
            up = turned > 0
            sign = np.where(up, 1.0, -1.0) / np.sqrt(self.dim)
            codes[:, k] = self.pack(up)
            align[:, k] = (turned * sign).sum(1)
            rest = ((turned - align[:, k, None] * sign) @ self.matrix.T) * flip
        align[:, -1] = np.sqrt((rest**2).sum(1))
        return codes, align

    def question(self, vectors: np.ndarray) -> Question:
        return Question(self, vectors.astype(float))


class Question:
    """Anchors prepared for popcounts: each rotated component is a whole number of steps above the least one, as bit planes."""

    def __init__(self, code: Code, vectors: np.ndarray):
        self.code, self.levels = code, []
        self.norm = np.sqrt((vectors**2).sum(1))
        top = (1 << QUERY_BITS) - 1
        for flip in code.flips:
            turned = (vectors * flip) @ code.matrix
            low = turned.min(1)
            step = np.maximum((turned.max(1) - low) / top, 1e-300)
            units = np.clip(np.rint((turned - low[:, None]) / step[:, None]), 0, top).astype(np.int64)
            near = low[:, None] + step[:, None] * units
            planes = [code.pack((units >> b) & 1 == 1) for b in range(QUERY_BITS)]
            self.levels.append((planes, low, step, near.sum(1), np.sqrt(((turned - near)**2).sum(1))))

    def intervals(self, some: slice, codes: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimate, half width) of the inner products of the anchors ``some`` with the rows of the codes.

        The half width is what quantising the anchor may have changed, level by level, plus the
        product of the lengths of anchor and remainder.
        """
        middle = np.zeros((some.stop - some.start, len(codes)))
        width = self.norm[some, None] * align[None, :, -1]
        for k, (planes, low, step, total, error) in enumerate(self.levels):
            units = np.zeros(middle.shape, np.int32)
            ones = np.zeros(len(codes), np.int64)
            for w in range(self.code.words):
                word = codes[:, k, w]
                ones += np.bitwise_count(word)
                for b, plane in enumerate(planes):
                    units += np.bitwise_count(plane[some, w, None] & word[None, :]).astype(np.int32) << b
            inner = 2 * (low[some, None] * ones + step[some, None] * units) - total[some, None]
            middle += inner * (align[:, k] / np.sqrt(self.code.dim))
            width += error[some, None] * align[:, k]
        # room for rounding in double precision
        return middle, width + 1e-9 * (1 + self.norm[some, None] * np.sqrt((align**2).sum(1)))


@functools.lru_cache(maxsize=8)
def code(dim: int) -> Code:
    return Code(dim)


def integers(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: float) -> DataFrame:
    """(id, label, dim, v, codes, align) of the rows that take part: v holds floor(scale * component) as 64-bit integers."""
    names = ["id", "label", "dim", "v", "codes", "align"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_dim: dict[int, list[tuple[int, np.ndarray]]] = {}
            for i, (vector, label) in enumerate(zip(batch.column(2), batch.column(1))):
                if not vector.is_valid or not label.is_valid or vector.values.null_count:
                    continue
                x = vector.values.to_numpy(zero_copy_only=False).astype(float)
                if np.isfinite(x).all():
                    by_dim.setdefault(len(x), []).append((i, x))
            for dim, rows in by_dim.items():
                with np.errstate(over="ignore"):
                    v = np.clip(np.floor(scale * np.array([x for _, x in rows]).reshape(len(rows), dim)), -LARGEST, LARGEST).astype("<i8")
                codes, align = code(dim).encode(v)
                take = pa.array([i for i, _ in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(take), batch.column(1).take(take), pa.array([dim] * len(rows), pa.int32()),
                    *(pa.array([r.tobytes() for r in part], pa.binary()) for part in (v, codes, align))], names)

    kind = vectors.schema[id_col].dataType.simpleString()
    slim = vectors.select(F.col(id_col).alias("id"), label.cast("string").alias("label"), F.col(vector_col).alias("vector"))
    return slim.mapInArrow(run, f"id {kind}, label string, dim int, v binary, codes binary, align binary")


class _Side:
    """Rows of one side of a cell, in order of their ids (nulls last), so that ties go to the first."""

    def __init__(self, table: pa.Table, dim: int):
        table = table.append_column("no_id", table.column("id").is_null())
        table = table.sort_by([("no_id", "ascending"), ("id", "ascending"), ("rid", "ascending")])
        self.id, self.rid = table.column("id").combine_chunks(), table.column("rid").to_numpy()
        self.label = np.array(table.column("label").to_pylist(), object)
        self.v = self._matrix(table, "v", "<i8").reshape(len(table), dim)
        self.table, self.dim = table, dim

    @staticmethod
    def _matrix(table: pa.Table, name: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    def coded(self) -> tuple[np.ndarray, np.ndarray]:
        c, n = code(self.dim), len(self.v)
        return self._matrix(self.table, "codes", "<u8").reshape(n, c.levels, c.words), self._matrix(self.table, "align", "<f8").reshape(n, c.levels + 1)


def _scores(anchors: np.ndarray, rows: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs (a[i], r[i])."""
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), 65536):
        part = slice(at, at + 65536)
        out[part] = (anchors[a[part]] * rows[r[part]]).sum(1)
    return out


def _first(k: int, group: np.ndarray, score: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Positions of the ``k`` best of each group: highest score, then least ``tie``."""
    order = np.lexsort((tie, -score, group))
    g = group[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    nth = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return order[nth < k]


class _Best:
    """The k best rows so far of each of ``groups`` groups."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.group, self.row, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(groups, -np.inf)  # score of the k-th best: lower ones change nothing

    def add(self, group: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        merged = [np.concatenate(x) for x in ((self.group, group), (self.row, row), (self.score, score))]
        keep = _first(self.k, merged[0], merged[2], merged[1])
        self.group, self.row, self.score = (m[keep] for m in merged)
        groups, first, n = np.unique(self.group, return_index=True, return_counts=True)
        full = n == self.k
        self.least[groups[full]] = self.score[first[full] + self.k - 1]


def _tiles(anchors: int, rows: int) -> Iterator[tuple[slice, slice]]:
    for r in range(0, rows, TILE_ROWS):
        for a in range(0, anchors, TILE_ANCHORS):
            yield slice(a, min(a + TILE_ANCHORS, anchors)), slice(r, min(r + TILE_ROWS, rows))


def _nearest(anchors: _Side, rows: _Side, k: int) -> _Best:
    """The k best rows of each anchor, its own row apart."""
    question, (codes, align) = code(anchors.dim).question(anchors.v), rows.coded()
    best = _Best(len(anchors.v), k)
    for a, r in _tiles(len(anchors.v), len(rows.v)):
        middle, width = question.intervals(a, codes[r], align[r])
        other = anchors.rid[a, None] != rows.rid[None, r]
        least = best.least[a]
        if other.shape[1] > k:  # the k-th highest lower bound is reached for certain
            lower = np.where(other, middle - width, -np.inf)
            least = np.maximum(least, np.partition(lower, -k, axis=1)[:, -k])
        i, j = np.nonzero(other & (middle + width >= least[:, None]))
        i, j = i + a.start, j + r.start
        best.add(i, j, _scores(anchors.v, rows.v, i, j))
    return best


def _banded(anchors: _Side, rows: _Side, positives: list[list[int]], k: int, low: int, high: int) -> tuple[_Best, np.ndarray]:
    """The k best rows of another label for each (anchor, positive) whose score lies in the positive's band; groups number these pairs."""
    question, (codes, align) = code(anchors.dim).question(anchors.v), rows.coded()
    size = max(map(len, positives))
    wanted = np.full((len(positives), size), np.iinfo(np.int64).min)
    for i, scores in enumerate(positives):
        wanted[i, :len(scores)] = scores
    real = np.array([[n < len(p) for n in range(size)] for p in positives])
    best = _Best(len(positives) * size, k)
    for a, r in _tiles(len(anchors.v), len(rows.v)):
        middle, width = question.intervals(a, codes[r], align[r])
        differs = anchors.label[a, None] != rows.label[None, r]
        possible = np.zeros(differs.shape, bool)
        for n in range(size):
            p = wanted[a, n]
            floor = np.maximum(low / high * p - 1, best.least.reshape(-1, size)[a, n])
            possible |= (real[a, n] & (p >= 0))[:, None] & (middle + width >= floor[:, None]) & (middle - width <= p[:, None])
        i, j = np.nonzero(possible & differs)
        i, j = i + a.start, j + r.start
        score = _scores(anchors.v, rows.v, i, j)
        for n in range(size):
            p = wanted[i, n]
            inside = real[i, n] & (low * p <= high * score) & (score <= p)
            best.add(i[inside] * size + n, j[inside], score[inside])
    return best, wanted


def _ranked(found: DataFrame, group: list[str], k: int, id_name: str, score_name: str) -> DataFrame:
    """The k best rows of each group with their ``rank``; groups hold k rows a cell at most."""
    order = Window.partitionBy(*group).orderBy(F.col(score_name).desc(), F.col(id_name).asc_nulls_last(), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _spread(n: Column, at_most: int) -> Column:
    return F.greatest(F.ceil(n / at_most), F.lit(1)).cast("int")


def _every(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def _apart(df: DataFrame) -> DataFrame:
    """``df`` with columns of its own, so that it can be grouped with a table it shares rows with."""
    return df.toDF(*df.columns).select(*(F.col(c).alias(c) for c in df.columns))


def mine(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: str | Column = "label", anchor: Column | None = None,
         positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive.

    Vectors become integers, floor(scale * component) in double precision; a score is the integer
    inner product with the anchor; higher scores come first, ties by smaller id (null ids last).
    Rows with a null label, a null vector, or a null or non-finite component take no part.  Anchors
    are the rows where ``anchor`` holds (by default: ids divisible by 100); null counts as no.  Its
    positives are the first other rows of its label; for each, the result has the first rows of
    another label with ``low * positive_score <= high * negative_score <= high * positive_score``
    (none where the positive's score is negative).  An anchor without positives, or a positive
    without negatives in its band, gives no row; an empty table gives an empty result.

    Rows equal in id, label and integers are one row; rows that share an id only are several, each an
    anchor of its own.  Vectors are compared with those of as many components; an empty vector
    scores 0.  Integers beyond 2 ** 26 in magnitude are cut to that.  Other columns are not read.
    """
    label = F.col(label) if isinstance(label, str) else label
    chosen = F.coalesce(F.col("id") % 100 == 0 if anchor is None else anchor, F.lit(False))
    key = F.struct("id", "label", "v")
    rows = integers(vectors, id_col, vector_col, label, scale).dropDuplicates(["id", "label", "v"])
    rows = cut_lineage(rows.withColumn("rid", F.xxhash64(key)).withColumn("anchor", chosen))
    id_kind = rows.schema["id"].dataType.simpleString()

    # positives: anchors meet the rows of their label
    spread = rows.groupBy("label", "dim").agg(_spread(F.count("*"), ROWS).alias("nr"), _spread(F.count_if("anchor"), ANCHORS).alias("na"),
                                              F.count_if("anchor").alias("anchors")).where("anchors > 0").drop("anchors")
    placed = rows.join(spread, ["label", "dim"]).withColumn("h", F.xxhash64("rid", F.lit(1)))
    cell = ["label", "dim", "rb", "ab"]
    own = F.pmod(F.col("h"), F.col("na")).cast("int").alias("ab")
    here = placed.where("anchor").select("id", "rid", "label", "dim", "v", own, _every(F.col("nr")).alias("rb"))
    there = placed.select("id", "rid", "label", "dim", "v", "codes", "align", F.pmod(F.col("h"), F.col("nr")).cast("int").alias("rb"), _every(F.col("na")).alias("ab"))

    def nearest(cell_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _empty(near_names, near_types)
        a, r = _Side(left, cell_key[1].as_py()), _Side(right, cell_key[1].as_py())
        best = _nearest(a, r, positives)
        return pa.table([a.rid[best.group], r.rid[best.row], r.id.take(pa.array(best.row)), best.score], near_names)

    near_names, near_types = ["rid", "other", "positive_id", "positive_score"], [pa.int64(), pa.int64(), _arrow_type(rows, "id"), pa.int64()]
    near = _apart(here).groupBy(*cell).cogroup(there.groupBy(*cell)).applyInArrow(
        nearest, f"rid long, other long, positive_id {id_kind}, positive_score long")
    near = _ranked(near, ["rid"], positives, "positive_id", "positive_score").where("positive_score >= 0")
    mined = near.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score", "positive_id"))).alias("positives"))
    asked = cut_lineage(rows.where("anchor").join(mined, "rid").select("id", "rid", "label", "dim", "v", "positives"))

    # negatives: the same anchors meet all rows
    totals = rows.groupBy("dim").agg(_spread(F.count("*"), ROWS).alias("nr"), _spread(F.count_if("anchor"), ANCHORS).alias("na"))
    cell2 = ["dim", "rb", "ab"]
    questions = asked.join(totals, "dim").withColumn("h", F.xxhash64("rid", F.lit(2)))
    questions = questions.select("id", "rid", "label", "dim", "v", F.col("positives.positive_score").alias("scores"), own, _every(F.col("nr")).alias("rb"))
    answers = rows.join(totals, "dim").withColumn("h", F.xxhash64("rid", F.lit(2)))
    answers = answers.select("id", "rid", "label", "dim", "v", "codes", "align", F.pmod(F.col("h"), F.col("nr")).cast("int").alias("rb"), _every(F.col("na")).alias("ab"))

    def banded(cell_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _empty(band_names, band_types)
        a, r = _Side(left, cell_key[0].as_py()), _Side(right, cell_key[0].as_py())
        best, wanted = _banded(a, r, a.table.column("scores").to_pylist(), negatives, low, high)
        size = wanted.shape[1]
        return pa.table([a.rid[best.group // size], pa.array(best.group % size, pa.int32()), r.rid[best.row], r.id.take(pa.array(best.row)), best.score], band_names)

    band_names, band_types = ["rid", "nth", "other", "negative_id", "negative_score"], [pa.int64(), pa.int32(), pa.int64(), _arrow_type(rows, "id"), pa.int64()]
    hard = _apart(questions).groupBy(*cell2).cogroup(answers.groupBy(*cell2)).applyInArrow(
        banded, f"rid long, nth int, other long, negative_id {id_kind}, negative_score long")
    hard = _ranked(hard, ["rid", "nth"], negatives, "negative_id", "negative_score")
    named = hard.join(asked.select("rid", F.col("id").alias("anchor_id"), "positives"), "rid").withColumn("positive", F.col("positives")[F.col("nth")])
    return named.select("anchor_id", F.col("positive.positive_id"), "rank", "negative_id", F.col("positive.positive_score"), "negative_score")


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    return to_arrow_type(df.schema[name].dataType)


def _empty(names: list[str], types: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array([], t) for t in types], names)
