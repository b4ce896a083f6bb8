"""Embedding near-dedup by spherical-cap filters.

Filter directions are the words of a random product code: the rotated space is cut into blocks, and
a direction takes one random unit vector per block, so thousands of directions need few inner
products.  Each vector is list-decoded to all directions whose cap it lies in.  The nearest of them
is its home; every vector meets the residents of all directions on its list, by a join on the
filters, and is verified against them in double precision.  Directions grow with the vectors, so a
vector meets few residents by chance; a filter without residents, and a lone resident whose sketch
is too far away for certain, are left out before the vectors themselves travel.  A vector has one home, so a pair meets
at most once in each direction, and no pair is ever written out: tasks return link counts and the
edges of a spanning forest.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyspark.llm.components import contract
from storyspark.session import packed

#: Blocks of the code; a block has BLOCK_WORDS unit vectors at least, WORDS_PER_ROOT times the root of the vectors of the largest label, MAX_WORDS at most.
BLOCKS, BLOCK_WORDS, WORDS_PER_ROOT, MAX_WORDS = 2, 128, 32, 16_384
#: Vectors of few components have few directions that differ: (components below, words at most).
FEW_COMPONENTS = ((16, 128), (48, 512))
#: Rows of a verification cell: residents of a filter in groups of the first, visitors in groups of the second size.
RESIDENTS, VISITORS = 512, 2048
#: Standard deviations by which a neighbour may fall short of its expected place before it is missed.
MARGIN = 4.5
#: Bits a home, hashes and most bits of the table of filters with residents; inner products that a task holds at once.
HOME_BITS, HASHES, MAX_BITS, PRODUCTS = 32, 4, 1 << 27, 1 << 22
#: What rounding may take from a sum of products.
SLACK = 1e-12
#: Rotated components of a sketch, a byte each: component times SKETCH_SCALE, rounded.
SKETCH, SKETCH_SCALE = 16, 127


class Code:
    """Random product code for vectors of ``dim`` components; the same for the same arguments."""

    def __init__(self, dim: int, blocks: int = BLOCKS, words: int = BLOCK_WORDS, seed: int = 11):
        rng = np.random.default_rng([seed, dim])
        self.rotation, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
        self.cuts = [b for b in np.array_split(np.arange(dim), min(blocks, dim))]
        self.words = []
        for block in self.cuts:
            w = rng.normal(size=(words, len(block)))
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(len(self.cuts)))

    def inner(self, x: np.ndarray) -> Iterator[list[np.ndarray]]:
        """For each row of ``x``, its products with the words of each block; PRODUCTS of them exist at a time."""
        step = max(1, PRODUCTS // sum(map(len, self.words)))
        for at in range(0, len(x), step):
            y = x[at:at + step] @ self.rotation
            yield from zip(*(y[:, block] @ w.T for w, block in zip(self.words, self.cuts)))

    def home(self, inner: list[np.ndarray]) -> int:
        home = 0
        for i in inner:
            home = home * len(i) + int(i.argmax())
        return home

    def reach(self, inner: list[np.ndarray], similarity: float) -> np.ndarray:
        """All directions in reach of a unit vector.

        If y is as similar to x as asked, y's home f is at least as near to y as x's home is, which
        is ``similarity`` times the distance of x's home up to noise; x in turn sees f at that value
        times ``similarity`` up to noise.  The noise is that of a random direction, of which the
        cap leaves MARGIN standard deviations.  Words and partial sums that cannot reach the cap are pruned.
        """
        best = [float(i.max()) for i in inner]
        noise = np.sqrt(max(0.0, 1 - similarity**2)) * np.sqrt(2.0 / len(self.rotation))
        cap = similarity**2 * sum(best) - MARGIN * noise
        sums, index = np.zeros(1), np.zeros(1, np.int64)
        for k, i in enumerate(inner):
            rest = sum(best[k + 1:])
            near = np.flatnonzero(i + (sum(best) - best[k]) >= cap - SLACK)
            near = near[np.argsort(-i[near])]  # a partial sum goes on with a beginning of these
            many = np.searchsorted(-i[near], sums + rest - cap + SLACK, "right")
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            sums, index = np.repeat(sums, many) + i[near[place]], np.repeat(index * len(i), many) + near[place]
            keep = sums + rest >= cap
            sums, index = sums[keep], index[keep]
        return index.astype(np.int32)

    def decode(self, x: np.ndarray, similarity: float) -> tuple[int, np.ndarray]:
        """(home, all directions in reach) of a unit vector."""
        inner = next(self.inner(x[None]))
        return self.home(inner), self.reach(inner, similarity)


@functools.lru_cache(maxsize=8)
def code(dim: int, words: int = BLOCK_WORDS) -> Code:
    return Code(dim, words=min([words] + [most for below, most in FEW_COMPONENTS if dim < below]))


def words_for(vectors: int) -> int:
    """Words of a block, a power of two: the directions grow with the vectors of a label, so that those that a vector visits do not."""
    words = BLOCK_WORDS
    while words < MAX_WORDS and words < WORDS_PER_ROOT * vectors**0.5:
        words *= 2
    return words


def _comparable(x: np.ndarray) -> bool:
    return len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())


def _units(raws: list[bytes], kind: str) -> np.ndarray:
    """Vectors of length one in double precision, of as many components each."""
    x = np.frombuffer(b"".join(raws), kind).reshape(len(raws), -1).astype(float)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, kind: str, whole: bool) -> DataFrame:
    """(id, node) per row, or with ``whole`` (node, field, raw): equal vectors of one label share a node; a node is null where nothing can link.

    A field is a label and a number of components, ``raw`` the components as they are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, nodes, fields, raws = batch.column(1), [], [], []
            for vector, label in zip(vectors, batch.column(2).to_pylist()):
                values = vector.values
                x = None if label is None or values is None else values.to_numpy(zero_copy_only=False).astype(float)  # a null component is read as NaN
                fit = x is not None and _comparable(x)
                nodes.append(hashlib.md5(f"{label}|".encode() + x.tobytes()).digest() if fit else None)
                if whole:
                    fields.append(int.from_bytes(hashlib.md5(f"{len(x)}|{label}".encode()).digest()[:8], "little", signed=True) if fit else None)
                    raws.append(x.astype(kind).tobytes() if fit else None)
            made = [pa.array(nodes, pa.binary())]
            yield pa.RecordBatch.from_arrays(made + [pa.array(fields, pa.int64()), pa.array(raws, pa.binary())], ["node", "field", "raw"]) if whole else (
                pa.RecordBatch.from_arrays([batch.column(0), *made], ["id", "node"]))

    slim = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).cast("string").alias("label"))
    return slim.mapInArrow(run, "node binary, field long, raw binary" if whole else f"id {vectors.schema[id_col].dataType.simpleString()}, node binary")


def _by_dim(raws: list[bytes], kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of the rows of each number of components."""
    sizes = np.array([len(r) for r in raws], int)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, _units([raws[i] for i in at], kind)


def _sketches(rotated: np.ndarray) -> np.ndarray:
    return np.rint(rotated[:, :SKETCH] * SKETCH_SCALE).astype(np.int8)


def _homes(nodes: DataFrame, words: int, kind: str) -> DataFrame:
    """(node, n, field, raw, home, sketch) of each distinct vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(3).to_pylist()
            homes, sketches = [0] * len(raws), [b""] * len(raws)
            for at, x in _by_dim(raws, kind):
                c = code(x.shape[1], words)
                for i, inner, sketch in zip(at, c.inner(x), _sketches(x @ c.rotation)):
                    homes[i], sketches[i] = c.home(inner), sketch.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(homes, pa.int32()), pa.array(sketches, pa.binary())], ["node", "n", "field", "raw", "home", "sketch"])

    return nodes.select("node", "n", "field", "raw").mapInArrow(run, "node binary, n long, field long, raw binary, home int, sketch binary")


def _hashed(field: np.ndarray, filters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, step) of each filter of a field in a table of any power of two: HASHES places, a step apart each."""
    h = (filters.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ field.astype(np.uint64)
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h, (h >> np.uint64(32)) | np.uint64(1)


def _taken(decoded: DataFrame, vectors: int) -> tuple[np.ndarray, int]:
    """Table of the filters that have residents, for every task (16 MB at most), and its bits: no taken filter is missing, few others are in it."""
    bits = 1 << 16
    while bits < MAX_BITS and bits < HOME_BITS * vectors:
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, step = _hashed(batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy())
            spots = np.concatenate([(first + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(HASHES)])
            yield pa.RecordBatch.from_arrays([pa.array((spots >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (spots & np.uint64(63))).view(np.int64))], ["at", "mask"])

    marks = decoded.select("field", "home").mapInArrow(run, "at int, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(bits >> 6, np.int64)
    table[marks.column("at").to_numpy()] = marks.column("mask").to_numpy()
    return table.view(np.uint64), bits


def _visits(decoded: DataFrame, similarity: float, words: int, kind: str, vectors: int) -> DataFrame:
    """(field, filter, node, sketch): the filters in reach of each vector, apart from those that have no resident for certain."""
    table, bits = _taken(decoded, vectors)
    shared = decoded.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = shared.value
        for batch in batches:
            fields, raws = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            lists, rows = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for at, x in _by_dim(raws, kind):
                c = code(x.shape[1], words)
                for i, inner in zip(at, c.inner(x)):
                    near = c.reach(inner, similarity)
                    first, step = _hashed(fields[i:i + 1].view(np.uint64), near)
                    for _ in range(HASHES):  # the next place is only looked up where those before are taken
                        spot = first & np.uint64(bits - 1)
                        hit = np.flatnonzero((taken[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1))
                        near, step = near[hit], step[hit]
                        first = first[hit] + step
                    lists.append(near)
                    rows.append(np.full(len(near), i))
            place = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([batch.column(1).take(place), pa.array(np.concatenate(lists)), batch.column(0).take(place), batch.column(3).take(place)],
                                             ["field", "filter", "node", "sketch"])

    return decoded.select("node", "field", "raw", "sketch").mapInArrow(run, "field long, filter int, node binary, sketch binary")


def _promising(meeting: DataFrame, similarity: float) -> DataFrame:
    """Visits without those to a lone resident that is the visitor itself or, by its sketch, too far away for certain."""
    # rounding moves a component by half a step, on both sides
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, other = ([np.frombuffer(s, np.int8) for s in batch.column(k).to_pylist()] for k in (4, 5))
            keep = batch.column(3).to_numpy() > 1
            sizes = np.array([len(m) for m in mine], int)
            for size in np.unique(sizes[~keep]):
                at = np.flatnonzero(~keep & (sizes == size))
                gap = np.array([mine[i] for i in at], float) - np.array([other[i] for i in at], float)
                keep[at] = np.sqrt((gap**2).sum(1)) / SKETCH_SCALE <= np.sqrt(2 - 2 * similarity) + np.sqrt(size) / SKETCH_SCALE + 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(4)], ["field", "filter", "node", "residents"]).filter(pa.array(keep))

    apart = meeting.where("residents > 1 OR node <> one").select("field", "filter", "node", "residents", "sketch", "other")
    return apart.mapInArrow(run, "field long, filter int, node binary, residents long")


def _cells(decoded: DataFrame, visits: DataFrame, similarity: float) -> DataFrame:
    """(cell keys, visits, node, n, raw): residents and visitors of each filter, dealt to cells of bounded size.

    A filter with many residents or visitors is cut into a grid of cells; each resident goes to all
    cells of its row, each visitor to all of its column.
    """
    key = ["field", "filter"]
    residents = decoded.select("field", F.col("home").alias("filter"), "node", "sketch")
    homes = residents.groupBy(*key).agg(F.count("*").alias("residents"), F.min("node").alias("one"), F.min("sketch").alias("other"))
    meeting = packed(_promising(visits.join(homes, key), similarity))
    grid = meeting.groupBy(*key).agg(F.ceil(F.first("residents") / RESIDENTS).cast("int").alias("rows"), F.ceil(F.count("*") / VISITORS).cast("int").alias("columns"))
    spot = lambda size: F.pmod(F.xxhash64("node"), F.col(size)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1))
    here = residents.join(grid, key).select(*key, spot("rows").alias("row"), every("columns").alias("column"), F.lit(False).alias("visits"), "node")
    come = meeting.join(grid, key).select(*key, every("rows").alias("row"), spot("columns").alias("column"), F.lit(True).alias("visits"), "node")
    return here.unionByName(come).join(decoded.select("node", "n", "raw"), "node")


def _links(cells: DataFrame, similarity: float, kind: str) -> DataFrame:
    """(node, links, other): link counts of visitors (``other`` null), and forest edges (``links`` 0)."""
    keys = ["field", "filter", "row", "column"]

    def verify(residents: list, visitors: list) -> tuple[list, list, list]:
        nodes, count = [r[0] for r in residents], np.array([r[1] for r in residents])
        at = {n: i for i, n in enumerate(nodes)}
        matrix, other = (_units([r[2] for r in rows], kind) for rows in (residents, visitors))
        close = other @ matrix.T >= similarity
        for j, v in enumerate(visitors):
            if v[0] in at:
                close[j, at[v[0]]] = False  # a vector is no neighbour of itself
        root = np.arange(len(residents))
        out = [], [], []
        for j in np.flatnonzero(close.any(1)):
            mine = np.flatnonzero(close[j])
            start = [(visitors[j][0], int(count[mine].sum()), None)]
            roots, first = np.unique(root[mine], return_index=True)
            own = at.get(visitors[j][0])
            if own is not None and root[own] not in roots:
                roots = np.append(roots, root[own])
            elif own is not None and len(roots) == 1:
                first = first[:0]  # already connected
            start += [(visitors[j][0], 0, nodes[mine[i]]) for i in first]
            root[np.isin(root, roots)] = roots[0]
            for column, values in zip(out, zip(*start)):
                column.extend(values)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, residents, visitors, found = None, [], [], ([], [], [])

        def close() -> None:
            if residents and visitors:
                for column, values in zip(found, verify(residents, visitors)):
                    column.extend(values)
            visitors.clear()

        for batch in batches:
            for *cell, visits, node, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if cell != now:
                    close()
                    now, residents = cell, []
                if visits:
                    visitors.append((node, n, raw))
                    if len(visitors) >= VISITORS:
                        close()
                else:
                    residents.append((node, n, raw))
            if len(found[0]) > 10_000:
                yield emit(found)
                found = [], [], []
        close()
        yield emit(found)

    def emit(found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found[0], pa.binary()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.binary())], ["node", "links", "other"])

    dealt = cells.select(*keys, "visits", "node", "n", "raw").repartition(*keys).sortWithinPartitions(*keys, "visits")
    return dealt.mapInArrow(run, "node binary, links long, other binary")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", similarity: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept) per row of ``vectors``.

    Rows link if their labels are equal and not null, their vectors have as many components, and
    the cosine in double precision is ``similarity`` or more.  Vectors that are null, empty, zero
    or hold a null or non-finite component link with nothing.  ``n_links`` counts the other rows
    linked directly, ``component_id`` is the least id reachable by links (null ids come last) and
    ``kept`` says id = component_id.  Rows that repeat count as rows: they link with each other.
    Other columns are not read; an empty table gives an empty one.

    The filters miss a pair at exactly the least similarity with a probability of a few in a
    million, closer ones less; no pair below it is linked.  Equal vectors are one node of the search.
    """
    kind = "f4" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "f8"
    rows = packed(_classes(vectors, id_col, vector_col, label_col, kind, False))
    comparable = rows.where("node IS NOT NULL")
    nodes = _classes(vectors, id_col, vector_col, label_col, kind, True).where("node IS NOT NULL").groupBy("node").agg(
        F.count("*").alias("n"), F.first("field").alias("field"), F.first("raw").alias("raw"))
    # an upper bound that needs no shuffle of vectors: equal ones count as often as they come
    largest, total = vectors.groupBy(label_col).count().agg(F.max("count"), F.sum("count")).first()
    words = words_for(largest or 0)
    decoded = packed(_homes(nodes, words, kind))
    visits = _visits(decoded, similarity, words, kind, total or 0)
    found = packed(_links(_cells(decoded, visits, similarity), similarity, kind))
    roots = contract(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    per_node = decoded.select("node", "n").join(counts, "node", "left").join(roots, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    placed = comparable.select("id", "node").join(per_node, "node")
    least = packed(placed.groupBy("root").agg(F.min("id").alias("least")))  # on its own, so that the join can split a large component
    linked = placed.join(least, "root").select("id", "n_links", F.col("least").alias("component_id"))
    alone = rows.where("node IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
