"""Vector top-k, exact or over inverted lists: matrix products inside tasks, k rows per query and partition leave them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyspark.session import cut_lineage

MAX_QUERY_BYTES = 64 << 20   # query matrix that a task (and, for a small set, the driver) holds
TILE_CELLS = 4 << 20         # products that a task holds at once


def unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size == 0, 1.0, size)


class _Best:
    """The k best rows of each query so far: flat arrays (query number, id, similarity, score)."""

    def __init__(self, names: list, matrix: np.ndarray, tags, k: int, weight, bonus_weight, clip: bool, positive: bool):
        self.names, self.matrix, self.tags, self.k = names, matrix, tags, k
        self.weight, self.bonus_weight = (np.broadcast_to(np.asarray(w, float), len(names)) for w in (weight, bonus_weight))
        self.clip, self.positive = clip, positive
        self.held: list[np.ndarray] | None = None

    def add(self, ids: np.ndarray, vectors: np.ndarray, own, bonus) -> None:
        """Rows in chunks and queries in tiles, so that at most TILE_CELLS products exist at a time."""
        tile = max(1, min(len(self.names), TILE_CELLS // 1024))
        rows = max(1, TILE_CELLS // tile)
        for a in range(0, len(ids), rows):
            part = slice(a, a + rows)
            for q in range(0, len(self.names), tile):
                self._tile(q, min(q + tile, len(self.names)), ids[part], vectors[part], None if own is None else own[part], None if bonus is None else bonus[part])

    def _tile(self, first, last, ids, vectors, own, bonus) -> None:
        sims = vectors @ self.matrix[first:last].T
        if self.clip:
            np.clip(sims, 0.0, 1.0, out=sims)
        scores = self.weight[first:last] * sims
        if bonus is not None:
            scores += bonus[:, None] * self.bonus_weight[first:last]
        if own is not None:
            scores[own[:, None] != self.tags[first:last][None, :]] = -np.inf
        if self.positive:
            scores[~(scores > 0)] = -np.inf
        if len(ids) > self.k:  # ties with the k-th best stay in until ids decide
            good = scores >= np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k]
        else:
            good = np.ones(scores.shape, bool)
        row, column = np.nonzero(good & (scores > -np.inf))
        new = [column + first, ids[row], sims[row, column], scores[row, column]]
        self.held = self._cut(new if self.held is None else [np.concatenate(p) for p in zip(self.held, new)])

    def _cut(self, flat: list[np.ndarray]) -> list[np.ndarray]:
        query, ids, _, scores = flat
        order = np.lexsort((ids, -scores, query))
        flat = [c[order] for c in flat]
        start = np.searchsorted(flat[0], flat[0], "left")
        keep = np.arange(len(order)) - start < self.k
        return [c[keep] for c in flat]

    def frame(self, qid: str, id: str) -> pd.DataFrame:
        # without rows the type of the ids is not known: an empty column of objects becomes any type
        query, ids, sims, scores = self.held if self.held is not None else [np.zeros(0, int), np.zeros(0, object), np.zeros(0), np.zeros(0)]
        # names stay objects: one of them may be null
        return pd.DataFrame({qid: pd.Series([self.names[q] for q in query], dtype=object), id: ids, "similarity": sims, "score": scores})


def top_k_vectors(vectors: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding",
                  qid: str = "query_id", qvector: str = "embedding", same: str | None = None, weight: float | str = 1.0,
                  bonus: str | None = None, bonus_weight: float | str = 1.0, clip: bool = False, positive: bool = False) -> DataFrame:
    """(query, id, similarity, score, rank) of the ``k`` best rows by cosine, ties by id.

    ``same`` names a column that must be equal on both sides (a metadata filter).  The ranking
    score is ``weight * cosine + bonus_weight * bonus`` (cosine clipped to [0, 1] with ``clip``); each
    weight is a number, or names a column of the queries.  A row or query without a vector, or with a null or
    non-finite component, has no similarity and no hits; nor has a null ``same``.  A null query id is an id like others.

    One job measures the query set.  If its matrix fits MAX_QUERY_BYTES, it goes to every task and
    the vectors stream past it without a shuffle.  A larger set stays distributed: queries are dealt
    to tiles of that size and vectors to blocks, and each (block, tile) cell streams its vectors
    past its tile.  A row of a query's global best is among the best of its own part, so partial
    lists of k rows are enough.
    """
    picks = [qid, qvector] + ([same] if same else []) + [w for w in (weight, bonus_weight) if isinstance(w, str)]
    cols = [id, vector] + ([same] if same else []) + ([bonus] if bonus else [])
    chosen, rows = queries.select(*picks).withColumn("_asks", _complete(qvector)), vectors.select(*cols).filter(F.col(vector).isNotNull())
    if same:
        chosen, rows = chosen.withColumn("_asks", F.col("_asks") & F.col(same).isNotNull()), rows.filter(F.col(same).isNotNull())
    given, total, dim = chosen.agg(F.count(F.lit(1)), F.count_if("_asks"), F.max(F.size(qvector))).first()
    if not given:
        raise ValueError("no query vectors")
    chosen = chosen.filter("_asks").drop("_asks")
    schema = T.StructType([T.StructField(qid, queries.schema[qid].dataType), T.StructField(id, vectors.schema[id].dataType),
                           T.StructField("similarity", T.DoubleType()), T.StructField("score", T.DoubleType())])
    if not total:
        return vectors.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0))
    tiles = -(-total * 8 * max(1, dim) // MAX_QUERY_BYTES)

    def best_of(columns: list[list]) -> _Best:
        """``columns``: the picked columns of the queries."""
        own = dict(zip(picks, columns))
        return _Best(own[qid], unit(np.array(own[qvector], dtype=np.float64)), np.array(own[same], dtype=object) if same else None, k,
                     own.get(weight, weight), own.get(bonus_weight, bonus_weight), clip, positive)

    def add(best: _Best, pdf: pd.DataFrame) -> None:
        if pdf.empty:
            return
        matrix = np.array(pdf[vector].tolist(), dtype=np.float64)
        whole = np.isfinite(matrix).all(1)  # a null component is read as NaN
        if not whole.all():
            pdf, matrix = pdf[whole], matrix[whole]
        if len(pdf):
            best.add(pdf[id].to_numpy(), unit(matrix), pdf[same].to_numpy() if same else None, pdf[bonus].to_numpy(dtype=np.float64) if bonus else None)

    if tiles == 1:
        columns = [list(c) for c in zip(*chosen.collect())]
        columns[1] = np.array(columns[1], dtype=np.float64)  # as numbers, a quarter of what lists of them take in every worker

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = best_of(columns)
            for pdf in batches:
                add(best, pdf)
            yield best.frame(qid, id)

        found = rows.mapInPandas(run, schema)
    else:
        found = _cells(rows, chosen, picks, cols, tiles, best_of, add, schema)
    w = Window.partitionBy(qid).orderBy(F.desc("score"), id)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _complete(vector: str):
    """Whether an array is there and all its components are finite."""
    x = F.col(vector)
    return x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def _cells(rows, chosen, picks, cols, tiles, best_of, add, schema) -> DataFrame:
    """Partial lists of all (vector block, query tile) cells; in each the queries arrive first."""
    blocks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // tiles)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = chosen.select(F.struct(*picks).alias("q"), F.pmod(F.xxhash64(picks[0]), F.lit(tiles)).cast("int").alias("_tile")).select("q", "_tile", every(blocks).alias("_block"))
    right = rows.select(F.struct(*cols).alias("v"), F.pmod(F.xxhash64(cols[0]), F.lit(blocks)).cast("int").alias("_block")).select("v", "_block", every(tiles).alias("_tile"))
    both = left.withColumn("v", F.lit(None).cast(right.schema["v"].dataType)).unionByName(right.withColumn("q", F.lit(None).cast(left.schema["q"].dataType)))
    placed = both.withColumn("_side", F.col("v").isNotNull()).repartition("_block", "_tile").sortWithinPartitions("_block", "_tile", "_side")
    qid, id = picks[0], cols[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, asked, best = None, [], None
        for pdf in batches:
            for cell, part in pdf.groupby(["_block", "_tile"], sort=False):
                if cell != now:
                    if best is not None:
                        yield best.frame(qid, id)
                    now, asked, best = cell, [], None
                asked += [tuple(q[c] for c in picks) for q in part.loc[~part["_side"], "q"]]
                seen = part.loc[part["_side"], "v"]
                if len(seen) and asked:
                    if best is None:
                        best = best_of([list(c) for c in zip(*asked)])
                    add(best, pd.DataFrame([tuple(v[c] for c in cols) for v in seen], columns=cols))
        if best is not None:
            yield best.frame(qid, id)

    return placed.mapInPandas(run, schema)


# ---- J20: inverted lists -------------------------------------------------------------------------------

MAX_LISTS = 4096             # so that centroids can go to every task
SAMPLE_BYTES = 64 << 20      # vectors that the driver fits the centroids on
LIST_ROWS, LIST_QUERIES = 16_384, 4096  # rows and queries of a cell
PROBE_CELLS = 1 << 20        # similarities of queries or rows to centroids that a task holds at once


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Unit centroids by k-means on the sphere; a list that loses its rows starts again from the row that fits worst."""
    rng = np.random.default_rng(seed)
    x = unit(sample)
    centres = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        own, near = _nearest_list(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        sums[empty] = x[np.argsort(near, kind="stable")[:len(empty)]]
        centres = unit(sums)
    return centres


def _nearest_list(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, near = np.empty(len(x), np.int64), np.empty(len(x))
    step = max(1, PROBE_CELLS // len(centres))
    for a in range(0, len(x), step):
        sims = x[a:a + step] @ centres.T
        own[a:a + step] = sims.argmax(1)
        near[a:a + step] = sims.max(1)
    return own, near


@dataclass
class VectorLists:
    """Every row with a vector in the list of its nearest centroid, and the centroids."""

    rows: DataFrame  # id, vector, list
    centroids: np.ndarray
    id: str
    vector: str


def build_lists(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", lists: int | None = None, sample_rows: int = 50_000) -> VectorLists:
    """Index of all rows that have a vector.

    Centroids are fitted in the driver on the rows of least id hash, ``sample_rows`` at most and
    SAMPLE_BYTES at most; every row is then assigned.  There are as many lists as the square root of
    the number of rows, MAX_LISTS at most, unless ``lists`` says otherwise.
    """
    slim = vectors.select(id, vector).filter(F.col(vector).isNotNull())
    total, dim = slim.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    if not total:
        raise ValueError("no vectors")
    bound = min(sample_rows, max(1, SAMPLE_BYTES // (8 * dim)))
    sample = slim.orderBy(F.xxhash64(id), id).limit(bound).select(vector).toPandas()[vector]
    wanted = min(lists or max(1, round(total**0.5)), MAX_LISTS, len(sample))
    centres = fit_centroids(np.array(sample.tolist(), dtype=np.float64), wanted)
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = _nearest_list(unit(np.array(pdf[vector].tolist(), dtype=np.float64).reshape(len(pdf), -1)), shared.value)[0] if len(pdf) else np.zeros(0, int)
            yield pdf.assign(list=own)

    schema = T.StructType([*slim.schema.fields, T.StructField("list", T.LongType())])
    return VectorLists(cut_lineage(slim.mapInPandas(assign, schema)), centres, id, vector)


def search_lists(index: VectorLists, queries: DataFrame, k: int, probes: int, qid: str = "query_id", qvector: str = "embedding") -> DataFrame:
    """(query, id, similarity, score, rank) of the ``k`` best rows of the ``probes`` lists nearest to each query, by exact cosine.

    All lists give the exact result.  A long list is cut into cells of LIST_ROWS rows and
    LIST_QUERIES queries; a cell returns k rows a query.
    """
    spark, id, vector = queries.sparkSession, index.id, index.vector
    probes = min(probes, len(index.centroids))
    shared = spark.sparkContext.broadcast(index.centroids)
    step = max(1, PROBE_CELLS // len(index.centroids))
    slim = queries.select(qid, F.col(qvector).alias("_qv")).filter("_qv IS NOT NULL")

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), step):  # a batch of queries against all lists would not be bounded
                part = pdf.iloc[a:a + step]
                sims = unit(np.array(part["_qv"].tolist(), dtype=np.float64)) @ shared.value.T
                yield part.assign(list=list(np.argsort(-sims, axis=1, kind="stable")[:, :probes]))

    lists = T.StructType([*slim.schema.fields, T.StructField("list", T.ArrayType(T.LongType()))])
    asked = slim.mapInPandas(probe, lists).withColumn("list", F.explode("list"))
    # one row a list: MAX_LISTS at most
    sizes = index.rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).cast("int").alias("_rows"))
    crowds = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_QUERIES).cast("int").alias("_queries"))
    grid = F.broadcast(sizes.join(crowds, "list"))
    spot = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(grid, "list").select(qid, "_qv", "list", every("_rows").alias("_row"), spot(qid, "_queries").alias("_query"))
    right = index.rows.join(grid, "list").select(id, vector, "list", spot(id, "_rows").alias("_row"), every("_queries").alias("_query"))
    schema = T.StructType([T.StructField(qid, queries.schema[qid].dataType), T.StructField(id, index.rows.schema[id].dataType),
                           T.StructField("similarity", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def compare(some: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if some.empty or rows.empty:
            return pd.DataFrame({f.name: [] for f in schema})
        best = _Best(some[qid].tolist(), unit(np.array(some["_qv"].tolist(), dtype=np.float64)), None, k, 1.0, 1.0, False, False)
        best.add(rows[id].to_numpy(), unit(np.array(rows[vector].tolist(), dtype=np.float64)), None, None)
        return best.frame(qid, id)

    cell = ["list", "_row", "_query"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(compare, schema)
    w = Window.partitionBy(qid).orderBy(F.desc("score"), id)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cosine(a, b):
    """Cosine of two array columns (for pairs that are already known)."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def context_text(hits: DataFrame, text: str = "text", who: str = "character", qid: str = "query_id") -> DataFrame:
    """One context string per query from its top-k hits (k rows per group)."""
    line = F.concat(F.lit("- "), F.col(text), F.when(F.coalesce(F.col(who), F.lit("")) != "", F.concat(F.lit(" (Character: "), F.col(who), F.lit(")"))).otherwise(""))
    return hits.groupBy(qid).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("context"))


# ---- S10, S11: collections -------------------------------------------------------------------------

def collection_rows(df: DataFrame, collection: str, text: str = "text", parts: tuple[str, ...] = ("text",)) -> DataFrame:
    """Rows with a content id, so that repeated loads never collide or duplicate by position."""
    digest = F.sha2(F.concat_ws("\u0001", F.lit(collection), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts]), 256)
    return df.withColumns({"collection": F.lit(collection), "id": digest, "content_hash": F.md5(F.coalesce(F.col(text), F.lit("")))})


def append_collection(df: DataFrame, path: str, collection: str, buckets: int = 16, **kw) -> int:
    """Store the rows that the collection does not hold yet; how many were new.

    Rows lie in buckets by content id.  Only the buckets of the batch are read; those with new rows are
    written anew as a whole (dynamic partition overwrite), so a load that is run again, wholly or
    after a failure half-way, leaves each row once.  Rows that repeat a content id in the batch are one.
    """
    spark = df.sparkSession
    placed = lambda rows: rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    rows = cut_lineage(placed(collection_rows(df, collection, **kw).dropDuplicates(["id"])))
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fresh = rows
    stored = None
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # the number of buckets at most
        stored = spark.read.schema(rows.schema).parquet(path).filter((F.col("collection") == collection) & F.col("bucket").isin(touched))
        fresh = rows.join(stored.select("id"), "id", "left_anti")
    fresh = cut_lineage(fresh)
    new = fresh.count()
    if new:
        out = fresh
        if stored is not None:
            # the old rows of the same buckets come along; cut off from the files that the write replaces
            out = fresh.unionByName(cut_lineage(stored.join(F.broadcast(fresh.select("bucket").distinct()), "bucket", "left_semi").select(*fresh.columns)))
        out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection", "bucket").parquet(path)
    return new


def stale_rows(current: DataFrame, stored: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Rows whose text has no stored vector yet: only these need encoding."""
    return current.withColumn("content_hash", F.md5(F.coalesce(F.col(text), F.lit("")))).join(
        stored.select(key, "content_hash"), [key, "content_hash"], "left_anti")


def stored_status(current: DataFrame, stored: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row: current rows, reusable vectors, rows to encode, vectors to drop."""
    now = current.select(key, F.md5(F.coalesce(F.col(text), F.lit(""))).alias("content_hash"), F.lit(1).alias("c"))
    old = stored.select(key, "content_hash", F.lit(1).alias("s"))
    return now.join(old, [key, "content_hash"], "full").agg(
        F.count("c").alias("current_rows"), F.count_if(F.col("c").isNotNull() & F.col("s").isNotNull()).alias("reusable"),
        F.count_if(F.col("s").isNull()).alias("to_encode"), F.count_if(F.col("c").isNull()).alias("outdated"))
