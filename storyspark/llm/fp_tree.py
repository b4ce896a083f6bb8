"""Ranked lexical search over a document FP-tree.

Each document is restricted to the terms of the items and its terms are put in order of document
frequency, the most frequent first.  In this order documents share leading terms, so a block of them
is a trie whose subtrees are runs of neighbours.  Every subtree knows the largest tf of each term
in it and its smallest length norm m, which bound the score of all its documents; each item walks
the trie depth first, the most promising child first, and skips subtrees whose bound is below
its k-th best score so far.

A task keeps one trie of bounded size at a time and gives k documents an item; nothing is grouped
but these.  Corpus statistics cover all documents.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from storyspark.session import cut_lineage

#: Documents of a trie, and of a leaf that is scored at once.
BLOCK, LEAF = 8192, 64
#: Items that one pass over the documents looks for: bounds of their text and number, so that they can be broadcast.
PASS_BYTES, PASS_ITEMS = 4_000_000, 4096
#: Documents whose scores give the first thresholds (about; they only save work).
SEED_ROWS = 4096
#: Every ASCII byte but letters and digits separates terms; capitals are folded.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """Terms of a text as UTF-8: runs of ASCII letters and digits and of all other characters, A-Z lower-cased."""
    return (text or "").encode().translate(_FOLD).split()


def _rows(lists: Sequence[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(values of all lists, length of each)."""
    return np.frombuffer(b"".join(lists), kind), np.array([len(x) for x in lists], np.int64) // np.dtype(kind).itemsize


def restrict(docs: DataFrame, vocabulary: Sequence[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, terms, tfs) of the documents with a term: number of all terms, and places in ``vocabulary`` with their tf."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for batch in batches:
            owner, sizes, at, tfs = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                words = terms(text.as_py())
                if not words:
                    continue
                found = Counter(filter(place.__contains__, words))
                owner.append(i)
                sizes.append(len(words))
                at.append(np.fromiter(map(place.__getitem__, found), "<u4", len(found)).tobytes())
                tfs.append(np.fromiter(found.values(), "<u4", len(found)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(sizes, pa.int64()), pa.array(at, pa.binary()),
                                              pa.array(tfs, pa.binary())], ["id", "n", "terms", "tfs"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n long, terms binary, tfs binary")


@dataclass
class Corpus:
    """N documents with L terms; ``weight`` of each term of the vocabulary, and its ``rank`` by falling document frequency."""

    documents: int
    length: int
    weight: np.ndarray
    rank: np.ndarray

    @classmethod
    def of(cls, restricted: DataFrame, size: int) -> Corpus:
        """Statistics of all documents; tasks count on their own, and one row a term and task is summed."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df, documents, length = np.zeros(size, np.int64), 0, 0
            for batch in batches:
                df += np.bincount(_rows(batch.column(1).to_pylist(), "<u4")[0], minlength=size)
                documents += batch.num_rows
                length += sum(batch.column(0).to_pylist())
            held = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, -2, held], pa.int64()), pa.array(np.r_[documents, length, df[held]], pa.int64())], ["term", "n"])

        counted = dict(restricted.select("n", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect())
        documents, length = counted.pop(-1, 0), counted.pop(-2, 0)
        df = np.array([counted.get(t, 0) for t in range(size)], np.int64)
        weight = np.array([math.floor(1000 * math.log((2.0 * documents + 2.0) / (2.0 * d + 1.0))) for d in df.tolist()], np.int64).reshape(size)
        rank = np.empty(size, np.int64)
        rank[np.lexsort((np.arange(size), -df))] = np.arange(size)
        return cls(documents, length, weight, rank)

    def norms(self, n: np.ndarray) -> np.ndarray:
        """The length norm m of documents of ``n`` terms."""
        return 100 - 50 + (50 * n * self.documents) // self.length


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight one adds: grows with tf, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _most(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the largest value of each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.maximum.reduceat(value[order], first) if len(key) else value


class Tree:
    """Trie of a block of restricted documents.

    ``order`` lists the documents in trie order; a node is a run [start, end) of them.  A run that
    shares its leading terms is cut where the next term changes; small neighbours share a leaf.
    """

    def __init__(self, ranks: np.ndarray, tfs: np.ndarray, sizes: np.ndarray, m: np.ndarray, vocabulary: int):
        cuts = np.r_[0, np.cumsum(sizes)]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        sort = np.lexsort((ranks, owner))
        ranks, tfs = ranks[sort], tfs[sort]
        keys = [ranks[a:b].astype(">u4").tobytes() for a, b in itertools.pairwise(cuts.tolist())]
        self.order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        self.m = m[self.order]
        self._grow([keys[i] for i in self.order])
        place = np.empty(len(keys), np.int64)
        place[self.order] = np.arange(len(keys))
        at = place[owner]
        by_term = np.lexsort((at, ranks))
        self.docs, tf = at[by_term], tfs[by_term].astype(np.int64)
        self.doc_share = share(tf, self.m[self.docs])
        edges = np.arange(vocabulary + 1)
        self.doc_cuts = np.searchsorted(ranks[by_term], edges)
        self._climb(ranks, at, tfs.astype(np.int64), edges)

    def _grow(self, keys: list[bytes]) -> None:
        self.start, self.end, self.parent, self.depth, self.children = [], [], [], [], []

        def node(a: int, b: int, parent: int) -> int:
            self.start.append(a)
            self.end.append(b)
            self.parent.append(parent)
            self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(len(self.start) - 1)
            return len(self.start) - 1

        todo = [node(0, len(keys), -1)]
        while todo:
            at = todo.pop()
            a, b = self.start[at], self.end[at]
            if b - a <= LEAF or keys[a] == keys[b - 1]:
                continue
            low, high = keys[a], keys[b - 1]
            shared = next((i for i in range(0, len(low), 4) if low[i:i + 4] != high[i:i + 4]), len(low))
            runs, first = [], a
            for _, run in itertools.groupby(range(a, b), key=lambda i: keys[i][shared:shared + 4]):
                last = first + sum(1 for _ in run)
                if runs and last - runs[-1][0] <= LEAF:
                    runs[-1] = (runs[-1][0], last)
                else:
                    runs.append((first, last))
                first = last
            todo += [node(*run, at) for run in runs]
        self.start, self.end, self.parent, self.depth = (np.array(x, np.int64) for x in (self.start, self.end, self.parent, self.depth))

    def _climb(self, ranks: np.ndarray, at: np.ndarray, tfs: np.ndarray, edges: np.ndarray) -> None:
        """Largest tf of each term below each node, from the leaves up, as postings by term."""
        n = len(self.start)
        leaves = np.array(sorted((i for i in range(n) if not self.children[i]), key=self.start.__getitem__), np.int64)
        leaf = leaves[np.searchsorted(self.start[leaves], at, side="right") - 1] if len(at) else at
        key, most = _most(ranks * n + leaf, tfs)
        done = []
        for depth in range(int(self.depth.max()), -1, -1):
            here = self.depth[key % n] == depth
            own, top = _most(key[here], most[here])
            done.append((own, top))
            if depth:
                up = own - own % n + self.parent[own % n]
                key, most = np.r_[key[~here], up], np.r_[most[~here], top]
        key, most = np.concatenate([k for k, _ in done]), np.concatenate([t for _, t in done])
        order = np.argsort(key)
        key, most = key[order], most[order]
        least = np.array([self.m[a:b].min() for a, b in zip(self.start, self.end)], np.int64)
        self.nodes = key % n
        self.node_share = share(most, least[self.nodes])
        self.node_cuts = np.searchsorted(key // n, edges)

    def search(self, ranks: Sequence[int], weights: Sequence[int], least: int, offer) -> None:
        """Give ``offer`` the places and scores of all documents that can score ``least`` or more, leaf by leaf; it returns the new ``least``."""
        bound = np.zeros(len(self.start), np.int64)
        lists = []
        for rank, weight in zip(ranks, weights):
            a, b = self.node_cuts[rank], self.node_cuts[rank + 1]
            if a < b and weight:
                bound[self.nodes[a:b]] += weight * self.node_share[a:b]
                lists.append((self.docs[self.doc_cuts[rank]:self.doc_cuts[rank + 1]], self.doc_share[self.doc_cuts[rank]:self.doc_cuts[rank + 1]], weight))
        todo = [0]
        while todo:
            at = todo.pop()
            if bound[at] < least:
                continue
            if self.children[at]:
                todo += sorted(self.children[at], key=bound.__getitem__)  # the best one is on top
                continue
            start, end = self.start[at], self.end[at]
            score = np.zeros(end - start, np.int64)
            for docs, shares, weight in lists:
                a, b = docs.searchsorted((start, end))
                if a < b:
                    score[docs[a:b] - start] += weight * shares[a:b]
            good = np.flatnonzero(score >= least)
            if len(good):
                least = offer(good + start, score[good])


def search_block(found: dict[int, list[tuple]], ids: list, tree: Tree, items: Sequence[tuple[list[int], list[int]]], least: np.ndarray,
                 k: int) -> None:
    """Search one block for all items; ``found`` holds the k best (-score, id is null, id) of each item so far."""
    for i, (ranks, weights) in enumerate(items):
        best = found.setdefault(i, [])

        def offer(places: np.ndarray, scores: np.ndarray) -> int:
            names = [ids[d] for d in tree.order[places]]
            best.extend((-s, d is None, 0 if d is None else d) for s, d in zip(scores.tolist(), names))
            best.sort()
            del best[k:]
            return max(floor, -best[-1][0]) if len(best) == k else floor

        floor = max(1, int(least[i]), -best[-1][0] if len(best) == k else 1)
        tree.search(ranks, weights, floor, offer)


def _search(restricted: DataFrame, corpus: Corpus, items: Sequence[np.ndarray], k: int, least: np.ndarray) -> DataFrame:
    """(item, id, score): the k best documents of each item in each task, those that score ``least`` or more."""
    spark = restricted.sparkSession
    asked = [(corpus.rank[t].tolist(), corpus.weight[t].tolist()) for t in items]
    shared = spark.sparkContext.broadcast((corpus, asked, least))
    kind = to_arrow_type(restricted.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, asked, least = shared.value
        found: dict[int, list[tuple]] = {}
        rows: list[tuple] = []

        def close() -> None:
            ids, n, at, tf = zip(*rows)
            places, sizes = _rows(at, "<u4")
            tree = Tree(corpus.rank[places], _rows(tf, "<u4")[0], sizes, corpus.norms(np.array(n, np.int64)), len(corpus.rank))
            search_block(found, list(ids), tree, asked, least, k)
            rows.clear()

        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                rows += zip(*(c.to_pylist() for c in batch.slice(a, 1024).columns))
                if len(rows) >= BLOCK:
                    close()
        if rows:
            close()
        out = [(i, None if no_id else d, -s) for i, best in found.items() for s, no_id, d in best]
        columns = list(zip(*out)) if out else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], kind), pa.array(columns[2], pa.int64())], ["item", "id", "score"])

    id_kind = restricted.schema["id"].dataType.simpleString()
    return restricted.where(F.length("terms") > 0).mapInArrow(run, f"item int, id {id_kind}, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                   k: int = 50) -> DataFrame:
    """(item, rank, id, score): the ``k`` best documents with a score above 0 of each item, equal scores by smaller id (null ids last).

    N counts the documents with a term, L all their terms, n those of a document, df the documents
    that hold a term, tf its occurrences in a document.  A term weighs w = floor(1000 ln((2N + 2) /
    (2 df + 1))); m = 50 + 50 n N div L; a document scores the sum of w (10^9 tf div (1000 tf + 20 m))
    over the distinct terms of the item.  A null or empty text has no term: such documents count
    nowhere, such items give no row.  Each row of ``docs`` is a document of its own, also if it
    repeats an id or another row.  Items that agree in id and text are one item; those that share an
    id only are ranked on their own.  Empty tables give an empty result; other columns are not read.

    One pass over the documents looks for a bounded number of items; more items take more passes.
    Bounds never cut a document that belongs to the result.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).where("length(text) > 0").distinct()
    size, count = asked.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    passes = max(-(-(size or 0) // PASS_BYTES), -(-count // PASS_ITEMS))
    kinds = f"`{item_col}` {items.schema[item_col].dataType.simpleString()}, rank int, `{id_col}` {docs.schema[id_col].dataType.simpleString()}, score long"
    out = None
    for number in range(passes):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number).collect()
        one = _one_pass(docs, part, items.schema[item_col].dataType.simpleString(), id_col, text_col, item_col, k)
        out = one if out is None or one is None else out.unionByName(one)
    return spark.createDataFrame([], kinds) if out is None else out


def _one_pass(docs: DataFrame, items: list, item_kind: str, id_col: str, text_col: str, item_col: str, k: int) -> DataFrame | None:
    spark = docs.sparkSession
    spelled = [sorted(set(terms(r["text"]))) for r in items]
    vocabulary = sorted(set().union(*spelled))
    if not vocabulary:
        return None
    place = {t: i for i, t in enumerate(vocabulary)}
    wanted = [np.array([place[t] for t in s], np.int64) for s in spelled]
    restricted = cut_lineage(restrict(docs, vocabulary, id_col, text_col))
    corpus = Corpus.of(restricted, len(vocabulary))
    # any documents' k-th best score is one that the k-th best of all reaches
    some = max(1, corpus.documents // SEED_ROWS)
    seeds = _best(_search(restricted.where(F.pmod(F.xxhash64("id", "n"), F.lit(some)) == 0), corpus, wanted, k, np.zeros(len(wanted), np.int64)), k)
    least = np.zeros(len(wanted), np.int64)
    for row in seeds.where(F.col("rank") == k).select("item", "score").collect():
        least[row["item"]] = row["score"]
    found = _best(_search(restricted, corpus, wanted, k, least), k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], f"item int, `{item_col}` {item_kind}")
    return found.join(F.broadcast(names), "item").select(item_col, "rank", F.col("id").alias(id_col), "score")
