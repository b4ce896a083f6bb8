"""MinHash near-dedup of multisets: weighted signatures, banding, exact verification.

Documents are multisets of five-word shingles.  For every shingle and weight interval a Poisson
process on (time, weight) is drawn from hashes; a point counts for a document if its weight
coordinate lies below the shingle's count there.  The first point of each signature component is
then equal in two documents with the probability of their weighted Jaccard similarity.  Points are
drawn in order of time and only as far as the components need (BagMinHash).  Equal documents are
one row before banding; banded pairs are verified on the multisets, and classes are the connected
components of verified pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyspark.llm.common import SPACES
from storyspark.llm.components import contract
from storyspark.session import cut_lineage

SHINGLE = 5
#: Components of a signature are BANDS times ROWS; at similarity 0.8 a pair is missed with probability (1 - 0.8**4)**32 < 1e-7.
BANDS, ROWS = 32, 4
#: Texts on each side of a cell in which pairs of different classes are compared.
CELL_TEXTS = 256
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser, element by element."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] from 64 bits."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the words (runs of bytes other than white space) in a byte buffer.

    The hash of a word is a polynomial in random values of its bytes, from prefix sums of the buffer.
    """
    space = np.isin(np.arange(256), np.frombuffer(SPACES.encode(), np.uint8))[data]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, _U), start
    values = _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
    offset = np.arange(len(data)) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(data)]])))
    longest = int((end - start).max())
    powers = np.multiply.accumulate(np.full(longest, 0xD1342543DE82EF95, _U))
    terms = np.where(space, _U(0), values[data] * powers[np.minimum(offset, longest - 1)])
    return _mix(np.add.reduceat(terms, start) ^ (end - start).astype(_U)), start


def shingle_bags(texts: Sequence[bytes], width: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted distinct shingle hashes, counts) per text; a text of fewer words is one shingle, one without words none."""
    size = np.array([len(t) + 1 for t in texts], np.int64)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    hashes, start = word_hashes(data)
    bounds = np.searchsorted(start, np.concatenate([[0], np.cumsum(size)]))
    out = []
    for a, b in zip(bounds, bounds[1:]):
        h, n = hashes[a:b], max(b - a - width + 1, min(b - a, 1))
        mixed = np.zeros(n, _U)
        for k in range(min(width, b - a)):
            mixed = mixed * _U(0x9E3779B97F4A7C15) + h[k:k + n]
        out.append(np.unique(_mix(mixed), return_counts=True))
    return out


def signatures(bags: Sequence[tuple[np.ndarray, np.ndarray]], size: int = BANDS * ROWS) -> np.ndarray:
    """One row of ``size`` 64-bit point names per bag; bags must not be empty.

    Weights are split at the powers of two: [0, 1), [1, 2), [2, 4), ...; each interval of each
    shingle has its own process, of a rate equal to its width.  A process that reaches beyond the
    weight is thinned: points above the weight do not count.  The horizon of time grows until every
    component has a point; all points before it are then known, so the first one is final.
    """
    owner = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    item = np.concatenate([h for h, _ in bags])
    weight = np.concatenate([c for _, c in bags]).astype(np.int64)
    total = np.bincount(owner, weight.astype(float), len(bags))
    levels = int(weight.max()).bit_length() + 1
    parts = []
    for level in range(levels):  # interval [low, low + width) of the weights
        low, width = (0, 1) if level == 0 else (1 << level - 1, 1 << level - 1)
        here = np.flatnonzero(weight > low)
        if len(here):
            parts.append((owner[here], _mix(item[here] + _U(level * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)), weight[here] - low, np.full(len(here), width)))
    owner, seed, room, width = (np.concatenate(c) for c in zip(*parts))
    first = np.full(len(bags) * size, np.inf)
    name = np.zeros(len(bags) * size, _U)
    horizon = size * (np.log(size) + 2.0) / total  # about two components in fifteen texts stay open
    time, count = np.zeros(len(seed)), np.zeros(len(seed), _U)
    ahead = -np.log(_unit(_mix(seed ^ _mix(count + _U(1))))) / width  # time of the next point of each process
    time = ahead
    todo = np.arange(len(seed))
    while len(todo):
        active = todo
        while len(active):
            active = active[time[active] <= horizon[owner[active]]]
            if not len(active):
                break
            point = _mix(seed[active] + (count[active] + _U(1)) * _U(0xA0761D6478BD642F))
            inside = (_unit(_mix(point ^ _U(0x8EBC6AF09C88C6E3))) * width[active]) <= room[active]
            slot = owner[active] * size + (_mix(point ^ _U(0x589965CC75374CC3)) % _U(size)).astype(np.int64)
            s, t, p = slot[inside], time[active][inside], point[inside]
            order = np.lexsort((p, t, s))
            s, t, p = s[order], t[order], p[order]
            lead = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
            s, t, p = s[lead], t[lead], p[lead]
            better = t < first[s]
            first[s[better]], name[s[better]] = t[better], p[better]
            count[active] += _U(1)
            time[active] += -np.log(_unit(_mix(seed[active] ^ _mix(count[active] + _U(1))))) / width[active]
        open_ = np.isinf(first.reshape(-1, size)).any(1)
        horizon = np.where(open_, 2 * horizon, horizon)
        todo = np.flatnonzero(open_[owner])
    return name.reshape(-1, size)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band of each signature row."""
    rows = signature.reshape(len(signature), bands, -1)
    key = np.zeros(rows.shape[:2], _U)
    for k in range(rows.shape[2]):
        key = _mix(key * _U(0x9E3779B97F4A7C15) + rows[:, :, k])
    return key.astype(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags: sum of the lesser counts over the sum of the greater."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    union = int(a[1].sum() + b[1].sum()) - both
    return both / union if union else 1.0


def _texts(column: pa.Array, chars: int = 2_000_000) -> Iterator[list[bytes]]:
    group, size = [], 0
    for text in column:
        group.append((text.as_py() or "").lower().encode())
        size += len(group[-1])
        if size > chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in short slices: what becomes Python objects at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``kid`` and ``tk``: what tells rows apart (id as text, hash of the text), null ids and texts included."""
    return docs.withColumns({"kid": F.coalesce(F.col(id_col).cast("string"), F.lit("\0")), "tk": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kid, tk, node, n_shingles, bands) per row: digest of the words, size of the multiset, band keys (none without words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _texts(batch.column(3)):
                bags = shingle_bags(texts)
                full = [i for i, (h, _) in enumerate(bags) if len(h)]
                keys = np.zeros((len(texts), BANDS), np.int64)
                if full:
                    keys[full] = _salted(band_keys(signatures([bags[i] for i in full])))
                lengths = np.zeros(len(texts) + 1, np.int32)
                lengths[1:][full] = BANDS
                bands = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths).astype(np.int32)), pa.array(keys[full].ravel()))
                node = pa.array([hashlib.md5(b" ".join(t.split())).digest() for t in texts], pa.binary())
                size = pa.array([int(c.sum()) for _, c in bags], pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(texts)) for c in batch.columns[:3]), node, size, bands],
                                                 ["id", "kid", "tk", "node", "n_shingles", "bands"])
                at += len(texts)

    slim = text_key(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text").select("id", "kid", "tk", "text")
    return slim.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, kid string, tk long, node binary, n_shingles long, bands array<long>")


def _salted(keys: np.ndarray) -> np.ndarray:
    """Band keys that differ between bands, so that one column names a bucket."""
    return _mix(keys.astype(_U) ^ (np.arange(keys.shape[1], dtype=_U) * _U(0xD6E8FEB86659FD93))).astype(np.int64)


def _bags(docs: DataFrame, wanted: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(nid, items, counts) of the ``wanted`` (nid, kid, tk); arrays travel as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _texts(batch.column(1)):
                bags = shingle_bags(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([h.tobytes() for h, _ in bags], pa.binary()),
                                                  pa.array([c.astype(np.int32).tobytes() for _, c in bags], pa.binary())], ["nid", "items", "counts"])
                at += len(texts)

    texts = text_key(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    one = texts.join(wanted, ["kid", "tk"]).select("nid", "text")
    return one.mapInArrow(run, "nid long, items binary, counts binary").dropDuplicates(["nid"])


def _verified(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) of texts whose multisets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            cells = [c.to_pylist() for c in batch.columns[2:]]
            bag = lambda items, counts: (np.frombuffer(items, _U), np.frombuffer(counts, np.int32))
            ok = [overlap(bag(ia, ca), bag(ib, cb)) >= similarity for ia, ca, ib, cb in zip(*cells)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    side = lambda k: bags.select(F.col("nid").alias(k), F.col("items").alias(f"items_{k}"), F.col("counts").alias(f"counts_{k}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "items_a", "counts_a", "items_b", "counts_b")
    return both.mapInArrow(run, "a long, b long")


def _shared_sizes(bags: DataFrame, open_: DataFrame) -> DataFrame:
    """(nid, private) of the ``open_`` texts: how much of a multiset lies in shingles that no other open text has (no row if nothing)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            nids, items, counts = (c.to_pylist() for c in batch.columns)
            item = np.frombuffer(b"".join(items), np.int64)
            owner = np.repeat(np.array(nids, np.int64), [len(i) // 8 for i in items])
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(owner), pa.array(np.frombuffer(b"".join(counts), np.int32))], ["item", "nid", "n"])

    items = bags.join(open_, "nid", "left_semi").select("nid", "items", "counts").mapInArrow(run, "item long, nid long, n int")
    alone = items.groupBy("item").agg(F.min("nid").alias("nid"), F.max("nid").alias("last"), F.min("n").alias("n")).where("nid = last")
    return alone.groupBy("nid").agg(F.sum("n").alias("private"))


def _cell_links(cells: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that join classes, found among the texts of each cell (family, low, high).

    A pair is compared if it shares a bucket, its classes differ and the sizes allow the similarity:
    the overlap is at most the lesser of the parts that are not private.
    """
    def compare(rows: list, low: int, high: int) -> Iterator[tuple[int, int]]:
        left, right = [r for r in rows if r[1] == low], [r for r in rows if r[1] == high]
        if not left or not right:
            return
        column = lambda side, k: np.array([r[k] for r in side])
        n_a, n_b = column(left, 3)[:, None], column(right, 3)[None, :]
        q = np.minimum(column(left, 4)[:, None], column(right, 4)[None, :])
        maybe = (column(left, 2)[:, None] != column(right, 2)[None, :]) & (q >= similarity / (1 + similarity) * (n_a + n_b) - 1e-9)
        if low == high:
            maybe &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
        bands_a, bands_b = np.stack([r[5] for r in left]), np.stack([r[5] for r in right])
        sets: dict[int, frozenset] = {}
        parent: dict[int, int] = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for i in np.flatnonzero(maybe.any(1)):
            near = np.flatnonzero(maybe[i])
            near = near[(bands_b[near] == bands_a[i]).any(1)]
            for j in near:
                a, b = left[i], right[j]
                root_a, root_b = find(a[2]), find(b[2])
                if root_a == root_b:
                    continue
                x, y = (sets.get(r[0]) or sets.setdefault(r[0], _leveled(r[6], r[7])) for r in (a, b))
                both = len(x & y)
                if both >= similarity * (len(x) + len(y) - both):
                    parent[root_a] = root_b
                    yield a[0], b[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def close() -> pa.RecordBatch:
            found = list(compare(rows, *now[1:])) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in _slices(batches):
            for family, low, high, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (family, low, high) != now:
                    if now:
                        yield close()
                    now, rows = (family, low, high), []
                row[5] = np.array(row[5], np.int64)
                rows.append(row)
        if now:
            yield close()

    key = ["family", "low", "high"]
    dealt = cells.select(*key, "nid", "block", "root", "n_shingles", "shared_size", "bands", "items", "counts").repartition(*key).sortWithinPartitions(*key, "nid")
    return dealt.mapInArrow(run, "a long, b long")


def _leveled(items: bytes, counts: bytes) -> frozenset:
    """The multiset as a set: the k-th copy of an item is an element of its own."""
    items, counts = np.frombuffer(items, _U), np.frombuffer(counts, np.int32)
    out = set(items.tolist())
    for k in range(1, int(counts.max(initial=1))):
        out.update(_mix(items[counts > k] + _U(k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)).tolist())
    return frozenset(out)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """(id, tk, class_id, n_copies, kept) per row of ``docs``.

    Words are runs of anything but white space, in lower case.  Rows with equal words are copies;
    texts without a word (null or empty) are copies of each other.  Texts link if the weighted
    Jaccard similarity of their multisets of five-word shingles is ``similarity`` or more (a text
    of fewer words is one shingle).  ``class_id`` is the least id in the connected component (null
    ids come last), ``n_copies`` counts the rows with the row's words.  ``kept`` marks the least
    (id, text hash ``tk``) of each class; rows that repeat both are marked alike.  Other columns are
    not read.  An empty table gives an empty one.

    No pair is made within a group of copies.  In each bucket every text is first paired with one
    leader.  Buckets whose texts then lie in one class are done, since no further link can change
    it.  Of the texts in the other buckets, those with too many shingles of their own to be similar
    to any are done as well (an exact bound).  The rest is dealt by families (texts tied by shared
    buckets) to cells of about 2 * CELL_TEXTS texts, which compare what shares a bucket and return the
    links that join classes; so pairs are never rows of a table there.
    """
    rows = cut_lineage(signed(docs, id_col, text_col))
    texts = cut_lineage(rows.groupBy("node").agg(F.count("*").alias("n_copies"), F.min(F.struct("kid", "tk")).alias("one"), F.first("n_shingles").alias("n_shingles"),
                                                 F.first("bands").alias("bands")).withColumn("nid", F.monotonically_increasing_id()))
    banded = texts.select("nid", F.explode("bands").alias("bucket"))
    # tables of their own, here and below, so that the joins can split a large bucket or class
    buckets = cut_lineage(banded.groupBy("bucket").agg(F.min("nid").alias("lead"), F.max("nid").alias("last")).where("lead <> last"))
    shared = cut_lineage(banded.join(buckets.select("bucket", "lead"), "bucket"))
    star = cut_lineage(shared.where("nid <> lead").select(F.col("lead").alias("a"), F.col("nid").alias("b")).distinct())
    named = star.select(F.col("a").alias("nid")).unionByName(star.select(F.col("b").alias("nid"))).distinct()
    bags = cut_lineage(_bags(docs, named.join(texts.select("nid", "one.kid", "one.tk"), "nid"), text_col, id_col))
    links = cut_lineage(_verified(star, bags, similarity))
    links = links.unionByName(_across(texts, shared.select("bucket", "nid"), bags, contract(links), similarity))
    roots = contract(links).join(texts.select(F.col("nid").alias("root"), F.col("node").alias("root_node")), "root")
    named = texts.select("nid", "node", "n_copies").join(roots.withColumnRenamed("node", "nid"), "nid", "left")
    classes = rows.select("id", "tk", "node").join(named.select("node", "n_copies", F.coalesce("root_node", "node").alias("root")), "node")
    first = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("tk").alias("tk"))
    heads = cut_lineage(classes.groupBy("root").agg(F.min(first).alias("head")))
    return classes.join(heads, "root").select(F.col("id").alias(id_col), "tk", F.col("head.id").alias("class_id"), "n_copies",
                                              (F.col("id").eqNullSafe(F.col("head.id")) & (F.col("tk") == F.col("head.tk"))).alias("kept"))


def _across(texts: DataFrame, shared: DataFrame, bags: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that join the classes ``roots`` of texts that share a bucket."""
    placed = shared.join(roots.withColumnRenamed("node", "nid"), "nid", "left").select("bucket", "nid", F.coalesce("root", "nid").alias("root"))
    several = lambda df: df.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    open_ = cut_lineage(placed.join(several(placed), "bucket"))
    sizes = texts.join(_shared_sizes(bags, open_.select("nid").distinct()), "nid", "left").select(
        "nid", "n_shingles", (F.col("n_shingles") - F.coalesce("private", F.lit(0))).alias("shared_size"), "bands")
    live = open_.join(sizes.where(F.col("shared_size") >= similarity * F.col("n_shingles") - 1e-9).select("nid"), "nid")
    live = cut_lineage(live.join(several(live), "bucket"))
    leads = live.groupBy("bucket").agg(F.min("nid").alias("lead"))
    families = contract(live.join(leads, "bucket").select(F.col("lead").alias("a"), F.col("nid").alias("b"))).withColumnsRenamed({"node": "nid", "root": "family"})
    blocks = families.groupBy("family").agg(F.ceil(F.count("*") / CELL_TEXTS).alias("blocks"))
    member = families.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("nid"), F.col("blocks")))
    dealt = member.select("family", "nid", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k"))
    cells = dealt.select("family", "nid", "block", F.least("block", "k").alias("low"), F.greatest("block", "k").alias("high"))
    root = live.select("nid", "root").distinct()
    return cut_lineage(_cell_links(cells.join(root, "nid").join(sizes, "nid").join(bags, "nid"), similarity))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each near-duplicate class, the one ``near_duplicates`` marks as kept; all columns stay."""
    found = near_duplicates(docs, id_col, text_col, similarity).where("kept")
    keep = found.select(F.coalesce(F.col(id_col).cast("string"), F.lit("\0")).alias("kid"), "tk").distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("\0")).alias("kid"),
                         F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("tk"))
    # the join leaves the rows of one (kid, tk) together, so this costs no shuffle of its own
    one = packed.join(keep, ["kid", "tk"]).dropDuplicates(["kid", "tk"])
    return one.select(*[F.col("row")[c].alias(c) for c in docs.columns])
