"""Quality rules: fixed base rules, then an isolation forest on the rule statistics.

Statistics of whole texts feed a forest of random splits, grown on a bounded sample of labelled
rows that pass the base rules.  Rows that few splits set apart are anomalous; labelled rows
calibrate from which path score on a document is rejected.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyspark.llm.common import SPACES, class_labels, hash_sample, written

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Bytes of a text that are split into words at a time, at least.
PIECE = 1 << 20
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")
_WORD = re.compile(rf"[^{SPACES}]")


def rule_statistics(text: str) -> tuple[int, int, int, int, int]:
    """Words, characters in words, symbols, repeated lines, words in repeated windows of eight."""
    words = word_numbers(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if _WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


def word_numbers(text: str) -> np.ndarray:
    """Number of each word, equal words alike; a long text is split piece by piece, so that its words are never objects all at once."""
    data = text.encode()
    number: dict[bytes, int] = {}
    found = array("i")
    start = 0
    while start < len(data):
        stop = start + PIECE
        if stop < len(data):  # up to the next space, so that no word is cut
            space = _SPACE.search(data, stop)
            stop = space.end() if space else len(data)
        found.extend([number.setdefault(w, len(number)) for w in data[start:stop].split()])
        start = stop
    return np.frombuffer(found, np.int32) if found else np.zeros(0, np.int32)


def _pair_numbers(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of each pair, equal pairs alike."""
    key = left.astype(np.int64) * (int(right.max()) + 1) + right
    return np.unique(key, return_inverse=True)[1].astype(np.int32)


def repeated_words(words: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` (a power of two) words found twice or more, the first one included.

    Windows are numbered by doubling: pairs of words, pairs of those, and so on; equal numbers are equal windows.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n].astype(np.uint64)
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():  # different hashes: no window repeats
        return 0
    del mixed
    size = 1
    while size < window:
        words = _pair_numbers(words[:-size], words[size:])
        size *= 2
    twice = np.flatnonzero(np.bincount(words)[words] > 1)
    covered = np.zeros(n + window, np.int32)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + window, -1)
    return int(np.count_nonzero(np.cumsum(covered)))


def base_failed(n_words, n_repeat_words):
    """Fixed base rules: under 20 words, or over 30 percent of the words in repeated windows."""
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def features(stats: np.ndarray) -> np.ndarray:
    """Forest inputs of rows of STATS: log size, mean word length, log share of symbols, log repeated lines, repeated share."""
    s = stats.astype(float)
    n = np.maximum(s[:, 0], 1)
    return np.column_stack([np.log1p(s[:, 0]), s[:, 1] / n, np.log1p(100 * s[:, 2] / n), np.log1p(s[:, 3]), s[:, 4] / n])


def _expected_path(n):
    """Mean path of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Isolation forest: flat trees with a split (feature, value) or, at leaves, the path length."""

    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    norm: float = 1.0
    threshold: float = float("inf")

    @classmethod
    def fit(cls, rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = 128, sample: int = 256, seed: int = 7) -> Forest:
        """Trees on random samples of ``rows``; splits fall anywhere in the box from ``low`` to ``high``.

        Since a cell, not the rows in it, bounds a split, a split next to a tight group still
        parts it from the empty space, and a row out there ends after few of them.
        """
        rng = np.random.default_rng(seed)
        sample = min(sample, len(rows))
        depth = int(np.ceil(np.log2(max(sample, 2))))
        grown = [cls._grow(rows[rng.choice(len(rows), sample, replace=False)], depth, rng, low, high) for _ in range(trees)]
        return cls(grown, float(_expected_path(sample)) or 1.0)

    @staticmethod
    def _grow(rows: np.ndarray, depth: int, rng, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        feature, value, left, path = [], [], [], []

        def node() -> int:
            for column, zero in ((feature, -1), (value, 0.0), (left, 0), (path, 0.0)):
                column.append(zero)
            return len(feature) - 1

        todo = [(node(), rows, 0, low, high)]
        while todo:
            at, own, level, low, high = todo.pop()
            wide = np.flatnonzero(high > low) if level < depth and len(own) > 1 else []
            if not len(wide):
                path[at] = level + float(_expected_path(len(own)))
                continue
            f = int(rng.choice(wide))
            feature[at], value[at] = f, rng.uniform(low[f], high[f])
            left[at] = node()
            node()  # the right child follows the left one
            below = own[:, f] < value[at]
            top, bottom = high.copy(), low.copy()
            top[f] = bottom[f] = value[at]
            todo += [(left[at], own[below], level + 1, low, top), (left[at] + 1, own[~below], level + 1, bottom, high)]
        return np.array(feature), np.array(value), np.array(left), np.array(path)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1): 2 to the minus mean path over the expected path."""
        if not self.trees:
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, value, left, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            open_ = every
            while len(open_):
                f = feature[at[open_]]
                open_, f = open_[f >= 0], f[f >= 0]
                here = at[open_]
                at[open_] = left[here] + (rows[open_, f] >= value[here])
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / self.norm)


def calibrated(rows: np.ndarray, labels: np.ndarray, clean_loss: float, **fit) -> Forest:
    """Forest grown on the rows labelled 1, in the box of all rows, with the threshold that catches
    most rows labelled 0 among those that reject at most ``clean_loss`` of the rows labelled 1.

    Without rows of both labels nothing can be calibrated: the forest then rejects nothing.
    """
    if not (labels == 0).any() or not (labels == 1).any():
        return Forest()
    forest = Forest.fit(rows[labels == 1], rows.min(0), rows.max(0), **fit)
    score = forest.score(rows)
    clean, junk = np.sort(score[labels == 1]), score[labels == 0]
    spare = int(clean_loss * len(clean))
    lowest = clean[len(clean) - 1 - spare]  # rejecting above it loses ``spare`` clean rows at most
    above = junk[junk > lowest]
    # halfway to the least junk score above: room for clean rows that the sample does not hold
    forest.threshold = float((lowest + above.min()) / 2) if len(above) else float("inf")
    return forest


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) per row; a null text has no words."""
    return _with_statistics(docs, id_col, text_col, None)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str | None = "text", trees: int = 128, sample: int = 256, clean_loss: float = 0.002) -> Forest:
    """``calibrated`` over all labelled rows that pass the base rules; without a ``text_col``, ``docs`` are rows of ``statistics``.

    The box, the counts and the threshold come from every such row, in Spark.  As the method has it, each tree grows
    on ``sample`` rows labelled 1; the driver holds those of all trees, drawn by hash from all, and nothing else.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), *(STATS if text_col is None else [F.col(text_col).alias("text")]))
    stats = (rows if text_col is None else statistics(rows)).where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    # five numbers a row: they, not the texts, travel to the labels, and are read for the box, the trees and the scores
    stats = written(stats.join(class_labels(labels, "quality"), "doc_id"))
    points = _with_features(stats)
    names = [f"f{i}" for i in range(len(STATS))]
    box = points.agg(F.count_if(F.col("label") == 1).alias("clean"), F.count_if(F.col("label") == 0).alias("junk"),
                     *[F.min(n) for n in names], *[F.max(n) for n in names]).first()
    if not box["clean"] or not box["junk"]:
        return Forest()
    low, high = np.array(box[2:2 + len(names)]), np.array(box[2 + len(names):])
    grown = hash_sample(stats.where("label = 1"), trees * sample, ["doc_id", *STATS]).orderBy("doc_id", *STATS).select(*STATS).toPandas().to_numpy()
    forest = Forest.fit(features(grown), low, high, trees, sample)
    scores = written(_with_features(stats, forest).select("label", "score"))
    spare = int(clean_loss * box["clean"])  # rejecting above the next score loses as many clean rows at most
    lowest = scores.where("label = 1").orderBy(F.desc("score")).offset(spare).first()["score"]
    above = scores.where((F.col("label") == 0) & (F.col("score") > lowest)).agg(F.min("score")).first()[0]
    forest.threshold = (lowest + above) / 2 if above is not None else float("inf")
    return forest


def _with_features(stats: DataFrame, forest: Forest | None = None) -> DataFrame:
    """(label, f0, f1 ..., score) of rows of statistics; without a forest the score is null."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = features(np.column_stack([batch.column(c).to_numpy() for c in STATS]))
            score = pa.nulls(len(own), pa.float64()) if shared.value is None else pa.array(shared.value.score(own))
            yield pa.RecordBatch.from_arrays([batch.column("label"), *map(pa.array, own.T.copy()), score], ["label", *names, "score"])

    names = [f"f{i}" for i in range(len(STATS))]
    return stats.mapInArrow(run, "label int, " + ", ".join(f"{n} double" for n in names) + ", score double")


def judge(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str | None = "text", keep: list[str] | None = None) -> DataFrame:
    """Statistics of each row with ``base_failed``, ``anomaly`` (path score) and ``kept``; without a ``text_col``, ``docs`` hold them already.

    Every row of ``docs`` gives one row, with the columns of ``keep`` as they are.  A null text has
    no words and so fails the base rules, as does an empty one; repeated rows are judged alike.
    """
    return _with_statistics(docs, id_col, text_col, docs.sparkSession.sparkContext.broadcast(forest), keep or [])


def _with_statistics(docs, id_col, text_col, forest, keep=()):
    # the text travels first under a name of its own, so that it may also be among the kept columns
    read = STATS if text_col is None else [F.col(text_col).alias("__text")]
    width = len(read)
    names = [id_col, *[c for c in keep if c != id_col], *STATS] + (["base_failed", "anomaly", "kept"] if forest else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if text_col is None:
                stats = np.column_stack([c.to_numpy() for c in batch.columns[:width]])
            else:
                stats = np.array([rule_statistics(t.as_py() or "") for t in batch.column(0)], np.int64).reshape(-1, len(STATS))
            columns = [*batch.columns[width:], *[pa.array(c) for c in stats.T]]
            if forest:
                failed = base_failed(stats[:, 0], stats[:, 4])
                score = forest.value.score(features(stats))
                columns += [pa.array(failed), pa.array(score), pa.array(~failed & (score <= forest.value.threshold))]
            yield pa.RecordBatch.from_arrays(columns, names)

    carried = [id_col, *[c for c in keep if c != id_col]]
    kinds = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried), *(f"{c} long" for c in STATS)])
    return docs.select(*read, *carried).mapInArrow(
        run, kinds + (", base_failed boolean, anomaly double, kept boolean" if forest else ""))


def passing(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` would keep, with their columns; only the text goes to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("boolean")
    def verdict(texts: pd.Series) -> pd.Series:
        stats = np.array([rule_statistics(t or "") for t in texts], np.int64).reshape(-1, len(STATS))
        return pd.Series(~base_failed(stats[:, 0], stats[:, 4]) & (shared.value.score(features(stats)) <= shared.value.threshold))

    return docs.where(verdict(F.col(f"`{text_col}`")))
