"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters slide over the UTF-8 bytes of the whole text.  Their responses are max-pooled in
overlapping chunks, the chunk vectors are averaged and max-pooled over the document, and a logistic
unit turns both into one probability.  Training runs on a bounded sample of labelled rows in the
driver; scoring streams every document through the filters in blocks of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.llm.common import class_labels, hash_sample

WIDTH = 6
#: Positions per cell; a chunk is two neighbouring cells, so chunks overlap by half.
CELL = 128
#: Cells whose responses are held at once while scoring.
BLOCK_CELLS = 512


@dataclass
class Layout:
    """Texts as one byte buffer: each is padded with zeros to whole cells, so that windows start at its own bytes only and end in its own padding."""

    data: np.ndarray
    valid: np.ndarray
    cells: np.ndarray  # cells of each text

    @classmethod
    def of(cls, texts: Sequence[bytes]) -> Layout:
        size = np.array([len(t) for t in texts], np.int64)
        cells = -(-(np.maximum(size, 1) + WIDTH - 1) // CELL)
        start = np.concatenate([[0], np.cumsum(cells)]) * CELL
        data = np.zeros(start[-1] + WIDTH, np.uint8)
        valid = np.zeros(start[-1], bool)
        for t, n, s in zip(texts, size, start):
            data[s:s + n] = np.frombuffer(t, np.uint8)
            valid[s:s + max(n, 1)] = True  # an empty text has one window, of zeros
        return cls(data, valid, cells)

    def chunk_cells(self) -> tuple[np.ndarray, np.ndarray]:
        """First cell of each chunk, and whether the next cell belongs to it; a text of one cell is one chunk."""
        last = np.zeros(int(self.cells.sum()), bool)
        last[np.cumsum(self.cells) - 1] = True
        alone = np.repeat(self.cells == 1, self.cells)
        first = np.flatnonzero(~last | alone)
        return first, ~alone[first]

    def chunks(self) -> np.ndarray:
        return np.maximum(self.cells - 1, 1)


@dataclass
class Network:
    """``taps[k]`` maps the byte at offset k to its part in each filter's response."""

    taps: np.ndarray  # WIDTH x 256 x filters
    bias: np.ndarray
    mean_weight: np.ndarray
    max_weight: np.ndarray
    offset: float
    prior: float = 0.0

    @classmethod
    def start(cls, filters: int, rng) -> Network:
        return cls(rng.normal(0, 0.3, (WIDTH, 256, filters)).astype(np.float32), np.zeros(filters, np.float32),
                   rng.normal(0, 0.1, filters), rng.normal(0, 0.1, filters), 0.0)

    def pairs(self) -> list[np.ndarray]:
        """Taps of two neighbouring bytes as one table each: half the look-ups."""
        return [(self.taps[k][:, None, :] + self.taps[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, WIDTH, 2)]

    def pool(self, layout: Layout, pairs: list[np.ndarray], places: bool = False):
        """Largest response of each filter in each cell, and its position if ``places``."""
        n, filters = len(layout.valid), len(self.bias)
        best = np.empty((n // CELL, filters), np.float32)
        where = np.empty((n // CELL, filters), np.int64) if places else None
        step = BLOCK_CELLS * CELL
        for a in range(0, n, step):
            b = min(a + step, n)
            d = layout.data[a:b + WIDTH].astype(np.int32)
            two = d[:-1] * 256 + d[1:]
            r = pairs[0].take(two[:b - a], 0)
            for i, table in enumerate(pairs[1:], 1):
                r += table.take(two[2 * i:2 * i + b - a], 0)
            r[~layout.valid[a:b]] = -np.inf
            r = r.reshape(-1, CELL, filters)
            if places:
                at = r.argmax(1)
                where[a // CELL:b // CELL] = at + np.arange(a, b, CELL)[:, None]
                best[a // CELL:b // CELL] = np.take_along_axis(r, at[:, None, :], 1)[:, 0]
            else:
                best[a // CELL:b // CELL] = r.max(1)
        return best, where

    def logits(self, texts: Sequence[bytes], pairs: list[np.ndarray]) -> np.ndarray:
        layout = Layout.of(texts)
        best, _ = self.pool(layout, pairs)
        first, two = layout.chunk_cells()
        chunk = np.maximum(best[first], best[np.where(two, first + 1, first)])
        hidden = np.tanh(chunk + self.bias)
        starts = np.concatenate([[0], np.cumsum(layout.chunks())[:-1]])
        mean = np.add.reduceat(hidden, starts) / layout.chunks()[:, None]
        top = np.maximum.reduceat(hidden, starts)
        # row by row: the last bits of a matrix product depend on the other rows
        return (mean * self.mean_weight).sum(1) + (top * self.max_weight).sum(1) + self.offset + self.prior

    def gradients(self, texts: Sequence[bytes], target: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss, in the order taps, bias, mean_weight, max_weight, offset."""
        layout = Layout.of(texts)
        best, where = self.pool(layout, self.pairs(), places=True)
        first, two = layout.chunk_cells()
        second = np.where(two, first + 1, first)
        right = best[second] > best[first]
        place = np.where(right, where[second], where[first])
        hidden = np.tanh(np.maximum(best[first], best[second]) + self.bias)
        chunks = layout.chunks()
        owner = np.repeat(np.arange(len(texts)), chunks)
        starts = np.concatenate([[0], np.cumsum(chunks)[:-1]])
        mean, top = np.add.reduceat(hidden, starts) / chunks[:, None], np.maximum.reduceat(hidden, starts)
        logit = mean @ self.mean_weight + top @ self.max_weight + self.offset
        error = (1 / (1 + np.exp(-logit)) - target) / len(texts)
        is_top = (hidden == top[owner]).astype(float)
        is_top /= np.add.reduceat(is_top, starts)[owner]  # chunks that share the largest cell share its gradient
        back = error[owner, None] * (self.mean_weight / chunks[owner, None] + self.max_weight * is_top) * (1 - hidden**2)
        taps = np.zeros_like(self.taps)
        filters = np.broadcast_to(np.arange(hidden.shape[1]), place.shape)
        for k in range(WIDTH):
            np.add.at(taps[k], (layout.data[place + k], filters), back)
        return [taps, back.sum(0), error @ mean, error @ top, error.sum()]


def train(texts: Sequence[bytes], labels: np.ndarray, prior: float = 0.0, filters: int = 16, epochs: int = 12, batch: int = 32, rate: float = 0.01,
          decay: float = 1e-4, seed: int = 5) -> Network:
    """Network fitted by Adam on balanced classes; ``prior`` is the log odds that the balance took away."""
    rng = np.random.default_rng(seed)
    net = Network.start(filters, rng)
    names = ["taps", "bias", "mean_weight", "max_weight", "offset"]
    moments = {n: [0.0, 0.0] for n in names}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            take = order[a:a + batch]
            step += 1
            lr = rate * (1 - epoch / epochs)
            for name, g in zip(names, net.gradients([texts[i] for i in take], labels[take])):
                m = moments[name]
                if name != "offset":
                    g = g + decay * getattr(net, name)
                m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
                change = lr * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
                value = getattr(net, name) - change
                setattr(net, name, value.astype(np.float32) if name in ("taps", "bias") else value)
    net.prior = prior
    return net


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from; a null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = 800,
        max_bytes: int = 20_000) -> Network | None:
    """Network of a bounded sample: per label, the ``per_class`` rows of least hash that are not held out,
    among texts of at most ``max_bytes`` (the bound of the driver's memory is the product of both).

    None where the labels do not hold both classes: nothing can be learned.
    """
    known = class_labels(labels, target).where(~held_out(F.col("doc_id")))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    # twice the rows, since some texts may be too long; still a fixed bound, so safe to broadcast
    wanted = None
    for label in (0, 1):
        part = hash_sample(known.where(F.col("label") == label), 2 * per_class, ["doc_id"])
        wanted = part if wanted is None else wanted.unionByName(part)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = (docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).where(F.octet_length("text") <= max_bytes)
            .join(F.broadcast(wanted), "doc_id"))
    got = []
    for label in (0, 1):
        got += hash_sample(rows.where(F.col("label") == label), per_class, ["doc_id", "text"]).collect()
    got.sort(key=lambda r: (r["doc_id"], r["text"]))
    if len({r["label"] for r in got}) < 2:
        return None
    picked = np.array([r["label"] for r in got], float)
    odds = np.log(counts[1] / counts[0]) - np.log(picked.sum() / (len(picked) - picked.sum()))
    return train([r["text"].encode() for r in got], picked, float(odds))


def probabilities(texts: Iterable[str | None], net: Network | None, group_bytes: int = 4_000_000) -> np.ndarray:
    """Probability of label 1 per text, computed in groups of about ``group_bytes``; 0.5 without a network."""
    pairs = net.pairs() if net else None
    logits, group, size = [np.zeros(0)], [], 0

    def close() -> None:
        if group:
            logits.append(net.logits(group, pairs) if net else np.zeros(len(group)))
            group.clear()

    for text in texts:
        group.append((text or "").encode())
        size += len(group[-1])
        if size > group_bytes:
            close()
            size = 0
    close()
    return 1 / (1 + np.exp(-np.concatenate(logits)))


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(id, held_out, score, predicted) per row, with the columns of ``keep`` as they are.

    The score is the probability of label 1 from the bytes of the whole text alone.  A null text
    counts as empty and gets the score of a single window of zeros; without a network every score
    is 0.5.  Repeated rows score alike.
    """
    carried = [id_col, *[c for c in keep if c != id_col]]
    names = [*carried, "held_out", "score", "predicted"]
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probabilities((t.as_py() for t in batch.column(0)), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names)

    kinds = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried), "held_out boolean, score double, predicted int"])
    return docs.select(F.col(text_col).alias("__text"), *carried, held_out(F.col(id_col)).alias("held_out")).mapInArrow(run, kinds)


def passing(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of 0.5 or more, with their columns; only the text goes to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("boolean")
    def verdict(texts: pd.Series) -> pd.Series:
        return pd.Series(probabilities(texts, shared.value) >= 0.5)

    return docs.where(verdict(F.col(f"`{text_col}`")))
