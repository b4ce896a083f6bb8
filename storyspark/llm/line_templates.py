"""Line dedup by log templates.

Lines walk a parse tree of fixed depth: token count first, then the leading tokens, where a token
that holds a digit is a variable field.  In a leaf, lines that agree in enough places share a
template, whose other places become variable too.  Templates that recur across documents are
boilerplate: their lines are dropped from every document but the first.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyspark.llm.common import written
from storyspark.session import cut_lineage

VARIABLE = "<*>"
#: Leading tokens that route a line, after its token count.
DEPTH = 3
#: Fixed tokens that a line needs to be parsed: shorter lines recur by chance, so they only match as they are, in SHORT_MIN_DOCS documents or more.
MIN_FIXED = 5
SHORT_MIN_DOCS = 10
#: Templates of a leaf that a line is compared with one by one; among more, those that can match are looked up by their segments, with the same outcome.
STREAM_LINES = 4000
#: Rows whose texts are packed or unpacked together.
SLICE = 256
_DIGIT = re.compile(r"\d")


def tokens(line: str) -> list[str]:
    """Tokens between white space, variable ones masked."""
    found = line.split()
    return [VARIABLE if _DIGIT.search(t) else t for t in found] if _DIGIT.search(line) else found


def _digest(parts: list[str], size: int) -> bytes:
    return hashlib.blake2b("\x1f".join(parts).encode(), digest_size=size).digest()


class Leaf:
    """Templates of one leaf, in order of arrival.

    A line that is similar enough to a template differs from it in at most ``places - need`` places,
    so it shares one whole segment at least of any ``places - need + 1``.  In a large leaf, templates
    are found by the segments that they have or had, of which a line takes those that the fewest
    templates have; all that can match are among them.
    """

    def __init__(self, similarity: float):
        self.similarity, self.ids, self.lines = similarity, {VARIABLE: 0}, []
        self.matrix = np.zeros((0, 0), np.int32)
        self.n = 0
        self.index: dict[tuple[int, bytes], array] | None = None
        self.bounds: list[tuple[int, int]] = []
        self.looked_up = 0

    def _segments(self, row: np.ndarray) -> list[tuple[int, bytes]]:
        return [(k, row[a:b].tobytes()) for k, (a, b) in enumerate(self.bounds)]

    def _build(self, places: int) -> None:
        """Index of the templates so far; the leading places, which all share, are in no segment."""
        need = next((k for k in range(places + 1) if k >= self.similarity * places), places)
        self.looked_up = places - need + 1
        self.index = {}
        if self.looked_up <= places - DEPTH:
            segments = min(2 * self.looked_up, places - DEPTH)
            cuts = [DEPTH + (places - DEPTH) * k // segments for k in range(segments + 1)]
            self.bounds = list(itertools.pairwise(cuts))
            for k in range(self.n):
                self._enter(k, self._segments(self.matrix[k]))

    def _enter(self, template: int, segments: list[tuple[int, bytes]]) -> None:
        for key in segments:
            self.index.setdefault(key, array("i")).append(template)

    def _best(self, row: np.ndarray, segments: list[tuple[int, bytes]]) -> tuple[int, int]:
        """The template that agrees with ``row`` in most places (the first on ties), and in how many."""
        found = sorted((self.index.get(key, ()) for key in segments), key=len)[:self.looked_up]
        if not found or sum(map(len, found)) > self.n // 4:
            same = (self.matrix[:self.n] == row).sum(1)
            best = int(same.argmax())
            return best, int(same[best])
        some = np.unique(np.concatenate([np.array(f, np.int32) for f in found]))
        if not len(some):
            return -1, -1
        same = (self.matrix[some] == row).sum(1)
        best = int(same.argmax())
        return int(some[best]), int(same[best])

    def add(self, line: list[str]) -> int:
        """Index of the template that ``line`` joins (the most similar one, the first on ties) or opens."""
        row = np.array([self.ids.setdefault(t, len(self.ids)) for t in line], np.int32)
        if self.index is None and self.n > STREAM_LINES:
            self._build(len(row))
        segments = self._segments(row)
        if not self.n:
            self.matrix = np.zeros((4, len(row)), np.int32)
        else:
            best, same = self._best(row, segments)
            if best >= 0 and same >= self.similarity * len(row):
                old, new = self.matrix[best], np.where(self.matrix[best] == row, row, 0)
                if self.bounds and (old != new).any():
                    had = set(self._segments(old))
                    self._enter(best, [key for key in self._segments(new) if key not in had])
                self.matrix[best] = new
                return best
        if self.n == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[self.n] = row
        if self.bounds:
            self._enter(self.n, segments)
        self.n += 1
        return self.n - 1

    def templates(self, order: Iterable[int] | None = None) -> Iterator[list[str]]:
        spell = list(self.ids)
        return ([spell[i] for i in self.matrix[k].tolist()] for k in (range(self.n) if order is None else order))


def parse(lines: Iterable[list[str]], similarity: float) -> list[bytes]:
    """Digest of the template of each of the ``lines`` of one leaf: parsed in their order, then the templates once more in order of their digests."""
    leaf = Leaf(similarity)
    of = array("i", (leaf.add(words) for words in lines))
    names = [_digest(t, 16) for t in leaf.templates()]
    once = {name: k for k, name in enumerate(names)}
    order = sorted(once)
    again = Leaf(similarity)
    merged = dict(zip(order, [again.add(words) for words in leaf.templates(once[name] for name in order)]))
    final = [_digest(t, 16) for t in again.templates()]
    return [final[merged[names[k]]] for k in of]


def scan(docs: DataFrame) -> DataFrame:
    """(id, tk, pos, leaf, line, short) of each line of (id, tk, text): leaf and masked line as digests.

    A short line is a leaf of its own.  One without a fixed token that holds a letter (blank, numbers, rules, brackets) is layout and left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, pos, leaf, line, short = [], [], [], [], []
            for i, text in enumerate(batch.column(2)):
                for p, raw in enumerate((text.as_py() or "").split("\n")):
                    words = tokens(raw)
                    few = len(words) - words.count(VARIABLE) < MIN_FIXED
                    if few and not any(c.isalpha() for w in words for c in w):
                        continue
                    owner.append(i)
                    pos.append(p)
                    line.append(_digest(["", *words] if few else words, 16))  # apart from templates of the same words
                    leaf.append(int.from_bytes(line[-1][:8] if few else _digest([str(len(words)), *words[:DEPTH]], 8), "little", signed=True))
                    short.append(few)
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(pos, pa.int32()), pa.array(leaf, pa.int64()),
                                              pa.array(line, pa.binary()), pa.array(short, pa.bool_())], ["id", "tk", "pos", "leaf", "line", "short"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "tk", "text").mapInArrow(run, f"id {kind}, tk long, pos int, leaf long, line binary, short boolean")


def _line_tokens(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(leaf, line, words) of the ``wanted`` (leaf, line, at): their tokens, cut out of the documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, line, words = [], [], []
            for crate, places in zip(batch.column(0), batch.column(1).to_pylist()):
                lines = _unpacked(crate).split("\n")
                for p in places:
                    leaf.append(p["leaf"])
                    line.append(p["line"])
                    words.append(tokens(lines[p["pos"]]))
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(line, pa.binary()), pa.array(words, pa.list_(pa.string()))], ["leaf", "line", "words"])

    per_doc = wanted.groupBy(_kid("at.id").alias("kid"), F.col("at.tk").alias("tk")).agg(F.collect_list(F.struct("at.pos", "leaf", "line")).alias("places"))
    texts = _crated(docs.select(_kid("id").alias("kid"), "tk", "text")).join(per_doc, ["kid", "tk"])
    return texts.select("crate", "places").mapInArrow(run, "leaf long, line binary, words array<string>").dropDuplicates(["line"])


def _crated(docs: DataFrame) -> DataFrame:
    """``docs`` with its column ``text`` packed as ``crate``: texts cross a shuffle in a third of their size."""
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                part = batch.slice(a, SLICE)
                crate = pa.array([None if t is None else pack(t.encode()) for t in (v.as_py() for v in part.column(0))], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], crate], [*(f.name for f in kept), "crate"])

    return docs.select("text", *(f.name for f in kept)).mapInArrow(run, T.StructType([*kept, T.StructField("crate", T.BinaryType())]))


def _unpacked(crate: pa.Scalar) -> str | None:
    return zstandard.ZstdDecompressor().decompress(crate.as_py()).decode() if crate.is_valid else None


def _kid(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit("\0"))


def _parsed(lines: DataFrame, similarity: float) -> DataFrame:
    """(line, template) of (leaf, line, words), as digests.

    A leaf is one stream, however many lines it has: lines that meet in no template of one stream
    could still meet in another order, so a leaf in parts would not give the same templates.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        lines, templates = [], []

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (lines, templates)], ["line", "template"])

        def words(members: Iterable[tuple]) -> Iterator[list[str]]:
            for _, line, spelled in members:
                lines.append(line)
                yield spelled

        for _, members in itertools.groupby(rows, key=lambda row: row[0]):
            templates += parse(words(members), similarity)
            if len(lines) > 10_000:
                yield emit()
                lines, templates = [], []
        yield emit()

    dealt = lines.select("leaf", "line", "words").repartition("leaf").sortWithinPartitions("leaf", "line")
    return dealt.mapInArrow(run, "line binary, template binary")


def recurring_lines(docs: DataFrame, similarity: float = 0.8, min_docs: int = 2, short_min_docs: int = SHORT_MIN_DOCS) -> DataFrame:
    """(kid, tk, drop) of (id, tk, text): positions of the lines to drop from each document that has any.

    A leaf with one line in all documents cannot recur, so its line is left out first.  Exact copies
    of a masked line are counted as digests.  Only leaves with several different lines need their
    tokens: these are read once more and parsed, each leaf as one stream, so that the templates do
    not depend on the number of lines.
    """
    every = written(scan(docs))
    # a table of its own, so that the join below can split a leaf that many lines have
    busy = written(every.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1").select("leaf"))
    lines = written(every.join(busy, "leaf", "left_semi"))
    at = F.struct(F.col("id").isNull().alias("no_id"), "id", "tk", "pos")
    distinct = lines.where("NOT short").groupBy("leaf", "line").agg(F.min(at).alias("at"))
    crowded = distinct.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1")
    wanted = distinct.join(crowded, "leaf")
    final = _parsed(_line_tokens(docs, wanted), similarity)
    named = lines.join(cut_lineage(final), "line", "left").select("id", "tk", "pos", "short", F.coalesce("template", "line").alias("template"))
    doc = F.struct(F.col("id").isNull().alias("no_id"), "id", "tk")
    per_doc = named.select("template", "short", doc.alias("doc")).distinct()
    # a table of its own, so that the join below can split a template that many lines have
    least = F.when(F.col("short"), max(min_docs, short_min_docs)).otherwise(min_docs)
    spread = cut_lineage(per_doc.groupBy("template", "short").agg(F.count("*").alias("docs"), F.min("doc").alias("home")).where(F.col("docs") >= least)
                         .drop("short"))
    again = named.join(spread, "template").where(~doc.eqNullSafe(F.col("home")))
    return again.groupBy(_kid("id").alias("kid"), "tk").agg(F.collect_set("pos").alias("drop"))


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, min_docs: int = 2,
                   counts: bool = False, short_min_docs: int = SHORT_MIN_DOCS) -> DataFrame:
    """``docs`` with the lines of recurring templates cut from ``text_col`` (and with ``n_lines``, ``n_dropped`` if ``counts``).

    A template recurs if lines of it stand in ``min_docs`` documents or more; the document of least
    id (null ids last, then by text hash) x stays, with all its columns; a text of
    dropped lines alone becomes empty, a null text stays null.  Rows that repeat an id and its text
    are one document, rows that share an id only are several.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tk"), text.alias("text"))
    drops = recurring_lines(slim, similarity, min_docs, short_min_docs)
    # the other columns travel in a struct, so that their names clash with nothing
    rest = [c for c in docs.columns if c != text_col]
    row = F.struct(F.lit(True).alias("__"), *[F.col(f"`{c}`") for c in rest])
    packed = _crated(docs.select(row.alias("row"), _kid(f"`{id_col}`").alias("kid"), F.xxhash64(text).alias("tk"), F.col(f"`{text_col}`").alias("text")))
    joined = packed.join(drops, ["kid", "tk"], "left").select("row", "crate", "drop")
    kind = T.StructType([joined.schema["row"], *(T.StructField(n, t) for n, t in (("text", T.StringType()), ("n_lines", T.LongType()), ("n_dropped", T.LongType())))])
    cleaned = joined.mapInArrow(_without_lines, kind)
    columns = [F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return cleaned.select(*columns, *(["n_lines", "n_dropped"] if counts else []))


def _without_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            part = batch.slice(a, SLICE)
            texts, sizes, gone = [], [], []
            for crate, drop in zip(part.column(1), part.column(2).to_pylist()):
                text = _unpacked(crate)
                out = set(drop or ())
                lines = [] if text is None else text.split("\n")
                texts.append("\n".join(line for i, line in enumerate(lines) if i not in out) if out else text)
                sizes.append(len(lines))
                gone.append(len(out))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())], ["row", "text", "n_lines", "n_dropped"])
