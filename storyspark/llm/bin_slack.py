"""Sequence packing by minimum bin slack.

Documents become pieces of at most one bin (the first piece of a long one may be shorter).  For
each bin, a bitset subset-sum over the lengths still available finds the fullest feasible
combination with the longest length left; it is removed and the next bin starts.  Equal lengths are
interchangeable, so the search runs on the histogram of lengths, which has at most ``capacity``
entries however many documents there are, and one combination is taken as often as the counts
allow.  Tokenizing, ranking and placing the pieces is distributed.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyspark.llm.byte_bpe import byte_characters
from storyspark.session import cut_lineage

#: Pieces of one length that are ranked together; more are ranked in several groups.
RANK_GROUP = 2_000


class TextEncoder:
    """Ids of a byte-level BPE file of the tokenizers library, without special tokens.

    The name of an added token in a text is that token, as by the library's default.

    Texts up to U+024F without such a name are encoded with the file's own vocabulary as ranks, which gives the same
    ids several times faster (its ids follow its merges); any other text goes to the library itself,
    since the two split newer scripts by different Unicode tables.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(path)
        spelled = {c: i for i, c in enumerate(byte_characters())}
        special = self.library.get_added_tokens_decoder()
        self.names = [token.content for token in special.values()]
        ranks = {bytes(spelled[c] for c in token): i for token, i in self.library.get_vocab().items() if i not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if (text.isascii() or max(text) <= "\u024f") and not any(name in text for name in self.names):
            return self.fast.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


@functools.lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> TextEncoder:
    return TextEncoder(path, pattern)


def cut_into_pieces(docs: DataFrame, path: str, pattern: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
                    token_ids: bool = False) -> DataFrame:
    """(id, row, piece, start, length, ids_crc32[, token_ids]) of every piece.

    A document is the ids of its text (null: empty) without special tokens, then ``end_id``.  Only
    documents over ``capacity`` are cut, from the end, so that the first piece alone may be
    shorter.  ``row`` is a digest of the ids that tells apart rows which share an id.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*encoder.encode(text.as_py() or ""), end_id], "<u4")
                row = zlib.crc32(ids.tobytes())
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(itertools.pairwise(cuts)):
                    own = ids[a:b]
                    rows.append((i, row, piece, a, b - a, zlib.crc32(own.tobytes()), *([own.astype(np.int64)] if token_ids else [])))
            owner, *columns = zip(*rows) if rows else [()] * (len(types) + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int64())] if token_ids else [])]
    names = [id_col, "row", "piece", "start", "length", "ids_crc32", *(["token_ids"] if token_ids else [])]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, row long, piece int, start long, length long, ids_crc32 long" + ", token_ids array<long>" * token_ids)


def fullest(counts: Mapping[int, int], room: int) -> list[tuple[int, int]]:
    """(length, copies) of the fullest combination within ``room``, longer lengths first on ties.

    Bit s of ``reach`` says that sum s is feasible; copies of one length are added in powers of two.
    Short lengths come last, so they are spent only where longer ones leave a gap.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], room // length), 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> room:  # full: nothing can be fuller
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return sorted(used.items(), reverse=True)


def patterns(counts: Mapping[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Combinations that use up ``counts`` and how often each is taken, in order."""
    counts = {n: c for n, c in counts.items() if c > 0}
    out = []
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        used = dict(fullest({n: c for n, c in rest.items() if c and n <= capacity - longest}, capacity - longest))
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[n] // c for n, c in used.items())
        out.append((sorted(used.items(), reverse=True), times))
        for n, c in used.items():
            counts[n] -= c * times
            if not counts[n]:
                del counts[n]
    return out


def slots(found: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, last, copies, sequence, offset) per length of a pattern: the pieces of that
    length with ranks first to last - 1 fill its slots, ``copies`` to a sequence, from ``sequence`` on."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for used, times in found:
        offset = 0
        for length, copies in used:
            first = taken.get(length, 0)
            taken[length] = first + copies * times
            rows.append((length, first, taken[length], copies, sequence, offset))
            offset += length * copies
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: every sequence is filled without gaps from 0.

    Ranks among pieces of one length are counted in groups of at most about RANK_GROUP rows (a
    length may hold a third of them), so no group grows with the data.  The histogram in the driver
    and the slot table that is broadcast have a size bound by ``capacity``.  An empty table gives
    an empty one; repeated rows and null ids are pieces like others.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    groups = spark.createDataFrame([(n, -(-c // RANK_GROUP)) for n, c in histogram.items()], "length long, __groups long")
    slot_rows = slots(patterns(histogram, capacity))
    table = spark.createDataFrame(slot_rows, "length long, first long, last long, copies long, base_sequence long, base_offset long")
    order = [F.col(id_col), F.col("row"), F.col("piece")]
    dealt = pieces.join(F.broadcast(groups), "length").withColumn("__group", F.pmod(F.xxhash64(*order), F.col("__groups")))
    sizes = dealt.groupBy("length", "__group").count()
    before = sizes.select("length", "__group", (F.sum("count").over(Window.partitionBy("length").orderBy("__group")) - F.col("count")).alias("__before"))
    ranked = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__group").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", "__group"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    slot = F.broadcast(table.withColumnRenamed("length", "__length"))
    placed = ranked.join(slot, (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("first")) & (F.col("__rank") < F.col("last")))
    nth = F.col("__rank") - F.col("first")
    return placed.select(*pieces.columns, (F.col("base_sequence") + F.floor(nth / F.col("copies"))).alias("sequence_id"),
                         (F.col("base_offset") + F.pmod(nth, F.col("copies")) * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
                   token_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, token_ids]) of every piece of ``docs``."""
    pieces = cut_lineage(cut_into_pieces(docs, path, pattern, capacity, end_id, id_col, text_col, token_ids))
    return pack(pieces, capacity, id_col).drop("row")
