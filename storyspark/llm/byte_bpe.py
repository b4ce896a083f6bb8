"""Byte-level BPE through a sentencepiece model that is written from the vocabulary.

A rank file (token bytes and rank per line) becomes a serialised sentencepiece BPE model: every
token is spelled with one printable character per byte, scored by its negative rank, under
identity normalisation.  Sentencepiece then merges exactly as the ranks say.  Text is split by the
published pattern; each match is encoded on its own, and ids are decoded by the inverse mapping.
No special tokens exist, so their strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encoded matches kept per task; a full cache starts anew.
CACHE_ENTRIES = 300_000
#: Characters of the texts whose matches are looked up together.
GROUP_CHARS = 2_000_000


def byte_characters() -> list[str]:
    """One printable character per byte: itself where printable, else the next free one from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in out:
            out[b] = chr(0x100 + len(out) - len(printable))
    return [out[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """Serialised sentencepiece model of a rank vocabulary; piece ids are the ranks, the unknown piece comes last."""
    by_rank = sorted(ranks.items(), key=lambda item: item[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a token: {missing}")
    spell = byte_characters()
    normal, unknown, bpe = 1, 2, 2  # fixed values of the published model format
    pieces = [_bytes(1, _bytes(1, "".join(spell[b] for b in token).encode()) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, normal))
              for token, rank in by_rank]
    pieces.append(_bytes(1, _bytes(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, unknown)))
    size = len(pieces)
    trainer = _number(3, bpe) + _number(4, size) + _number(40, size - 1) + b"".join(_number(f, -1) for f in (41, 42, 43))
    normalizer = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normalizer)


class Codec:
    """Encoder and decoder of one vocabulary, with a bounded cache of encoded matches."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.tokens = [t for t, _ in sorted(self.ranks.items(), key=lambda item: item[1])]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.split = regex.compile(pattern).findall
        self.spelling = dict(enumerate(byte_characters()))
        self.cache: dict[str, list[int]] = {}

    def _learn(self, parts: set[str]) -> None:
        """Put the ids of ``parts`` into the cache: a match that is a token needs no merges, the rest go to the model at once."""
        if len(self.cache) + len(parts) > CACHE_ENTRIES:
            self.cache = {}
        data = {p: p.encode() for p in parts}
        merged = {}
        for p, b in data.items():
            rank = self.ranks.get(b)
            if rank is None:
                merged[p] = len(b)
            else:
                self.cache[p] = [rank]
        spelled = b"".join(map(data.__getitem__, merged)).decode("latin-1").translate(self.spelling)  # one character per byte
        ends = list(itertools.accumulate(merged.values()))
        pieces = [spelled[i:j] for i, j in zip([0, *ends], ends)]
        if pieces:
            self.cache.update(zip(merged, self.model.encode(pieces, num_threads=1)))

    def encode_all(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of each text, taken in groups of a few million characters."""
        group, size = [], 0
        for text in texts:
            group.append(self.split(text))
            size += len(text)
            if size > GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[list[str]]) -> Iterator[list[int]]:
        new = set().union(*group)
        if not new <= self.cache.keys():
            self._learn(new.difference(self.cache))
            if not new <= self.cache.keys():  # the cache started anew meanwhile
                self._learn(new)
        for parts in group:
            yield list(itertools.chain.from_iterable(map(self.cache.__getitem__, parts)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, token_ids]) per row of ``docs``.

    ``path`` is the rank file, which every worker opens (it belongs to an installed package).  A
    null text counts as empty: no tokens and the digests of nothing.  Repeated rows and null ids
    give one row each; other columns, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        digits = [str(i) for i in range(len(bpe.tokens))]
        for batch in batches:
            rows = []
            for tokens in bpe.encode_all(text.as_py() or "" for text in batch.column(1)):
                rows.append((len(tokens), hashlib.sha256(",".join(map(digits.__getitem__, tokens)).encode()).hexdigest(),
                             hashlib.sha256(bpe.decode(tokens)).hexdigest(), *([tokens] if ids else [])))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    types = [pa.int64(), pa.string(), pa.string(), *([pa.list_(pa.int32())] if ids else [])]
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(["token_ids"] if ids else [])]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, schema)
