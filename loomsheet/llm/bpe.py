"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

The model is serialised straight from the vocabulary: each token's bytes are mapped to characters
(byte b to U+0100 + b), its score is the negative rank, the type is BPE and the normalisation is
identity, so that sentencepiece merges exactly the pairs of lowest rank. Texts are split into
pre-tokens by the vocabulary's pattern; a pre-token that is a token itself is that token, as in the
rank file's own library; the others are encoded by the model. Decoding maps ids back to bytes.

Defined results: null and empty texts give no ids and no bytes; texts are encoded whole; repeated
rows repeat their ids; extra columns are dropped. A vocabulary must hold all 256 single bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices, text_of

BASE = 0x100
TOGETHER = 1_000_000  # ids decoded together
KEPT = 200_000  # pre-tokens whose ids a task remembers


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(_UP)


_UP = {b: BASE + b for b in range(256)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model: piece 0 is unknown, piece k + 1 the token of rank k."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must run from 0 without gaps and hold all single bytes")
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    pieces += [_field(1, _field(1, mapped(t).encode()) + _field(2, float(-k)) + _field(3, 1)) for k, t in enumerate(tokens)]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, 2**64 - 1) + _field(42, 2**64 - 1) + _field(43, 2**64 - 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes and decodes whole texts; one for each Python worker."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.tokens = sorted(self.ranks, key=self.ranks.__getitem__)
        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.ranks))
        self.known: dict[str, bytes] = {}
        self.table = pa.array(self.tokens, pa.large_binary())

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as int32 values one after the other."""
        split = [self.pattern.findall(t) for t in texts]
        known, seen = self.known, set(chain.from_iterable(split))
        if len(known) + len(seen) > KEPT:
            known.clear()
        new = [p for p in seen if p not in known]  # a difference of sets would go through all that is known
        merge = []
        for piece in new:
            if (rank := self.ranks.get(piece.encode())) is not None:
                known[piece] = struct.pack("=i", rank)
            else:
                merge.append(piece)
        found = self.model.encode([mapped(p.encode()) for p in merge], num_threads=1) if merge else []
        flat = (np.fromiter(chain.from_iterable(found), np.int32) - 1).astype(np.int32).tobytes()
        at = 0
        for piece, ids in zip(merge, found, strict=True):
            known[piece] = flat[at : (at := at + 4 * len(ids))]
        return [b"".join([known[p] for p in pieces]) for pieces in split]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids: those of all tokens lie together, so a row is cut out of them."""
        taken = self.table.take(ids.flatten())
        _, offsets, data = taken.buffers()
        starts = np.frombuffer(offsets, np.int64, len(taken) + 1, taken.offset * 8)
        ends = starts[np.append(0, np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False)))]
        return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends.tobytes()), data]).cast(pa.binary())


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int): the ids of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, "text", 250_000):
                ids = own.encode(part.column("text").to_pylist())
                ends = (np.cumsum([0, *map(len, ids)]) // 4).astype(np.int32)
                values = np.frombuffer(b"".join(ids), np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["doc_id", "ids"])

    return bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, data (binary): what the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            counts = np.cumsum(pc.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False)) if batch.num_rows else []
            start = 0
            while start < batch.num_rows:  # about ``TOGETHER`` ids, or one row
                done = counts[start - 1] if start else 0
                part = batch.slice(start, max(1, int(np.searchsorted(counts, done + TOGETHER, side="right")) - start))
                start += part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), own.decode(part.column("ids"))], ["doc_id", "ids", "data"])

    return bounded(encoded.select("doc_id", "ids")).mapInArrow(run, "doc_id long, ids array<int>, data binary")
