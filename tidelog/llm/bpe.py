"""Byte-level BPE by a sentencepiece model that is serialised from the vocabulary itself.

Every byte maps to one character; a token of rank r becomes piece r with score -r, and merges by best score are then
merges by lowest rank. Normalisation is the identity. Texts are split into pre-tokens by a pattern, each encoded on
its own; decoding maps ids to pieces to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.common import pieces
from tidelog.storage import ship

#: Pre-tokens remembered by a worker, and the longest of them.
CACHE, CACHED_CHARS = 400_000, 48
#: Characters 256 to 511 stand for bytes 0 to 255.
BASE = 256


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float | bool) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


def to_chars(b: bytes) -> str:
    return "".join(chr(BASE + x) for x in b)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: pieces in rank order, then the unknown piece that the format demands."""
    pieces = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in pieces] != list(range(len(pieces))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    out = [_field(1, _field(1, to_chars(b).encode()) + _field(2, -float(r)) + _field(3, 1)) for b, r in pieces]  # NORMAL
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))  # UNKNOWN
    bpe = _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + b"".join(_varint(n << 3) + _varint((1 << 64) - 1) for n in (41, 42, 43))
    identity = _field(1, b"identity") + _field(3, False) + _field(4, False) + _field(5, False)
    return b"".join(out) + _field(2, bpe) + _field(3, identity)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """encode(text) -> ids and decode(ids) -> bytes, by a rank file and a pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = load_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        # decoding inverts the mapping of bytes to characters in the model's own pieces; the last one is the unknown piece
        self.bytes = [bytes(ord(c) - BASE for c in self.model.id_to_piece(k)) for k in range(len(self.ranks))]
        self.split = regex.compile(pattern).findall
        self.chars = {b: chr(BASE + b) for b in range(256)}
        self.known: dict[str, list[int]] = {}

    def piece(self, token: str) -> list[int]:
        """Ids of one pre-token: itself if it is in the vocabulary, else the merges of its bytes."""
        raw = token.encode()
        rank = self.ranks.get(raw)
        return [rank] if rank is not None else self.model.encode(raw.decode("latin-1").translate(_SHIFT))

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for token in self.split(text):
            ids = known.get(token)
            if ids is None:
                ids = self.piece(token)
                if len(token) <= CACHED_CHARS:
                    if len(known) >= CACHE:
                        known.clear()
                    known[token] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


_SHIFT = {b: BASE + b for b in range(256)}


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every row. Null and empty texts have no ids."""
    path, pattern = _defaults(path, pattern)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in (x for y in batches for x in pieces(y, 1)):
            ids = [np.array(c.encode(t.as_py() or ""), np.int32) for t in b.column(1)]
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["doc_id", "ids"])

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, payload binary) of rows (doc_id, ids); null ids: empty. An id outside the vocabulary is an error."""
    path, pattern = _defaults(path, None)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x.as_py() or []) for x in b.column(1)], pa.binary())], names=["doc_id", "payload"])

    ship(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(of, "doc_id long, payload binary")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Both operators in one pass that keeps only digests: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Ids are hashed as little-endian unsigned 32-bit integers, then decoded and hashed again. Null and empty texts have
    no tokens. Every row gives a row, repeated ones too; an empty table gives none.
    """
    path, pattern = _defaults(path, pattern)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in (x for y in batches for x in pieces(y, 1)):
            n, one, two = [], [], []
            for t in b.column(1):
                ids = c.encode(t.as_py() or "")
                n.append(len(ids))
                one.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                two.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(of, DIGESTS)
