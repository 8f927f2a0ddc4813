"""Byte-level BPE through a sentencepiece model that is serialised from a rank file.

Every byte becomes one character, so a token's bytes become a piece; its score is its negative
rank, normalisation is the identity. Each match of the split pattern is encoded by itself, which
gives the merges of the rank file in rank order. Decoding maps ids back to bytes.

Defined results: a null text encodes as an empty one (no ids, empty bytes); long texts are encoded whole; a null id list
decodes to empty bytes; rows are independent, so ties and repeated rows need no rule; columns
other than the id and text columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from quern.plans import memo
from quern.plans.arrow import slices
from quern.plans.shared import prepare

#: Entries that a worker keeps of pre-tokens it has encoded; more only cost time, never results.
CACHE_ENTRIES = 300_000
#: First code point of the 256 that stand for bytes: letters that no normaliser touches.
FIRST = 0x100


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The rank file's tokens: base64 and a rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece ModelProto of a rank file; piece i is the i-th token by rank, the last is <unk>."""
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
    out = bytearray()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(chr(FIRST + b) for b in token).encode()
        out += _block(1, _block(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -rank))
    out += _block(1, _block(1, b"<unk>") + _number(3, 2))
    # TrainerSpec: BPE, the place of <unk>, and no other control ids
    out += _block(2, _number(3, 2) + _number(4, len(ranks) + 1) + _number(40, len(ranks)) + _number(41, -1) + _number(42, -1) + _number(43, -1))
    # NormalizerSpec: identity without a prefix, trimming or escapes
    out += _block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class Codec(dict):
    """Encoder and decoder; as a dict it holds the ids of pre-tokens as little-endian bytes."""

    def __init__(self, data: bytes, pattern: str):
        super().__init__()
        ranks = read_ranks(data)
        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        self.ids = np.array([r for _, r in by_rank], dtype="<u4")
        self.bytes_of = dict(zip((r for _, r in by_rank), (t for t, _ in by_rank)))
        #: A pre-token that is itself a token is that token, even where merges alone end elsewhere.
        self.whole = {}
        got = self.model.encode([self._mapped(t) for t, _ in by_rank], num_threads=1)
        for i, (pieces, (token, rank)) in enumerate(zip(got, by_rank)):
            if pieces != [i]:
                self.whole[token] = rank

    @staticmethod
    def _mapped(data: bytes) -> str:
        return data.decode("latin-1").translate(_MAP)

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        if self.whole and data in self.whole:
            got = np.array([self.whole[data]], dtype="<u4").tobytes()
        else:
            got = self.ids[self.model.encode(self._mapped(data))].tobytes()
        if len(data) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = got
        return got

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, self.pattern.findall(text))) if text else b""

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes that ids (as ``encode`` gives them) stand for."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())) if ids else b""


_MAP = {b: FIRST + b for b in range(256)}
_codecs: dict[tuple, Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """One codec for each vocabulary in a worker."""
    key = (zlib.crc32(data), len(data), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(data, pattern)
    return _codecs[key]


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:  # on the driver; a vocabulary is a few MB
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("the vocabulary file is larger than 64 MB")
    return df.sparkSession.sparkContext.broadcast(data)


def _over(df: DataFrame, path: str, pattern: str, id_col: str, in_col: str, outs: dict) -> DataFrame:
    prepare(df.sparkSession)
    data = _vocabulary(df, path)
    names = list(outs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo.only("byte_bpe", _codecs.clear)
        own = codec(data.value, pattern)
        for batch in slices(batches, in_col):
            columns = [batch.column(0)]
            done = {}
            for name in names:
                source, how = outs[name]
                values = done[source] if source in done else batch.column(1).to_pylist()
                done[name] = [getattr(own, how)(x) for x in values]
                columns.append(pa.array(done[name], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *names])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, in_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{x} binary" for x in names))


def encode(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids``, the little-endian unsigned 32-bit ids of each whole text."""
    return _over(df, vocabulary, pattern, id_col, text_col, {"ids": (text_col, "encode")})


def decode(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``decoded``, the bytes of each id list."""
    return _over(df, vocabulary, pattern, id_col, ids_col, {"decoded": (ids_col, "decode")})


def round_trip(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` and ``decoded`` in one pass of a Python worker."""
    return _over(df, vocabulary, pattern, id_col, text_col, {"ids": (text_col, "encode"), "decoded": ("ids", "decode")})
