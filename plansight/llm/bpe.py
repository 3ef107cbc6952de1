"""Byte-level BPE encoding and decoding by a sentencepiece model made from a rank file.

The model is serialised from the vocabulary itself: every byte is mapped to one character,
each token becomes a piece spelt in these characters with its negative rank as score, and the
normaliser is the identity. Sentencepiece then merges the neighbouring pair of the best score
first, which is the pair of the lowest rank, as byte-level BPE does.

Defined results: a null text is an empty one and has no ids; texts may be of any length; the
ids depend on the text alone, so repeated rows agree; empty tables give empty tables; other
columns of a table pass through, and one that has the new column's name is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plansight.llm.common import trim

#: Byte b is written as the character U+0100 + b: a letter that no normaliser or splitter treats specially.
_CHARACTERS = {b: chr(0x100 + b) for b in range(256)}
_BYTES = {character: b for b, character in _CHARACTERS.items()}
#: Pre-tokens that a worker remembers, and the longest of them. The memory forgets all when it is full.
REMEMBERED, LONGEST = 1 << 16, 48
#: Rows that are worked on at a time.
STEP = 256


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token, rank) in the order of their ranks."""
    with open(path, "rb") as file:
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in file if line.strip())]
    pairs.sort()
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    return [token for _, token in pairs]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the ranks; the unknown piece comes after them."""

    def piece(text: str, score: float, kind: int) -> bytes:
        return _bytes(1, _bytes(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))

    normal, unknown = 1, 2
    pieces = [piece("".join(map(_CHARACTERS.__getitem__, token)), -float(rank), normal) for rank, token in enumerate(tokens)]
    pieces.append(piece("<unk>", 0.0, unknown))
    bpe = 2
    trainer = _number(3, bpe) + _number(4, len(pieces)) + _number(40, len(tokens)) + b"".join(_number(k, -1) for k in (41, 42, 43))
    normalizer = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normalizer)


class Codec:
    """Encodes texts to little-endian unsigned 32-bit ids and decodes these to bytes."""

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str) -> None:
        import regex
        import sentencepiece

        self._ranks = {token: rank for rank, token in enumerate(tokens)}
        self._find = regex.compile(pattern).findall
        self._processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        # the model's own pieces, each mapped back to its bytes once
        self._spelt = [bytes(map(_BYTES.__getitem__, self._processor.id_to_piece(k))) for k in range(self._processor.get_piece_size()) if not self._processor.is_unknown(k)]
        self._memory: dict[str, bytes] = {}

    def _spell(self, pre_token: str) -> str:
        return "".join(map(_CHARACTERS.__getitem__, pre_token.encode()))

    def _learn(self, pre_tokens: list[str]) -> dict[str, bytes]:
        """The ids of pre-tokens: a pre-token that is a token has its rank, the others are merged."""
        out, rest = {}, []
        for x in pre_tokens:
            rank = self._ranks.get(x.encode())
            if rank is None:
                rest.append(x)
            else:
                out[x] = struct.pack("<I", rank)
        for x, ids in zip(rest, self._processor.encode([self._spell(x) for x in rest], num_threads=1) if rest else [], strict=True):
            out[x] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def encode(self, text: str | None) -> bytes:
        pre_tokens = self._find(text or "")
        memory = self._memory
        missing = {x for x in pre_tokens if x not in memory}
        if missing:
            found = self._learn(list(missing))
            if len(memory) + len(found) > REMEMBERED:
                memory.clear()
                found = {**self._learn([x for x in set(pre_tokens) if x not in found]), **found}
            long = {x: ids for x, ids in found.items() if len(x) > LONGEST}
            memory.update(found)
            ids = b"".join(map(memory.__getitem__, pre_tokens))
            for x in long:
                del memory[x]
            return ids
        return b"".join(map(memory.__getitem__, pre_tokens))

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes that the ids' pieces spell, by the inverse of the bytes' characters."""
        return b"".join(map(self._spelt.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


class ByteBpe:
    """Encodes and decodes columns of tables by one vocabulary.

    Only the driver reads the rank file. Its tokens and the model go to the executors as a
    broadcast, whose size the vocabulary bounds (about 1.5 MB for 50,000 tokens), not the data.
    Rows pass through a few at a time, so a worker holds little beside the batch it was given.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str) -> None:
        tokens = read_ranks(path)
        model = model_bytes(tokens)
        self._key = hashlib.sha256(model + pattern.encode()).hexdigest()
        self._parts = spark.sparkContext.broadcast((tokens, model, pattern))

    def encode(self, table: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
        """The table with the ids in place of the text; a column that had the ids' name goes."""
        return self._mapped(table, text, {ids: Codec.encode})

    def decode(self, table: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
        """The table with the bytes that the ids stand for in place of the ids; null ids give none."""
        return self._mapped(table, ids, {decoded: Codec.decode})

    def encode_and_decode(self, table: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
        """Both in one pass of one worker: the ids, and the bytes decoded from these ids."""
        return self._mapped(table, text, {ids: Codec.encode, decoded: Codec.decode})

    def _mapped(self, table: DataFrame, old: str, steps: dict[str, Callable]) -> DataFrame:
        """The table with a column for each step in place of the old one; each step works on what the one before it made."""
        key, parts = self._key, self._parts
        others = [c for c in table.columns if c not in (old, *steps)]

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(key, parts)
            for batch in batches:
                for at in range(0, batch.num_rows, STEP):
                    part = batch.slice(at, STEP)
                    values, made = part.column(len(others)).to_pylist(), []
                    for work in steps.values():
                        values = [work(codec, x) for x in values]
                        made.append(pa.array(values, pa.binary()))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], [*others, *steps])
            trim()

        picked = table.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{old}`"))
        schema = T.StructType([*picked.schema.fields[:-1], *[T.StructField(name, T.BinaryType()) for name in steps]])
        return picked.mapInArrow(rows, schema)


_CODECS: dict[str, Codec] = {}


def _codec(key: str, parts) -> Codec:
    """One codec a worker process, kept between tasks under the model's digest."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(*parts.value)
    return _CODECS[key]
