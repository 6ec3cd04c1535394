"""Encode a corpus with a public byte-level BPE vocabulary through sentencepiece.

The vocabulary file (``base64-token rank`` per line) is serialised straight into
a sentencepiece BPE model: every token becomes a piece whose bytes are mapped to
printable characters, scored by its negative rank, so that the best-scored merge
is the lowest-ranked one; normalisation is the identity.  Texts are cut into
pre-tokens, byte-mapped and encoded; decoding maps pieces back to bytes.

Defined results: null and empty texts give an empty list; special-token strings
in a text are ordinary text; whole texts are encoded, whatever their length.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: where the vocabulary is, unless the caller says otherwise
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are cut into pre-tokens.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: pre-tokens remembered by a task; the memory is emptied when full
REMEMBERED = 200_000


@lru_cache(1)
def byte_characters() -> tuple[str, ...]:
    """A printable character for each byte: itself where printable, else from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return tuple(chr(b) if b in printable else chr(next(spare)) for b in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, kind: int, payload: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(payload)) if kind == 2 else b"") + payload


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Tokens by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece model file of ``tokens`` with an unknown piece after the last."""
    chars = byte_characters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        out += _field(1, 2, _field(1, 2, piece) + _field(2, 5, struct.pack("<f", -float(rank))))
    out += _field(1, 2, _field(1, 2, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, _varint(2)))
    unknown = len(tokens)
    none = (1 << 64) - 1
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(unknown + 1))
    trainer += _field(40, 0, _varint(unknown)) + b"".join(_field(n, 0, _varint(none)) for n in (41, 42, 43))
    normaliser = _field(1, 2, b"identity") + b"".join(_field(n, 0, _varint(0)) for n in (3, 4, 5))
    return bytes(out + _field(2, 2, trainer) + _field(3, 2, normaliser))


class Codec:
    """Encoder and decoder of one process."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(PATTERN).findall
        self.chars = byte_characters()
        self.to_char = {b: c for b, c in enumerate(self.chars)}
        self.to_byte = {ord(c): b for b, c in enumerate(self.chars)}
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.cut(t) if t else [] for t in texts]
        known = self.known
        new = list({p for parts in split for p in parts if p not in known})
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list({p for parts in split for p in parts})
        mapped = [p.encode().decode("latin-1").translate(self.to_char) for p in new]
        known.update(zip(new, self.pieces.encode(mapped, num_threads=1) if mapped else [], strict=True))
        out = []
        for parts in split:
            ids: list[int] = []
            for p in parts:
                ids += known[p]
            out.append(ids)
        if len(known) > REMEMBERED:
            known.clear()
        return out

    def decode(self, ids: list[int] | None) -> str:
        """The text of ``ids``; null and empty give an empty text."""
        pieces = "".join(self.pieces.id_to_piece([int(i) for i in ids])) if ids is not None and len(ids) else ""
        return bytes(pieces.translate(self.to_byte).encode("latin-1")).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str = VOCABULARY) -> Codec:
    """The process's codec; the model is built once from the vocabulary file."""
    return Codec(serialise(read_vocabulary(path)))


class _Shipped:
    """The model on its way to the tasks: one copy per executor, built once per Python worker."""

    def __init__(self, df: DataFrame, path: str):
        model = serialise(read_vocabulary(path))
        self.key = hashlib.sha256(model).hexdigest()
        self.model = df.sparkSession.sparkContext.broadcast(model)

    def codec(self) -> Codec:
        made = _WORKER.get(self.key)
        if made is None:
            _WORKER.clear()
            made = _WORKER[self.key] = Codec(self.model.value)
        return made


_WORKER: dict[str, Codec] = {}


def _texts(column: pa.Array) -> list[str | None]:
    """Python strings of a text column; bytes that are not UTF-8 read as U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        raw = column.cast(pa.binary()).to_pylist()
        return [None if b is None else b.decode("utf-8", "replace") for b in raw]


def _slices(texts: list[str | None], room: int = 4_000_000):
    """Runs of texts of bounded total length, so long texts are encoded a few at a time."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > room and i > start:
            yield texts[start:i]
            start, size = i, len(t or "")
    if texts[start:]:
        yield texts[start:]


def encode(df: DataFrame, text: str, path: str = VOCABULARY) -> Column:
    """Column of the token ids of ``text``: ``array<int>``, empty for null and empty texts."""
    shipped = _Shipped(df, path)

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        c = shipped.codec()
        ends, values = [0], []
        for part in _slices(_texts(column)):
            for found in c.encode(part):
                ends.append(ends[-1] + len(found))
                values.append(np.asarray(found, np.int32))
        flat = np.concatenate(values) if values else np.empty(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

    return ids(F.col(text))


def count_tokens(df: DataFrame, text: str, path: str = VOCABULARY) -> Column:
    """Column of the number of tokens of ``text``: ``long``, 0 for null and empty texts."""
    shipped = _Shipped(df, path)

    @F.arrow_udf("long")
    def sizes(column: pa.Array) -> pa.Array:
        c = shipped.codec()
        return pa.array([len(x) for part in _slices(_texts(column)) for x in c.encode(part)], pa.int64())

    return sizes(F.col(text))


def decode(df: DataFrame, ids: str, path: str = VOCABULARY) -> Column:
    """Column of the texts that lists of token ids stand for."""
    shipped = _Shipped(df, path)

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        c = shipped.codec()
        return pa.array([c.decode(x) for x in column.to_pylist()], pa.string())

    return texts(F.col(ids))
