"""Byte-level BPE through a sentencepiece model that is written directly from a rank vocabulary.

Every byte is mapped to a printable character, every token of the vocabulary becomes a piece of such characters
whose score is its negative rank, and the normalizer changes nothing. BPE then merges the neighbours whose
joined piece has the lowest rank, as the rank vocabulary's own library does. Texts are split by the vocabulary's
pattern first and each match is encoded by itself. Decoding maps the pieces' characters back to bytes.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from .common import slices

#: Pre-tokens that a Python worker remembers; beyond that it starts anew. Results do not depend on it.
REMEMBERED = 400_000
NORMAL, UNKNOWN, BPE = 1, 2, 2


def byte_characters() -> list[str]:
    """A printable character for every byte: itself where Latin-1 has one, else the next from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer message: bytes, a varint, or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks from a rank file: base64 of the token, a space, its rank, a line each."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialized sentencepiece model. Piece 0 is the unknown piece; rank r is piece r + 1, so ranks must be 0, 1, 2, ..."""
    letters = byte_characters()
    ordered = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must be consecutive from 0")
    out = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, UNKNOWN))]
    for rank, token in enumerate(ordered):
        piece = "".join(letters[b] for b in token).encode()
        out.append(_field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, NORMAL)))
    trainer = _field(3, BPE) + _field(4, len(ordered) + 1) + _field(40, 0) + b"".join(_field(n, -1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder of one vocabulary, for use inside a task."""

    def __init__(self, path: str, pattern: str) -> None:
        ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.find = regex.compile(pattern).findall
        self.letters = {b: c for b, c in enumerate(byte_characters())}
        inverse = {ord(c): b for b, c in self.letters.items()}
        # A piece's characters, mapped back, are the token's bytes.
        self.tokens = [self.model.id_to_piece(i + 1).translate(inverse).encode("latin-1") for i in range(len(ranks))]
        # A match that is a token itself is that token, also where merges would not reach it.
        pieces = self.model.encode([self.mapped(t) for t in self.tokens], num_threads=1)
        self.whole = {t: (i,) for i, (t, ids) in enumerate(zip(self.tokens, pieces)) if len(ids) != 1}
        self.seen: dict[str, tuple[int, ...]] = {}

    def mapped(self, token: bytes) -> str:
        return token.decode("latin-1").translate(self.letters)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of several texts. Pre-tokens not met before are encoded in one call for all of them."""
        seen = self.seen
        if len(seen) > REMEMBERED:
            seen.clear()
        parts = [self.find(t) for t in texts]
        found = [list(map(seen.get, p)) for p in parts]
        open_rows = [k for k, f in enumerate(found) if None in f]
        new = list({part for k in open_rows for part, ids in zip(parts[k], found[k]) if ids is None})
        raw = [p.encode() for p in new]
        for part, own, ids in zip(new, raw, self.model.encode([self.mapped(r) for r in raw], num_threads=1)):
            seen[part] = self.whole.get(own) or tuple(i - 1 for i in ids)
        for k in open_rows:
            found[k] = list(map(seen.__getitem__, parts[k]))
        return [np.fromiter(chain.from_iterable(f), np.int32) for f in found]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))


def bpe_encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None,
               pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``df`` with an array of token ids of each whole text. Null and empty texts get an empty array.

    Rows stay as they are, repeated ones too; a column named ``out`` is replaced. No shuffle: batches stream
    through the tasks in slices of bounded size, and a very long text is a slice by itself. An empty table gives
    an empty result. The vocabulary file must be on every machine at ``path``.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    df = df.drop(out) if out in df.columns else df
    schema = StructType([*df.schema.fields]).add(out, ArrayType(IntegerType()))

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, text):
                at = part.schema.get_field_index(text)
                ids = _lists(bpe.encode([t or "" for t in part.column(at).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None,
               pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``df`` with the bytes that each array of ids stands for. A null array gives empty bytes; an id outside the
    vocabulary, or a null one, is an error. Other rules as for :func:`bpe_encode`."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    df = df.drop(out) if out in df.columns else df
    schema = StructType([*df.schema.fields]).add(out, BinaryType())

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                lists = part.column(part.schema.get_field_index(ids))
                raw = [bpe.decode(x.values.to_numpy().tolist() if x.is_valid else []) for x in lists]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)


def bpe_digests(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_tokens, ids_sha256 and decoded_sha256 of each whole text's encoding, and without its text:
    encoded, decoded again, and both hashed."""
    encoded = bpe_encode(df, text, "__ids")
    decoded = bpe_decode(encoded.drop(text), "__ids", "__decoded")
    return decoded.withColumns({
        "n_tokens": F.size("__ids").cast("long"),
        "ids_sha256": F.sha2(F.concat_ws(" ", F.col("__ids").cast("array<string>")), 256),
        "decoded_sha256": F.sha2("__decoded", 256),
    }).drop("__ids", "__decoded")
