"""Byte-level BPE encoding and decoding with a sentencepiece model written from a rank file.

The model is serialised directly: every token of the rank file becomes a piece whose bytes are mapped to printable
characters and whose score is its negative rank, under identity normalisation. sentencepiece then merges the pair with
the highest score, leftmost first, which is the lowest-rank-first rule of byte-level BPE.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, table

#: Unicode White_Space: what \s means in the pattern.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No match of the pattern holds a non-space followed by white space, so a text may be cut before each such run.
_CHUNK = f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+"
#: Entries of a worker's cache; beyond it the cache starts anew. It changes speed only, never results.
CACHE_ENTRIES = 800_000
CACHED_LENGTH = 64


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where it is printable Latin-1, else the next from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    mapped, following = [""] * 256, 256
    for b in range(256):
        if b in own:
            mapped[b] = chr(b)
        else:
            mapped[b] = chr(following)
            following += 1
    return mapped


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file, by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    return [tokens[i] for i in range(len(tokens))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    """A protobuf field: length-delimited for bytes, a varint for integers."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """The serialised model; piece ids are ranks, and the unknown piece that the format demands comes last."""
    characters = byte_characters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(characters[b] for b in token).encode()
        score = _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))
        out += _field(1, _field(1, piece) + score + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2))
    absent = (1 << 64) - 1  # -1: no such piece
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
    trainer += _field(41, absent) + _field(42, absent) + _field(43, absent)
    out += _field(2, trainer)
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class ByteCodec:
    """Text to little-endian unsigned 32-bit ids and back."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import re

        import regex
        import sentencepiece

        self.tokens = read_ranks(ranks_path)
        self._whole = {token: struct.pack("<I", rank) for rank, token in enumerate(self.tokens)}
        self._model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        self._characters = {b: c for b, c in enumerate(byte_characters())}
        self._pretokens = regex.compile(pattern).findall
        self._chunks = re.compile(_CHUNK).findall
        self._cache: dict[str, bytes] = {}

    def _chunk(self, chunk: str) -> bytes:
        out = []
        for pretoken in self._pretokens(chunk):
            raw = pretoken.encode()
            ids = self._whole.get(raw)
            if ids is None:
                got = self._model.encode(raw.decode("latin-1").translate(self._characters), out_type=int)
                ids = struct.pack(f"<{len(got)}I", *got)
            out.append(ids)
        joined = b"".join(out)
        if len(chunk) <= CACHED_LENGTH:
            if len(self._cache) >= CACHE_ENTRIES:
                self._cache.clear()
            self._cache[chunk] = joined
        return joined

    def encode(self, text: str) -> bytes:
        found = self._cache.get
        return b"".join([found(c) or self._chunk(c) for c in self._chunks(text)])

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in memoryview(ids).cast("I")])


@functools.lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> ByteCodec:
    """One codec for each worker process."""
    return ByteCodec(ranks_path, pattern)


def encode_documents(documents: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """All columns of `documents`, plus `ids` (binary: ids as little-endian unsigned 32-bit integers).

    Null and empty texts get no ids; equal rows get equal ids; an empty table gives an empty result. An input column
    of the name `ids` is replaced.
    """
    bounded_batches(documents.sparkSession)

    @F.pandas_udf("binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(ranks_path, pattern)
        for texts in batches:
            yield pd.Series([own.encode(t or "") for t in texts], dtype=object)

    return documents.withColumn("ids", encoded(F.col(text)))


def decode_documents(documents: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """All columns, plus `decoded` (binary). Null ids give null; an id outside the vocabulary is an error."""
    bounded_batches(documents.sparkSession)

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(ranks_path, pattern)
        for column in batches:
            yield pd.Series([None if x is None else own.decode(x) for x in column], dtype=object)

    return documents.withColumn("decoded", decoded(F.col(ids)))


def digests(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, and decoded again, in one pass over the texts.

    Null and empty texts have no ids. Very long texts are encoded whole. Equal texts give equal values, repeated rows stay,
    and an empty table gives no rows. Only doc_id and text are read, whatever else there is.
    """
    bounded_batches(documents.sparkSession)

    def both(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = own.encode(text or "")
                decoded = own.decode(ids)
                rows.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return documents.select("doc_id", "text").mapInPandas(both, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
