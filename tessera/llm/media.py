"""Media columns: types by signature sniffing, carving of embedded media, lossless storage of bytes as audio samples.

An Aho-Corasick automaton finds every magic number of a value in one pass; the validator of its format then walks the
structure from there and gives the length, or rejects the place. Declared types give way to what was confirmed.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, put_back, set_apart, table

#: The magic numbers of the formats.
SIGNATURES = {
    "bmp": b"BM",
    "gif": b"GIF8",
    "jpeg": b"\xff\xd8\xff",
    "png": b"\x89PNG\r\n\x1a\n",
    "riff": b"RIFF",
}
#: The form types of RIFF files and the types they stand for.
RIFF_FORMS = {b"WAVE": "wav", b"WEBP": "webp", b"AVI ": "avi"}
PAD_BYTE, PAD_MULTIPLE = b"\x20", 192
SAMPLE_RATE = 8000


def _png(data: bytes, at: int) -> tuple[str, int] | None:
    place, first = at + 8, True
    while place + 12 <= len(data):
        (length,) = struct.unpack_from(">I", data, place)
        kind, end = data[place + 4 : place + 8], place + 12 + length
        if end > len(data) or first and (kind != b"IHDR" or length != 13):
            return None
        if zlib.crc32(data[place + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return None
        if kind == b"IEND":
            return "png", end - at
        place, first = end, False
    return None


def _jpeg(data: bytes, at: int) -> tuple[str, int] | None:
    place = at + 2
    while place + 4 <= len(data) and data[place] == 0xFF:
        marker = data[place + 1]
        if marker == 0xD9:
            return "jpeg", place + 2 - at
        (length,) = struct.unpack_from(">H", data, place + 2)
        if length < 2:
            return None
        place += 2 + length
        if marker == 0xDA:  # entropy-coded data up to a marker that is neither a stuffed byte nor a restart
            place = data.find(b"\xff", place)
            while 0 <= place < len(data) - 1 and (data[place + 1] == 0 or 0xD0 <= data[place + 1] <= 0xD7):
                place = data.find(b"\xff", place + 2)
            if place < 0 or place >= len(data) - 1:
                return None
            if data[place + 1] == 0xD9:
                return "jpeg", place + 2 - at
    return None


def _gif(data: bytes, at: int) -> tuple[str, int] | None:
    if data[at + 4 : at + 6] not in (b"7a", b"9a") or at + 13 > len(data):
        return None
    flags = data[at + 10]
    place = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)

    def blocks(start: int) -> int:
        while start < len(data) and data[start]:
            start += 1 + data[start]
        return start + 1

    while place < len(data):
        kind = data[place]
        if kind == 0x3B:
            return "gif", place + 1 - at
        if kind == 0x21:
            place = blocks(place + 2)
        elif kind == 0x2C and place + 10 < len(data):
            own = data[place + 9]
            place = blocks(place + 11 + (3 << (own & 7) + 1 if own & 0x80 else 0))
        else:
            return None
    return None


def _bmp(data: bytes, at: int) -> tuple[str, int] | None:
    if at + 30 > len(data):
        return None
    size, _, pixels, header = struct.unpack_from("<IIII", data, at + 2)
    if header not in (12, 40, 52, 56, 64, 108, 124) or not 14 + header <= pixels <= size or at + size > len(data):
        return None
    return "bmp", size


def riff_chunks(data: bytes, at: int = 0) -> dict[bytes, tuple[int, int]] | None:
    """Place and length of each chunk of the RIFF file that starts at `at`; None if its lengths contradict."""
    if at + 12 > len(data):
        return None
    (size,) = struct.unpack_from("<I", data, at + 4)
    end, place, found = at + 8 + size, at + 12, {}
    if size < 4 or end > len(data):
        return None
    while place + 8 <= end:
        (length,) = struct.unpack_from("<I", data, place + 4)
        if place + 8 + length > end:
            return None
        found.setdefault(data[place : place + 4], (place + 8, length))
        place += 8 + length + (length & 1)
    return found if place >= end else None


def _riff(data: bytes, at: int) -> tuple[str, int] | None:
    kind = RIFF_FORMS.get(data[at + 8 : at + 12])
    chunks = riff_chunks(data, at) if kind else None
    if chunks is None or kind == "wav" and not {b"fmt ", b"data"} <= chunks.keys():
        return None
    return kind, struct.unpack_from("<I", data, at + 4)[0] + 8


VALIDATORS = {"bmp": _bmp, "gif": _gif, "jpeg": _jpeg, "png": _png, "riff": _riff}


@functools.cache
def _automaton():
    import ahocorasick

    own = ahocorasick.Automaton()
    for name, magic in SIGNATURES.items():
        own.add_word(magic.decode("latin-1"), (name, len(magic)))
    own.make_automaton()
    return own


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of all confirmed media in `data`, by offset, those inside others too."""
    found = []
    for last, (name, width) in _automaton().iter(data.decode("latin-1")):
        at = last - width + 1
        if confirmed := VALIDATORS[name](data, at):
            found.append((confirmed[0], at, confirmed[1]))
    return sorted(found, key=lambda x: (x[1], -x[2]))


#: Types that a declaration may name and that bytes then have to confirm.
KNOWN_TYPES = {*RIFF_FORMS.values(), *SIGNATURES} - {"riff"}


def corrected_type(places: list[tuple[str, int, int]], size: int, told: str | None) -> str | None:
    """The type confirmed for the whole value, else the declared one, but none where bytes contradict a known one."""
    whole = [kind for kind, at, n in places if (at, n) == (0, size)]
    return whole[0] if whole else None if told in KNOWN_TYPES and size else told


def sniff_media(df: DataFrame, content: str = "content", declared: str | None = None) -> DataFrame:
    """All columns of df, plus media_type, embedded and corrected.

    media_type is the type confirmed at offset 0 for the whole value, or else the declared one, but null where the
    declared one names a known format that the bytes contradict. corrected: media_type differs from the declared
    type. embedded: array of (type, offset, length, sha256) of the other media found inside, also of those inside
    others, by offset. Null or empty content has the declared type and nothing embedded. Repeated rows get equal values,
    values of any length are read whole, an empty table gives no rows. Columns of these names in df are replaced.
    """
    bounded_batches(df.sparkSession)
    used, more = (content, *([declared] if declared else [])), ("media_type", "embedded", "corrected")

    @F.pandas_udf("media_type string, embedded array<struct<type:string,offset:long,length:long,sha256:string>>")
    def looked(contents: pd.Series, types: pd.Series) -> pd.DataFrame:
        rows = []
        for data, told in zip(contents, types):
            data = bytes(data or b"")
            places = sniff(data)
            kind = corrected_type(places, len(data), told)
            inner = [(t, at, n, hashlib.sha256(data[at : at + n]).hexdigest()) for t, at, n in places if (at, n) != (0, len(data))]
            rows.append((kind, [dict(zip(("type", "offset", "length", "sha256"), x)) for x in inner]))
        return pd.DataFrame(rows, columns=["media_type", "embedded"])

    told = F.col(declared) if declared else F.lit(None).cast("string")
    seen = set_apart(df, used).withColumn("_seen", looked(F.col(content), told))
    seen = seen.withColumns({"media_type": F.col("_seen.media_type"), "embedded": F.col("_seen.embedded"), "corrected": ~F.col("_seen.media_type").eqNullSafe(told)})
    return put_back(seen, df.columns, used, more)


def carve_media(df: DataFrame, content: str = "content") -> DataFrame:
    """A row for each embedded medium of `df` after sniff_media: df's columns, plus carved_type and carved (binary).

    Rows without embedded media give none. Columns of these names in df are replaced.
    """
    used, more = (content, "embedded"), ("carved_type", "carved")
    one = set_apart(df, used).withColumn("_one", F.explode("embedded"))
    piece = F.substring(F.col(content), (F.col("_one.offset") + 1).cast("int"), F.col("_one.length").cast("int"))
    return put_back(one.withColumns({"carved_type": F.col("_one.type"), "carved": piece}), df.columns, used, more)


def pad(raw: bytes) -> bytes:
    target = max(PAD_MULTIPLE, -(-len(raw) // PAD_MULTIPLE) * PAD_MULTIPLE)
    return raw.ljust(target, PAD_BYTE)


def to_wav(payload: bytes) -> bytes:
    """A mono wave file whose unsigned 8-bit samples are the payload's bytes."""
    fmt = struct.pack("<HHIIHH", 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body) + len(payload) % 2) + body + b"\0" * (len(payload) % 2)


def from_wav(media: bytes) -> bytes:
    """The samples of a file that to_wav made."""
    chunks = riff_chunks(media)
    if chunks is None or b"data" not in chunks:
        raise ValueError("not a wave file")
    at, length = chunks[b"data"]
    return media[at : at + length]


def features(kind: str, samples: bytes, inside: list[tuple[str, int, int]]) -> str:
    """Type, number of samples, their mean, root mean square and peak about 128, zero crossings, media inside."""
    wave = np.frombuffer(samples, np.uint8).astype(np.int16) - 128
    level = np.sqrt(np.mean(np.square(wave, dtype=np.float64)))
    crossings = np.count_nonzero(np.diff(wave >= 0))
    embedded = ",".join(f"{t}@{at}+{n}" for t, at, n in inside) or "none"
    return f"{kind};n={len(wave)};mean={wave.mean():.4f};rms={level:.4f};peak={np.abs(wave).max()};cross={crossings};embedded={embedded}"


#: What the store declares its values to be: nothing but bytes, which sniffing corrects.
DECLARED = "bin"


def store_text(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media and declared: each whole text (null: empty) as UTF-8, padded, in a file of 8-bit samples.

    Repeated rows and equal texts give equal media, texts of any length are stored whole, an empty table gives no rows.
    Only doc_id and text are read, whatever else there is.
    """
    bounded_batches(documents.sparkSession)

    @F.pandas_udf("binary")
    def stored(texts: pd.Series) -> pd.Series:
        return pd.Series([to_wav(pad((t or "").encode())) for t in texts], dtype=object)

    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long").alias("n_bytes")
    return documents.select("doc_id", size, stored(text).alias("media"), F.lit(DECLARED).alias("declared"))


def read_media(stored: DataFrame) -> DataFrame:
    """Read the media of store_text back: digests and features of what the stored bytes hold, media_type and corrected.

    The type comes from sniffing, which corrects the declared one; payloads and the media embedded in them are found
    through it. Equal media give equal values; an empty table gives none.
    """
    bounded_batches(stored.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for media, told in zip(batch["media"], batch["declared"]):
                media = bytes(media)
                places = sniff(media)
                kind = corrected_type(places, len(media), told)
                if kind != "wav":
                    raise ValueError("a stored value is not the wave file that was written")
                start, length = riff_chunks(media)[b"data"]
                payload = media[start : start + length]
                inside = [(t, at - start, n) for t, at, n in places if start <= at and at + n <= start + length]
                digest = hashlib.sha256(payload).hexdigest()
                whole = hashlib.sha256(media).hexdigest()
                rows.append((length, digest, zlib.crc32(payload[-16:]), len(media), whole, features(kind, payload, inside), kind, kind != told))
            out = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "corrected"])
            out.insert(0, "n_bytes", batch["n_bytes"].values)
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").values)
            yield out

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, corrected boolean"
    return stored.mapInPandas(read, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(store_text(table(spark, sf_dir, "documents")))
