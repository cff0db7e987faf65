"""Media columns: payloads as progressive JPEG files, read back to coefficients and full-resolution RGB tensors.

Defined results: a null or empty text is a payload of 64 zero bytes; equal texts give equal files, tensors and features;
repeated rows give repeated result rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from . import jpeg
from .common import map_texts

# payload bytes in arrays at a time
PIECE_BYTES = 2_000_000


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length in UTF-8, and the bytes followed by zeros up to a positive multiple of 64."""
    raw = text.encode() if text else b""
    return len(raw), raw + bytes(-len(raw) % 64 if raw else 64)


def encode(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with ``n_bytes`` and ``media``, the file that holds the text's payload."""
    schema = StructType([StructField("n_bytes", LongType()), StructField("media", BinaryType())])

    def run(texts: list) -> list:
        sized = [payload_of(t) for t in texts]
        return [[n for n, _ in sized], jpeg.encode([p for _, p in sized])]

    return map_texts(df, text_col, keep, schema, lambda: run, PIECE_BYTES)


def feature(tensor) -> str:
    """Size, sums of the channels, checksum of all samples."""
    h, w, _ = tensor.shape
    sums = tensor.reshape(-1, 3).sum(axis=0, dtype="int64").tolist()
    return f"{w}x{h}:" + ",".join(map(str, sums)) + f":{zlib.crc32(tensor.tobytes()):08x}"


def decode(df: DataFrame, keep: list[str], media_col: str = "media", tensor: bool = True) -> DataFrame:
    """``keep`` columns with ``payload``, ``width``, ``height``, ``feature`` and, if asked for, ``tensor`` (height x width x 3 bytes)."""
    fields = [StructField("payload", BinaryType()), StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("feature", StringType())]
    schema = StructType(fields + [StructField("tensor", BinaryType())] * tensor)

    def run(files: list) -> list:
        images = [jpeg.Image(f) for f in files]
        coefs, first = jpeg.coefficients(images)
        rgb = jpeg.tensors(images, coefs, first)
        out = [jpeg.payloads(images, coefs, first), [x.width for x in images], [x.height for x in images], [feature(t) for t in rgb]]
        return out + [[t.tobytes() for t in rgb]] * tensor

    return map_texts(df, media_col, keep, schema, lambda: run, PIECE_BYTES)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, sizes, digests of the payload read back and of the stored file, feature."""
    stored = encode(df, [id_col], text_col)
    back = decode(stored, [id_col, "n_bytes", "media"], "media", tensor=False)
    return back.select(
        id_col, "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature")
