"""Media columns: payloads stored as lossless WebP, read back by the decoder, and described.

A payload's bytes are grey 8-bit samples, 64 to a row; a payload of more than 16,384 rows becomes several images, one after
another. Images have the transform that subtracts green, and back-references to what stands before. Texts of usual letter frequencies share one prefix code, given below by a rule, so most images
neither search for a code nor build a decoding table; other payloads get codes of their own.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp
from .common import as_bytes, batched, lean

UNIT = 64
#: Bytes from the most to the least frequent, for the usual code: the weight of the k-th is 1 / (k + 3).
FREQUENT = b" etaoinrshldcumgfpwybv,.\nkzjxqTAEISOWHBCDMP\xc3NRLFG0123456789"


@functools.cache
def usual_code() -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Code lengths of bytes and lengths of copies, and of distances."""
    order = [*dict.fromkeys(FREQUENT), *(b for b in range(256) if b not in FREQUENT)]
    counts, far = np.zeros(256 + webp.LENGTH_CODES, np.int64), np.zeros(webp.DISTANCE_CODES, np.int64)
    for k, b in enumerate(order):
        counts[b] = 60_000 // (k + 3) if k < len(FREQUENT) else 12
    for k in range(5, webp.LENGTH_CODES):  # 8 bytes and more
        counts[256 + k] = 6_000 // (k - 4)
    far[13:] = 8  # 121 and more
    far[16:26] = 64
    return tuple(webp._limited(counts, 14)), tuple(webp._limited(far, 14))


def padded(body: bytes) -> bytes:
    """Zero bytes up to a positive multiple of UNIT."""
    return body + bytes(-len(body) % UNIT or (0 if body else UNIT))


def store(payload: bytes) -> bytes:
    """The images of a payload."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    parts = (samples[at : at + webp.MOST_SIDE].astype(np.uint32) * np.uint32(0x10101) for at in range(0, len(samples), webp.MOST_SIDE))
    return b"".join(webp.encode(np.uint32(webp.OPAQUE) | x, palette=False, green=True, usual=usual_code(), copies=True) for x in parts)


def load(media: bytes) -> np.ndarray:
    """The samples of stored images, one row of UNIT each."""
    parts, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        parts.append((webp.decode(media[at : at + size]) >> np.uint32(8)).astype(np.uint8))
        at += size
    return np.concatenate(parts)


def describe(samples: np.ndarray) -> str:
    """Rows, mean, entropy in bits and the commonest sample."""
    n = np.bincount(samples.ravel(), minlength=256)
    p = n[n > 0] / samples.size
    return f"rows={len(samples)};mean={samples.mean():.4f};bits={-(p * np.log2(p)).sum():.4f};mode={int(n.argmax())}"


COLUMNS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
MEDIA = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return lean(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media (the stored images) of every row."""

    def run(batches):
        yield from batched(((i, store(padded(x))) for b in batches for i, x in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True)), MEDIA, weigh=1)

    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id long, media binary")


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: sizes and digests of the payload as read back from its stored form, and a feature.

    A null text counts as empty and has a payload of 64 zero bytes. Equal texts give equal values; repeated rows each give a
    row; other columns are not read; an empty table gives an empty result."""

    def out(i, body):
        media = store(padded(body))
        samples = load(media)
        back = samples.tobytes()
        return i, len(body), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), describe(samples)

    def run(batches):
        yield from batched((out(i, x) for b in batches for i, x in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True)), COLUMNS)

    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
