"""Arrow-batched codecs: the compression gate, deltas with a raw-content dictionary, and sizes for analyses."""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELTA_LEVEL, MOST_DELTA = 3, 16 << 20


def gate(raw: bytes | None) -> bytes | None:
    """The LZ4 form if raw is over 1.5 times as large, else None."""
    if not raw:
        return None
    packed = pa.Codec("lz4_raw").compress(raw, asbytes=True)
    return packed if len(packed) * 3 // 2 < len(raw) else None


def delta(source: bytes, target: bytes) -> bytes:
    known = zstandard.ZstdCompressionDict(source, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=DELTA_LEVEL, dict_data=known).compress(target)


def undelta(source: bytes, blob: bytes) -> bytes:
    """The target again; ValueError beyond MOST_DELTA bytes."""
    known = zstandard.ZstdCompressionDict(source, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    size = zstandard.frame_content_size(blob)
    if size > MOST_DELTA:
        raise ValueError("delta target too large")
    return zstandard.ZstdDecompressor(dict_data=known).decompress(blob, max_output_size=MOST_DELTA)


@F.pandas_udf(T.LongType())
def gated_size(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else len(gate(x) or x)).astype("Int64")


@F.pandas_udf(T.LongType())
def packed_size(raw: pd.Series) -> pd.Series:
    pack = zstandard.ZstdCompressor(level=DELTA_LEVEL)
    return raw.map(lambda x: None if x is None else len(pack.compress(x))).astype("Int64")


@F.pandas_udf(T.LongType())
def delta_size(source: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else len(delta(a, b)) for a, b in zip(source, target, strict=True)], dtype="Int64")


@F.pandas_udf(T.BooleanType())
def delta_round_trip(source: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([hashlib.sha256(undelta(a, delta(a, b))).digest() == hashlib.sha256(b).digest() for a, b in zip(source, target, strict=True)])
