"""Language identification by compression with per-language zstandard raw-content dictionaries."""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import scanned

#: Bounds of the fitted sample: rows of a language, and UTF-8 bytes that a row gives to a dictionary.
SAMPLE_ROWS, SAMPLE_TEXT, MOST_LANGUAGES = 160, 4096, 512
#: Bytes of text that are encoded at once: short enough that the dictionary, not the text's own past, decides.
PIECE = 4096
LEVEL = 6
UNKNOWN = "und"


def piece_of(text: str) -> bytes:
    """The lower-cased text's first SAMPLE_TEXT bytes, without a character that the cut would part."""
    return text[:SAMPLE_TEXT].lower().encode()[:SAMPLE_TEXT].decode(errors="ignore").encode()


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, bytes]:
    """Raw-content dictionaries of lower-cased text by language, from a bounded sample of the rows where `train` holds.

    Rows with null or empty text or null lang don't enter the sample; of each language the SAMPLE_ROWS rows with the least
    hash of their key do (ties: by text), each with its first SAMPLE_TEXT bytes. Only those characters leave the executors.
    With no such row the result is empty. More than MOST_LANGUAGES distinct languages are refused with ValueError.
    """
    rows = docs.where(train).select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))
    rows = rows.where(F.col("l").isNotNull() & (F.octet_length("t") > 0)).withColumn("h", F.xxhash64("k", "t")).withColumn("t", F.substring("t", 1, SAMPLE_TEXT))
    counts = rows.groupBy("l").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    if not counts:
        return {}
    # three times the wanted share of the hash range: a small superset, of which the driver keeps the least hashes
    ceilings = [(r["l"], int(-(2**63) + min(1.0, 3 * SAMPLE_ROWS / r["count"]) * (2**64 - 1))) for r in counts]
    share = docs.sparkSession.createDataFrame([(name, min(c, 2**63 - 1)) for name, c in ceilings], "l string, ceiling long")
    got = rows.join(F.broadcast(share), "l").where("h <= ceiling").select("l", "h", "t").distinct().collect()
    texts: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r.l, r.h, r.t)):
        if len(own := texts.setdefault(r.l, [])) < SAMPLE_ROWS:
            own.append(piece_of(r.t))
    return {name: b"\n".join(parts) for name, parts in texts.items()}


def _encoders(dictionaries: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for name in sorted(dictionaries):
        raw = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=LEVEL)
        out.append((name, zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def encoded_sizes(text: str, encoders: list) -> list[int]:
    """Bytes that the whole lower-cased text takes with each dictionary, piece by piece."""
    raw = text.lower().encode()
    pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
    return [sum(len(e.compress(p)) for p in pieces) for _, e in encoders]


def decide(text: str | None, encoders: list, margin: float = 0.0) -> tuple[str, float]:
    """(language, score). `und` with score 0 if the text is null or has no letter, if nothing was learned, or if the
    smallest encoding isn't smaller than the second by over `margin` of it. Ties: the first language by name.
    score: 0.5 for a tie, up to 1 for a difference of a tenth or more (1 if only one language was learned)."""
    if text is None or not encoders or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    sizes = encoded_sizes(text, encoders)
    best = min(range(len(sizes)), key=sizes.__getitem__)
    rest = min((n for i, n in enumerate(sizes) if i != best), default=None)
    gap = 1.0 if rest is None else (rest - sizes[best]) / rest
    if margin and gap <= margin:
        return UNKNOWN, 0.0
    return encoders[best][0], 0.5 + min(gap / 0.1, 1.0) / 2


def predict(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[Column], text: str = "text", margin: float = 0.0) -> DataFrame:
    """`keep` columns (but any called lang_pred or score), lang_pred and score for every row; whole texts, one pass, no shuffle.

    The dictionaries have at most SAMPLE_ROWS * SAMPLE_TEXT bytes each and go out with the task's closure by broadcast.
    """
    known = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def start():
        encoders = _encoders(known.value)

        def look(texts: pa.Array) -> list:
            found = [decide(t.as_py(), encoders, margin) for t in texts]
            return [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]

        return look

    return scanned(docs, keep, text, "lang_pred string, score double", start)
