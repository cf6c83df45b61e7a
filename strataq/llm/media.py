"""Media columns: content-addressed payloads in tar shards; rows carry digest, shard, offset and length.

A payload is stored losslessly as an 8-bit greyscale PNG of WIDTH samples a row, under its SHA-256 as its name, in plain tar
shards below the shared folder. Rows never carry payloads: header-only range reads fill the metadata columns, and whole
range reads, by the same shard, offset and length, decode and describe the samples.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strataq.llm.common import nested, new_path, slices, staged, unnested

WIDTH, LEVEL = 64, 6
#: Bytes after which a task begins another shard; it also forgets then which digests it has stored.
SHARD_BYTES = 128 << 20
#: Stored bytes that one task reads back, about.
READ_BYTES = 8 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33  # the signature and the IHDR chunk


def padded(raw: bytes) -> bytes:
    """raw with bytes 0 up to a positive multiple of WIDTH."""
    return raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """The payload (a positive multiple of WIDTH bytes) as a PNG."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # each row begins with filter type 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header(raw: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first HEADER_BYTES of a PNG; ValueError if these are no greyscale header."""
    if len(raw) < HEADER_BYTES or raw[:8] != SIGNATURE or raw[12:16] != b"IHDR" or zlib.crc32(raw[12:29]) != struct.unpack(">I", raw[29:33])[0]:
        raise ValueError("no PNG header")
    width, height, depth, colour = struct.unpack(">IIBB", raw[16:26])
    if colour:
        raise ValueError("not greyscale")
    return width, height, depth


def decode(raw: bytes) -> bytes:
    """The samples of a PNG that encode() made."""
    width, height, _ = header(raw)
    at, data = HEADER_BYTES, []
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        if kind == b"IDAT":
            data.append(raw[at + 8 : at + 8 + n])
        at += n + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a filter type other than 0")
    return rows[:, 1:].tobytes()


def describe(payload: bytes) -> str:
    """Features of the samples: entropy in bits, mean, and the share of steps between neighbours that are rises."""
    v = np.frombuffer(payload, np.uint8)
    p = np.bincount(v, minlength=256) / len(v)
    p = p[p > 0]
    rises = float((v[1:] > v[:-1]).mean())
    return f"entropy={-(p * np.log2(p)).sum() + 0.0:.6f};mean={v.mean():.6f};rises={rises:.6f}"


class _Writer:
    """Tar shards of one task's attempt: names are unique, so what a lost attempt leaves is never referred to."""

    def __init__(self, folder: str):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.folder, self.out = folder, None

    def put(self, digest: str, blob) -> tuple[str, int, int]:
        """Where the payload with this digest stands in the shard; blob() is called only if it isn't stored there yet."""
        if self.out is None:
            self.name, self.at, self.known = f"{uuid.uuid4().hex}.tar", 0, {}
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}")
        if digest not in self.known:
            data = blob()
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + data + b"\0" * (-len(data) % 512))
            self.known[digest] = (f"{self.folder}/{self.name}", self.at + len(head), len(data))
            self.at += len(head) + len(data) + -len(data) % 512
        found = self.known[digest]
        if self.at >= SHARD_BYTES:
            self.close()
        return found

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def store(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """Writes the payload of every row's whole text (null: empty) and returns `keep` columns, n_bytes, digest (the payload's
    SHA-256, lowercase hex), shard, offset and length, staged in the shared folder beside the shards.

    Within a shard equal payloads are stored once, so a group of copies costs a copy for each shard at most; no text is
    shuffled. The shards stay as long as the rows that refer to them, and go with the application's folder. A kept column with
    the name of an added one is left out.
    """
    folder = new_path(docs.sparkSession, "media")
    kept = docs.select(nested(keep), F.col(text).alias("_text"))
    added = StructType.fromDDL("n_bytes long, digest string, shard string, offset long, length long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(folder)
        for whole in batches:
            for b in slices(whole, "_text"):
                rows = []
                for t in b.column("_text"):
                    raw = (t.as_py() or "").encode()
                    payload = padded(raw)
                    digest = hashlib.sha256(payload).hexdigest()
                    rows.append((len(raw), digest, *writer.put(digest, lambda p=payload: encode(p))))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("_kept"), *columns], ["_kept", *added.names])
        writer.close()

    return staged(unnested(kept.mapInArrow(run, StructType([kept.schema["_kept"], *added])), added.names), "media-rows")


def sweep(rows: DataFrame) -> int:
    """Deletes shards of the folder of `rows` (from store()) that no row refers to: what lost attempts of tasks have left. Returns
    how many. The driver holds one name for each shard."""
    used = {r["shard"] for r in rows.select("shard").distinct().toLocalIterator()}
    gone = 0
    for folder in {s.rpartition("/")[0] for s in used}:
        fs, root = pafs.FileSystem.from_uri(folder)
        for info in fs.get_file_info(pafs.FileSelector(root)):
            if info.is_file and f"{folder}/{info.base_name}" not in used:
                fs.delete_file(info.path)
                gone += 1
    return gone


class _Reader:
    """Range reads; keeps the last shard open."""

    def __init__(self):
        self.shard, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.shard:
            fs, path = pafs.FileSystem.from_uri(shard)
            self.shard, self.file = shard, fs.open_input_file(path)
        return self.file.read_at(length, offset)


def _read_rows(rows: DataFrame, names: str, look) -> DataFrame:
    """rows with what `look(read, row)` finds; tasks take neighbouring ranges of a shard, about READ_BYTES each."""
    total = rows.agg(F.sum("length").alias("n")).collect()[0]["n"] or 0
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // READ_BYTES))
    rows = rows.select(nested([F.col(f"`{c}`") for c in rows.columns]), "shard", "offset", "length", "digest")
    dealt = rows.repartition(tasks, "shard", F.floor(F.col("offset") / (READ_BYTES // 8))).sortWithinPartitions("shard", "offset")
    added, kinds = zip(*(n.split() for n in names.split(", ")), strict=True)
    arrow = [pa.string() if k == "string" else pa.int64() for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last, found = _Reader(), None, None
        for b in batches:
            out = []
            for place in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length", "digest")), strict=True):
                if place != last:  # copies stand beside each other: each payload is read once
                    last, found = place, look(reader.read, *place)
                out.append(found)
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow, strict=True)] if out else [pa.array([], t) for t in arrow]
            yield pa.RecordBatch.from_arrays([b.column("_kept"), *columns], ["_kept", *added])

    return unnested(dealt.mapInArrow(run, StructType([rows.schema["_kept"], *StructType.fromDDL(names)])), list(added))


def _metadata(read, shard: str, offset: int, length: int, digest: str) -> tuple:
    return header(read(shard, offset, HEADER_BYTES))


def _features(read, shard: str, offset: int, length: int, digest: str) -> tuple:
    width, height, depth = header(read(shard, offset, HEADER_BYTES))
    blob = read(shard, offset, length)
    payload = decode(blob)
    if (own := hashlib.sha256(payload).hexdigest()) != digest or len(payload) != width * height:
        raise ValueError(f"what is stored under {digest} is {own}")
    return width, height, depth, len(payload), own, zlib.crc32(payload[-WIDTH:]), length, hashlib.sha256(blob).hexdigest(), describe(payload)


def metadata(rows: DataFrame) -> DataFrame:
    """rows of store() with width, height and bit_depth, from range reads of HEADER_BYTES a payload."""
    return _read_rows(rows, "width long, height long, bit_depth long", _metadata)


def features(rows: DataFrame) -> DataFrame:
    """rows of store() with the metadata, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature,
    all from the stored bytes. A payload that isn't what its digest says stops the job with ValueError."""
    return _read_rows(rows, "width long, height long, bit_depth long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", _features)


def members(shard: bytes) -> list[str]:
    """The names in a shard, by the standard tar reader."""
    with tarfile.open(fileobj=io.BytesIO(shard)) as f:
        return f.getnames()
