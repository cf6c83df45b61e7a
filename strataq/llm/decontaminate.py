"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, training token windows scanned against it.

Words are maximal runs of characters other than the ASCII ones that are neither digits nor letters, after A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strataq.llm.common import nested, slices, staged, unnested

WINDOW = 10
#: Bytes of benchmark text in one broadcast set. A larger benchmark is dealt over several sets, each scanned in a pass of its own.
SET_BYTES = 16 << 20
#: Bytes that a built set may take in the driver and in each worker: an item far beyond SET_BYTES is refused.
SET_MEMORY = 1 << 30

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text, as UTF-8; a null text has none."""
    return (text or "").encode().translate(_LOWER).split()


class Grams:
    """Windows of the items, in arrays: all items' words as one stream of ids, and for each length of windows the distinct windows
    by hash, each with a place of it in the stream and its items. Some 30 bytes for each word of the benchmark, and its
    distinct words."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        streams = [np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)], np.uint32) for _, text in items]
        self.stream = np.concatenate([*streams, np.zeros(0, np.uint32)])
        sizes = np.array([len(s) for s in streams], np.int64)
        starts = np.cumsum(sizes) - sizes
        lengths = np.minimum(sizes, window)
        self.by_length = {}
        for n in sorted(set(lengths[lengths > 0].tolist())):
            mine = np.flatnonzero(lengths == n)
            counts = sizes[mine] - n + 1
            owner = np.repeat(mine, counts)
            place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts[mine], counts)
            keys = self.hashes(place, n)
            order = np.lexsort((place, keys))
            keys, place, owner = keys[order], place[order], owner[order]
            same = keys[1:] == keys[:-1]
            for k in range(n):  # equal hashes of unequal windows begin a window of their own
                same &= self.stream[place[1:] + k] == self.stream[place[:-1] + k]
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            self.by_length[n] = (keys[first], place[first], np.append(first, len(keys)), owner)

    def hashes(self, place: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the windows of n words at places of the stream."""
        return _hashes(self.stream, place, n)

    @property
    def nbytes(self) -> int:
        """Bytes held, about: arrays, and words with their place in a dictionary."""
        return self.stream.nbytes + sum(x.nbytes for found in self.by_length.values() for x in found) + sum(len(w) + 130 for w in self.ids)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged hit ranges [start, end) of words, and the items of which a window occurs."""
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint32, len(words))
        run = np.concatenate([[0], np.cumsum(ids != 0)])
        spans, found = [], set()
        for n, (keys, place, bounds, owner) in self.by_length.items():
            if len(ids) < n:
                continue
            whole = np.flatnonzero(run[n:] - run[:-n] == n)  # windows of benchmark words only
            if not len(whole):
                continue
            h = _hashes(ids, whole, n)
            at = np.searchsorted(keys, h)
            while len(at):  # verified; windows of one hash stand beside each other
                live = at < len(keys)
                live[live] = keys[at[live]] == h[live]
                whole, h, at = whole[live], h[live], at[live]
                same = np.ones(len(at), bool)
                for k in range(n):
                    same &= ids[whole + k] == self.stream[place[at] + k]
                spans += [(s, s + n) for s in whole[same].tolist()]
                for g in set(at[same].tolist()):
                    found.update(owner[bounds[g] : bounds[g + 1]].tolist())
                at = at + 1
        return merged(spans), {self.names[i] for i in found}


def _hashes(ids: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(place), np.uint64)
    for k in range(n):
        out = (out ^ ids[place + k]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def removed(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words in the ranges and without what stands between two words of a range."""
    raw = text.encode()
    lowered = np.frombuffer(raw.translate(_LOWER), np.uint8)
    inside = np.concatenate([[False], lowered != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : starts[a]])
        last = int(ends[b - 1])
    return b"".join([*out, raw[last:]]).decode()


def _sets(benchmark: DataFrame, item: str, text: str) -> list[list[tuple]]:
    """The benchmark in sets of at most SET_BYTES (an item over that is alone), one after another by hash of the item."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text") + 64).alias("n")).collect()[0]["n"] or 0
    n = max(1, -(-2 * size // SET_BYTES)) if size > SET_BYTES else 1
    return [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[Column], text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, remove: str | None = None) -> DataFrame:
    """For every document row: `keep` columns, n_words, n_hit, n_items, items (sorted as strings) and, with remove="spans",
    `cleaned`: the text without its hit words; with remove="documents", only rows without a hit, and their text as it is.

    A window is `window` consecutive words of an item; a shorter item is one window. Null texts have no words; items without
    words have no window; null item ids stand behind windows but aren't listed. Documents aren't shuffled while the benchmark
    fits one set of SET_BYTES. Beyond it each set is scanned in its own pass over all documents, and a document's ranges are
    merged: a stated query set against all rows, in blocks. Repeated rows are judged each by itself; an empty benchmark hits
    nothing. A kept column with the name of an added one is left out.
    """
    base = docs.select(nested(keep), F.col(text).alias("_text"))
    sets = _sets(benchmark, item, item_text)
    added = [*["cleaned"] * bool(remove), "n_words", "n_hit", "n_items", "items"]
    if len(sets) == 1:
        return unnested(_pass(base, sets[0], window, remove), added)
    base = staged(base.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
    parts = [_pass(base, one, window, None).select("_row", "n_words", "_spans", "items") for one in sets]
    every = parts[0]
    for one in parts[1:]:
        every = every.unionByName(one)
    # one row of a document from each set: as many as there are sets
    whole = every.groupBy("_row").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("_spans")).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = base.join(whole, "_row").drop("_row")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for b in slices(whole_batch, "_text"):
                spans = [merged([(x["a"], x["b"]) for x in s]) for s in b.column("_spans").to_pylist()]
                yield _finished(b, ["_kept"], spans, b.column("n_words").to_pylist(), b.column("items").to_pylist(), remove)

    return unnested(joined.mapInArrow(finish, _schema([joined.schema["_kept"]], remove)), added)


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _schema(kept: list, remove: str | None) -> StructType:
    added = ", ".join([*["cleaned string"] * bool(remove), "n_words long, n_hit long, n_items long, items array<string>, _spans array<struct<a:bigint,b:bigint>>"])
    return StructType([*kept, *StructType.fromDDL(added)])


def _finished(b: pa.RecordBatch, kept: list[str], spans: list, n_words: list, items: list, remove: str | None) -> pa.RecordBatch:
    columns = [b.column(n) for n in kept]
    names = list(kept)
    if remove:
        texts = b.column("_text").to_pylist()
        columns.append(pa.array([removed(t, s) if s and remove == "spans" else t for t, s in zip(texts, spans, strict=True)], pa.string()))
        names.append("cleaned")
    columns += [pa.array(n_words, pa.int64()), pa.array([sum(y - x for x, y in s) for s in spans], pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array([[{"a": x, "b": y} for x, y in s] for s in spans], _SPANS)]
    out = pa.RecordBatch.from_arrays(columns, [*names, "n_words", "n_hit", "n_items", "items", "_spans"])
    return out.filter(pa.array([not s for s in spans], pa.bool_())) if remove == "documents" else out


def _pass(base: DataFrame, items: DataFrame, window: int, remove: str | None) -> DataFrame:
    grams = Grams([(r["item"], r["text"]) for r in items.collect()], window)  # at most SET_BYTES of text
    if grams.nbytes > SET_MEMORY:
        raise ValueError(f"a set of benchmark windows takes {grams.nbytes} bytes")
    known = base.sparkSession.sparkContext.broadcast(grams)
    kept = [f for f in base.schema.fields if f.name != "_text"]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = known.value
        for whole in batches:
            for b in slices(whole, "_text"):
                spans, items, counts = [], [], []
                for t in b.column("_text"):
                    words = words_of(t.as_py())
                    hit, found = grams.scan(words)
                    spans.append(hit), items.append(sorted(x for x in found if x is not None)), counts.append(len(words))
                yield _finished(b, names, spans, counts, items, remove)

    return base.mapInArrow(run, _schema(kept, remove))
