"""Byte-level BPE encoding and decoding with length-bucketed padded numpy matrices.

Distinct pretokens are laid out as rows of part ids, padded to the width of their length bucket. In each round every row
finds its leftmost pair of minimum rank by a hashed pair lookup, merges it and is compacted; rows without a pair leave.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import scanned

#: Widths of the buckets; a longer pretoken is merged by a heap over a linked list, with the same result.
WIDTHS = (4, 8, 12, 16, 24, 32, 64, 128)
#: Pretokens, and bytes of them and their ids, that a worker remembers before it forgets all, and rows of a matrix.
REMEMBERED, REMEMBERED_BYTES, ROWS = 150_000, 32 << 20, 20_000
NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=16)
def _members(what: str) -> str:
    """The members of a Unicode class below U+10000 as ranges for a character class of `re`."""
    found = [ord(c) for c in regex.findall(what, "".join(map(chr, range(0x10000))))]
    cuts = [i for i in range(1, len(found)) if found[i] != found[i - 1] + 1]
    spans = zip([found[0], *(found[i] for i in cuts)], [*(found[i - 1] for i in cuts), found[-1]], strict=True)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" if a < b else f"\\U{a:08x}" for a, b in spans)


def compiled(pattern: str) -> re.Pattern:
    """pattern, with the Unicode classes of `regex` written out as ranges: in texts below U+10000, `re` then finds the same
    matches several times faster, by one look into a bitmap for each character."""
    out, inside = [], False
    for x in re.findall(r"\\p\{\w+\}|\\[sS]|\\.|.", pattern, re.S):
        if x == r"\S" and not inside:
            out.append(f"[^{_members(chr(92) + 's')}]")
        elif x == r"\s" or x.startswith(r"\p"):
            out.append(_members(x) if inside else f"[{_members(x)}]")
        else:
            inside = (inside or x == "[") and x != "]"
            out.append(x)
    return re.compile("".join(out))


class Encoder:
    """Ranks, and a hash table from pairs of ids to the id of their concatenation (its rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.narrow = ranks, regex.compile(pattern), compiled(pattern)
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"no rank for bytes {missing[:5]}")
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        vocabulary = [b""] * size
        for token, i in ranks.items():
            vocabulary[i] = token
        self.lengths = np.array([len(x) for x in vocabulary], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(vocabulary), np.uint8)
        a, b, c = [], [], []
        for token, i in ranks.items():  # every split of a token into two tokens is a pair that may merge into it
            for k in range(1, len(token)):
                if (x := ranks.get(token[:k])) is not None and (y := ranks.get(token[k:])) is not None:
                    a.append(x), b.append(y), c.append(i)
        keys = (np.array(a, np.int64) << 32) | np.array(b, np.int64)
        self._table(keys, np.array(c, np.int32))
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probing; `probes` is the longest chain."""
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        n = 1 << self.bits
        self.slot_key, self.slot_value = np.full(n, -1, np.int64), np.full(n, NONE, np.int32)
        home, left, self.probes = self._home(keys), np.arange(len(keys)), 0
        while len(left):
            at = (home[left] + self.probes) & (n - 1)
            free = self.slot_key[at] == -1
            tried = left[free]
            first = np.unique(at[free], return_index=True)[1]
            placed = tried[first]
            spot = (home[placed] + self.probes) & (n - 1)
            self.slot_key[spot], self.slot_value[spot] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's concatenation; NONE where that is no token or a side is padding (negative)."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out, at = np.full(keys.shape, NONE, np.int32), self._home(keys)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        flat, flat_at, result = keys.ravel(), at.ravel(), out.ravel()
        for k in range(self.probes):
            if not len(todo):
                break
            spot = (flat_at[todo] + k) & ((1 << self.bits) - 1)
            found = self.slot_key[spot]
            hit = found == flat[todo]
            result[todo[hit]] = self.slot_value[spot[hit]]
            todo = todo[~hit & (found != -1)]
        return result.reshape(keys.shape)

    def merge_rows(self, parts: np.ndarray) -> np.ndarray:
        """Rows of ids padded with -1, merged until no pair is left; each round merges a row's leftmost minimum-rank pair."""
        parts, done = parts.copy(), np.full(parts.shape, -1, np.int32)
        rows = np.arange(len(parts))
        ranks = self.pair_ranks(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(parts), -1)
        while len(rows):
            j = ranks.argmin(axis=1)  # the first of equal minima
            best = ranks[np.arange(len(rows)), j]
            if (over := best == NONE).any():
                done[rows[over], : parts.shape[1]] = parts[over]
                live = ~over
                rows, parts, ranks, j, best = rows[live], parts[live], ranks[live], j[live], best[live]
                if not len(rows):
                    break
            at, columns = np.arange(len(rows)), np.arange(parts.shape[1] - 1)
            after = columns[None, :] > j[:, None]
            kept = parts[:, :-1]
            shifted = np.where(after, parts[:, 1:], kept)
            shifted[at, j] = best
            parts = shifted  # one column less: each row has lost one part
            if parts.shape[1] == 1:
                done[rows, :1] = parts
                break
            # pairs right of the merge shift left; the two beside the merged part are looked up anew
            pair_columns = np.arange(parts.shape[1] - 1)
            ranks = np.where(pair_columns[None, :] > j[:, None], ranks[:, 1:], ranks[:, :-1])
            for side in (-1, 0):
                k = j + side
                ok = (k >= 0) & (k < parts.shape[1] - 1)
                i = at[ok]
                ranks[i, k[ok]] = self.pair_ranks(parts[i, k[ok]], parts[i, k[ok] + 1])
        return done

    def merge_long(self, raw: bytes) -> np.ndarray:
        """One long pretoken, by a heap over a linked list: n log n instead of n rounds over n parts. An entry is a rank with the
        pair's place below it; it holds while the place has that rank. Some hundred bytes are held for each of the pretoken's."""
        ids = array("i", self.byte_id[np.frombuffer(raw, np.uint8)].tolist())
        n, pair = len(ids), self._pair
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        first = self.pair_ranks(np.frombuffer(ids, np.int32)[:-1].copy(), np.frombuffer(ids, np.int32)[1:].copy())
        now = array("i", np.where(first == NONE, -1, first).astype(np.int32).tolist() + [-1])
        heap = [now[i] << 40 | i for i in range(n) if now[i] >= 0]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            r, i = entry >> 40, entry & (1 << 40) - 1
            if now[i] != r:
                continue
            k = after[i]
            ids[i], ids[k], now[k] = r, -1, -1
            after[i] = after[k]
            if after[k] < n:
                before[after[k]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left < 0:
                    continue
                x = pair(ids[left], ids[right]) if right < n else None
                now[left] = -1 if x is None else x
                if x is not None:
                    heapq.heappush(heap, x << 40 | left)
        return np.array([x for x in ids if x >= 0], np.int32)

    def _pair(self, a: int, b: int) -> int | None:
        if a < 0 or b < 0:
            return None
        v = self.blob
        s, t = self.starts, self.lengths
        return self.ranks.get(v[s[a] : s[a] + t[a]].tobytes() + v[s[b] : s[b] + t[b]].tobytes())

    def learn(self, pretokens: list[str]) -> None:
        """Encodes pretokens that aren't known yet and remembers their ids as little-endian unsigned 32-bit integers."""
        raw = [p.encode() for p in pretokens]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        low = 0
        for width in WIDTHS:
            mine = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for start in range(0, len(mine), ROWS):
                rows = mine[start : start + ROWS]
                parts = np.full((len(rows), width), -1, np.int32)
                parts[np.arange(width)[None, :] < sizes[rows][:, None]] = self.byte_id[np.frombuffer(b"".join([raw[i] for i in rows]), np.uint8)]
                merged = self.merge_rows(parts)
                counts = (merged >= 0).sum(axis=1)
                ids = merged[merged >= 0].astype("<u4").tobytes()
                ends = (np.cumsum(counts) * 4).tolist()
                for i, begin, end in zip(rows.tolist(), [0, *ends[:-1]], ends, strict=True):
                    self.known[pretokens[i]] = ids[begin:end]
        for i in np.flatnonzero(sizes > low):
            self.known[pretokens[i]] = self.merge_long(raw[i]).astype("<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit integers."""
        split = [(self.narrow if len(t.encode("utf-16-le")) == 2 * len(t) else self.pattern).findall(t) for t in texts]
        if len(self.known) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.known.clear()
            self.held = 0
        fresh = set().union(*split).difference(self.known) if split else set()
        if fresh:
            self.learn(list(fresh))
            self.held += sum(len(p) + len(self.known[p]) for p in fresh)
        get = self.known.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids' tokens, gathered at once; an id that is no token raises IndexError."""
        ids = ids.astype(np.int64)
        lengths = self.lengths[ids]
        if (lengths == 0).any():
            raise IndexError("an id without a token")
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(total)].tobytes()


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """A worker's encoder; the rank file must be on every machine at this path (a package's file, not the corpus)."""
    return Encoder(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, keep: list[Column], text: str = "text") -> DataFrame:
    """`keep` columns and, for every row's whole text, n_tokens, ids (binary: little-endian unsigned 32-bit) and decoded
    (binary, decoded from the ids). A null text is the empty text: no ids, no bytes. One pass without a shuffle. A kept column
    with one of these names is left out."""

    def start():
        coder = encoder(path, pattern)

        def look(texts: pa.Array) -> list:
            ids = coder.encode_batch([t or "" for t in texts.to_pylist()])
            decoded = [coder.decode(np.frombuffer(x, "<u4")) for x in ids]
            return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())]

        return look

    return scanned(docs, keep, text, "n_tokens long, ids binary, decoded binary", start, 2 << 20)


def digests(encoded: DataFrame) -> DataFrame:
    """encoded with ids_sha256 and decoded_sha256 (lowercase hex) in place of the bytes."""
    return encoded.withColumns({"ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2("decoded", 256)}).drop("ids", "decoded")


