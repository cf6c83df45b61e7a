"""Language-model scoring by online logistic context mixing.

Bit predictors: for each context (the last two to five bytes), its hash with the bits of the byte seen so far selects
a slot with the counts of zeros and ones that followed in the corpus. Mixing: the predictors' log odds are combined by weights that a gate
selects (by bit, and by how sure the two longest contexts are); weights are learned online, a gradient step after every few
thousand predictions. Refinement: an adaptive map from the last byte and the mixed odds to what was seen there; its estimate is averaged in.

All of it is learned from all training rows. The counts are sums over tasks. Weights and refinement are learned on a fixed
tenth of the training rows, with counts from the other nine, so that they see contexts as new text does; scoring then uses
counts from all. When texts are scored nothing is learned any more, so a score doesn't depend on what a task read before.

Size: there is one model of all training rows, whatever their number. Its tables of slots grow with the training text: up to
MOST_BITS whole, then in sections of that size, twice as many each time the text outgrows them by GROUP_BYTES a section. A
window's slots all lie in one section, chosen by the last two bytes of its contexts. One section is broadcast; of several, each is
met in tasks of its own by the windows that need it, so what a task or the driver holds doesn't grow. Both ways compute the same.

A text's windows of a byte and its contexts repeat a lot: each task remembers windows (see Memory), and only those that it
doesn't remember are counted or predicted bit by bit.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strataq.llm.common import nested, slices, staged, unnested, unstage

#: Bytes of the contexts; bits of their tables at most, and by how many bits a table is below the bytes of training text.
ORDERS, MOST_BITS, BELOW = (2, 3, 4, 5), (19, 20, 21, 23), (5, 4, 3, 2)
LEAST_BITS = 14
#: Training text for which a section is made.
GROUP_BYTES = 1 << 30
#: Tables of so many sections (1, or 0 for none) are broadcast; those of more are met by windows, in tasks that hold a section.
WHOLE = 1
#: Tasks that a section is dealt over; windows of a row sent to it; text whose windows are looked up together; rows at once.
DEALT, PIECE, LOOK_BYTES, PIECE_ROWS = 8, 4096, 4 << 20, 200
REACH = max(ORDERS)
BLOCK_BITS = 14
#: Stands before each text and after it; no byte of UTF-8 text.
EDGE = 0xFF
COUNT_PRIOR, MOST_ODDS = 0.4, 11.0
LEVELS = 127 / MOST_ODDS
#: Absolute log odds from which a context counts as surer; the gate goes by this.
SURER = (0.001, 1.6, 3.5)
BATCH, RATE = 4096, 0.05
BUCKETS = 33
CHUNK_BYTES = 2 << 20
#: Text that one run of online learning sees; there are as many runs as the learning rows have of it, and they are averaged.
LANE_BYTES = 8 << 20
#: Words that a task looks up itself: a dictionary of the most frequent, then hashes. Those with at least the total count
#: / 2**bits occurrences are at most 2**bits many, whatever the corpus.
DICT_BITS, HEAD_BITS = 17, 20
REMEMBERED = 300_000
TASKS_A_SUM = 64
MEMORY_BITS = 21

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_ODD32 = np.array([0x9E3779B1, 0x85EBCA77], np.uint32)


def table_bits(n: int) -> tuple[int, ...]:
    """Bits of the contexts' tables for n bytes of training text."""
    return tuple(max(LEAST_BITS, min(most, n.bit_length() - below)) for most, below in zip(MOST_BITS, BELOW, strict=True))


def sections_for(n: int) -> int:
    """Sections of the tables for n bytes of training text, a power of two."""
    return 1 << max(0, -(-n // GROUP_BYTES) - 1).bit_length()


def section_of(windows: np.ndarray, sections: int) -> np.ndarray:
    """The section of each window's slots: by the two bytes before its byte, which are in all of its contexts."""
    x = ((windows >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.uint32) * _ODD32[0]
    x ^= x >> np.uint32(15)
    return ((x * _ODD32[1]).astype(np.uint64) * np.uint64(sections) >> np.uint64(32)).astype(np.int32)


def packed(texts: list[bytes]) -> np.ndarray:
    """The window of each byte and each end of the texts, in order, each text between EDGEs: the byte lowest, above it those
    before it, the last first."""
    edge, pad = bytes([EDGE]), bytes([EDGE]) * 7
    joined = pad + b"".join(t + edge + pad for t in texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(sizes + 7)
    steps = np.zeros(len(joined) - 6, np.int8)
    steps[ends - sizes - 7] += 1
    steps[ends - 7] -= 1
    inside = np.cumsum(steps[:-1], dtype=np.int8).astype(bool)
    every = np.ndarray(len(inside), ">u8", joined, strides=(1,))  # the eight bytes up to each place
    return every[inside].astype(np.uint64) & np.uint64((1 << 8 * (REACH + 1)) - 1)


def rows_of(windows: np.ndarray) -> np.ndarray:
    """Packed windows as rows of REACH + 1 bytes."""
    return np.ascontiguousarray(windows).view(np.uint8).reshape(-1, 8)[:, : REACH + 1]


class Memory:
    """Direct-mapped memory of windows with a number for each. A window that isn't met in a chunk gives way to a new one."""

    def __init__(self, kind: type):
        self.keys = np.full(1 << MEMORY_BITS, 2**64 - 1, np.uint64)  # no window has all bits
        self.values = np.zeros(1 << MEMORY_BITS, kind)

    @staticmethod
    def places(windows: np.ndarray) -> np.ndarray:
        return ((windows * _ODD[0]) >> np.uint64(64 - MEMORY_BITS)).astype(np.int64)

    def replace(self, new: np.ndarray, values: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Remembers distinct windows where the place wasn't met. Returns windows and values that gave way, and the numbers
        of those new ones that have no place."""
        at = self.places(new)
        free = np.flatnonzero(~met[at])
        last = np.zeros(len(self.keys), np.int32)
        last[at[free]] = free
        won = free[last[at[free]] == free]
        spots = at[won]
        gone = self.keys[spots], self.values[spots]
        self.keys[spots], self.values[spots] = new[won], values[won]
        lost = np.ones(len(new), bool)
        lost[won] = False
        held = gone[0] != np.uint64(2**64 - 1)
        return gone[0][held], gone[1][held], np.flatnonzero(lost)


def context_hashes(rows: np.ndarray) -> list[np.ndarray]:
    """32-bit hashes of each window's contexts, in the order of ORDERS."""
    out, h = [], np.full(len(rows), _ODD[-1], np.uint64)
    for j in range(1, REACH + 1):
        h = (h ^ rows[:, j]) * _ODD[j % len(_ODD)]
        h ^= h >> np.uint64(31)
        if j in ORDERS:
            out.append((h >> np.uint64(16)).astype(np.uint32))
    return out


class Slots:
    """Where slots stand in the joint table of all contexts."""

    def __init__(self, bits: tuple[int, ...]):
        self.bits, self.starts = bits, np.cumsum([0, *(1 << b for b in bits)])
        self.total = int(self.starts[-1])

    def at(self, h: np.ndarray, node: np.ndarray, i: int) -> np.ndarray:
        """The i-th context's slots for its hashes and the bits seen so far (with a leading 1)."""
        x = (h ^ node * _ODD32[0]) * _ODD32[1]
        x ^= x >> np.uint32(15)
        x *= _ODD32[0]
        return (x >> np.uint32(32 - self.bits[i])).astype(np.int64) + self.starts[i]


def bits_of(rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each bit of the windows' bytes: its number, the bits before it with a leading 1, and the bit."""
    byte = rows[:, 0].astype(np.uint32)
    for bit in range(8):
        yield bit, (np.uint32(1) << np.uint32(bit)) | (byte >> np.uint32(8 - bit)), (byte >> np.uint32(7 - bit)) & np.uint32(1)


def add_counts(counts: np.ndarray, slots: Slots, rows: np.ndarray, times: np.ndarray) -> None:
    """Adds the bits of distinct windows, with their counts, to the joint table, two cells for a slot."""
    n, hashes = times.astype(counts.dtype), context_hashes(rows)
    for _, node, side in bits_of(rows):
        for i, h in enumerate(hashes):
            np.add.at(counts, 2 * slots.at(h, node, i) + side, n)


class Counts:
    """Counts of a task: windows in memory, and the joint table that they go to when they give way."""

    def __init__(self, slots: Slots):
        self.slots, self.table, self.memory, self.seen = slots, np.zeros(2 * slots.total, np.uint32), Memory(np.uint32), 0

    def _spill(self, windows: np.ndarray, times: np.ndarray) -> None:
        for start in range(0, len(windows), 1 << 15):
            add_counts(self.table, self.slots, rows_of(windows[start : start + (1 << 15)]), times[start : start + (1 << 15)])

    def add(self, windows: np.ndarray) -> None:
        self.seen += len(windows)
        at = self.memory.places(windows)
        hit = self.memory.keys[at] == windows
        met = np.bincount(at[hit], minlength=len(self.memory.keys))
        self.memory.values += met.astype(np.uint32)
        new, times = np.unique(windows[~hit], return_counts=True)
        gone, held, lost = self.memory.replace(new, times, met > 0)
        self._spill(gone, held)
        self._spill(new[lost], times[lost])

    def blocks(self) -> list[tuple[int, bytes]]:
        """The filled blocks, packed; the counts begin anew."""
        held = np.flatnonzero(self.memory.values)
        self._spill(self.memory.keys[held], self.memory.values[held])
        pack, blocks = zstandard.ZstdCompressor(level=1), self.table.reshape(-1, 2 << BLOCK_BITS)
        out = [(int(i), pack.compress(blocks[i].tobytes())) for i in np.flatnonzero(blocks.any(axis=1))]
        self.__init__(self.slots)
        return out


def pieces(windows: np.ndarray, sections: int, values: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """(section, windows, values) of at most PIECE sorted windows, compressed."""
    pack, own = zstandard.ZstdCompressor(level=1), section_of(windows, sections)
    order = np.argsort(own, kind="stable")
    ends = np.searchsorted(own[order], np.arange(sections + 1))
    for section in np.flatnonzero(np.diff(ends)):
        for start in range(ends[section], ends[section + 1], PIECE):
            at = order[start : min(start + PIECE, ends[section + 1])]
            yield int(section), pack.compress(np.diff(windows[at], prepend=np.uint64(0)).tobytes()), pack.compress(values[at].tobytes())


def _plain(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _windows(raw: bytes) -> np.ndarray:
    return np.cumsum(_plain(raw, np.uint64), dtype=np.uint64)


class Spilled(Counts):
    """Counts of a task that hold no table: what gives way is kept to be sent to the sections."""

    def __init__(self):
        self.memory, self.seen, self.out = Memory(np.uint32), 0, []

    def _spill(self, windows: np.ndarray, times: np.ndarray) -> None:
        if len(windows):
            self.out.append((windows, times.astype(np.uint32)))

    def waiting(self) -> int:
        return sum(len(w) for w, _ in self.out)

    def sent(self, sections: int) -> Iterator[tuple[int, bytes, bytes]]:
        if self.out:
            windows, times = map(np.concatenate, zip(*self.out, strict=True))
            order = np.argsort(windows)
            self.out = []
            yield from pieces(windows[order], sections, times[order])

    def rest(self, sections: int) -> Iterator[tuple[int, bytes, bytes]]:
        held = np.flatnonzero(self.memory.values)
        self._spill(self.memory.keys[held], self.memory.values[held])
        yield from self.sent(sections)
        self.__init__()


def count_sections(docs: DataFrame, text: str, kind: int, bits: tuple[int, ...], sections: int) -> DataFrame:
    """As count_slots, with a section's blocks numbered after those of the sections before it. Tasks send windows with their
    counts to the sections; each section is counted by DEALT tasks."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, salt = Spilled(), TaskContext.get().partitionId() % DEALT

        def rows(found: Iterator[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
            for section, windows, times in found:
                yield pa.RecordBatch.from_arrays([pa.array([section], pa.int32()), pa.array([salt], pa.int32()), pa.array([windows], pa.binary()), pa.array([times], pa.binary())], ["section", "salt", "windows", "times"])

        for whole in batches:
            for b in slices(whole, text, CHUNK_BYTES):
                counts.add(packed([(t or "").encode() for t in b.column(text).to_pylist()]))
                if counts.seen >> 30:
                    yield from rows(counts.rest(sections))
                elif counts.waiting() > 1 << 20:
                    yield from rows(counts.sent(sections))
        yield from rows(counts.rest(sections))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, pack, last, table, seen = Slots(bits), zstandard.ZstdCompressor(level=1), None, None, 0

        def done() -> Iterator[pa.RecordBatch]:
            blocks = table.reshape(-1, 2 << BLOCK_BITS)
            for i in np.flatnonzero(blocks.any(axis=1)):
                yield pa.RecordBatch.from_arrays([pa.array([last[0] * len(blocks) + int(i)], pa.int32()), pa.array([kind], pa.int32()), pa.array([pack.compress(blocks[i].tobytes())], pa.binary())], ["block", "kind", "counts"])

        for b in batches:
            for *key, windows, times in zip(*(b.column(c).to_pylist() for c in ("section", "salt", "windows", "times")), strict=True):
                n = _plain(times, np.uint32)
                more = int(n.sum(dtype=np.uint64))
                if key != last or seen + more >> 32:  # more than a cell can hold
                    if last is not None:
                        yield from done()
                    last, table, seen = key, np.zeros(2 * slots.total, np.uint32), 0
                seen += more
                add_counts(table, slots, rows_of(_windows(windows)), n)
        if last is not None:
            yield from done()

    sent = docs.select(text).mapInArrow(send, "section int, salt int, windows binary, times binary")
    return sent.repartition("section", "salt").sortWithinPartitions("section", "salt").mapInArrow(count, "block int, kind int, counts binary")


def count_slots(docs: DataFrame, text: str, kind: int, bits: tuple[int, ...]) -> DataFrame:
    """(block, kind, zeros and ones of the block's slots, compressed) from all whole texts; a row for a block and a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(Slots(bits))

        def done() -> pa.RecordBatch:
            found = counts.blocks()
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int32()), pa.array([kind] * len(found), pa.int32()), pa.array([x for _, x in found], pa.binary())], ["block", "kind", "counts"])

        for whole in batches:
            for b in slices(whole, text, CHUNK_BYTES):
                counts.add(packed([(t or "").encode() for t in b.column(text).to_pylist()]))
                if counts.seen >> 30:  # far below what a cell can hold
                    yield done()
        if counts.seen:
            yield done()

    return docs.select(text).mapInArrow(run, "block int, kind int, counts binary")


def _unpacked(raw: bytes) -> np.ndarray:
    """Counts of a block: 32 bits each from a task, 64 bits each once summed."""
    plain = zstandard.ZstdDecompressor().decompress(raw)
    return np.frombuffer(plain, np.uint32 if len(plain) == 8 << BLOCK_BITS else np.uint64).astype(np.uint64)


def sum_blocks(parts: DataFrame, tasks: int) -> DataFrame:
    """Sums of the parts' counts by block and kind. Parts of very many tasks are first summed in groups of about TASKS_A_SUM."""
    if tasks > 2 * TASKS_A_SUM:
        salt = F.pmod(F.xxhash64("counts"), F.lit(-(-tasks // TASKS_A_SUM)))
        parts = _summed(parts.repartition("block", salt))
    return _summed(parts.repartition("block"))


def _summed(dealt: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, last, held = zstandard.ZstdCompressor(level=1), None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int32()), pa.array([last[1]], pa.int32()), pa.array([pack.compress(held.tobytes())], pa.binary())], ["block", "kind", "counts"])
        for b in batches:
            for block, kind, raw in zip(b.column("block").to_pylist(), b.column("kind").to_pylist(), b.column("counts"), strict=True):
                if (block, kind) != last:
                    if last is not None:
                        yield done()
                    last, held = (block, kind), np.zeros(2 << BLOCK_BITS, np.uint64)
                held = held + _unpacked(raw.as_py())
        if last is not None:
            yield done()

    return dealt.sortWithinPartitions("block", "kind").mapInArrow(run, "block int, kind int, counts binary")


def odds(counts: np.ndarray) -> np.ndarray:
    """Log odds of a one in LEVELS-ths, from pairs of counts; 0 where nothing was seen."""
    n = counts.reshape(-1, 2).astype(np.float64) + COUNT_PRIOR
    return np.rint(np.log(n[:, 1] / n[:, 0]) * LEVELS).clip(-127, 127).astype(np.int8)


def odds_blocks(summed: DataFrame) -> DataFrame:
    """By block, the odds from kind 0 and from both kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}
        empty = np.zeros(2 << BLOCK_BITS, np.uint64)

        def done() -> pa.RecordBatch:
            a, b = held.get(0, empty), held.get(1, empty)
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([odds(a).tobytes()], pa.binary()), pa.array([odds(a + b).tobytes()], pa.binary())], ["block", "part", "whole"])

        for b in batches:
            for block, kind, raw in zip(b.column("block").to_pylist(), b.column("kind").to_pylist(), b.column("counts"), strict=True):
                if block != last:
                    if last is not None:
                        yield done()
                    last, held = block, {}
                held[kind] = _unpacked(raw.as_py())
        if last is not None:
            yield done()

    return summed.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, "block int, part binary, whole binary")


GATES = 8 * 4 * 4
WIDTH = len(ORDERS) + 1


def _start_weights() -> np.ndarray:
    w = np.full((WIDTH, GATES), 0.4, np.float32)
    w[-1] = 0
    return w


@dataclass
class Mixer:
    """The odds of a section's slots (None: they are given as inputs), the gated weights, and the refinement's log odds by last byte and bucket (None: not learned)."""

    bits: tuple[int, ...]
    odds: np.ndarray | None
    weights: np.ndarray
    refined: np.ndarray | None = None
    sections: int = 1

    def __post_init__(self):
        self.token = uuid.uuid4().hex
        self.slots = Slots(self.bits)
        self.squares = np.zeros(self.weights.shape)  # of all steps so far: each weight's steps shrink as it settles

    def inputs(self, rows: np.ndarray) -> np.ndarray:
        """The odds of each window's slots, by bit, then by context."""
        hashes = context_hashes(rows)
        return np.stack([self.odds[self.slots.at(h, node, i)] for _, node, _ in bits_of(rows) for i, h in enumerate(hashes)], axis=1)

    def predict(self, rows: np.ndarray, inputs: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each bit of each window's byte: inputs (with a 1 for the bias), gate, the bit, mixed log odds. The odds of the
        slots may be given as inputs() returns them."""
        hashes = context_hashes(rows) if inputs is None else []
        for bit, node, side in bits_of(rows):
            x = np.ones((WIDTH, len(rows)), np.float32)
            for i, h in enumerate(hashes):
                x[i] = self.odds[self.slots.at(h, node, i)]
            if inputs is not None:
                x[:-1] = inputs[:, bit * len(ORDERS) : (bit + 1) * len(ORDERS)].T
            x[:-1] *= np.float32(1 / LEVELS)
            gate = np.full(len(rows), bit, np.int64)
            for long in (x[-2], x[-3]):
                size = np.abs(long)
                gate *= 4
                for least in SURER:
                    gate += size > np.float32(least)
            mixed = self.weights[-1][gate]
            for k in range(WIDTH - 1):
                mixed += self.weights[k][gate] * x[k]
            yield x, gate, side.astype(np.float32), mixed

    @staticmethod
    def place(rows: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lower bucket of the refinement and the share of the upper one."""
        at = (np.clip(mixed, -7.99, 7.99) + 8) * ((BUCKETS - 1) / 16)
        low = at.astype(np.int64)
        return rows[:, 1].astype(np.int64) * BUCKETS + low, (at - low).astype(np.float32)

    def cost(self, windows: np.ndarray) -> np.ndarray:
        """log10 probability of each window's byte."""
        out = np.zeros(len(windows), np.float32)
        most = np.float32(MOST_ODDS)
        for start in range(0, len(windows), 1 << 14):  # so that arrays stay in the processor's cache
            rows = rows_of(windows[start : start + (1 << 14)])
            total = np.zeros(len(rows), np.float32)
            for _, _, bit, mixed in self.predict(rows):
                sign = 1 - 2 * bit
                p = 1 / (1 + np.exp(sign * np.clip(mixed, -most, most)))  # of the bit that came
                if self.refined is not None:
                    low, share = self.place(rows, mixed)
                    r = (1 - share) * self.refined[low] + share * self.refined[low + 1]
                    p = (p + 1 / (1 + np.exp(sign * r))) / 2
                total += np.log(p)
            out[start : start + len(total)] = total
        return out * np.float32(1 / np.log(10))

    def scores(self, texts: list[bytes], memory: Memory | None = None) -> np.ndarray:
        """log10 probability of each whole text and its end. What a memory holds is the same cost that would be computed."""
        if not texts:
            return np.zeros(0)
        return text_sums(self.costs(packed(texts), memory or Memory(np.float32)), texts)

    def costs(self, windows: np.ndarray, memory: Memory) -> np.ndarray:
        """What cost() gives for each window, by a memory."""
        at = memory.places(windows)
        hit = memory.keys[at] == windows
        out = memory.values[at].astype(np.float64)
        miss = np.flatnonzero(~hit)
        new, back = np.unique(windows[miss], return_inverse=True)
        cost = self.cost(new)
        out[miss] = cost[back]
        met = np.zeros(len(memory.keys), bool)
        met[at[hit]] = True
        memory.replace(new, cost, met)
        return out

    def learn(self, rows: np.ndarray, times: np.ndarray, inputs: np.ndarray | None = None) -> None:
        """Online steps: after each batch of windows, the weights of its gates move against the gradient of its code length.
        A step is at most RATE, however often a window occurs."""
        order = np.random.default_rng(len(times)).permutation(len(times))
        for start in range(0, len(times), BATCH):
            own = order[start : start + BATCH]
            part, n = rows[own], times[own].astype(np.float32)
            for x, gate, bit, mixed in self.predict(part, None if inputs is None else inputs[own]):
                error = (bit - 1 / (1 + np.exp(-np.clip(mixed, -MOST_ODDS, MOST_ODDS)))) * n
                for k in range(WIDTH):
                    step = np.bincount(gate, weights=error * x[k], minlength=GATES)
                    self.squares[k] += step**2
                    self.weights[k] += (RATE * step / np.sqrt(np.maximum(self.squares[k], 1))).astype(np.float32)

    def refine(self, rows: np.ndarray, times: np.ndarray, seen: np.ndarray, inputs: np.ndarray | None = None) -> None:
        """Adds to `seen` (zeros and ones by last byte and bucket) what came where."""
        for start in range(0, len(rows), 1 << 15):
            part, n = rows[start : start + (1 << 15)], times[start : start + (1 << 15)]
            for _, _, bit, mixed in self.predict(part, None if inputs is None else inputs[start : start + (1 << 15)]):
                low, share = self.place(part, mixed)
                for side, weight in ((low, n * (1 - share)), (low + 1, n * share)):
                    seen[0] += np.bincount(side, weights=weight * (1 - bit), minlength=seen.shape[1])
                    seen[1] += np.bincount(side, weights=weight * bit, minlength=seen.shape[1])


def text_sums(costs: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Sums of the windows' costs by text."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return np.add.reduceat(costs, np.concatenate([[0], ends[:-1]]))


_WARM: list = [None, None]


def warm(mixer: Mixer) -> Memory:
    """The memory of a model's costs, which the tasks of a worker hand on to each other."""
    if _WARM[0] != mixer.token:
        _WARM[:] = [mixer.token, Memory(np.float32)]
    return _WARM[1]


def distinct(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of the texts, as rows, and their counts."""
    windows, times = np.unique(packed(texts), return_counts=True)
    return rows_of(windows), times


def lanes(dev: DataFrame, text: str, key: Column, n: int) -> DataFrame:
    """The rows dealt into n lanes by their keys, each lane in order: what a lane learns doesn't depend on how files are cut."""
    dealt = dev.select((F.pmod(key, F.lit(n))).cast("int").alias("lane"), key.alias("at"), F.col(text).alias("text"))
    return dealt.repartition(n, "lane").sortWithinPartitions("lane", "at")


def _lane_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(lane, texts of about CHUNK_BYTES) in order; a chunk is never of two lanes."""
    last, held, size = None, [], 0
    for b in batches:
        for lane, t in zip(b.column("lane").to_pylist(), b.column("text"), strict=True):
            raw = (t.as_py() or "").encode()
            if held and (lane != last or size + len(raw) > CHUNK_BYTES):
                yield last, held
                held, size = [], 0
            last, size = lane, size + len(raw)
            held.append(raw)
    if held:
        yield last, held


Chunks = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, None]]:
    """Of each chunk in order: lane, distinct windows as rows, their counts; the odds are looked up in the tables."""
    for lane, texts in _lane_chunks(batches):
        yield lane, *distinct(texts), None


def _met_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """As _chunks, with the odds, from rows of looked_up sorted by place."""
    width = 8 * len(ORDERS)

    def whole() -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        windows, times, inputs = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(windows)
        return last >> 32, rows_of(windows[order]), times[order], inputs[order]

    held, last = [], None
    for b in batches:
        for place, windows, times, inputs in zip(*(b.column(c).to_pylist() for c in ("place", "windows", "own", "answers")), strict=True):
            if held and place != last:
                yield whole()
                held = []
            last = place
            held.append((_windows(windows), _plain(times, np.int64), _plain(inputs, np.int8).reshape(-1, width)))
    if held:
        yield whole()


def _ask_chunks(dealt: DataFrame, sections: int) -> DataFrame:
    """place (lane and number of the chunk), section, windows and own (their counts) of the lanes' chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Counter()
        for lane, texts in _lane_chunks(batches):
            windows, times = np.unique(packed(texts), return_counts=True)
            yield from _asked(lane << 32 | numbers[lane], windows, sections, times.astype(np.int64))
            numbers[lane] += 1

    return dealt.mapInArrow(run, ASKED)


ASKED = "place long, section int, windows binary, own binary"


def _asked(place: int, windows: np.ndarray, sections: int, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    for section, found, own in pieces(windows, sections, values):
        yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([section], pa.int32()), pa.array([found], pa.binary()), pa.array([own], pa.binary())], ["place", "section", "windows", "own"])


def looked_up(asked: DataFrame, tables: DataFrame, column: str, bits: tuple[int, ...], start: Callable[[np.ndarray], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """asked (see ASKED) with `answers`, an array of values for its windows, compressed. start() gets a section's odds, which are
    in that column of tables (block, part, whole), and gives what answers. A section's windows are dealt over DEALT tasks."""
    blocks = Slots(bits).total >> BLOCK_BITS
    salts = F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("salt")
    held = tables.select((F.col("block") / blocks).cast("int").alias("section"), salts, F.lit(-1).cast("long").alias("place"), (F.col("block") % blocks).alias("block"), F.col(column).alias("windows"), F.lit(None).cast("binary").alias("own"))
    rows = asked.select("section", F.pmod(F.xxhash64("place"), F.lit(DEALT)).cast("int").alias("salt"), "place", F.lit(-1).alias("block"), "windows", "own")
    order = ["section", "salt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, last, odds, answer = zstandard.ZstdCompressor(level=1), None, None, None
        for b in batches:
            for *key, place, block, raw, own in zip(*(b.column(c).to_pylist() for c in (*order, "place", "block", "windows", "own")), strict=True):
                if key != last:
                    last, odds, answer = key, np.zeros(blocks << BLOCK_BITS, np.int8), None
                if block >= 0:  # these come first
                    odds[block << BLOCK_BITS : (block + 1) << BLOCK_BITS] = np.frombuffer(raw, np.int8)
                    continue
                answer = answer or start(odds)
                found = pack.compress(np.ascontiguousarray(answer(_windows(raw))).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([key[0]], pa.int32()), pa.array([raw], pa.binary()), pa.array([own], pa.binary()), pa.array([found], pa.binary())], ["place", "section", "windows", "own", "answers"])

    dealt = held.unionByName(rows).repartition(*order).sortWithinPartitions(*order, "place")
    return dealt.mapInArrow(run, ASKED + ", answers binary")


def _learn_weights(dealt: DataFrame, bits: tuple[int, ...], part: Broadcast | None, chunks: Chunks) -> np.ndarray:
    """Weights learned online in each lane, averaged by the predictions made with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            flat = mixer.weights.ravel().astype(float)
            return pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat * seen), pa.array([float(seen)] * len(flat))], ["i", "w", "n"])

        mixer, last, seen = None, None, 0
        for lane, rows, times, inputs in chunks(batches):
            if lane != last:
                if mixer is not None:
                    yield done()
                mixer, last, seen = Mixer(bits, part and part.value, _start_weights()), lane, 0
            mixer.learn(rows, times, inputs)
            seen += int(times.sum())
        if mixer is not None:
            yield done()

    got = dealt.mapInArrow(run, "i int, w double, n double").groupBy("i").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect()
    out = _start_weights().ravel()
    for r in got:
        if r["n"]:
            out[r["i"]] = r["w"] / r["n"]
    return out.reshape(WIDTH, GATES)


def _learn_refinement(dealt: DataFrame, bits: tuple[int, ...], part: Broadcast | None, weights: np.ndarray, chunks: Chunks) -> np.ndarray:
    """Log odds of what was seen at each last byte and bucket, which start from the bucket's own odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, seen = Mixer(bits, part and part.value, weights), np.zeros((2, 256 * BUCKETS))
        for _, rows, times, inputs in chunks(batches):
            mixer.refine(rows, times, seen, inputs)
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[0, at]), pa.array(seen[1, at])], ["i", "zeros", "ones"])

    got = dealt.mapInArrow(run, "i int, zeros double, ones double").groupBy("i").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).collect()
    centre = np.tile(np.linspace(-8, 8, BUCKETS), 256)
    p = 1 / (1 + np.exp(-centre))
    zeros, ones = 20 * (1 - p), 20 * p
    for r in got:
        zeros[r["i"]] += r["zeros"]
        ones[r["i"]] += r["ones"]
    return np.log(ones / zeros).astype(np.float32)


#: Rows that a task holds at once on either side of the Arrow channel.
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Arrow batches of at most so many rows for the jobs inside: tasks here hold tables, so less room is left for texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), rows) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def train(docs: DataFrame, text: str, dev: Column, key: Column) -> tuple[Mixer, DataFrame | None]:
    """The model from all rows of docs; `dev` marks the tenth on which mixing and refinement are learned, `key` (long, not
    null) tells rows apart. Without rows, or without text, nothing was seen anywhere and each bit has even odds. Where there are
    several sections, the model has no odds, and they are returned beside it (block, part, whole), staged.

    The driver holds a section's odds at most: two bytes for each slot, at most the sum of 2**MOST_BITS of them, whatever the corpus.
    """
    size = F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 1)
    sums = docs.agg(size.alias("n"), F.sum(F.when(dev, F.coalesce(F.octet_length(text), F.lit(0)) + 1)).alias("dev")).collect()[0]
    bits, sections = table_bits(sums["n"] or 0), sections_for(sums["n"] or 0)
    main, held = docs.where(~dev), docs.where(dev)
    n_lanes = max(1, -(-(sums["dev"] or 0) // LANE_BYTES))
    dealt = lanes(held, text, key, n_lanes)
    if sections > WHOLE:
        with small_batches(docs.sparkSession, PIECE_ROWS):
            counted = count_sections(main, text, 0, bits, sections).unionByName(count_sections(held, text, 1, bits, sections))
            summed = staged(sum_blocks(counted, DEALT), "lm-counts")
            tables = staged(odds_blocks(summed), "lm-odds")
            unstage(summed)
            look = lambda odds: lambda windows, model=Mixer(bits, odds, _start_weights()): model.inputs(rows_of(windows))
            met = staged(looked_up(_ask_chunks(dealt, sections), tables, "part", bits, look), "lm-inputs")
            ordered = met.withColumn("lane", F.shiftright("place", 32)).repartition(n_lanes, "lane").sortWithinPartitions("place")
            weights = _learn_weights(ordered, bits, None, _met_chunks)
            refined = _learn_refinement(ordered, bits, None, weights, _met_chunks)
            unstage(met)
        return Mixer(bits, None, weights, refined, sections), tables
    slots, tasks = Slots(bits).total, docs.rdd.getNumPartitions()
    summed = staged(sum_blocks(count_slots(main, text, 0, bits), tasks).unionByName(sum_blocks(count_slots(held, text, 1, bits), tasks)), "lm-counts")
    part, whole = np.zeros(slots, np.int8), np.zeros(slots, np.int8)
    for r in odds_blocks(summed).toLocalIterator():
        span = slice(r["block"] << BLOCK_BITS, (r["block"] + 1) << BLOCK_BITS)
        part[span], whole[span] = np.frombuffer(r["part"], np.int8), np.frombuffer(r["whole"], np.int8)
    unstage(summed)
    known = docs.sparkSession.sparkContext.broadcast(part)
    weights = _learn_weights(dealt, bits, known, _chunks)
    refined = _learn_refinement(dealt, bits, known, weights, _chunks)
    known.unpersist()
    return Mixer(bits, whole, weights, refined), None


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """word (binary) and n, its occurrences in all whole texts. Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. A task sums
    up to REMEMBERED words before it passes them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            words = list(counts)
            for i in range(0, len(words), 20_000):
                some = words[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([counts[w] for w in some], pa.int64())], ["word", "n"])
            counts.clear()

        for b in batches:
            for t in b.column(0):
                counts.update((t.as_py() or "").encode().lower().split())
                if len(counts) > REMEMBERED:
                    yield from rows()
        yield from rows()

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Words:
    """Counts of frequent words: a dictionary of log10(n + 0.1) for the most frequent, and the others by 128-bit hashes."""

    def __init__(self, rows: Iterator, least: int):
        self.top: dict[bytes, float] = {}
        keys, values = [], []
        for word, n in rows:
            if n >= least:
                self.top[bytes(word)] = float(np.log10(n + 0.1))
            else:
                keys.append(xxhash.xxh3_128_digest(word)), values.append(n)
        found = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
        order = np.argsort(found[:, 0], kind="stable")
        self.keys, self.logs = found[order], np.log10(np.array(values, np.float64)[order] + 0.1)

    def find(self, words: list[bytes]) -> np.ndarray:
        """log10(n + 0.1) of words that aren't in the dictionary; nan for unknown ones."""
        out = np.full(len(words), np.nan)
        if len(words) and len(self.keys):
            asked = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
            at, todo = np.searchsorted(self.keys[:, 0], asked[:, 0]), np.arange(len(words))
            while len(todo := todo[at[todo] < len(self.keys)]) and len(todo := todo[self.keys[at[todo], 0] == asked[todo, 0]]):
                same = self.keys[at[todo], 1] == asked[todo, 1]
                out[todo[same]] = self.logs[at[todo[same]]]
                todo = todo[~same]
                at[todo] += 1
        return out

    def sums(self, texts: list[bytes]) -> tuple[list[int], list[int], list[float], list[list[dict]]]:
        """Of each text: words, known words, the sum of their logarithms, and words to be looked up elsewhere with counts."""
        get, split, unknown, n_words, n_known, sums = self.top.get, [], set(), [], [], []
        for t in texts:
            words = t.lower().split()
            logs = np.fromiter(map(get, words, repeat(np.nan)), np.float64, len(words))
            missing = np.isnan(logs)
            rest = [words[i] for i in np.flatnonzero(missing)]
            unknown.update(rest)
            split.append(rest), n_words.append(len(words)), n_known.append(len(words) - len(rest)), sums.append(float(logs[~missing].sum()))
        asked = list(unknown)
        known = {w: x for w, x in zip(asked, self.find(asked).tolist(), strict=True) if x == x}
        rare = []
        for i, rest in enumerate(split):
            left = []
            for w in rest:
                if (x := known.get(w)) is None:
                    left.append(w)
                else:
                    sums[i] += x
            n_known[i] += len(rest) - len(left)
            rare.append([{"w": w, "n": k} for w, k in Counter(left).items()])
        return n_words, n_known, sums, rare


def score(docs: DataFrame, keep: list[Column], text: str, train_rows: Column, dev: Column, key: Column) -> DataFrame:
    """`keep` columns and, for every row's whole text (null: empty): n_tokens, n_known, train_tokens, base_score, score
    (log10 probability of the text and its end by the mixed model) and bits_per_byte (bits over the text's bytes, end included).
    A kept column with one of these names is left out.

    train_rows marks the rows that are learned from, dev the tenth of them that mixing is learned on; a null mark counts as
    false. key: any column, by which rows are told apart. base_score is the unigram model's: the sum over words and one end
    of log10((c + 0.1) / (N + 0.1 * (V + 1))), c counted in training rows. Frequent words (at most 2**HEAD_BITS, see there) are
    looked up in a broadcast; the others, each of which has a small share of all tokens, meet their counts in a join. Without
    training rows, counts are 0 and the mixed model gives each byte 2**-8. Equal texts have equal scores.
    """
    with small_batches(docs.sparkSession):
        return _score(docs, keep, text, train_rows, dev, key)


def _score(docs: DataFrame, keep: list[Column], text: str, train_rows: Column, dev: Column, key: Column) -> DataFrame:
    spark = docs.sparkSession
    mark = lambda c: F.coalesce(c, F.lit(False))
    source = docs.select(nested(keep), F.col(text).alias("_text"), mark(train_rows).alias("_train"), mark(dev).alias("_dev"), F.xxhash64(key, F.col(text)).alias("_key"))
    learned = source.where("_train")
    counts = staged(word_counts(learned, "_text"), "words")
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()[0]
    ends = learned.count()
    n, v = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    least, frequent = (max(1, -(-(sums["n"] or 0) // (1 << b))) for b in (HEAD_BITS, DICT_BITS))
    head = spark.sparkContext.broadcast(Words(((r["word"], r["n"]) for r in counts.where(F.col("n") >= least).toLocalIterator()), frequent))

    rows = _scored(source, head)
    rare = rows.select("_row", F.explode("_rare").alias("r")).select("_row", F.col("r.w").alias("word"), F.col("r.n").alias("k"))
    met = rare.join(counts.where(F.col("n") < least), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    summed = met.groupBy("_row").agg(F.sum(F.col("k") * F.log10(F.col("n") + 0.1)).alias("_s"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("_k"))
    norm = float(np.log10(n + 0.1 * (v + 1)))
    base = F.col("_sum") + F.coalesce("_s", F.lit(0.0)) + float(np.log10(ends + 0.1)) - F.col("_words") * F.lit(norm)
    joined = rows.drop("_rare").join(summed, "_row", "left")
    n_known = F.col("_known") + F.coalesce("_k", F.lit(0)) + F.lit(int(ends > 0))
    out = joined.select("_kept", F.col("_words").alias("n_tokens"), n_known.cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), F.col("_score").alias("score"), F.col("_bits").alias("bits_per_byte"))
    return unnested(out, out.columns[1:])


SCORED = ["_words", "_known", "_sum", "_rare", "_score", "_bits"]


def _row_parts(kept: pa.Array, raw: list[bytes], scores: np.ndarray, words: Words) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.struct([("w", pa.binary()), ("n", pa.int64())])), pa.float64(), pa.float64())
    n_words, n_known, sums, rare = words.sums(raw)
    found = ([x + 1 for x in n_words], n_known, sums, rare, scores.tolist(), [-s / np.log10(2) / (len(t) + 1) for s, t in zip(scores.tolist(), raw, strict=True)])
    return pa.RecordBatch.from_arrays([kept, *(pa.array(x, t) for x, t in zip(found, types, strict=True))], ["_kept", *SCORED])


def _scored(source: DataFrame, head: Broadcast) -> DataFrame:
    """source with the model's score and the base's parts, staged; the model is learned from its training rows."""
    model, tables = train(source.where("_train"), "_text", F.col("_dev"), F.col("_key"))
    schema = StructType([source.schema["_kept"], *StructType.fromDDL("_words long, _known long, _sum double, _rare array<struct<w:binary,n:bigint>>, _score double, _bits double")])
    if tables is not None:
        return _scored_by_sections(source, head, model, tables, schema)
    known = source.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, mixer = head.value, known.value
        memory = warm(mixer)
        for whole in batches:
            for b in slices(whole, "_text", CHUNK_BYTES):
                raw = [(t or "").encode() for t in b.column("_text").to_pylist()]
                yield _row_parts(b.column("_kept"), raw, mixer.scores(raw, memory), words)

    rows = source.select("_kept", "_text").mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id())
    out = staged(rows, "lm-rows")
    known.destroy()
    return out


def _scored_by_sections(source: DataFrame, head: Broadcast, model: Mixer, tables: DataFrame, schema: StructType) -> DataFrame:
    """As _scored: texts are dealt into places of about LOOK_BYTES; the costs of a place's distinct windows come from the sections' tasks."""
    sections = model.sections

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, size = TaskContext.get().partitionId() << 32, 0
        for whole in batches:
            for b in slices(whole, "_text", CHUNK_BYTES):
                n = (pc.sum(pc.binary_length(b.column("_text"))).as_py() or 0) + b.num_rows
                if size and size + n > LOOK_BYTES:
                    place, size = place + 1, 0
                size += n
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([place] * b.num_rows, pa.int64())], ["_kept", "_text", "_place"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:
            for place, t in zip(b.column("_place").to_pylist(), b.column("_text").to_pylist(), strict=True):
                if held and place != last:
                    windows = np.unique(packed(held))
                    yield from _asked(last, windows, sections, np.zeros(len(windows), np.int8))
                    held = []
                last = place
                held.append((t or "").encode())
        if held:
            windows = np.unique(packed(held))
            yield from _asked(last, windows, sections, np.zeros(len(windows), np.int8))

    def start(odds: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        mixer, memory = Mixer(model.bits, odds, model.weights, model.refined), Memory(np.float32)
        return lambda windows: mixer.costs(windows, memory).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, held, known = head.value, None, [], None
        for whole in batches:
            at = whole.column("_place").to_numpy()
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                rows = whole.slice(lo, hi - lo)
                if at[lo] != last:
                    last, held, known = at[lo], [], None
                costs = pc.is_valid(rows.column("answers"))
                for windows, found in zip(*(rows.filter(costs).column(c).to_pylist() for c in ("windows", "answers")), strict=True):  # these come first
                    held.append((_windows(windows), _plain(found, np.float32)))
                texts = rows.filter(pc.invert(costs))
                for b in slices(texts, "_text", CHUNK_BYTES):
                    if known is None:
                        windows, found = (np.concatenate(x) for x in zip(*held, strict=True))
                        order = np.argsort(windows, kind="stable")
                        known, held = (windows[order], found[order]), []
                    raw = [(t or "").encode() for t in b.column("_text").to_pylist()]
                    cost = known[1][np.searchsorted(known[0], packed(raw))].astype(np.float64)
                    yield _row_parts(b.column("_kept"), raw, text_sums(cost, raw), words)

    spark = source.sparkSession
    with small_batches(spark, PIECE_ROWS):
        placed = StructType([*source.select("_kept", "_text").schema, *StructType.fromDDL("_place long")])
        texts = staged(source.select("_kept", "_text").mapInArrow(deal, placed), "lm-texts")
        answers = looked_up(texts.select("_text", "_place").mapInArrow(ask, ASKED), tables, "whole", model.bits, start)
        none = F.lit(None).cast("binary")
        both = texts.select("_place", "_kept", "_text", none.alias("windows"), none.alias("answers")).unionByName(
            answers.select(F.col("place").alias("_place"), F.lit(None).cast(source.schema["_kept"].dataType).alias("_kept"), F.lit(None).cast("string").alias("_text"), "windows", "answers")
        )
        dealt = both.repartition("_place").sortWithinPartitions("_place", F.col("answers").isNull())
        out = staged(dealt.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()), "lm-rows")
    unstage(texts)
    unstage(tables)
    return out
