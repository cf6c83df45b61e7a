"""SimHash near-duplicates with vantage-point trees.

A fingerprint is the bitwise majority of its text's shingle hashes. Fingerprints are first dealt into shards by projected
Hamming distance: of `radius` + s disjoint runs of bits, s at least agree wholly in any two fingerprints within the radius,
so a pair within it meets in at least one shard of each choice of s runs. In a shard a vantage-point tree splits the members by their
distance to a vantage point; a query enters each branch whose region its ball overlaps, by the triangle inequality, so queries
near a boundary go to both sides, and no pair within the radius is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import attached, nested, scanned, staged, unnested
from strataq.llm.components import roots

SEED, SHINGLE, RADIUS = 42, 4, 4
#: Members of a shard that one task takes as queries. A larger shard is split by further runs of bits, LEVELS times at most;
#: what is larger still is dealt over several tasks, each with a slice of the queries against all members. Pairs that a leaf
#: of a tree compares at once.
SLICE, LEVELS, LEAF = 8192, 3, 1 << 14


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint: words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, shingles joined by a space, repeats
    included; fewer words than a shingle has are one shingle, no word at all (or null) gives 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words))
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[Column], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """`keep` columns (but any called fp) and fp (long: the 64 bits as signed) for every row; one pass without a shuffle."""
    look = lambda texts: [pa.array(np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64))]
    return scanned(docs, keep, text, "fp long", lambda: look)


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n members' components under the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (jumped := label[label]).tobytes() != label.tobytes():
            label = jumped
        live = label[a] != label[b]
        a, b = a[live], b[live]
    return label


def tree_links(queries: np.ndarray, members: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (two arrays of fingerprints) that connect all queries and members within the radius as their pairs would.

    A vantage point splits the members at their median distance; queries go where |d(q, v) - d(x, v)| <= radius is possible.
    """
    todo = [(queries, members)]
    while todo:
        q, x = todo.pop()
        if not len(q) or not len(x):
            continue
        if len(q) * len(x) > LEAF:
            v = x[len(x) // 2]
            dx, dq = np.bitwise_count(x ^ v), np.bitwise_count(q ^ v)
            cut = int(np.median(dx))
            if (inner := dx <= cut).all():  # many members at one distance: split below it
                cut = int(dx.max()) - 1
                inner = dx <= cut
            near, far = q[dq <= cut + radius], q[dq.astype(np.int64) > cut - radius]
            if inner.any() and not inner.all() and (len(near) < len(q) or len(far) < len(q) or len(x) > 64):
                todo += [(near, x[inner]), (far, x[~inner])]
                continue
        step = max(1, LEAF // len(x))
        for i in range(0, len(q), step):
            a, b = np.nonzero(np.bitwise_count(q[i : i + step, None] ^ x[None, :]) <= radius)
            a, b = q[i : i + step][a], x[b]
            if (differ := a != b).any():
                nodes, ends = np.unique(np.concatenate([a[differ], b[differ]]), return_inverse=True)
                least = labels(len(nodes), ends[: differ.sum()], ends[differ.sum() :])
                own = np.flatnonzero(least != np.arange(len(nodes)))
                yield nodes[own], nodes[least[own]]


def _run(bits: list[int]) -> int:
    """The mask of some bits, as a signed 64-bit number."""
    mask = sum(1 << b for b in bits)
    return mask - 2**64 if mask >= 2**63 else mask


def _split(bits: list[int], runs: int) -> list[list[int]]:
    return [bits[round(i * len(bits) / runs) : round((i + 1) * len(bits) / runs)] for i in range(runs)]


def _choices(radius: int, n: int) -> list[list[int]]:
    """Choices of bits: the fewest that leave some hundred fingerprints of n to a shard. Two fingerprints within the radius agree
    on all bits of one of them at least."""
    for agree in range(1, 9):
        runs = _split(list(range(64)), radius + agree)
        if n <= 2 ** (64 * agree // len(runs)) * 256 or agree == 8 or math.comb(radius + agree + 1, agree + 1) > 500:
            return [sum(c, []) for c in combinations(runs, agree)]
    raise AssertionError


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints: distinct fp (long). Links u, v (long) whose components are those of all pairs within the radius; each shard
    gives a spanning star instead of all pairs, so a large group of near copies gives no square of links.

    A shard of over SLICE members is split again: of radius + 1 runs of the bits that it wasn't chosen by, two members within
    the radius agree on one at least, so they meet in one of its parts.
    """
    n = prints.count()
    choices = dict(enumerate(_choices(radius, n)))
    shards = prints.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(_run(c)) for c in choices.values()))).alias("choice", "bits"))
    total, dealt = n * len(choices), []
    order = ["choice", "bits", "task"]
    for level in range(LEVELS + 1):
        sizes = staged(shards.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1"), "shards")
        met = attached(shards, sizes, ["choice", "bits"], "n", total)
        many = sizes.where(F.col("n") > SLICE).agg(F.sum("n").alias("n")).collect()[0]["n"] or 0
        dealt.append(met.where(F.col("n") <= SLICE).select("choice", "bits", F.lit(0).alias("task"), F.lit(True).alias("asks"), "fp"))
        if not many:
            break
        large = met.where(F.col("n") > SLICE)
        if level == LEVELS:
            tasks = F.ceil(F.col("n") / SLICE).cast("int")
            own = F.pmod(F.xxhash64("fp"), tasks).cast("int")
            copies = large.select("choice", "bits", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("task"), own.alias("own"), "fp")
            dealt.append(copies.select("choice", "bits", "task", (F.col("own") == F.col("task")).alias("asks"), "fp"))
            break
        finer, parts = {}, []
        for c in [r["choice"] for r in sizes.where(F.col("n") > SLICE).select("choice").distinct().collect()]:
            rest = [b for b in range(64) if b not in choices[c]]
            for run in _split(rest, radius + 1):
                at = max(choices) + 1 + len(finer)
                finer[at] = choices[c] + run
                parts.append((c, at, _run(finer[at])))
        choices = finer
        by_choice = F.broadcast(prints.sparkSession.createDataFrame(parts, "choice int, finer int, mask long"))
        shards = staged(large.join(by_choice, "choice").select("fp", F.col("finer").alias("choice"), F.col("fp").bitwiseAND(F.col("mask")).alias("bits")), "shards")
        total = many * (radius + 1)
    dealt = reduce(DataFrame.unionByName, dealt).repartition(*order).sortWithinPartitions(*order)

    def links(own: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        members = np.concatenate([x for _, x in own]).view(np.uint64)
        asks = np.concatenate([x for x, _ in own])
        for a, b in tree_links(members[asks], members, radius):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:
            shard = list(zip(*(b.column(c).to_pylist() for c in order), strict=True))
            cuts = [0, *(i for i in range(1, len(shard)) if shard[i] != shard[i - 1]), len(shard)]
            asks, fps = b.column("asks").to_numpy(zero_copy_only=False), b.column("fp").to_numpy()
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if held and shard[s] != last:
                    yield from links(held)
                    held = []
                held.append((asks[s:e], fps[s:e]))
                last = shard[s]
        if held:
            yield from links(held)

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, keep: list[Column], doc_id: Column, text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """`keep` columns (but any called fp or component_id), fp (long) and component_id for every row: the least doc_id of the rows
    reachable over links between fingerprints within the radius, itself included. Rows with equal fingerprints are linked;
    null texts have fingerprint 0. component_id is null only where all doc_ids of a component are null. Only fingerprints,
    never texts, are shuffled."""
    rows = staged(fingerprints(docs, [nested(keep), doc_id.alias("_doc")], text, shingle), "fingerprints")
    prints = staged(rows.groupBy("fp").agg(F.min("_doc").alias("least"), F.count("*").alias("n")), "prints")
    found = roots(near_links(prints.select("fp"), radius))
    rooted = prints.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    components = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_of"))
    by_print = attached(rooted, components, ["root"], "_of", prints.count()).select("fp", "n", "component_id")
    return unnested(attached(rows, by_print, ["fp"], "n", rows.count()), ["fp", "component_id"])
