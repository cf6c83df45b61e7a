"""Near-duplicates at an exact Jaccard similarity of shingle sets: wide SimHash fingerprints first, then what they miss.

At a similarity of 0.8 the 64 bits of simhash.py differ in ten places or so, as many as no tree over 64 bits can prune, so
fingerprints have 512 bits. Shards are projections onto few bits, CHOICES of them; vantage-point trees in them gather
fingerprints within the expected number of bits plus a standard deviation. In a large group the member nearest to the majority
of its fingerprints is the pivot, else the least one; a member stays only if its shingle set has the similarity to the pivot's.

Fingerprints miss pairs, of short texts above all. So a prefix filter finds every other pair: in one order of all shingles,
two sets of the similarity share one of the first n - ceil(similarity * n) + 1 shingles of each. Pairs that meet there, aren't
in one group yet and can still have the similarity by their sizes, places and sketches are compared by their whole sets. Where
many texts meet at a shingle, sketches are compared there, and only pairs that can be alike are passed on. The order has
shingles last that are common in a sample of texts; that only decides how many pairs meet, not which are found.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import attached, nested, slices, staged, unnested, unstage
from strataq.llm.components import roots
from strataq.llm.lm import small_batches
from strataq.llm.simhash import LEAF, SLICE, labels

SHINGLE, SIMILARITY, CHOICES = 5, 0.8, 16
WORDS = 8
BITS = 64 * WORDS
#: Fingerprints of a shard on average, at most; more of them make the projections wider. What a task of a larger shard compares
#: at once is SLICE of them, and with them the same PIVOTS, over which slices are linked.
SHARD, PIVOTS = 4096, 64
#: Groups of more members are measured for their pivot. Texts that meet at a shingle, and more than which compare sketches there.
LARGE_GROUP, FEW = 16, 16
#: One text of SAMPLED is counted for the order of shingles; at most 2**COMMON_BITS shingles count as common, whatever the corpus.
SAMPLED, COMMON_BITS = 8, 18
#: Bits of the filter by which texts to compare are read again; false hits cost time only.
FILTER_BITS = 26
#: Shingles of the prefix filter are dealt over so many passes, so that the disk holds the shuffled rows of one pass at a time.
PASSES = 4
#: Against rounding, far below the least step of a similarity.
TINY = 1e-9


def share(similarity: float) -> float:
    """The expected share of bits that differ at a Jaccard similarity of (equally large) shingle sets."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius(similarity: float) -> int:
    p = share(similarity)
    return round(BITS * p + math.sqrt(BITS * p * (1 - p)))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """128-bit hashes of the text's distinct shingles as rows of two words, sorted; words as in simhash.py. Fewer words than a
    shingle has are one shingle; a text without words has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros((0, 2), np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, k = ends - sizes, min(shingle, len(words))
    h = xxhash.xxh3_128_digest
    raw = b"".join(sorted({h(joined[a:b]) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)}))
    return np.frombuffer(raw, "<u8").reshape(-1, 2)


def node_of(pairs: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers of a shingle set: the first names it, the second tells sets of one name apart."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(pairs.tobytes()))


def fingerprint_of(pairs: np.ndarray) -> bytes:
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(pairs), 255):  # so that sums of a block fit a byte
        a, b = pairs[i : i + 255, :1], pairs[i : i + 255, 1:]
        x = a + b * np.arange(WORDS, dtype=np.uint64)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        counts += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(pairs), bitorder="little").tobytes()


def fingerprint(text: str | None, shingle: int = SHINGLE) -> bytes:
    """512 bits over the text's distinct shingles. A text without words has all bits 0."""
    return fingerprint_of(shingles(text, shingle))


def prefix(tokens: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first of the tokens in the order of all shingles, as many as a set of the similarity can't avoid altogether."""
    if not len(tokens):
        return tokens
    rank = np.zeros(len(tokens), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        rank = np.where(common[at] == tokens, counts[at], 0)
    return tokens[np.lexsort((tokens, rank))][: len(tokens) - math.ceil(similarity * len(tokens) - TINY) + 1]


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens' numbers by their low bits, at least two places a token. Two sets differ in no fewer tokens than
    their parities do, whatever the number of places, so what a comparison of sketches leaves out can't be alike."""
    places = max(64, 1 << (2 * len(tokens)).bit_length())
    return np.packbits((np.bincount((tokens & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Tokens that two sets differ in, at least; the longer sketch is folded to the places of the shorter one."""
    x, y = (np.frombuffer(v, np.uint8).reshape(-1, min(len(a), len(b))) for v in (a, b))
    return int(np.bitwise_count(np.bitwise_xor.reduce(x, axis=0) ^ np.bitwise_xor.reduce(y, axis=0)).sum(dtype=np.int64))


def least_common(sizes, similarity: float):
    """Tokens that two sets of the similarity have in common, at least, by the sum of their sizes."""
    return np.ceil(sizes * (similarity / (1 + similarity)) - TINY)


def meeting_pairs(token: np.ndarray, label: np.ndarray, node: np.ndarray, size: np.ndarray, at: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes with a token in common but not the label, which can have the similarity if the token is the first one
    that they share (a pair passes where it is, or nowhere). Rows are sorted by token, then label."""
    n = len(token)
    if not n:
        return
    new_token = token[1:] != token[:-1]
    token_ends = np.append(np.flatnonzero(new_token) + 1, n)
    group_ends = np.append(np.flatnonzero(new_token | (label[1:] != label[:-1])) + 1, n)
    end = np.repeat(token_ends, np.diff(token_ends, prepend=0))
    j = np.repeat(group_ends, np.diff(group_ends, prepend=0))
    i = np.flatnonzero(j < end)
    j = j[i]
    while len(i):
        need = least_common(size[i] + size[j], similarity)
        fits = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - TINY
        fits &= np.minimum(size[i] - at[i], size[j] - at[j]) >= need
        if fits.any():
            a, b = node[i[fits]], node[j[fits]]
            yield np.maximum(a, b), np.minimum(a, b)
        j = j + 1
        live = j < end[i]
        i, j = i[live], j[live]


def _choices(n: int) -> np.ndarray:
    """Bit numbers by choice, wide enough for SHARD fingerprints a shard."""
    width = max(12, math.ceil(math.log2(max(1, n) / SHARD)))
    rng = np.random.default_rng(17)
    return np.array([rng.choice(BITS, width, replace=False) for _ in range(CHOICES)])


def leaf_links(queries: np.ndarray, members: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (query, member) within the distance, block by block."""
    step = max(1, LEAF // max(1, len(members)))
    for i in range(0, len(queries), step):
        near = np.zeros((min(step, len(queries) - i), len(members)), np.uint16)
        for w in range(WORDS):
            near += np.bitwise_count(queries[i : i + step, w, None] ^ members[None, :, w])
        a, b = np.nonzero(near <= most)
        yield a + i, b


def tree_links(members: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (places of members) that connect the members as all pairs within the distance would. A vantage point splits
    members by distance; queries go where the triangle inequality lets them."""
    todo = [(np.arange(len(members)), np.arange(len(members)))]
    while todo:
        q, x = todo.pop()
        if not len(q) or not len(x):
            continue
        if len(q) * len(x) > LEAF and len(x) > 64:
            v = members[x[len(x) // 2]]
            distance = lambda rows: np.bitwise_count(members[rows] ^ v).sum(axis=1, dtype=np.int64)
            dx, dq = distance(x), distance(q)
            cut = int(np.median(dx))
            inner = dx <= cut
            if not inner.all():
                near, far = q[dq <= cut + most], q[dq > cut - most]
                todo += [(near, x[inner]), (far, x[~inner])]
                continue
        a_all, b_all = [], []
        for a, b in leaf_links(members[q], members[x], most):
            differ = q[a] != x[b]
            a_all.append(q[a][differ]), b_all.append(x[b][differ])
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        if len(a):
            nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
            least = labels(len(nodes), ends[: len(a)], ends[len(a) :])
            own = np.flatnonzero(least != np.arange(len(nodes)))
            yield nodes[own], nodes[least[own]]


def near_links(prints: DataFrame, similarity: float) -> DataFrame:
    """prints: distinct node (long) and fp (binary). Links u, v between nodes whose fingerprints are near, in spanning stars.

    A shard of very many members is dealt over tasks, and a task takes SLICE members at once; the shard's pivots are in each
    slice, so what is near a pivot is linked over all of them. Pairs that this leaves out are found by the prefix filter.
    """
    n = prints.count()
    choices, most = _choices(n), radius(similarity)

    def deal(narrow: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            powers = (1 << np.arange(choices.shape[1])).astype(np.int64)
            for whole in batches:
                for s in range(0, whole.num_rows, 1000):
                    b = whole.slice(s, 1000)
                    bits = np.unpackbits(np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(-1, 8 * WORDS), axis=1, bitorder="little")
                    for c, chosen in enumerate(choices):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, c, np.int32)), pa.array(bits[:, chosen] @ powers), *([] if narrow else b.columns)], ["choice", "bits", *([] if narrow else ["node", "fp"])])

        return prints.select("node", "fp").mapInArrow(run, "choice int, bits long" + ("" if narrow else ", node long, fp binary"))

    # at most 2**15 shards of all
    hot = deal(True).groupBy("choice", "bits").agg(F.count("*").alias("n")).where(F.col("n") > max(SLICE, n * CHOICES >> 15))
    hot = F.broadcast(hot.withColumns({"tasks": F.ceil(F.col("n") / SLICE).cast("int"), "every": F.ceil(F.col("n") / PIVOTS)}).drop("n"))
    dealt = deal(False).join(hot, ["choice", "bits"], "left")
    pivot = F.coalesce(F.pmod(F.xxhash64("node", F.lit(7)), F.col("every")) == 0, F.lit(False))
    tasks = F.when(pivot, F.sequence(F.lit(0), F.col("tasks") - 1)).otherwise(F.array(F.coalesce(F.pmod(F.xxhash64("node"), F.col("tasks")), F.lit(0)).cast("int")))
    order = ["choice", "bits", "task"]
    dealt = dealt.select("choice", "bits", F.explode(tasks).alias("task"), (~pivot).alias("plain"), "node", "fp")
    dealt = dealt.repartition(*order).sortWithinPartitions(*order, "plain").drop("plain")  # pivots first

    def links(held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            members, nodes = np.frombuffer(b"".join(fp for _, fp in held), "<u8").reshape(-1, WORDS), np.array([n for n, _ in held])
            for a, b in tree_links(members, most):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:
            for *shard, node, fp in zip(*(b.column(c).to_pylist() for c in (*order, "node", "fp")), strict=True):
                if shard != last:
                    yield from links(held)
                    held, last = [], shard
                elif len(held) >= SLICE + PIVOTS:
                    yield from links(held)
                    held = held[:PIVOTS]
                held.append((node, fp))
        yield from links(held)

    return dealt.mapInArrow(run, "u long, v long")


def pivots(grouped: DataFrame, prints: DataFrame) -> DataFrame:
    """grouped: node, root. Pairs u, v of each member and its group's pivot: the root, or in groups of over LARGE_GROUP members
    the one whose fingerprint is nearest to the bitwise majority of all. Majorities are sums over tasks."""
    total = grouped.count()
    sizes = staged(grouped.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > LARGE_GROUP), "wide-sizes")
    large = staged(attached(grouped, sizes, ["root"], "n", total).join(prints.select("node", "fp"), "node").select("root", "node", "fp"), "wide-large")

    def summed(rows: Iterator[tuple[int, np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([int(n) for _, n in held.values()], pa.int64()), pa.array([c.tobytes() for c, _ in held.values()], pa.binary())], ["root", "n", "ones"])

        for root, ones, n in rows:
            if (own := held.get(root)) is None:
                if len(held) >= 2000:
                    yield done()
                    held = {}
                own = held[root] = [np.zeros(BITS, np.int64), 0]
            own[0] += ones
            own[1] += n
        if held:
            yield done()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from summed((root, np.unpackbits(np.frombuffer(fp.as_py(), np.uint8), bitorder="little"), 1) for b in batches for root, fp in zip(b.column("root").to_pylist(), b.column("fp"), strict=True))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in summed((root, np.frombuffer(c.as_py(), np.int64), n) for b in batches for root, c, n in zip(b.column("root").to_pylist(), b.column("ones"), b.column("n").to_pylist(), strict=True)):
            centre = [np.packbits(2 * np.frombuffer(c.as_py(), np.int64) > n, bitorder="little").tobytes() for c, n in zip(found.column("ones"), found.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([found.column("root"), found.column("n"), pa.array(centre, pa.binary())], ["root", "n", "centre"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, 8 * WORDS) for c in ("fp", "centre"))
            far = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column("root"), b.column("node"), pa.array(far)], ["root", "node", "far"])

    sums = large.mapInArrow(parts, "root long, n long, ones binary").repartition("root").sortWithinPartitions("root")
    centres = staged(sums.mapInArrow(whole, "root long, n long, centre binary"), "wide-centres")
    measured = attached(large, centres, ["root"], "n", total).select("root", "node", "fp", "centre").mapInArrow(measure, "root long, node long, far long")
    best = staged(measured.groupBy("root").agg(F.min_by("node", F.struct("far", "node")).alias("pivot"), F.count("*").alias("n")), "wide-pivots")
    led = attached(large, best, ["root"], "n", total).select(F.col("node").alias("u"), F.col("pivot").alias("v"))
    rest = grouped.join(F.broadcast(sizes.where(F.col("n") > max(1024, total >> 15)).select("root")), "root", "left_anti").join(sizes.select("root"), "root", "left_anti")
    return led.unionByName(rest.select(F.col("node").alias("u"), F.col("root").alias("v"))).where("u <> v")


def common_shingles(source: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, sorted, and their counts, from one text of SAMPLED. At most 2**COMMON_BITS: each has that share of what is counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "_text"):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t.as_py(), shingle)[:, 0] for t in b.column("_text")]).view(np.int64))], ["token"])

    tokens = source.where(F.pmod("_mark", F.lit(SAMPLED)) == 0).select("_text").mapInArrow(run, "token long")
    counts = staged(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "wide-common")
    least = -(-(counts.agg(F.sum("n").alias("n")).collect()[0]["n"] or 0) // (1 << COMMON_BITS))
    got = counts.where(F.col("n") >= least).toArrow()
    unstage(counts)
    token, n = got.column("token").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def prefix_pairs(dealt: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """dealt: token, label, node (long), size, at (int). Distinct pairs u > v that meet at a token, staged; see meeting_pairs. Where over FEW texts
    meet, pairs are left out whose sketches differ too much (see sketched_pairs)."""
    names = ["token", "label", "node", "size", "at"]
    kinds = "u long, v long, token long, label long, node long, size long, at int"

    def few(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for u, v in meeting_pairs(*(np.concatenate(x) for x in zip(*parts, strict=True)), similarity):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), *(pa.nulls(len(u), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], ["u", "v", *names])

    def many(rows: list[np.ndarray]) -> pa.RecordBatch:
        n = len(rows[0])
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *map(pa.array, rows)], ["u", "v", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passing = [], None  # up to FEW rows of the last token, which may go on; a token whose rows are all passed on
        for b in batches:
            if not b.num_rows:
                continue
            rows = [b.column(c).to_numpy() for c in names]
            if held:
                rows = [np.concatenate(x) for x in zip(*held, rows, strict=True)]
                held = []
            token = rows[0]
            starts = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1])
            sizes = np.diff(np.append(starts, len(token)))
            large = sizes > FEW
            if passing is not None and token[0] == passing:
                large[0] = True
            passing = token[-1] if large[-1] else None
            large = np.repeat(large, sizes)
            if passing is None:  # its rows wait for the next batch
                cut = int(starts[-1])
                held = [[x[cut:] for x in rows]]
                rows, large = [x[:cut] for x in rows], large[:cut]
            if large.any():
                yield many([x[large] for x in rows])
            if not large.all():
                yield from few([[x[~large] for x in rows]])
        if held:
            yield from few(held)

    met = staged(dealt.select(*names).repartition("token").sortWithinPartitions("token", "label").mapInArrow(run, kinds), "wide-met")
    pairs = met.where("u IS NOT NULL").select("u", "v").unionByName(sketched_pairs(met.where("u IS NULL").select(*names), prints, similarity))
    out = staged(pairs.distinct(), "wide-passed")
    unstage(met)
    return out


#: Rows of a block: members of a token are compared block against block.
BLOCK = 1024


def sketched_pairs(members: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """members: token, label, node, size, at. Pairs u > v of nodes that meet at a token, have other labels, and whose sizes and
    sketches let them have the similarity. Sets of the similarity stand in one class of sizes or in neighbouring ones; a token's
    members of a class and the next one are cut into blocks, and tasks compare block against block."""
    ratio = math.log(1 / similarity)
    klass = F.floor(F.log(F.col("size").cast("double")) / ratio + TINY).cast("int")
    rows = members.withColumn("own", klass).withColumn("class", F.explode(F.array(F.col("own"), F.col("own") - 1)))
    sizes = staged(rows.groupBy("token", "class").agg(F.count("*").alias("n"), F.count_if(F.col("own") == F.col("class")).alias("firsts")).where("firsts > 0 AND n > 1"), "wide-classes")
    rows = attached(rows, sizes, ["token", "class"], "n", 2 * members.count()).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, F.col("block")).alias("a"), F.greatest(i, F.col("block")).alias("b")))
    order = ["token", "class", "a", "b"]
    rows = rows.join(prints.select("node", "sketch"), "node").select("token", "class", F.inline(meets), "block", (F.col("own") == F.col("class")).alias("first"), "label", "node", "size", "at", "sketch")
    dealt = rows.repartition(*order).sortWithinPartitions(*order)

    def compare(key: tuple, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        block, first, label, node, size, at = (np.array(x) for x in list(zip(*held, strict=True))[:-1])
        raw = [h[-1] for h in held]
        least = min(map(len, raw))
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, least), axis=0) for x in raw]).view(np.uint64)
        left, right = np.flatnonzero(block == key[2]), np.flatnonzero(block == key[3])
        for start in range(0, len(left), 32):
            i = left[start : start + 32, None]
            j = right[None, :]
            need = least_common(size[i] + size[j], similarity)
            fits = (first[i] | first[j]) & (label[i] != label[j]) & (np.minimum(size[i] - at[i], size[j] - at[j]) >= need)
            fits &= np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - TINY
            if key[2] == key[3]:
                fits &= i < j
            x, y = np.nonzero(fits)
            for s in range(0, len(x), 1 << 16):
                p, q = left[start + x[s : s + (1 << 16)]], right[y[s : s + (1 << 16)]]
                differ = np.bitwise_count(folded[p] ^ folded[q]).sum(axis=1, dtype=np.int64)
                near = differ <= size[p] + size[q] - 2 * least_common(size[p] + size[q], similarity)
                a, b = node[p[near]], node[q[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None  # at most two blocks of a token and class
        for b in batches:
            columns = [b.column(c).to_pylist() for c in (*order, "block", "first", "label", "node", "size", "at", "sketch")]
            for row in zip(*columns, strict=True):
                if row[:4] != last:
                    if len(held) > 1:
                        yield from compare(last, held)
                    held, last = [], row[:4]
                held.append(row[4:])
        if len(held) > 1:
            yield from compare(last, held)

    return dealt.mapInArrow(run, "u long, v long")


def verified(source: DataFrame, prints: DataFrame, pairs: DataFrame, similarity: float, shingle: int, moved: dict) -> DataFrame:
    """The pairs (u, v: nodes) whose shingle sets have the similarity. Sketches leave out most others; texts of the nodes that
    remain are read again, by a filter of fixed size over their marks, and only their sets are shuffled."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("m").to_numpy() + b.column("n").to_numpy()
            differ = np.fromiter((least_difference(x.as_py(), y.as_py()) for x, y in zip(b.column("a"), b.column("b"), strict=True)), np.int64, b.num_rows)
            yield b.select(["u", "v"]).filter(pa.array(differ <= sizes - 2 * least_common(sizes, similarity)))

    side = lambda node, size, held: prints.select(F.col("node").alias(node), F.col("size").alias(size), F.col("sketch").alias(held))
    sketched = pairs.distinct().join(side("u", "m", "a"), "u").join(side("v", "n", "b"), "v").select("u", "v", "m", "n", "a", "b")
    pairs = staged(sketched.mapInArrow(possible, "u long, v long"), "wide-pairs")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    place = F.pmod(F.col("first._mark"), F.lit(1 << FILTER_BITS)) + 1
    blocks = prints.join(nodes, "node", "left_semi").groupBy(F.bitmap_bucket_number(place).alias("i")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    mask = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
    for r in blocks:
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        mask[(r["i"] - 1) * len(part) : r["i"] * len(part)] = part
    wanted = source.sparkSession.sparkContext.broadcast(mask)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for whole in batches:
            x = whole.column("_mark").to_numpy() & ((1 << FILTER_BITS) - 1)
            for b in slices(whole.filter(pa.array((bits[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(bool))), "_text"):
                own = [shingles(t.as_py(), shingle) for t in b.column("_text")]
                names = [moved.get(n, n[0]) for n in map(node_of, own)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([np.sort(s[:, 0]).tobytes() for s in own], pa.binary())], ["node", "own"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            alike = []
            for x, y in zip(b.column("a"), b.column("b"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(common >= similarity * (len(x) + len(y) - common) - TINY)
            yield b.select(["u", "v"]).filter(pa.array(alike, pa.bool_()))

    sets = source.select("_mark", "_text").mapInArrow(read, "node long, own binary").groupBy("node").agg(F.first("own").alias("own"))
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("own").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("own").alias("b")), "v")
    return staged(both.select("u", "v", "a", "b").mapInArrow(compare, "u long, v long"), "wide-verified")


MOST_MOVED = 100_000


def apart(rows: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """rows (node, check and others) with another node where two sets have one node by chance, and by (node, check) which. Among
    10**10 sets a few are expected; over MOST_MOVED of them are refused with RuntimeError."""
    shared = rows.groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("node", "low")
    found = rows.select("node", "check").join(shared, "node").where("check <> low").select("node", "check").distinct().withColumn("to", F.xxhash64("node", "check"))
    got = found.limit(MOST_MOVED + 1).collect()
    if len(got) > MOST_MOVED:
        raise RuntimeError("too many sets share a node")
    if not got:
        return rows, {}
    by = F.broadcast(rows.sparkSession.createDataFrame([tuple(r) for r in got], "node long, check long, to long"))
    other = rows.join(by, ["node", "check"], "left").withColumn("node", F.coalesce("to", "node")).drop("to")
    return staged(other, "wide-rows"), {(r["node"], r["check"]): r["to"] for r in got}


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """docs (its columns and no others, whatever their names) with one row of each group of texts linked over near-duplicates:
    the one with the least key (a null key is the last). Links are all pairs whose sets of shingles have the Jaccard similarity
    or more, and no others. Equal rows (key and text) count as one. Null and empty texts are one group; a text of fewer words
    than a shingle has equals only texts with the same words. An empty table gives an empty table. Texts are shuffled once, to
    leave the rest out.
    """
    with small_batches(docs.sparkSession):
        return _drop(docs, key, text, similarity, shingle)


def _drop(docs: DataFrame, key: str, text: str, similarity: float, shingle: int) -> DataFrame:
    own_key, own_text = F.col(f"`{key}`"), F.col(f"`{text}`")
    facts = (own_key.isNull(), own_key, own_text.isNull(), own_text)
    mark, other = F.xxhash64(*facts).alias("_mark"), F.xxhash64(F.lit(1), *facts).alias("_other")  # 128 bits name a row
    source = docs.select(mark, other, own_key.alias("_key"), own_text.alias("_text"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "_text"):
                node, check = zip(*(node_of(shingles(t.as_py(), shingle)) for t in b.column("_text")), strict=True)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(node, pa.int64()), pa.array(check, pa.int64())], [*b.schema.names[:-1], "node", "check"])

    named = staged(source.select("_mark", "_other", "_text").mapInArrow(name, "_mark long, _other long, node long, check long"), "wide-names")
    moved = apart(named)[1]
    known = docs.sparkSession.sparkContext.broadcast(common_shingles(source, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = known.value
        for whole in batches:
            for b in slices(whole, "_text"):
                own = [shingles(t.as_py(), shingle) for t in b.column("_text")]
                names = [moved.get(n, n[0]) for n in map(node_of, own)]
                found = (pa.array(names, pa.int64()), pa.array([len(s) for s in own], pa.int64()), pa.array([fingerprint_of(s) for s in own], pa.binary()), pa.array([sketch(s[:, 1]) for s in own], pa.binary()))
                firsts = pa.array([prefix(s[:, 0], common, counts, similarity).view(np.int64) for s in own], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *found, firsts], [*b.schema.names[:-1], "node", "size", "fp", "sketch", "prefix"])

    rows = source.mapInArrow(run, f"_mark long, _other long, _key {source.schema['_key'].dataType.simpleString()}, node long, size long, fp binary, sketch binary, prefix array<long>")
    first = F.struct(F.col("_key").isNull(), F.col("_key"), F.col("_mark"), F.col("_other"))
    prints = staged(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("prefix").alias("prefix"), F.min(first).alias("first")), "wide-prints")
    grouped = staged(roots(near_links(prints, similarity)), "wide-groups")
    near = verified(source, prints, pivots(grouped, prints), similarity, shingle, moved)
    labelled = prints.join(near.withColumnRenamed("u", "node"), "node", "left").select("node", "size", "prefix", F.coalesce("v", "node").alias("label"))
    tokens = labelled.select(F.posexplode("prefix").alias("at", "token"), "label", "node", "size")
    of = F.pmod(F.xxhash64("token", F.lit(3)), F.lit(PASSES))
    met = [prefix_pairs(tokens.where(of == k), prints, similarity) for k in range(PASSES)]
    rest = verified(source, prints, reduce(DataFrame.unionByName, met), similarity, shingle, moved)
    found = staged(roots(near.unionByName(rest)), "wide-roots")
    heads = prints.select("node", "first").join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    names = ["_mark", "_other"]
    stays = heads.select(*(F.col(f"first.{n}") for n in names)).distinct()
    marks = named.groupBy(*names).agg(F.count("*").alias("n")).join(stays.withColumn("stays", F.lit(True)), names, "left")
    marks = staged(marks.where("stays IS NULL OR n > 1"), "wide-marks")
    for old in (named, prints, grouped, near, rest, found, *met):
        unstage(old)
    whole = docs.select(nested([F.col(f"`{c}`") for c in docs.columns]), mark, other)
    kept = whole.join(marks.where("stays IS NULL").select(*names), names, "left_anti")
    if marks.where("stays").limit(1).count():  # the same row several times: once is enough
        again = marks.where("stays").select(*names)
        kept = kept.join(again, names, "left_anti").unionByName(kept.join(again, names, "left_semi").dropDuplicates(names))
    return unnested(kept, [])
