"""Best-fit-decreasing bin packing of indivisible groups into fixed-capacity shards.

The packing depends only on how many groups have each size, so the driver packs size classes, of which there are at most
CLASSES whatever the data: sizes below 4096 are exact, larger ones are rounded up to 12 significant bits. Classes enter from
the largest; a run of equal groups fills the tightest bin that still takes one (found in a balanced tree of remaining
capacities) until it takes no more. The plan is a list of rank ranges for each class, and groups find their shard by their
rank in the class, which is counted in buckets so that no class is ever gathered into one task. The driver holds the plan: a
piece for each class and bin that meet, with given `shards` some 4096 + 40 * 4096 of them at most, with given `capacity` as many
as classes and bins; more than MOST_BINS bins are refused.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataq.llm.common import staged

EXACT, BITS = 4096, 12
#: Rows of a bucket, about: ranks and slots are counted in a bucket and offset by the counts of the buckets before it.
BUCKET_ROWS = 50_000
MOST_BINS = 1 << 22
#: Ranks of a class that find their piece by one key of the join.
RANKS = 1024


def size_class(size: Column) -> Column:
    """The size, rounded up to BITS significant bits from EXACT on."""
    drop = F.greatest(F.lit(0), F.ceil(F.log2(size + 1)).cast("int") - BITS)
    unit = F.pow(F.lit(2.0), drop).cast("long")
    return F.when(size < EXACT, size).otherwise(F.ceil(size / unit).cast("long") * unit)


@dataclass
class Plan:
    """pieces: (class, first rank, rank after the last, bin); loads: packed size by bin; capacity: of each bin."""

    pieces: list[tuple[int, int, int, int]]
    loads: list[int]
    capacity: int


class Tree:
    """A set of keys as a treap: a binary search tree that random priorities keep balanced. A node is [key, priority, left, right]."""

    def __init__(self):
        self.root, self.draw = None, random.Random(5).random

    @staticmethod
    def _split(node: list | None, key: tuple) -> tuple[list | None, list | None]:
        """The tree's keys below `key`, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = Tree._split(node[3], key)
            return node, high
        low, node[2] = Tree._split(node[2], key)
        return low, node

    @staticmethod
    def _merge(low: list | None, high: list | None) -> list | None:
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = Tree._merge(low[3], high)
            return low
        high[2] = Tree._merge(low, high[2])
        return high

    def add(self, key: tuple) -> None:
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, [key, self.draw(), None, None]), high)

    def pop_from(self, key: tuple) -> tuple | None:
        """Removes and returns the least key that isn't below `key`; None if there is none."""
        low, high = self._split(self.root, key)
        if high is None:
            self.root = low
            return None
        above, node = None, high
        while node[2] is not None:
            above, node = node, node[2]
        if above is None:
            high = node[3]
        else:
            above[2] = node[3]
        self.root = self._merge(low, high)
        return node[0]


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int, first_bin: int = 0) -> Plan:
    """Packs (size, count) classes into bins of the capacity; a group over the capacity has a bin of its own. No classes, or
    counts of 0, give no bin.

    Bins are kept in a tree by (remaining capacity, bin): the tightest bin that takes a size is one search away.
    """
    bins = Tree()
    loads: list[int] = []
    pieces = []
    for size, count in sorted(classes, reverse=True):
        done = 0
        while done < count:
            left, b = bins.pop_from((size, -1)) or (max(capacity, size), len(loads))
            if b == len(loads):
                if b >= MOST_BINS:
                    raise ValueError(f"over {MOST_BINS} bins of {capacity}")
                loads.append(0)
            take = min(count - done, left // size)
            pieces.append((size, done, done + take, first_bin + b))
            loads[b] += take * size
            done += take
            bins.add((left - take * size, b))
    return Plan(pieces, loads, capacity)


def pack_into(classes: list[tuple[int, int]], bins: int) -> Plan:
    """Best fit decreasing into at most `bins` bins of the least capacity that suffices (found by bisection).

    Groups over an equal share of what is left have bins of their own, before the rest is packed into the other bins.
    """
    pieces, loads, left = [], [], {size: n for size, n in classes if n}
    total = sum(s * n for s, n in left.items())
    ranks = dict.fromkeys(left, 0)
    while left and len(loads) < bins - 1 and (top := max(left)) * (bins - len(loads)) > total:
        pieces.append((top, ranks[top], ranks[top] + 1, len(loads)))
        loads.append(top)
        total -= top
        ranks[top] += 1
        left[top] -= 1
        if not left[top]:
            del left[top]
    if not left:
        return Plan(pieces, loads, max(loads, default=0))
    rest, free = sorted(left.items()), bins - len(loads)
    low = max(-(-total // free), max(left))
    high = low
    while len((plan := best_fit_decreasing(rest, high, len(loads))).loads) > free:
        high += max(1, (high - low) or high >> 10)
    while low < high:
        middle = (low + high) // 2
        found = best_fit_decreasing(rest, middle, len(loads))
        if len(found.loads) <= free:
            plan, high = found, middle
        else:
            low = middle + 1
    pieces += [(s, ranks[s] + a, ranks[s] + b, k) for s, a, b, k in plan.pieces]
    return Plan(pieces, loads + plan.loads, max([*loads, plan.capacity]))


def ranked(rows: DataFrame, by: str, order: list[Column], name: str, buckets: int) -> DataFrame:
    """rows with `name`: 0, 1, ... within each value of `by`. Rows of a value are dealt by the hash of `order` over buckets,
    numbered there, and offset by the sizes of the value's earlier buckets; ties of `order` are numbered in any order."""
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(by, "_bucket").count().withColumn("_offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy(by, "_bucket").orderBy(*order)
    numbered = dealt.withColumn("_in", F.row_number().over(inside) - 1)
    return numbered.join(offsets, [by, "_bucket"]).withColumn(name, F.col("_offset") + F.col("_in")).drop("_bucket", "_offset", "_in")


def pack(rows: DataFrame, group: str, size: str, order: list[Column], shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """rows with `shard` and `slot` (0, 1, ... within the shard: in buckets by the hash of `order`, then by it). Rows with equal `group` (not null) stay in one shard.

    Give `shards` (at most so many, sizes near equal: least sufficient capacity) or `capacity` (as few shards as best fit
    decreasing needs; a group over the capacity is alone). A null size counts as 0; every group takes a size of 1 at least.
    rows should be staged: it is read three times.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    groups = rows.groupBy(group).agg(F.greatest(F.sum(F.coalesce(size, F.lit(0))), F.lit(1)).cast("long").alias("_size"), F.count("*").alias("_rows"))
    groups = staged(groups.withColumn("_class", size_class(F.col("_size"))), "groups")
    counts = groups.groupBy("_class").agg(F.count("*").alias("n"), F.sum("_rows").alias("rows")).collect()  # bounded: see above
    classes = [(r["_class"], r["n"]) for r in counts]
    plan = pack_into(classes, shards) if shards is not None else best_fit_decreasing(classes, capacity)
    pieces = rows.sparkSession.createDataFrame(plan.pieces, "_class long, _from long, _to long, shard int")
    pieces = pieces.withColumn("_ranks", F.explode(F.sequence(F.expr(f"_from div {RANKS}"), F.expr(f"(_to - 1) div {RANKS}"))))
    buckets = lambda n: max(1, -(-n // BUCKET_ROWS))
    placed = ranked(groups, "_class", [F.col(group)], "_rank", buckets(sum(r["n"] for r in counts))).withColumn("_ranks", F.expr(f"_rank div {RANKS}"))
    placed = placed.join(pieces, ["_class", "_ranks"]).where("_from <= _rank AND _rank < _to")
    # a group of many rows meets the one row of its group: the join's skewed side can be split
    found = rows.join(placed.select(group, "shard"), group)
    return ranked(found, "shard", order, "slot", buckets(sum(r["rows"] for r in counts)))
