"""The interval kernel: overlay, range join, complement and islands, all partitioned by key and bucket.

Intervals are half open. Long ones are cut at multiples of a bucket's width, so every shuffle is by (key, bucket): no volume,
however large, is sorted or joined in one task, and no interval join becomes a Cartesian product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 256


def bucketed(df: DataFrame, start: str, end: str, width: int = WIDTH) -> DataFrame:
    """A row for each bucket that [start, end) touches, with _b, and _s and _e: the part inside the bucket. Empty and null
    intervals give no row."""
    some = df.where(F.col(start) < F.col(end))
    first, last = F.expr(f"`{start}` div {width}"), F.expr(f"(`{end}` - 1) div {width}")
    cut = some.withColumn("_b", F.explode(F.sequence(first, last)))
    return cut.withColumns({"_s": F.greatest(F.col(start), F.col("_b") * width), "_e": F.least(F.col(end), (F.col("_b") + 1) * width)})


def islands(df: DataFrame, keys: list[str], start: str, end: str, keep: list[Column] | None = None, touching: bool = True) -> DataFrame:
    """Unions of overlapping (and touching) intervals with equal keys: keys, start, end, and any aggregates in keep."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max(end).over(before)
    opens = F.col(start) > reached if touching else F.col(start) >= reached
    marked = df.withColumn("_new", F.when(reached.isNull() | opens, 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), *(keep or [])).drop("_island")


def overlay(entries: DataFrame, keys: list[str], priority: Column, carry: list[str], identity: str = "entry_key", start: str = "start_lba", length: str = "lba_length", width: int = WIDTH) -> DataFrame:
    """The map after all entries are written in order of priority, the highest on top: keys, start, length,
    payload_block_offset, identity and carry, a row for each maximal run of one entry.

    priority must be unique where entries of a key overlap. Runs of different entries are never merged.
    """
    ends = entries.withColumns({"_start": F.col(start), "_end": F.col(start) + F.col(length), "_prio": priority})
    parts = bucketed(ends.select(*keys, "_start", "_end", "_prio", identity, *carry), "_start", "_end", width)
    place = [*keys, "_b"]
    bounds = parts.select(*place, F.explode(F.array("_s", "_e")).alias("_lo")).distinct()
    cells = bounds.withColumn("_hi", F.lead("_lo").over(Window.partitionBy(*place).orderBy("_lo"))).where("_hi IS NOT NULL")
    covering = cells.join(parts, place).where("_s <= _lo AND _lo < _e")
    top = F.max_by(F.struct(identity, "_start", *carry), "_prio").alias("_top")
    won = covering.groupBy(*place, "_lo", "_hi").agg(top).select(*keys, "_lo", "_hi", "_top.*")
    runs = islands(won, [*keys, identity], "_lo", "_hi", [F.first("_start").alias("_start"), *(F.first(c).alias(c) for c in carry)])
    return runs.select(*keys, F.col("_lo").alias(start), (F.col("_hi") - F.col("_lo")).alias(length), (F.col("_lo") - F.col("_start")).alias("payload_block_offset"), identity, *carry)


def range_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int = WIDTH) -> DataFrame:
    """Pairs of rows with equal keys whose half-open intervals overlap, each pair once, with lo and hi of the overlap.

    Apart from keys, the two sides must have different column names.
    """
    a = bucketed(left, *left_span, width).drop("_s", "_e")
    b = bucketed(right, *right_span, width).drop("_s", "_e")
    lo, hi = F.greatest(left_span[0], right_span[0]), F.least(left_span[1], right_span[1])
    met = a.join(b, [*keys, "_b"]).withColumns({"lo": lo, "hi": hi})
    return met.where((F.col("lo") < F.col("hi")) & (F.expr(f"lo div {width}") == F.col("_b"))).drop("_b")


def point_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, span: tuple[str, str], how: str = "inner", width: int = WIDTH) -> DataFrame:
    """Points with the spans that hold them: only the spans' side is cut into buckets."""
    cut = bucketed(spans, *span, width).select(*keys, "_b", F.col("_s").alias("_from"), F.col("_e").alias("_to"), *(c for c in spans.columns if c not in keys))
    asked = points.withColumn("_b", F.expr(f"`{at}` div {width}"))
    left = asked.alias("p")
    right = cut.alias("s")
    condition = F.col("p._b") == F.col("s._b")
    for k in keys:
        condition &= F.col(f"p.{k}") == F.col(f"s.{k}")
    condition &= (F.col("s._from") <= F.col(f"p.{at}")) & (F.col(f"p.{at}") < F.col("s._to"))
    return left.join(right, condition, how).select(*(F.col(f"p.{c}") for c in points.columns), *(F.col(f"s.{c}") for c in spans.columns if c not in keys))


def complement(pieces: DataFrame, wholes: DataFrame, key: str, span: tuple[str, str]) -> DataFrame:
    """What the disjoint pieces (key, lo, hi) leave uncovered of each whole: key, lo, hi. Sorted within one whole only."""
    start, end = span
    edges = pieces.select(key, "lo", "hi").unionByName(wholes.select(key, F.col(start).alias("lo"), F.col(start).alias("hi"))).unionByName(wholes.select(key, F.col(end).alias("lo"), F.col(end).alias("hi")))
    order = Window.partitionBy(key).orderBy("lo", "hi")
    after = edges.withColumn("_next", F.lead("lo").over(order))
    return after.where("_next > hi").select(key, F.col("hi").alias("lo"), F.col("_next").alias("hi"))
