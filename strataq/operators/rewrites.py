"""Carrying out rewrite plans, and the checks that may cancel what came of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataq.operators.extentmap import ZERO_HASH


def owners(extents: DataFrame, deltas: DataFrame) -> DataFrame:
    """Owner-only form of both tables: owns (body or delta), volume_id, hash, segment_id."""
    rows = [df.select(F.lit(kind).alias("owns"), "volume_id", "hash", "segment_id") for kind, df in (("body", extents), ("delta", deltas))]
    return rows[0].unionByName(rows[1])


def positions(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with their position in their volume, by start_lba or the given order; a volume's rows are sorted together."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("volume_id").orderBy(*(order or (F.col("start_lba"),)))) - 1)


def places_of(hashes: DataFrame, runs: DataFrame) -> DataFrame:
    """Where the given contents are mapped: volume_id, hash, segment_id, start_lba, lba_length."""
    return hashes.select("volume_id", "hash", "segment_id").join(runs.where(F.col("hash") != ZERO_HASH).select("volume_id", "hash", "start_lba", "lba_length"), ["volume_id", "hash"])


def materialise(plan: DataFrame, entries: DataFrame, block: int) -> DataFrame:
    """Output entries of a plan (entry_key, ord, op, start_lba, lba_length, payload_block_offset): entry_key, ord, op, kind, hash,
    start_lba, lba_length. entries carry `body`, the whole content. A keep stays as it is, a canonical claims no blocks, a
    zero_split is a zero of its range, a run is new data: its slice of the body under the slice's own hash. Drops give nothing."""
    op = F.col("op")
    rows = plan.where(op != "drop").join(entries.select("entry_key", F.col("kind").alias("was"), F.col("hash").alias("old_hash"), "body"), "entry_key")
    cut = F.substring(F.col("body"), F.col("payload_block_offset") * block + 1, F.col("lba_length") * block)
    canonical = F.when(F.col("was").endswith("inline"), "canonical_inline").otherwise("canonical_data")
    kind = F.when(op == "zero_split", "zero").when(op == "run", "data").when(op == "keep", F.col("was")).otherwise(canonical)
    hash_ = F.when(op == "zero_split", ZERO_HASH).when(op == "run", F.sha2(cut, 256)).otherwise(F.col("old_hash"))
    claim = lambda c: F.when(op == "canonical", F.lit(0).cast("long")).otherwise(F.col(c)).alias(c)
    return rows.select("entry_key", "ord", "op", kind.alias("kind"), hash_.alias("hash"), claim("start_lba"), claim("lba_length"))


def cancels(owned: DataFrame, carried: DataFrame, live: DataFrame) -> DataFrame:
    """By volume: contents that inputs own and outputs don't carry, how many of them are live, and whether that cancels the
    rewrite. Volumes that lose nothing have no row."""
    lost = owned.select("volume_id", "hash").distinct().join(carried.select("volume_id", "hash").distinct(), ["volume_id", "hash"], "left_anti")
    rows = lost.join(live.select("volume_id", "hash", F.lit(True).alias("live")), ["volume_id", "hash"], "left")
    return rows.groupBy("volume_id").agg(F.count("*").alias("dropped"), F.count("live").alias("still_live"), (F.count("live") > 0).alias("cancelled"))


def stored_live(classified: DataFrame) -> DataFrame:
    """By segment, stored bytes and their share that is still mapped, in whole bytes an entry."""
    rows = classified.where("lba_length > 0 AND kind IN ('data', 'inline')")
    return rows.groupBy("volume_id", "segment_id").agg(F.sum(F.expr("(stored_length * matching) div lba_length")).alias("live_stored"), F.sum("stored_length").alias("stored"))


def resident(classified: DataFrame, offsets: DataFrame) -> DataFrame:
    """By segment, whether the cache has every body that a rewrite of it reads; true where it reads none."""
    rows = classified.where("outcome NOT LIKE 'drop%'").select("volume_id", "segment_id", "entry_key", "kind").join(offsets.select("entry_key", "present"), "entry_key", "left")
    needed = F.when(F.col("kind").isin("data", "canonical_data"), F.col("present"))
    return rows.groupBy("volume_id", "segment_id").agg(F.coalesce(F.bool_and(needed), F.lit(True)).alias("resident"))


def most_dead(candidates: DataFrame, cap: int) -> DataFrame:
    """The `cap` candidates of each volume with most dead blocks, ranked; each task passes on `cap` of a volume at most."""
    rank = F.row_number().over(Window.partitionBy("volume_id").orderBy(F.desc("dead_blocks"), "hash"))
    return candidates.withColumn("rank", rank).where(F.col("rank") <= cap).select("volume_id", "hash", "lba_length", "dead_blocks", "rank")


def contained(target: DataFrame, runs: DataFrame) -> DataFrame:
    """By target (volume_id, hash, start_lba, end_lba): runs of its content, and whether all of them lie inside it. One that
    doesn't would still need the old body, so the rewrite is left."""
    spans = runs.where(F.col("hash") != ZERO_HASH).select("volume_id", "hash", F.col("start_lba").alias("run_start"), (F.col("start_lba") + F.col("lba_length")).alias("run_end"))
    inside = (F.col("run_start") >= F.col("start_lba")) & (F.col("run_end") <= F.col("end_lba"))
    return target.join(spans, ["volume_id", "hash"]).groupBy("volume_id", "hash", "start_lba").agg(F.count("*").alias("runs"), F.bool_and(inside).alias("contained"))
