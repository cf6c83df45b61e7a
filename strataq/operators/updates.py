"""Conditional updates of the live map and of the tables of extents: what changes only if nothing newer stands there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.operators.intervals import islands, overlay, range_join


def insert_if_newer(runs: DataFrame, inserts: DataFrame, consumed: DataFrame | None = None) -> DataFrame:
    """The map after inserts (volume_id, entry_key, start_lba, lba_length, hash, claimant, ord, source_hash) in order of ord, each
    only where the claimant that stands there is older than its own; of equals the first stays. Claims of consumed segments
    (volume_id, segment_id) stand in nobody's way. Runs keep volume_id, start_lba, lba_length, hash, claimant,
    payload_block_offset (within the body of whoever claims it), source_hash and is_new.

    One after another by claimant is the same as the newest claimant on top, so this is an overlay.
    """
    rank = F.col("claimant")
    old = runs
    if consumed is not None:
        gone = consumed.select("volume_id", F.col("segment_id").alias("claimant"), F.lit(True).alias("gone")).distinct()
        old = old.join(gone, ["volume_id", "claimant"], "left")
        rank = F.when(F.col("gone"), -1).otherwise(F.col("claimant"))
    shape = ["volume_id", "start_lba", "lba_length", "hash", "claimant", "source_hash"]
    place = lambda kind, *parts: F.concat_ws("/", F.lit(kind), *parts).alias("piece")
    a = old.select(*shape, F.col("payload_block_offset").alias("base"), rank.cast("long").alias("rank"), F.lit(1).cast("long").alias("early"), place("old", "entry_key", "start_lba"))
    b = inserts.select(*shape, F.lit(0).cast("long").alias("base"), F.col("claimant").alias("rank"), (-F.col("ord")).alias("early"), place("new", "entry_key"))
    top = overlay(a.unionByName(b), ["volume_id"], F.struct("rank", "early"), ["hash", "claimant", "source_hash", "base"], identity="piece")
    return top.select(*shape, (F.col("payload_block_offset") + F.col("base")).alias("payload_block_offset"), F.col("piece").startswith("new").alias("is_new"))


def raise_claimants(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """runs (with a unique run_id) with the newest claimant of the updates (volume_id, first, last, hash, new_claimant) that
    overlap a run of their hash, where it is newer than the run's own; and raised: whether it is."""
    spans = runs.select("volume_id", "run_id", F.col("hash").alias("run_hash"), F.col("start_lba").alias("run_start"), (F.col("start_lba") + F.col("lba_length")).alias("run_end"))
    met = range_join(spans, updates, ["volume_id"], ("run_start", "run_end"), ("first", "last")).where("run_hash = hash")
    newest = met.groupBy("run_id").agg(F.max("new_claimant").alias("newest"))
    rows = runs.join(newest, "run_id", "left")
    raised = F.coalesce(F.col("newest") > F.col("claimant"), F.lit(False))
    return rows.withColumns({"claimant": F.when(raised, F.col("newest")).otherwise(F.col("claimant")), "raised": raised}).drop("newest")


def replace_sources(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """runs with the source_hash of the last update (by ord) that names exactly their start and hash; and replaced."""
    last = updates.groupBy("volume_id", "start_lba", "hash").agg(F.max_by("source_hash", "ord").alias("new_source"))
    rows = runs.join(last, ["volume_id", "start_lba", "hash"], "left")
    return rows.withColumns({"replaced": F.col("new_source").isNotNull(), "source_hash": F.coalesce("new_source", "source_hash")}).drop("new_source")


def swapped(table: DataFrame, updates: DataFrame, keys: list[str], expected: dict[str, str], new: dict[str, Column]) -> DataFrame:
    """table with the columns of `new` changed where an update of its keys expects what stands there (expected: a table's column
    to an update's), and `swapped`. Of several updates of a key the first (by ord) counts; others and mismatches change nothing."""
    holds = [F.col(f"t.{k}") == F.col(f"u.{k}") for k in keys] + [F.col(f"t.{a}") == F.col(f"u.{b}") for a, b in expected.items()]
    first = updates.groupBy(*keys).agg(F.min_by(F.struct(*(F.col(c) for c in updates.columns if c not in keys)), "ord").alias("f")).select(*keys, "f.*")
    met = table.alias("t").join(first.alias("u"), holds, "left")
    hit = F.col("u.ord").isNotNull()
    return met.select(*((F.when(hit, new[c]).otherwise(F.col(f"t.{c}")) if c in new else F.col(f"t.{c}")).alias(c) for c in table.columns), hit.alias("swapped"))


def removed(table: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """table without the rows that an update names by all the keys."""
    return table.join(updates.select(*keys).distinct(), keys, "left_anti")


def value_runs(runs: DataFrame) -> DataFrame:
    """Stretches of one content in a volume's view, whichever entries they come from: volume_id, hash, start_lba, end_lba."""
    spans = runs.select("volume_id", "hash", "start_lba", (F.col("start_lba") + F.col("lba_length")).alias("end_lba"))
    return islands(spans, ["volume_id", "hash"], "start_lba", "end_lba")


def map_difference(stored: DataFrame, rebuilt: DataFrame, columns: list[str]) -> DataFrame:
    """Runs of one map that the other doesn't have, by side: stored_only and rebuilt_only, 0 each for equal maps."""
    a, b = stored.select(*columns), rebuilt.select(*columns)
    count = lambda side, rows: rows.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count("stored_only", a.exceptAll(b)).unionByName(count("rebuilt_only", b.exceptAll(a)))
