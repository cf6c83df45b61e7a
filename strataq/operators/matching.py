"""Joins between snapshots, images, lineages and records that go by position, path or key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prior_blocks(now: DataFrame, prior: DataFrame) -> DataFrame:
    """Single blocks whose content differs from the prior snapshot's at the same place: volume_id, start_lba, hash, prior_hash."""
    old = prior.where("lba_length = 1").select("volume_id", "start_lba", F.col("hash").alias("prior_hash"))
    return now.where("lba_length = 1").select("volume_id", "start_lba", "hash").join(old, ["volume_id", "start_lba"]).where("hash <> prior_hash")


def match_filemaps(target: DataFrame, sources: DataFrame) -> DataFrame:
    """target rows (path, file_offset, byte_count, hash) with source_hash of the first source (by ordinal) whose whole layout
    of the path, offsets and counts, is the same; rows whose content is already equal are left out."""
    layout = lambda df, *keys: df.groupBy(*keys, "path").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col("file_offset").cast("string"), 20, "0"), "byte_count"))), ",").alias("layout"))
    same = layout(target).join(layout(sources, "ordinal"), ["path", "layout"]).groupBy("path").agg(F.min("ordinal").alias("ordinal"))
    rows = target.join(same, "path").join(sources.select("ordinal", "path", "file_offset", F.col("hash").alias("source_hash")), ["ordinal", "path", "file_offset"])
    return rows.where("hash <> source_hash").select("path", "file_offset", "byte_count", "hash", "source_hash")


def first_owner(layers: DataFrame, segments: DataFrame) -> DataFrame:
    """For each volume and segment number in its ancestry, the nearest layer that holds it: volume_id, segment_id, owner."""
    held = segments.select(F.col("volume_id").alias("layer_volume_id"), "segment_id").distinct()
    rows = layers.join(held, "layer_volume_id").where("segment_id <= cutoff")
    return rows.groupBy("volume_id", "segment_id").agg(F.min_by("layer_volume_id", "depth").alias("owner"))


def shared_keys(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """Owners of a key that more than one owner has."""
    many = rows.groupBy(key).agg(F.countDistinct(owner).alias("owners")).where("owners > 1")
    return rows.select(key, owner).distinct().join(many, key)


def enrol(requests: DataFrame) -> DataFrame:
    """seq, sub, outcome of each request: created (the first of its subject), idempotent (the first one's key), or conflict."""
    first = requests.groupBy("sub").agg(F.min_by(F.struct("seq", "pubkey"), "seq").alias("f"))
    outcome = F.when(F.col("seq") == F.col("f.seq"), "created").when(F.col("pubkey") == F.col("f.pubkey"), "idempotent").otherwise("conflict")
    return requests.join(first, "sub").select("seq", "sub", outcome.alias("outcome"))


def recorded_order(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value isn't above all values before them in their key."""
    before = F.max(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("highest_before", before).where(F.col(value) <= F.col("highest_before")).select(key, order, value, "highest_before")


def trace_cost(trace: DataFrame, files1: DataFrame, files2: DataFrame) -> DataFrame:
    """class (exact: image 1 has the content; changed: it has the path; new; unmapped: no file), reads and bytes of a trace."""
    known = files1.select("hash").distinct().withColumn("exact", F.lit(True))
    place = files2.groupBy("hash").agg(F.min("path").alias("path"))
    old = files1.select("path").withColumn("had", F.lit(True))
    rows = trace.join(known, "hash", "left").join(place, "hash", "left").join(old, "path", "left")
    kind = F.when(F.col("exact"), "exact").when(F.col("path").isNull(), "unmapped").when(F.col("had"), "changed").otherwise("new")
    return rows.groupBy(kind.alias("class")).agg(F.count("*").alias("reads"), F.sum("byte_count").alias("bytes"))


MOST_LEVELS = 256


def tree_paths(entries: DataFrame) -> DataFrame:
    """inode and path of every directory entry (inode, parent, name) that hangs below a root (a null parent), level by level; the
    root's path is empty, and an inode with several names has several rows. Trees of over MOST_LEVELS levels, or with a
    directory below itself, are refused with ValueError."""
    step = entries.where("parent IS NULL").select("inode", F.lit("").alias("path"))
    out, edges = [step], entries.where("parent IS NOT NULL").select(F.col("inode").alias("child"), F.col("parent").alias("inode"), "name")
    for _ in range(MOST_LEVELS):
        step = step.join(edges, "inode").select(F.col("child").alias("inode"), F.concat("path", F.lit("/"), "name").alias("path"))
        if step.isEmpty():
            return reduce(DataFrame.unionByName, out)
        out.append(step)
    raise ValueError("a directory tree is too deep")
