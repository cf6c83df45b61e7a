"""Fork ancestry, layered maps, and the set algebra of segment heads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.operators.extentmap import live_map, tier_rank

MOST_DEPTH = 64
NO_CUTOFF = 2**63 - 1
RETENTION_S = 600


def layers(lineage: DataFrame) -> DataFrame:
    """volume_id, layer_volume_id, depth (0: the volume itself) and cutoff (inclusive) for each volume in lineage.

    lineage: child_id, parent_id, branch_id; at most one parent for a child. A chain longer than MOST_DEPTH (a cycle) is
    refused with ValueError.
    """
    volumes = lineage.select(F.col("child_id").alias("volume_id")).union(lineage.select("parent_id")).distinct()
    step = volumes.select("volume_id", F.col("volume_id").alias("layer_volume_id"), F.lit(0).alias("depth"), F.lit(NO_CUTOFF).alias("cutoff"))
    out, edges = step, lineage.select(F.col("child_id").alias("layer_volume_id"), "parent_id", "branch_id")
    for depth in range(1, MOST_DEPTH + 1):
        step = step.join(edges, "layer_volume_id").select("volume_id", F.col("parent_id").alias("layer_volume_id"), F.lit(depth).alias("depth"), F.col("branch_id").alias("cutoff"))
        if step.isEmpty():
            return out
        out = out.unionByName(step)
    raise ValueError("lineage has a cycle")


def forked_live_map(entries: DataFrame, lineage: DataFrame) -> DataFrame:
    """Each volume's map through its ancestry: nearer layers on top, of an ancestor only segments up to the branch."""
    known = layers(lineage).withColumnRenamed("layer_volume_id", "layer")
    rows = entries.withColumnRenamed("volume_id", "layer").join(known, "layer").where("segment_id <= cutoff")
    return live_map(rows, ["volume_id"], F.struct((-F.col("depth")).alias("d"), tier_rank().alias("t"), "segment_id", "entry_idx"))


def live_set(head: DataFrame) -> DataFrame:
    """Manifest and added segments without superseded and tombstoned ones."""
    present = head.where("section IN ('manifest', 'added')").select("volume_id", "segment_id").distinct()
    gone = head.where("section IN ('superseded', 'tombstoned')").select("volume_id", "segment_id")
    return present.join(gone, ["volume_id", "segment_id"], "left_anti")


def reap_due(head: DataFrame, retention_s: int = RETENTION_S) -> DataFrame:
    """Superseded segments whose retention has passed."""
    return head.where(f"section = 'superseded' AND age_s >= {retention_s}").select("volume_id", "segment_id").distinct()


def head_after_reap(head: DataFrame, retention_s: int = RETENTION_S) -> DataFrame:
    return head.join(reap_due(head, retention_s), ["volume_id", "segment_id"], "left_anti")


def head_render(head: DataFrame) -> DataFrame:
    """One line of text a volume: sections in order, each with its sorted segments."""
    lines = head.groupBy("volume_id", "section").agg(F.array_join(F.array_sort(F.collect_list("segment_id")), ",").alias("line"))
    return lines.groupBy("volume_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "section", "line"))), ";").alias("head"))
