"""Live maps of volumes, canonical extents, and what follows from them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataq.operators.intervals import complement, overlay, point_join, range_join

# Fixed values of the data model.
BODY_KINDS = ("data", "inline", "canonical_data", "canonical_inline")
CANONICAL_KINDS = ("canonical_data", "canonical_inline")
ZERO_HASH = "0" * 32
BLOCK_BYTES = 4096
RECLAIM_DEAD_BLOCKS, RECLAIM_DEAD_RATIO, RECLAIM_STORED_BYTES = 8, 0.3, 64 * 1024
DENSITY, SMALL_BYTES, LIVE_CAP, ENTRY_CAP, MOST_BUCKETS = 0.70, 16 << 20, 32 << 20, 8192, 4


def tier_rank(tier: str = "tier") -> Column:
    """Committed segments below pending ones, these below the write log."""
    return F.when(F.col(tier) == "wal", 2).when(F.col(tier) == "pending", 1).otherwise(0)


def newest() -> Column:
    """Priority of the map: the newest write wins."""
    return F.struct(tier_rank().alias("t"), "segment_id", "entry_idx")


def visible(entries: DataFrame, inputs: DataFrame) -> DataFrame:
    """Entries without index-tier segments that a gc output lists as its inputs."""
    hidden = inputs.select("volume_id", F.col("input_id").alias("segment_id"), F.lit("index").alias("tier")).distinct()
    return entries.join(hidden, ["volume_id", "segment_id", "tier"], "left_anti")


def live_map(entries: DataFrame, keys: list[str] | None = None, priority: Column | None = None) -> DataFrame:
    """Runs of the map; entries that only own content claim no blocks and don't appear."""
    runs = overlay(entries, keys or ["volume_id"], priority if priority is not None else newest(), ["hash", "segment_id"])
    return runs.withColumnRenamed("segment_id", "claimant")


def canonical_extents(entries: DataFrame) -> DataFrame:
    """For each content hash its body's first writer: volume_id, hash, segment_id, entry_idx, kind, stored_length, compressed."""
    bodies = entries.where(F.col("kind").isin(*BODY_KINDS))
    first = F.min(F.struct(tier_rank().alias("t"), "segment_id", "entry_idx", "kind", "stored_length", "compressed", "entry_key")).alias("f")
    return bodies.groupBy("volume_id", "hash").agg(first).select("volume_id", "hash", "f.segment_id", "f.entry_idx", "f.kind", "f.stored_length", "f.compressed", "f.entry_key")


def delta_extents(entries: DataFrame, extents: DataFrame) -> DataFrame:
    """First deltas of hashes that have no body."""
    first = F.min(F.struct(tier_rank().alias("t"), "segment_id", "entry_idx", "source_hash")).alias("f")
    deltas = entries.where("kind = 'delta'").groupBy("volume_id", "hash").agg(first)
    return deltas.join(extents, ["volume_id", "hash"], "left_anti").select("volume_id", "hash", "f.segment_id", "f.entry_idx", "f.source_hash")


def resolve_reads(requests: DataFrame, runs: DataFrame, extents: DataFrame, deltas: DataFrame) -> DataFrame:
    """Pieces of each request in order of blocks: where the content is (data, delta, zero, missing), or hole where nothing
    was written."""
    spans = runs.select("volume_id", F.col("start_lba").alias("run_start"), (F.col("start_lba") + F.col("lba_length")).alias("run_end"), "hash")
    hit = range_join(requests, spans, ["volume_id"], ("start_lba", "end_lba"), ("run_start", "run_end"))
    pieces = hit.select("request_id", "volume_id", "lo", "hi", "hash")
    holes = complement(pieces, requests, "request_id", ("start_lba", "end_lba"))
    where = extents.select("volume_id", "hash", F.col("segment_id").alias("body_segment"))
    other = deltas.select("volume_id", "hash", F.col("segment_id").alias("delta_segment"))
    found = pieces.join(where, ["volume_id", "hash"], "left").join(other, ["volume_id", "hash"], "left")
    source = F.when(F.col("hash") == ZERO_HASH, "zero").when(F.col("body_segment").isNotNull(), "data").when(F.col("delta_segment").isNotNull(), "delta").otherwise("missing")
    segment = F.when(F.col("hash") != ZERO_HASH, F.coalesce("body_segment", "delta_segment"))
    filled = holes.select("request_id", F.col("lo").alias("start_lba"), F.col("hi").alias("end_lba"), F.lit("hole").alias("source"), F.lit(None).cast("long").alias("segment_id"))
    return found.select("request_id", F.col("lo").alias("start_lba"), F.col("hi").alias("end_lba"), source.alias("source"), segment.alias("segment_id")).unionByName(filled)


def lookup(points: DataFrame, runs: DataFrame, at: str) -> DataFrame:
    """points with the hash, block offset and claimant at their block; null where nothing was written."""
    spans = runs.select("volume_id", F.col("start_lba").alias("run_start"), (F.col("start_lba") + F.col("lba_length")).alias("run_end"), "hash", "payload_block_offset", "claimant")
    found = point_join(points, spans, ["volume_id"], at, ("run_start", "run_end"), "left")
    return found.withColumn("block_offset", F.col("payload_block_offset") + F.col(at) - F.col("run_start")).drop("run_start", "run_end", "payload_block_offset")


def live_hashes(runs: DataFrame, entries: DataFrame) -> DataFrame:
    """Mapped hashes and the sources of mapped deltas, without the zero hash: volume_id, hash."""
    mapped = runs.select("volume_id", "hash")
    sources = runs.join(entries.where("kind = 'delta'").select("entry_key", "source_hash"), "entry_key").select("volume_id", F.col("source_hash").alias("hash"))
    return mapped.unionByName(sources).where((F.col("hash") != ZERO_HASH) & F.col("hash").isNotNull()).distinct()


def classify(entries: DataFrame, runs: DataFrame, extents: DataFrame, live: DataFrame) -> DataFrame:
    """Each entry with total, matching and zero blocks, n_runs, is_owner, is_live and its outcome.

    Matching blocks are those of the entry's hash that the map shows at the entry's own place; another copy of the content
    at another place doesn't count.
    """
    spans = runs.select("volume_id", F.col("start_lba").alias("run_start"), (F.col("start_lba") + F.col("lba_length")).alias("run_end"), F.col("hash").alias("run_hash"), "payload_block_offset")
    asked = entries.select("volume_id", "entry_key", "hash", F.col("start_lba").alias("first"), (F.col("start_lba") + F.col("lba_length")).alias("last"))
    met = range_join(asked, spans, ["volume_id"], ("first", "last"), ("run_start", "run_end"))
    offset = F.col("payload_block_offset") + F.col("lo") - F.col("run_start")
    same = (F.col("run_hash") == F.col("hash")) & (F.col("lo") - F.col("first") == offset)
    blocks = F.col("hi") - F.col("lo")
    counts = met.groupBy("entry_key").agg(F.sum(F.when(same, blocks).otherwise(0)).alias("matching"), F.sum(same.cast("long")).alias("n_runs"), F.sum(F.when(F.col("run_hash") == ZERO_HASH, blocks).otherwise(0)).alias("zero_blocks"))
    owners = extents.select("volume_id", "hash", F.col("segment_id").alias("owner_segment"))
    known = live.withColumn("is_live", F.lit(True))
    resolved = extents.select("volume_id", F.col("hash").alias("source_hash"), F.lit(True).alias("source_known"))
    rows = entries.join(counts, "entry_key", "left").join(owners, ["volume_id", "hash"], "left").join(known, ["volume_id", "hash"], "left").join(resolved, ["volume_id", "source_hash"], "left")
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("matching", "n_runs", "zero_blocks")})
    rows = rows.withColumns({"is_live": F.coalesce("is_live", F.lit(False)), "is_owner": F.coalesce(F.col("owner_segment") == F.col("segment_id"), F.lit(False))})
    kind, matching = F.col("kind"), F.col("matching")
    outcome = (
        F.when(kind == "zero", F.when(F.col("zero_blocks") > 0, "zero_sub_runs").otherwise("drop"))
        .when(kind.isin(*CANONICAL_KINDS) | (matching == F.col("lba_length")), "fully_live")
        .when((matching == 0) & kind.isin("data", "inline", "delta") & F.col("is_owner") & F.col("is_live"), "demote_to_canonical")
        .when((matching == 0) & F.col("is_owner"), "drop_and_remove_hash")
        .when(matching == 0, "drop")
        .when(kind.isin("data", "inline"), F.when(F.col("is_live"), "partial_with_canonical").otherwise("partial"))
        .when(kind == "dedup_ref", "partial")
        .when(F.col("source_known"), F.when(F.col("is_live"), "partial_with_canonical").otherwise("partial"))
        .otherwise("defer_unresolvable_delta")
    )
    return rows.withColumn("outcome", outcome)


def segment_density(classified: DataFrame) -> DataFrame:
    """Live and total mapped bytes of each segment, dead bytes, density (0 for no bytes), and estimated output entries."""
    live = F.when(F.col("kind") == "zero", F.col("zero_blocks")).when(F.col("kind").isin(*CANONICAL_KINDS), 0).otherwise(F.col("matching"))
    drops = F.col("outcome").isin("drop", "drop_and_remove_hash")
    partial = F.col("outcome").isin("partial", "partial_with_canonical")
    rows = classified.groupBy("volume_id", "segment_id", "tier").agg(
        (F.sum(live) * BLOCK_BYTES).alias("live_bytes"),
        (F.sum("lba_length") * BLOCK_BYTES).alias("total_bytes"),
        F.sum((~drops).cast("long")).alias("kept_entries"),
        F.sum((F.col("outcome") == "drop_and_remove_hash").cast("long")).alias("removed_hashes"),
        F.sum((F.col("outcome") == "defer_unresolvable_delta").cast("long")).alias("deferred"),
        F.sum(F.when(drops, 0).when(partial, F.col("n_runs") + 1).otherwise(1)).alias("output_entries"),
        F.sum((~drops & F.col("kind").isin(*BODY_KINDS)).cast("long")).alias("data_entries"),
    )
    return rows.withColumns({"dead_bytes": F.greatest(F.col("total_bytes") - F.col("live_bytes"), F.lit(0)), "density": F.when(F.col("total_bytes") > 0, F.col("live_bytes") / F.col("total_bytes")).otherwise(0.0)})


def gc_eligible(density: DataFrame, floor: DataFrame) -> DataFrame:
    """Committed segments above the volume's latest snapshot that nothing defers, and the class that makes them eligible."""
    rows = density.where("tier IN ('index', 'gc') AND deferred = 0").join(floor.groupBy("volume_id").agg(F.max("snap_id").alias("snap")), "volume_id", "left")
    rows = rows.where("snap IS NULL OR segment_id > snap").drop("snap")
    reason = (
        F.when((F.col("kept_entries") == 0) & (F.col("removed_hashes") == 0), "tombstone")
        .when(F.col("live_bytes") <= SMALL_BYTES, "small")
        .when((F.col("density") < DENSITY) & (F.col("dead_bytes") > 0) & (F.col("data_entries") > 0), "sparse")
    )
    return rows.withColumn("class", reason).where("class IS NOT NULL")


def gc_buckets(eligible: DataFrame, most: int = MOST_BUCKETS) -> DataFrame:
    """volume_id, segment_id, bucket: first-fit-decreasing under the byte and entry caps, a volume at a time.

    The fold is sequential for a volume by its meaning; it reads one narrow row for each eligible segment. Tombstones join
    bucket 0; a bucket of one dense segment is left out.
    """

    def pack(rows):
        rows = rows.sort_values("segment_id")
        dead, rest = rows[rows["class"] == "tombstone"], rows[rows["class"] != "tombstone"].sort_values(["live_bytes", "segment_id"], ascending=[False, True])
        room, out = [], []
        for r in rest.itertuples():
            at = next((i for i, (b, e, _) in enumerate(room) if r.live_bytes <= b and r.output_entries <= e), None)
            if at is None and len(room) < most:
                at = len(room)
                room.append([LIVE_CAP, ENTRY_CAP, []])
            if at is not None:
                b, e, own = room[at]
                room[at][:2] = max(0, b - r.live_bytes), max(0, e - r.output_entries)
                own.append(r)
        if len(dead):
            if not room:
                room.append([LIVE_CAP, ENTRY_CAP, []])
            room[0][2].extend(dead.itertuples())
        for _, _, own in room:
            if len(own) > 1 or any(r.density < DENSITY for r in own) or any(r.kept_entries + r.removed_hashes == 0 for r in own):
                out.append(own)
        return pd.DataFrame([(rows["volume_id"].iloc[0], r.segment_id, i) for i, own in enumerate(out) for r in own], columns=["volume_id", "segment_id", "bucket"])

    narrow = eligible.select("volume_id", "segment_id", "class", "live_bytes", "density", "kept_entries", "removed_hashes", "output_entries")
    return narrow.groupBy("volume_id").applyInPandas(pack, "volume_id string, segment_id long, bucket int")


def plan_rows(classified: DataFrame, eligible: DataFrame, runs: DataFrame) -> DataFrame:
    """Rewrite plan of the eligible segments: op keep, zero_split, canonical, run or drop, with place and length, by entry
    and ord: the place of an op among its entry's, whole bodies first, then pieces by place."""
    rows = classified.join(eligible.select("volume_id", "segment_id"), ["volume_id", "segment_id"], "left_semi")
    spans = runs.select("volume_id", F.col("start_lba").alias("run_start"), (F.col("start_lba") + F.col("lba_length")).alias("run_end"), F.col("hash").alias("run_hash"), "payload_block_offset")
    asked = rows.where("outcome LIKE 'partial%' OR outcome = 'zero_sub_runs'").select("volume_id", "entry_key", "hash", "kind", "start_lba", F.col("start_lba").alias("first"), (F.col("start_lba") + F.col("lba_length")).alias("last"))
    met = range_join(asked, spans, ["volume_id"], ("first", "last"), ("run_start", "run_end"))
    offset = F.col("lo") - F.col("first")
    fits = F.when(F.col("kind") == "zero", F.col("run_hash") == ZERO_HASH).otherwise((F.col("run_hash") == F.col("hash")) & (F.col("payload_block_offset") + F.col("lo") - F.col("run_start") == offset))
    pieces = met.where(fits).select("entry_key", F.when(F.col("kind") == "zero", "zero_split").otherwise("run").alias("op"), F.col("lo").alias("start_lba"), (F.col("hi") - F.col("lo")).alias("lba_length"), F.when(F.col("kind") == "zero", None).otherwise(offset).alias("payload_block_offset"))
    whole = rows.select("entry_key", F.when(F.col("outcome") == "fully_live", "keep").when(F.col("outcome").isin("demote_to_canonical", "partial_with_canonical"), "canonical").when(F.col("outcome").isin("drop", "drop_and_remove_hash"), "drop").alias("op"), F.when(F.col("outcome") == "fully_live", F.col("start_lba")).alias("start_lba"), F.when(F.col("outcome") == "fully_live", F.col("lba_length")).alias("lba_length"), F.lit(None).cast("long").alias("payload_block_offset")).where("op IS NOT NULL")
    every = whole.unionByName(pieces)
    order = Window.partitionBy("entry_key").orderBy(F.col("op").isin("run", "zero_split"), "start_lba")
    return every.withColumn("ord", F.row_number().over(order) - 1)


def snapshot_live_segments(entries: DataFrame, runs: DataFrame, extents: DataFrame) -> DataFrame:
    """Segments that a snapshot must list: those with an entry whose content is mapped and, for bodies, that own it."""
    mapped = runs.select("volume_id", "hash").distinct()
    rows = entries.where(F.col("kind") != "zero").join(mapped, ["volume_id", "hash"], "left_semi")
    owners = extents.select("volume_id", "hash", F.col("entry_key").alias("owner"))
    rows = rows.join(owners, ["volume_id", "hash"], "left").where(~F.col("kind").isin(*BODY_KINDS) | (F.col("owner") == F.col("entry_key")))
    zeros = entries.where("kind = 'zero'").join(runs.select("entry_key"), "entry_key", "left_semi")
    return rows.select("volume_id", "segment_id").unionByName(zeros.select("volume_id", "segment_id")).distinct()


def reclaim_candidates(runs: DataFrame, extents: DataFrame, deltas: DataFrame, dead_blocks: int = RECLAIM_DEAD_BLOCKS, dead_ratio: float = RECLAIM_DEAD_RATIO, stored_bytes: int = RECLAIM_STORED_BYTES) -> DataFrame:
    """Contents of which enough blocks are no longer mapped, with the range to rewrite. Inline bodies never qualify; of
    compressed bodies and deltas only the blocks up to the last mapped one are known, a lower bound."""
    agg = runs.where(F.col("hash") != ZERO_HASH).groupBy("volume_id", "hash").agg(F.min("start_lba").alias("start_lba"), F.max(F.col("start_lba") + F.col("lba_length")).alias("end_lba"), F.sum("lba_length").alias("live_blocks"), F.max(F.col("payload_block_offset") + F.col("lba_length")).alias("reach"))
    bodies = extents.select("volume_id", "hash", "kind", "compressed", "stored_length")
    rows = agg.join(bodies, ["volume_id", "hash"], "left").join(deltas.select("volume_id", "hash", F.lit(True).alias("is_delta")), ["volume_id", "hash"], "left")
    rows = rows.where("(kind IS NOT NULL AND kind NOT IN ('inline', 'canonical_inline')) OR (kind IS NULL AND is_delta)")
    exact = F.col("kind").isNotNull() & ~F.col("compressed")
    rows = rows.withColumns({"logical_blocks": F.when(exact, F.expr(f"stored_length div {BLOCK_BYTES}")).otherwise(F.col("reach")), "stored_bytes": F.coalesce(F.col("stored_length"), F.col("reach") * BLOCK_BYTES), "is_lower_bound": ~exact})
    rows = rows.withColumn("dead_blocks", F.col("logical_blocks") - F.col("live_blocks"))
    rows = rows.where((F.col("dead_blocks") >= dead_blocks) & (F.col("stored_bytes") >= stored_bytes) & (F.col("dead_blocks") / F.col("logical_blocks") >= dead_ratio))
    return rows.select("volume_id", "hash", "start_lba", (F.col("end_lba") - F.col("start_lba")).alias("lba_length"), "dead_blocks", "live_blocks", "stored_bytes", "is_lower_bound")


def integrity_violations(entries: DataFrame, runs: DataFrame, extents: DataFrame, deltas: DataFrame) -> DataFrame:
    """Number of violations by rule: mapped content without body or delta, pending segments not above committed ones,
    extents in unknown segments, negative or empty claims."""
    owned = extents.select("volume_id", "hash").unionByName(deltas.select("volume_id", "hash"))
    missing = runs.where(F.col("hash") != ZERO_HASH).join(owned, ["volume_id", "hash"], "left_anti").agg(F.count("*").alias("n"))
    edges = entries.groupBy("volume_id").agg(F.max(F.when(F.col("tier") != "pending", F.col("segment_id"))).alias("top"), F.min(F.when(F.col("tier") == "pending", F.col("segment_id"))).alias("low"))
    order = edges.where("top >= low").agg(F.count("*").alias("n"))
    lost = extents.join(entries.select("volume_id", "segment_id").distinct(), ["volume_id", "segment_id"], "left_anti").agg(F.count("*").alias("n"))
    bad = entries.where((F.col("start_lba") < 0) | (F.col("lba_length") < 0) | ((F.col("lba_length") == 0) & ~F.col("kind").isin(*CANONICAL_KINDS))).agg(F.count("*").alias("n"))
    named = [df.select(F.lit(rule).alias("rule"), "n") for rule, df in (("mapped_without_content", missing), ("pending_not_above_committed", order), ("extent_in_unknown_segment", lost), ("bad_claim", bad))]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df)
    return out
