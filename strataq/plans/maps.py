"""Queries over segment index entries: maps, extents, liveness, compaction; each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.operators import extentmap as X
from strataq.operators import lineage as L
from strataq.sources.fixtures import duck, fixture
from strataq.sources.stage import staged

VIS = "vis AS (SELECT *, (CASE tier WHEN 'wal' THEN 2 WHEN 'pending' THEN 1 ELSE 0 END) * 1000000000000 + segment_id * 1000000 + entry_idx AS pr FROM fx_entries e WHERE NOT (tier = 'index' AND EXISTS (SELECT 1 FROM fx_inputs i WHERE i.volume_id = e.volume_id AND i.input_id = e.segment_id)))"
BLOCKS = "won AS (SELECT volume_id, lba, arg_max(entry_key, pr) AS entry_key, arg_max(start_lba, pr) AS s0, arg_max(hash, pr) AS hash, arg_max(segment_id, pr) AS claimant FROM (SELECT *, unnest(range(start_lba, start_lba + lba_length)) AS lba FROM vis) GROUP BY volume_id, lba)"
MAP = "live AS (SELECT volume_id, min(lba) AS start_lba, count(*) AS lba_length, any_value(hash) AS hash, min(lba) - any_value(s0) AS payload_block_offset, any_value(claimant) AS claimant, entry_key FROM (SELECT *, lba - row_number() OVER (PARTITION BY volume_id, entry_key ORDER BY lba) AS g FROM won) GROUP BY volume_id, entry_key, g)"
BODY = "('data', 'inline', 'canonical_data', 'canonical_inline')"
EXT = f"ext AS (SELECT volume_id, hash, arg_min(segment_id, pr) AS segment_id, arg_min(entry_idx, pr) AS entry_idx, arg_min(kind, pr) AS kind, arg_min(stored_length, pr) AS stored_length, arg_min(compressed, pr) AS compressed, arg_min(entry_key, pr) AS entry_key FROM vis WHERE kind IN {BODY} GROUP BY volume_id, hash)"
DEL = "del AS (SELECT volume_id, hash, arg_min(segment_id, pr) AS segment_id, arg_min(entry_idx, pr) AS entry_idx, arg_min(source_hash, pr) AS source_hash FROM vis v WHERE kind = 'delta' AND NOT EXISTS (SELECT 1 FROM ext x WHERE x.volume_id = v.volume_id AND x.hash = v.hash) GROUP BY volume_id, hash)"
ZERO = "repeat('0', 32)"
LIVE = f"lh AS (SELECT DISTINCT volume_id, hash FROM (SELECT volume_id, hash FROM won UNION ALL SELECT w.volume_id, e.source_hash FROM won w JOIN vis e ON e.entry_key = w.entry_key WHERE e.kind = 'delta') WHERE hash <> {ZERO} AND hash IS NOT NULL)"
CLS = f"""cls AS (SELECT e.*, coalesce(m.matching, 0) AS matching, coalesce(m.zero_blocks, 0) AS zero_blocks, coalesce(r.n_runs, 0) AS n_runs, coalesce(x.segment_id = e.segment_id, false) AS is_owner, l.hash IS NOT NULL AS is_live, s.hash IS NOT NULL AS source_known FROM vis e
LEFT JOIN (SELECT b.entry_key, count(*) FILTER (WHERE w.hash = b.hash AND w.lba - w.s0 = b.lba - b.start_lba) AS matching, count(*) FILTER (WHERE w.hash = {ZERO}) AS zero_blocks FROM (SELECT entry_key, volume_id, hash, start_lba, unnest(range(start_lba, start_lba + lba_length)) AS lba FROM vis) b JOIN won w ON w.volume_id = b.volume_id AND w.lba = b.lba GROUP BY b.entry_key) m ON m.entry_key = e.entry_key
LEFT JOIN (SELECT e.entry_key, count(*) AS n_runs FROM vis e JOIN live r ON r.volume_id = e.volume_id AND r.start_lba < e.start_lba + e.lba_length AND r.start_lba + r.lba_length > e.start_lba AND r.hash = e.hash AND greatest(r.start_lba, e.start_lba) - e.start_lba = r.payload_block_offset + greatest(r.start_lba, e.start_lba) - r.start_lba GROUP BY e.entry_key) r ON r.entry_key = e.entry_key
LEFT JOIN ext x ON x.volume_id = e.volume_id AND x.hash = e.hash LEFT JOIN lh l ON l.volume_id = e.volume_id AND l.hash = e.hash LEFT JOIN ext s ON s.volume_id = e.volume_id AND s.hash = e.source_hash),
outc AS (SELECT *, CASE WHEN kind = 'zero' THEN CASE WHEN zero_blocks > 0 THEN 'zero_sub_runs' ELSE 'drop' END WHEN kind LIKE 'canonical%' OR matching = lba_length THEN 'fully_live' WHEN matching = 0 AND kind IN ('data', 'inline', 'delta') AND is_owner AND is_live THEN 'demote_to_canonical' WHEN matching = 0 AND is_owner THEN 'drop_and_remove_hash' WHEN matching = 0 THEN 'drop' WHEN kind IN ('data', 'inline') THEN CASE WHEN is_live THEN 'partial_with_canonical' ELSE 'partial' END WHEN kind = 'dedup_ref' THEN 'partial' WHEN source_known THEN CASE WHEN is_live THEN 'partial_with_canonical' ELSE 'partial' END ELSE 'defer_unresolvable_delta' END AS outcome FROM cls)"""
DENS = "dens AS (SELECT *, greatest(total_bytes - live_bytes, 0) AS dead_bytes, CASE WHEN total_bytes > 0 THEN CAST(live_bytes AS DOUBLE) / total_bytes ELSE 0.0 END AS density FROM (SELECT volume_id, segment_id, tier, CAST(sum(CASE WHEN kind = 'zero' THEN zero_blocks WHEN kind LIKE 'canonical%' THEN 0 ELSE matching END) * 4096 AS BIGINT) AS live_bytes, CAST(sum(lba_length) * 4096 AS BIGINT) AS total_bytes, count(*) FILTER (WHERE outcome NOT LIKE 'drop%') AS kept_entries, count(*) FILTER (WHERE outcome = 'drop_and_remove_hash') AS removed_hashes, count(*) FILTER (WHERE outcome = 'defer_unresolvable_delta') AS deferred, CAST(sum(CASE WHEN outcome LIKE 'drop%' THEN 0 WHEN outcome LIKE 'partial%' THEN n_runs + 1 ELSE 1 END) AS BIGINT) AS output_entries, count(*) FILTER (WHERE outcome NOT LIKE 'drop%' AND kind IN " + BODY + ") AS data_entries FROM outc GROUP BY volume_id, segment_id, tier))"
ELIG = "elig AS (SELECT * FROM (SELECT d.*, CASE WHEN kept_entries = 0 AND removed_hashes = 0 THEN 'tombstone' WHEN live_bytes <= 16777216 THEN 'small' WHEN density < 0.7 AND dead_bytes > 0 AND data_entries > 0 THEN 'sparse' END AS class FROM dens d LEFT JOIN (SELECT volume_id, max(snap_id) AS snap FROM fx_snapshots GROUP BY volume_id) s USING (volume_id) WHERE tier IN ('index', 'gc') AND deferred = 0 AND (snap IS NULL OR segment_id > snap)) WHERE class IS NOT NULL)"
CORE = (VIS, BLOCKS, MAP, EXT, DEL, LIVE)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *parts: str):
    """Registers a function as the query of its name, with its DuckDB twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = duck(sql, *parts)
        return f

    return add


def visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.visible(fixture(spark, sf_dir, "fx_entries"), fixture(spark, sf_dir, "fx_inputs"))


def _core(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Visible entries, the live map, bodies and deltas. The first three are staged, as each is read several times."""
    rows = staged(visible(spark, sf_dir), "entries")
    extents = staged(X.canonical_extents(rows), "extents")
    return rows, staged(X.live_map(rows), "runs"), extents, X.delta_extents(rows, extents)


def _classified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, runs, extents, _ = _core(spark, sf_dir)
    return staged(X.classify(rows, runs, extents, X.live_hashes(runs, rows)), "classified"), runs


@query("SELECT * FROM live", VIS, BLOCKS, MAP)
def live_map(spark, sf_dir):
    return X.live_map(visible(spark, sf_dir))


SNAP = "snapped AS (SELECT s.snap_id, e.*, (CASE tier WHEN 'pending' THEN 1 ELSE 0 END) * 1000000000000 + segment_id * 1000000 + entry_idx AS pr FROM fx_entries e JOIN fx_snapshots s ON s.volume_id = e.volume_id AND e.segment_id <= s.snap_id WHERE NOT (tier = 'index' AND EXISTS (SELECT 1 FROM fx_inputs i WHERE i.volume_id = e.volume_id AND i.input_id = e.segment_id AND i.output_id <= s.snap_id)))"
SNAPMAP = "SELECT volume_id, snap_id, min(lba) AS start_lba, count(*) AS lba_length, any_value(hash) AS hash, min(lba) - any_value(s0) AS payload_block_offset, any_value(claimant) AS claimant, entry_key FROM (SELECT *, lba - row_number() OVER (PARTITION BY volume_id, snap_id, entry_key ORDER BY lba) AS g FROM (SELECT volume_id, snap_id, lba, arg_max(entry_key, pr) AS entry_key, arg_max(start_lba, pr) AS s0, arg_max(hash, pr) AS hash, arg_max(segment_id, pr) AS claimant FROM (SELECT *, unnest(range(start_lba, start_lba + lba_length)) AS lba FROM snapped) GROUP BY ALL)) GROUP BY volume_id, snap_id, entry_key, g"


def _at_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, snaps = fixture(spark, sf_dir, "fx_entries"), fixture(spark, sf_dir, "fx_snapshots").distinct()
    rows = entries.join(snaps, "volume_id").where("segment_id <= snap_id")
    inputs = fixture(spark, sf_dir, "fx_inputs").join(snaps, "volume_id").where("output_id <= snap_id")
    hidden = inputs.select("volume_id", "snap_id", F.col("input_id").alias("segment_id"), F.lit("index").alias("tier")).distinct()
    return X.live_map(rows.join(hidden, ["volume_id", "snap_id", "segment_id", "tier"], "left_anti"), ["volume_id", "snap_id"])


@query(SNAPMAP, SNAP)
def live_map_at_snapshot(spark, sf_dir):
    return _at_snapshots(spark, sf_dir)


@query(f"SELECT volume_id, snap_id, sha256(string_agg(hash, ',' ORDER BY start_lba)) AS content_id FROM ({SNAPMAP}) GROUP BY volume_id, snap_id", SNAP)
def snapshot_content_id(spark, sf_dir):
    runs = _at_snapshots(spark, sf_dir)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("start_lba", "hash"))), lambda x: x["hash"])
    return runs.groupBy("volume_id", "snap_id").agg(F.sha2(F.array_join(listed, ","), 256).alias("content_id"))


LAYERS = "/*recursive*/ anc AS (SELECT child_id AS volume_id, child_id AS layer, CAST(9223372036854775807 AS BIGINT) AS cutoff, 0 AS depth FROM (SELECT child_id FROM fx_lineage UNION SELECT parent_id FROM fx_lineage) UNION ALL SELECT a.volume_id, l.parent_id, l.branch_id, a.depth + 1 FROM anc a JOIN fx_lineage l ON l.child_id = a.layer)"


@query("SELECT volume_id, layer AS layer_volume_id, CAST(depth AS INT) AS depth, cutoff FROM anc", LAYERS)
def fork_layers(spark, sf_dir):
    lineage = fixture(spark, sf_dir, "fx_lineage")
    return L.layers(lineage).select("volume_id", "layer_volume_id", "depth", "cutoff")


@query("SELECT volume_id, min(lba) AS start_lba, count(*) AS lba_length, any_value(hash) AS hash, min(lba) - any_value(s0) AS payload_block_offset, any_value(claimant) AS claimant, entry_key FROM (SELECT *, lba - row_number() OVER (PARTITION BY volume_id, entry_key ORDER BY lba) AS g FROM (SELECT volume_id, lba, arg_max(entry_key, p) AS entry_key, arg_max(start_lba, p) AS s0, arg_max(hash, p) AS hash, arg_max(segment_id, p) AS claimant FROM (SELECT a.volume_id, v.entry_key, v.start_lba, v.hash, v.segment_id, v.pr - a.depth * 10000000000000 AS p, unnest(range(v.start_lba, v.start_lba + v.lba_length)) AS lba FROM anc a JOIN vis v ON v.volume_id = a.layer AND v.segment_id <= a.cutoff) GROUP BY ALL)) GROUP BY volume_id, entry_key, g", LAYERS, VIS)
def forked_live_map(spark, sf_dir):
    return L.forked_live_map(visible(spark, sf_dir), fixture(spark, sf_dir, "fx_lineage"))


@query("SELECT volume_id, string_agg(layer, ',' ORDER BY depth) AS ids, count(*) AS n FROM anc GROUP BY volume_id", LAYERS)
def lineage_ids(spark, sf_dir):
    found = L.layers(fixture(spark, sf_dir, "fx_lineage"))
    return found.groupBy("volume_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("depth", "layer_volume_id"))), lambda x: x["layer_volume_id"]), ",").alias("ids"), F.count("*").alias("n"))


@query("SELECT volume_id, hash, segment_id, entry_idx, kind FROM ext", VIS, EXT)
def canonical_extents(spark, sf_dir):
    return X.canonical_extents(visible(spark, sf_dir)).select("volume_id", "hash", "segment_id", "entry_idx", "kind")


@query("SELECT * FROM del", VIS, EXT, DEL)
def delta_extents(spark, sf_dir):
    rows = visible(spark, sf_dir)
    return X.delta_extents(rows, X.canonical_extents(rows))


@query(f"""SELECT request_id, min(lba) AS start_lba, max(lba) + 1 AS end_lba, any_value(source) AS source, any_value(segment_id) AS segment_id FROM (SELECT *, lba - row_number() OVER (PARTITION BY request_id, run ORDER BY lba) AS g FROM (SELECT q.request_id, q.lba, coalesce(w.entry_key, -1) AS run, CASE WHEN w.hash IS NULL THEN 'hole' WHEN w.hash = {ZERO} THEN 'zero' WHEN x.hash IS NOT NULL THEN 'data' WHEN d.hash IS NOT NULL THEN 'delta' ELSE 'missing' END AS source, CASE WHEN w.hash <> {ZERO} THEN coalesce(x.segment_id, d.segment_id) END AS segment_id FROM (SELECT *, unnest(range(start_lba, end_lba)) AS lba FROM fx_requests) q LEFT JOIN won w ON w.volume_id = q.volume_id AND w.lba = q.lba LEFT JOIN ext x ON x.volume_id = w.volume_id AND x.hash = w.hash LEFT JOIN del d ON d.volume_id = w.volume_id AND d.hash = w.hash)) GROUP BY request_id, run, g""", VIS, BLOCKS, EXT, DEL)
def resolve_reads(spark, sf_dir):
    rows, runs, extents, deltas = _core(spark, sf_dir)
    return X.resolve_reads(fixture(spark, sf_dir, "fx_requests"), runs, extents, deltas)


@query("SELECT q.request_id, q.volume_id, q.start_lba, q.end_lba, w.hash, w.claimant, w.lba - w.s0 AS block_offset FROM fx_requests q LEFT JOIN won w ON w.volume_id = q.volume_id AND w.lba = q.start_lba", VIS, BLOCKS)
def block_lookup(spark, sf_dir):
    return X.lookup(fixture(spark, sf_dir, "fx_requests"), X.live_map(visible(spark, sf_dir)), "start_lba")


@query(f"SELECT volume_id, hash, count(*) AS n_runs, CAST(sum(lba_length) AS BIGINT) AS n_blocks, min(start_lba) AS first_lba FROM live WHERE hash <> {ZERO} GROUP BY volume_id, hash", VIS, BLOCKS, MAP)
def hash_runs(spark, sf_dir):
    runs = X.live_map(visible(spark, sf_dir)).where(F.col("hash") != X.ZERO_HASH)
    return runs.groupBy("volume_id", "hash").agg(F.count("*").alias("n_runs"), F.sum("lba_length").alias("n_blocks"), F.min("start_lba").alias("first_lba"))


@query("SELECT volume_id, hash, count(*) AS n FROM lh GROUP BY ALL", VIS, BLOCKS, LIVE)
def live_hashes(spark, sf_dir):
    rows = visible(spark, sf_dir)
    return X.live_hashes(X.live_map(rows), rows).withColumn("n", F.lit(1).cast("long"))


@query("SELECT r.volume_id, e.source_hash AS hash, count(*) AS n FROM live r JOIN vis e ON e.entry_key = r.entry_key WHERE e.kind = 'delta' GROUP BY ALL", VIS, BLOCKS, MAP)
def delta_source_refcount(spark, sf_dir):
    rows = visible(spark, sf_dir)
    deltas = rows.where("kind = 'delta'").select("entry_key", F.col("source_hash").alias("hash"))
    return X.live_map(rows).drop("hash").join(deltas, "entry_key").groupBy("volume_id", "hash").agg(F.count("*").alias("n"))


@query("SELECT v.entry_key FROM vis v JOIN live r ON r.volume_id = v.volume_id AND r.start_lba = v.start_lba AND r.lba_length = v.lba_length AND r.hash = v.hash AND r.payload_block_offset = 0", VIS, BLOCKS, MAP)
def exact_matches(spark, sf_dir):
    rows = visible(spark, sf_dir)
    runs = X.live_map(rows).where("payload_block_offset = 0").select("volume_id", "start_lba", "lba_length", "hash")
    return rows.join(runs, ["volume_id", "start_lba", "lba_length", "hash"]).select("entry_key")


@query("SELECT entry_key, volume_id, segment_id, kind, outcome, matching, zero_blocks, n_runs FROM outc", *CORE, CLS)
def classify_entries(spark, sf_dir):
    return _classified(spark, sf_dir)[0].select("entry_key", "volume_id", "segment_id", "kind", "outcome", "matching", "zero_blocks", "n_runs")


@query("SELECT * FROM dens", *CORE, CLS, DENS)
def segment_density(spark, sf_dir):
    return X.segment_density(_classified(spark, sf_dir)[0])


@query("SELECT volume_id, segment_id, class, live_bytes, dead_bytes, density FROM elig", *CORE, CLS, DENS, ELIG)
def gc_eligible(spark, sf_dir):
    return X.gc_eligible(X.segment_density(_classified(spark, sf_dir)[0]), fixture(spark, sf_dir, "fx_snapshots")).select("volume_id", "segment_id", "class", "live_bytes", "dead_bytes", "density")


@query()
def gc_buckets(spark, sf_dir):
    return X.gc_buckets(X.gc_eligible(X.segment_density(_classified(spark, sf_dir)[0]), fixture(spark, sf_dir, "fx_snapshots")))


GC_PLAN_SQL = f"""SELECT *, row_number() OVER (PARTITION BY entry_key ORDER BY CASE WHEN op IN ('run', 'zero_split') THEN 1 ELSE 0 END, start_lba) - 1 AS ord FROM (SELECT entry_key, CASE WHEN outcome = 'fully_live' THEN 'keep' WHEN outcome IN ('demote_to_canonical', 'partial_with_canonical') THEN 'canonical' ELSE 'drop' END AS op, CASE WHEN outcome = 'fully_live' THEN start_lba END AS start_lba, CASE WHEN outcome = 'fully_live' THEN lba_length END AS lba_length, CAST(NULL AS BIGINT) AS payload_block_offset FROM outc SEMI JOIN elig USING (volume_id, segment_id) WHERE outcome IN ('fully_live', 'demote_to_canonical', 'partial_with_canonical', 'drop', 'drop_and_remove_hash')
UNION ALL SELECT o.entry_key, CASE WHEN o.kind = 'zero' THEN 'zero_split' ELSE 'run' END, greatest(r.start_lba, o.start_lba), least(r.start_lba + r.lba_length, o.start_lba + o.lba_length) - greatest(r.start_lba, o.start_lba), CASE WHEN o.kind <> 'zero' THEN greatest(r.start_lba, o.start_lba) - o.start_lba END FROM outc o SEMI JOIN elig USING (volume_id, segment_id) JOIN live r ON r.volume_id = o.volume_id AND r.start_lba < o.start_lba + o.lba_length AND r.start_lba + r.lba_length > o.start_lba WHERE (o.outcome LIKE 'partial%' OR o.outcome = 'zero_sub_runs') AND CASE WHEN o.kind = 'zero' THEN r.hash = {ZERO} ELSE r.hash = o.hash AND r.payload_block_offset - r.start_lba = -o.start_lba END)"""


@query(GC_PLAN_SQL, *CORE, CLS, DENS, ELIG)
def gc_plan_rows(spark, sf_dir):
    classified, runs = _classified(spark, sf_dir)
    eligible = X.gc_eligible(X.segment_density(classified), fixture(spark, sf_dir, "fx_snapshots"))
    return X.plan_rows(classified, eligible, runs)


@query("SELECT volume_id, array_to_string(list_sort(list(DISTINCT segment_id)), ',') AS inputs, count(DISTINCT segment_id) AS n FROM elig GROUP BY volume_id", *CORE, CLS, DENS, ELIG)
def gc_plan_inputs(spark, sf_dir):
    eligible = X.gc_eligible(X.segment_density(_classified(spark, sf_dir)[0]), fixture(spark, sf_dir, "fx_snapshots"))
    return eligible.groupBy("volume_id").agg(F.array_join(F.array_sort(F.collect_set("segment_id")), ",").alias("inputs"), F.countDistinct("segment_id").alias("n"))


@query("SELECT volume_id, count(*) AS segments, CAST(sum(live_bytes) AS BIGINT) AS live_bytes, CAST(sum(dead_bytes) AS BIGINT) AS bytes_freed, count(*) FILTER (WHERE class = 'tombstone') AS dead_cleaned, CAST(sum(output_entries) AS BIGINT) AS output_entries FROM elig GROUP BY volume_id", *CORE, CLS, DENS, ELIG)
def gc_pass_summary(spark, sf_dir):
    eligible = X.gc_eligible(X.segment_density(_classified(spark, sf_dir)[0]), fixture(spark, sf_dir, "fx_snapshots"))
    return eligible.groupBy("volume_id").agg(F.count("*").alias("segments"), F.sum("live_bytes").alias("live_bytes"), F.sum("dead_bytes").alias("bytes_freed"), F.count_if(F.col("class") == "tombstone").alias("dead_cleaned"), F.sum("output_entries").alias("output_entries"))


@query("SELECT DISTINCT volume_id, segment_id FROM (SELECT v.volume_id, v.segment_id FROM vis v SEMI JOIN won w USING (volume_id, hash) LEFT JOIN ext x ON x.volume_id = v.volume_id AND x.hash = v.hash WHERE v.kind <> 'zero' AND (v.kind NOT IN " + BODY + " OR x.entry_key = v.entry_key) UNION ALL SELECT v.volume_id, v.segment_id FROM vis v SEMI JOIN won w USING (entry_key) WHERE v.kind = 'zero')", VIS, BLOCKS, EXT)
def snapshot_live_segments(spark, sf_dir):
    rows, runs, extents, _ = _core(spark, sf_dir)
    return X.snapshot_live_segments(rows, runs, extents)


RECLAIM_SQL = "SELECT volume_id, hash, start_lba, end_lba - start_lba AS lba_length, dead_blocks, live_blocks, stored AS stored_bytes, NOT exact AS is_lower_bound FROM (SELECT *, logical - live_blocks AS dead_blocks FROM (SELECT a.*, x.kind IS NOT NULL AND NOT x.compressed AS exact, CASE WHEN x.kind IS NOT NULL AND NOT x.compressed THEN x.stored_length // 4096 ELSE reach END AS logical, coalesce(x.stored_length, reach * 4096) AS stored FROM (SELECT volume_id, hash, min(start_lba) AS start_lba, max(start_lba + lba_length) AS end_lba, CAST(sum(lba_length) AS BIGINT) AS live_blocks, max(payload_block_offset + lba_length) AS reach FROM live WHERE hash <> " + ZERO + " GROUP BY ALL) a LEFT JOIN ext x USING (volume_id, hash) LEFT JOIN del d USING (volume_id, hash) WHERE (x.kind IS NOT NULL AND x.kind NOT LIKE '%inline') OR (x.kind IS NULL AND d.hash IS NOT NULL))) WHERE dead_blocks >= 1 AND stored >= 4096 AND CAST(dead_blocks AS DOUBLE) / logical >= 0.1"


@query(RECLAIM_SQL, VIS, BLOCKS, MAP, EXT, DEL)
def reclaim_candidates(spark, sf_dir):
    _, runs, extents, deltas = _core(spark, sf_dir)
    return X.reclaim_candidates(runs, extents, deltas, dead_blocks=1, dead_ratio=0.1, stored_bytes=4096)


@query("SELECT 'mapped_without_content' AS rule, count(*) AS n FROM live r WHERE hash <> " + ZERO + " AND NOT EXISTS (SELECT 1 FROM ext x WHERE x.volume_id = r.volume_id AND x.hash = r.hash) AND NOT EXISTS (SELECT 1 FROM del x WHERE x.volume_id = r.volume_id AND x.hash = r.hash) UNION ALL SELECT 'pending_not_above_committed', count(*) FROM (SELECT volume_id FROM vis GROUP BY volume_id HAVING max(segment_id) FILTER (WHERE tier <> 'pending') >= min(segment_id) FILTER (WHERE tier = 'pending')) UNION ALL SELECT 'extent_in_unknown_segment', count(*) FROM ext x WHERE NOT EXISTS (SELECT 1 FROM vis v WHERE v.volume_id = x.volume_id AND v.segment_id = x.segment_id) UNION ALL SELECT 'bad_claim', count(*) FROM vis WHERE start_lba < 0 OR lba_length < 0 OR (lba_length = 0 AND kind NOT LIKE 'canonical%')", VIS, BLOCKS, MAP, EXT, DEL)
def integrity_violations(spark, sf_dir):
    return X.integrity_violations(*_core(spark, sf_dir))


HEADS = "base AS (SELECT DISTINCT volume_id, segment_id FROM fx_head WHERE section IN ('manifest', 'added'))"


@query("SELECT volume_id, segment_id FROM base EXCEPT SELECT volume_id, segment_id FROM fx_head WHERE section IN ('superseded', 'tombstoned')", HEADS)
def live_set(spark, sf_dir):
    return L.live_set(fixture(spark, sf_dir, "fx_head"))


@query("SELECT DISTINCT volume_id, segment_id FROM fx_head WHERE section = 'superseded' AND age_s >= 600")
def reap_due(spark, sf_dir):
    return L.reap_due(fixture(spark, sf_dir, "fx_head"))


@query("SELECT h.volume_id, h.segment_id, h.section, h.age_s FROM fx_head h WHERE NOT EXISTS (SELECT 1 FROM fx_head d WHERE d.section = 'superseded' AND d.age_s >= 600 AND d.volume_id = h.volume_id AND d.segment_id = h.segment_id)")
def head_after_reap(spark, sf_dir):
    return L.head_after_reap(fixture(spark, sf_dir, "fx_head"))


@query("SELECT volume_id, string_agg(section || ':' || line, ';' ORDER BY section, line) AS head FROM (SELECT volume_id, section, string_agg(CAST(segment_id AS VARCHAR), ',' ORDER BY segment_id) AS line FROM fx_head GROUP BY volume_id, section) GROUP BY volume_id")
def head_render(spark, sf_dir):
    return L.head_render(fixture(spark, sf_dir, "fx_head"))


@query("SELECT volume_id, max(snap_id) AS snap_id, count(DISTINCT snap_id) AS n_snapshots FROM fx_snapshots GROUP BY volume_id")
def latest_snapshot(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_snapshots").groupBy("volume_id").agg(F.max("snap_id").alias("snap_id"), F.countDistinct("snap_id").alias("n_snapshots"))


@query("SELECT s.volume_id, s.snap_id, array_to_string(list_sort(list(DISTINCT e.segment_id)), ',') AS segments, count(DISTINCT e.segment_id) AS n FROM fx_snapshots s JOIN fx_entries e ON e.volume_id = s.volume_id AND e.segment_id <= s.snap_id GROUP BY s.volume_id, s.snap_id")
def snapshot_manifest(spark, sf_dir):
    segments = fixture(spark, sf_dir, "fx_entries").select("volume_id", "segment_id").distinct()
    rows = fixture(spark, sf_dir, "fx_snapshots").join(segments, "volume_id").where("segment_id <= snap_id")
    return rows.groupBy("volume_id", "snap_id").agg(F.array_join(F.array_sort(F.collect_set("segment_id")), ",").alias("segments"), F.countDistinct("segment_id").alias("n"))
