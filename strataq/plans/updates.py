"""Queries of conditional updates, rewrites and what becomes of them; each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataq.operators import extentmap as X
from strataq.operators import rewrites as R
from strataq.operators import updates as U
from strataq.plans import maps as M
from strataq.plans.maps import BLOCKS, CLS, CORE, DEL, DENS, ELIG, EXT, LIVE, MAP, VIS, ZERO, visible
from strataq.plans.more import OFFS, _offsets
from strataq.sources.fixtures import duck, fixture
from strataq.sources.stage import staged

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *parts: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = duck(sql, *parts)
        return f

    return add


# The map of committed segments, and pending entries that are put on it with claimants of their own.
CVIS = "cvis AS (SELECT * FROM vis WHERE tier <> 'pending')"
CBLOCKS = BLOCKS.replace("won AS", "cwon AS").replace("FROM vis", "FROM cvis")
CMAP = MAP.replace("live AS", "clive AS").replace("FROM won", "FROM cwon")
INS = "ins AS (SELECT volume_id, entry_key, start_lba, lba_length, hash, segment_id - 60 * (entry_key % 3) AS claimant, segment_id * 1000000 + entry_idx AS ord, source_hash FROM vis WHERE tier = 'pending' AND lba_length > 0)"
GONE = "gone AS (SELECT DISTINCT volume_id, segment_id FROM cvis WHERE segment_id % 10 = 3)"


def _put(rank: str) -> str:
    return f"""SELECT volume_id, min(lba) AS start_lba, count(*) AS lba_length, any_value(hash) AS hash, any_value(claimant) AS claimant, any_value(source_hash) AS source_hash, min(lba) - any_value(s0) + any_value(base) AS payload_block_offset, any_value(piece LIKE 'new%') AS is_new
FROM (SELECT *, lba - row_number() OVER (PARTITION BY volume_id, piece ORDER BY lba) AS g FROM (SELECT volume_id, lba, arg_max(piece, p) AS piece, arg_max(s0, p) AS s0, arg_max(base, p) AS base, arg_max(hash, p) AS hash, arg_max(claimant, p) AS claimant, arg_max(struct_pack(s := source_hash), p).s AS source_hash
FROM (SELECT c.volume_id, unnest(range(c.start_lba, c.start_lba + c.lba_length)) AS lba, 'old/' || c.entry_key || '/' || c.start_lba AS piece, c.start_lba AS s0, payload_block_offset AS base, c.hash, claimant, {rank} * 1000000000000 + 1 AS p, e.source_hash FROM clive c JOIN cvis e ON e.entry_key = c.entry_key
UNION ALL SELECT volume_id, unnest(range(start_lba, start_lba + lba_length)), 'new/' || entry_key, start_lba, 0, hash, claimant, claimant * 1000000000000 - ord, source_hash FROM ins) GROUP BY volume_id, lba)) GROUP BY volume_id, piece, g"""


def _committed(spark, sf_dir):
    rows = visible(spark, sf_dir).where("tier <> 'pending'")
    return staged(X.live_map(rows).join(rows.select("entry_key", "source_hash"), "entry_key"), "runs"), rows


def _inserts(spark, sf_dir):
    rows = visible(spark, sf_dir).where("tier = 'pending' AND lba_length > 0")
    return rows.select("volume_id", "entry_key", "start_lba", "lba_length", "hash", (F.col("segment_id") - 60 * (F.col("entry_key") % 3)).alias("claimant"), (F.col("segment_id") * 1000000 + F.col("entry_idx")).alias("ord"), "source_hash")


@query(_put("claimant"), VIS, CVIS, CBLOCKS, CMAP, INS)
def map_insert_if_newer(spark, sf_dir):
    """Deltas bring their sources along."""
    return U.insert_if_newer(_committed(spark, sf_dir)[0], _inserts(spark, sf_dir))


@query(_put("CASE WHEN claimant % 10 = 3 THEN -1 ELSE claimant END"), VIS, CVIS, CBLOCKS, CMAP, INS)
def map_insert_consuming(spark, sf_dir):
    runs, rows = _committed(spark, sf_dir)
    return U.insert_if_newer(runs, _inserts(spark, sf_dir), rows.where("segment_id % 10 = 3").select("volume_id", "segment_id").distinct())


RAISE = "ups AS (SELECT volume_id, start_lba AS first, start_lba + lba_length + 2 AS last, hash, segment_id + 5 - 20 * (entry_key % 2) AS new_claimant FROM vis WHERE entry_key % 3 = 0 AND lba_length > 0)"


@query("SELECT r.volume_id, r.start_lba, r.hash, greatest(r.claimant, coalesce(u.n, r.claimant)) AS claimant, coalesce(u.n > r.claimant, false) AS raised FROM live r LEFT JOIN (SELECT r.entry_key, r.start_lba, max(new_claimant) AS n FROM live r JOIN ups u ON u.volume_id = r.volume_id AND u.hash = r.hash AND r.start_lba < u.last AND u.first < r.start_lba + r.lba_length GROUP BY ALL) u ON u.entry_key = r.entry_key AND u.start_lba = r.start_lba", VIS, BLOCKS, MAP, RAISE)
def map_raise_claimants(spark, sf_dir):
    rows = visible(spark, sf_dir)
    runs = X.live_map(rows).withColumn("run_id", F.concat_ws("/", "entry_key", "start_lba"))
    updates = rows.where("entry_key % 3 = 0 AND lba_length > 0").select("volume_id", F.col("start_lba").alias("first"), (F.col("start_lba") + F.col("lba_length") + 2).alias("last"), "hash", (F.col("segment_id") + 5 - 20 * (F.col("entry_key") % 2)).alias("new_claimant"))
    return U.raise_claimants(runs, updates).select("volume_id", "start_lba", "hash", "claimant", "raised")


@query("SELECT r.volume_id, r.start_lba, r.hash, coalesce(u.s, e.source_hash) AS source_hash, u.s IS NOT NULL AS replaced FROM live r JOIN vis e ON e.entry_key = r.entry_key LEFT JOIN (SELECT volume_id, start_lba, hash, arg_max(md5(hash), entry_key) AS s FROM vis WHERE entry_key % 2 = 0 GROUP BY ALL) u ON u.volume_id = r.volume_id AND u.start_lba = r.start_lba AND u.hash = r.hash", VIS, BLOCKS, MAP)
def map_replace_sources(spark, sf_dir):
    rows = visible(spark, sf_dir)
    runs = X.live_map(rows).join(rows.select("entry_key", "source_hash"), "entry_key")
    updates = rows.where("entry_key % 2 = 0").select("volume_id", "start_lba", "hash", F.md5(F.col("hash").cast("binary")).alias("source_hash"), F.col("entry_key").alias("ord"))
    return U.replace_sources(runs, updates).select("volume_id", "start_lba", "hash", "source_hash", "replaced")


# Locations of bodies, and updates of which a third expects another segment and a fifth another offset than stands there.
LOC = "loc AS (SELECT x.volume_id, x.hash, x.segment_id, o.stored_offset AS body_offset, o.stored_length AS body_length FROM ext x JOIN offs o ON o.entry_key = x.entry_key)"
CAS = "cas AS (SELECT volume_id, hash, segment_id + CASE WHEN body_length % 3 = 0 THEN 1 ELSE 0 END AS was_segment, body_offset + CASE WHEN segment_id % 5 = 0 THEN 8 ELSE 0 END AS was_offset, segment_id + 1000 AS to_segment, segment_id AS ord FROM loc)"


def _locations(spark, sf_dir):
    extents = X.canonical_extents(visible(spark, sf_dir)).select("volume_id", "hash", "segment_id", "entry_key")
    offsets = _offsets(spark, sf_dir).select("entry_key", F.col("stored_offset").alias("body_offset"), F.col("stored_length").alias("body_length"))
    table = extents.join(offsets, "entry_key").drop("entry_key")
    updates = table.select("volume_id", "hash", (F.col("segment_id") + F.when(F.col("body_length") % 3 == 0, 1).otherwise(0)).alias("was_segment"), (F.col("body_offset") + F.when(F.col("segment_id") % 5 == 0, 8).otherwise(0)).alias("was_offset"), (F.col("segment_id") + 1000).alias("to_segment"), F.col("segment_id").alias("ord"))
    return table, updates


@query("SELECT l.volume_id, l.hash, CASE WHEN h THEN to_segment ELSE segment_id END AS segment_id, CASE WHEN h THEN 0 ELSE body_offset END AS body_offset, body_length, h AS swapped FROM (SELECT l.*, c.to_segment, c.was_segment = l.segment_id AND c.was_offset = l.body_offset AS h FROM loc l JOIN cas c ON c.volume_id = l.volume_id AND c.hash = l.hash) l", VIS, EXT, OFFS, LOC, CAS)
def extent_replace_if_matches(spark, sf_dir):
    table, updates = _locations(spark, sf_dir)
    return U.swapped(table, updates, ["volume_id", "hash"], {"segment_id": "was_segment", "body_offset": "was_offset"}, {"segment_id": F.col("u.to_segment"), "body_offset": F.lit(0).cast("long")})


@query("SELECT l.* FROM loc l WHERE NOT EXISTS (SELECT 1 FROM cas c WHERE c.volume_id = l.volume_id AND c.hash = l.hash AND c.was_segment = l.segment_id AND c.was_offset = l.body_offset)", VIS, EXT, OFFS, LOC, CAS)
def extent_remove_if_matches(spark, sf_dir):
    table, updates = _locations(spark, sf_dir)
    return U.removed(table, updates.select("volume_id", "hash", F.col("was_segment").alias("segment_id"), F.col("was_offset").alias("body_offset")), ["volume_id", "hash", "segment_id", "body_offset"])


OWN = "own AS (SELECT 'body' AS owns, volume_id, hash, segment_id FROM ext UNION ALL SELECT 'delta', volume_id, hash, segment_id FROM del)"


@query("SELECT * FROM own", VIS, EXT, DEL, OWN)
def extent_owners(spark, sf_dir):
    """Owners of both tables alone: body or delta, hash and segment."""
    return R.owners(*M._core(spark, sf_dir)[2:])


@query("SELECT * FROM own WHERE segment_id % 4 <> 1", VIS, EXT, DEL, OWN)
def extent_remove_owner(spark, sf_dir):
    owners = R.owners(*M._core(spark, sf_dir)[2:])
    return U.removed(owners, owners.where("segment_id % 4 = 1"), ["volume_id", "hash", "segment_id"])


DLOC = "dloc AS (SELECT volume_id, hash, segment_id, CASE WHEN entry_idx % 2 = 0 THEN 'full' ELSE 'cached' END AS source, entry_idx * 10 AS section_start, 64 AS body_length FROM del)"


def _delta_locations(spark, sf_dir):
    rows = M._core(spark, sf_dir)[3]
    source = F.when(F.col("entry_idx") % 2 == 0, "full").otherwise("cached")
    table = rows.select("volume_id", "hash", "segment_id", source.alias("source"), (F.col("entry_idx") * 10).alias("section_start"), F.lit(64).alias("body_length"))
    return table, table.select("volume_id", "hash", (F.col("segment_id") + (F.col("segment_id") % 3 == 0).cast("long")).alias("was"), F.col("segment_id").alias("ord"))


@query("SELECT volume_id, hash, segment_id, CASE WHEN segment_id % 3 <> 0 THEN 'cached' ELSE source END AS source, section_start, body_length, segment_id % 3 <> 0 AS swapped FROM dloc", VIS, EXT, DEL, DLOC)
def delta_flip_to_cached(spark, sf_dir):
    table, updates = _delta_locations(spark, sf_dir)
    return U.swapped(table, updates, ["volume_id", "hash"], {"segment_id": "was"}, {"source": F.lit("cached")})


@query("SELECT volume_id, hash, CASE WHEN h THEN segment_id + 500 ELSE segment_id END AS segment_id, source, CASE WHEN h THEN 4096 ELSE section_start END AS section_start, CASE WHEN h THEN 128 ELSE body_length END AS body_length, h AS swapped FROM (SELECT *, segment_id % 3 <> 0 AND source = 'full' AS h FROM dloc)", VIS, EXT, DEL, DLOC)
def delta_migrate_full(spark, sf_dir):
    """Only locations in a full segment move."""
    table, updates = _delta_locations(spark, sf_dir)
    updates = updates.withColumn("kind", F.lit("full"))
    return U.swapped(table, updates, ["volume_id", "hash"], {"segment_id": "was", "source": "kind"}, {"segment_id": F.col("t.segment_id") + 500, "section_start": F.lit(4096).cast("long"), "body_length": F.lit(128)})


@query("SELECT volume_id, hash, min(lba) AS start_lba, max(lba) + 1 AS end_lba FROM (SELECT *, lba - row_number() OVER (PARTITION BY volume_id, hash ORDER BY lba) AS g FROM won) GROUP BY volume_id, hash, g", VIS, BLOCKS)
def value_runs(spark, sf_dir):
    return U.value_runs(X.live_map(visible(spark, sf_dir)))


@query("SELECT volume_id, row_number() OVER (PARTITION BY volume_id ORDER BY start_lba) - 1 AS position, start_lba, lba_length, hash FROM live", VIS, BLOCKS, MAP)
def map_listing(spark, sf_dir):
    return R.positions(X.live_map(visible(spark, sf_dir))).select("volume_id", "position", "start_lba", "lba_length", "hash")


WAL = "walv AS (SELECT * REPLACE (CASE WHEN entry_key % 50 = 7 THEN 'wal' ELSE tier END AS tier) FROM vis), walp AS (SELECT * REPLACE ((CASE tier WHEN 'wal' THEN 2 WHEN 'pending' THEN 1 ELSE 0 END) * 1000000000000 + segment_id * 1000000 + entry_idx AS pr) FROM walv)"


@query("SELECT * FROM live", VIS, WAL, BLOCKS.replace("FROM vis", "FROM walp"), MAP)
def live_map_with_log(spark, sf_dir):
    """Records of the write log lie above all segments."""
    rows = visible(spark, sf_dir)
    return X.live_map(rows.withColumn("tier", F.when(F.col("entry_key") % 50 == 7, "wal").otherwise(F.col("tier"))))


@query("SELECT 'stored_only' AS side, count(*) AS n FROM (SELECT volume_id, start_lba, lba_length, hash FROM live EXCEPT ALL SELECT volume_id, start_lba, lba_length, hash FROM clive) UNION ALL SELECT 'rebuilt_only', count(*) FROM (SELECT volume_id, start_lba, lba_length, hash FROM clive EXCEPT ALL SELECT volume_id, start_lba, lba_length, hash FROM live)", VIS, BLOCKS, MAP, CVIS, CBLOCKS, CMAP)
def map_consistency(spark, sf_dir):
    """The whole map against the one of committed segments, as a stored map against a rebuilt one."""
    return U.map_difference(X.live_map(visible(spark, sf_dir)), _committed(spark, sf_dir)[0], ["volume_id", "start_lba", "lba_length", "hash"])


@query(f"SELECT e.volume_id, e.hash, e.segment_id, r.start_lba, r.lba_length FROM ext e JOIN live r ON r.volume_id = e.volume_id AND r.hash = e.hash WHERE e.segment_id % 3 = 0 AND r.hash <> {ZERO}", VIS, BLOCKS, MAP, EXT)
def stale_hash_places(spark, sf_dir):
    """Where contents of segments that are to go are still mapped."""
    _, runs, extents, _ = M._core(spark, sf_dir)
    return R.places_of(extents.where("segment_id % 3 = 0"), runs)


# What a rewrite makes of its inputs. A body here is the text of a block's hash for each of its blocks, 32 bytes a block.
BODYT = "array_to_string(list_transform(range(lba_length), lambda i: md5(hash || CAST(i AS VARCHAR))), '')"
PLAN = M.GC_PLAN_SQL


@query(f"SELECT p.entry_key, p.ord, p.op, CASE p.op WHEN 'zero_split' THEN 'zero' WHEN 'run' THEN 'data' WHEN 'keep' THEN o.kind WHEN 'canonical' THEN CASE WHEN o.kind LIKE '%inline' THEN 'canonical_inline' ELSE 'canonical_data' END END AS kind, CASE p.op WHEN 'zero_split' THEN {ZERO} WHEN 'run' THEN sha256(substr(b.body, p.payload_block_offset * 32 + 1, p.lba_length * 32)) ELSE o.hash END AS hash, CASE WHEN p.op = 'canonical' THEN 0 ELSE p.start_lba END AS start_lba, CASE WHEN p.op = 'canonical' THEN 0 ELSE p.lba_length END AS lba_length FROM ({PLAN}) p JOIN outc o ON o.entry_key = p.entry_key JOIN (SELECT entry_key, {BODYT} AS body FROM vis) b ON b.entry_key = p.entry_key WHERE p.op <> 'drop'", *CORE, CLS, DENS, ELIG)
def rewrite_entries(spark, sf_dir):
    classified, runs = M._classified(spark, sf_dir)
    plan = X.plan_rows(classified, X.gc_eligible(X.segment_density(classified), fixture(spark, sf_dir, "fx_snapshots")), runs)
    body = F.expr("array_join(transform(IF(lba_length > 0, sequence(0, cast(lba_length AS INT) - 1), array()), i -> md5(cast(concat(hash, cast(i AS STRING)) AS BINARY))), '')")
    return R.materialise(plan, visible(spark, sf_dir).withColumn("body", body), block=32)


OUTH = f"pl AS ({PLAN}), inh AS (SELECT DISTINCT o.volume_id, o.hash FROM outc o SEMI JOIN elig USING (volume_id, segment_id) WHERE o.kind IN {M.BODY} AND o.is_owner), outh AS (SELECT DISTINCT o.volume_id, o.hash FROM pl p JOIN outc o ON o.entry_key = p.entry_key WHERE p.op IN ('keep', 'canonical') AND o.entry_key % 2 = 0)"


@query("SELECT volume_id, count(*) AS dropped, count(*) FILTER (WHERE l) AS still_live, count(*) FILTER (WHERE l) > 0 AS cancelled FROM (SELECT i.volume_id, EXISTS (SELECT 1 FROM lh WHERE lh.volume_id = i.volume_id AND lh.hash = i.hash) AS l FROM inh i WHERE NOT EXISTS (SELECT 1 FROM outh o WHERE o.volume_id = i.volume_id AND o.hash = i.hash)) GROUP BY volume_id", *CORE, CLS, DENS, ELIG, OUTH)
def rewrite_cancels(spark, sf_dir):
    """A rewrite that has lost half of its bodies: cancelled where a content that it doesn't carry is live."""
    rows, runs, extents, _ = M._core(spark, sf_dir)
    live = X.live_hashes(runs, rows)
    classified = staged(X.classify(rows, runs, extents, live), "classified")
    eligible = X.gc_eligible(X.segment_density(classified), fixture(spark, sf_dir, "fx_snapshots"))
    plan = X.plan_rows(classified, eligible, runs)
    owned = classified.join(eligible.select("volume_id", "segment_id"), ["volume_id", "segment_id"], "left_semi").where(F.col("kind").isin(*X.BODY_KINDS) & F.col("is_owner"))
    carried = plan.join(classified.select("entry_key", "volume_id", "hash"), "entry_key").where("op IN ('keep', 'canonical') AND entry_key % 2 = 0")
    return R.cancels(owned, carried, live)


@query("SELECT volume_id, segment_id, CAST(sum(stored_length * matching // lba_length) AS BIGINT) AS live_stored, CAST(sum(stored_length) AS BIGINT) AS stored FROM outc WHERE lba_length > 0 AND kind IN ('data', 'inline') GROUP BY ALL", *CORE, CLS)
def repack_bytes(spark, sf_dir):
    return R.stored_live(M._classified(spark, sf_dir)[0])


RESID = "SELECT c.volume_id, c.segment_id, coalesce(bool_and(o.present) FILTER (WHERE c.kind IN ('data', 'canonical_data')), true) AS resident FROM outc c LEFT JOIN offs o ON o.entry_key = c.entry_key WHERE c.outcome NOT LIKE 'drop%' GROUP BY ALL"


@query(RESID, *CORE, CLS, OFFS)
def cache_resident(spark, sf_dir):
    return R.resident(M._classified(spark, sf_dir)[0], _offsets(spark, sf_dir))


@query("SELECT entry_key, position FROM (SELECT e.entry_key, row_number() OVER (PARTITION BY volume_id ORDER BY CASE tier WHEN 'gc' THEN 0 ELSE 1 END, segment_id, entry_idx) - 1 AS position FROM fx_entries e)")
def rebuild_order(spark, sf_dir):
    """Inputs of a rewrite in the order in which they are applied: gc outputs first, that is lowest."""
    return R.positions(fixture(spark, sf_dir, "fx_entries"), F.when(F.col("tier") == "gc", 0).otherwise(1), F.col("segment_id"), F.col("entry_idx")).select("entry_key", "position")


@query("SELECT volume_id, hash, lba_length, dead_blocks, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY dead_blocks DESC, hash) AS rank FROM (" + M.RECLAIM_SQL + ")) WHERE rank <= 5", VIS, BLOCKS, MAP, EXT, DEL)
def reclaim_capped(spark, sf_dir):
    """The five candidates with most dead blocks of each volume; of equals the least hash."""
    return R.most_dead(M.reclaim_candidates(spark, sf_dir), 5)


LATE = f"tgt AS (SELECT volume_id, hash, start_lba, start_lba + lba_length AS end_lba FROM ({M.RECLAIM_SQL}))"


@query(f"SELECT t.volume_id, t.hash, t.start_lba, count(*) AS runs, bool_and(r.start_lba >= t.start_lba AND r.start_lba + r.lba_length <= t.end_lba - CAST(t.start_lba % 2 = 0 AS INT)) AS contained FROM tgt t JOIN live r ON r.volume_id = t.volume_id AND r.hash = t.hash AND r.hash <> {ZERO} GROUP BY ALL", VIS, BLOCKS, MAP, EXT, DEL, LATE)
def reclaim_contained(spark, sf_dir):
    """Whether all runs of a content lie inside the range that is to be rewritten (every other range one block short)."""
    runs = X.live_map(visible(spark, sf_dir))
    found = M.reclaim_candidates(spark, sf_dir)
    target = found.select("volume_id", "hash", "start_lba", (F.col("start_lba") + F.col("lba_length") - (F.col("start_lba") % 2 == 0).cast("int")).alias("end_lba"))
    return R.contained(target, runs)
