"""Queries over write logs, images, ownership, audit, fetch planning and inspection; each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataq.operators import images as I
from strataq.operators import intervals
from strataq.operators import lineage as L
from strataq.operators import ownership as O
from strataq.operators import writes as W
from strataq.plans.maps import BODY, LAYERS, VIS, visible
from strataq.sources.fixtures import duck, fixture

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *parts: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = duck(sql, *parts)
        return f

    return add


WRITES = "ow AS (SELECT *, op = 'write' AND coalesce(lag(hash) OVER (PARTITION BY volume_id, lba ORDER BY seq) = hash, false) AS noop FROM fx_writes WHERE op <> 'flush'), oc AS (SELECT seq, volume_id, lba, CASE WHEN op = 'zero' THEN 'zero' WHEN noop THEN 'noop' WHEN row_number() OVER (PARTITION BY volume_id, hash, noop, op ORDER BY seq) = 1 THEN 'data' ELSE 'dedup_ref' END AS outcome FROM ow)"


@query("SELECT * FROM oc", WRITES)
def write_outcomes(spark, sf_dir):
    return W.outcomes(fixture(spark, sf_dir, "fx_writes"))


@query("SELECT volume_id, count(*) AS writes, count(*) FILTER (WHERE outcome = 'noop') AS noops, count(*) FILTER (WHERE outcome = 'noop') * 4096 AS noop_bytes FROM oc GROUP BY volume_id", WRITES)
def noop_stats(spark, sf_dir):
    return W.noop_stats(W.outcomes(fixture(spark, sf_dir, "fx_writes")))


@query("SELECT volume_id, session, count(*) FILTER (WHERE op = 'write') AS n_writes, count(*) FILTER (WHERE op = 'zero') AS n_zeroes, min(seq) AS first_seq, max(seq) AS last_seq FROM (SELECT *, CAST(coalesce(sum(CASE WHEN op = 'flush' THEN 1 ELSE 0 END) OVER (PARTITION BY volume_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS session FROM fx_writes) GROUP BY volume_id, session")
def wal_sessions(spark, sf_dir):
    return W.sessions(fixture(spark, sf_dir, "fx_writes"))


OFFS = f"offs AS (SELECT *, CAST(sum(stored_length) OVER (PARTITION BY volume_id, segment_id, section ORDER BY entry_idx ROWS UNBOUNDED PRECEDING) - stored_length AS BIGINT) AS stored_offset, entry_key % 7 <> 3 AS present FROM (SELECT *, CASE WHEN kind LIKE '%inline' THEN 'inline' ELSE 'body' END AS section FROM fx_entries WHERE kind IN {BODY}))"


def _offsets(spark, sf_dir):
    return W.section_offsets(fixture(spark, sf_dir, "fx_entries")).withColumn("present", F.col("entry_key") % 7 != 3)


@query("SELECT entry_key, section, stored_offset FROM offs", OFFS)
def segment_offsets(spark, sf_dir):
    return _offsets(spark, sf_dir).select("entry_key", "section", "stored_offset")


@query("SELECT volume_id, segment_id, coalesce(min(stored_offset) FILTER (WHERE NOT present), max(stored_offset + stored_length)) AS covered, max(stored_offset + stored_length) AS body_length FROM offs WHERE section = 'body' GROUP BY ALL", OFFS)
def covered_prefix(spark, sf_dir):
    return W.covered_prefix(_offsets(spark, sf_dir))


@query("SELECT volume_id, segment_id, string_agg(lpad(CAST(b AS VARCHAR), 6, '0') || ':' || lpad(upper(hex(v)), 2, '0'), ',' ORDER BY b) AS bits, CAST(sum(n) AS BIGINT) AS populated FROM (SELECT volume_id, segment_id, entry_idx // 8 AS b, CAST(sum(1 << CAST(entry_idx % 8 AS INT)) AS BIGINT) AS v, count(*) AS n FROM offs WHERE present GROUP BY ALL) GROUP BY ALL", OFFS)
def presence_bits(spark, sf_dir):
    return W.presence_bits(_offsets(spark, sf_dir))


ABSENT = "ab AS (SELECT *, row_number() OVER (PARTITION BY volume_id, segment_id ORDER BY entry_idx) AS rn, coalesce(lag(CASE WHEN present THEN -1 ELSE stored_offset + stored_length END) OVER (PARTITION BY volume_id, segment_id ORDER BY entry_idx), -1) = stored_offset AS joins FROM offs WHERE section = 'body' AND stored_length > 0), /*recursive*/ wb AS (SELECT volume_id, segment_id, rn, entry_idx, present, stored_offset + stored_length AS e, stored_offset AS bs, entry_idx AS be FROM ab WHERE rn = 1 UNION ALL SELECT a.volume_id, a.segment_id, a.rn, a.entry_idx, a.present, a.stored_offset + a.stored_length, CASE WHEN a.joins AND NOT w.present AND a.stored_offset + a.stored_length - w.bs <= 65536 THEN w.bs ELSE a.stored_offset END, CASE WHEN a.joins AND NOT w.present AND a.stored_offset + a.stored_length - w.bs <= 65536 THEN w.be ELSE a.entry_idx END FROM wb w JOIN ab a ON a.volume_id = w.volume_id AND a.segment_id = w.segment_id AND a.rn = w.rn + 1)"


@query("SELECT volume_id, segment_id, be AS start_entry, max(entry_idx) AS end_entry, min(bs) AS body_start, max(e) AS body_end FROM wb WHERE NOT present GROUP BY volume_id, segment_id, be", OFFS, ABSENT)
def warm_batches(spark, sf_dir):
    return W.warm_batches(_offsets(spark, sf_dir), 65536)


@query()
def log_rollovers(spark, sf_dir):
    return W.rollovers(visible(spark, sf_dir), "entry_key", "stored_length", 1 << 20, 256)


@query("SELECT volume_id, segment_id, count(*) AS entries, count(*) FILTER (WHERE kind = 'data') AS data, count(*) FILTER (WHERE kind = 'inline') AS inline, count(*) FILTER (WHERE kind = 'dedup_ref') AS refs, count(*) FILTER (WHERE kind = 'zero') AS zeroes, count(*) FILTER (WHERE kind = 'delta') AS deltas, count(*) FILTER (WHERE kind = 'canonical_data') AS canonical, CAST(sum(stored_length) AS BIGINT) AS stored_bytes FROM fx_entries GROUP BY ALL")
def segment_stats(spark, sf_dir):
    kinds = {"data": "data", "inline": "inline", "refs": "dedup_ref", "zeroes": "zero", "deltas": "delta", "canonical": "canonical_data"}
    rows = fixture(spark, sf_dir, "fx_entries").groupBy("volume_id", "segment_id")
    return rows.agg(F.count("*").alias("entries"), *(F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()), F.sum("stored_length").alias("stored_bytes"))


@query("SELECT a.volume_id, count(DISTINCT e.volume_id || '/' || e.segment_id) AS segments, count(*) AS entries, CAST(sum(stored_length) AS BIGINT) AS stored_bytes FROM anc a JOIN fx_entries e ON e.volume_id = a.layer AND e.segment_id <= a.cutoff GROUP BY a.volume_id", LAYERS)
def volume_totals(spark, sf_dir):
    layers = L.layers(fixture(spark, sf_dir, "fx_lineage"))
    per = fixture(spark, sf_dir, "fx_entries").groupBy(F.col("volume_id").alias("layer_volume_id"), "segment_id").agg(F.count("*").alias("n"), F.sum("stored_length").alias("b"))
    rows = layers.join(per, "layer_volume_id").where("segment_id <= cutoff")
    return rows.groupBy("volume_id").agg(F.count("*").alias("segments"), F.sum("n").alias("entries"), F.sum("b").alias("stored_bytes"))


@query("SELECT entry_key, 'canonical_data' AS kind, CAST(0 AS BIGINT) AS start_lba, CAST(0 AS BIGINT) AS lba_length, hash FROM fx_entries WHERE kind = 'data' AND entry_key % 5 = 0")
def demoted_entries(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_entries").where("kind = 'data' AND entry_key % 5 = 0")
    return rows.select("entry_key", F.lit("canonical_data").alias("kind"), F.lit(0).cast("long").alias("start_lba"), F.lit(0).cast("long").alias("lba_length"), "hash")


@query("SELECT DISTINCT volume_id, input_id AS segment_id FROM fx_inputs")
def superseded_inputs(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_inputs").select("volume_id", F.col("input_id").alias("segment_id")).distinct()


@query("SELECT DISTINCT h.volume_id, h.segment_id FROM fx_head h WHERE section IN ('manifest', 'added') AND segment_id % 5 = 0")
def manifest_fetch_set(spark, sf_dir):
    listed = fixture(spark, sf_dir, "fx_head").where("section IN ('manifest', 'added')").select("volume_id", "segment_id").distinct()
    local = fixture(spark, sf_dir, "fx_entries").where("segment_id % 5 <> 0").select("volume_id", "segment_id")
    return listed.join(local, ["volume_id", "segment_id"], "left_anti")


@query("SELECT volume_id, min(start_lba) AS start_lba, max(end_lba) AS end_lba, count(*) AS requests FROM (SELECT *, sum(CASE WHEN reached IS NULL OR start_lba > reached THEN 1 ELSE 0 END) OVER (PARTITION BY volume_id ORDER BY start_lba, end_lba ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, max(end_lba) OVER (PARTITION BY volume_id ORDER BY start_lba, end_lba ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM fx_requests)) GROUP BY volume_id, g")
def fetch_leases(spark, sf_dir):
    return intervals.islands(fixture(spark, sf_dir, "fx_requests"), ["volume_id"], "start_lba", "end_lba", [F.count("*").alias("requests")])


@query("SELECT concat_ws('/', 'by_id', e.volume_id, strftime(to_timestamp(1700000000 + segment_id * 3600), '%Y%m%d'), segment_id) AS object_key FROM (SELECT DISTINCT volume_id, segment_id FROM fx_entries) e")
def segment_keys(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_entries").select("volume_id", "segment_id").distinct()
    day = F.date_format(F.timestamp_seconds(F.col("segment_id") * 3600 + 1700000000), "yyyyMMdd")
    return rows.select(F.concat_ws("/", F.lit("by_id"), "volume_id", day, F.col("segment_id").cast("string")).alias("object_key"))


HASHED = "h1 AS (SELECT path, sha256(content) AS hash, strlen(content) AS bytes FROM fx_image1), h2 AS (SELECT path, sha256(content) AS hash, strlen(content) AS bytes FROM fx_image2)"


def _images(spark, sf_dir):
    return tuple(I.hashed(fixture(spark, sf_dir, f"fx_image{i}")) for i in (1, 2))


@query("SELECT CAST(sum(n) AS BIGINT) AS files, CAST(sum(n * b) AS BIGINT) AS total_bytes, count(*) AS unique_files, CAST(sum(b) AS BIGINT) AS unique_bytes, 1 - CAST(sum(b) AS DOUBLE) / sum(n * b) AS dedup_ratio FROM (SELECT hash, count(*) AS n, any_value(bytes) AS b FROM h1 GROUP BY hash)", HASHED)
def dedup_report(spark, sf_dir):
    return I.dedup_report(_images(spark, sf_dir)[0])


@query("SELECT count(*) AS contents, count(*) FILTER (WHERE s) AS shared_contents, CAST(sum(b) AS BIGINT) AS total_bytes, CAST(coalesce(sum(b) FILTER (WHERE s), 0) AS BIGINT) AS shared_bytes, CAST(count(*) FILTER (WHERE s) AS DOUBLE) / count(*) AS count_ratio, CAST(coalesce(sum(b) FILTER (WHERE s), 0) AS DOUBLE) / sum(b) AS byte_ratio FROM (SELECT hash, any_value(bytes) AS b, hash IN (SELECT hash FROM h1) AS s FROM h2 GROUP BY hash)", HASHED)
def image_overlap(spark, sf_dir):
    return I.overlap(*_images(spark, sf_dir))


@query("SELECT coalesce(h1.path, h2.path) AS path, CASE WHEN h1.hash IS NULL THEN 'new' WHEN h2.hash IS NULL THEN 'removed' WHEN h1.hash = h2.hash THEN 'exact' ELSE 'changed' END AS class, h1.bytes AS bytes1, h2.bytes AS bytes2 FROM h1 FULL JOIN h2 ON h1.path = h2.path", HASHED)
def file_diff(spark, sf_dir):
    return I.file_diff(*_images(spark, sf_dir))


RENAMED = "ren AS (SELECT h2.path, CASE WHEN o.old_path IS NOT NULL THEN 'renamed' WHEN h2.bytes > 0 AND h2.bytes IN (SELECT bytes FROM h1) THEN 'same_size' ELSE 'new' END AS class, o.old_path, h2.bytes FROM h2 LEFT JOIN (SELECT hash, min(path) AS old_path FROM h1 GROUP BY hash) o ON o.hash = h2.hash WHERE h2.path NOT IN (SELECT path FROM h1))"


@query("SELECT * FROM ren", HASHED, RENAMED)
def rename_analysis(spark, sf_dir):
    return I.renames(*_images(spark, sf_dir))


@query("SELECT path, old_path, bytes FROM ren WHERE class = 'renamed' ORDER BY bytes DESC, path LIMIT 20", HASHED, RENAMED)
def top_renames(spark, sf_dir):
    return I.renames(*_images(spark, sf_dir)).where("class = 'renamed'").select("path", "old_path", "bytes").orderBy(F.desc("bytes"), "path").limit(20)


SPARSE = "sp AS (SELECT path, any_value(blocks) AS blocks, count(*) FILTER (WHERE substr(hex(o), i * 8192 + 1, 8192) <> substr(hex(n), i * 8192 + 1, 8192)) AS changed FROM (SELECT a.path, encode(a.content) AS o, encode(b.content) AS n, CAST(ceil(strlen(b.content) / 4096.0) AS BIGINT) AS blocks, unnest(range(CAST(ceil(strlen(b.content) / 4096.0) AS BIGINT))) AS i FROM fx_image1 a JOIN fx_image2 b ON a.path = b.path WHERE a.content <> b.content) GROUP BY path)"


@query("SELECT * FROM sp", SPARSE)
def sparse_analysis(spark, sf_dir):
    return I.changed_blocks(fixture(spark, sf_dir, "fx_image1"), fixture(spark, sf_dir, "fx_image2"))


@query("SELECT CAST(least(floor(CAST(changed AS DOUBLE) / blocks * 5), 4) AS INT) AS bin, count(*) AS files FROM sp WHERE blocks > 0 GROUP BY bin", SPARSE)
def diff_histogram(spark, sf_dir):
    return I.histogram(sparse_analysis(spark, sf_dir), "changed", "blocks")


MATRIX = "mx(state, verb, outcome) AS (VALUES " + ", ".join(f"('{s}', '{v}', '{o}')" for s, v, o in O.MATRIX) + ")"
FOLD = "vs AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq) AS rn FROM fx_verbs), /*recursive*/ fo AS (SELECT DISTINCT name, CAST(0 AS BIGINT) AS rn, 'released' AS state, CAST(NULL AS VARCHAR) AS owner, 0 AS n_proceed, 0 AS n_idempotent, 0 AS n_reroute, 0 AS n_refuse FROM fx_verbs UNION ALL SELECT name, rn, CASE WHEN o = 'proceed' THEN CASE verb WHEN 'stop' THEN 'stopped' WHEN 'release' THEN 'released' WHEN 'start' THEN 'live' WHEN 'force-release' THEN 'released' ELSE 'live' END ELSE state END, CASE WHEN o <> 'proceed' THEN owner WHEN verb = 'claim' THEN actor WHEN verb IN ('release', 'force-release') THEN NULL ELSE owner END, n_proceed + CAST(o = 'proceed' AS INT), n_idempotent + CAST(o = 'idempotent' AS INT), n_reroute + CAST(o = 'reroute' AS INT), n_refuse + CAST(o = 'refuse' AS INT) FROM (SELECT f.name, v.rn, f.state, f.owner, v.verb, v.actor, f.n_proceed, f.n_idempotent, f.n_reroute, f.n_refuse, CASE WHEN m.outcome = 'proceed' AND v.verb NOT IN ('claim', 'force-release') AND f.owner IS NOT NULL AND f.owner <> v.actor THEN 'refuse' ELSE m.outcome END AS o FROM fo f JOIN vs v ON v.name = f.name AND v.rn = f.rn + 1 JOIN mx m ON m.state = f.state AND m.verb = v.verb))"


@query("SELECT name, arg_max(state, rn) AS state, arg_max(struct_pack(o := owner), rn).o AS owner, max(n_proceed) AS n_proceed, max(n_idempotent) AS n_idempotent, max(n_reroute) AS n_reroute, max(n_refuse) AS n_refuse FROM fo GROUP BY name", MATRIX, FOLD)
def ownership_fold(spark, sf_dir):
    return O.fold(fixture(spark, sf_dir, "fx_verbs"))


@query("SELECT mx.state, mx.verb, mx.outcome, count(*) AS n FROM mx JOIN fx_verbs v ON v.verb = mx.verb GROUP BY ALL", MATRIX)
def transition_counts(spark, sf_dir):
    verbs = fixture(spark, sf_dir, "fx_verbs").groupBy("verb").agg(F.count("*").alias("n"))
    return O.matrix(spark).join(verbs, "verb").select("state", "verb", "outcome", "n")


@query("SELECT name, event_ulid, lag(event_ulid) OVER (PARTITION BY name ORDER BY event_ulid) IS DISTINCT FROM prev_event_ulid AS gap FROM fx_events")
def event_gaps(spark, sf_dir):
    return O.event_gaps(fixture(spark, sf_dir, "fx_events"))


@query("SELECT name, event_ulid, kind, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY event_ulid DESC) AS rank FROM fx_events) WHERE rank <= 16")
def recent_events(spark, sf_dir):
    return O.recent(fixture(spark, sf_dir, "fx_events"))


@query("SELECT name, event_ulid, step FROM wk", "ev AS (SELECT * FROM fx_events), /*recursive*/ wk AS (SELECT name, max(event_ulid) AS event_ulid, arg_max(struct_pack(p := prev_event_ulid), event_ulid).p AS prev, 0 AS step FROM ev GROUP BY name UNION ALL SELECT w.name, e.event_ulid, e.prev_event_ulid, w.step + 1 FROM wk w JOIN ev e ON e.name = w.name AND e.event_ulid = w.prev WHERE w.step < 5)")
def event_chain(spark, sf_dir):
    return O.chain(fixture(spark, sf_dir, "fx_events"), 6)


RES = "res AS (SELECT token_id, CASE WHEN count(*) FILTER (WHERE name = 'aud') = 0 THEN 'absent' WHEN count(DISTINCT value) FILTER (WHERE name = 'aud') = 1 THEN 'value' ELSE 'unsatisfiable' END AS aud_is, CASE WHEN count(DISTINCT value) FILTER (WHERE name = 'aud') = 1 THEN min(value) FILTER (WHERE name = 'aud') END AS aud, CASE WHEN count(*) FILTER (WHERE name = 'role') = 0 THEN 'absent' WHEN count(DISTINCT value) FILTER (WHERE name = 'role') = 1 THEN 'value' ELSE 'unsatisfiable' END AS role_is, CASE WHEN count(DISTINCT value) FILTER (WHERE name = 'role') = 1 THEN min(value) FILTER (WHERE name = 'role') END AS role, min(TRY_CAST(value AS BIGINT)) FILTER (WHERE name = 'exp') AS na FROM fx_caveats GROUP BY token_id)"


@query("SELECT token_id, aud_is, aud, role_is, role FROM res", RES)
def caveat_resolution(spark, sf_dir):
    return O.resolve_caveats(fixture(spark, sf_dir, "fx_caveats"), ["aud", "role"])


@query("SELECT token_id, na AS not_after FROM res WHERE na IS NOT NULL", RES)
def token_not_after(spark, sf_dir):
    return O.not_after(fixture(spark, sf_dir, "fx_caveats"))


@query("SELECT token_id, o AS outcome, CASE WHEN o = 'ok' THEN least(3600, 1800, na - 1500) END AS ttl FROM (SELECT *, CASE WHEN aud IS DISTINCT FROM 'engine' THEN 'wrong_audience' WHEN role_is = 'absent' THEN 'no_role' WHEN role IS DISTINCT FROM 'writer' THEN 'wrong_role' WHEN na <= 1500 THEN 'expired' ELSE 'ok' END AS o FROM res)", RES)
def role_authorize(spark, sf_dir):
    return O.authorize(fixture(spark, sf_dir, "fx_caveats"), "engine", "writer", 1500, 3600, 1800)
