"""Queries of records, tokens, events, recovery, fetch planning and listings; each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataq.operators import extentmap as X
from strataq.operators import images as I
from strataq.operators import lineage as L
from strataq.operators import ownership as O
from strataq.operators import records as R
from strataq.operators import writes as W
from strataq.operators.intervals import point_join
from strataq.operators.matching import tree_paths
from strataq.operators.rewrites import positions
from strataq.plans import maps as M
from strataq.plans.maps import BLOCKS, CORE, LAYERS, MAP, VIS, visible
from strataq.plans.more import FOLD, HASHED, MATRIX, OFFS, RES, _images, _offsets
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


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Head texts of the volumes; the third volume's lacks a section.
HEADT = "ht AS (SELECT volume_id, section, string_agg('  ' || segment_id, chr(10) ORDER BY segment_id) AS line FROM fx_head WHERE section <> 'manifest' GROUP BY ALL)"


@query("SELECT volume_id AS id, CASE WHEN volume_id <> 'v2' THEN section END AS section, CASE WHEN volume_id <> 'v2' THEN entry END AS entry, CASE WHEN volume_id = 'v2' THEN 'missing section tombstoned' END AS error FROM (SELECT volume_id, section, CAST(segment_id AS VARCHAR) AS entry FROM fx_head WHERE section <> 'manifest' AND volume_id <> 'v2' UNION ALL SELECT DISTINCT volume_id, 'anchor', 'none' FROM fx_head)")
def head_entries(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_head").where("section <> 'manifest'").groupBy("volume_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list("segment_id")), lambda x: F.concat(F.lit("  "), x.cast("string"))), "\n").alias("line"))
    shown = rows.groupBy("volume_id").agg(F.array_join(F.array_sort(F.collect_list(F.when((F.col("volume_id") != "v2") | (F.col("section") != "tombstoned"), F.concat("section", F.lit(":\n"), "line")))), "\n").alias("b"))
    return R.parse_heads(shown.select(F.col("volume_id").alias("id"), F.concat(F.lit("anchor: none\n"), "b", F.lit("\n")).alias("body")))


@query("SELECT event_ulid, CASE WHEN event_ulid % 31 = 0 THEN 'unsupported_version' WHEN event_ulid % 50 = 1 THEN 'timestamp_mismatch' ELSE 'ok' END AS status FROM fx_events")
def event_reads(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_events")
    at = F.unix_millis(F.col("at").cast("timestamp"))
    return rows.select("event_ulid", R.read_status(F.when(F.col("event_ulid") % 31 == 0, 1).otherwise(2), 2, at, at + (F.col("event_ulid") % 50 == 1).cast("long")).alias("status"))


@query("SELECT volume_id, snap_id, len(list_distinct(ids)) = len(ids) AND list_sort(ids) = ids AS valid FROM (SELECT s.volume_id, s.snap_id, list(e.segment_id * CASE WHEN s.volume_id = 'v1' AND e.segment_id = 3 THEN 100 ELSE 1 END ORDER BY e.segment_id) AS ids FROM fx_snapshots s JOIN (SELECT DISTINCT volume_id, segment_id FROM fx_entries) e ON e.volume_id = s.volume_id AND e.segment_id <= s.snap_id GROUP BY ALL)")
def manifest_reads(spark, sf_dir):
    """Manifests' ids must be strictly ascending; one volume's have an id out of place."""
    segments = fixture(spark, sf_dir, "fx_entries").select("volume_id", "segment_id").distinct()
    rows = fixture(spark, sf_dir, "fx_snapshots").join(segments, "volume_id").where("segment_id <= snap_id")
    shown = F.col("segment_id") * F.when((F.col("volume_id") == "v1") & (F.col("segment_id") == 3), 100).otherwise(1)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("segment_id", shown.alias("shown")))), lambda x: x["shown"])
    return rows.groupBy("volume_id", "snap_id").agg(ids.alias("ids")).select("volume_id", "snap_id", R.ascending(F.col("ids")).alias("valid"))


@query("SELECT f AS file, count(*) AS accepted, max(pos) AS last FROM (SELECT *, sum(CASE WHEN pos % 97 = 96 THEN 1 ELSE 0 END) OVER (PARTITION BY f ORDER BY pos) AS bad FROM (SELECT p_partkey % 5 AS f, p_partkey AS pos FROM part)) WHERE bad = 0 GROUP BY f")
def cache_records(spark, sf_dir):
    """Records of append-only files up to the first broken one."""
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 5).alias("file"), F.col("p_partkey").alias("pos"))
    return R.before_first_bad(rows, "file", "pos", F.col("pos") % 97 == 96).groupBy("file").agg(F.count("*").alias("accepted"), F.max("pos").alias("last"))


CYC = "cy AS (SELECT child_id, parent_id FROM fx_lineage UNION ALL SELECT * FROM (VALUES ('x1', 'x2'), ('x2', 'x3'), ('x3', 'x1'), ('y1', 'x2'))), /*recursive*/ wk AS (SELECT child_id AS volume_id, child_id AS layer, [child_id] AS path, CAST(NULL AS VARCHAR) AS met FROM (SELECT child_id FROM cy UNION SELECT parent_id FROM cy) UNION ALL SELECT volume_id, parent_id, list_append(path, parent_id), CASE WHEN list_contains(path, parent_id) THEN parent_id END FROM wk JOIN cy ON cy.child_id = wk.layer WHERE met IS NULL)"


@query("SELECT volume_id, met AS met_again FROM wk WHERE met IS NOT NULL", CYC)
def ancestry_errors(spark, sf_dir):
    lineage = fixture(spark, sf_dir, "fx_lineage").select("child_id", "parent_id")
    return R.ancestry_errors(lineage.unionByName(spark.createDataFrame([("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("y1", "x2")], "child_id string, parent_id string")))


SRC = "src(volume_id, source_id, snapshot) AS (VALUES ('v0', 's1', 10), ('v1', 's1', 40), ('v1', 's2', 7), ('v2', 's3', 5), ('v3', 's1', 2))"


@query("SELECT a.volume_id, s.source_id, CAST(max(s.snapshot) AS BIGINT) AS snapshot FROM anc a JOIN src s ON s.volume_id = a.layer GROUP BY ALL", LAYERS, SRC)
def extent_sources(spark, sf_dir):
    sources = spark.createDataFrame([("v0", "s1", 10), ("v1", "s1", 40), ("v1", "s2", 7), ("v2", "s3", 5), ("v3", "s1", 2)], "volume_id string, source_id string, snapshot long")
    return R.extent_sources(L.layers(fixture(spark, sf_dir, "fx_lineage")), sources)


@query("SELECT a.volume_id, a.layer AS layer_volume_id, e.segment_id FROM anc a JOIN (SELECT DISTINCT volume_id, segment_id FROM fx_entries) e ON e.volume_id = a.layer AND e.segment_id <= a.cutoff WHERE a.depth > 0 AND e.segment_id % 9 = 4", LAYERS)
def ancestor_manifest_gaps(spark, sf_dir):
    layers = L.layers(fixture(spark, sf_dir, "fx_lineage"))
    segments = fixture(spark, sf_dir, "fx_entries").select("volume_id", "segment_id").distinct()
    cuts = layers.where("depth > 0").select(F.col("layer_volume_id").alias("volume_id"), F.col("cutoff").alias("snap_id")).distinct()
    return R.missing_in_ancestors(layers, cuts.join(segments, "volume_id").where("segment_id <= snap_id"), segments.where("segment_id % 9 <> 4"))


# Token chains: role, op, volume and expiry in this order, each missing or wrong for some tokens.
CHAIN = "ch AS (SELECT c_custkey AS token_id, pos, name, value FROM customer, LATERAL (VALUES (1, 'role', 'operator'), (2, 'op', CASE WHEN c_custkey % 7 = 0 THEN 'list' ELSE 'remove' END), (3, 'not_after', CASE WHEN c_custkey % 5 = 0 THEN '900' ELSE '2000' END), (4, 'volume', CASE WHEN c_custkey % 11 = 0 THEN 'other' ELSE 'mine' END), (5, 'scope', CASE WHEN c_custkey % 17 = 0 THEN 'fetch' END), (6, 'pid', CASE WHEN c_custkey % 17 = 0 THEN CAST(c_custkey % 3 AS VARCHAR) END)) x(pos, name, value) WHERE value IS NOT NULL AND NOT (c_custkey % 13 = pos))"


def _chain(spark, sf_dir):
    k = F.col("c_custkey")
    fetch = k % 17 == 0
    values = [("role", F.lit("operator")), ("op", F.when(k % 7 == 0, "list").otherwise("remove")), ("not_after", F.when(k % 5 == 0, "900").otherwise("2000")), ("volume", F.when(k % 11 == 0, "other").otherwise("mine")), ("scope", F.when(fetch, "fetch")), ("pid", F.when(fetch, (k % 3).cast("string")))]
    rows = F.inline(F.array(*(F.struct(F.lit(i + 1).alias("pos"), F.lit(n).alias("name"), v.alias("value")) for i, (n, v) in enumerate(values))))
    return table(spark, sf_dir, "customer").select(k.alias("token_id"), rows).where("value IS NOT NULL AND NOT (token_id % 13 = pos)")


@query("SELECT token_id, CASE WHEN r IS NOT NULL THEN r WHEN NOT ro THEN 'wrong_role' WHEN NOT op THEN 'missing_op' WHEN NOT vo THEN 'missing_volume' ELSE 'ok' END AS outcome FROM (SELECT token_id, arg_min(f, pos) FILTER (WHERE f IS NOT NULL) AS r, bool_or(name = 'role') AS ro, bool_or(name = 'op') AS op, bool_or(name = 'volume') AS vo FROM (SELECT *, CASE name WHEN 'op' THEN CASE WHEN value <> 'remove' THEN 'wrong_op' END WHEN 'not_after' THEN CASE WHEN 1000 >= CAST(value AS BIGINT) THEN 'expired' END WHEN 'volume' THEN CASE WHEN value <> 'mine' THEN 'volume_mismatch' END WHEN 'role' THEN NULL ELSE 'wrong_role' END AS f FROM ch) GROUP BY token_id)", CHAIN)
def operator_tokens(spark, sf_dir):
    value = F.col("value")
    wrong = lambda when, reason: F.when(when, reason)
    checks = {"role": F.lit(None).cast("string"), "op": wrong(value != "remove", "wrong_op"), "not_after": wrong(value.try_cast("long") <= 1000, "expired"), "volume": wrong(value != "mine", "volume_mismatch"), "scope": F.lit("wrong_role"), "pid": F.lit("wrong_role")}
    return R.first_refusal(_chain(spark, sf_dir), checks, [("role", "wrong_role"), ("op", "missing_op"), ("volume", "missing_volume")])


@query("SELECT token_id, CASE WHEN r IS NOT NULL THEN r WHEN NOT vo THEN 'missing volume' WHEN NOT sc THEN 'missing scope' WHEN NOT pi THEN 'missing pid' ELSE 'ok' END AS outcome FROM (SELECT token_id, arg_min(f, pos) FILTER (WHERE f IS NOT NULL) AS r, bool_or(name = 'volume') AS vo, bool_or(name = 'scope') AS sc, bool_or(name = 'pid') AS pi FROM (SELECT *, CASE name WHEN 'volume' THEN CASE WHEN value <> 'mine' THEN 'volume mismatch' END WHEN 'scope' THEN CASE WHEN value NOT IN ('fetch', 'credentials') THEN 'scope mismatch' END WHEN 'pid' THEN CASE WHEN value <> '1' THEN 'pid mismatch' END WHEN 'not_after' THEN CASE WHEN 1000 >= CAST(value AS BIGINT) THEN 'expired' END END AS f FROM ch WHERE name NOT IN ('role', 'op')) GROUP BY token_id)", CHAIN)
def volume_tokens(spark, sf_dir):
    value = F.col("value")
    checks = {"volume": F.when(value != "mine", "volume mismatch"), "scope": F.when(~value.isin("fetch", "credentials"), "scope mismatch"), "pid": F.when(value != "1", "pid mismatch"), "not_after": F.when(value.try_cast("long") <= 1000, "expired"), "role": F.lit("role not valid here"), "op": F.lit("op not valid here")}
    return R.first_refusal(_chain(spark, sf_dir).where("name NOT IN ('role', 'op')"), checks, [(n, f"missing {n}") for n in ("volume", "scope", "pid")])


REQ = "rq AS (SELECT p_partkey AS request_id, 'n' || p_partkey % 25 AS name, 'c' || p_partkey % 3 AS coordinator, 'v' || p_partkey % 5 AS volume_id, 900 + p_partkey % 200 AS issued, p_partkey % 11 <> 0 AS signed FROM part), folded AS (SELECT name, arg_max(state, rn) AS state, arg_max(struct_pack(o := owner), rn).o AS owner FROM fo GROUP BY name)"


@query("SELECT request_id, CASE WHEN abs(issued - 1000) > 60 THEN 'stale' WHEN NOT signed THEN 'bad_signature' WHEN NOT coalesce(f.state IN ('live', 'stopped') AND f.owner = r.coordinator, false) THEN 'not_current_claimer' WHEN r.volume_id NOT IN (SELECT child_id FROM fx_lineage UNION SELECT parent_id FROM fx_lineage) THEN 'outside_lineage' ELSE 'ok' END AS outcome FROM rq r LEFT JOIN folded f USING (name)", MATRIX, FOLD, REQ)
def peer_requests(spark, sf_dir):
    k = F.col("p_partkey")
    text = lambda prefix, n: F.concat(F.lit(prefix), (k % n).cast("string"))
    requests = table(spark, sf_dir, "part").select(k.alias("request_id"), text("n", 25).alias("name"), text("c", 3).alias("coordinator"), text("v", 5).alias("volume_id"), (k % 200 + 900).alias("issued"), (k % 11 != 0).alias("signed"))
    lineage = fixture(spark, sf_dir, "fx_lineage")
    return R.admit(requests, O.fold(fixture(spark, sf_dir, "fx_verbs")), lineage.select(F.col("child_id").alias("volume_id")).union(lineage.select("parent_id")), 1000)


SIGNED = "sg AS (SELECT *, 'c' || event_ulid % 4 AS coordinator, CASE WHEN event_ulid % 4 < 3 THEN 'key' || event_ulid % 4 END AS key, CASE WHEN event_ulid % 19 = 0 THEN NULL WHEN event_ulid % 23 = 0 THEN 'forged' ELSE md5(CAST(event_ulid AS VARCHAR) || kind || 'key' || event_ulid % 4) END AS signature FROM fx_events)"


@query("SELECT name, event_ulid, kind, CASE WHEN key IS NULL THEN 'key_unavailable' WHEN signature IS NULL THEN 'missing' WHEN signature = md5(CAST(event_ulid AS VARCHAR) || kind || key) THEN 'valid' ELSE 'invalid' END AS status, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY event_ulid DESC) AS rank FROM sg) WHERE rank <= 20", SIGNED)
def event_history(spark, sf_dir):
    """The newest twenty events of each name with the state of their signatures (digests stand for them); rank 1 is the newest."""
    e = fixture(spark, sf_dir, "fx_events")
    k = F.col("event_ulid")
    keys = F.when(k % 4 < 3, F.concat(F.lit("key"), (k % 4).cast("string")))
    signed = lambda key: F.md5(F.concat(k.cast("string"), "kind", key).cast("binary"))
    own = F.when(k % 19 == 0, F.lit(None)).when(k % 23 == 0, F.lit("forged")).otherwise(signed(F.concat(F.lit("key"), (k % 4).cast("string"))))
    status = R.signature_status(own, keys, signed(keys))
    return O.recent(e, 20).join(e.select("name", "event_ulid", status.alias("status")), ["name", "event_ulid"]).select("name", "event_ulid", "kind", "status", "rank")


@query("SELECT token_id, CASE WHEN role IS NULL THEN NULL ELSE replace(replace('{\"role\":\"{{role}}\",\"until\":\"{{expiry}}\"}', '{{role}}', role), '{{expiry}}', CAST(na AS VARCHAR)) END AS policy FROM res", RES)
def rendered_policies(spark, sf_dir):
    """Strict templates: a value that is missing or contradicted gives no policy."""
    caveats = fixture(spark, sf_dir, "fx_caveats")
    rows = O.resolve_caveats(caveats, ["role"]).join(O.not_after(caveats), "token_id", "left")
    template = F.lit('{"role":"{{role}}","until":"{{expiry}}"}')
    return rows.select("token_id", R.rendered(template, {"role": F.col("role"), "expiry": F.col("not_after").cast("string")}).alias("policy"))


@query("SELECT token_id, string_agg(name || '=' || value, ';' ORDER BY pos) AS caveats FROM fx_caveats GROUP BY token_id")
def audited_caveats(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_caveats").groupBy("token_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "value"))).alias("c"))
    return rows.select("token_id", F.array_join(F.transform("c", lambda x: F.concat(x["name"], F.lit("="), x["value"])), ";").alias("caveats"))


@query("SELECT sub, first_seen FROM (SELECT 's' || user_id % 50 AS sub, min(event_id) AS first_seen FROM events GROUP BY 1) WHERE greatest(1000 - first_seen, 0) > 980")
def stale_enrolments(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("s"), (F.col("user_id") % 50).cast("string")).alias("sub")).agg(F.min("event_id").alias("first_seen"))
    return rows.where(F.greatest(F.lit(1000) - F.col("first_seen"), F.lit(0)) > 980)


PUTS = "ob AS (SELECT DISTINCT 'k' || event_id % 40 AS key, CAST(event_id % 40 % 3 AS BIGINT) AS version FROM events WHERE event_id % 40 % 4 > 0), pu AS (SELECT 'k' || event_id % 40 AS key, event_id AS seq, CASE WHEN event_id % 3 > 0 THEN event_id % 3 END AS expects FROM events)"


@query("SELECT key, seq, CASE WHEN fits AND seq = min(seq) FILTER (WHERE fits) OVER (PARTITION BY key) THEN 'written' WHEN expects IS NULL THEN 'already_exists' ELSE 'precondition_failed' END AS outcome FROM (SELECT pu.*, CASE WHEN expects IS NULL THEN version IS NULL ELSE coalesce(expects = version, false) END AS fits FROM pu LEFT JOIN ob USING (key))", PUTS)
def conditional_puts(spark, sf_dir):
    k = F.col("event_id")
    events = table(spark, sf_dir, "events")
    key = F.concat(F.lit("k"), (k % 40).cast("string")).alias("key")
    objects = events.where("event_id % 40 % 4 > 0").select(key, (k % 40 % 3).alias("version")).distinct()
    return R.put_if(objects, events.select(key, k.alias("seq"), F.when(k % 3 > 0, k % 3).alias("expects")))


RNG = "rg AS (SELECT p_partkey AS request_id, s.segment, p_partkey % 7 * 4096 AS first, p_partkey % 7 * 4096 + p_size * 1000 AS last FROM part JOIN (SELECT DISTINCT volume_id || '/' || segment_id AS segment, row_number() OVER (ORDER BY volume_id, segment_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT volume_id, segment_id FROM fx_entries)) s ON s.i = p_partkey % 4), gp AS (SELECT volume_id || '/' || segment_id AS segment, stored_offset AS gap_start, stored_offset + stored_length AS gap_end FROM offs WHERE section = 'body' AND NOT present)"


def _ranges(spark, sf_dir):
    segments = fixture(spark, sf_dir, "fx_entries").select("volume_id", "segment_id").distinct().orderBy("volume_id", "segment_id").limit(4).collect()
    named = spark.createDataFrame([(i, f"{r.volume_id}/{r.segment_id}") for i, r in enumerate(segments)], "i long, segment string")
    k = F.col("p_partkey")
    first = k % 7 * 4096
    ranges = table(spark, sf_dir, "part").withColumn("i", k % 4).join(F.broadcast(named), "i").select(k.alias("request_id"), "segment", first.alias("first"), (first + F.col("p_size") * 1000).alias("last"))
    gaps = _offsets(spark, sf_dir).where("section = 'body' AND NOT present").select(F.concat_ws("/", "volume_id", F.col("segment_id").cast("string")).alias("segment"), F.col("stored_offset").alias("gap_start"), (F.col("stored_offset") + F.col("stored_length")).alias("gap_end"))
    return ranges, gaps


@query("SELECT request_id, CAST(CASE WHEN c = 0 THEN 404 WHEN c = n THEN 200 ELSE 206 END AS INT) AS status, c AS from_peer, n - c AS from_store FROM (SELECT request_id, last - first + 1 AS n, coalesce(min(greatest(gap_start - first, 0)) FILTER (WHERE gap_start <= last AND gap_end > first), last - first + 1) AS c FROM rg LEFT JOIN gp USING (segment) GROUP BY request_id, first, last)", OFFS, RNG)
def served_ranges(spark, sf_dir):
    """What peers serve of byte ranges, and what is left for the store."""
    return R.serve(*_ranges(spark, sf_dir))


@query("SELECT volume_id, segment_id, count(*) AS entries, count(*) FILTER (WHERE present) AS present, CAST(sum(stored_length) AS BIGINT) AS bytes, CAST(coalesce(sum(stored_length) FILTER (WHERE present), 0) AS BIGINT) AS present_bytes FROM offs GROUP BY ALL", OFFS)
def cache_stats(spark, sf_dir):
    rows = _offsets(spark, sf_dir).groupBy("volume_id", "segment_id")
    return rows.agg(F.count("*").alias("entries"), F.count_if("present").alias("present"), F.sum("stored_length").alias("bytes"), F.sum(F.when(F.col("present"), F.col("stored_length")).otherwise(0)).alias("present_bytes"))


@query("SELECT a.volume_id, a.layer AS layer_volume_id, CAST(a.depth AS INT) AS depth, count(DISTINCT e.segment_id) AS segments, count(e.entry_key) AS entries, CAST(coalesce(sum(e.stored_length), 0) AS BIGINT) AS stored_bytes FROM anc a LEFT JOIN fx_entries e ON e.volume_id = a.layer AND e.segment_id <= a.cutoff GROUP BY ALL", LAYERS)
def ancestor_summaries(spark, sf_dir):
    layers = L.layers(fixture(spark, sf_dir, "fx_lineage"))
    per = fixture(spark, sf_dir, "fx_entries").groupBy(F.col("volume_id").alias("layer_volume_id"), "segment_id").agg(F.count("*").alias("n"), F.sum("stored_length").alias("b"))
    rows = layers.join(per, "layer_volume_id", "left").withColumn("fits", F.coalesce(F.col("segment_id") <= F.col("cutoff"), F.lit(False)))
    counted = lambda c: F.sum(F.when(F.col("fits"), F.col(c)).otherwise(0))
    return rows.groupBy("volume_id", "layer_volume_id", "depth").agg(F.count_if("fits").alias("segments"), counted("n").alias("entries"), counted("b").alias("stored_bytes"))


@query("SELECT volume_id, tier, string_agg(CAST(segment_id AS VARCHAR), ',' ORDER BY segment_id) AS segments FROM (SELECT DISTINCT volume_id, tier, segment_id FROM fx_entries) GROUP BY ALL")
def segment_listing(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_entries").groupBy("volume_id", "tier").agg(F.array_join(F.array_sort(F.collect_set("segment_id")), ",").alias("segments"))


@query("SELECT volume_id, segment_id, arg_min(tier, CASE tier WHEN 'wal' THEN 0 WHEN 'pending' THEN 1 WHEN 'gc' THEN 2 ELSE 3 END) AS found_in, CASE WHEN bool_or(tier <> 'index') THEN 'full' ELSE 'body_only' END AS layout FROM (SELECT volume_id, segment_id, tier FROM fx_entries UNION ALL SELECT volume_id, segment_id, 'index' FROM fx_entries WHERE segment_id % 2 = 0) GROUP BY ALL")
def body_places(spark, sf_dir):
    """Where a segment's body is read from: the log, then pending, then gc outputs, then the cache."""
    e = fixture(spark, sf_dir, "fx_entries").select("volume_id", "segment_id", "tier")
    rows = e.unionByName(e.where("segment_id % 2 = 0").withColumn("tier", F.lit("index")))
    rank = F.when(F.col("tier") == "wal", 0).when(F.col("tier") == "pending", 1).when(F.col("tier") == "gc", 2).otherwise(3)
    return rows.groupBy("volume_id", "segment_id").agg(F.min_by("tier", rank).alias("found_in"), F.when(F.bool_or(F.col("tier") != "index"), "full").otherwise("body_only").alias("layout"))


@query("SELECT volume_id, segment_id FROM (SELECT volume_id, segment_id FROM fx_head WHERE section IN ('manifest', 'added') EXCEPT SELECT volume_id, segment_id FROM fx_head WHERE section IN ('superseded', 'tombstoned')) WHERE segment_id % 8 <> 3")
def recovered_segments(spark, sf_dir):
    """The live set without the segments that don't verify (every eighth here): what a synthesised snapshot lists."""
    live = L.live_set(fixture(spark, sf_dir, "fx_head"))
    verified = fixture(spark, sf_dir, "fx_entries").where("segment_id % 8 <> 3").select("volume_id", "segment_id").distinct()
    return live.join(verified, ["volume_id", "segment_id"], "left_semi")


@query("SELECT volume_id, segment_id, max(age_s) AS age_s FROM (SELECT volume_id, segment_id, age_s FROM fx_head WHERE section = 'superseded' UNION ALL SELECT volume_id, segment_id, 0 FROM fx_entries WHERE segment_id % 7 IN (2, 3)) GROUP BY ALL")
def published_supersessions(spark, sf_dir):
    """A tick's new supersessions merged into the head's; an input that is there already keeps its age."""
    old = fixture(spark, sf_dir, "fx_head").where("section = 'superseded'").select("volume_id", "segment_id", "age_s")
    new = fixture(spark, sf_dir, "fx_entries").where("segment_id % 7 IN (2, 3)").select("volume_id", "segment_id", F.lit(0).cast("long").alias("age_s"))
    return old.unionByName(new).groupBy("volume_id", "segment_id").agg(F.max("age_s").alias("age_s"))


@query("SELECT volume_id, i AS ord, top + 1 + i AS reserved, top + 1 + 3 AS flush_id FROM (SELECT volume_id, max(segment_id) AS top FROM fx_entries GROUP BY volume_id), range(3) r(i)")
def reserved_ids(spark, sf_dir):
    """Ids for three rewrite outputs above all that exist, and below the id that the log is flushed under next."""
    top = fixture(spark, sf_dir, "fx_entries").groupBy("volume_id").agg(F.max("segment_id").alias("top"))
    return top.select("volume_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.col("top") + 1 + i)).alias("ord", "reserved"), (F.col("top") + 4).alias("flush_id")).withColumn("ord", F.col("ord").cast("long"))


@query("SELECT volume_id, floor, min(seq) AS first_asked, count(*) AS asked FROM (SELECT w.volume_id, w.seq, max(e.s) AS floor FROM fx_writes w JOIN (SELECT volume_id AS v, seq AS s FROM fx_writes WHERE op <> 'flush' AND seq % 17 = 0) e ON e.v = w.volume_id AND e.s <= w.seq WHERE w.op = 'flush' GROUP BY ALL) GROUP BY volume_id, floor")
def snapshot_floors(spark, sf_dir):
    """Snapshots at flushes: each has the last segment as its floor, and those with nothing new since are one."""
    w = fixture(spark, sf_dir, "fx_writes")
    last = F.max(F.when((F.col("op") != "flush") & (F.col("seq") % 17 == 0), F.col("seq"))).over(Window.partitionBy("volume_id").orderBy("seq"))
    rows = w.withColumn("floor", last).where("op = 'flush' AND floor IS NOT NULL")
    return rows.groupBy("volume_id", "floor").agg(F.min("seq").alias("first_asked"), F.count("*").alias("asked"))


@query("SELECT child_id, parent_id, branch_id FROM fx_lineage UNION ALL SELECT volume_id || '-fork', volume_id, max(snap_id) FROM fx_snapshots GROUP BY volume_id")
def forked_lineage(spark, sf_dir):
    """Lineage after a fork of every volume at its latest snapshot."""
    new = fixture(spark, sf_dir, "fx_snapshots").groupBy("volume_id").agg(F.max("snap_id").alias("branch_id"))
    return fixture(spark, sf_dir, "fx_lineage").unionByName(new.select(F.concat("volume_id", F.lit("-fork")).alias("child_id"), F.col("volume_id").alias("parent_id"), "branch_id"))


# Fragments of files on the mapped blocks.
FRAG = "fr AS (SELECT 'f' || p_partkey % 40 AS path, p_partkey // 40 * 4096 AS file_offset, 'v' || p_partkey % 4 AS volume_id, p_partkey * 37 % 2048 AS lba_start, p_size * 100 AS byte_count FROM part)"


@query("SELECT f.path, f.file_offset, w.hash, CAST(f.byte_count AS BIGINT) AS byte_count FROM fr f JOIN won w ON w.volume_id = f.volume_id AND w.lba = f.lba_start", VIS, BLOCKS, FRAG)
def generated_filemap(spark, sf_dir):
    """A file map from a snapshot: the content at each fragment's first block; fragments on unmapped blocks are left out."""
    k = F.col("p_partkey")
    fragments = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), (k % 40).cast("string")).alias("path"), (F.expr("p_partkey div 40") * 4096).alias("file_offset"), F.concat(F.lit("v"), (k % 4).cast("string")).alias("volume_id"), (k * 37 % 2048).alias("lba_start"), (F.col("p_size") * 100).cast("long").alias("byte_count"))
    runs = M.live_map(spark, sf_dir)
    spans = runs.select("volume_id", F.col("start_lba").alias("run_start"), (F.col("start_lba") + F.col("lba_length")).alias("run_end"), "hash")
    return point_join(fragments, spans, ["volume_id"], "lba_start", ("run_start", "run_end")).select("path", "file_offset", "hash", "byte_count")


@query("SELECT h2.path, h2.hash, CASE WHEN h2.hash IN (SELECT hash FROM h1) THEN 'dedup_ref' WHEN h2.bytes < 256 THEN 'inline' ELSE 'data' END AS kind FROM h2", HASHED)
def import_entries(spark, sf_dir):
    """Entries of an imported image: what the parent's index has becomes a reference."""
    one, two = _images(spark, sf_dir)
    known = one.select("hash").distinct().withColumn("known", F.lit(True))
    kind = F.when(F.col("known"), "dedup_ref").when(F.col("bytes") < 256, "inline").otherwise("data")
    return two.join(known, "hash", "left").select("path", "hash", kind.alias("kind"))


@query("SELECT outcome, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT bytes, CASE WHEN bytes % 29 = 0 THEN 'missing' WHEN bytes % 37 = 5 THEN 'mismatch' ELSE 'ok' END AS outcome FROM h1) GROUP BY outcome", HASHED)
def verified_bodies(spark, sf_dir):
    """Bodies against their recorded hashes: ok, mismatch or missing, by count and bytes."""
    image = fixture(spark, sf_dir, "fx_image1")
    n = F.octet_length("content").cast("long")
    recorded = I.hashed(image).select("path", F.when(F.col("bytes") % 37 == 5, F.lit("0" * 64)).otherwise(F.col("hash")).alias("recorded"), "bytes")
    bodies = image.where(n % 29 != 0).select("path", F.sha2("content", 256).alias("found"))
    rows = recorded.join(bodies, "path", "left")
    outcome = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("recorded"), "ok").otherwise("mismatch")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("SELECT a.volume_id, x.segment_id, string_agg(CAST(x.entry_idx AS VARCHAR), ',' ORDER BY x.entry_idx) AS entries FROM (SELECT DISTINCT volume_id FROM ext) a JOIN ext x USING (volume_id) JOIN lh l ON l.volume_id = x.volume_id AND l.hash = x.hash WHERE x.kind IN ('data', 'canonical_data') AND x.entry_key % 7 = 3 GROUP BY ALL", *CORE)
def full_warm_work(spark, sf_dir):
    """Bodies to fetch for a full warm-up: owned by a segment, live, not inline, and absent."""
    rows, runs, extents, _ = M._core(spark, sf_dir)
    wanted = extents.where("kind IN ('data', 'canonical_data')").join(X.live_hashes(runs, rows), ["volume_id", "hash"], "left_semi")
    absent = _offsets(spark, sf_dir).where("NOT present").select("entry_key")
    return wanted.join(absent, "entry_key", "left_semi").groupBy("volume_id", "segment_id").agg(F.array_join(F.array_sort(F.collect_set("entry_idx")), ",").alias("entries"))


@query("SELECT a.volume_id, e.segment_id, a.layer AS owner, row_number() OVER (PARTITION BY a.volume_id ORDER BY a.depth, e.segment_id) - 1 AS position FROM anc a JOIN (SELECT DISTINCT volume_id, segment_id FROM fx_entries WHERE segment_id % 3 = 0) e ON e.volume_id = a.layer AND e.segment_id <= a.cutoff", LAYERS)
def prefetch_order(spark, sf_dir):
    """Segments with a hint (every third here) over a volume's ancestry: the head's first, then its ancestors'."""
    hinted = fixture(spark, sf_dir, "fx_entries").where("segment_id % 3 = 0").select(F.col("volume_id").alias("layer_volume_id"), "segment_id").distinct()
    rows = L.layers(fixture(spark, sf_dir, "fx_lineage")).join(hinted, "layer_volume_id").where("segment_id <= cutoff")
    return positions(rows, F.col("depth"), F.col("segment_id")).select("volume_id", "segment_id", F.col("layer_volume_id").alias("owner"), "position")


@query("SELECT a.volume_id, count(*) AS listed, count(*) FILTER (WHERE e.segment_id % 5 <> 0) AS skipped, count(*) FILTER (WHERE e.segment_id % 5 = 0) AS to_fetch FROM anc a JOIN (SELECT DISTINCT volume_id, segment_id FROM fx_entries) e ON e.volume_id = a.layer AND e.segment_id <= a.cutoff GROUP BY a.volume_id", LAYERS)
def prefetch_counts(spark, sf_dir):
    """Index files over a volume's ancestry: listed, there already, and to be fetched."""
    segments = fixture(spark, sf_dir, "fx_entries").select(F.col("volume_id").alias("layer_volume_id"), "segment_id").distinct()
    local = segments.where("segment_id % 5 <> 0").withColumn("here", F.lit(True))
    rows = L.layers(fixture(spark, sf_dir, "fx_lineage")).join(segments, "layer_volume_id").where("segment_id <= cutoff").join(local, ["layer_volume_id", "segment_id"], "left")
    return rows.groupBy("volume_id").agg(F.count("*").alias("listed"), F.count("here").alias("skipped"), (F.count("*") - F.count("here")).alias("to_fetch"))


@query("SELECT id, CASE WHEN id % 6 = 0 THEN 'not_released' WHEN id % 4 = 1 THEN 'fork_mismatch' ELSE 'reclaimed' END AS outcome FROM (SELECT c_custkey AS id FROM customer)")
def reclaimed_names(spark, sf_dir):
    """A released name taken back in place: only while it is released, and only by the fork that released it."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 6 == 0, "live").otherwise("released").alias("state"), (k % 9).alias("vol"), F.when(k % 4 == 1, 99).otherwise(k % 9).alias("local_vol"))
    return rows.select("id", F.when(O.transition(F.col("state"), F.lit("claim")) != "proceed", "not_released").when(F.col("vol") != F.col("local_vol"), "fork_mismatch").otherwise("reclaimed").alias("outcome"))


@query("SELECT sub AS name, CASE WHEN seq = f THEN 'created' ELSE 'exists' END AS outcome, seq, CASE WHEN seq = f AND seq % 3 = 0 THEN 'readonly' WHEN seq = f THEN 'live' END AS state FROM (SELECT event_id AS seq, 'n' || user_id % 300 AS sub, min(event_id) OVER (PARTITION BY user_id % 300) AS f FROM events WHERE event_type = 'signup')")
def created_names(spark, sf_dir):
    """Names created if absent, some of them readonly: of several creations the first wins."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").where("event_type = 'signup'").select(k.alias("seq"), F.concat(F.lit("n"), (F.col("user_id") % 300).cast("string")).alias("key"))
    done = R.put_if(rows.select("key", F.lit(0).alias("version")).limit(0), rows.withColumn("expects", F.lit(None).cast("int")))
    won = F.col("outcome") == "written"
    return done.select(F.col("key").alias("name"), F.when(won, "created").otherwise("exists").alias("outcome"), "seq", F.when(won, F.when(F.col("seq") % 3 == 0, "readonly").otherwise("live")).alias("state"))


HAND = "hn AS (SELECT o_orderkey AS id, 'g' || o_orderkey % 30 AS dir, CASE o_orderkey % 4 WHEN 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 26, '0') || '.plan' WHEN 1 THEN lpad(CAST(o_orderkey - 1 AS VARCHAR), 26, '0') WHEN 2 THEN lpad(CAST(o_orderkey AS VARCHAR), 26, '0') || '.tmp' ELSE 'notes.txt' END AS name FROM orders WHERE o_orderkey % 8 < 5)"


@query("SELECT p.dir, p.name, b.name IS NOT NULL AS applied FROM (SELECT DISTINCT dir, name FROM hn WHERE name LIKE '%.plan') p LEFT JOIN (SELECT DISTINCT name FROM hn) b ON b.name = replace(p.name, '.plan', '')", HAND)
def plan_handoffs(spark, sf_dir):
    """Plan files that wait, and whether their output is there already, so that they are only to be removed."""
    files = _handoffs(spark, sf_dir)
    plans = files.where("name LIKE '%.plan'").select("dir", "name", F.regexp_replace("name", r"\.plan$", "").alias("output")).distinct()
    there = files.select(F.col("name").alias("output"), F.lit(True).alias("there")).distinct()
    return plans.join(there, "output", "left").select("dir", "name", F.coalesce("there", F.lit(False)).alias("applied"))


@query("SELECT dir, bool_or(name LIKE '%.plan' OR (name NOT LIKE '%.%' AND length(name) = 26)) AS pending FROM hn GROUP BY dir", HAND)
def handoffs_in_flight(spark, sf_dir):
    """Whether a volume has a rewrite in flight, which holds back the next one."""
    waits = F.col("name").like("%.plan") | (~F.contains(F.col("name"), F.lit(".")) & (F.length("name") == 26))
    return _handoffs(spark, sf_dir).groupBy("dir").agg(F.bool_or(waits).alias("pending"))


def _handoffs(spark, sf_dir):
    k = F.col("o_orderkey")
    padded = lambda n: F.lpad(n.cast("string"), 26, "0")
    name = F.when(k % 4 == 0, F.concat(padded(k), F.lit(".plan"))).when(k % 4 == 1, padded(k - 1)).when(k % 4 == 2, F.concat(padded(k), F.lit(".tmp"))).otherwise("notes.txt")
    return table(spark, sf_dir, "orders").where("o_orderkey % 8 < 5").select(k.alias("id"), F.concat(F.lit("g"), (k % 30).cast("string")).alias("dir"), name.alias("name"))


DIRS = "dr AS (SELECT o_orderkey AS inode, CASE WHEN o_orderkey = 0 THEN NULL ELSE o_orderkey // 6 END AS parent, 'e' || o_orderkey % 10 AS name FROM orders WHERE o_orderkey < 400 UNION ALL SELECT 399, 5, 'hard'), /*recursive*/ wl AS (SELECT inode, '' AS path FROM dr WHERE parent IS NULL UNION ALL SELECT d.inode, w.path || '/' || d.name FROM wl w JOIN dr d ON d.parent = w.inode)"


@query("SELECT inode, min(path) AS path, count(*) AS links FROM wl GROUP BY inode", DIRS)
def inode_paths(spark, sf_dir):
    """Paths of inodes from a directory tree, level by level; of several names the first in order."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").where("o_orderkey < 400").select(k.alias("inode"), F.when(k > 0, F.expr("o_orderkey div 6")).alias("parent"), F.concat(F.lit("e"), (k % 10).cast("string")).alias("name"))
    rows = rows.unionByName(spark.createDataFrame([(399, 5, "hard")], "inode long, parent long, name string"))
    return tree_paths(rows).groupBy("inode").agg(F.min("path").alias("path"), F.count("*").alias("links"))


@query("SELECT h2.path, h2.hash, coalesce(o.path, '') AS source_path FROM h2 LEFT JOIN (SELECT hash, min(path) AS path FROM h1 GROUP BY hash) o ON o.hash = h2.hash", HASHED)
def extent_paths(spark, sf_dir):
    """Where the other image has a file's content; an empty path if nowhere."""
    one, two = _images(spark, sf_dir)
    return two.join(one.groupBy("hash").agg(F.min("path").alias("source")), "hash", "left").select("path", "hash", F.coalesce("source", F.lit("")).alias("source_path"))


@query("SELECT mode, string_agg(volume_id, ',' ORDER BY volume_id) AS volumes FROM (SELECT 'all' AS mode, volume_id FROM vl UNION ALL SELECT 'readonly', volume_id FROM vl WHERE ro UNION ALL SELECT 'writable', volume_id FROM vl WHERE NOT ro UNION ALL SELECT DISTINCT 'with_ancestors', layer FROM anc WHERE volume_id = 'v2') GROUP BY mode", LAYERS, "vl AS (SELECT DISTINCT volume_id, volume_id IN ('v0', 'v1') AS ro FROM fx_entries)")
def volume_lists(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_entries").select("volume_id", F.col("volume_id").isin("v0", "v1").alias("ro")).distinct()
    family = L.layers(fixture(spark, sf_dir, "fx_lineage")).where("volume_id = 'v2'").select(F.lit("with_ancestors").alias("mode"), F.col("layer_volume_id").alias("volume_id")).distinct()
    modes = F.explode(F.array(F.lit("all"), F.when(F.col("ro"), "readonly").otherwise("writable"))).alias("mode")
    return rows.select(modes, "volume_id").unionByName(family).groupBy("mode").agg(F.array_join(F.array_sort(F.collect_set("volume_id")), ",").alias("volumes"))


@query("SELECT volume_id, segment_id, entry_idx, kind, hash, start_lba, lba_length, stored_length, row_number() OVER (ORDER BY volume_id, segment_id, entry_idx) AS line FROM fx_entries WHERE segment_id < 2")
def segment_dump(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_entries").where("segment_id < 2")
    line = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("volume_id", "segment_id", "entry_idx"))  # a dump of two segments
    return rows.select("volume_id", "segment_id", "entry_idx", "kind", "hash", "start_lba", "lba_length", "stored_length", line.alias("line"))


@query("SELECT op, action, count(*) AS n FROM (SELECT op, CASE op WHEN 'flush' THEN 'promote' WHEN 'zero' THEN 'trim' ELSE 'commit' END AS action FROM fx_writes) GROUP BY ALL")
def dispatched(spark, sf_dir):
    """What block-device requests become."""
    action = F.when(F.col("op") == "flush", "promote").when(F.col("op") == "zero", "trim").otherwise("commit")
    return fixture(spark, sf_dir, "fx_writes").groupBy("op", action.alias("action")).agg(F.count("*").alias("n"))


@query("SELECT entry_key, present FROM offs WHERE entry_idx % 4 = 0", OFFS)
def presence_tests(spark, sf_dir):
    """Bits of the presence sets, read back from their bytes, for some entries."""
    rows = _offsets(spark, sf_dir)
    bits = rows.where("present").groupBy("volume_id", "segment_id", F.expr("entry_idx div 8").alias("byte")).agg(F.sum(F.expr("shiftleft(1, cast(entry_idx % 8 AS INT))")).alias("bits"))
    asked = rows.where("entry_idx % 4 = 0").withColumn("byte", F.expr("entry_idx div 8"))
    found = asked.join(bits, ["volume_id", "segment_id", "byte"], "left")
    return found.select("entry_key", W.bit_set(F.coalesce("bits", F.lit(0)), F.col("entry_idx") % 8).alias("present"))
