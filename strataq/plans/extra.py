"""Queries of predicates, matching joins and codecs; each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataq.functions import codecs as C
from strataq.functions import predicates as P
from strataq.operators import images as I
from strataq.operators import lineage as L
from strataq.operators import matching as M
from strataq.plans.maps import LAYERS
from strataq.plans.more import HASHED
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


@query("SELECT entry_key, kind IN ('data', 'inline', 'canonical_data', 'canonical_inline') AS has_body, kind NOT IN ('canonical_data', 'canonical_inline') AS claims, CASE WHEN stored_length < 256 THEN 'inline' ELSE 'data' END AS body_kind FROM fx_entries")
def kind_predicates(spark, sf_dir):
    kind = F.col("kind")
    return fixture(spark, sf_dir, "fx_entries").select("entry_key", P.has_body(kind).alias("has_body"), P.claims_blocks(kind).alias("claims"), P.body_kind(F.col("stored_length")).alias("body_kind"))


LITERALS = ["7", "4G", "4GB", " 4G ", "4 G", "512M", "64KB", "2T", "4X", "", "G", "-1", "99999999999999999999", "+3K", "1.5G"]
SIZES = [7, 4 << 30, 4 << 30, 4 << 30, 4 << 30, 512 << 20, 64 << 10, 2 << 40, None, None, None, None, None, 3 << 10, None]


@query("SELECT p_partkey, ['" + "', '".join(LITERALS) + "'][1 + p_partkey % " + str(len(LITERALS)) + "] AS literal, CAST([" + ", ".join("NULL" if x is None else str(x) for x in SIZES) + "][1 + p_partkey % " + str(len(LITERALS)) + "] AS BIGINT) AS bytes FROM part")
def size_literals(spark, sf_dir):
    literal = F.element_at(F.array(*map(F.lit, LITERALS)), (F.col("p_partkey") % len(LITERALS) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", literal.alias("literal"), P.size_literal(literal).alias("bytes"))


@query("SELECT c_custkey, length(n) > 0 AND regexp_replace(n, '[a-zA-Z0-9._-]', '', 'g') = '' AND n NOT IN ('status', 'attach') AS valid FROM (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '-' || replace(c_name, '#', '_') WHEN 1 THEN repeat('n', 100) WHEN 2 THEN 'attach' WHEN 3 THEN replace(c_name, '#', '-') || chr(10) WHEN 4 THEN c_name ELSE '' END AS n FROM customer)")
def valid_names(spark, sf_dir):
    k = F.col("c_custkey") % 6
    name = F.when(k == 0, F.concat(F.lit("-"), F.replace("c_name", F.lit("#"), F.lit("_")))).when(k == 1, F.lit("n" * 100)).when(k == 2, "attach").when(k == 3, F.concat(F.replace("c_name", F.lit("#"), F.lit("-")), F.lit("\n"))).when(k == 4, F.col("c_name")).otherwise("")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", P.valid_name(name).alias("valid"))


@query("SELECT event_id, (CASE WHEN f & 1 <> 0 THEN 4 ELSE 0 END) + (CASE WHEN f & 2 <> 0 THEN 8 ELSE 0 END) + (CASE WHEN f & 4 <> 0 THEN 16 ELSE 0 END) AS flags, abs(i - 1000) <= 60 AS fresh, i + 600 <= 1000 AS expired FROM (SELECT event_id, event_id % 8 AS f, 900 + event_id % 200 AS i FROM events)")
def flags_and_ages(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % 8).alias("f"), (F.col("event_id") % 200 + 900).alias("i"))
    return rows.select("event_id", P.segment_flags(F.col("f")).alias("flags"), P.fresh(F.col("i"), F.lit(1000)).alias("fresh"), P.expired(F.col("i"), F.lit(1000)).alias("expired"))


@query("SELECT user_id, CASE WHEN user_id % 6 = 0 THEN 'fetched' WHEN user_id % 3 = 0 THEN 'released' WHEN user_id % 5 = 0 THEN 'readonly' WHEN user_id % 7 = 0 THEN 'importing' WHEN user_id % 11 = 0 THEN 'running' ELSE 'stopped' END AS state FROM (SELECT DISTINCT user_id FROM events)")
def lifecycle_states(spark, sf_dir):
    u = F.col("user_id")
    markers = {"fetched": u % 6 == 0, "released": u % 3 == 0, "readonly": u % 5 == 0, "importing": u % 7 == 0, "running": u % 11 == 0}
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().select("user_id", P.lifecycle(markers).alias("state"))


NAMES = "nm AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'live' WHEN 1 THEN 'stopped' WHEN 2 THEN 'released' WHEN 3 THEN 'readonly' END AS state, CASE WHEN c_custkey % 7 > 0 THEN 'c' || c_custkey % 3 END AS owner, c_custkey % 2 = 0 AS stopped, c_custkey % 3 = 0 AS released FROM customer)"


def _names(spark, sf_dir):
    k = F.col("c_custkey")
    state = F.when(k % 5 == 0, "live").when(k % 5 == 1, "stopped").when(k % 5 == 2, "released").when(k % 5 == 3, "readonly")
    owner = F.when(k % 7 > 0, F.concat(F.lit("c"), (k % 3).cast("string")))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("id"), state.alias("state"), owner.alias("owner"), (k % 2 == 0).alias("stopped"), (k % 3 == 0).alias("released"))


@query("SELECT id, CASE WHEN state IS NULL THEN 'absent' WHEN state IN ('released', 'readonly') THEN state WHEN owner = 'c1' THEN 'mine' ELSE 'other' END AS position, CASE WHEN state IN ('live', 'stopped') THEN coalesce(owner, '<unknown>') END AS owner, CASE WHEN state IS NULL THEN NULL WHEN state = 'released' THEN 'released-claimable' WHEN state = 'readonly' THEN 'readonly' WHEN owner = 'c1' THEN 'owned' ELSE 'foreign' END AS eligibility, CASE WHEN state IS NULL THEN 'none' WHEN state IN ('live', 'stopped') AND owner = 'c1' THEN 'owner' ELSE 'observer' END AS role FROM nm", NAMES)
def name_positions(spark, sf_dir):
    rows, me = _names(spark, sf_dir), F.lit("c1")
    position = P.ownership(F.col("state"), F.col("owner"), me)
    return rows.select("id", position.alias("position"), P.owner_name(F.col("state"), F.col("owner")).alias("owner"), P.eligibility(F.col("state"), F.col("owner"), me).alias("eligibility"), P.role(position).alias("role"))


@query("SELECT id, CASE WHEN state = 'released' THEN concat_ws(',', CASE WHEN NOT released THEN 'write released' END, CASE WHEN stopped THEN 'remove stopped' END) WHEN owner IS DISTINCT FROM 'c1' THEN '' WHEN state = 'live' THEN concat_ws(',', CASE WHEN stopped THEN 'remove stopped' END, CASE WHEN released THEN 'remove released' END) WHEN state = 'stopped' THEN concat_ws(',', CASE WHEN NOT stopped THEN 'write stopped' END, CASE WHEN released THEN 'remove released' END) ELSE '' END AS action FROM nm", NAMES)
def marker_actions(spark, sf_dir):
    return _names(spark, sf_dir).select("id", P.marker_action(F.col("state"), F.col("owner"), F.lit("c1"), F.col("stopped"), F.col("released")).alias("action"))


@query("SELECT k AS id, CASE WHEN n >= 1073741824 THEN printf('%.2f GiB', n / 1073741824.0::DOUBLE) WHEN n >= 1048576 THEN printf('%.1f MiB', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN printf('%.1f KiB', n / 1024.0::DOUBLE) ELSE n || ' B' END AS shown, format('{:,}', n) AS commas FROM (SELECT o_orderkey AS k, o_orderkey * o_orderkey * 977 AS n FROM orders)")
def formatted_sizes(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * F.col("o_orderkey") * 977).alias("n"))
    return rows.select("id", P.size_text(F.col("n")).alias("shown"), F.format_number("n", 0).alias("commas"))


FILES = "fl AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN u || '.manifest' WHEN 1 THEN u || '-stop.manifest' WHEN 2 THEN u || '.idx' WHEN 3 THEN lower(u) || '.manifest' ELSE 'U' || u || '.manifest' END AS name, u FROM (SELECT p_partkey, '01ARZ3NDEKTSV4RRFFQ' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 7, '0') AS u FROM part))"


@query("SELECT id, CASE WHEN id % 5 < 2 THEN u END AS snapshot, CASE id % 5 WHEN 0 THEN 'user' WHEN 1 THEN 'stop' END AS kind FROM fl", FILES)
def snapshot_files(spark, sf_dir):
    k = F.col("p_partkey")
    u = F.concat(F.lit("01ARZ3NDEKTSV4RRFFQ"), F.lpad((k % 1000).cast("string"), 7, "0"))
    name = F.when(k % 5 == 0, F.concat(u, F.lit(".manifest"))).when(k % 5 == 1, F.concat(u, F.lit("-stop.manifest"))).when(k % 5 == 2, F.concat(u, F.lit(".idx"))).when(k % 5 == 3, F.concat(F.lower(u), F.lit(".manifest"))).otherwise(F.concat(F.lit("U"), u, F.lit(".manifest")))
    snapshot, kind = P.snapshot_file(name)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("id"), snapshot.alias("snapshot"), kind.alias("kind"))


@query("SELECT a.volume_id, segment_id, arg_min(a.layer, a.depth) AS owner FROM anc a JOIN (SELECT DISTINCT volume_id AS v, segment_id FROM fx_entries) s ON s.v = a.layer AND s.segment_id <= a.cutoff GROUP BY a.volume_id, segment_id", LAYERS)
def segment_owners(spark, sf_dir):
    return M.first_owner(L.layers(fixture(spark, sf_dir, "fx_lineage")), fixture(spark, sf_dir, "fx_entries"))


@query("SELECT seq, sub, CASE WHEN seq = f THEN 'created' WHEN pubkey = k THEN 'idempotent' ELSE 'conflict' END AS outcome FROM (SELECT *, first_value(seq) OVER w AS f, first_value(pubkey) OVER w AS k FROM (SELECT event_id AS seq, 's' || user_id % 50 AS sub, event_type AS pubkey FROM events) WINDOW w AS (PARTITION BY sub ORDER BY seq))")
def enrolments(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), F.concat(F.lit("s"), (F.col("user_id") % 50).cast("string")).alias("sub"), F.col("event_type").alias("pubkey"))
    return M.enrol(rows)


@query("SELECT pubkey, sub, owners FROM (SELECT DISTINCT md5(CAST(o_custkey % 97 AS VARCHAR)) AS pubkey, CAST(o_custkey AS VARCHAR) AS sub FROM orders) JOIN (SELECT md5(CAST(o_custkey % 97 AS VARCHAR)) AS pubkey, count(DISTINCT o_custkey) AS owners FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) > 1) USING (pubkey)")
def shared_keys(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.md5((F.col("o_custkey") % 97).cast("string").cast("binary")).alias("pubkey"), F.col("o_custkey").cast("string").alias("sub"))
    return M.shared_keys(rows, "pubkey", "sub")


@query("SELECT name, event_ulid, v, hb AS highest_before FROM (SELECT *, max(v) OVER (PARTITION BY name ORDER BY event_ulid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hb FROM (SELECT name, event_ulid, event_ulid - event_ulid % 7 * 50 AS v FROM fx_events)) WHERE v <= hb")
def monotonic_violations(spark, sf_dir):
    rows = fixture(spark, sf_dir, "fx_events").withColumn("v", F.col("event_ulid") - F.col("event_ulid") % 7 * 50)
    return M.recorded_order(rows, "name", "event_ulid", "v")


@query("SELECT CASE WHEN exact THEN 'exact' WHEN path IS NULL THEN 'unmapped' WHEN path IN (SELECT path FROM h1) THEN 'changed' ELSE 'new' END AS class, count(*) AS reads, CAST(sum(byte_count) AS BIGINT) AS bytes FROM (SELECT t.hash, t.byte_count, t.hash IN (SELECT hash FROM h1) AS exact, p.path FROM (SELECT CASE WHEN bytes % 17 = 0 THEN 'gone' ELSE hash END AS hash, bytes AS byte_count FROM h2) t LEFT JOIN (SELECT hash, min(path) AS path FROM h2 GROUP BY hash) p ON p.hash = t.hash) GROUP BY 1", HASHED)
def cold_boot_trace(spark, sf_dir):
    one, two = (I.hashed(fixture(spark, sf_dir, f"fx_image{i}")) for i in (1, 2))
    trace = two.select(F.when(F.col("bytes") % 17 == 0, "gone").otherwise(F.col("hash")).alias("hash"), F.col("bytes").alias("byte_count"))
    return M.trace_cost(trace, one, two)


def _changed(spark, sf_dir):
    one, two = (fixture(spark, sf_dir, f"fx_image{i}") for i in (1, 2))
    return one.select("path", F.col("content").cast("binary").alias("old")).join(two.select("path", F.col("content").cast("binary").alias("new")), "path").where("old <> new")


@query()
def delta_benefit(spark, sf_dir):
    """Sizes of changed files alone, packed, gated and as deltas against the old file; each delta is also undone and compared."""
    rows = _changed(spark, sf_dir)
    return rows.select("path", F.octet_length("new").alias("raw"), C.packed_size("new").alias("packed"), C.gated_size("new").alias("gated"), C.delta_size("old", "new").alias("delta"), C.delta_round_trip("old", "new").alias("exact"))


@query("SELECT k AS id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a END AS first, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b END AS last FROM (SELECT k, TRY_CAST(nullif(regexp_extract(h, '^bytes=([0-9]+)-([0-9]+)$', 1), '') AS BIGINT) AS a, TRY_CAST(nullif(regexp_extract(h, '^bytes=([0-9]+)-([0-9]+)$', 2), '') AS BIGINT) AS b FROM (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN 'bytes=' || p_size ELSE 'bytes=' || p_size || '-' || (p_size + p_partkey) END AS h FROM part))")
def byte_ranges(spark, sf_dir):
    from strataq.sources.text import byte_range

    size = F.col("p_size").cast("string")
    header = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("bytes="), size)).otherwise(F.concat(F.lit("bytes="), size, F.lit("-"), (F.col("p_size") + F.col("p_partkey")).cast("string")))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), header.alias("h"))
    first, last = byte_range("h")
    return rows.select("id", first.alias("first"), last.alias("last"))
