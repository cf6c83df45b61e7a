"""Derived tables: one SQL text each for Spark and DuckDB, from the driver tables. Only equality of the hashes matters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

TEXTS = {
    "fx_entries": """
WITH m AS (SELECT max(o_orderkey) AS mx FROM orders),
a AS (SELECT o_orderkey AS k, 'v' || CAST(o_orderkey % 4 AS STRING) AS volume_id,
             CAST(floor(o_orderkey / 64.0) AS BIGINT) AS segment_id,
             (o_orderkey * 7919) % 211 AS c, (o_orderkey * 104729) % 2048 AS lba,
             CASE WHEN CAST(floor(o_orderkey / 64.0) AS BIGINT) * 64 >= mx * 0.9 THEN 'pending'
                  WHEN CAST(floor(o_orderkey / 64.0) AS BIGINT) % 16 = 15 THEN 'gc' ELSE 'index' END AS tier
      FROM orders CROSS JOIN m),
b AS (SELECT *, 1 + c % 8 AS len, md5('b' || CAST(c AS STRING)) AS h,
             row_number() OVER (PARTITION BY volume_id, segment_id ORDER BY k) - 1 AS entry_idx,
             row_number() OVER (PARTITION BY volume_id, c ORDER BY k) AS occ FROM a),
d AS (SELECT *, CASE WHEN k % 13 = 0 THEN 'zero' WHEN k % 29 = 0 THEN 'canonical_data'
                     WHEN k % 31 = 0 THEN 'delta' WHEN occ > 1 THEN 'dedup_ref'
                     WHEN c % 11 = 0 THEN 'inline' ELSE 'data' END AS kind FROM b)
SELECT k AS entry_key, volume_id, segment_id, tier, CAST(entry_idx AS BIGINT) AS entry_idx, kind,
       CASE WHEN kind = 'zero' THEN '00000000000000000000000000000000' ELSE h END AS hash,
       CASE WHEN kind = 'canonical_data' THEN CAST(0 AS BIGINT) ELSE lba END AS start_lba,
       CASE WHEN kind = 'canonical_data' THEN CAST(0 AS BIGINT) ELSE len END AS lba_length,
       (kind IN ('data','canonical_data') AND c % 3 = 0) AS compressed,
       CASE WHEN kind = 'inline' THEN CAST(200 AS BIGINT)
            WHEN kind IN ('data','canonical_data') AND c % 3 = 0 THEN len * 1500
            WHEN kind IN ('data','canonical_data') THEN len * 4096 ELSE CAST(0 AS BIGINT) END AS stored_length,
       CASE WHEN kind = 'delta' THEN md5('b' || CAST((c + 1) % 211 AS STRING)) END AS source_hash
FROM d""",
    "fx_inputs": """
SELECT DISTINCT e.volume_id, e.segment_id AS output_id, e.segment_id - i.d AS input_id
FROM fx_entries e CROSS JOIN (SELECT CAST(1 AS BIGINT) AS d UNION ALL SELECT CAST(2 AS BIGINT)) i
WHERE e.tier = 'gc'""",
    "fx_snapshots": """
SELECT volume_id, CAST(floor(max(segment_id) * 0.25) AS BIGINT) AS snap_id FROM fx_entries GROUP BY volume_id
UNION ALL
SELECT volume_id, CAST(floor(max(segment_id) * 0.5) AS BIGINT) FROM fx_entries GROUP BY volume_id""",
    "fx_lineage": """
SELECT c.child_id, c.parent_id, CAST(floor(m.mx * c.f) AS BIGINT) AS branch_id
FROM (SELECT 'v1' AS child_id, 'v0' AS parent_id, 0.5 AS f UNION ALL SELECT 'v2','v1',0.25 UNION ALL SELECT 'v3','v0',0.75) c
CROSS JOIN (SELECT max(segment_id) AS mx FROM fx_entries) m""",
    "fx_requests": """
SELECT p_partkey AS request_id, 'v' || CAST(p_partkey % 4 AS STRING) AS volume_id,
       (p_partkey * 53) % 2048 AS start_lba, (p_partkey * 53) % 2048 + 1 + p_size % 16 AS end_lba FROM part""",
    "fx_writes": """
SELECT event_id AS seq, 'w' || CAST(user_id % 4 AS STRING) AS volume_id, user_id % 64 AS lba,
       CASE WHEN event_id % 50 = 49 THEN 'flush' WHEN event_type = 'error' THEN 'zero' ELSE 'write' END AS op,
       CASE WHEN event_id % 50 = 49 THEN NULL WHEN event_type = 'error' THEN '00000000000000000000000000000000'
            ELSE md5(event_type || CAST(CAST(floor(value / 100.0) AS BIGINT) AS STRING)) END AS hash FROM events""",
    "fx_image1": """
SELECT source || '/' || lang || '/' || CAST(doc_id AS STRING) AS path, text AS content FROM documents WHERE doc_id % 10 <> 9""",
    "fx_image2": """
SELECT source || '/' || lang || '/' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 10 = 8 THEN '.moved' ELSE '' END AS path,
       CASE WHEN doc_id % 10 = 6 THEN text || '!' WHEN doc_id % 10 = 7 THEN '#' || text ELSE text END AS content
FROM documents WHERE doc_id % 10 <> 5""",
    "fx_verbs": """
SELECT event_id AS seq, 'n' || CAST(user_id % 20 AS STRING) AS name, 'c' || CAST(user_id % 3 AS STRING) AS actor,
       CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'stop' WHEN 'purchase' THEN 'release'
                       WHEN 'signup' THEN 'claim' ELSE 'force-release' END AS verb FROM events""",
    "fx_events": """
WITH a AS (SELECT event_id, 'n' || CAST(user_id % 20 AS STRING) AS name, event_type, ts,
  lag(event_id, 1) OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS p1,
  lag(event_id, 2) OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS p2 FROM events)
SELECT event_id AS event_ulid, name, event_type AS kind, ts AS at, CASE WHEN event_id % 97 = 0 THEN p2 ELSE p1 END AS prev_event_ulid FROM a""",
    "fx_head": """
WITH s AS (SELECT DISTINCT volume_id, segment_id FROM fx_entries), m AS (SELECT max(segment_id) AS mx FROM s)
SELECT volume_id, segment_id, CASE WHEN segment_id <= mx * 0.5 THEN 'manifest' ELSE 'added' END AS section, CAST(NULL AS BIGINT) AS age_s FROM s CROSS JOIN m
UNION ALL SELECT volume_id, segment_id, 'superseded', (segment_id * 37) % 1200 FROM s WHERE segment_id % 7 = 3
UNION ALL SELECT volume_id, segment_id, 'tombstoned', CAST(NULL AS BIGINT) FROM s WHERE segment_id % 11 = 5""",
    "fx_caveats": """
SELECT c_custkey AS token_id, CAST(p.pos AS BIGINT) AS pos, p.name,
  CASE p.name WHEN 'aud' THEN CASE WHEN c_custkey % 17 = 0 THEN 'other' ELSE 'engine' END
    WHEN 'role' THEN CASE WHEN p.pos = 4 AND c_custkey % 5 = 0 THEN 'reader' ELSE 'writer' END
    ELSE CAST(1000 + (c_custkey * 31 * p.pos) % 5000 AS STRING) END AS value
FROM customer CROSS JOIN (SELECT 1 AS pos,'aud' AS name UNION ALL SELECT 2,'role' UNION ALL SELECT 3,'exp' UNION ALL SELECT 4,'role' UNION ALL SELECT 5,'exp') p
WHERE NOT (p.pos = 2 AND c_custkey % 23 = 0)""",
}


def needed(text: str) -> list[str]:
    """Names of derived tables that a text reads, directly or not, each after those that it reads itself."""
    found: list[str] = []
    for name in sorted({*re.findall(r"\bfx_\w+", text)} & {*TEXTS}):
        found += [x for x in (*needed(TEXTS[name]), name) if x not in found]
    return found


def duck(text: str, *parts: str) -> str:
    """DuckDB SQL: the derived tables that parts (`name AS (...)`) and text read, then the parts, then the text."""
    ctes = [f"{n} AS ({TEXTS[n]})" for n in needed(" ".join((*parts, text)))]
    every = [*ctes, *parts]
    return ("WITH " + ("RECURSIVE " if "/*recursive*/" in " ".join(parts) else "") + ",\n".join(every) + "\n" if every else "") + text


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the Parquet tables in sf_dir."""
    names = [*needed(TEXTS[name]), name]
    text = " ".join(TEXTS[n] for n in names)
    ctes = [f"{b} AS (SELECT * FROM parquet.`{sf_dir}/{b}.parquet`)" for b in BASES if re.search(rf"\b(FROM|JOIN) {b}\b", text)]
    ctes += [f"{n} AS ({TEXTS[n]})" for n in names[:-1]]
    return spark.sql(f"WITH {', '.join([*ctes, f'{name} AS ({TEXTS[name]})'])} SELECT * FROM {name}")
