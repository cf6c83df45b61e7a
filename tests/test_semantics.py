import pytest
from pyspark.sql import functions as F

from strataq.functions import codecs, predicates
from strataq.operators import extentmap as X
from strataq.operators import lineage, ownership, records, updates, writes

SCHEMA = "entry_key long, volume_id string, segment_id long, tier string, entry_idx long, kind string, hash string, start_lba long, lba_length long, compressed boolean, stored_length long, source_hash string"


def entries(spark, rows):
    """rows: (segment, kind, hash, start, length) of one volume, in order of entries."""
    full = [(i, "v", s, t, i, k, h, a, n, False, n * 4096, None) for i, (s, t, k, h, a, n) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def outcome(spark, rows):
    e = entries(spark, rows)
    runs, ext = X.live_map(e), X.canonical_extents(e)
    found = X.classify(e, runs, ext, X.live_hashes(runs, e)).collect()
    return {r.entry_key: r.outcome for r in found}


def test_dead_owner_of_a_live_reference_becomes_canonical(spark):
    assert outcome(spark, [(1, "index", "data", "A", 0, 1), (2, "index", "dedup_ref", "A", 9, 1), (3, "index", "data", "B", 0, 1)])[0] == "demote_to_canonical"


def test_zero_with_a_hole_splits(spark):
    rows = [(1, "index", "zero", X.ZERO_HASH, 0, 8), (2, "index", "data", "B", 3, 1)]
    e = entries(spark, rows)
    assert [(r.start_lba, r.lba_length) for r in X.live_map(e).where("entry_key = 0").orderBy("start_lba").collect()] == [(0, 3), (4, 4)]
    assert outcome(spark, rows)[0] == "zero_sub_runs"


@pytest.mark.parametrize("at", [0, 3, 7])
def test_partial_overwrite(spark, at):
    assert outcome(spark, [(1, "index", "data", "A", 0, 8), (2, "index", "data", "B", at, 1)])[0] == "partial_with_canonical"


def test_punched_reference_never_gives_a_canonical_body(spark):
    assert outcome(spark, [(1, "index", "data", "A", 50, 4), (2, "index", "dedup_ref", "A", 0, 4), (3, "index", "data", "B", 1, 1)])[1] == "partial"


def test_same_content_at_another_place_does_not_match(spark):
    found = outcome(spark, [(1, "index", "data", "A", 24, 1), (2, "index", "dedup_ref", "A", 25, 1), (3, "index", "data", "B", 25, 1)])
    assert found[0] == "fully_live" and found[1] == "drop"


def test_child_zero_masks_parent_and_later_parent_writes_stay_invisible(spark):
    e = entries(spark, [(1, "index", "data", "A", 0, 4), (9, "index", "data", "C", 0, 4)])
    child = entries(spark, [(3, "index", "zero", X.ZERO_HASH, 1, 1)]).withColumns({"volume_id": F.lit("c"), "entry_key": F.lit(77).cast("long")})
    edges = spark.createDataFrame([("c", "v", 5)], "child_id string, parent_id string, branch_id long")
    found = {(r.start_lba, r.lba_length): r.hash for r in lineage.forked_live_map(e.unionByName(child), edges).where("volume_id = 'c'").collect()}
    assert found == {(0, 1): "A", (1, 1): X.ZERO_HASH, (2, 2): "A"}


def test_gc_output_hides_index_inputs_only(spark):
    e = entries(spark, [(1, "index", "data", "A", 0, 1), (1, "pending", "data", "B", 5, 1), (4, "gc", "data", "C", 0, 1)])
    inputs = spark.createDataFrame([("v", 4, 1)], "volume_id string, output_id long, input_id long")
    assert sorted(r.hash for r in X.visible(e, inputs).collect()) == ["B", "C"]


def test_lineage_cycle_is_refused(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "child_id string, parent_id string, branch_id long")
    with pytest.raises(ValueError):
        lineage.layers(edges)


def test_caveats(spark):
    rows = spark.createDataFrame([(1, "aud", "x"), (1, "aud", "y"), (1, "exp", "5000"), (1, "exp", "3000"), (1, "exp", "9000"), (2, "exp", "soon")], "token_id long, name string, value string")
    got = {r.token_id: r for r in ownership.resolve_caveats(rows, ["aud"]).collect()}
    assert got[1].aud_is == "unsatisfiable" and got[1].aud is None and got[2].aud_is == "absent"
    assert {r.token_id: r.not_after for r in ownership.not_after(rows).collect()} == {1: 3000, 2: None}


def test_gc_buckets_keep_their_caps(spark):
    rows = [("v", i, "small", 10 << 20, 0.9, 1, 0, 10) for i in range(6)] + [("v", 99, "tombstone", 0, 0.0, 0, 0, 0), ("w", 1, "small", 1, 0.9, 1, 0, 1)]
    df = spark.createDataFrame(rows, "volume_id string, segment_id long, class string, live_bytes long, density double, kept_entries long, removed_hashes long, output_entries long")
    found = X.gc_buckets(df).collect()
    sizes = {}
    for r in found:
        sizes.setdefault((r.volume_id, r.bucket), []).append(r.segment_id)
    assert sizes == {("v", 0): [0, 1, 2, 99], ("v", 1): [3, 4, 5]}


def test_rollover_and_bits(spark):
    rows = spark.createDataFrame([("v", i, 40) for i in range(7)], "volume_id string, k long, s long")
    assert [r.log for r in writes.rollovers(rows, "k", "s", 100, 9).orderBy("k").collect()] == [0, 0, 0, 1, 1, 1, 2]
    raw = spark.createDataFrame([("a", bytes([0xA1, 0x02]), 16), ("b", bytes([0xA1, 0x02]), 6), ("c", b"", 4)], "id string, bits binary, n int")
    assert sorted(map(tuple, writes.decode_bits(raw, "bits", "n", ["id"]).collect())) == [("a", 0), ("a", 5), ("a", 7), ("a", 9), ("b", 0), ("b", 5)]


def test_codecs_and_predicates(spark):
    old, new = b"abcdefgh" * 600, b"abcdefgh" * 599 + b"xyz"
    assert codecs.undelta(old, codecs.delta(old, new)) == new
    assert codecs.gate(bytes(4096)) is not None and codecs.gate(bytes(range(256))) is None and codecs.gate(None) is None
    row = spark.range(1).select(predicates.size_literal(F.lit("4G")).alias("a"), predicates.size_literal(F.lit("4X")).alias("b"), predicates.ownership(F.lit("live"), F.lit(None), F.lit("m")).alias("c")).collect()[0]
    assert (row.a, row.b, row.c) == (4 << 30, None, "other")


def test_conditional_inserts(spark):
    """A carry around a newer middle keeps its offsets; a consumed claimant stands in nobody's way."""
    runs = spark.createDataFrame([("v", 10, 2, "N", 7, 0, 1, None), ("v", 20, 4, "O", 5, 3, 2, None)], "volume_id string, start_lba long, lba_length long, hash string, claimant long, payload_block_offset long, entry_key long, source_hash string")
    new = lambda *rows: spark.createDataFrame([("v", i, a, n, h, c, i, None) for i, (a, n, h, c) in enumerate(rows)], "volume_id string, entry_key long, start_lba long, lba_length long, hash string, claimant long, ord long, source_hash string")
    shown = lambda df: sorted((r.start_lba, r.lba_length, r.hash, r.payload_block_offset) for r in df.collect())
    assert shown(updates.insert_if_newer(runs, new((8, 6, "C", 6)))) == [(8, 2, "C", 0), (10, 2, "N", 0), (12, 2, "C", 4), (20, 4, "O", 3)]
    assert shown(updates.insert_if_newer(runs, new((21, 1, "E", 5), (22, 1, "F", 9), (22, 1, "G", 9)))) == [(10, 2, "N", 0), (20, 2, "O", 3), (22, 1, "F", 0), (23, 1, "O", 6)]
    gone = spark.createDataFrame([("v", 7)], "volume_id string, segment_id long")
    assert shown(updates.insert_if_newer(runs, new((8, 6, "C", 6)), gone)) == [(8, 6, "C", 0), (20, 4, "O", 3)]


def test_heads_are_read_strictly(spark):
    bodies = ["anchor: none\nadded:\n  A\n  B\nsuperseded:\ntombstoned:\n  C\n", "anchor: x\nadded:\nsuperseded:\n", "anchor: x\nadded:\nadded:\nsuperseded:\ntombstoned:\n", "anchor: x\nadded:\nA\nsuperseded:\ntombstoned:\n", ""]
    rows = records.parse_heads(spark.createDataFrame(list(enumerate(bodies)), "id int, body string")).collect()
    assert sorted((r.section, r.entry) for r in rows if r.id == 0) == [("added", "A"), ("added", "B"), ("anchor", "none"), ("tombstoned", "C")]
    assert {r.id: r.error for r in rows if r.id} == {1: "missing section tombstoned", 2: "duplicate section", 3: "unknown line", 4: "missing section anchor"}


def test_fetch_batches(spark):
    rows = [("v", 1, i, 100 * i, 100, i in (3, 7)) for i in range(9)] + [("v", 2, 0, 0, 900, False), ("v", 2, 1, 900, 50, False)]
    df = spark.createDataFrame(rows, "volume_id string, segment_id long, entry_idx long, stored_offset long, stored_length long, present boolean").withColumn("section", F.lit("body"))
    found = sorted((r.segment_id, r.start_entry, r.end_entry, r.body_start, r.body_end) for r in writes.warm_batches(df, 200).collect())
    assert found == [(1, 0, 1, 0, 200), (1, 2, 2, 200, 300), (1, 4, 5, 400, 600), (1, 6, 6, 600, 700), (1, 8, 8, 800, 900), (2, 0, 0, 0, 900), (2, 1, 1, 900, 950)]
