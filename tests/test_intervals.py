import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataq.operators.intervals import complement, islands, overlay, point_join, range_join

WRITE = st.tuples(st.integers(0, 60), st.integers(1, 20))


def replay(log):
    """Block by block, the last write wins."""
    blocks = {}
    for i, (start, length) in enumerate(log):
        for b in range(start, start + length):
            blocks[b] = (i, b - start)
    runs = []
    for b in sorted(blocks):
        i, offset = blocks[b]
        if runs and runs[-1][3] == i and runs[-1][0] + runs[-1][1] == b:
            runs[-1][1] += 1
        else:
            runs.append([b, 1, offset, i])
    return [tuple(r) for r in runs]


@settings(max_examples=4, deadline=None)
@given(logs=st.lists(st.lists(WRITE, min_size=1, max_size=12), min_size=10, max_size=25))
def test_overlay_is_sequential_replay(spark, logs):
    """Many logs, one a volume, in one job."""
    rows = [(f"v{v}", i, s, n, "h") for v, log in enumerate(logs) for i, (s, n) in enumerate(log)]
    df = spark.createDataFrame(rows, "volume_id string, entry_key long, start_lba long, lba_length long, hash string")
    found = {}
    for r in overlay(df, ["volume_id"], F.col("entry_key"), ["hash"], width=16).collect():
        found.setdefault(r.volume_id, []).append((r.start_lba, r.lba_length, r.payload_block_offset, r.entry_key))
    for v, log in enumerate(logs):
        assert sorted(found[f"v{v}"]) == replay(log)


def test_range_and_point_join_match_brute_force(spark):
    rng = random.Random(3)
    a = [(f"k{rng.randrange(3)}", i, s, s + rng.randrange(0, 90)) for i in range(60) for s in [rng.randrange(300)]]
    b = [(f"k{rng.randrange(3)}", i, s, s + rng.randrange(1, 90)) for i in range(60) for s in [rng.randrange(300)]]
    left = spark.createDataFrame(a, "k string, i long, a0 long, a1 long")
    right = spark.createDataFrame(b, "k string, j long, b0 long, b1 long")
    found = sorted((r.i, r.j, r.lo, r.hi) for r in range_join(left, right, ["k"], ("a0", "a1"), ("b0", "b1"), 32).collect())
    assert found == sorted((i, j, max(s, t), min(e, u)) for k, i, s, e in a for m, j, t, u in b if k == m and max(s, t) < min(e, u))
    points = sorted((r.i, r.j) for r in point_join(left, right, ["k"], "a0", ("b0", "b1"), width=32).collect())
    assert points == sorted((i, j) for k, i, s, _ in a for m, j, t, u in b if k == m and t <= s < u)
    outer = point_join(left, right, ["k"], "a0", ("b0", "b1"), "left", 32).select("i").distinct().count()
    assert outer == 60


def test_islands_and_complement(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 9, 10), ("b", 1, 2)], "k string, s long, e long")
    assert sorted(map(tuple, islands(df, ["k"], "s", "e").collect())) == [("a", 0, 7), ("a", 9, 10), ("b", 1, 2)]
    assert sorted(map(tuple, islands(df, ["k"], "s", "e", touching=False).collect())) == [("a", 0, 5), ("a", 5, 7), ("a", 9, 10), ("b", 1, 2)]
    wholes = spark.createDataFrame([("a", 0, 12), ("c", 3, 4)], "k string, s long, e long")
    pieces = spark.createDataFrame([("a", 2, 5), ("a", 7, 9)], "k string, lo long, hi long")
    assert sorted(map(tuple, complement(pieces, wholes, "k", ("s", "e")).collect())) == [("a", 0, 2), ("a", 5, 7), ("a", 9, 12), ("c", 3, 4)]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "volume_id string, entry_key long, start_lba long, lba_length long, hash string")
    assert overlay(none, ["volume_id"], F.col("entry_key"), ["hash"]).count() == 0
