import hashlib

import pandas as pd
from pyspark.sql import functions as F

from strataq.functions import codecs
from strataq.sources import binary, text
from strataq.streaming import writelog


def test_log_round_trip_and_partial_tail(spark, tmp_path):
    body = b"x" * 4096
    records = [("data", hashlib.sha256(body).digest(), 7, 1, False, body), ("ref", b"r" * 32, 300, 2, False, None), ("zero", None, 2**40, 524288, False, None)]
    raw = binary.encode_log(records)
    (tmp_path / "whole").write_bytes(raw)
    (tmp_path / "cut").write_bytes(raw[:-3])
    rows = binary.read_logs(spark, str(tmp_path)).orderBy("path", "seq").collect()
    whole = [r for r in rows if r.path.endswith("whole")]
    assert [(r.kind, r.start_lba, r.lba_length) for r in whole] == [("data", 7, 1), ("ref", 300, 2), ("zero", 2**40, 524288)]
    assert [r.has_partial_tail for r in rows if r.path.endswith("cut")] == [True, True]
    assert binary.read_logs(spark, str(tmp_path), partial=False).select("path").distinct().count() == 1


def test_wrong_hash_ends_the_log():
    records, cut = binary.parse_log(binary.encode_log([("data", b"w" * 32, 0, 1, False, b"body")]))
    assert not records and cut


def test_packed_payloads_are_checked_too():
    body = b"abcdefgh" * 512
    packed = codecs.gate(body)
    record = lambda h, data: binary.encode_log([("data", h, 0, 1, True, data), ("zero", None, 5, 1, False, None)])
    digest = hashlib.sha256(body).digest()
    assert len(binary.parse_log(record(digest, packed))[0]) == 2
    for broken in (record(b"w" * 32, packed), record(digest, packed[:-1] + b"z"), record(digest, b"junk")):
        records, cut = binary.parse_log(broken)
        assert not records and cut


def test_segment_round_trip_and_bounds(spark, tmp_path):
    entry = lambda flags, offset, n, **x: {"hash": b"h" * 32, "start_lba": 1, "lba_length": 2, "flags": flags, "stored_offset": offset, "stored_length": n} | x
    good = binary.encode_segment([entry(0, 0, 8), entry(binary.SEG_INLINE, 0, 4), entry(binary.SEG_DELTA | binary.SEG_HAS_DELTAS, 0, 0, deltas=[(b"s" * 32, 0, 3, b"d" * 32)]), entry(binary.SEG_CANONICAL, 0, 8)], [b"i" * 16], b"abcd", b"12345678", b"xyz")
    (tmp_path / "good").write_bytes(good)
    (tmp_path / "bad").write_bytes(binary.encode_segment([entry(0, 4, 8)], [], b"", b"12345678"))
    rows = binary.read_segments(spark, str(tmp_path)).orderBy("path", "entry_idx").collect()
    assert rows[0].error == "entry out of its section"
    assert [r.kind for r in rows[1:]] == ["data", "inline", "delta", "canonical_data"]
    assert rows[3].delta_options[0].delta_length == 3 and rows[1].inputs == [(b"i" * 16).hex()]
    assert binary.segment_flags(5) == 20


def test_filemap_and_plan(spark, tmp_path):
    df = spark.createDataFrame([("b", 0, "h", 4), ("a", 4096, "g", 2), ("a", 0, "f", 4096)], text.FILEMAP)
    text.write_filemap(df, str(tmp_path / "map"))
    got = [tuple(r) for r in text.read_filemap(spark, str(tmp_path / "map")).orderBy("path", "file_offset").collect()]
    assert got == [("a", 0, "f", 4096), ("a", 4096, "g", 2), ("b", 0, "h", 4)]
    (tmp_path / "plan").write_text("# v1\nkeep\ts\t1\nrun\ts\t1\t0\t5\t2\nkeep\ts\nspin\tx\n\n")
    assert [r.ok for r in text.read_plan(spark, str(tmp_path / "plan")).collect()] == [True, True, False, False]


def test_stream_of_writes(spark, tmp_path):
    rows = [(1, "v", 0, "write", "A"), (2, "v", 0, "write", "A"), (3, "v", 0, "zero", "Z"), (4, "v", 0, "write", "A"), (5, "v", 1, "flush", None), (6, "v", 1, "write", "A")]
    df = spark.createDataFrame(rows, "seq long, volume_id string, lba long, op string, hash string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = writelog.outcomes(stream).writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert [r.outcome for r in spark.table("seen").orderBy("seq").collect()] == ["write", "noop", "zero", "write", "write"]
    assert spark.table("seen").where(F.col("outcome") == "late").count() == 0


def test_rows_of_a_batch_are_taken_in_order_over_its_chunks():
    class State:
        exists, value = False, None

        @property
        def get(self):
            return self.value

        def update(self, value):
            self.exists, self.value = True, value

    held, state = {}, State()

    class Rows:
        def where(self, _):
            return self

        select = groupBy = lambda self, *_: self

        def applyInPandasWithState(self, step, *_):  # noqa: N802
            held["step"] = step

    writelog.outcomes(Rows())
    frame = lambda *rows: pd.DataFrame(rows, columns=["seq", "volume_id", "lba", "op", "hash"])
    late_chunk = [frame((5, "v", 0, "write", "B"), (9, "v", 0, "write", "B")), frame((2, "v", 0, "write", "A"), (5, "v", 0, "write", "C"), (7, "v", 0, "zero", "Z"))]
    out = pd.concat(held["step"](("v", 0), iter(late_chunk), state))
    assert list(zip(out["seq"], out["outcome"], strict=True)) == [(2, "write"), (5, "write"), (5, "late"), (7, "zero"), (9, "write")]
    out = pd.concat(held["step"](("v", 0), iter([frame((8, "v", 0, "write", "B"), (10, "v", 0, "write", "B"))]), state))
    assert out["outcome"].tolist() == ["late", "noop"]
