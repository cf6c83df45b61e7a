"""Order-dependent write-path semantics as windows and aggregates over a log's sequence numbers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BYTES = 4096
FLUSH_BYTES, FLUSH_ENTRIES = 32 << 20, 8192
COMPRESSION_NUM, COMPRESSION_DEN = 3, 2


def outcomes(writes: DataFrame) -> DataFrame:
    """seq, volume_id, lba, outcome of each block write: zero, noop (the block already has this content), data (first
    stored write of the content in the volume) or dedup_ref."""
    blocks = writes.where("op <> 'flush'")
    before = F.lag("hash").over(Window.partitionBy("volume_id", "lba").orderBy("seq"))
    marked = blocks.withColumn("noop", (F.col("op") == "write") & F.coalesce(before == F.col("hash"), F.lit(False)))
    first = marked.where("op = 'write' AND NOT noop").groupBy("volume_id", "hash").agg(F.min("seq").alias("first_seq"))
    rows = marked.join(first, ["volume_id", "hash"], "left")
    outcome = F.when(F.col("op") == "zero", "zero").when(F.col("noop"), "noop").when(F.col("seq") == F.col("first_seq"), "data").otherwise("dedup_ref")
    return rows.select("seq", "volume_id", "lba", outcome.alias("outcome"))


def noop_stats(found: DataFrame) -> DataFrame:
    noop = F.col("outcome") == "noop"
    return found.groupBy("volume_id").agg(F.count("*").alias("writes"), F.count_if(noop).alias("noops"), (F.count_if(noop) * BLOCK_BYTES).alias("noop_bytes"))


def sessions(writes: DataFrame) -> DataFrame:
    """Counts of each stretch of a volume's log between flushes."""
    order = Window.partitionBy("volume_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    numbered = writes.withColumn("session", F.coalesce(F.sum(F.when(F.col("op") == "flush", 1).otherwise(0)).over(order), F.lit(0)))
    return numbered.groupBy("volume_id", "session").agg(F.count_if(F.col("op") == "write").alias("n_writes"), F.count_if(F.col("op") == "zero").alias("n_zeroes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def section_offsets(entries: DataFrame) -> DataFrame:
    """entry_key, section (inline or body) and stored_offset: the running sum of stored lengths in the segment's section."""
    rows = entries.where("kind IN ('data', 'inline', 'canonical_data', 'canonical_inline')").withColumn("section", F.when(F.col("kind").isin("inline", "canonical_inline"), "inline").otherwise("body"))
    order = Window.partitionBy("volume_id", "segment_id", "section").orderBy("entry_idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("stored_offset", F.sum("stored_length").over(order) - F.col("stored_length"))


def rollovers(entries: DataFrame, order: str, size: str, most_bytes: int = FLUSH_BYTES, most_entries: int = FLUSH_ENTRIES) -> DataFrame:
    """volume_id, order and log: the number of the log that a record goes to, when a log ends once it holds most_bytes or
    most_entries. A resetting sum is sequential for a volume; it reads two narrow columns."""

    def roll(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        log, held, n, out = 0, 0, 0, []
        for s in rows[size].fillna(0):
            out.append(log)
            held, n = held + int(s), n + 1
            if held >= most_bytes or n >= most_entries:
                log, held, n = log + 1, 0, 0
        return pd.DataFrame({"volume_id": rows["volume_id"], order: rows[order], "log": out})

    return entries.select("volume_id", order, size).groupBy("volume_id").applyInPandas(roll, f"volume_id string, {order} long, log int")


def warm_batches(rows: DataFrame, most_bytes: int = 256 << 10) -> DataFrame:
    """volume_id, segment_id, start_entry, end_entry, body_start, body_end: neighbouring absent bodies fetched together.

    rows: section_offsets() of body entries with `present`. A batch ends at a present entry, at a gap, or before it would
    exceed most_bytes; its first entry is always in. A segment has a bounded number of entries.
    """

    order = Window.partitionBy("volume_id", "segment_id").orderBy("entry_idx")
    bodies = rows.where("section = 'body' AND stored_length > 0").select("volume_id", "segment_id", "entry_idx", "stored_offset", "stored_length", "present")
    end = F.col("stored_offset") + F.col("stored_length")
    joins = F.coalesce((F.lag(end).over(order) == F.col("stored_offset")) & ~F.lag("present").over(order), F.lit(False))
    marked = bodies.withColumn("new", (~joins).cast("int")).withColumn("island", F.sum("new").over(order)).where("NOT present")
    held = marked.groupBy("volume_id", "segment_id", "island").agg(F.array_sort(F.collect_list(F.struct("entry_idx", F.col("stored_offset").alias("a"), end.alias("b")))).alias("own"))
    batch = lambda x: F.struct(x["entry_idx"].alias("start_entry"), x["entry_idx"].alias("end_entry"), x["a"].alias("body_start"), x["b"].alias("body_end"))

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(last["start_entry"].alias("start_entry"), x["entry_idx"].alias("end_entry"), last["body_start"].alias("body_start"), x["b"].alias("body_end"))
        return F.when(x["b"] - last["body_start"] <= most_bytes, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(batch(x))))

    rest = F.slice("own", F.lit(2), F.size("own"))
    found = held.withColumn("batches", F.aggregate(rest, F.array(batch(F.col("own")[0])), step))
    return found.select("volume_id", "segment_id", F.inline("batches"))


def covered_prefix(rows: DataFrame) -> DataFrame:
    """Bytes of each segment's body before the first absent entry, and the section's length."""
    body = rows.where("section = 'body'")
    end = F.max(F.col("stored_offset") + F.col("stored_length"))
    return body.groupBy("volume_id", "segment_id").agg(F.coalesce(F.min(F.when(~F.col("present"), F.col("stored_offset"))), end).alias("covered"), end.alias("body_length"))


def presence_bits(rows: DataFrame) -> DataFrame:
    """Each segment's presence bits as hex, entry 0 in the lowest bit of the first byte, and how many are set."""
    bits = rows.where("present").select("volume_id", "segment_id", F.expr("entry_idx div 8").alias("byte"), F.expr("shiftleft(1, cast(entry_idx % 8 AS INT))").alias("bit")).distinct()
    bytes_ = bits.groupBy("volume_id", "segment_id", "byte").agg(F.sum("bit").alias("v"), F.count("*").alias("n"))
    shown = F.concat_ws(":", F.lpad(F.col("byte").cast("string"), 6, "0"), F.lpad(F.hex("v"), 2, "0"))
    return bytes_.groupBy("volume_id", "segment_id").agg(F.array_join(F.array_sort(F.collect_list(shown)), ",").alias("bits"), F.sum("n").alias("populated"))


def bit_set(byte, place) -> Column:
    """Whether the bit at a place (0 the lowest) is set."""
    return F.getbit(byte, place.cast("int")) == 1


def decode_bits(raw: DataFrame, bits: str, count: str, keys: list[str]) -> DataFrame:
    """keys and entry_idx of each set bit of a binary column, up to the row's entry count."""
    index = F.explode(F.sequence(F.lit(0), F.least(F.col(count), F.octet_length(bits) * 8) - 1))
    rows = raw.where((F.col(count) > 0) & (F.octet_length(bits) > 0)).select(*keys, bits, index.alias("entry_idx"))
    byte = F.conv(F.hex(F.expr(f"substring({bits}, (entry_idx div 8) + 1, 1)")), 16, 10).cast("int")
    return rows.where(F.getbit(byte, (F.col("entry_idx") % 8).cast("int")) == 1).select(*keys, "entry_idx")
