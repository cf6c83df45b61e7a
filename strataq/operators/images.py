"""Comparison of two images: files by path, content and size, and 4 KiB blocks of what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4096


def hashed(image: DataFrame) -> DataFrame:
    """path, hash, bytes of each file."""
    return image.select("path", F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("bytes"))


def dedup_report(files: DataFrame) -> DataFrame:
    """Files, bytes, distinct contents and their bytes, and the share of bytes that copies take."""
    per = files.groupBy("hash").agg(F.count("*").alias("n"), F.first("bytes").alias("bytes"))
    out = per.agg(F.sum("n").alias("files"), F.sum(F.col("n") * F.col("bytes")).alias("total_bytes"), F.count("*").alias("unique_files"), F.sum("bytes").alias("unique_bytes"))
    return out.withColumn("dedup_ratio", F.when(F.col("total_bytes") > 0, 1 - F.col("unique_bytes") / F.col("total_bytes")).otherwise(0.0))


def overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct contents of the second image that the first has, by count and bytes, with ratios."""
    a = first.select("hash").distinct().withColumn("shared", F.lit(True))
    b = second.groupBy("hash").agg(F.first("bytes").alias("bytes")).join(a, "hash", "left")
    out = b.agg(F.count("*").alias("contents"), F.count("shared").alias("shared_contents"), F.sum("bytes").alias("total_bytes"), F.coalesce(F.sum(F.when(F.col("shared"), F.col("bytes"))), F.lit(0)).alias("shared_bytes"))
    return out.withColumns({"count_ratio": F.col("shared_contents") / F.col("contents"), "byte_ratio": F.col("shared_bytes") / F.col("total_bytes")})


def file_diff(first: DataFrame, second: DataFrame) -> DataFrame:
    """path and class (exact, changed, new or removed), with the bytes on both sides."""
    both = first.select("path", F.col("hash").alias("h1"), F.col("bytes").alias("bytes1")).join(second.select("path", F.col("hash").alias("h2"), F.col("bytes").alias("bytes2")), "path", "full_outer")
    kind = F.when(F.col("h1").isNull(), "new").when(F.col("h2").isNull(), "removed").when(F.col("h1") == F.col("h2"), "exact").otherwise("changed")
    return both.select("path", kind.alias("class"), "bytes1", "bytes2")


def renames(first: DataFrame, second: DataFrame) -> DataFrame:
    """Paths only the second image has: renamed (the same content at an old path, the least one), same_size, or new."""
    fresh = second.join(first.select("path"), "path", "left_anti")
    old = first.groupBy("hash").agg(F.min("path").alias("old_path"))
    sizes = first.where("bytes > 0").select("bytes").distinct().withColumn("sized", F.lit(True))
    rows = fresh.join(old, "hash", "left").join(sizes, "bytes", "left")
    kind = F.when(F.col("old_path").isNotNull(), "renamed").when(F.col("sized"), "same_size").otherwise("new")
    return rows.select("path", kind.alias("class"), "old_path", "bytes")


def changed_blocks(first: DataFrame, second: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """path, blocks and changed of each file of both images whose content differs; a block past the old end has changed."""
    pairs = first.select("path", F.col("content").cast("binary").alias("old")).join(second.select("path", F.col("content").cast("binary").alias("new")), "path").where("old <> new")
    blocks = F.ceil(F.octet_length("new") / block).cast("int")
    cut = lambda c, i: F.substring(F.col(c), i * block + 1, F.lit(block))
    differ = F.filter(F.sequence(F.lit(0), F.greatest(blocks, F.lit(1)) - 1), lambda i: cut("old", i) != cut("new", i))
    return pairs.select("path", blocks.cast("long").alias("blocks"), F.when(blocks > 0, F.size(differ)).otherwise(0).cast("long").alias("changed"))


def histogram(found: DataFrame, part: str, whole: str) -> DataFrame:
    """Files by fifths of the changed share; the last bin holds a share of one."""
    share = F.col(part) / F.col(whole)
    return found.where(F.col(whole) > 0).groupBy(F.least(F.floor(share * 5), F.lit(4)).cast("int").alias("bin")).agg(F.count("*").alias("files"))
