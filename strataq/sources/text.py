"""Line formats: file maps, boot traces and rewrite plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILEMAP = "path string, file_offset long, hash string, byte_count long"
TRACE = "hash string, start_byte long, byte_count long"
#: Fields of a plan line after its op.
PLAN_FIELDS = {"keep": 2, "zero_split": 4, "canonical": 2, "run": 5, "drop": 2}


def read_filemap(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILEMAP).option("sep", "\t").option("comment", "#").option("mode", "FAILFAST").csv(path)


def write_filemap(rows: DataFrame, path: str) -> None:
    """Sorted by path and offset over all files: a range for each file, sorted inside."""
    ordered = rows.select("path", "file_offset", "hash", "byte_count").orderBy("path", "file_offset")
    ordered.write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Boot trace lines; comments and blank lines are left out."""
    return spark.read.schema(TRACE).option("sep", "\t").option("comment", "#").option("mode", "FAILFAST").csv(path)


def write_trace(rows: DataFrame, path: str) -> None:
    rows.select("hash", "start_byte", "byte_count").write.mode("overwrite").option("sep", "\t").csv(path)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """line, op, fields and ok: whether the op is known and has its number of fields."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> '' AND NOT startswith(value, '#')").select(F.col("value").alias("line"), parts[0].alias("op"), F.slice(parts, 2, 99).alias("fields"))
    wanted = F.create_map(*(F.lit(x) for pair in PLAN_FIELDS.items() for x in pair))
    return rows.withColumn("ok", F.coalesce(F.try_element_at(wanted, F.col("op")) == F.size("fields"), F.lit(False)))


def byte_range(header: str) -> tuple:
    """First and last byte columns of a `bytes=a-b` header column; null where it has another form."""
    return tuple(F.expr(f"try_cast(regexp_extract({header}, '^bytes=([0-9]+)-([0-9]+)$', {i}) AS BIGINT)") for i in (1, 2))
