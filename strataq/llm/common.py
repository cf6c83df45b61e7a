"""What the operators share: the shared folder, staged tables, null-safe columns, batch helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strataq.sources.stage import LOCAL_SHARED, new_path, shared_dir, staged, unstage

__all__ = ["LOCAL_SHARED", "attached", "nested", "new_path", "remainder", "scanned", "shared_dir", "slices", "staged", "table", "unnested", "unstage"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, m: int) -> Column:
    """crc32 of doc_id as text, modulo m; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch cut so that the texts of a slice have about `most` bytes; a longer text has a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def nested(keep: list[Column]) -> Column:
    """Kept columns as one struct `_kept`, so that their names meet no others while an operator works."""
    return F.struct(*(keep or [F.lit(None).cast("int").alias("_nothing")])).alias("_kept")


def unnested(df: DataFrame, added: list[str]) -> DataFrame:
    """The fields of `_kept`, then the added columns. A kept column with the name of an added one is left out."""
    own = {a.lower() for a in added}
    kept = [n for n in df.schema["_kept"].dataType.names if n.lower() not in own and n != "_nothing"]
    return df.select(*(F.col("_kept").getField(n).alias(n) for n in kept), *(F.col(f"`{a}`") for a in added))


def scanned(docs: DataFrame, keep: list[Column], text: str, schema: str, start: Callable[[], Callable[[pa.Array], list]], most: int = 8 << 20) -> DataFrame:
    """`keep` columns and those of schema for every row, without a shuffle. start() runs once in a task; what it returns gets
    the texts of a slice (see slices) and gives the added columns as Arrow arrays. For clashing names see unnested."""
    base = docs.select(nested(keep), F.col(text).alias("_text"))
    added = StructType.fromDDL(schema)
    names = ["_kept", *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = start()
        for whole in batches:
            for b in slices(whole, "_text", most):
                yield pa.RecordBatch.from_arrays([b.column(0), *look(b.column(1))], names)

    return unnested(base.mapInArrow(run, StructType([base.schema["_kept"], *added])), added.names)


def attached(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """rows with the columns of facts, which has one row for each key and, in `count`, the number of rows of it; rows without
    facts go. total: how many rows there are, or more.

    Keys of over 1,024 rows and over a 2**15th of all meet their facts in a broadcast, the others in a join by key: at most
    2**15 keys can have over a 2**15th of all rows, so the broadcast has a bound, and so has what a key brings to a task of the join.
    """
    most = max(1024, total >> 15)
    hot = F.broadcast(facts.where(F.col(count) > most))
    cold = facts.where(F.col(count) <= most)
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))
