"""The corpus pipeline: quality, near-duplicates, benchmark passages, personal data, then tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of
their input, whatever else they are called: columns go through in a struct, so they meet no name of an operator. Null and empty
texts are rows like any other (see the operators for what they get); an empty table gives an empty table. Labels and
benchmark are read from sf_dir.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm import bpe, decontaminate, pii, quality, simhash_wide
from strataq.llm.common import remainder, staged, table


def _carried(docs: DataFrame, *but: str) -> Column:
    """The columns of docs, but some, as one struct."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in but)).alias("_row")


def _again(found: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs in their order and types: new ones, and the others from the struct."""
    return found.select(*((new[c] if c in new else F.col("_row").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def _retold(found: DataFrame, docs: DataFrame, text: Column, changed: Column) -> DataFrame:
    """docs with another text; n_chars is counted anew where the text has changed."""
    return _again(found, docs, text=text, n_chars=F.when(changed, F.length(text)).otherwise(F.col("_row").getField("n_chars")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at least 0.5."""
    rules = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"), remainder(F.col("doc_id"), 3) != 1)
    return _again(quality.predict(docs, rules, [_carried(docs)]).where("predicted = 1"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id."""
    return simhash_wide.drop_near_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark passages."""
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), [_carried(docs, "text")], remove="spans")
    return _retold(found, docs, F.col("cleaned"), F.col("n_hit") > 0)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    found = pii.scan(docs, pii.fit(docs), [_carried(docs, "text")])
    return _retold(found, docs, F.col("redacted"), F.col("spans") != "")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, [F.col("doc_id"), F.col("lang"), F.col("source")])
    return bpe.digests(coded)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("PII", redact),
    ("byte-level BPE encoding and decoding", tokenize),
]

#: The classifier, the fingerprints, the tagger and the merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return docs
