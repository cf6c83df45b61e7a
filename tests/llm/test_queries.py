import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from strataq.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_all_ten_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(ORACLES) <= set(QUERIES)


def test_twins_agree(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, SF)
        found = con.execute(sql)
        order = sorted(d[0] for d in found.description)
        assert order == sorted(df.columns)
        want = sorted(str(tuple(r)) for r in con.execute(f"SELECT {', '.join(order)} FROM ({sql})").fetchall())
        assert sorted(str(tuple(r)) for r in df.select(*order).collect()) == want


COLUMNS = {
    "op1_context_mixing": "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    "op2_quality": "doc_id long, held_out boolean, score double, predicted int",
    "op3_sharding": "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int",
    "op4_media": "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    "op5_url_filter": "page_id long, host string, path string, rule string, verdict string",
    "op6_pii": "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
    "op7_simhash": "doc_id long, fingerprint string, component_id long",
    "op8_decontamination": "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean",
    "op9_byte_bpe": "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    "op10_language_id": "doc_id long, held_out boolean, lang_pred string, score double",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_registered_queries_return_all_rows_and_their_columns(spark, name):
    df = QUERIES[name](spark, SF)
    types = dict(df.dtypes)
    for column in COLUMNS[name].split(", "):
        field, kind = column.split()
        assert types[field] == {"long": "bigint"}.get(kind, kind)
    source = spark.read.parquet(f"{SF}/{'pages' if name.startswith('op5') else 'documents'}.parquet")
    assert df.count() == source.count()


def test_stages_carry_columns_of_any_name(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(12)
    used = ["score", "predicted", "n_hit", "cleaned", "spans", "_text", "_n", "_kept", "redacted", "_row", "kept", "a.b"]
    docs = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(used)))
    docs = docs.unionByName(docs.limit(1).withColumns({"text": F.lit(None).cast("string"), "doc_id": F.lit(None).cast("long")}))
    docs.write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    for _, stage in corpus_pipeline.STAGES[:1] + corpus_pipeline.STAGES[2:4]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes
        assert all(tuple(r)[-len(used) :] == tuple(range(len(used))) for r in out.collect())
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_pipeline_stages_keep_the_columns_and_work_on_what_was_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(i)))
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before and len(after) > 0.6 * len(before)
        if i >= 2:
            assert after == before
    assert docs.where(F.col("n_tokens").isNull()).count() == 0
