"""The registered queries against their SQL, and the pipeline stage by stage."""

import os

import duckdb
import pytest

import corpus_pipeline
from pathloom.llm import registry

SF = os.environ.get("PATHLOOM_TEST_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    a, b = registry.QUERIES[name](spark, SF).toArrow(), con.sql(registry.ORACLES[name]).to_arrow_table()
    assert sorted(a.column_names) == sorted(b.column_names)
    assert sorted(map(str, a.to_pylist())) == sorted(map(str, b.select(a.column_names).to_pylist()))


def test_stages_keep_columns_and_only_remove_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        kept = spark.read.parquet(str(tmp_path / str(k)))
        assert kept.exceptAll(docs).count() == 0 and 0 < kept.count() <= docs.count()
        docs = kept
