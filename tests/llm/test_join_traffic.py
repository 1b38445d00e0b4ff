"""What the near-duplicate join moves and holds: no texts, small batches, few tables."""

import io
import os
import re
from contextlib import redirect_stdout

import pyarrow as pa

from pathloom.llm import ngram_join
from pathloom.llm.common import documents, stored

SF = os.environ.get("PATHLOOM_TEST_DIR", "/root/testdata/sf0.001")


def test_texts_are_not_shuffled_and_tables_are_few(spark, monkeypatch):
    plans = []

    def kept(df, name, *rest):
        out = io.StringIO()
        with redirect_stdout(out):
            df.explain("formatted")
        plans.append((name, out.getvalue()))
        return stored(df, name, *rest)

    monkeypatch.setattr(ngram_join, "stored", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ngram_join.joined(documents(spark, SF)).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [name for name, plan in plans for block in re.findall(r"\(\d+\) Exchange\n(.*)", plan) if "text#" in block]
    assert any(name == "hists" for name, _ in plans) and not moved
    verified = [name for name, _ in plans if name in ("needed", "first", "rest", "sets", "links")]
    assert len(verified) <= 3 * sum(name == "near" for name, _ in plans)


def test_stored_takes_small_batches(spark):
    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    found = stored(spark.range(0, 95, 1, 1).mapInArrow(rows, "n long"), "batches", 10)
    assert sorted(r["n"] for r in found.collect()) == [5] + [10] * 9
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_slices_and_turns_give_the_same_rows(spark, monkeypatch):
    docs = documents(spark, SF)
    want = sorted(map(str, ngram_join.joined(docs).collect()))
    monkeypatch.setattr(ngram_join, "SLICE_PAIRS", 20)
    monkeypatch.setattr(ngram_join, "FEW_PARTNERS", 0)
    assert sorted(map(str, ngram_join.joined(docs).collect())) == want
