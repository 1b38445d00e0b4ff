"""The files of edge_file_scan stay small however many edges there are."""

from collections import Counter

import __spark_entry__ as entry
from pathloom.plans import source_queries

SF = "/root/testdata/sf0.001"


def test_files_grow_in_number_not_in_size(spark, monkeypatch):
    sizes, npz = Counter(), source_queries._write_files

    def seen(df, root, content):
        sizes.update({r["file"]: r["count"] for r in df.groupBy("file").count().collect()})
        npz(df, root, content)

    monkeypatch.setattr(source_queries, "_write_files", seen)
    monkeypatch.setattr(source_queries, "EDGES_A_FILE", 50, raising=False)
    got = entry.queries()["edge_file_scan"](spark, SF).collect()
    edges = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert sum(sizes.values()) == edges == next(r["n"] for r in got if r["file"] == "json")
    assert max(sizes.values()) <= 100 < edges // 16
