"""Queries over whole tables: no row is left out by a made-up filter."""

import os
import random
import time

import pytest

from pathloom.operators import graph
from pathloom.plans import registry

SF = os.environ.get("PATHLOOM_TEST_DIR", "/root/testdata/sf0.001")


def plain_components(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def test_components_equal_brute_force(spark):
    rng = random.Random(1)
    path = [(k, k + 1) for k in range(1000, 1006)]
    star = [(2000, k) for k in range(2001, 2040)]
    links = path + star + [(7, 7), (9, 8), (8, 9)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(120)]
    rng.shuffle(links)
    df, want = spark.createDataFrame(links, "i long, j long"), plain_components(links)
    for last in (0, 50, graph.LAST_EDGES):
        assert dict(graph.components(df, last_edges=last).collect()) == want
    sizes = [list(want.values()).count(c) for c in set(want.values())] + [1]
    one = graph.component_summary(df, spark.createDataFrame([(x,) for x in [*want, 5000]], "node long")).first()
    assert (one["components"], one["largest"], one["coverage"]) == (len(sizes), max(sizes), pytest.approx(max(sizes) / sum(sizes)))


def test_components_read_every_edge(spark):
    links = [tuple(r) for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()]
    want = plain_components(links)
    assert dict(registry.QUERIES["edge_components_whole"](spark, SF).collect()) == want
    nodes = set(want) | {r[0] for t, c in (("part", "p_partkey"), ("supplier", "s_suppkey")) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(c).collect()}
    sizes = [list(want.values()).count(c) for c in set(want.values())] + [1] * len(nodes - set(want))
    one = registry.QUERIES["edge_component_summary_whole"](spark, SF).first()
    assert (one["components"], one["largest"], one["coverage"]) == (len(sizes), max(sizes), pytest.approx(max(sizes) / sum(sizes), abs=1e-6))


def test_cloud_queries_read_every_frame(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    frames = {r["label"]: sum(q["label"] == r["label"] for q in rows) for r in rows}
    for name in ("cloud_frame_histogram_whole", "cloud_frame_bounds_whole"):
        assert {r["frame"]: r["n"] for r in registry.QUERIES[name](spark, SF).collect()} == frames
    cells = {(r["frame"], r["pos"]) for r in registry.QUERIES["cloud_unproject_whole"](spark, SF).select("frame", "pos").collect()}
    assert cells == {(r["vec_id"], k) for r in rows for k, v in enumerate(r["embedding"]) if v > 0.001}


def test_a_long_path_is_one_component_in_few_rounds(spark):
    steps = spark.range(3000).selectExpr("id as i", "id + 1 as j")
    began = time.time()
    for last in (100, graph.LAST_EDGES):
        assert {tuple(r) for r in graph.components(steps, last_edges=last).groupBy("component").count().collect()} == {(0, 3001)}
    assert time.time() - began < 120
