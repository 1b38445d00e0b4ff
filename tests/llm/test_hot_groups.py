"""Large groups of near copies: compared block by block, without a second level of signatures."""

import random

import pytest
from test_operators import brute_components, docs

from pathloom.llm import ngram_join
from pathloom.llm.common import stored


def drifting(seed, copies):
    """Texts that differ from one base in 0 to 30 places: some link with it, many with none or with few others."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, 30)):
            words[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
        if rng.random() < 0.1:  # a copy of a far copy: the two link with each other alone
            words[rng.randrange(300)] = f"y{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    return texts


@pytest.fixture
def tables(monkeypatch):
    names = []
    monkeypatch.setattr(ngram_join, "stored", lambda df, name, *rest: names.append(name) or stored(df, name, *rest))
    return names


def test_a_hot_group_needs_no_second_signatures(spark, tables):
    texts = drifting(1, 250)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.joined(docs(spark, texts)).collect()}
    assert got == dict(enumerate(brute_components(texts)))
    assert "groups" in tables[:-1] and tables.count("candidates") == ngram_join.PASSES and tables.count("members") == 1


@pytest.mark.parametrize("direct,block", [(1 << 16, 32), (20, 1 << 12)])
def test_blocks_and_differences_give_the_same_rows(spark, tables, monkeypatch, direct, block):
    monkeypatch.setattr(ngram_join, "DIRECT", direct)
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", block)
    texts = drifting(2, 250)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.joined(docs(spark, texts)).collect()}
    assert got == dict(enumerate(brute_components(texts)))
    assert (tables.count("candidates") > ngram_join.PASSES) == (direct == 20)


def test_sets_are_not_written_before_they_are_compared(spark, tables):
    ngram_join.joined(docs(spark, drifting(3, 60))).collect()
    assert "links" in tables and "sets" not in tables


def test_rows_that_surely_stay_are_not_shuffled(spark):
    texts = drifting(4, 40) + [f"alone {i} of its kind" for i in range(200)]
    df = docs(spark, texts)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ngram_join.representatives(df)
        held = got.collect()
        plan = got._jdf.queryExecution().executedPlan()
        moved = max(m.value() for m in _written(plan, "shuffleRecordsWritten"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = brute_components(texts)
    assert sorted(r["doc_id"] for r in held) == [i for i, (_, c) in enumerate(want) if i == c] and got.columns == df.columns
    assert moved < len(texts) / 2


def _written(node, name):
    """The metric of every exchange below a plan's node."""
    if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        node = node.executedPlan()
    if "QueryStageExec" in node.getClass().getSimpleName():
        node = node.plan()
    found = [node.metrics().apply(name)] if node.metrics().contains(name) else []
    for k in range(node.children().size()):
        found += _written(node.children().apply(k), name)
    return found
