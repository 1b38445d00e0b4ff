"""The pipeline on a small table: every stage against a plain version, and run() against the stages."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from test_operators import brute_components, edited

import corpus_pipeline
from pathloom.llm import mixing, packing, quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(20)
    word = lambda: rng.choice("sea sky walk calm and the over old light rain house".split()) + str(rng.randrange(40))
    texts = [" ".join(word() for _ in range(rng.randint(5, 80))) + "." for _ in range(60)]
    base = [word() for _ in range(60)]
    texts += [edited(rng, base, 2) for _ in range(12)] + [texts[3], texts[3] + " ", "  ".join(texts[4].split()), None, ""]
    texts += ["".join(rng.choice("#!$%9ZQ ") for _ in range(200)) for _ in range(40)]
    rows = [(i, t, "en", ("a", "b", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]
    root = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    good = lambda t: int(bool(t) and "#" not in t and "$" not in t)
    spark.createDataFrame([(i, good(t), 0) for i, t, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def mix_counts(rows):
    """Copies of each row by water filling over its source and a hashed coin."""
    size = {id(r): len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows}
    per = collections.Counter()
    for r in rows:
        per[r["source"]] += size[id(r)]
    names = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(per.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * per[s] <= level * weight[s]}
        for s in full or open_:
            target[s] = 2.0 * per[s] if full else level * weight[s]
            left -= target[s]
        open_ -= full or open_
    out = []
    for r in rows:
        rate = target[r["source"]] / per[r["source"]] if per[r["source"]] else 0.0
        coin = int(hashlib.sha256(f"{mixing.SEED}:{mixing.coin_text(r['doc_id'], r['text'])}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out.append(int(rate) + (coin < rate - int(rate)))
    return out


def test_stages_equal_plain_ones(spark, folder, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        ids = sorted(r["doc_id"] for r in rows)
        if name == "quality_filter":
            scores = {r["doc_id"]: r["predicted"] for r in quality.scored(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
            assert ids == sorted(r["doc_id"] for r in before if scores[r["doc_id"]] == 1) and 0 < len(ids) < len(before)
        elif name == "exact_dedup":
            least = {}
            for r in before:
                body = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
                least[body] = min(least.get(body, r["doc_id"]), r["doc_id"])
            assert ids == sorted(least.values()) and len(ids) < len(before)
        elif name == "near_dedup":
            order = sorted(before, key=lambda r: r["doc_id"])
            assert ids == sorted({order[c]["doc_id"] for _, c in brute_components([r["text"] for r in order])}) and len(ids) < len(before)
        elif name == "source_mix":
            want = collections.Counter()
            for r, n in zip(before, mix_counts(before), strict=True):
                want[r["doc_id"]] += n
            assert collections.Counter(ids) == +want
        else:
            model = Tokenizer.from_file(packing.default_tokenizer())
            tokens = lambda t: np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
            assert sum(r["length"] for r in rows) == sum(len(tokens(r["text"])) for r in before)
            text = {r["doc_id"]: r["text"] for r in before}
            assert all(r["ids_crc32"] == zlib.crc32(tokens(text[r["doc_id"]])[r["start"] : r["start"] + r["length"]].tobytes()) for r in rows)
            ends = collections.Counter()
            for r in rows:
                ends[r["sequence_id"]] += r["length"]
            assert sorted(ends.values())[1:] == [2048] * (len(ends) - 1)
        before = rows
    end = lambda rows: collections.Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0)
    assert end(corpus_pipeline.run(spark, folder).collect()) == end(before)
