"""Odd rows of the training-data operators: ties, repeats, nulls, thousands of spans, long conversations."""

import collections
import hashlib
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathloom.llm import chat, licenses, mixing, pii, quality, secrets

DOCS = "doc_id long, text string, source string"


@pytest.mark.parametrize("scanner,piece,kind", [(secrets, "deadbeef%016x ", "hex"), (pii, "10.0.%d.7 ", "ip")])
def test_thousands_of_spans_take_seconds(spark, scanner, piece, kind):
    text = "".join(piece % (k % 256) for k in range(20_000))
    began = time.time()
    row = scanner.scanned(spark.createDataFrame([(1, text, "a"), (None, text, "a"), (1, text, None)], DOCS)).collect()
    assert [r[f"n_{kind}"] for r in row] == [20_000] * 3 and time.time() - began < 30


def test_added_spans_inside_base_ones_go():
    base = [(0, 10, "a"), (3, 30, "b"), (40, 50, "a"), (5, 8, "c")]
    added = [(0, 10, "x"), (12, 30, "x"), (12, 31, "x"), (31, 40, "x"), (45, 50, "x"), (60, 61, "x")]
    want = [s for s in added if not any(a <= s[0] and s[1] <= b for a, b, _ in base)]
    assert secrets.outside(added, base) == want and secrets.outside(added, []) == added


@pytest.mark.parametrize("text,found", [("my ssn is 419-33-7812 ok", "419-33-7812"), ("the desk answers (303) 555-7714 now", "(303) 555-7714"), ("tel. 020-775314 please", "020-775314"), ("passport K7734561 lost", "K7734561"), ("my name is Bruno Castillo and so on", "Bruno Castillo"), ("the lawyer Priya Hansen came again", "Priya Hansen"), ("The war of 1914-1918 was long; see 3-4 and 12-10-2020.", None)])
def test_the_field_finds_what_patterns_miss(spark, text, found):
    row = pii.scanned(spark.createDataFrame([(1, text, "a")], DOCS)).first()
    spans = [s.split(":") for s in row["spans"].split(",") if s]
    assert [text[int(a) : int(b)] for _, a, b in spans] == ([found] if found else [])


@pytest.mark.parametrize("token,found", [("tRxQpLmZvBnWkYdShJuF", True), ("qzxkvjwpmtrbnhgdlscf", True), ("82736450917263549081", True), ("A1B2C-D3E4F-G5H6I-J7K8L", True), ("someVeryLongFunctionNameHere", False), ("internationalization", False), ("path/to/2024/file-name", False), ("00000000000000000000", False)])
def test_every_character_class_is_scored(token, found):
    assert bool(secrets.entropy_spans(f"x {token} y")) == found


def test_long_and_repeated_texts_keep_their_license(spark):
    note = "Licensed under CC BY 4.0."
    text = "word " * 50_000 + "\n\n" + note
    rows = licenses.scanned(spark.createDataFrame([(1, text, "a"), (1, text, "a"), (2, note, "a"), (None, note, None)], DOCS)).collect()
    assert [r["licenses"] for r in rows] == ["CC-BY-4.0"] * 4


def test_turns_with_ties_repeats_and_nulls(spark):
    rows = [(1, 0, "b", "y"), (1, 0, "a", "z"), (1, 0, "a", "x"), (1, None, "c", "last"), (2, 5, "a", "x"), (2, 7, "a", "z"), (3, 1, "u", "same"), (3, 1, "u", "same"), (4, 1, "u", "same"), (4, 1, "u", "same"), (4, 2, None, None)]
    out = {r["conv_id"]: r for r in chat.rendered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert out[1]["chat"] == "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in (("a", "x"), ("a", "z"), ("b", "y"), ("c", "last")))
    assert set(out) == {1, 4} and out[4]["n_turns"] == 3 and out[4]["chat"].endswith("<|unknown|>\n<|end|>\n")


def test_a_long_conversation_comes_in_parts(spark):
    turns = spark.range(3000).select(F.lit(None).cast("long").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("u").alias("role"), F.lpad(F.col("id").cast("string"), 6, "0").alias("text"))
    short = spark.range(1000).select(F.lit(9).cast("long").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("u").alias("role"), F.lpad(F.col("id").cast("string"), 6, "0").alias("text"))
    out = chat.rendered(turns.union(short).repartition(5), part_turns=100).orderBy("part").collect()
    assert [r["conv_id"] for r in out] == [None] * 30 and "".join(r["chat"] for r in out) == "".join(f"<|u|>\n{k:06d}<|end|>\n" for k in range(3000))


def test_quality_of_null_texts_and_repeated_identifiers(spark):
    rows = [(k % 50, "good words here. " * 5 if k % 2 else "#$ 1 " * 9, None) for k in range(200)] + [(7, None, "a"), (None, None, None), (None, "", None)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)] + [(3, 1), (None, 0)], "doc_id long, quality int")
    got = quality.scored(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] is None}) == 1


def test_repeated_and_null_identifiers_are_drawn_apart(spark):
    rows = [(5, f"w {k}", "b") for k in range(400)] + [(None, f"v {k}", "b") for k in range(400)] + [(k + 100, "x " * 40, "a") for k in range(50)] + [(6, "twice", "b")] * 2
    counted, names = mixing.with_copies(spark.createDataFrame(rows, DOCS))
    per = collections.defaultdict(set)
    for r in counted.collect():
        per[r["doc_id"] if r["doc_id"] in (5, 6, None) else -1].add(r[names["copies"]])
        coin = int(hashlib.sha256(f"{mixing.SEED}:{mixing.coin_text(r['doc_id'], r['text'])}".encode()).hexdigest()[:13], 16) / (1 << 52)
        rate = r[names["target"]] / r[names["source_size"]]
        assert r[names["copies"]] == int(rate) + (coin < rate - int(rate))
    assert len(per[5]) == 2 and len(per[None]) == 2 and len(per[6]) == 1


def test_the_field_finds_unseen_names_and_leaves_documents_alone(spark):
    rng = random.Random(5)
    first = "Alice Bruno Celine Dmitri Elena Farid Greta Hugo Irene Jakob Kenji Laura Miguel Noor Otto Priya Rosa Stefan Tara".split()
    last = "Anders Blanchard Castillo Dietrich Eriksen Ferrari Goldberg Hansen Ibrahim Jansen Lefevre Martinez Nakamura Olsen Pereira Romano Suzuki".split()
    left = ["I spoke to", "the director", "hired by", "visited", "trust", "invited", "the lawyer", "witness", "caller", "her uncle", "says", "because", "introduced", "about", "the nurse"]
    seen = {w for row in (*pii.LABELLED, *pii.rule_rows()) for w in row.replace("[[", "").replace("]]", "").split()}
    assert not seen & set(first)
    word = lambda: "".join(rng.choice("aeioutrnsl") for _ in range(rng.randint(2, 9)))
    made = [(f"{word()} {word()} {rng.choice(left)} ", f"{rng.choice(first)} {rng.choice(last)}", f" {word()} {word()}") for _ in range(300)]
    found = pii.field_spans(pa.array(["".join(m) for m in made]), pii.trained())
    assert sum((len(a), len(a) + len(b), "crf") in f for f, (a, b, _) in zip(found, made, strict=True)) >= 0.8 * 300
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    added = [secrets.outside(sorted(s), pii.base_spans(t)) for t, s in zip(texts, pii.field_spans(pa.array(texts), pii.trained()), strict=True)]
    assert sum(map(bool, added)) <= 0.005 * len(texts)


def test_repeated_identifiers_give_one_training_row(spark, monkeypatch):
    seen = []
    real = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: (seen.append(len(y)), real(x, y))[1])
    docs = spark.createDataFrame([(k % 40, f"words {k} and more of them. " * 3, None) for k in range(4000)], DOCS)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    quality.trained(docs, labels)
    assert seen[0] <= 40
