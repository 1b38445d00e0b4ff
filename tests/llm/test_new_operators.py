"""Line dedup, periodic runs and centroid clustering against plain versions."""

import collections
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import balltree, lines, periodic

DOCS = "doc_id long, text string"
VECTORS = "vec_id long, embedding array<float>"


# -- line dedup


def plain_lines(rows, least_chars=40, least_documents=5):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least_chars:
                holders[key(x)].add(d)
    last = {k: max(h, key=lambda d: (d is not None, d or 0)) for k, h in holders.items() if len(h) >= least_documents}
    out = []
    for d, t in rows:
        all_ = (t or "").split("\n")
        stay = [x for x in all_ if last.get(key(x), d) == d]
        out.append((d, len(all_), len(all_) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def line_texts(seed):
    rng = random.Random(seed)
    pool = [f"Shared line number {k} " + "é" * 20 + " and more of it" for k in range(12)] + ["short one", "", "  ", "x" * 39, "y" * 40]
    odd = lambda x: rng.choice(["", " ", "\t", "\r", "\x0b "]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", " \t", "\x0c"])
    return ["\n".join(odd(rng.choice(pool)) for _ in range(rng.randint(0, 9))) for _ in range(80)]


def test_line_dedup_equals_the_plain_version(spark):
    texts = [None, "", "\n", "one line", *line_texts(1)]
    long = "\n".join(f"line {k} of a very long text that is shared by many of them" for k in range(5000))
    rows = [*enumerate(texts), (900, long), (901, long), (902, long), (903, long), (904, long + "\nlast")]
    rows += [(7, texts[9]), (7, texts[9]), (7, texts[10]), (None, texts[11]), (None, texts[12]), (None, None)]
    out, names = lines.stripped(spark.createDataFrame(rows, DOCS).repartition(7))
    got = [(r["doc_id"], r[names["n_lines"]], r[names["n_dropped"]], r[names["kept"]]) for r in out.collect()]
    assert sorted(got, key=str) == plain_lines(rows)


def test_a_line_of_every_document_stays_once(spark):
    rows = [(k, "the very same line of every document, long enough to count\nown %d" % k) for k in range(3000)]
    out, names = lines.stripped(spark.createDataFrame(rows, DOCS))
    kept = {r["doc_id"]: r[names["kept"]] for r in out.collect()}
    assert len(kept) == 3000 and kept[2999].startswith("the very") and all(kept[k] == f"own {k}" for k in range(2999))


def test_line_dedup_of_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", 2, "b")], "doc_id long, text string, kept long, gone_lines string")
    out, names = lines.stripped(df)
    assert out.columns[:4] == df.columns and len(set(out.columns)) == 7 and out.first()[names["kept"]] == "a"
    assert lines.stripped(df.limit(0))[0].count() == 0


# -- periodic runs


def plain_runs(words, least_words=6, least_power=4):
    """All maximal repetitions, period by period."""
    n, found = len(words), {}
    for q in range(1, n // least_power + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least_words, least_power * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, e - a, q) for (a, e), q in found.items())


def plain_collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def looped_words(seed):
    rng = random.Random(seed)
    out = []
    while len(out) < rng.choice([0, 3, 30, 200, 700]):
        base = [rng.choice("abcd") for _ in range(rng.randint(1, 12))]
        n = rng.randint(1, len(base) * 7)
        out += [base[i % len(base)] for i in range(n)] + [rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_the_plain_version(spark, seed):
    rng = random.Random(seed)
    texts = [rng.choice([" ", "\n", " \t"]).join(looped_words(100 * seed + k)) for k in range(120)]
    texts += [None, "", " \n", "a", "a " * 5, "a " * 6, "a a a a a a a", "ab " * 3000, "a b " * 2500 + "a", "é è " * 9 + "x", "a b " * 7, "x " + "A a " * 8]
    texts += [" ".join("ab"[bin(i).count("1") % 2] for i in range(4000))]  # no cube in it
    got = periodic.collapsed(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    assert len(got) == len(texts)
    for r in got:
        words = [w.decode() for w in (texts[r["doc_id"]] or "").encode().split()]
        want = plain_runs(words)
        assert [tuple(x) for x in r["runs"]] == want
        assert r["collapsed"] == plain_collapsed(words, want)


def test_runs_of_small_alphabets_of_all_lengths():
    rng = random.Random(3)
    words = [[rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 60))] for _ in range(2000)]
    found, _ = periodic.document_runs(words)
    got = collections.defaultdict(list)
    for d, *r in found.tolist():
        got[d].append(tuple(r))
    assert all(got[d] == plain_runs(w) for d, w in enumerate(words)) and len(found) > 100


def test_the_overlap_gives_k():
    assert periodic.least_overlap() == 5 and periodic.least_overlap(2, 2) == 1 and periodic.least_overlap(9, 3) == 6


def plain_looped(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_of_runs_equals_the_plain_version(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, rng.choice([None, "", " ", "one", *[" ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 400))) for _ in range(9)]])) for k in range(900)]
    rows += [(None, "a " * 30), (None, None), (3, "b " * 12), (3, "b " * 12)]
    spark.createDataFrame(rows, DOCS).withColumn("runs", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(str, (tuple(r) for r in periodic.query(spark, str(tmp_path)).collect())))
    want = []
    for d, t in rows:
        words = plain_looped(d, t)
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((d, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(plain_collapsed(words, runs))))
    assert got == sorted(map(str, want))
    assert sum(w[1] > 0 for w in want) > 20


# -- centroid clustering


def plain_clusters(rows, clusters=16, rounds=3, dims=64):
    kept = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    centre = [x for _, x in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:clusters]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centre))

    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, x in kept:
            own[nearest(x)[1]].append(x)
        for k, xs in own.items():
            centre[k] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    return [(i, *nearest(x)[::-1]) for i, x in kept], centre


def vector_rows(seed, n, spread):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(9, 64))
    return [(int(k), [float(x) for x in (middles[rng.integers(9)] + spread * rng.normal(size=64)).astype(np.float32)]) for k in range(n)]


@pytest.mark.parametrize("seed,spread", [(1, 0.05), (2, 0.6), (3, 3.0)])
def test_clusters_equal_the_plain_version(spark, seed, spread):
    rows = vector_rows(seed, 500, spread)
    same = rows[3][1]
    rows += [(k, same) for k in range(600, 900)] + [(None, rows[8][1]), (None, same), (4, rows[9][1]), (4, rows[9][1])]
    rows += [(1000, None), (1001, []), (1002, same[:63]), (1003, [*same, 1.0]), (1004, [None, *same[1:]]), (1005, [float("nan"), *same[1:]]), (1006, [float("inf"), *same[1:]])]
    found, centre = balltree.clustered(spark.createDataFrame(rows, VECTORS).repartition(3))
    want, c = plain_clusters(rows)
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, want))
    assert centre.tolist() == c


def test_ties_go_to_the_smaller_cluster_and_few_vectors_start_few(spark):
    rows = [(k, [float(x % 2)] * 64) for k, x in enumerate([0, 0, 0, 1, 1])]
    found, centre = balltree.clustered(spark.createDataFrame(rows, VECTORS))
    want, c = plain_clusters(rows)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and centre.tolist() == c and len(c) == 5
    found, centre = balltree.clustered(spark.createDataFrame([], VECTORS))
    assert found.count() == 0 and len(centre) == 0


def test_huge_components_are_cut_off(spark):
    rows = [(k, [(-1.0) ** k * 3e38] * 64) for k in range(20)] + [(k, [k * 1e5] * 64) for k in range(20, 60)]
    found, _ = balltree.clustered(spark.createDataFrame(rows, VECTORS))
    assert found.count() == 60 and found.filter("distance < 0").count() == 0


def test_balls_hold_their_vectors_and_are_assigned_rightly():
    rng = np.random.default_rng(5)
    x = np.floor(64 * rng.normal(size=(1000, 8))).astype(np.int64) // 4
    order, middles, radii, sums, starts, ends = balltree.tree(x)
    rows = x[order]
    assert sorted(order.tolist()) == list(range(1000))
    for b in range(len(middles)):
        if ends[b] > starts[b]:
            own = rows[starts[b] : ends[b]]
            assert (own.sum(axis=0) == sums[b]).all() and (np.sqrt(((own - middles[b]) ** 2).sum(axis=1)) <= radii[b] + 1e-9).all()
    for _ in range(20):
        centre = rows[rng.integers(1000, size=6)] + rng.integers(-2, 3, size=(6, 8))
        exact = ((rows[:, None] - centre) ** 2).sum(axis=2)
        covered = np.zeros(1000, int)
        for _, a, e, left in balltree.filtered(middles, radii, starts, ends, centre):
            covered[a:e] += 1
            assert (left[exact[a:e][:, left].argmin(axis=1)] == exact[a:e].argmin(axis=1)).all()
        assert (covered == 1).all()


def test_far_balls_go_whole():
    x = np.concatenate([np.zeros((500, 4), int), np.full((500, 4), 1000)]) + np.arange(1000)[:, None] % 7
    _, middles, radii, _, starts, ends = balltree.tree(x)
    found = balltree.filtered(middles, radii, starts, ends, np.array([[0] * 4, [1000] * 4]))
    assert len(found) < 6 and all(len(left) == 1 for *_, left in found)
