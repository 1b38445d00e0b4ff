"""Periodic runs of words: repeated k-gram masking, then Main-Lorentz.

A run is a maximal stretch of words with smallest period q and length of
max(LEAST_WORDS, LEAST_POWER * q) at least. Its words but the last q come again q
words later, so every word of a run lies in a k-gram that the document repeats,
where k is the smallest overlap that a run may have. Words outside such k-grams
are masked by one hash pass; only the stretches between them go on.

These are halved again and again. A run lies across the middle of one piece: for
every period the words there are compared with those a period away, and where
they agree the agreement is extended to both sides. The extensions are read from
tables that name the 2 ** j-grams by their equality, so they are exact. All pieces
of a level, of all documents of a slice, are treated at once in numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, documents, fresh, ship, sliced, text_or_empty

#: A run's words and its length in periods, at least.
LEAST_WORDS, LEAST_POWER = 6, 4
#: Text of one slice; a longer document is a slice of its own.
SLICE_BYTES = 4 << 20
#: Comparisons of one step.
STEP = 1 << 20


def least_overlap(least_words: int = LEAST_WORDS, least_power: int = LEAST_POWER) -> int:
    """Words that any run shares with itself, a period later: the least over all periods."""
    return min(max(least_words, least_power * q) - q for q in range(1, least_words + 1))


def masked(ids: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Whether each word lies in a k-gram that its document holds twice. Hashes may
    coincide, which only lets words pass that are compared exactly later."""
    n = len(ids) - k + 1
    if n < 1:
        return np.zeros(len(ids), dtype=bool)
    gram = doc[:n].astype(np.uint64)
    for j in range(k):
        gram = (gram ^ ids[j : j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        gram ^= gram >> np.uint64(29)
    again = pd.Series(gram).duplicated(keep=False).to_numpy() & (doc[:n] == doc[k - 1 :])
    step = np.zeros(len(ids) + 1, np.int64)
    step[:n] += again
    step[k : k + n] -= again
    return np.cumsum(step[:-1]) > 0


class Extensions:
    """Names of the 2 ** j-grams of a sequence, and how far two places agree."""

    def __init__(self, ids: np.ndarray):
        self.names = [ids]
        while True:
            last, width = self.names[-1], 1 << (len(self.names) - 1)
            if len(last) <= width:
                break
            codes, found = pd.factorize(last[:-width].astype(np.int64) * (len(ids) + 1) + last[width:])
            if len(found) == len(codes):  # nothing comes twice
                break
            self.names.append(codes)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from a and b on."""
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            names = self.names[j]
            x, y = a + out, b + out
            inside = (x < len(names)) & (y < len(names))
            same = inside.copy()
            same[inside] = names[x[inside]] == names[y[inside]]
            out += same.astype(np.int64) << j
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree up to a and b, these left out."""
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.names) - 1, -1, -1):
            names, width = self.names[j], 1 << j
            x, y = a - out - width, b - out - width
            inside = (x >= 0) & (y >= 0)
            same = inside.copy()
            same[inside] = names[x[inside]] == names[y[inside]]
            out += same.astype(np.int64) << j
        return out


def runs_of(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, least_words: int = LEAST_WORDS, least_power: int = LEAST_POWER) -> np.ndarray:
    """Rows (start, end, period) of all runs inside the pieces [start, end) of ids, in this order.

    Pieces must be parted by names that come once.
    """
    table, found = Extensions(ids), [np.zeros((0, 3), np.int64)]
    while True:
        big = ends - starts >= least_words
        starts, ends = starts[big], ends[big]
        if not len(starts):
            break
        middle, periods = (starts + ends) // 2, (ends - starts) // least_power
        upto = np.cumsum(periods)
        for lo in range(0, int(upto[-1]), STEP):
            at = np.arange(lo, min(lo + STEP, int(upto[-1])))
            piece = np.searchsorted(upto, at, side="right")
            q = at - (upto[piece] - periods[piece]) + 1
            m, a, e = middle[piece], starts[piece], ends[piece]
            # The run holds m - 1 and m. Where it goes on for a period from m, m - 1 agrees with a period later, else with a period before.
            for left, right, inside in ((m - 1, m - 1 + q, m - 1 + q < e), (m - 1 - q, m - 1, m - 1 - q >= a)):
                agree = np.flatnonzero(inside)
                agree = agree[ids[left[agree]] == ids[right[agree]]]
                x, y, p = left[agree], right[agree], q[agree]
                # Few of them overlap themselves far enough; the forward part settles most.
                on, back = table.forward(x, y), table.backward(x, y)
                good = on + back + p >= np.maximum(least_words, least_power * p)
                found.append(np.stack([(x - back)[good], (y + on)[good], p[good]], axis=1))
        starts, ends = np.concatenate([starts, middle]), np.concatenate([middle, ends])
    all_ = np.concatenate(found)
    # A stretch found with several periods has the smallest; the others are its multiples.
    all_ = all_[np.lexsort((all_[:, 2], all_[:, 1], all_[:, 0]))]
    first = np.ones(len(all_), dtype=bool)
    first[1:] = (all_[1:, :2] != all_[:-1, :2]).any(axis=1)
    all_ = all_[first]
    return all_[np.lexsort((all_[:, 1], all_[:, 2], all_[:, 0]))]


def document_runs(words: list[list[bytes]], least_words: int = LEAST_WORDS, least_power: int = LEAST_POWER) -> tuple[np.ndarray, np.ndarray]:
    """Rows (document, start, length, period) of the runs, in order of document, start, period; and the words' documents."""
    doc = np.repeat(np.arange(len(words)), [len(w) for w in words])
    first = np.searchsorted(doc, np.arange(len(words)))
    flat = pa.array([x for w in words for x in w], pa.large_binary())
    ids = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    keep = masked(ids, doc, least_overlap(least_words, least_power))
    at = np.flatnonzero(keep)
    if not len(at):
        return np.zeros((0, 4), np.int64), doc
    # Surviving stretches stand one after another, with a name that comes once between them.
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (doc[at[1:]] != doc[at[:-1]])]))
    size = np.diff(np.append(new, len(at)))
    long = size >= least_words
    new, size = new[long], size[long]
    if not len(new):
        return np.zeros((0, 4), np.int64), doc
    starts = np.cumsum(size + 1) - size - 1
    origin = at[new]
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    place = np.repeat(starts, size) + inner
    line = np.empty(int((size + 1).sum()), np.int64)
    line[place] = ids[np.repeat(origin, size) + inner]
    names, _ = pd.factorize(line[place])
    line[place] = names
    line[starts + size] = len(names) + np.arange(len(starts))
    found = runs_of(line, starts, starts + size, least_words, least_power)
    piece = np.searchsorted(starts, found[:, 0], side="right") - 1
    start = found[:, 0] - starts[piece] + origin[piece]
    of = doc[start] if len(start) else start
    return np.stack([of, start - first[of], found[:, 1] - found[:, 0], found[:, 2]], axis=1), doc


def collapsed(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, least_power: int = LEAST_POWER) -> DataFrame:
    """One row per document: doc_id, runs (array of start, length, period, by start and period), collapsed.

    Starts are word numbers. `collapsed` has the words that lie in no run beyond
    that run's first period, joined by one space. A null text, an empty one and
    one of white space have no words. Each row stands for itself: repeated rows
    and null identifiers give rows of their own; an empty table gives an empty
    result, and other columns are ignored.
    """
    ship(docs.sparkSession)
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for batch in sliced(batches, "text", SLICE_BYTES):
            words = [t.encode().split() for t in batch.column(1).to_pylist()]
            found, doc = document_runs(words, least_words, least_power)
            n = np.bincount(found[:, 0], minlength=len(words))
            first = np.searchsorted(doc, np.arange(len(words)))
            step = np.zeros(len(doc) + 1, np.int64)
            begin = first[found[:, 0]] + found[:, 1]
            np.add.at(step, begin + found[:, 3], 1)
            np.add.at(step, begin + found[:, 2], -1)
            gone = np.cumsum(step[:-1]) > 0
            out = []
            for w, a, some in zip(words, first.tolist(), n.tolist(), strict=True):
                out.append(b" ".join([x for x, g in zip(w, gone[a : a + len(w)].tolist(), strict=True) if not g] if some else w).decode())
            runs = pa.StructArray.from_arrays([pa.array(found[:, c], pa.int64()) for c in (1, 2, 3)], fields=list(kind))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), runs)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(out, pa.string())], names=["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_loops(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with looped texts: with h the CRC-32 of the decimal identifier and g = h / 10,
    where h % 10 = 0 every word i >= a becomes word a + (i - a) % p of the text, with
    a = g % n and p = 1 + (n - a) / (3 + g % 8). Other texts, and those without
    identifier or words, stay as they are; looped ones have one space between words."""
    h, words = fresh(docs, "loop_hash", "loop_words")
    rows = docs.withColumn(h, F.crc32(F.col(key).cast("string").cast("binary")))
    looped = (F.col(h) % 10 == 0) & text_or_empty(text).rlike(r"[^\x20\x09-\x0D]")
    rows = rows.withColumn(words, F.when(looped, F.filter(F.split(F.col(text), SPACE), lambda w: w != "")))
    n, g = F.size(words).cast("long"), F.expr(f"{h} div 10")
    a = g % n
    p = 1 + F.expr(f"(size({words}) - ({h} div 10) % size({words})) div (3 + ({h} div 10) % 8)")
    pick = lambda i: F.get(F.col(words), F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))
    made = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), pick), " ")
    return rows.withColumn(text, F.when(F.col(words).isNotNull(), made).otherwise(F.col(text))).drop(h, words)


def _best(runs: Column) -> Column:
    """The run with the greatest length / period; ties: smallest start, then period."""
    more = lambda a, x: x["length"] * a["period"] > a["length"] * x["period"]
    return F.aggregate(F.slice(runs, 2, 1 << 30), F.get(runs, F.lit(0)), lambda a, x: F.when(more(a, x), x).otherwise(a))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collapsed(with_loops(documents(spark, sf_dir).select("doc_id", "text"))).withColumn("best", _best(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
