"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes some twenty numbers (make-up of its bytes, words, lines and
repetition). Training visits the features in turn, many times, and fits a tree
of at most four leaves on the binned feature to the current gradients; the
shrunken leaves add up in one lookup table per feature. The pairs that explain
most of what is left get two-way tables in the same way. A score is the
logistic of a sum of table entries, looked up for whole Arrow batches.

Training runs on the driver over at most SAMPLE labelled rows, chosen by hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, ship, text_or_empty
from .shingles import _SPACE, text_bytes, word_hashes

SAMPLE = 20_000
BINS = 32
ROUNDS = 120
PAIR_ROUNDS = 40
PAIRS = 6
COARSE = 8
RATE = 0.15
RIDGE = 2.0
SLICE_BYTES = (1 << 18) - 1

FEATURES = (
    "chars", "words", "lines", "upper", "digit", "other", "wide", "space", "word_length", "shout_words", "symbol_words", "lone_symbol_words",
    "distinct_words", "top_word", "repeat_word", "distinct_pairs", "sentence_ends", "line_words", "distinct_lines", "first_upper_words",
)

_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LOWER = np.zeros(256, np.int64)
_LOWER[97:123] = 1
_LOWER[128:] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_WIDE = np.zeros(256, np.int64)
_WIDE[128:] = 1
_STOP = np.zeros(256, np.int64)
_STOP[[33, 46, 63]] = 1
_OTHER = np.zeros(256, np.int64)
_OTHER[33:48] = _OTHER[58:65] = _OTHER[91:97] = _OTHER[123:127] = 1
_OTHER[[44, 46]] = 0


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values, and of the most frequent one, in each row."""
    kinds, most = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b > a:
            v = np.sort(values[a:b])
            at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1], [True]]))
            kinds[i], most[i] = len(at) - 1, np.diff(at).max()
    return kinds, most


def features(column: pa.Array) -> np.ndarray:
    """FEATURES of whole texts, one row each; zeros for the empty text."""
    raw, offsets = text_bytes(column)
    hashes, count = word_hashes(raw, offsets)
    word_at = np.concatenate([[0], np.cumsum(count)])
    chars = np.diff(offsets).astype(float)
    words = count.astype(float)
    n, w = np.maximum(chars, 1), np.maximum(words, 1)
    upper, lower = _per_row(_UPPER[raw], offsets), _per_row(_LOWER[raw], offsets)
    space = _per_row(_SPACE[raw], offsets)
    feed = raw == 10
    lines = _per_row(feed, offsets) + (chars > 0)
    # Per word: how many capitals, letters and symbols it has.
    inside = ~_SPACE[raw]
    begin = np.zeros(len(raw), dtype=bool)
    if len(raw):
        begin[0] = inside[0]
        begin[1:] = inside[1:] & ~inside[:-1]
        edge = offsets[:-1][chars > 0]
        begin[edge] = inside[edge]
    first = np.flatnonzero(begin)
    ends = np.append(first[1:], len(raw))
    tally = lambda t: (c := np.concatenate([[0], np.cumsum(t[raw])]))[ends] - c[first]
    up, low, symbols = tally(_UPPER), tally(_LOWER), tally(_OTHER)
    per_word = lambda flags: _per_row(flags, word_at)
    kinds, most = _distinct(hashes, word_at)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[word_at[:-1][count > 0]] = False
    pair = hashes.copy()
    with np.errstate(over="ignore"):
        pair[:-1] += hashes[1:] * np.uint64(0x9E3779B97F4A7C15)
    pairs, _ = _distinct(pair, word_at)
    # Lines by the sum of their words' hashes.
    breaks = np.flatnonzero(feed)
    line_start = np.unique(np.concatenate([offsets[:-1][chars > 0], breaks + 1]))
    line_start = line_start[line_start < len(raw)]
    at_word = np.concatenate([np.searchsorted(first, line_start), [len(first)]])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes)])
    line_hash = sums[at_word[1:]] - sums[at_word[:-1]]
    line_at = np.searchsorted(line_start, offsets)
    line_kinds, _ = _distinct(line_hash, line_at)
    out = np.stack([
        np.log1p(chars), np.log1p(words), np.log1p(lines), upper / np.maximum(upper + lower, 1), _per_row(_DIGIT[raw], offsets) / n, _per_row(_OTHER[raw], offsets) / n,
        _per_row(_WIDE[raw], offsets) / n, space / n, (chars - space) / w, per_word((up > 1) & (low == 0)) / w, per_word((symbols > 0) & (up + low > 0)) / w, per_word((symbols > 0) & (up + low == 0)) / w,
        kinds / w, most / w, per_word(same) / w, pairs / w, _per_row(_STOP[raw], offsets) / w, words / np.maximum(lines, 1), line_kinds / np.maximum(np.diff(line_at), 1), per_word((up > 0) & (low > 0)) / w,
    ], axis=1)
    out[chars == 0] = 0
    return out


@dataclass
class Additive:
    """base + sum of cuts-indexed tables + sum of pair tables, as a log-odds."""

    base: float
    cuts: list[np.ndarray]
    tables: np.ndarray
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        c = b * COARSE // BINS
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[c[:, i], c[:, j]]
        return 1 / (1 + np.exp(-out))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Step function over bins: best-first splits of the gradient histogram."""
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + RIDGE)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a > 1:
                m = np.arange(a + 1, b)
                gains = gain(a, m) + gain(m, b) - gain(a, b)
                k = int(np.argmax(gains))
                if gains[k] > best[0]:
                    best = (gains[k], (a, b), int(m[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + RIDGE)
    return out


def _best_cut(G: np.ndarray, H: np.ndarray) -> tuple[float, np.ndarray]:
    """The cut in each of two dimensions with the best four leaves, as a table."""
    g, h = np.zeros((COARSE + 1,) * 2), np.zeros((COARSE + 1,) * 2)
    g[1:, 1:], h[1:, 1:] = G.cumsum(0).cumsum(1), H.cumsum(0).cumsum(1)
    best, table = 0.0, np.zeros((COARSE, COARSE))
    for i in range(1, COARSE):
        for j in range(1, COARSE):
            boxes = [(0, i, 0, j), (i, COARSE, 0, j), (0, i, j, COARSE), (i, COARSE, j, COARSE)]
            s = [(g[b, d] - g[a, d] - g[b, c] + g[a, c], h[b, d] - h[a, d] - h[b, c] + h[a, c]) for a, b, c, d in boxes]
            gain = sum(x * x / (y + RIDGE) for x, y in s)
            if gain > best:
                best, table = gain, np.zeros((COARSE, COARSE))
                for (a, b, c, d), (x, y) in zip(boxes, s, strict=True):
                    table[a:b, c:d] = x / (y + RIDGE)
    return best, table


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS) -> Additive:
    """Cyclic boosting of logistic loss. One class only gives its smoothed rate."""
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
    model = Additive(base, cuts, np.zeros((len(FEATURES), BINS)), [], np.zeros((0, COARSE, COARSE)))
    if len(x) == 0 or y.min() == y.max():
        return model
    b = model.bins(x)
    out = np.full(len(x), base)
    for _ in range(rounds):
        for j in range(len(FEATURES)):
            p = 1 / (1 + np.exp(-out))
            step = RATE * _tree(np.bincount(b[:, j], y - p, BINS), np.bincount(b[:, j], p * (1 - p), BINS))
            model.tables[j] += step
            out += step[b[:, j]]
    c = b * COARSE // BINS

    def cells(i, j, p):
        at = c[:, i] * COARSE + c[:, j]
        return at, np.bincount(at, y - p, COARSE**2).reshape(COARSE, COARSE), np.bincount(at, p * (1 - p), COARSE**2).reshape(COARSE, COARSE)

    p = 1 / (1 + np.exp(-out))
    ranked = sorted(((-_best_cut(*cells(i, j, p)[1:])[0], i, j) for i in range(len(FEATURES)) for j in range(i)), key=lambda t: t)
    model.pairs = [(i, j) for _, i, j in ranked[:pairs]]
    model.pair_tables = np.zeros((len(model.pairs), COARSE, COARSE))
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-out))
            at, g, h = cells(i, j, p)
            step = RATE * _best_cut(g, h)[1]
            model.pair_tables[k] += step
            out += step.ravel()[at]
    return model


def held_out(key: Column) -> Column:
    """Rows that training never sees: crc32 of the identifier as text, mod 3, is 1."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _slices(column: pa.Array):
    """Runs of a string column of about SLICE_BYTES, so that numpy's arrays stay small."""
    _, offsets = text_bytes(column)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, side="right")) - 1)
        yield column.slice(start, end - start)
        start = end


def _feature_column(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        x = np.concatenate([features(s) for s in _slices(column)]) if len(column) else np.zeros((0, len(FEATURES)))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))

    return run(text)


def trained(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Additive:
    """A model of `label` from at most `sample` labelled rows outside the held-out fold.

    Rows without an identifier or label are ignored, and so are identifiers
    with contradictory labels. Of rows that repeat an identifier the one with the
    smallest features counts, so that the driver gets `sample` rows at most.
    """
    ship(docs.sparkSession)
    chosen = (
        labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y in (0, 1)").filter(~held_out(F.col("id")))
        .groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").select("id", "y")
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    # At most `sample` rows of two numbers: broadcast.
    rows = docs.select(F.col(key).alias("id"), text_or_empty(text).alias("text")).join(F.broadcast(chosen), "id")
    got = rows.select("id", "y", _feature_column(F.col("text")).alias("x")).groupBy("id", "y").agg(F.min("x").alias("x")).toArrow().sort_by([("id", "ascending")])
    x = np.asarray(got.column("x").combine_chunks().flatten() if got.num_rows else [], dtype=float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, got.column("id").to_numpy()))
    return fit(x[order], got.column("y").to_numpy()[order].astype(float))


def score_column(model: Additive, text: Column) -> Column:
    """Score in [0, 1]; the null text counts as empty."""

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([model.score(features(s)) for s in _slices(column)]) if len(column) else np.zeros(0))

    return run(F.coalesce(text, F.lit("")))


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts are scored as empty. Repeated rows, and rows without
    an identifier, are scored each for itself; without usable labels every
    score is 0.5. Other columns are ignored.
    """
    model = trained(docs, labels, key, text, **options)
    out = docs.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), score_column(model, F.col(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents the model accepts (score at least 0.5), with their own columns."""
    score, = fresh(docs, "score")
    model = trained(docs, labels, key, text, **options)
    return docs.withColumn(score, score_column(model, F.col(text))).filter(F.col(score) >= 0.5).drop(score)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
