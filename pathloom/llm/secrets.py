"""Secret scans: fixed patterns, and windows of high Shannon entropy.

Candidate strings are long runs of token characters. A window slides over a
candidate while the counts of its characters, and the sum of c * log2(c), are
updated by the character that enters and the one that leaves; windows above the
limit of the candidate's character class (digits, hexadecimal, letters of one
case, any) merge into one span. Allow-listed candidates are suppressed: UUIDs,
paths and names made of words and short numbers, repeats of one character.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ship, text_or_empty

ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# The look-behind keeps leftmost matches and spares a start at every character of a run.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Character classes, each with its least entropy in bits a character.
CLASSES = (
    ("digits", re.compile(r"[0-9]+"), 2.7),
    ("hex", re.compile(r"[0-9a-fA-F]+"), 3.0),
    ("letters", re.compile(r"[A-Z]?[a-z]+|[A-Z]+"), 3.7),
    ("token", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.7),
)
_PART = r"(?:[A-Z]?[a-z]{1,15}|[A-Z]{1,15}|[0-9]{1,8}|v[0-9]{1,3})"
#: Harmless shapes of candidates.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),  # UUIDs
    re.compile(rf"{_PART}([_/=+-]+{_PART})+[_/=+-]*"),  # words and numbers joined by signs, as in paths
    re.compile(r"[A-Z]?[a-z]{2,15}([A-Z][a-z]{2,15})+"),  # words run together, each with a capital
    re.compile(r"(.)\1*"),
)

_LOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def hot_windows(text: str, limit: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged spans of the windows with at least `limit` bits a character."""
    if len(text) < window:
        return []
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        total += _LOG[n + 1] - _LOG[n]
        counts[c] = n + 1
        if i + 1 < window:
            continue
        if math.log2(window) - total / window >= limit - 1e-9:
            a, b = i + 1 - window, i + 1
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
        old = text[i + 1 - window]
        n = counts[old]
        total += _LOG[n - 1] - _LOG[n]
        counts[old] = n - 1
    return spans


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in the order start, kind."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda s: (s[0], s[2]))]


def entropy_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in CANDIDATE.finditer(text):
        found = m[0]
        limit = next(t for _, pattern, t in CLASSES if pattern.fullmatch(found))
        if not any(p.fullmatch(found) for p in ALLOWED):
            out += [(m.start() + a, m.start() + b, "entropy") for a, b in hot_windows(found, limit)]
    return out


def outside(added: list[tuple], base: list[tuple]) -> list[tuple]:
    """The added spans that no base span contains, by one search in the sorted base spans each."""
    starts, reach = [], []
    for a, b, _ in sorted(base):
        starts.append(a)
        reach.append(max(b, reach[-1]) if reach else b)
    return [s for s in added if not (k := bisect_right(starts, s[0])) or reach[k - 1] < s[1]]


def span_rows(texts: list[str], base: Callable, added: Callable, kinds: tuple[str, ...], by_kind: bool) -> pa.Array:
    """Per text: counts of the base kinds, digest of its base spans, all spans."""
    order = (lambda s: (kinds.index(s[2]), s[0], s[1])) if by_kind else (lambda s: (s[0], kinds.index(s[2]), s[1]))
    line = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=order))
    nothing = hashlib.sha256(b"").hexdigest()
    counts, digests, whole = [[] for _ in kinds[:-1]], [], []
    for text, more in zip(texts, added(texts), strict=True):
        own = base(text)
        for column, kind in zip(counts, kinds[:-1], strict=True):
            column.append(sum(s[2] == kind for s in own))
        digests.append(hashlib.sha256(line(own).encode()).hexdigest() if own else nothing)
        whole.append(line(own + outside(more, own)))
    return pa.StructArray.from_arrays([*[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(whole, pa.string())], names=[*[f"n_{k}" for k in kinds[:-1]], "base_sha256", "spans"])


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null text counts as empty and has no span. Repeated rows and null
    identifiers are scanned each for itself; other columns are ignored; an
    empty table gives an empty result.
    """
    ship(docs.sparkSession)

    @F.arrow_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def scan(column: pa.Array) -> pa.Array:
        return span_rows(column.to_pylist(), base_spans, lambda texts: map(entropy_spans, texts), KINDS, False)

    return docs.select(F.col(key).alias("doc_id"), scan(text_or_empty(text)).alias("found")).select("doc_id", "found.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(documents(spark, sf_dir))
