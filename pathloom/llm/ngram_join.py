"""N-gram Jaccard self-join by PartEnum signatures.

Sets are grouped in size bands; a set emits signatures for its own band and,
if a larger partner may lie there, for the next. In a band with largest size r
two similar sets differ in at most k = 2r/9 elements (similarity 0.8), so the
domain of shingle hashes is partitioned into more than (k+1)/2 groups of three
cells: in some groups the sets differ in one element at most, and two of the
three cells agree. Every subset of two cells is one signature, skipped if it is
empty. A set whose groups hold too many empty cells for that argument also emits
the prefix-filter signatures of its band, where it meets the other such sets.

A bucket's classes are compared with one of them, its pivot, first; classes that
then lie in one component need no look at each other. Of a small bucket that still
spans several components, all pairs across them are compared. A larger one is hot.
A set's slack is the number of its groups that must agree with any similar set: a
set with fewer hot signatures than its slack meets every partner in a small bucket,
so only the others (mostly members of large groups of near copies) are looked at in
hot buckets. Buckets whose pivots lie in one component make one group, and a group's
pairs across components are held against each other by their histograms, block by
block. In a group of more classes than DIRECT a signature is needed again: two sets'
distance is that of their differences from the pivot,
so sets that link with the pivot need no look at each other, and any other link
must share an element of short prefixes of the differences. Those elements are
signatures in turn, with new pivots; every level drops the pivot, so it ends and no
link is lost.

Candidate pairs are first held against small histograms of the sets; the sets
themselves are fetched, by a scan, for the pairs that remain.

Equal sets form one class and take part once. Signatures travel packed, in
blocks of one task and one hash range; members of a bucket that its task already
knows to be hot travel apart, spread by task. The contract asks for connected
components, so pairs within a component that is known are not verified: the
operator returns components, not every link.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import documents, drop_stored, flagged, fresh, join_groups, ship, sliced, stored, text_or_empty, trim
from .shingles import U, mix, set_keys, shingle_sets

#: Bytes of text at a time: the arrays made of them are some 60 times as large.
SLICE_BYTES = (1 << 18) - 1
BAND_RATIO = 1.5
SLACK = 0.06
PER_PART = 1_200_000
#: The signatures travel in so many passes over the texts, each with its share of the hash ranges: a pass's shuffle goes before the next.
PASSES = 1
#: Pairs that are compared at a time, with their own sets.
SLICE_PAIRS = 200_000
#: One partner of each set is compared before the others where sets have more partners than this on average.
FEW_PARTNERS = 6
#: Rows of an Arrow batch: their texts or sets are held by the executor and by its Python worker.
BATCH_ROWS = 1000
BLOCK_SIGNATURES = 400_000
#: Classes of a bucket that gives all its pairs.
SMALL_BUCKET = 16
#: Members of a bucket in one block; those beyond travel apart.
BLOCK_MEMBERS = 256
#: The same for signatures of differences, which are far more selective.
SMALL_DIFFERENCE = 256
#: Classes of a group that is compared block by block, and of a block.
DIRECT, BLOCK_CLASSES = 1 << 16, 1 << 12
BAND_STEP = 1.35
SEEN_CLASSES = 200_000
#: Bits of a histogram's ranges for sets above and up to a size.
RANGES = ((5, 0, 150), (7, 150, 1000), (10, 1000, 8000), (12, 8000, 1 << 62))


@lru_cache(maxsize=4096)
def band_limits() -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest size of each band."""
    low, high = [1], []
    while low[-1] < 1 << 40:
        high.append(max(low[-1], math.floor(low[-1] * BAND_RATIO)))
        low.append(high[-1] + 1)
    return np.array(low[:-1]), np.array(high)


@lru_cache(maxsize=4096)
def partition(band: int) -> tuple[int, np.ndarray]:
    """Groups of a band and the inner bounds of its cells in the hash domain."""
    k = 2 * int(band_limits()[1][band]) // 9
    groups = (k + 2) // 2 + int(SLACK * (k + 1))
    cells = 3 * groups
    return groups, np.array([(c << 64) // cells for c in range(1, cells)], dtype=np.uint64)


def tags(n: int) -> list[int]:
    """Bands a set of n elements emits signatures for."""
    low, high = band_limits()
    own = int(np.searchsorted(low, n, side="right")) - 1
    return [own] if n * 5 < int(low[own + 1]) * 4 else [own, own + 1]


def signatures(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the sets, the number of each set's, and each set's slack (255 at most)."""
    low, high = band_limits()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h))])
    bounds, owner, shape, plain, plain_owner = [], [], [], [], []
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for band in tags(b - a) if b > a else ():
            groups, inner = partition(band)
            bounds.append(np.concatenate([[a], a + np.searchsorted(h[a:b], inner), [b]]))
            owner.append(row)
            shape.append((band, groups))
    slack = np.full(len(offsets) - 1, 255)
    if not bounds:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64), slack
    cells = np.array([3 * g for _, g in shape])
    at = np.concatenate(bounds)
    last = np.cumsum(cells + 1) - 1
    inside = np.ones(len(at), dtype=bool)
    inside[last] = False
    left = np.flatnonzero(inside)
    content = (sums[at[left + 1]] - sums[at[left]]).reshape(-1, 3)
    count = (at[left + 1] - at[left]).reshape(-1, 3)
    group_rows = np.array([g for _, g in shape])
    number = np.arange(group_rows.sum()) - np.repeat(np.cumsum(group_rows) - group_rows, group_rows)
    band_of = np.repeat(np.array([b for b, _ in shape]), group_rows)
    place = mix(number.astype(np.uint64) * U(4) + band_of.astype(np.uint64) * U(1 << 40))
    out, who = [], []
    group_owner = np.repeat(np.array(owner), group_rows)
    for k, (x, y) in enumerate(((0, 1), (0, 2), (1, 2))):
        some = count[:, x] + count[:, y] > 0
        out.append(mix(content[some, x] + mix(content[some, y] + U(k)) + place[some]))
        who.append(group_owner[some])
    # A set is covered if its fully occupied groups outnumber half the largest distance.
    good = np.add.reduceat((count > 0).sum(axis=1) >= 2, np.cumsum(group_rows) - group_rows)
    for (band, _), row, g in zip(shape, owner, good.tolist(), strict=True):
        n = int(offsets[row + 1] - offsets[row])
        k = (n + min(int(high[band]), n * 5 // 4)) // 9
        if k:
            slack[row] = max(0, min(int(slack[row]), g - k // 2))
        if k and 2 * g < k + 1:
            prefix = n - -(-4 * n // 5) + 1
            plain.append(mix(h[offsets[row] : offsets[row] + prefix] + U((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
            plain_owner.append(np.full(prefix, row))
    who = np.concatenate([*who, *plain_owner])
    order = np.argsort(who, kind="stable")
    return np.concatenate([*out, *plain])[order], np.bincount(who, minlength=len(offsets) - 1), slack


def _kept(df: DataFrame, name: str) -> DataFrame:
    return stored(df, name, BATCH_ROWS)


def class_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (doc_id, class_id string, k long, n long), one per document.

    class_id names the set; it is null for a text without words. k is its
    first half, which the candidate search uses.
    """

    def run(batches):
        for batch in sliced(batches, "text", SLICE_BYTES):
            h, offsets = shingle_sets(batch.column(1))
            a, b = set_keys(h, offsets)
            size = np.diff(offsets)
            raw = np.stack([a, b], axis=1).astype(">u8").tobytes().hex()
            names = [raw[32 * i : 32 * i + 32] if n else None for i, n in enumerate(size.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(a.view(np.int64)), pa.array(size)], names=["doc_id", "class_id", "k", "n"])
        trim()

    return docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, "doc_id long, class_id string, k long, n long")


BLOCKS = "part int, salt int, keys binary, sizes binary, slack binary, counts binary, sigs binary"

#: Sizes travel as steps of this ratio in the first search; STEPS of them exceed a ratio of 5 / 4.
SIZE_RATIO, STEPS = 1.06, 5


def size_steps(sizes: np.ndarray) -> np.ndarray:
    """Sizes as one byte; from about 2.8 million on all have the same."""
    return np.minimum(np.log(np.maximum(sizes, 1)) / math.log(SIZE_RATIO), 255).astype(np.uint8)


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    part, salt, *binary = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(salt, pa.int32()), *[pa.array(c, pa.binary()) for c in binary]], names=["part", "salt", "keys", "sizes", "slack", "counts", "sigs"])


def _packed(parts: int, held: list[tuple], task: int | None = None):
    """Batches of BLOCKS of (keys, sizes, slack, counts, signatures) arrays, by hash range.

    With a task number, members beyond BLOCK_MEMBERS + 1 of a signature go to
    blocks of their own, salted with the task: the first ones make it hot.
    """
    keys, sizes, slack, counts, sigs = (np.concatenate(c) for c in zip(*held, strict=True))
    row = np.repeat(np.arange(len(keys)), counts)
    salt = np.zeros(len(sigs), np.int64)
    if task is not None:
        order = np.argsort(sigs, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], sigs[order][1:] != sigs[order][:-1]])) if len(sigs) else np.zeros(0, np.int64)
        rank = np.arange(len(sigs)) - np.repeat(new, np.diff(np.append(new, len(sigs))))
        salt[order[rank > BLOCK_MEMBERS]] = task + 1
    part = ((sigs >> U(32)) * U(parts) >> U(32)).astype(np.int64) * 2 + (salt > 0)
    order = np.argsort(part, kind="stable")
    part, row, low = part[order], row[order], sigs[order].astype(np.uint32)
    cuts = np.searchsorted(part, np.arange(2 * parts + 1))
    rows = []
    for p in range(2 * parts):
        a, b = cuts[p], cuts[p + 1]
        if a == b:
            continue
        head = np.flatnonzero(np.concatenate([[True], row[a + 1 : b] != row[a : b - 1]]))
        own = row[a:b][head]
        count = np.diff(np.append(head, b - a))
        while count.max() > 255:  # one byte counts the signatures of a set in a range
            more = np.maximum(count - 255, 0)
            count, own = np.stack([np.minimum(count, 255), more], axis=1).reshape(-1), np.repeat(own, 2)
            count, own = count[count > 0], own[count > 0]
        rows.append((p // 2, (task + 1) if p % 2 else 0, keys[own].tobytes(), sizes[own].tobytes(), slack[own].tobytes(), count.astype(np.uint8).tobytes(), low[a:b].tobytes()))
        if len(rows) == 512:
            yield _batch_of(rows)
            rows = []
    if rows:
        yield _batch_of(rows)


def signature_blocks(docs: DataFrame, text: str, parts: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """Packed signatures (BLOCKS) of one turn's hash ranges; a task packs a set it has seen once."""

    def run(batches):
        from pyspark import TaskContext

        seen: set[int] = set()
        held, total, task = [], 0, TaskContext.get().partitionId()
        for batch in sliced(batches, "text", SLICE_BYTES):
            h, offsets = shingle_sets(batch.column(0))
            keys, _ = set_keys(h, offsets)
            sizes = np.diff(offsets)
            if len(seen) > SEEN_CLASSES:
                seen = set()
            new = np.zeros(len(sizes), dtype=bool)
            for i, (k, n) in enumerate(zip(keys.tolist(), sizes.tolist(), strict=True)):
                if n and k not in seen:
                    seen.add(k)
                    new[i] = True
            h = h[np.repeat(new, sizes)]
            keys, sizes = keys[new], sizes[new]
            sigs, counts, slack = signatures(h, np.concatenate([[0], np.cumsum(sizes)]))
            mine = (sigs >> U(32)) * U(parts) >> U(32)
            mine = mine % U(turns) == U(turn)
            counts = np.bincount(np.repeat(np.arange(len(sizes)), counts)[mine], minlength=len(sizes))
            sigs = sigs[mine]
            held.append((keys, size_steps(sizes), slack.astype(np.uint8), counts, sigs))
            total += len(sigs)
            if total >= BLOCK_SIGNATURES:
                yield from _packed(parts, held, task)
                held, total = [], 0
        if held:
            yield from _packed(parts, held, task)
        del held, seen
        trim()

    return docs.select(text_or_empty(text).alias("text")).mapInArrow(run, BLOCKS)


#: A size's top bit marks a class of the pivot's component: two of them need no look.
SETTLED = 1 << 31

#: kind 1, class k of the small bucket; 2, of the large one; 3, class k has this number of hot signatures more.
FOUND = "kind byte, bucket long, k long, slack short"
FINE = "kind byte, bucket long, k long, at long, away long"


def _joined(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=dtype)


def _runs(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal, sorted signatures."""
    head = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    return head, np.diff(np.append(head, len(sig)))


def _members(head: np.ndarray, run: np.ndarray) -> np.ndarray:
    return np.arange(run.sum()) + np.repeat(head - (np.cumsum(run) - run), run)


def _found(kind: np.ndarray, bucket: np.ndarray, key: np.ndarray, slack: np.ndarray, hot_key: np.ndarray, hot_slack: np.ndarray) -> pa.Table:
    """Rows of FOUND; the hot keys stand for one hot signature each."""
    who, at, many = np.unique(hot_key, return_index=True, return_counts=True)
    return pa.table({
        "kind": pa.array(np.concatenate([kind, np.full(len(who), 3)]).astype(np.int8)), "bucket": np.concatenate([bucket, many]),
        "k": np.concatenate([key, who]), "slack": np.concatenate([slack, hot_slack[at]]).astype(np.int16),
    })


def _coarse(table: pa.Table) -> pa.Table:
    """FOUND of one hash range of the sets' signatures, or of one task's members of hot ones.

    Buckets that can't have members elsewhere are named by their members, so that
    equal ones are one.
    """
    part, salt = table.column("part")[0].as_py(), table.column("salt")[0].as_py()
    counts = _joined(table, "counts", np.uint8)
    sig = _joined(table, "sigs", np.uint32)
    key, step, slack = (np.repeat(_joined(table, name, dtype), counts) for name, dtype in (("keys", np.int64), ("sizes", np.uint8), ("slack", np.uint8)))
    if salt:
        out = _found(np.full(len(sig), 2), sig.astype(np.int64) << 31 ^ part, key, slack, key, slack)
        trim()
        return out
    order = np.lexsort((key, sig))
    sig, key, step, slack = sig[order], key[order], step[order], slack[order]
    new = np.ones(len(sig), dtype=bool)
    new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
    sig, key, step, slack = sig[new], key[new], step[new].astype(np.int16), slack[new]
    head, run = _runs(sig)
    # A bucket counts if two of its members may be similar by size.
    spread = np.maximum.reduceat(step, head) - np.minimum.reduceat(step, head) if len(head) else run
    near = run > 1
    for b in np.flatnonzero(near & (spread > STEPS) & (run <= SMALL_BUCKET)):
        near[b] = (np.diff(np.sort(step[head[b] : head[b] + run[b]])) <= STEPS).any()
    head, run = head[near], run[near]
    hot = _members(head[run > SMALL_BUCKET], run[run > SMALL_BUCKET])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(key.view(np.uint64)))])
    name = mix(total[head + run] - total[head]).view(np.int64)
    shared = run > BLOCK_MEMBERS
    name[shared] = sig[head[shared]].astype(np.int64) << 31 ^ part
    name, once = np.unique(name, return_index=True)
    head, run = head[once], run[once]
    member = _members(head, run)
    out = _found(np.repeat(np.where(run > SMALL_BUCKET, 2, 1), run), np.repeat(name, run), key[member], slack[member], key[hot], slack[hot])
    del order, key, step, slack, sig, total, member
    trim()
    return out


def _fine(table: pa.Table) -> pa.Table:
    """FINE of one hash range of the signatures of differences.

    A signature's upper half is its position, and a size's the distance from the pivot.
    """
    part = table.column("part")[0].as_py()
    counts = _joined(table, "counts", np.uint32)
    key, size, sig = np.repeat(_joined(table, "keys", np.int64), counts), np.repeat(_joined(table, "sizes", np.uint64), counts), _joined(table, "sigs", np.uint64)
    at, away = (sig >> U(32)).astype(np.int64), (size >> U(32)).astype(np.int64)
    sig, size = sig.astype(np.uint32), size.astype(np.uint32)
    open_ = size < SETTLED
    order = np.lexsort((at, away, key, sig))
    sig, key, open_, at, away = sig[order], key[order], open_[order], at[order], away[order]
    new = np.ones(len(sig), dtype=bool)
    new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1]) | (away[1:] != away[:-1])
    sig, key, open_, at, away = sig[new], key[new], open_[new], at[new], away[new]
    size = size[order][new].astype(np.int64) & (SETTLED - 1)
    # A member stays if its position allows a link with the nearest partner its bucket may
    # hold: one that is open, or for an open member any. What goes may shut out others.
    for _ in range(3):
        head, run = _runs(sig)
        if not len(head):
            break
        of = np.repeat(np.arange(len(head)), run)
        least = [np.minimum.reduceat(v, head)[of] for v in (np.where(open_, away, 1 << 40), away)]
        largest = np.maximum.reduceat(size, head)[of]
        some = np.add.reduceat(open_.astype(np.int64), head)[of] > 0
        share = (away + np.where(open_, least[1], least[0]) - (size + largest) // 9 + 1) // 2
        keep = some & (run[of] > 1) & (at <= away - share)
        sig, key, open_, at, away, size = (v[keep] for v in (sig, key, open_, at, away, size))
    head, run = _runs(sig)
    first = np.add.reduceat(open_.astype(np.int64), head) if len(head) else run
    many = (run > 1) & (first > 0)
    head, run = head[many], run[many]
    member = _members(head, run)
    kind = np.repeat(np.where(run > SMALL_DIFFERENCE, 2, 1), run).astype(np.int8)
    out = pa.table({"kind": pa.array(kind), "bucket": np.repeat(sig[head].astype(np.int64), run) << 31 ^ part, "k": key[member], "at": at[member], "away": away[member]})
    del order, key, size, sig, at, away, member
    trim()
    return out


@lru_cache(maxsize=1)
def _distance_bands() -> np.ndarray:
    """Smallest distance from the pivot of each band."""
    low = [0]
    while low[-1] < 1 << 40:
        low.append(max(low[-1] + 1, math.floor(low[-1] * BAND_STEP)))
    return np.array(low)


def difference_signatures(x: np.ndarray, pivot: np.ndarray, salt: int, largest: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, int]:
    """Signatures of a set by its difference D from a pivot, their positions in D, and D's size.

    D has the elements of x alone, then those of the pivot alone, each in the order of their hash.

    A link's distance is at most a ninth of the sizes' sum: n / 4, or less if no
    set of the pivot is larger than `largest`. With a set at distance e from the
    pivot it shares at least (|D| + e - reach) / 2 elements of the differences,
    so one lies in the prefixes that remain. Where this is no element, both sets
    link with the pivot.
    """
    low = _distance_bands()
    diff = np.concatenate([np.setdiff1d(x, pivot, assume_unique=True), np.setdiff1d(pivot, x, assume_unique=True)])
    d, reach = len(diff), (len(x) + min(len(x) * 5 // 4, largest)) // 9
    own = int(np.searchsorted(low, d, side="right")) - 1
    bands = np.arange(int(np.searchsorted(low, max(0, d - reach), side="right")) - 1, int(np.searchsorted(low, d + reach, side="right")))
    need = np.maximum(1, (d + np.maximum(low[bands], d - reach) - reach + 1) // 2)
    prefix = np.clip(d - need + 1, 0, d)
    at = np.arange(prefix.sum()) - np.repeat(np.cumsum(prefix) - prefix, prefix)
    place = mix(np.minimum(bands, own).astype(np.uint64) * U(1 << 20) + np.maximum(bands, own).astype(np.uint64) + U(salt & (1 << 64) - 1))
    return mix(diff[at] + np.repeat(place, prefix)), at, d


def difference_blocks(tied: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """BLOCKS of the difference signatures of rows (k, p, open): class, its pivot, and
    whether they lie in different components."""

    def packed(held):
        keys, sizes, sigs, at = (np.concatenate(c) for c in list(zip(*held, strict=True))[:4])
        counts = np.concatenate([h[4] for h in held])
        part = ((sigs >> U(32)) * U(parts) >> U(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        row, part = np.repeat(np.arange(len(keys)), counts)[order], part[order]
        whole = at[order].astype(np.uint64) << U(32) | sigs[order].astype(np.uint32)
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        rows = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            head = np.flatnonzero(np.concatenate([[True], row[a + 1 : b] != row[a : b - 1]]))
            own = row[a:b][head]
            rows.append((int(part[a]), 0, keys[own].tobytes(), sizes[own].tobytes(), b"", np.diff(np.append(head, b - a)).astype(np.uint32).tobytes(), whole[a:b].tobytes()))
        for start in range(0, len(rows), 512):
            yield _batch_of(rows[start : start + 512])

    def run(batches):
        held, total = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                k, p, open_, n, most, items, pivot = batch.slice(start, 64).columns
                found = [difference_signatures(a.values.to_numpy().view(np.uint64), b.values.to_numpy().view(np.uint64), c, m) for a, b, c, m in zip(items, pivot, p.to_pylist(), most.to_pylist(), strict=True)]
                sigs, at, away = zip(*found, strict=True)
                sizes = n.to_numpy() | np.where(open_.to_numpy(zero_copy_only=False), 0, SETTLED) | np.array(away) << 32
                held.append((k.to_numpy().view(np.uint64), sizes, np.concatenate(sigs), np.concatenate(at), np.array([len(s) for s in sigs])))
                total += len(held[-1][2])
                if total >= BLOCK_SIGNATURES:
                    yield from packed(held)
                    held, total = [], 0
        if total:
            yield from packed(held)
        del held
        trim()

    most = tied.join(sets.select("k", "n"), "k").groupBy("p").agg(F.max("n").alias("most"))
    own = tied.join(sets.select("k", "n", "items"), "k")
    pivots = sets.join(most.select(F.col("p").alias("k"), "most"), "k").select(F.col("k").alias("p"), F.col("items").alias("pivot"), "most")
    return own.join(pivots, "p").select("k", "p", "open", "n", "most", "items", "pivot").mapInArrow(run, BLOCKS)


def histograms(h: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Elements of each set by equal ranges of the hash, cut at 255: more ranges
    for larger sets, so that few elements share one."""
    out: list[bytes] = [b""] * (len(offsets) - 1)
    size = np.diff(offsets)
    for bits, low, high in RANGES:
        rows = np.flatnonzero((size > low) & (size <= high))
        if len(rows):
            mine = np.concatenate([h[offsets[r] : offsets[r + 1]] for r in rows])
            at = np.repeat(np.arange(len(rows)), size[rows]) << bits | (mine >> U(64 - bits)).astype(np.int64)
            raw = np.minimum(np.bincount(at, minlength=len(rows) << bits), 255).astype(np.uint8).tobytes()
            for i, r in enumerate(rows.tolist()):
                out[r] = raw[i << bits : (i + 1) << bits]
    return out


PARITY = [f"p{i}" for i in range(8)]


def parities(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Eight words a set, one bit for each of 512 equal ranges of the hash: whether it holds
    an odd number of elements. Two sets differ in as many elements as bits, or more."""
    rows = len(offsets) - 1
    out = np.zeros(rows * 8, np.uint64)
    if len(h):
        word = np.repeat(np.arange(rows), np.diff(offsets)) * 8 + (h >> U(61)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[start]] = np.bitwise_xor.reduceat(U(1) << (h >> U(55) & U(63)), start)
    return out.reshape(rows, 8)


def _sets(docs: DataFrame, names: DataFrame, keys: DataFrame, key: str, text: str, whole: bool) -> DataFrame:
    """Rows (k, class_id, n, hist and PARITY) for the classes of `names` whose k is in keys, or with `whole` (k, class_id, n, items array<long>).

    Texts are not shuffled: a bitmap of the classes' representatives chooses them, and their sets meet the keys.
    """
    need = names.join(keys, "k", "left_semi").select(F.coalesce("rep", F.lit(0)).alias("rep"))
    mine = docs.select(F.col(key).cast("long").alias("rep"), text_or_empty(text).alias("text"))
    chosen = flagged(mine, F.coalesce("rep", F.lit(0)), need, "maybe").filter("maybe").select("text")

    def run(batches):
        for batch in sliced(batches, "text", SLICE_BYTES):
            h, offsets = shingle_sets(batch.column(0))
            a, b = set_keys(h, offsets)
            raw = np.stack([a, b], axis=1).astype(">u8").tobytes().hex()
            if whole:
                last = {"items": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(h.view(np.int64)))}
            else:
                last = {"hist": pa.array(histograms(h, offsets), pa.binary())} | dict(zip(PARITY, map(pa.array, np.ascontiguousarray(parities(h, offsets).T).view(np.int64)), strict=True))
            names = [raw[32 * i : 32 * i + 32] for i in range(len(a))]
            yield pa.RecordBatch.from_pydict({"k": pa.array(a.view(np.int64)), "class_id": pa.array(names, pa.string()), "n": pa.array(np.diff(offsets)), **last})
        trim()

    kind = "items array<long>" if whole else "hist binary, " + ", ".join(f"{p} long" for p in PARITY)
    # Dealt by k once: the joins with the keys and with pairs, and what drops repeated rows, keep it.
    return chosen.mapInArrow(run, f"k long, class_id string, n long, {kind}").repartition("k").join(keys, "k", "left_semi").dropDuplicates(["k", "class_id"])


def _alike(xs: list[bytes], ys: list[bytes], limit: np.ndarray) -> np.ndarray:
    """Whether the differences of two histograms, range by range, sum up to the limit at most; true if they have other ranges."""
    size = np.array([len(a) if len(a) == len(b) else 0 for a, b in zip(xs, ys, strict=True)], dtype=np.int64)
    out = np.ones(len(xs), dtype=bool)
    for n in np.unique(size[size > 0]).tolist():
        for rows in np.array_split(np.flatnonzero(size == n), 1 + int((size == n).sum()) * n // (1 << 22)):
            a, b = (np.frombuffer(b"".join([side[r] for r in rows]), dtype=np.uint8).reshape(-1, n).astype(np.int16) for side in (xs, ys))
            out[rows] = np.abs(a - b).sum(axis=1, dtype=np.int64) <= limit[rows]
    return out


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that their histograms don't rule out: the sum of the ranges' differences
    is at most the sets' distance, which is at most a ninth of their sizes' sum."""

    @F.arrow_udf("boolean")
    def near(xh: pa.Array, yh: pa.Array, xn: pa.Array, yn: pa.Array) -> pa.Array:
        return pa.array(_alike(xh.to_pylist(), yh.to_pylist(), (xn.to_numpy() + yn.to_numpy()) // 9))

    side = lambda k: sets.select(F.col("k").alias(k), F.col("n").alias(k + "n"), F.col("hist").alias(k + "h"))
    return pairs.join(side("x"), "x").join(side("y"), "y").filter(near("xh", "yh", "xn", "yn")).select("x", "y")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (x, y) whose sets are similar, as the classes (a, b): exact count of the intersection."""
    left = sets.select(F.col("k").alias("x"), F.col("class_id").alias("a"), F.col("items").alias("xs"))
    right = sets.select(F.col("k").alias("y"), F.col("class_id").alias("b"), F.col("items").alias("ys"))
    met = F.size(F.array_intersect("xs", "ys"))
    return pairs.join(right, "y").join(left, "x").filter(100 * met >= 80 * (F.size("xs") + F.size("ys") - met)).select("a", "b")


class _Components:
    """The components known so far, from verified links."""

    def __init__(self, docs: DataFrame, rows: DataFrame, key: str, text: str, keys: DataFrame):
        self.source = (docs, key, text)
        names = rows.filter("n > 0").join(keys, "k", "left_semi").groupBy("k", "class_id").agg(F.min("doc_id").alias("rep"))
        self.names = _kept(names.withColumn("twin", F.count(F.lit(1)).over(Window.partitionBy("k")) > 1), "names")
        self.hists = _kept(self.fetched(keys, False), "hists")
        self.links: list[DataFrame] = []
        self.labels = self.known = None

    def fetched(self, keys: DataFrame, whole: bool) -> DataFrame:
        docs, key, text = self.source
        return _sets(docs, self.names, keys, key, text, whole)

    def labelled(self, rows: DataFrame, k: str, label: str) -> DataFrame:
        """rows with the component of class k, its own name where it has no link."""
        known = self.known.select(F.col("k").alias(k), F.col("component").alias(label))
        return rows.join(known, k, "left").withColumn(label, F.coalesce(label, F.col(k).cast("string")))

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sets lie in different components."""
        return self.labelled(self.labelled(pairs, "x", "lx"), "y", "ly").filter("lx <> ly").select("x", "y")

    def add(self, links: list[DataFrame]) -> None:
        found = [x for x in links if x.limit(1).count()]
        if self.labels is None or found:
            self.links += found or links[:1]
            before, self.labels = [x for x in (self.labels, self.known) if x is not None], _kept(components(reduce(DataFrame.union, self.links), "a", "b"), "labels")
            # Only linked classes have a row, and those that share their k with another class.
            both = self.names.join(self.labels.withColumnRenamed("node", "class_id"), "class_id", "left").filter("component is not null or twin")
            self.known = _kept(both.select("k", F.coalesce("component", "class_id").alias("component")), "known")
            drop_stored(*before)

    def verify(self, pairs: DataFrame, apart: bool = False, alike: bool = False) -> None:
        """Take up the links among pairs (x, y) that matter. Where sets have many partners, as
        in large groups, one partner of each set comes first, then what still lies across
        components: most pairs then need no sets. `apart`: all pairs lie across components;
        `alike`: their histograms have been compared."""
        pairs = pairs if apart or self.labels is None else self.apart(pairs)
        near = _kept(pairs if alike else _near(pairs, self.hists), "near")
        many, sets = near.agg(F.count("x"), F.approx_count_distinct("y")).first()
        if self.labels is not None and not many:
            return
        if many <= FEW_PARTNERS * sets:
            self.compare(near, many)
            drop_stored(near)
            return
        first = _kept(near.groupBy("y").agg(F.min("x").alias("x")).select("x", "y"), "first")
        self.compare(first, sets)
        rest = _kept(self.apart(near.join(first, ["x", "y"], "left_anti")), "rest")
        if left := rest.count():
            self.compare(rest, left)
        drop_stored(near, first, rest)

    def compare(self, pairs: DataFrame, many: int) -> None:
        """Take up the links among so many pairs, slice by slice: only a slice's sets are fetched and joined at a time."""
        if not many:
            return self.add([pairs.select(F.col("x").cast("string").alias("a"), F.col("y").cast("string").alias("b"))])
        found, slices = [], 1 + many // SLICE_PAIRS
        for k in range(slices):
            part = pairs.filter(F.pmod(F.xxhash64("y"), F.lit(slices)) == k) if slices > 1 else pairs
            found.append(_kept(_links(part, self.fetched(part.select(F.explode(F.array("x", "y")).alias("k")), True)), "links"))
        self.add(found)


def _uncovered(found: DataFrame) -> DataFrame:
    """Members of all small buckets, and of the large ones those classes that may meet a partner nowhere else."""
    open_ = found.filter("kind = 3").groupBy("k").agg(F.sum("bucket").alias("hot"), F.min("slack").alias("slack")).filter("hot >= slack").select("k")
    columns = ["bucket", "k", F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("away")]
    small = found.filter("kind = 1").select(*columns, F.lit(False).alias("large"))
    return small.unionByName(found.filter("kind = 2").join(_kept(open_, "open"), "k", "left_semi").select(*columns, F.lit(True).alias("large"))).distinct()


def links(docs: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (node, component) of the classes that are linked with another class."""
    spark = docs.sparkSession
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(0.85 * total / PER_PART))
    found = [_kept(signature_blocks(docs, text, parts, k, PASSES).groupBy("part", "salt").applyInArrow(_coarse, FOUND), "candidates") for k in range(PASSES)]
    members = _kept(_uncovered(reduce(DataFrame.union, found)), "members")
    drop_stored(*found)
    known = _Components(docs, rows, key, text, members.select("k").distinct())
    while True:
        pivots = _kept(_pivots(members), "pivots")
        tied = _kept(members.join(pivots, "bucket").filter("k <> p").groupBy("k", "p").agg(F.max("large").alias("large")), "tied")
        known.verify(tied.select(F.least("k", "p").alias("x"), F.greatest("k", "p").alias("y")).distinct())
        known.verify(_across(known, members.filter(~F.col("large")), pivots), apart=True)
        named = _kept(known.labelled(known.labelled(tied.filter("large"), "k", "lk"), "p", "lp").select("k", "p", "lk", "lp"), "named")
        drop_stored(members, pivots, tied)
        groups = _kept(named.groupBy("lp").agg(F.count_distinct("k").alias("classes"), F.max(F.col("lk") != F.col("lp")).alias("open")).filter("open").drop("open"), "groups")
        known.verify(_direct(known, named, groups.filter(F.col("classes") <= DIRECT)), apart=True, alike=True)
        rest = named.join(groups.filter(F.col("classes") > DIRECT), "lp", "left_semi").select("k", "p", (F.col("lk") != F.col("lp")).alias("open"))
        again = _kept(rest.join(rest.filter("open").select("p").distinct(), "p", "left_semi"), "again")
        drop_stored(named, groups)
        if not again.limit(1).count():
            drop_stored(known.names, known.hists, known.known)
            return known.labels
        sets = _kept(known.fetched(again.select(F.explode(F.array("k", "p")).alias("k")), True), "sets")
        found = _kept(difference_blocks(again, sets, parts).groupBy("part").applyInArrow(_fine, FINE), "candidates")
        drop_stored(again, sets)
        members = found.select("bucket", "k", "at", "away", (F.col("kind") == 2).alias("large"))
        members._stored_path = found._stored_path


def _across(known: _Components, small: DataFrame, pivots: DataFrame) -> DataFrame:
    """Pairs (x, y) of small buckets' members in different components, if sizes and positions allow a link.

    Pairs with the pivot are known already. By its position, the first shared
    element must lie in both prefixes of this very pair, and the bits in which
    the parities differ can't outnumber the distance of a link.
    """
    rows = known.labelled(small, "k", "label").join(known.hists.select("k", "n", *PARITY), "k")
    open_ = rows.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("bucket")
    rows = _kept(rows.join(open_, "bucket", "left_semi").join(pivots, "bucket").filter("k <> p").drop("p").distinct(), "across")
    other = rows.select("bucket", *[F.col(c).alias(c + "2") for c in ("k", "at", "away", "label", "n", *PARITY)])
    share = F.expr("(away + away2 - (n + n2) div 9 + 1) div 2")
    fits = F.coalesce((F.col("at") <= F.col("away") - share) & (F.col("at2") <= F.col("away2") - share), F.lit(True))
    both = rows.join(other, "bucket").filter((F.col("k") < F.col("k2")) & (F.col("label") != F.col("label2")) & F.expr("5 * least(n, n2) >= 4 * greatest(n, n2)") & fits & F.expr(" + ".join(f"bit_count({p} ^ {p}2)" for p in PARITY) + " <= (n + n2) div 9"))
    return both.select(F.col("k").alias("x"), F.col("k2").alias("y")).distinct()


def _direct(known: _Components, named: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (x, y) of a group's classes in different components that their histograms don't rule out.

    A group (lp) holds the classes k that lie in a hot bucket whose pivot is of
    component lp. Its classes are dealt to blocks, and a task compares two
    blocks; most classes lie in one component, and the others meet all.
    """
    block = lambda c: F.pmod(F.xxhash64("k"), c)
    many = groups.select("lp", F.ceil(F.col("classes") / BLOCK_CLASSES).alias("blocks"))
    rows = named.join(many, "lp").select(F.xxhash64("lp").alias("g"), "k", F.col("lk").alias("label"), block(F.col("blocks")).alias("own"), "blocks").distinct().join(known.hists.drop("class_id"), "k")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("blocks", "other")
    return rows.groupBy("g", "a", "b").applyInArrow(_block_pairs, "x long, y long").distinct()


def _block_pairs(table: pa.Table) -> pa.Table:
    """Pairs of two blocks' classes, or of one block's, for _direct."""
    k, n, own = (table.column(c).to_numpy() for c in ("k", "n", "own"))
    label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    bits = np.stack([table.column(p).to_numpy().view(np.uint64) for p in PARITY])
    hist = table.column("hist")
    rest = label != np.bincount(label).argmax()
    left, right = (own == table.column(c)[0].as_py() for c in ("a", "b"))
    found = []
    for some, others in ((left & rest, right), (right & rest, left)):
        some, others = np.flatnonzero(some), np.flatnonzero(others)
        step = max(1, (1 << 20) // max(1, len(others)))
        for start in range(0, len(some), step):
            i = some[start : start + step]
            odd = np.zeros((len(i), len(others)), np.uint16)
            for word in bits:
                odd += np.bitwise_count(word[i][:, None] ^ word[others])
            most = (n[i][:, None] + n[others]) // 9
            fits = (odd <= most) & (label[i][:, None] != label[others]) & (5 * np.minimum(n[i][:, None], n[others]) >= 4 * np.maximum(n[i][:, None], n[others])) & (k[i][:, None] != k[others])
            x, y = np.nonzero(fits)
            for at in range(0, len(x), 1 << 14):
                u, v = i[x[at : at + (1 << 14)]], others[y[at : at + (1 << 14)]]
                alike = _alike(hist.take(pa.array(u)).to_pylist(), hist.take(pa.array(v)).to_pylist(), (n[u] + n[v]) // 9)
                found.append(np.stack([np.minimum(k[u], k[v]), np.maximum(k[u], k[v])])[:, alike])
    pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
    trim()
    return pa.table({"x": pairs[0], "y": pairs[1]})


def _pivots(members: DataFrame) -> DataFrame:
    """Rows (bucket, p): each bucket's pivot, the class in most buckets."""
    weights = members.groupBy("k").agg(F.count(F.lit(1)).alias("weight"))
    return members.join(weights, "k").groupBy("bucket").agg(F.max(F.struct("weight", "k"))["k"].alias("p"))


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    component_id is the smallest identifier reachable by links, its own
    included; a document without words is linked with nothing. Rows that
    repeat an identifier are joined each by its own text; a null identifier
    never is the smallest. Empty tables give an empty result, and other
    columns are ignored.
    """
    ship(docs.sparkSession)
    rows = _kept(class_rows(docs, key, text), "classes")
    labels = links(docs, rows, key, text)
    total = rows.count()
    classes = rows.filter("n > 0").groupBy("class_id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    named = classes.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("label", F.coalesce("component", "class_id")).drop("component")
    least = named.groupBy("label").agg(F.min("rep").alias("component"))
    groups = _kept(named.join(least, "label").select("class_id", "component", "copies"), "groups")
    out = join_groups(rows.filter("n > 0"), groups, "class_id", "copies", total)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).union(rows.filter("n = 0").select("doc_id", "n", "doc_id"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group of linked ones, all columns kept.

    The document with the smallest identifier stays; of rows that repeat it,
    those stay too. Rows without an identifier stay where no row of their
    group has one. Only rows that a bitmap of those to be dropped lets pass are
    shuffled to meet them.
    """
    gone, maybe = fresh(docs, "gone", "maybe")
    drop = _kept(joined(docs, key, text).filter("component_id is not null and not (doc_id <=> component_id)").select(F.col("doc_id").alias(gone)).distinct(), "dropped")
    rows = flagged(docs, F.col(key).cast("long"), drop, maybe)
    some = rows.filter(maybe).drop(maybe).join(drop, F.col(key).cast("long").eqNullSafe(F.col(gone)), "left_anti")
    return rows.filter(~F.col(maybe)).drop(maybe).union(some)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(documents(spark, sf_dir))
