"""Graph operators over edge tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop_stored, stored
from .joins import merged
from .ranking import percentiles


#: Contracted edges that one task finishes (16 bytes each).
LAST_EDGES = 200_000


def smallest_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of an edge list, sorted, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        np.minimum.at(least, label[i], label[j])  # roots meet through their members' edges
        np.minimum.at(least, label[j], label[i])
        while (least[least] != least).any():
            least = least[least]
        new = least[label]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def components(edges: DataFrame, a: str = "i", b: str = "j", last_edges: int = LAST_EDGES) -> DataFrame:
    """(node, component) for every node of an edge; component is its smallest node.

    Every round draws a new random order of the nodes, points each to the
    first of itself and its neighbours, follows the pointers twice and
    contracts the edges. An order that no input can foresee keeps chains
    short, so a path, too, shrinks by a constant factor and the rounds grow
    with the logarithm of the nodes. A round stores its pointers and the
    contracted edges; as a tree aggregation ends in one task, so do the last
    `last_edges` edges, and the pointers are chained. An edge with a null end
    is ignored.
    """
    nodes = edges.select(F.explode(F.array(a, b)).alias("node")).filter("node is not null").distinct()
    live = stored(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter(f"{a} <> {b}").distinct(), "edges")
    rounds, left = [], live.count()
    while left > last_edges:
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), F.col(c)).alias("h"), F.col(c).alias("p"))  # noqa: B023, E731
        both = live.union(live.select("v", "u"))
        first = both.groupBy("u").agg(F.min(rank("v")).alias("r")).select("u", F.least(rank("u"), F.col("r"))["p"].alias("p"))
        follow = lambda t: merged(t).join(t.select(F.col("u").alias("p"), F.col("p").alias("q")), "p", "left").select("u", F.coalesce("q", "p").alias("p"))
        hop = stored(follow(follow(first)), "hop")
        ends = merged(merged(live).join(hop.select("u", F.col("p").alias("x")), "u")).join(hop.select(F.col("u").alias("v"), F.col("p").alias("y")), "v")
        rest = stored(ends.filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
        drop_stored(live)
        rounds.append(hop)
        live, left = rest, rest.count()

    def finish(batches):
        held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if held:
            u, v = (np.concatenate(c) for c in zip(*held, strict=True))
            found, label = smallest_labels(u, v)
            for k in range(0, len(found), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[k : k + 50_000]), pa.array(label[k : k + 50_000])], names=["u", "p"])

    kind = live.schema["u"].dataType.simpleString()
    rounds.append(stored(live.coalesce(1).mapInArrow(finish, f"u {kind}, p {kind}"), "hop"))
    drop_stored(live)
    roots = nodes.select("node", F.col("node").alias("root"))
    for hop in rounds:
        roots = merged(roots).join(hop.select(F.col("u").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
    if len(rounds) == 1:  # no contraction: the roots are the smallest nodes
        return roots.withColumnRenamed("root", "component")
    roots = stored(roots, "roots")
    drop_stored(*rounds)
    return merged(roots).join(roots.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")


def component_summary(edges: DataFrame, nodes: DataFrame, a: str = "i", b: str = "j", node: str = "node") -> DataFrame:
    """Number of components with isolated nodes, the largest, and its share of all nodes."""
    found = nodes.select(F.col(node).alias("node")).distinct().join(components(edges, a, b), "node", "left")
    sizes = found.groupBy(F.coalesce("component", "node").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"), (F.max("n") / F.sum("n")).alias("coverage"))


def residuals(edges: DataFrame, poses: DataFrame) -> DataFrame:
    """Edges (i, j, dx, dy) with what the poses (node, x, y) leave: rx, ry and their length."""
    p = poses.select(F.col("node").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"))
    q = poses.select(F.col("node").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    both = edges.join(p, "i").join(q, "j").withColumns({"rx": F.col("xj") - F.col("xi") - F.col("dx"), "ry": F.col("yj") - F.col("yi") - F.col("dy")})
    return both.withColumn("residual", F.hypot("rx", "ry")).drop("xi", "yi", "xj", "yj")


def whitening(edges: DataFrame, norm: str, gap: str, most_gap: int = 10) -> DataFrame:
    """Edge scale: the larger of its norm and s * sqrt(gap), s being the median norm/gap of short edges."""
    s = percentiles(edges.filter((F.col(gap) > 0) & (F.col(gap) <= most_gap)), F.col(norm) / F.col(gap), [0.5]).select(F.col("p")[0].alias("_s"))
    return edges.join(F.broadcast(s)).withColumn("scale", F.greatest(F.col(norm), F.col("_s") * F.sqrt(F.col(gap).cast("double")))).drop("_s")
