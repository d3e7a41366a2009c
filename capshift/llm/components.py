"""Connected components of an edge table, without moving edges or labels to the driver.

Rounds of contraction. First every task joins the edges it holds (at most about
``per_task``) to stars around their smallest node; when one task holds all, that is the
answer. Otherwise every node then hooks to the neighbour of least priority, where
priorities are a new hash of the node in every round, hooks are followed to their
roots by doubling, and edges are rewritten between roots. Whatever the numbering of
the graph, a node with a neighbour is a root with probability 1/2 at most, so the
nodes left at least halve per round on average and hooks are short: O(log n) rounds
for any graph, without a cap on them. Edge tables shrink alike.

A hub costs no large group: minima are combined before the shuffle, and look-ups
broadcast the labels that hold a thousandth of all rows (``common.join_groups``).
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capshift.llm.common import join_groups, materialise

EDGES_PER_TASK = 500_000


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable) of the edges of two arrays."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while (up := parent[x]) != x:
            parent[x] = x = parent[up]
        return x

    for x, y in zip(ends[:len(a)].tolist(), ends[len(a):].tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    up = np.array(parent, np.int64)
    while not np.array_equal(up, up[up]):
        up = up[up]
    return nodes, nodes[up]


def _stars(batches):
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not held:
        return
    nodes, roots = local_roots(*(np.concatenate(ends) for ends in zip(*held)))
    for at in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at:at + (1 << 16)]), pa.array(roots[at:at + (1 << 16)])], ["a", "b"])


def _look_up(rows: DataFrame, column: str, mapping: DataFrame, name: str) -> DataFrame:
    """``rows`` with the value that ``mapping`` (node, root) gives for ``column`` (itself where it gives none)."""
    used = rows.groupBy(F.col(column).alias("node")).agg(F.count(F.lit(1)).alias("rows"))
    used = materialise(used.join(mapping, "node").select(F.col("node").alias(column), F.col("root").alias("_to"), F.col("rows").alias("_rows")),
                       f"cc-{name}")
    out = join_groups(rows, used, column, "_rows", rows.count())
    return materialise(out.withColumn(column, F.coalesce("_to", column)).drop("_to", "_rows"), f"cc-{name}")


def _hook(edges: DataFrame, seed: int) -> DataFrame:
    """(node, root): every node led to the end of its chain of least neighbours, by a priority drawn from ``seed``."""
    def ranked(column: str):
        return F.struct(F.xxhash64(column, F.lit(seed)).alias("rank"), F.col(column).alias("id"))

    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("node")).agg(F.min(ranked("b")).alias("near"))
    up = materialise(least.select("node", F.least(ranked("node"), F.col("near"))["id"].alias("root")), "cc-hooks")
    while True:
        further = _look_up(up.withColumn("was", F.col("root")), "root", up, "jumps")
        up = further.select("node", "root")
        if further.where(F.col("was") != F.col("root")).isEmpty():
            return up


def connected_components(edges: DataFrame, per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    An empty edge table gives an empty result; self-loops and repeats are harmless,
    edges with a null end are left out.
    """
    edges = materialise(edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull()), "cc-edges")
    mapping = None  # (node, root) of all nodes so far
    for seed in count():
        tasks = max(1, -(-edges.count() // per_task))
        dealt = edges.coalesce(1) if tasks == 1 else edges.repartition(tasks)
        stars = materialise(dealt.mapInArrow(_stars, "a long, b long"), "cc-stars")
        if tasks == 1:
            last = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        else:
            last = _hook(stars, seed)
            ends = _look_up(_look_up(stars, "a", last, "edges"), "b", last, "edges")
            edges = materialise(ends.where("a <> b").distinct(), "cc-edges")
        mapping = last if mapping is None else _look_up(mapping, "root", last, "roots")
        if tasks == 1:
            break
    if not seed:
        return mapping.select("node", F.col("root").alias("component"))
    smallest = materialise(mapping.groupBy("root").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")), "cc-least")
    return materialise(join_groups(mapping, smallest, "root", "n", mapping.count()).select("node", "component"), "cc-labels")
