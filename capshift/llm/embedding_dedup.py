"""Operator 10: near-duplicate vectors by sorted projection passes.

Exactly equal vectors first become one row with a weight, found by digest; their copies
get its links back at the end. Each pass draws ``BITS`` random hyperplanes; a vector's signs against them, one after
another, are its key. Vectors are sorted by key within the pass (a range-partitioned
sort), and each is compared with the ``WINDOW`` vectors before it, in double
precision; the windows across partition borders are compared apart. Pairs with
cosine >= the threshold are verified links. Within a window only the links that join
something new leave the task, so a group of near copies gives about one edge a member
and pass, whatever its size.

The links of all passes give components. Inside each component every pair is then
compared, in blocks, to count each vector's direct links; only counts leave a task.

A pair is missed only if no chain of found pairs joins it. With N distinct vectors a
pass brings a pair into a window if its first log2(N / WINDOW) signs or so agree, each
with probability 1 - angle / pi. ``passes_for`` takes as many passes as keep the share
of lone pairs missed at cosine ``least`` under ``MISS``: at 0.9, 19 passes for 50,000
vectors, 35 for 500,000, 70 for 10 million (of the order of N to the power 0.22). The model
is that of keys spread evenly; the tests measure it on planted pairs.

Defined cases: a vector that is null, empty, zero or holds null or non-finite
components links with nothing, nor do vectors of different lengths; each such row is
its own component. A null vec_id is an ordinary row, never a component id unless a
group has no other. Repeated rows are separate vectors and link with each other.
Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capshift.llm.common import broadcast_if_small, in_slices, materialise, scratch_scope
from capshift.llm.components import connected_components
from capshift.llm.vectors import matrix, unit, usable

BITS, WINDOW = 48, 256
MISS = 1e-3  # share of lone pairs at the threshold that may stay unfound
BLOCK_BYTES, SLICE = 1 << 24, 1024  # vectors of a task's either side; rows compared at once


def passes_for(rows: int, least: float) -> int:
    """Passes after which a lone pair of cosine ``least`` among ``rows`` distinct vectors is missed with at most ``MISS``."""
    agree = 1 - math.acos(max(-1.0, min(1.0, least))) / math.pi
    met = agree ** max(0.0, math.log2(max(rows, 1) / WINDOW))
    return 1 if met >= 1 else math.ceil(math.log(MISS) / math.log1p(-met))


def _keys(passes: int):
    """(pass, dim, key, row, raw) for every pass of every vector."""
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weight = (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
        for part in in_slices(batches, 2048):
            dims = part.column(1).to_numpy()
            for dim in np.unique(dims):
                rows = part.filter(pa.array(dims == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([10, int(dim)]).normal(size=(int(dim), passes * BITS))
                x = unit(matrix(rows.column(2)))
                for p in range(passes):
                    signs = x @ planes[dim][:, p * BITS:(p + 1) * BITS] > 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(signs), p, np.int32)), rows.column(1),
                         pa.array(signs @ weight), rows.column(0), rows.column(2)],
                        ["pass", "dim", "key", "row", "raw"])

    return run


class Forest:
    """Union-find over row numbers: which links join something new."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    def new_links(self, pairs):
        for a, b in pairs:
            x, y = self.root(a), self.root(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                yield a, b


def _window_pairs(group, row, x, earlier: int, least: float):
    """Linked (row, row) pairs of rows ``earlier``.. with the WINDOW rows of their group before them."""
    for at in range(earlier, len(row), WINDOW):
        to, lo = min(at + WINDOW, len(row)), max(0, at - WINDOW)
        near = x[at:to] @ x[lo:to].T >= least
        back = np.arange(at, to)[:, None] - np.arange(lo, to)[None, :]
        near &= (back >= 1) & (back <= WINDOW) & (group[at:to][:, None] == group[lo:to][None, :])
        i, j = np.nonzero(near)
        yield from zip(row[at + i].tolist(), row[lo + j].tolist())


_EDGE_FIELDS = ["a", "b", "border", "seat", "pass", "dim", "row", "raw"]
_EDGES = "a long, b long, border int, seat long, pass int, dim int, row long, raw binary"


def _as_units(part) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(group, row, unit vectors) stretches of one dimension, in order."""
    dims, passes = part.column(1).to_numpy(), part.column(0).to_numpy()
    edges = np.flatnonzero(np.diff(dims, prepend=-1)).tolist() + [len(dims)]
    return [(passes[a:b].astype(np.int64) << 32 | dims[a:b], part.column(3).to_numpy()[a:b],
             unit(matrix(part.column(4).slice(a, b - a)))) for a, b in zip(edges, edges[1:])]


def _sweep(least: float):
    """Edges within a sorted partition, and its first and last WINDOW rows for the borders."""
    def run(batches):
        here = TaskContext.get().partitionId()
        forest, before, seen, tail = Forest(), None, 0, []
        for part in in_slices(batches, 4 * WINDOW):
            found = []
            for group, row, x in _as_units(part):
                if before is not None and before[2].shape[1] == x.shape[1]:
                    group, row, x = (np.concatenate((p[-WINDOW:], q)) for p, q in zip(before, (group, row, x)))
                    earlier = min(WINDOW, len(before[1]))
                else:
                    earlier = 0
                found += forest.new_links(_window_pairs(group, row, x, earlier, least))
                before = (group[-WINDOW:], row[-WINDOW:], x[-WINDOW:])
            n = part.num_rows
            if found:
                a, b = np.array(found).T
                none = pa.nulls(len(a))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.int32()),
                     none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.binary())], _EDGE_FIELDS)
            if seen < WINDOW and here:  # the head belongs to the border with the partition before
                yield _border_rows(part.slice(0, WINDOW - seen), here - 1, seen + WINDOW)
            seen += n
            tail = [p for p in (*tail, part)][-3:]
        if tail:
            rows = pa.Table.from_batches(tail)
            rows = rows.slice(max(0, rows.num_rows - WINDOW)).combine_chunks().to_batches()[0]
            yield _border_rows(rows, here, WINDOW - rows.num_rows)

    return run


def _border_rows(part, border: int, seat: int):
    n = part.num_rows
    none = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays(
        [none, none, pa.array(np.full(n, border, np.int32)), pa.array(np.arange(seat, seat + n)),
         part.column(0), part.column(1), part.column(3), part.column(4)], _EDGE_FIELDS)


def _border_links(least: float):
    """Links across one border: rows of seats below WINDOW lie before it, the others after it."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seat")
        seat, passes, dims = (table.column(c).to_numpy() for c in ("seat", "pass", "dim"))
        row, raw = table.column("row").to_numpy(), table.column("raw").to_pylist()
        forest, found = Forest(), []
        for group in np.unique(np.stack((passes, dims), axis=1), axis=0):
            at = np.flatnonzero((passes == group[0]) & (dims == group[1]))
            left, right = at[seat[at] < WINDOW], at[seat[at] >= WINDOW]
            if len(left) and len(right):
                x, y = (unit(np.frombuffer(b"".join(raw[i] for i in s), np.float64).reshape(len(s), -1))
                        for s in (left, right))
                i, j = np.nonzero((x @ y.T >= least) & (seat[right][None, :] - seat[left][:, None] <= WINDOW))
                found += forest.new_links(zip(row[left[i]].tolist(), row[right[j]].tolist()))
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return run


def _count_links(least: float):
    """(row, links) partial counts of one block pair; rows of one component only are compared."""
    def run(table: pa.Table) -> pa.Table:
        row, component, block, weight = (table.column(c).to_numpy() for c in ("row", "component", "block", "weight"))
        x = unit(matrix(table.column("raw")))
        i, j = int(table.column("i")[0].as_py()), int(table.column("j")[0].as_py())
        # by component, so that slices of different components are passed over
        order = np.lexsort((row, component))
        left, right = order[block[order] == i], order[block[order] == j]
        links = np.zeros(len(row), np.int64)
        for a in range(0, len(left), SLICE):
            l = left[a:a + SLICE]
            lo = np.searchsorted(component[right], component[l[0]])
            hi = np.searchsorted(component[right], component[l[-1]], side="right")
            for b in range(lo, hi, SLICE):
                r = right[b:min(b + SLICE, hi)]
                near = (x[l] @ x[r].T >= least) & (component[l][:, None] == component[r][None, :])
                near &= row[l][:, None] != row[r][None, :]
                links[l] += near @ weight[r]
                if i != j:
                    links[r] += weight[l] @ near
        return pa.table({"row": row, "links": links})

    return run


def _links_inside(vectors: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """(row, n_links): direct links within components to all copies of other rows, in blocks of about BLOCK_BYTES.

    Small components share a block (the pair test asks for the same component); a
    large one is cut into blocks, and every pair of its blocks is a group of its own: a
    vector is copied once per block of its component, some 10,000 rows.
    """
    held = materialise(vectors.select("row", "raw", "weight", "dim").join(
        broadcast_if_small(labels.withColumnRenamed("node", "row")), "row"), "vector-held")
    sizes = held.groupBy("component").agg(F.sum(F.col("dim").cast("long") * 8).alias("bytes"))
    blocks = F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int")
    shape = materialise(sizes.select("component", blocks.alias("blocks"), "bytes"), "vector-shape")
    small = max(1, -(-(shape.agg(F.sum("bytes").alias("b")).first()["b"] or 0) // BLOCK_BYTES))
    held = held.join(broadcast_if_small(shape.drop("bytes")), "component")
    place = F.when(F.col("blocks") > 1, F.col("component")).otherwise(-1 - F.pmod(F.xxhash64("component"), F.lit(small)))
    held = held.withColumn("place", place).withColumn("block", F.pmod(F.xxhash64("row"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = held.withColumn("other", other).select(
        "place", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "row", "component",
        "block", "weight", "raw")
    return (pairs.groupBy("place", "dim", "i", "j").applyInArrow(_count_links(least), "row long, links long")
            .groupBy("row").agg(F.sum("links").alias("n_links")))


def near_links(vectors: DataFrame, least: float, passes: int) -> DataFrame:
    """(a, b) verified links between rows, enough to give the components of all pairs found."""
    spark = vectors.sparkSession
    total = vectors.count() * passes
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (8 * WINDOW)))
    keyed = vectors.select("row", "dim", "raw").mapInArrow(
        _keys(passes), "pass int, dim int, key long, row long, raw binary")
    order = ["pass", "dim", "key", "row"]
    swept = materialise(
        keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .select("pass", "dim", "key", "row", "raw").mapInArrow(_sweep(least), _EDGES), "vector-edges")
    inner = swept.where(F.col("border").isNull()).select("a", "b")
    borders = swept.where(F.col("border").isNotNull()).groupBy("border").applyInArrow(
        _border_links(least), "a long, b long")
    edges = inner.union(borders)
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicate_vectors(table: DataFrame, least: float = 0.9, passes: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``table`` (vec_id, embedding); ``passes`` None: ``passes_for``."""
    with scratch_scope(table.sparkSession):
        return materialise(_linked(table, least, passes), "vector-groups", keep=True)


def _linked(table: DataFrame, least: float, passes: int | None) -> DataFrame:
    vectors = usable(table)
    # Copies: one row of each distinct vector (the smallest row number) stands for all.
    digest = F.sha2("raw", 256).alias("digest")
    groups = materialise(vectors.select("row", digest).groupBy("digest").agg(
        F.min("row").alias("node"), F.count("*").alias("weight")), "vector-copies")
    distinct = materialise(vectors.select("row", "dim", "raw").join(
        broadcast_if_small(groups.select(F.col("node").alias("row"), "weight")), "row"), "vector-distinct")
    copied = groups.where("weight > 1").select(F.col("node").alias("a"), F.col("node").alias("b"))
    if passes is None:
        passes = passes_for(groups.count(), least)
    labels = materialise(connected_components(near_links(distinct, least, passes).union(copied)), "vector-components")
    counts = _links_inside(distinct, labels, least).join(distinct.select("row", "weight"), "row").select(
        F.col("row").alias("node"), (F.col("n_links") + F.col("weight") - 1).alias("n_links"))
    member = materialise(vectors.select("vec_id", digest).join(
        broadcast_if_small(groups.select("digest", "node")), "digest").select("vec_id", "node"), "vector-members")
    lowest = member.groupBy("node").agg(F.min("vec_id").alias("lowest")).join(broadcast_if_small(labels), "node")
    smallest = lowest.groupBy("component").agg(F.min("lowest").alias("component_id"))
    result = materialise(labels.join(smallest, "component").join(counts, "node").select(
        "node", "n_links", "component_id"), "vector-links")
    linked = member.join(broadcast_if_small(result), "node").select("vec_id", "n_links", "component_id")
    alone = member.join(broadcast_if_small(labels), "node", "left_anti").select("vec_id")
    # Rows that take no part: all rows less the usable ones, counted by id so that repeats stay.
    every = table.select(F.col("vec_id").cast("long").alias("vec_id")).groupBy("vec_id").agg(F.count("*").alias("n"))
    used = vectors.groupBy(F.col("vec_id").alias("used_id")).agg(F.count("*").alias("used"))
    out = every.join(used, F.col("vec_id").eqNullSafe(F.col("used_id")), "left").withColumn(
        "extra", (F.col("n") - F.coalesce("used", F.lit(0))).cast("int")).where("extra > 0")
    out = out.select("vec_id", F.explode(F.sequence(F.lit(1), "extra"))).select("vec_id")
    single = alone.union(out).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(single).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
