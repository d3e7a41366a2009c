"""Operator 4: approximate nearest neighbours by learned partitions.

1. On a bounded sample (``SAMPLE`` rows) a neighbour graph is built and cut into
   balanced parts: nodes move to the part that most of their neighbours are in, as
   long as it has room.
2. A small classifier (one hidden layer, numpy) learns the share of a vector's
   neighbours in each part.
3. The classifier places every row of the table in its most probable part. A query goes
   to its several most probable parts - as many as bring the recall measured on the
   sample to ``TARGET``, and on until they hold ``k`` rows besides the query - and is
   compared there with every row, exactly.

Neighbouring parts are gathered to shelves of about ``ROW_BLOCK`` rows, larger ones cut
into blocks of rows, and their queries into blocks too, so neither a hot part nor a
table of any size meets in one task. A task goes through the parts of its shelf in
slices and keeps each query's best ``k`` so far, so a query brings back ``k`` rows per
shelf, not per part; the best of all shelves are ranked. The sample bounds fitting only:
all rows are indexed, all queries answered.

Scores are inner products of the original vectors, summed in double precision over the
components in order, so equal vectors have equal scores; ties go to the smaller vec_id.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, vectors without an id and vectors not of the most frequent length take no
part. A query with fewer candidates than ``k`` gets them all; a repeated id is
another candidate. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capshift.llm.common import in_slices, materialise
from capshift.llm.vectors import matrix, usable

SAMPLE, NEIGHBOURS = 6000, 10
ROWS_PER_PART, LEAST_PARTS, MOST_PARTS = 1000, 4, 32
ROOM, SWEEPS = 1.1, 12
HIDDEN, EPOCHS, RATE = 64, 30, 0.01
TARGET = 0.94
ROW_BLOCK, QUERY_BLOCK, SLICE = 50_000, 1000, 4000
NEAR_TIE = 1e-9


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k largest inner products of each row with the others, block by block."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1000):
        s = x[at:at + 1000] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        best = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[at:at + len(s)] = np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, 1), axis=1), 1)
    return out


def shares(near: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    """Share of each node's neighbours in each part."""
    flat = np.arange(len(near))[:, None] * parts + part[near]
    return np.bincount(flat.ravel(), minlength=len(near) * parts).reshape(len(near), parts) / near.shape[1]


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rng) -> np.ndarray:
    """Balanced partition of the neighbour graph by moves of largest gain into parts with room."""
    part = np.empty(len(x), np.int64)
    part[np.argsort(x @ rng.normal(size=x.shape[1]), kind="stable")] = np.arange(len(x)) * parts // len(x)
    room = int(np.ceil(ROOM * len(x) / parts))
    for _ in range(SWEEPS):
        held = np.bincount(part, minlength=parts)
        share = shares(near, part, parts)
        best = share.argmax(axis=1)
        gain = share[np.arange(len(x)), best] - share[np.arange(len(x)), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable")[:int((gain > 0).sum())].tolist():
            if held[best[i]] < room:
                held[part[i]] -= 1
                held[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """Part probabilities from one hidden layer."""

    def __init__(self, w1, b1, w2, b2, probes: int):
        self.w1, self.b1, self.w2, self.b2, self.probes = w1, b1, w2, b2, probes

    @property
    def parts(self) -> int:
        return len(self.b2)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.maximum(x / norm @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def _train_router(x: np.ndarray, target: np.ndarray, rng) -> Router:
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    d, parts = x.shape[1], target.shape[1]
    p = [rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN),
         rng.normal(0, HIDDEN ** -0.5, (HIDDEN, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            b, step = order[at:at + 256], step + 1
            h = np.maximum(x[b] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            dz = (q / q.sum(axis=1, keepdims=True) - target[b]) / len(b)
            dh = (dz @ p[2].T) * (h > 0)
            for i, g in enumerate((x[b].T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= RATE * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    return Router(*p, probes=parts)


def fit(sample: np.ndarray, rows: int, k: int, seed: int = 4) -> Router:
    """The router for a table of ``rows`` vectors from a sample of them."""
    rng = np.random.default_rng(seed)
    parts = int(np.clip(-(-rows // ROWS_PER_PART), LEAST_PARTS, MOST_PARTS))
    if len(sample) < max(4 * parts, k + 2):  # too few to learn from: one part
        return Router(np.zeros((sample.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    near = neighbour_graph(sample, max(k, NEIGHBOURS))
    part = balanced_parts(sample, near[:, :NEIGHBOURS], parts, rng)
    router = _train_router(sample, 0.5 * shares(near[:, :NEIGHBOURS], part, parts) + 0.5 * np.eye(parts)[part], rng)
    # Recall on the sample for 1, 2, ... parts; parts as the classifier gives them.
    logits = router(sample)
    rank = np.argsort(np.argsort(-logits, axis=1), axis=1)
    needed = np.take_along_axis(rank, logits.argmax(axis=1)[near[:, :k]], axis=1)
    recall = [(needed < t).mean() for t in range(1, parts + 1)]
    router.probes = next(t for t, r in enumerate(recall, 1) if r >= TARGET or t == parts)
    return router


_NAMES = ["row", "vec_id", "asks", "raw", "shelf", "parts"]
_PARTS = "row long, vec_id long, asks boolean, raw binary, shelf int, parts array<int>"


def _order(router: Router, column) -> np.ndarray:
    return np.argsort(-router(matrix(column)), axis=1, kind="stable")


def _place(shared):
    """Every vector in its most probable part."""
    def run(batches):
        for part in in_slices(batches, 2048):
            first = _order(shared.value, part.column(3))[:, 0].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.nulls(len(first), pa.int32()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32)), pa.array(first))], _NAMES)

    return run


def shelves(held: np.ndarray, size: int) -> np.ndarray:
    """The shelf of each part: consecutive parts share one while it holds at most ``size`` rows."""
    out, shelf, rows = [], 0, 0
    for n in held.tolist():
        if rows and rows + n > size:
            shelf, rows = shelf + 1, 0
        rows += n
        out.append(shelf)
    return np.array(out, np.int32)


def visits(order: np.ndarray, held: np.ndarray, probes: int, k: int) -> np.ndarray:
    """How many parts of its ``order`` each query visits: ``probes``, or more until they hold ``k`` rows besides itself."""
    short = (np.cumsum(held[order], axis=1) < k + 1).sum(axis=1) + 1
    return np.minimum(np.maximum(short, probes), order.shape[1])


def _ask(shared, held: np.ndarray, shelf: np.ndarray, k: int):
    """Every query once for each shelf that has parts it visits, with these parts."""
    def run(batches):
        for part in in_slices(batches, 2048):
            order = _order(shared.value, part.column(3))
            needed = visits(order, held, shared.value.probes, k)
            wanted = np.zeros(order.shape, bool)
            np.put_along_axis(wanted, order, np.arange(order.shape[1])[None, :] < needed[:, None], axis=1)
            for s in range(int(shelf.max()) + 1):
                inside = wanted & (shelf == s)[None, :]
                some = np.flatnonzero(inside.any(axis=1))
                who, parts = np.nonzero(inside[some])
                offsets = np.searchsorted(who, np.arange(len(some) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.take(pa.array(some)).columns, pa.array(np.full(len(some), s, np.int32)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(parts.astype(np.int32)))], _NAMES)

    return run


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, components added in order."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _best_of_block(k: int):
    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        row, vec_id, x = table.column("row").to_numpy(), table.column("vec_id").to_numpy(), matrix(table.column("raw"))
        parts = table.column("parts").combine_chunks()
        who = np.repeat(np.arange(len(asks)), np.diff(parts.offsets.to_numpy()))
        part = parts.flatten().to_numpy()
        # the best so far: (query, candidate, score), at most k per query, and the least score that still counts
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        floor = np.full(len(asks), -np.inf)
        for p in np.unique(part[~asks[who]]):
            inside = who[part == p]
            queries, rows = inside[asks[inside]], inside[~asks[inside]]
            for at in range(0, len(rows) if len(queries) else 0, SLICE):
                some = rows[at:at + SLICE]
                scores = x[queries] @ x[some].T
                scores[row[queries][:, None] == row[some][None, :]] = -np.inf
                n = min(k, len(some))
                least = np.maximum(floor[queries], -np.partition(-scores, n - 1, axis=1)[:, n - 1])
                slack = NEAR_TIE * np.maximum(1.0, np.abs(np.where(np.isfinite(least), least, 0)))
                q, c = np.nonzero((scores >= (least - slack)[:, None]) & np.isfinite(scores))
                q, c = queries[q], some[c]
                q, c, exact = (np.concatenate(v) for v in zip(best, (q, c, inner_products(x[q], x[c]))))
                order = np.lexsort((vec_id[c], -exact, q))
                q, c, exact = q[order], c[order], exact[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                best = q, c, exact = tuple(v[place < k] for v in (q, c, exact))
                last = place[place < k] == k - 1
                floor[q[last]] = exact[last]
        q, c, exact = best
        return pa.table([pa.array(row[q], pa.int64()), pa.array(vec_id[q], pa.int64()), pa.array(vec_id[c], pa.int64()),
                         pa.array(exact, pa.float64())], names=["row", "query_id", "vec_id", "score"])

    return run


def fit_router(vectors: DataFrame, k: int) -> Router | None:
    total = vectors.count()
    if not total:
        return None
    spread = F.pmod(F.xxhash64("vec_id", F.lit(4)), F.lit(1 << 30)) / (1 << 30)
    sample = vectors.where(spread <= min(1.0, SAMPLE / total)).select("row", "raw").orderBy("row").limit(2 * SAMPLE).toArrow()
    return fit(matrix(sample.column("raw")) if sample.num_rows else np.zeros((0, 1)), total, k)


def search(table: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with vec_id divisible by ``every`` its ``k`` nearest found."""
    vectors = usable(table, with_id=True)
    usual = vectors.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if usual is not None:
        vectors = vectors.where(F.col("dim") == usual["dim"])
    router = fit_router(vectors, k)
    if router is None:
        router = Router(np.zeros((1, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    shared = table.sparkSession.sparkContext.broadcast(router)
    rows = vectors.select("row", "vec_id", F.lit(False).alias("asks"), "raw")
    placed = materialise(rows.mapInArrow(_place(shared), _PARTS), "ann-parts")
    held = np.zeros(router.parts, np.int64)
    for r in placed.groupBy(F.col("parts")[0].alias("part")).agg(F.count("*").alias("n")).collect():  # at most MOST_PARTS rows
        held[r["part"]] = r["n"]
    shelf = shelves(held, ROW_BLOCK)
    of_part = F.element_at(F.array(*[F.lit(int(s)) for s in shelf]), F.col("parts")[0] + 1)
    placed = placed.withColumn("shelf", of_part)
    asking = rows.where(F.col("vec_id") % every == 0).withColumn("asks", F.lit(True))
    routed = placed.union(materialise(asking.mapInArrow(_ask(shared, held, shelf, k), _PARTS), "ann-queries"))
    # At most MOST_PARTS rows: the blocks that rows and queries of each shelf are cut into.
    shape = routed.groupBy("shelf").agg(
        F.ceil(F.count_if(~F.col("asks")) / ROW_BLOCK).cast("int").alias("row_blocks"),
        F.ceil(F.count_if("asks") / QUERY_BLOCK).cast("int").alias("query_blocks"))
    cut = routed.join(F.broadcast(shape), "shelf")

    def own(blocks):
        return F.array(F.pmod(F.xxhash64("row"), F.greatest(F.lit(1), blocks)).cast("int"))

    def each(blocks):
        return F.when(F.col(blocks) > 0, F.sequence(F.lit(0), F.col(blocks) - 1)).otherwise(F.array().cast("array<int>"))

    paired = (cut.withColumn("i", F.explode(F.when(F.col("asks"), each("row_blocks")).otherwise(own("row_blocks"))))
              .withColumn("j", F.explode(F.when(F.col("asks"), own("query_blocks")).otherwise(each("query_blocks")))))
    found = paired.select("shelf", "i", "j", "row", "vec_id", "asks", "raw", "parts").groupBy("shelf", "i", "j").applyInArrow(
        _best_of_block(k), "row long, query_id long, vec_id long, score double")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
