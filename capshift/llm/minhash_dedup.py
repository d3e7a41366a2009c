"""Operator 9: near-duplicate documents by one-permutation MinHash.

Documents are sets of word shingles. Two documents are linked when their Jaccard
similarity, confirmed on the full sets, reaches the threshold; the groups are the
connected components of the links.

Steps, all on Spark:

1. ``sketch``: one pass over the texts gives each document's set size, a 128-bit
   digest of the set and its band keys. One permutation is split into ``BINS``
   bins; empty bins borrow from a filled bin chosen by a fixed random order of
   that bin (optimal densification). ``ROWS`` bins make a band.
2. Documents with the same set collapse into one class (grouped by digest, combined
   before the shuffle), so copies never reach the buckets.
3. A bucket is a band key held by two or more classes. Each bucket contributes a
   star: edges from its centre, the member with the most bucket mates, to the other
   members of compatible size. Edges are confirmed on the full sets and joined to
   components.
4. Buckets that still hold more than one component go on. Their members, joined
   over shared buckets, form clusters; a cluster is cut into blocks, and every member
   outside the cluster's largest component is compared with every member of another
   component, block pair by block pair, on the full sets. Only links leave a task.
   No bucket, partner or candidate is capped, and a group of any size is spread over
   tasks of about ``BLOCK_SHINGLES`` shingles on either side, compared slice by slice.

The one loss is MinHash's own: a pair at exactly 0.8 shares no band with
probability (1 - 0.8**6)**40 = 5e-6.

Defined cases: a null or empty text (or one of white space only) has no set, size 0,
and is linked with nothing. A null doc_id is an ordinary row whose id is null; it
never becomes a component id unless a group holds no other id. Rows that repeat a
doc_id are separate documents that share an id. Ties take the smaller id. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capshift.llm.common import broadcast_if_small, in_slices, materialise, scratch_scope, texts
from capshift.llm.components import connected_components
from capshift.llm.hashing import mix, shingle_set, word_hashes

BINS, ROWS = 240, 6
BANDS = BINS // ROWS
BLOCK_SHINGLES, SLICE = 1_500_000, 200  # of a task's either side; members compared at once
COLUMNS = 4096

_ORDER = np.argsort(np.random.default_rng(9).random((BINS, BINS)), axis=1).argsort(axis=1).astype(np.int16)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One value per bin from a sorted, non-empty set; empty bins filled by densification."""
    bins = ((shingles >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))  # sorted: the first of a bin is its minimum
    filled = bins[first]
    if len(filled) == BINS:
        return shingles[first]
    out = np.empty(BINS, np.uint64)
    empty = np.ones(BINS, bool)
    empty[filled] = False
    holes = np.flatnonzero(empty)
    out[filled] = shingles[first]
    out[holes] = shingles[first][_ORDER[np.ix_(holes, filled)].argmin(axis=1)]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS)
    z = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        z = mix(z * np.uint64(0x9E3779B97F4A7C15) ^ rows[:, j])
    return z.view(np.int64)


def text_shingles(text: str, width: int) -> np.ndarray:
    return shingle_set(word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)), width)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, digest, bands) per document; digest and bands are null for an empty set."""
    def run(batches):
        for part in in_slices(batches):
            sets = [text_shingles(t, width) for t in texts(part)]
            yield pa.record_batch({
                "doc_id": part.column(0), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "digest": pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                "bands": pa.array([band_keys(signature(s)) if len(s) else None for s in sets],
                                  pa.list_(pa.int64()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the classes in ``wanted`` (node, digest, first_id), from the texts of their first ids."""
    ids = broadcast_if_small(wanted.select(F.col("first_id").alias("wanted_id")))  # else the texts are shuffled by id
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")

    def run(batches):
        for part in in_slices(batches):
            sets = [text_shingles(t, width) for t in texts(part)]
            yield pa.record_batch({"digest": pa.array([_digest(s) for s in sets], pa.binary()),
                                   "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})

    sets = picked.mapInArrow(run, "digest binary, shingles binary")
    return sets.join(broadcast_if_small(wanted).select("node", "digest"), "digest").select("node", "shingles").dropDuplicates(["node"])


def _confirm(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))

    def run(batches):
        for part in in_slices(batches, 2048):
            keep = []
            for x, y in zip(part.column(2), part.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep))

    return (edges.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
            .mapInArrow(run, "a long, b long"))


def _compatible(x: str, y: str, percent: int):
    """Sizes between which the threshold is possible at all."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _star_edges(rows: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) from each bucket's centre to its members of compatible size."""
    centre = rows.groupBy("key").agg(F.max(F.struct("support", F.negate("node").alias("order"), "node", "size")).alias("c"))
    joined = rows.join(centre.select("key", F.col("c.node").alias("centre"), F.col("c.size").alias("centre_size")), "key")
    return joined.where((F.col("node") != F.col("centre")) & _compatible("size", "centre_size", percent)).select(
        F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def _relabel(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows with the components that all links so far give."""
    labels = broadcast_if_small(connected_components(links))
    return (rows.join(labels.withColumnRenamed("component", "label"), "node", "left")
            .withColumn("component", F.coalesce("label", "node")).drop("label"))


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the left with the right sets, by products of 0/1 blocks."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    held = shared[col]
    row, col = row[held], place[col[held]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(col, [at, at + COLUMNS])
        block = np.zeros((len(sets), COLUMNS), np.float32)
        block[row[lo:hi], col[lo:hi] - at] = 1
        out += block[left] @ block[right].T
    return out


def _compare_blocks(percent: int):
    def compare(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        component = table.column("component").to_numpy()
        outside = table.column("outside").to_numpy(zero_copy_only=False)
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("shingles").combine_chunks()]
        size = np.array([len(x) for x in sets])
        by_size = np.argsort(size, kind="stable")
        left, right = by_size[asks[by_size]], by_size[~asks[by_size]]
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(left), SLICE):
            for j in range(0, len(right), SLICE):
                l, r = left[i:i + SLICE], right[j:j + SLICE]
                # sizes rise: slices too far apart in size hold no link
                if 100 * size[l[-1]] < percent * size[r[0]] or 100 * size[r[-1]] < percent * size[l[0]]:
                    continue
                both = [sets[k] for k in (*l, *r)]
                shared = _intersections(both, np.arange(len(l)), np.arange(len(l), len(both)))
                union = size[l][:, None] + size[r][None, :] - shared
                # A pair of two outside members meets in two block pairs: the smaller node asks.
                linked = ((100 * shared >= percent * union) & (component[l][:, None] != component[r][None, :])
                          & (~outside[r][None, :] | (node[l][:, None] < node[r][None, :])))
                x, y = np.nonzero(linked)
                found_a.append(node[l][x])
                found_b.append(node[r][y])
        return pa.table({"a": np.concatenate(found_a), "b": np.concatenate(found_b)})

    return compare


def _cluster_links(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of different components in the clusters of ``mixed`` (key, node, component)."""
    # Components that share a bucket are one cluster; an edge to the bucket's smallest says so.
    hub = mixed.groupBy("key").agg(F.min("component").alias("b"))
    edges = mixed.select("key", F.col("component").alias("a")).distinct().join(hub, "key").where("a <> b")
    clusters = broadcast_if_small(connected_components(edges.select("a", "b").distinct()))
    members = mixed.select("node", "component", "size").distinct().join(
        clusters.select(F.col("node").alias("component"), F.col("component").alias("cluster")), "component")
    return (_paired_blocks(members).join(sets, "node").groupBy("cluster", "i", "j")
            .applyInArrow(_compare_blocks(percent), "a long, b long"))


def _paired_blocks(members: DataFrame) -> DataFrame:
    """The members (node, component, size, cluster) dealt to block pairs (cluster, i, j).

    Members outside a cluster's largest component ask, all are asked. A block holds about
    ``BLOCK_SHINGLES`` shingles, so a member is copied once per so many of the other side's.
    """
    parts = members.groupBy("cluster", F.col("component").alias("main")).agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    largest = F.struct("n", "main")
    shape = parts.groupBy("cluster").agg(F.max_by("main", largest).alias("main"), F.max_by("s", largest).alias("inside"),
                                         F.sum("s").alias("all"))

    def blocks(shingles):
        return F.greatest(F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")

    shape = shape.select("cluster", "main", blocks(F.col("all")).alias("all_blocks"),
                         blocks(F.col("all") - F.col("inside")).alias("ask_blocks"))
    members = materialise(members.join(shape, "cluster").withColumn("outside", F.col("component") != F.col("main")),
                          "near-clusters")

    def spread(blocks: str):
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    def own(blocks: str):
        return F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")

    asking = members.where("outside").select("cluster", "node", "component", "outside", F.lit(True).alias("asks"),
                                             own("ask_blocks").alias("i"), spread("all_blocks").alias("j"))
    asked = members.select("cluster", "node", "component", "outside", F.lit(False).alias("asks"),
                           spread("ask_blocks").alias("i"), own("all_blocks").alias("j"))
    return asking.unionByName(asked)


def confirmed_links(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) confirmed links between class nodes, enough to give the components of all links."""
    rows = classes.select("node", F.col("n_shingles").alias("size"), F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    rows = materialise(rows.join(shared, "key"), "near-buckets")
    support = rows.groupBy("node").agg(F.sum("members").alias("support"))
    support = materialise(support, "near-support")
    wanted = materialise(classes.join(broadcast_if_small(support), "node", "left_semi")
                         .select("node", "digest", "first_id"), "near-wanted")
    sets = materialise(_full_sets(docs, wanted, width), "near-sets")

    edges = _star_edges(rows.join(broadcast_if_small(support), "node"), percent)
    links = materialise(_confirm(edges, sets, percent), "near-links")
    rows = _relabel(rows.select("key", "node", "size"), links)
    spread = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = materialise(rows.join(spread.where("lo < hi").select("key"), "key"), "near-mixed")
    if mixed.isEmpty():
        return links
    return materialise(links.union(_cluster_links(mixed, sets, percent)), "near-links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text)."""
    with scratch_scope(docs.sparkSession):
        return materialise(_groups(docs, width, percent), "near-groups", keep=True)


def _groups(docs: DataFrame, width: int, percent: int) -> DataFrame:
    sketches = materialise(sketch(docs, width), "near-sketch")
    filled = sketches.where(F.col("digest").isNotNull())
    classes = materialise(
        filled.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"),
                                     F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()), "near-classes")
    labels = broadcast_if_small(connected_components(confirmed_links(docs, classes, width, percent)))
    member = classes.select("digest", "node", "first_id").join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    smallest = member.groupBy("component").agg(F.min("first_id").alias("component_id"))
    groups = member.join(smallest, "component").select("digest", "component_id")
    out = sketches.select("doc_id", "n_shingles", "digest").join(groups, "digest", "left")
    component_id = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component_id).alias("kept"))


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that are not the first of their group; columns unchanged.

    Rows equal in every column count as one document. Only rows that share their id
    with another kept row are compared for that.
    """
    kept = near_duplicates(docs, width, percent).where("kept").groupBy(F.col("doc_id").alias("kept_id")).agg(
        F.count("*").alias("rows"))
    kept = materialise(kept, "near-kept")

    def of(ids: DataFrame) -> DataFrame:
        ids = broadcast_if_small(ids.select("kept_id"))
        return docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(F.col("kept_id")), "left_semi")

    once, again = of(kept.where("rows = 1")), kept.where("rows > 1")
    return once if again.isEmpty() else once.union(of(again).dropDuplicates())
