"""Exact duplicates: binary-fuse filters of immutable snapshots screen what comes in.

Documents arrive in batches. The digests of a batch that no earlier batch had form an
immutable snapshot: exact buckets of digests and one static binary-fuse filter per
bucket. A later batch is first grouped by itself (its own duplicates, combined before
the shuffle), then its distinct digests are asked of the filters of all snapshots;
the few positives are joined with the exact buckets, which removes the false ones;
what is left is new and becomes the next snapshot. Only digests that occur twice or
more have their bytes checked: their normalised texts are grouped by content, and
where one digest turns out to hold several texts, its rows are grouped by the texts.

Texts never move but for that check. Everything else is 32-byte digests.

Defined cases: null text is empty text, and all empty texts (or texts of white space
alone) are equal to each other. Of equal texts the row with the most code points
stays, then the smallest doc_id, a null doc_id last; of repeated rows with the same
id and text one stays. A null doc_id is a document like others. An empty table gives
an empty result. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capshift.llm import fuse_filter
from capshift.llm.common import join_groups, materialise

SPACE = " \t\n\x0b\x0c\r"
KEYS_PER_BUCKET = 1 << 17  # digests of one filter and of one exact bucket, on average
BATCHES = 3
FILTER = "bucket int, snapshot int, seed int, length int, starts int, cells binary"


def _texts(docs: DataFrame, digest_bytes: int) -> DataFrame:
    """(doc_id, points, norm, sha, digest): the normalised text, its SHA-256 and the part of it that is compared."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(text).alias("points"),
                       F.translate(text, SPACE, "").alias("norm"))
    return (rows.withColumn("sha", F.unhex(F.sha2(F.col("norm"), 256)))
            .withColumn("digest", F.substring("sha", 1, digest_bytes)))


def _stays() -> F.Column:
    """Largest for the row that stays; ~id grows as the id falls, and null is least."""
    return F.struct("points", F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row").alias("row"))


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    """The first eight bytes of every digest as numbers."""
    return np.frombuffer(b"".join(d[:8].ljust(8, b"\0") for d in column.to_pylist()), np.uint64)


class SnapshotIndex:
    """Immutable snapshots of digests: exact buckets and a filter per bucket, both written tables."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.entries: DataFrame | None = None  # (snapshot, digest)
        self.filters: DataFrame | None = None
        self.snapshots = 0

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64("digest"), F.lit(self.buckets)).cast("int").alias("bucket")

    def screen(self, incoming: DataFrame) -> DataFrame:
        """(digest): those of the distinct ``incoming`` digests that a snapshot holds."""
        if self.filters is None:
            return incoming.select("digest").where(F.lit(False))

        def ask(left: pa.Table, right: pa.Table) -> pa.Table:
            keys, digests, snapshots = _keys(left.column("digest")), [], []
            for f in right.select(["snapshot", "seed", "length", "starts", "cells"]).to_pylist():
                hit = fuse_filter.contains(keys, f["seed"], f["length"], f["starts"], f["cells"])
                digests.append(left.column("digest").filter(pa.array(hit)).combine_chunks())
                snapshots += [f["snapshot"]] * int(hit.sum())
            return pa.table({"digest": pa.chunked_array(digests, pa.binary()), "snapshot": pa.array(snapshots, pa.int32())})

        asked = incoming.select("digest", self._bucket()).groupBy("bucket")
        positives = asked.cogroup(self.filters.groupBy("bucket")).applyInArrow(ask, "digest binary, snapshot int")
        return positives.join(self.entries, ["snapshot", "digest"]).select("digest").distinct()

    def add(self, digests: DataFrame) -> None:
        """A new snapshot of distinct digests that no earlier snapshot holds."""
        number = self.snapshots

        def build(table: pa.Table) -> pa.Table:
            seed, length, starts, cells = fuse_filter.build(_keys(table.column("digest")))
            return pa.table([[table.column("bucket")[0].as_py()], [number], [seed], [length], [starts], [cells]],
                            schema=pa.schema([("bucket", pa.int32()), ("snapshot", pa.int32()), ("seed", pa.int32()),
                                              ("length", pa.int32()), ("starts", pa.int32()), ("cells", pa.binary())]))

        entries = digests.select(F.lit(number).alias("snapshot"), "digest")
        filters = materialise(digests.select("digest", self._bucket()).groupBy("bucket").applyInArrow(build, FILTER),
                              "dedup-filters")
        self.entries = entries if self.entries is None else self.entries.unionByName(entries)
        self.filters = filters if self.filters is None else self.filters.unionByName(filters)
        self.snapshots += 1


def _repeated(batches: DataFrame, number: int, buckets: int) -> DataFrame:
    """(digest, n, stays) of the digests that two rows or more have, over all batches.

    ``batches`` has one row (batch, digest, n, stays) per batch and digest.
    """
    index, fresh, seen = SnapshotIndex(buckets), [], []
    for b in range(number):
        incoming = batches.where(F.col("batch") == b).drop("batch")
        known = materialise(index.screen(incoming), "dedup-known")
        seen.append(incoming.join(known, "digest", "left_semi"))
        new = materialise(incoming.join(known, "digest", "left_anti"), "dedup-new")
        fresh.append(new)
        if b + 1 < number:
            index.add(new)
    first, again = fresh[0], seen[0]
    for more, other in zip(fresh[1:], seen[1:]):
        first, again = first.unionByName(more), again.unionByName(other)
    again = materialise(again, "dedup-again")
    hit = again.select("digest", F.lit(True).alias("hit")).distinct()
    first = first.join(hit, "digest", "left").where((F.col("n") > 1) | F.col("hit")).drop("hit")
    return materialise(first.unionByName(again).groupBy("digest").agg(F.sum("n").alias("n"), F.max("stays").alias("stays")),
                       "dedup-repeated")


def find_duplicates(docs: DataFrame, batches: int = BATCHES, digest_bytes: int = 32) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (see the module).

    ``batches`` is the number of arrivals the table is taken in, dealt by a hash of the
    id; the result does not depend on it. ``digest_bytes`` shortens the compared part of
    the SHA-256 (tests), which the byte check makes good.
    """
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    texts = _texts(docs, digest_bytes)
    rows = materialise(texts.select("doc_id", "points", "sha", "digest", batch, F.monotonically_increasing_id().alias("row")),
                       "dedup-rows")
    total = rows.count()
    groups = materialise(rows.groupBy("batch", "digest").agg(F.count(F.lit(1)).alias("n"), F.max(_stays()).alias("stays")),
                         "dedup-batches")
    buckets = max(1, -(-groups.count() // KEYS_PER_BUCKET))
    repeated = _repeated(groups, batches, buckets)

    # the byte check: equal texts of a task are combined before they are shuffled
    held = join_groups(texts.select("digest", "norm"), repeated.select("digest", "n"), "digest", "n", total, how="inner")
    contents = held.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("rows"))
    several = materialise(contents.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.sum("rows").alias("n"))
                          .where(F.col("texts") > 1).select("digest", "n"), "dedup-collisions")

    agree = repeated.join(several, "digest", "left_anti")
    if not several.isEmpty():
        rows = rows.join(several, "digest", "left_anti")
    groups = materialise(agree.select("digest", F.col("n").alias("group_size"), "stays"), "dedup-groups")
    out = join_groups(rows, groups, "digest", "group_size", total).select(
        "doc_id",
        F.when(F.col("stays").isNull(), F.col("doc_id")).otherwise(F.bitwise_not("stays.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.bitwise_not("stays.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))
    return out if several.isEmpty() else out.unionByName(_by_content(texts, several))


def _by_content(texts: DataFrame, several: DataFrame) -> DataFrame:
    """The rows of digests that stand for several texts, grouped by the texts themselves."""
    rows = materialise(texts.join(several.select("digest"), "digest", "left_semi")
                       .withColumn("row", F.monotonically_increasing_id()), "dedup-contents")
    groups = rows.groupBy("norm").agg(F.count(F.lit(1)).alias("group_size"), F.max(_stays()).alias("stays"))
    return rows.join(groups, "norm").select(
        "doc_id", F.bitwise_not("stays.id").alias("keep_id"), "group_size",
        (F.bitwise_not("stays.row") == F.col("row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY length(t) DESC, doc_id)
"""
