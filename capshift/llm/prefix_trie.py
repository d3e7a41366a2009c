"""Prefix trie of conversations by whole-sequence collapse.

Identical conversations collapse to one weighted sequence with the list of those that
end there. A prefix is known by its depth and a 128-bit sum of position-dependent turn
hashes, which running sums give for all prefixes at once. Sequences that are proper
prefixes of others are found by an anti-join with the others' prefixes; the rest are
the leaves. Nodes are the weighted prefixes of the distinct sequences, aggregated.

What a subtree saves is summed without walking it: every node is charged to the
smallest leaf below it, so along a leaf's path the charged nodes are its lower end, and
suffix sums per leaf, added up per node, give each subtree once.

Long conversations, hot conversations and hot nodes are split: places and running sums
are taken in parts and blocks, groups are combined before they are shuffled, and joins
broadcast the keys that hold a thousandth of all rows (``common.join_groups``). The list
of a node's ends is rendered in pieces of 4,096 ids, and one task streams the pieces of
a node through its digest without holding them.

Defined cases: rows without a conv_id belong to no conversation and are left out. Turns
go by turn (null first), then role, then a digest of the text; repeated rows are turns
of their own. Null role and text are empty. An empty table has no nodes, not even the
root. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capshift.llm.common import join_groups, materialise
from capshift.llm.conversations import in_order, running_sums, turn_digests

SUMS = ["s0", "s1", "s2", "s3"]
LOW = (1 << 32) - 1
ID_BITS = 12  # ids of one piece of an end list share all but their lowest bits
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, t1, t2, bytes): every turn's place, digest and size of its text."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("conv_id", "turn", "role", *turn_digests(rows), F.octet_length("text").cast("long").alias("bytes"))
    return in_order(rows, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("t1"), F.col("t2")]).drop("turn", "role")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences (seq, pos, size, t1, t2, bytes) and all ids (seq, size): the first h turns of conversation
    c - c % 5, then c's own turns after its first h, where h is the crc32 of c's decimal form modulo 9."""
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumns({
        "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9, "base": F.col("conv_id") - F.col("conv_id") % 5})
    base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(base, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = materialise(convs.withColumn("size", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "trie-convs")
    heads = turns.where("i <= 8 and conv_id % 5 = 0").withColumnRenamed("conv_id", "base")
    first = convs.select(F.col("conv_id").alias("seq"), "base", "m", "size").join(heads, "base").where("i <= m").select(
        "seq", F.col("i").cast("long").alias("pos"), "size", "t1", "t2", "bytes")
    own = join_groups(turns, convs.select("conv_id", "n", "h", "m", "size"), "conv_id", "n", turns.count(), "inner")
    own = own.where("i > h").select(F.col("conv_id").alias("seq"), (F.col("m") + F.col("i") - F.col("h")).alias("pos"),
                                    "size", "t1", "t2", "bytes")
    return materialise(first.unionByName(own), "trie-rebuilt"), convs.select(F.col("conv_id").alias("seq"), "size")


def _node(depth, sums) -> F.Column:
    """A prefix as (depth, 128 bits): the low halves of its four sums."""
    low = [s.bitwiseAND(F.lit(LOW)) for s in sums]
    return F.struct(depth.cast("long").alias("d"), F.shiftleft(low[0], 32).bitwiseOR(low[1]).alias("a"),
                    F.shiftleft(low[2], 32).bitwiseOR(low[3]).alias("b"))


def _root() -> F.Column:
    return _node(F.lit(0), [F.lit(0).cast("long")] * 4)


def prefixes(sequences: DataFrame) -> DataFrame:
    """(seq, size, node, parent, bytes): every prefix but the empty one of every sequence, as written table."""
    hashes = {}
    for k, t in enumerate(("t1", "t2")):
        both = F.xxhash64(t, "pos")
        hashes[SUMS[2 * k]], hashes[SUMS[2 * k + 1]] = both.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(both, 32)
    rows = sequences.withColumn("pos", F.col("pos").cast("long")).withColumns(hashes)
    rows = rows.withColumns({f"own_{s}": F.col(s) for s in SUMS})
    rows = running_sums(rows, "seq", "pos", SUMS)
    return materialise(rows.select(
        "seq", "size", _node(F.col("pos"), [F.col(s) for s in SUMS]).alias("node"),
        _node(F.col("pos") - 1, [F.col(s) - F.col(f"own_{s}") for s in SUMS]).alias("parent"), "bytes"), "trie-prefixes")


def collapse(ends: DataFrame) -> DataFrame:
    """Distinct sequences (node, seq, weight, ends_sha256) of the ends (seq, node); seq is the smallest member."""
    pieces = ends.groupBy("node", F.shiftright("seq", ID_BITS).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"),
        F.array_join(F.transform(F.sort_array(F.collect_list("seq")), lambda i: i.cast("string")), ",").alias("piece"))
    flat = pieces.select("node.d", "node.a", "node.b", "block", "n", "seq", "piece")

    def stream(batches):
        """Rows come sorted by node and block; only the node at hand is kept."""
        key, weight, first, digest = None, 0, None, None
        for batch in batches:
            done = []
            for d, a, b, n, seq, piece in zip(*(batch.column(c).to_pylist() for c in ("d", "a", "b", "n", "seq", "piece"))):
                if (d, a, b) != key:
                    if key is not None:
                        done.append((*key, first, weight, digest.hexdigest()))
                    key, weight, first, digest = (d, a, b), 0, seq, hashlib.sha256()
                else:
                    digest.update(b",")
                weight += n
                digest.update(piece.encode())
            yield _sequence_rows(done)
        if key is not None:
            yield _sequence_rows([(*key, first, weight, digest.hexdigest())])

    rows = (flat.repartition("d", "a", "b").sortWithinPartitions("d", "a", "b", "block")
            .mapInArrow(stream, "d long, a long, b long, seq long, weight long, ends_sha256 string"))
    return materialise(rows.select(F.struct("d", "a", "b").alias("node"), "seq", "weight", "ends_sha256"), "trie-sequences")


def _sequence_rows(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = ("d", "a", "b", "seq", "weight", "ends_sha256"), [pa.int64()] * 5 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def trie(sequences: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per node (COLUMNS) of the trie of ``sequences`` (seq, pos, size, t1, t2, bytes).

    ``ids`` (seq, size) has every sequence, those without turns too.
    """
    paths = prefixes(sequences)
    ends = paths.where(F.col("node.d") == F.col("size")).select("seq", "node").unionByName(
        ids.where("size = 0").select("seq", _root().alias("node")))
    whole = collapse(ends)
    weighted = whole.select("seq", "weight", F.col("node.d").alias("length"))
    rows = materialise(join_groups(paths, weighted, "seq", "length", paths.count(), "inner"), "trie-weighted")
    total = rows.count()

    proper = rows.where(F.col("node.d") < F.col("size")).select("node").distinct()
    leaves = whole.join(proper, "node", "left_anti")
    if total:  # the empty sequence is a proper prefix of every other
        leaves = leaves.where(F.col("node.d") > 0)
    leaves = materialise(leaves.select("seq", F.col("node.d").alias("length"), F.lit(True).alias("leaf")), "trie-leaves")
    rows = materialise(join_groups(rows.drop("length"), leaves, "seq", "length", total).drop("length"), "trie-rows")

    leaf = F.col("leaf").isNotNull()
    nodes = rows.groupBy("node").agg(
        F.sum("weight").alias("n_convs"), F.min("seq").alias("conv_id"), F.count_if(leaf).alias("n_leaves"),
        F.min(F.when(leaf, F.col("seq"))).alias("charged"), F.min("parent").alias("parent"), F.min("bytes").alias("bytes"))
    children = rows.select("parent", "node").distinct().groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = materialise(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
                        .withColumn("own", (F.col("n_convs") - 1) * F.col("bytes")), "trie-nodes")

    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    parts = whole.select(F.col("weight").alias("n_convs"), F.col("seq").alias("conv_id"), zero.alias("n_leaves"),
                         zero.alias("saved"), zero.alias("n_children"))
    parts = parts.union(leaves.select(none, none, F.lit(1).cast("long"), zero, zero))
    parts = parts.union(nodes.select(none, none, zero, "own", (F.col("node.d") == 1).cast("long")))
    top = parts.agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in (
        "n_convs", "n_leaves", "saved", "n_children")]).where("n_convs is not null")
    top = top.select(_root().alias("node"), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
                     "n_children", "n_leaves", F.col("saved").alias("saved_tokens"))

    all_nodes = nodes.select("node", "conv_id", "n_children").unionByName(top.select("node", "conv_id", "n_children"))
    parents = materialise(all_nodes.where("n_children > 0").select(
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children"), "trie-parents")
    below = join_groups(nodes.withColumnRenamed("n_children", "own_children"), parents, "parent", "n_children",
                        total, "inner").drop("n_children").withColumnRenamed("own_children", "n_children")
    below = below.join(_saved(rows, nodes), "node", "left").select(
        "node", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.coalesce("saved", F.lit(0)).alias("saved_tokens"))
    out = below.unionByName(top).join(whole.select("node", "ends_sha256"), "node", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.withColumn("depth", F.col("node.d")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty))).select(
        *[F.col(c) if c == "ends_sha256" else F.col(c).cast("long").alias(c) for c in COLUMNS])


def _saved(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, saved): what the subtree of every node that several conversations share saves."""
    shared = materialise(nodes.where("n_convs > 1").select("node", "n_leaves", "charged", "own"), "trie-shared")
    paths = rows.where(F.col("leaf").isNotNull()).select("seq", "node")
    paths = join_groups(paths, shared, "node", "n_leaves", rows.count(), "inner")
    paths = paths.select("seq", "node", F.col("node.d").alias("pos"),
                         F.when(F.col("charged") == F.col("seq"), F.col("own")).otherwise(F.lit(0)).alias("up_to"))
    paths = paths.withColumn("here", F.col("up_to"))
    # shared nodes are the upper end of a path, so places run from 1 without a gap
    paths = materialise(running_sums(paths, "seq", "pos", ["up_to"]), "trie-charged")
    totals = paths.groupBy("seq").agg(F.sum("here").alias("all"), F.count(F.lit(1)).alias("n"))
    totals = materialise(totals.where(F.col("all") > 0), "trie-charges")
    rest = join_groups(paths, totals, "seq", "n", paths.count(), "inner")
    return rest.groupBy("node").agg(F.sum(F.col("all") - F.col("up_to") + F.col("here")).alias("saved"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    sequences, ids = rebuild(ordered_turns(conversations))
    return trie(sequences, ids)


def crc32_sql(text: str) -> str:
    """SQL for the unsigned crc32 of an ASCII string: eight shifts a byte (fixed value: the reflected polynomial)."""
    step = f"CASE WHEN i % 8 = 0 THEN xor(x, ascii(substr({text}, (i // 8 + 1)::BIGINT, 1))::BIGINT) ELSE x END"
    return (f"xor(4294967295, list_reduce([4294967295::BIGINT] || range(0, 8 * length({text}))::BIGINT[], lambda x, i: "
            f"CASE WHEN ({step}) & 1 = 1 THEN xor(({step}) >> 1, 3988292384::BIGINT) ELSE ({step}) >> 1 END))")


ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c0 AS (SELECT conv_id, conv_id - conv_id % 5 AS base, CAST(conv_id AS VARCHAR) AS s, count(*) AS n FROM t GROUP BY conv_id),
c AS (SELECT conv_id, base, n, {crc32_sql("s")} % 9 AS h FROM c0),
m AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS m FROM c LEFT JOIN c b ON b.conv_id = c.base),
s AS (
  SELECT m.conv_id, t.i AS d, r, x FROM m JOIN t ON t.conv_id = m.base AND t.i <= m.m
  UNION ALL SELECT m.conv_id, m.m + t.i - m.h, r, x FROM m JOIN t ON t.conv_id = m.conv_id AND t.i > m.h),
p AS (
  SELECT conv_id, d, x, string_agg(strlen(r) || ':' || r || strlen(x) || ':' || x, '') OVER (
    PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS k FROM s
  UNION ALL SELECT conv_id, 0, '', '' FROM m),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, min(x) AS x FROM p GROUP BY k, d),
l AS (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id),
e AS (SELECT p.k, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids FROM p JOIN l USING (conv_id, d) GROUP BY p.k),
a AS (SELECT n.k, q.k AS up FROM n JOIN p q ON q.conv_id = n.conv_id AND q.d = n.d - 1),
ch AS (SELECT up AS k, count(*) AS n_children FROM a GROUP BY up),
sub AS (
  SELECT q.k, sum((n.n_convs - 1) * strlen(n.x)) AS saved, count(*) FILTER (ch.k IS NULL) AS n_leaves
  FROM n LEFT JOIN ch ON ch.k = n.k JOIN p q ON q.conv_id = n.conv_id AND q.d <= n.d GROUP BY q.k)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs,
       coalesce(ch.n_children, 0) AS n_children, sub.n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM n JOIN sub USING (k) LEFT JOIN ch USING (k) LEFT JOIN e USING (k) LEFT JOIN a USING (k) LEFT JOIN n up ON up.k = a.up
"""
