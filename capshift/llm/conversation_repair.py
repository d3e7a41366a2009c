"""Conversation structure repair by a persistent audit program (see ``audit_tree``).

Rows are shuffled and sorted once by conversation, and a task streams them: the program
keeps one linked edit sequence per state of the role automaton. Whenever many rows are
pending, the letters that all living sequences share are settled: their rows are written
or hashed and forgotten. What a task holds is the unsettled end of one conversation (a
few rows as a rule) and its audit letters; a conversation of a third of all rows is
streamed, not collected. (One task does read it all: the SHA-256 of a repaired
conversation is one chain over its text.)

Whether a row repeats an earlier one is found before that by a grouped minimum over
(conversation, content), combined before the shuffle; only contents that occur twice
are joined back, hot ones by broadcast.

Defined cases: null role or text, and a null conv_id or turn inside the damage key, are
one space; rows with a null conv_id are one conversation of their own. Rows go by turn
(null first), then by role and a digest of the text as they were before the damage. A
role is judged by its first character as it stands (``User`` is no user); an empty role
has none, so such a row is reroled or deleted. An empty table has no rows in its result.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capshift.llm.audit_tree import KEEPS, MODULUS, NAMES, SPOKEN, START, AuditDP
from capshift.llm.common import in_slices, join_groups, materialise
from capshift.llm.conversations import turn_digests
from capshift.llm.prefix_trie import crc32_sql

SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
PENDING_ROWS, PENDING_CHARS = 256, 1 << 22  # rows or characters after which shared letters are settled
REPORT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")
TURNS = "conv_id long, place long, role string, text string"
ROWS = ["conv_id", "turn", "role", "text", "copies", "first_role", "t1", "t2"]


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with their damage done; ``copies`` is 0 for a dropped row, 2 for a repeated one."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(key.cast("binary")) % 20
    rows = rows.select("conv_id", "turn", "role", "text", fault.alias("fault"), *turn_digests(rows))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ENDS, ""))
        .otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).alias("copies"),
        F.col("role").alias("first_role"), "t1", "t2")


def as_given(conversations: DataFrame) -> DataFrame:
    """Rows as they are, for a repair without the damage; nulls are one space."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return rows.select("*", F.lit(1).alias("copies"), F.col("role").alias("first_role"), *turn_digests(rows))


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """Rows of a conversation together and in order, each with its faults.

    ``again`` is true where the content occurs elsewhere in the conversation and this is
    not its earliest place; equal rows at the earliest place stand side by side, and the
    stream tells the first of them.
    """
    c1, c2 = turn_digests(rows)
    rows = rows.withColumns({"content": F.struct("conv_id", c1, c2), "at": F.struct("turn", "first_role", "t1", "t2")})
    small = rows.where("copies > 0").select("content", "at", "copies")
    twice = small.groupBy("content").agg(F.sum("copies").alias("n"), F.min("at").alias("first")).where("n > 1")
    twice = materialise(twice, "repair-repeated")
    rows = join_groups(rows, twice, "content", "n", rows.count())
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    rows = rows.select(
        "conv_id", "turn", "role", "text", "copies", "content", "first_role", "t1", "t2", (last == "").alias("blank"),
        ((last != "") & ~last.isin(*ENDS)).alias("open"), F.coalesce(F.col("at") != F.col("first"), F.lit(False)).alias("again"))
    rows = rows.select("conv_id", "turn", "role", "text", "copies", "blank", "open", "again",
                       F.col("content.t1").alias("c1"), F.col("content.t2").alias("c2"), "first_role", "t1", "t2")
    return rows.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "first_role", "t1", "t2")


class _Conversation:
    """One conversation while its rows stream by."""

    def __init__(self, conv_id, modulus: int, write):
        self.conv_id, self.write = conv_id, write
        self.dp = AuditDP(modulus)
        self.digest, self.lines = hashlib.sha256(), 0
        self.audit: list[str] = []
        self.state = START
        self.pending: list[tuple[str, str]] = []
        self.chars = 0
        self.rows = self.blank = self.duplicate = self.open = self.illegal = 0
        self.initial = self.content = None
        self.least = self.most = self.turn = None
        self.turns = 0

    def feed(self, turn, role: str, text: str, blank: bool, opened: bool, again: bool, content) -> None:
        again = again or content == self.content
        initial = role[:1]
        if blank:
            self.blank += 1
        elif again:
            self.duplicate += 1
        elif opened:
            self.open += 1
        if self.rows and (self.initial or "") + initial not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None:
            if self.turn != turn:
                self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = self.turn = turn
        self.rows += 1
        self.initial, self.content = initial, content
        self.dp.feed(initial, blank or again, opened)
        self.pending.append((role, text))
        self.chars += len(text)
        if len(self.pending) >= PENDING_ROWS or self.chars >= PENDING_CHARS:
            self._carry_out(self.dp.settle())

    def _carry_out(self, letters: str) -> None:
        """Do the settled edits to the oldest pending rows."""
        at = 0
        for letter in letters:
            if letter != "I":
                role, text = self.pending[at]
                at += 1
            if letter == "K":
                self.state = KEEPS[self.state, role[:1]]
            elif letter != "D":
                self.state = SPOKEN[self.state]
                role, text = NAMES[self.state], text if letter == "R" else ""
            if letter != "D":
                self.digest.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
                self.lines += 1
                if self.write is not None:
                    self.write((self.conv_id, self.lines, role, text))
        del self.pending[:at]
        self.chars = sum(len(text) for _, text in self.pending)
        self.audit.append(letters)

    def report(self) -> tuple:
        """The conversation's row of the report; its last edits are done with it."""
        cost, letters = self.dp.finish() if self.rows else (0, "")
        self._carry_out(letters)
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, self.blank, self.duplicate, self.open, self.illegal, cost, "".join(self.audit),
                self.digest.hexdigest())


def _stream(batches, modulus: int, whole: bool):
    """Reports of the conversations (or, with ``whole``, their repaired turns) of sorted rows."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())]) if whole \
        else pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                        ("audit", pa.string()), ("repaired_sha256", pa.string())])
    out: list[tuple] = []

    def table() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)
        out.clear()
        return done

    now = None
    for part in in_slices(batches, 256):
        for conv, turn, role, text, copies, blank, opened, again, c1, c2 in zip(
                *(part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "blank", "open", "again", "c1", "c2"))):
            if now is None or now.conv_id != conv:
                if now is not None:
                    done = now.report()
                    if not whole:
                        out.append(done)
                now = _Conversation(conv, modulus, out.append if whole else None)
            for _ in range(copies):
                now.feed(turn, role, text, blank, opened, again, (c1, c2))
        yield table()
    if now is not None:
        done = now.report()
        if not whole:
            out.append(done)
        yield table()


def repair_report(rows: DataFrame, modulus: int = MODULUS) -> DataFrame:
    """One row (REPORT) per conversation of ``rows`` (of ``damage`` or ``as_given``)."""
    return _sorted_rows(rows.select(*ROWS)).mapInArrow(lambda b: _stream(b, modulus, False), REPORT)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves (TURNS)."""
    return _sorted_rows(rows.select(*ROWS)).mapInArrow(lambda b: _stream(b, MODULUS, True), TURNS)


ORACLE_SQL = rf"""
WITH RECURSIVE
r0 AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS r0, coalesce(text, ' ') AS t0,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
r1 AS (SELECT conv_id, turn, r0, t0, {crc32_sql("s")} % 20 AS e FROM r0),
r2 AS (
  SELECT conv_id, turn, r0, t0, CASE WHEN e = 4 THEN 'user' ELSE r0 END AS r,
         CASE WHEN e = 1 THEN '' WHEN e = 2 THEN regexp_replace(t0, '[.!?]', '', 'g') ELSE t0 END AS x,
         unnest(range(CASE WHEN e = 3 THEN 2 ELSE 1 END)) AS c
  FROM r1 WHERE e <> 0),
r3 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r0, t0, c) AS i FROM r2),
r AS (
  SELECT conv_id, turn, i, r, x, substr(r, 1, 1) AS f,
         CASE WHEN NOT regexp_matches(x, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, r, x ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(x, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault,
         lag(substr(r, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS pf
  FROM r3),
edits(q, f, q2, cost, a) AS (VALUES
  (0, NULL, 0, 3, 'D'), (1, NULL, 1, 3, 'D'), (2, NULL, 2, 3, 'D'), (3, NULL, 3, 3, 'D'),
  (0, 's', 1, 0, 'K'), (0, 'u', 2, 0, 'K'), (1, 'u', 2, 0, 'K'), (3, 'u', 2, 0, 'K'), (2, 'a', 3, 0, 'K'),
  (0, NULL, 2, 2, 'R'), (1, NULL, 2, 2, 'R'), (3, NULL, 2, 2, 'R'), (2, NULL, 3, 2, 'R')),
inserts(q, q2, cost, a) AS (VALUES
  (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''),
  (0, 2, 2, 'I'), (1, 2, 2, 'I'), (3, 2, 2, 'I'), (2, 3, 2, 'I'), (0, 3, 4, 'II'), (1, 3, 4, 'II')),
dp AS (
  SELECT c.conv_id, 0::BIGINT AS i, s.q2 AS q, s.cost::BIGINT AS cost, s.a
  FROM (SELECT DISTINCT conv_id FROM r) c, inserts s WHERE s.q = 0
  UNION ALL
  SELECT conv_id, i, q, cost, a FROM (
    SELECT dp.conv_id, r.i, s.q2 AS q, dp.cost + e.cost + s.cost + (e.a <> 'D' AND r.fault = 'truncated')::BIGINT AS cost,
           dp.a || e.a || s.a AS a,
           row_number() OVER (PARTITION BY dp.conv_id, s.q2 ORDER BY
             dp.cost + e.cost + s.cost + (e.a <> 'D' AND r.fault = 'truncated')::BIGINT, dp.a || e.a || s.a) AS best
    FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1
    JOIN edits e ON e.q = dp.q AND (e.f IS NULL OR e.f = r.f) AND (e.a = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
    JOIN inserts s ON s.q = e.q2)
  WHERE best = 1),
n AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND pf || f NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id),
b AS (
  SELECT n.*, dp.cost, dp.a, row_number() OVER (PARTITION BY n.conv_id ORDER BY dp.cost, dp.a) AS best
  FROM n JOIN dp ON dp.conv_id IS NOT DISTINCT FROM n.conv_id AND dp.i = n.n AND dp.q IN (0, 3)),
l0 AS (SELECT conv_id, a, unnest(range(1, length(a) + 1)) AS j FROM b WHERE best = 1),
l1 AS (
  SELECT conv_id, j, substr(a, j::BIGINT, 1) AS e,
         count(*) FILTER (substr(a, j::BIGINT, 1) <> 'I') OVER w AS i, count(*) FILTER (substr(a, j::BIGINT, 1) <> 'D') OVER w AS o
  FROM l0 WINDOW w AS (PARTITION BY conv_id ORDER BY j ROWS UNBOUNDED PRECEDING)),
l2 AS (
  SELECT l1.conv_id, l1.j, l1.e, l1.o, r.r, r.x,
         max(CASE WHEN l1.o = 1 AND l1.e = 'K' AND r.f = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l1.conv_id) AS led
  FROM l1 LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM l1.conv_id AND r.i = l1.i WHERE l1.e <> 'D'),
t AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN r WHEN (o - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
                             CASE WHEN e = 'I' THEN '' ELSE x END, chr(10) ORDER BY j) AS lines
  FROM l2 GROUP BY conv_id)
SELECT c.conv_id, coalesce(b.gaps, 0) AS gaps, coalesce(b.blank, 0) AS blank, coalesce(b.duplicate, 0) AS duplicate,
       coalesce(b.truncated, 0) AS truncated, coalesce(b.illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost,
       coalesce(b.a, '') AS audit, sha256(coalesce(t.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.best = 1
LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""
