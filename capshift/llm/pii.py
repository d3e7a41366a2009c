"""Operator 7: personal data, and terms that give it away.

Base kinds (email, ip, card, phone) are found in each whole text. The method adds
terms: for a protected value e and a term t of the same document, the corpus gives

    disclosure(t, e) = PMI(t, e) / IC(e) = log(p(t, e) / (p(t) p(e))) / -log p(e)

with p over different documents (copies of a whole text are one). It is 1 when every
document with t also holds e. A term reaching ``DISCLOSURE`` in at least ``SUPPORT`` of
them with e is disclosing: every occurrence of it outside base spans, anywhere in a
document that holds e, is a span of kind ``term``. ``sanitise`` replaces base spans by a
class mark (generalised) and removes disclosing terms.

Counts: only values of at least ``SUPPORT`` documents can disclose, so only their
documents' distinct terms are counted with them; those counts, and the document
frequencies of terms over all documents, are summed in the task before the shuffle.
Each of m copies of a text adds 1/m there, so no text is shuffled to find them (up to
``REPEATED`` repeated texts; beyond, texts are joined with their number of copies).

Defined cases: a null or empty text has no spans (and stays null or empty when
sanitised); rows that repeat a doc_id are separate rows; matches of different kinds
may overlap and all stay, replaced by the first that starts. Extra columns are kept
by ``sanitise`` and ignored by ``find_personal_data``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capshift.llm.common import broadcast_if_small, in_slices, materialise, texts

# Fixed values of the contract: the base kinds, in their order, and their patterns.
KINDS = ["email", "ip", "card", "phone"]
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only start where a run of digits does; saying so keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
MARKS = ["<EMAIL>", "<IP>", "<CARD>", "<PHONE>", ""]

TERM = re.compile(r"[^\W\d_]{3,}")
SUPPORT = 3  # documents
DISCLOSURE = 0.8
BROADCAST_ROWS = 200_000
REPEATED = 2_000_000
FLUSH_WORDS = 200_000
SPANS = "array<struct<kind:int,start:int,end:int>>"


def _emails(text: str):
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            end = m.end()
            yield 0, start, end
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, by kind, then start."""
    found = list(_emails(text)) if "@" in text else []
    if not DIGIT.search(text):
        return found
    if "." in text:
        found += [(1, m.start(), m.end()) for m in IP.finditer(text)
                  if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in PHONE.finditer(text)
                  if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return found


def _hash(text: str, size: int = 16) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=size).digest()


def _digest(text: str) -> int:
    """64 bits that tell whole texts apart."""
    return int.from_bytes(_hash(text, 8), "little", signed=True)


def entities(text: str, spans: list[tuple[int, int, int]]) -> list[bytes]:
    """The distinct protected values of a text, hashed."""
    return sorted({_hash(f"{kind}:{text[start:end].lower()}") for kind, start, end in spans})


def terms_outside(text: str, spans: list[tuple[int, int]]):
    """(term, start, end) of every term of a text that overlaps no base span (start, end)."""
    begins, ends = [], []
    for start, end in sorted(spans):  # merged
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            begins.append(start)
            ends.append(end)
    for m in TERM.finditer(text):
        i = bisect_left(begins, m.end())
        if i == 0 or ends[i - 1] <= m.start():
            yield m[0].lower(), m.start(), m.end()


_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_SCANNED = ["base", "entities", "digest"]


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` as c0, c1, ... with three more columns: base spans, protected values and the digest of the text."""
    schema = docs.schema
    column = schema.fieldNames().index("text")
    n = len(schema)
    names = [*[f"c{i}" for i in range(n)], *_SCANNED]

    def run(batches):
        for part in in_slices(batches):
            values = [t if t is not None else "" for t in part.column(column).to_pylist()]
            spans = [find_spans(t) for t in values]
            base = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans]
            held = [entities(t, x) for t, x in zip(values, spans)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(base, _SPAN_TYPE), pa.array(held, pa.list_(pa.binary())),
                 pa.array([_digest(t) for t in values], pa.int64())], names)

    inner = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(schema))
    plain = docs.toDF(*names[:n])
    return plain.mapInArrow(run, f"{inner}, base {SPANS}, entities array<binary>, digest long")


def _documents_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, text, base, entities) of the rows that hold entities of ``wanted``, and these entities."""
    each = rows.select("row", F.explode("entities").alias("entity")).join(broadcast_if_small(wanted, BROADCAST_ROWS), "entity")
    some = each.groupBy("row").agg(F.collect_list("entity").alias("entities"))
    return rows.select("row", "text", "base").join(broadcast_if_small(some, BROADCAST_ROWS), "row").select(
        "row", "text", "base", "entities")


def _each_document(part):
    for row, text, base, held in zip(*(part.column(i).to_pylist() for i in range(4))):
        yield row, held, terms_outside(text, [(s["start"], s["end"]) for s in base])


def _count_pairs(batches):
    """(entity, term, n): documents of both, each counted once; summed in the task."""
    counts: Counter[tuple[bytes, str]] = Counter()

    def flush():
        batch = pa.record_batch({"entity": pa.array([e for e, _ in counts], pa.binary()),
                                 "term": pa.array([t for _, t in counts], pa.string()),
                                 "n": pa.array(list(counts.values()), pa.int64())})
        counts.clear()
        return batch

    for part in in_slices(batches):
        for _, held, found in _each_document(part):
            terms = {t for t, _, _ in found}
            for entity in held:
                counts.update((entity, t) for t in terms)
                if len(counts) >= FLUSH_WORDS:
                    yield flush()
    yield flush()


def _occurrences(batches):
    """(row, terms): where the wanted terms of a document stand outside its base spans."""
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    for part in in_slices(batches, 64):
        marked = []
        for text, base, wanted in zip(*(part.column(i).to_pylist() for i in range(1, 4))):
            wanted = set(wanted)
            spans = terms_outside(text, [(s["start"], s["end"]) for s in base])
            marked.append([{"kind": len(KINDS), "start": a, "end": b} for t, a, b in spans if t in wanted])
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(marked, kind)], ["row", "terms"])


def _with_copies(docs: DataFrame, repeated: DataFrame):
    """(texts with a column more, copies of a text of a batch): ``repeated`` as a lookup in the task, or joined if large."""
    if repeated.count() <= REPEATED:
        found = repeated.orderBy("digest").toArrow()
        known = docs.sparkSession.sparkContext.broadcast(
            (found.column("digest").to_numpy(), found.column("copies").to_numpy()))

        def copies(part):
            digests, numbers = known.value
            own = np.array([_digest(t) for t in texts(part)], np.int64)
            if not len(digests):
                return np.ones(len(own))
            at = np.minimum(np.searchsorted(digests, own), len(digests) - 1)
            return np.where(digests[at] == own, numbers[at], 1)

        return docs.select("text", F.lit(1).cast("long").alias("copies")), copies

    def digest(batches):
        for part in in_slices(batches):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([_digest(t) for t in texts(part)], pa.int64())], ["text", "digest"])

    joined = docs.select("text").mapInArrow(digest, "text string, digest long").join(repeated, "digest", "left")
    return joined.select("text", F.coalesce("copies", F.lit(1)).alias("copies")), lambda part: part.column(1).to_numpy()


def document_frequency(docs: DataFrame, terms: DataFrame, repeated: DataFrame) -> DataFrame:
    """(term, documents) over the different texts of ``docs`` for the terms of ``terms``; counted in the task before
    the shuffle. repeated: (digest, copies) of the texts that occur more than once."""
    known = None
    if terms.count() <= BROADCAST_ROWS:  # else every word is counted and the terms are joined afterwards
        known = docs.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in terms.collect()))
    source, copies = _with_copies(docs, repeated)

    def run(batches):
        counts: defaultdict[str, float] = defaultdict(float)

        def flush():
            batch = pa.record_batch({"term": pa.array(list(counts), pa.string()),
                                     "n": pa.array(list(counts.values()), pa.float64())})
            counts.clear()
            return batch

        for part in in_slices(batches):
            for t, n in zip(texts(part), copies(part).tolist()):
                words = {w.lower() for w in set(TERM.findall(t))}
                for w in words if known is None else words & known.value:
                    counts[w] += 1 / n
                if len(counts) >= FLUSH_WORDS:
                    yield flush()
        yield flush()

    counted = source.mapInArrow(run, "term string, n double").groupBy("term").agg(
        F.round(F.sum("n")).cast("long").alias("documents"))
    return counted.join(terms, "term", "left_semi")


def disclosing_terms(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(entity, term) pairs over the disclosure threshold; rows: (row, text, base, entities, digest)."""
    holding = rows.where(F.size("entities") > 0)
    once = holding.groupBy("digest").agg(F.min("row").alias("row")).select("row")  # one of each whole text
    first = holding.join(broadcast_if_small(once, BROADCAST_ROWS), "row")
    texts_once = materialise(rows.groupBy("digest").agg(F.count("*").alias("copies")), "pii-texts")
    total = texts_once.count()
    held = materialise(first.select(F.explode("entities").alias("entity")).groupBy("entity").agg(
        F.count("*").alias("with_entity")).where(F.col("with_entity").between(SUPPORT, total - 1)), "pii-held")
    counted = _documents_of(first, held.select("entity")).mapInArrow(_count_pairs, "entity binary, term string, n long")
    joint = materialise(counted.groupBy("entity", "term").agg(F.sum("n").alias("both"))
                        .where(F.col("both") >= SUPPORT), "pii-joint")
    frequency = document_frequency(docs, joint.select("term").distinct(), texts_once.where("copies > 1"))
    p = {"e": F.col("with_entity") / F.lit(float(total)), "t": F.col("documents") / F.lit(float(total)),
         "et": F.col("both") / F.lit(float(total))}
    ratio = F.log(p["et"] / (p["t"] * p["e"])) / -F.log(p["e"])
    return joint.join(held, "entity").join(frequency, "term").where(ratio >= DISCLOSURE).select("entity", "term")


def _added(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, terms): the spans of disclosing terms; rows: (row, text, base, entities, digest)."""
    flagged = materialise(disclosing_terms(docs, rows), "pii-flagged")
    # A document gets the terms that its own entities flag, and only these are looked for in it.
    holds = rows.select("row", F.explode("entities").alias("entity"))
    own = holds.join(broadcast_if_small(flagged, BROADCAST_ROWS), "entity").groupBy("row").agg(F.collect_set("term").alias("wanted"))
    own = materialise(own, "pii-wanted")
    found = rows.select("row", "text", "base").join(broadcast_if_small(own, BROADCAST_ROWS), "row").select(
        "row", "text", "base", "wanted").mapInArrow(_occurrences, f"row long, terms {SPANS}")
    return found.where(F.size("terms") > 0).withColumn("terms", F.sort_array("terms"))


def _spans():
    none = F.array().cast(SPANS)
    return F.concat(F.coalesce("base", none), F.coalesce("terms", none))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) per document: structs (kind, start, end) by kind, then start; kind 4 is a term."""
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    # Only texts with protected values are kept, for their terms.
    rows = materialise(found.select(F.col("c0").alias("doc_id"), F.when(F.size("base") > 0, F.col("c1")).alias("text"),
                                    *_SCANNED, F.monotonically_increasing_id().alias("row")), "pii-scan")
    return rows.join(_added(docs, rows), "row", "left").select("doc_id", _spans().alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """The digest columns of ``find_personal_data``."""
    names = F.array(*[F.lit(k) for k in [*KINDS, "term"]])
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))

    def text(of):
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    def of_kind(k):
        return lambda s: s["kind"] == k

    return found.select(
        "doc_id", *[F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{name}")
                    for k, name in enumerate(KINDS)],
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def replace_spans(text: str, spans: list[dict]) -> str:
    """Base spans become their class mark, terms go; of overlapping spans the first that starts stands."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["kind"])):
        if s["start"] >= at:
            out += [text[at:s["start"]], MARKS[s["kind"]]]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with the text sanitised; rows and columns stay."""
    schema, n = docs.schema, len(docs.schema)
    column = schema.fieldNames().index("text")
    rows = materialise(scan(docs).withColumn("row", F.monotonically_increasing_id()), "pii-rows")
    added = materialise(_added(docs, rows.select("row", F.col(f"c{column}").alias("text"), *_SCANNED)), "pii-terms")
    if added.count() <= BROADCAST_ROWS:  # spans of the few documents with terms; else the texts are shuffled by row
        added = F.broadcast(added)
    found = rows.join(added, "row", "left").select(*[f"c{i}" for i in range(n)], _spans().alias("spans"))

    def run(batches):
        for part in in_slices(batches):
            spans = part.column(n).to_pylist()
            new = [replace_spans(t, s) if t is not None and s else t
                   for t, s in zip(part.column(column).to_pylist(), spans)]
            columns = [pa.array(new, part.schema.field(i).type) if i == column else part.column(i) for i in range(n)]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(n)])

    plain = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(schema))
    return found.mapInArrow(run, plain).toDF(*schema.fieldNames())
