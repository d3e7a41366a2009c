"""Operator 5: secrets, with corpus-wide ownership of their values.

``scan`` finds the base kinds (assign, access, hex) and further candidates (service
tokens, signed web tokens, private keys from header to END line, long random-looking
strings) in each whole text. A private key's value is its whole body without white
space. Every candidate value is hashed; the hashes are counted over the corpus by
the distinct documents ("repositories") and distinct sources ("owners") they occur
in. Both decide what a copied example is: a value of ``WIDE`` owners or more, or one of
two owners that stands in ``MANY`` documents or more. A value of one owner never is, in
however many documents it stands: one owner's live credential may be all over its own
files. A random-looking value that is no example looks live. Further candidates become
spans only when they look live; base spans always stay.

Values are counted per (value, owner, document), then per (value, owner), then per
value, each combined before its shuffle; what is known of a value that holds a
thousandth of all spans or more goes back to them by broadcast, so the spans of a value
that a third of all rows hold never meet in one task.

Defined cases: a null or empty text has no spans; a null source counts as the owner
''; rows that repeat a doc_id are separate rows of one document, rows without one are
documents of their own. Spans of the same place
and different kinds all stay. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capshift.llm.common import in_slices, join_groups, materialise, texts

# Fixed values of the contract: the base kinds, in their order, and their patterns.
KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")  # whole runs only, so the length test may stand in the pattern
WORDS = ("passw", "secret", "token", "apikey", "api_key")

# Further candidates of the method: service prefixes, signed web tokens, key headers.
MORE = ["service", "jwt", "pem", "random"]
SERVICE = re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}"
                     r"|AIza[A-Za-z0-9_-]{30,}|glpat-[A-Za-z0-9_-]{20,})")
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
PEM = re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----")
BREAK = r"(?:\s|\\[nr])"  # also line ends as strings of source code have them
# A key without its END line: header fields, long lines of base64 and a shorter last one on a line of its own.
BODY = re.compile(rf"(?:\s*[A-Z][A-Za-z-]+:\x20[^\n]*\n)*+(?:{BREAK}*+[A-Za-z0-9+/=]{{40,}}+)+(?:{BREAK}++[A-Za-z0-9+/]+={{0,2}}(?=\s*?\n|\s*\Z))?"
                  rf"|{BREAK}*+[A-Za-z0-9+/=]+")
LONG = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}")
ENTROPY = 3.5  # bits a character
WIDE = 3  # owners
MANY = 20  # documents of two owners
SPAN = "array<struct<kind:int,start:int,end:int,value:binary,random:boolean>>"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_random(value: str) -> bool:
    return (len(value) >= 12 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
            and entropy(value) >= min(ENTROPY, math.log2(len(value)) - 1))


def key_block(text: str, begin: re.Match) -> tuple[int, str]:
    """(end, value) of the private key whose BEGIN line is ``begin``: to its END line, or to the end of its base64."""
    after = text.find("-----BEGIN ", begin.end())
    after = len(text) if after < 0 else after
    last = begin[0].replace("BEGIN", "END", 1)
    at = text.find(last, begin.end(), after)
    if at >= 0:
        body, end = text[begin.end():at], at + len(last)
    else:
        m = BODY.match(text, begin.end(), after)
        body, end = (m[0], m.end()) if m else ("", begin.end())
    return end, re.sub(BREAK, "", body)


def find_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of all candidates, by start, then kind."""
    found = []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        found += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    longest = max(map(len, text.split()), default=0)
    if longest >= 16:
        if "AKIA" in text:
            found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
        found += [(3, m.start(), m.end(), m[0]) for m in SERVICE.finditer(text)]
    if longest >= 32:
        found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
        found += [(6, m.start(), m.end(), m[0]) for m in LONG.finditer(text)
                  if looks_random(m[0]) and any(c.isupper() for c in m[0]) and any(c.islower() for c in m[0])]
    if "eyJ" in text:
        found += [(4, m.start(), m.end(), m[0]) for m in JWT.finditer(text)]
    if "PRIVATE KEY-----" in text:
        found += [(5, m.start(), *key_block(text, m)) for m in PEM.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, owner, found) per document."""
    def run(batches):
        for part in in_slices(batches):
            found = [[{"kind": k, "start": s, "end": e,
                       "value": hashlib.blake2b(v.encode("utf-8", "surrogatepass"), digest_size=16).digest(),
                       "random": looks_random(v) or k == 5} for k, s, e, v in find_spans(t)] for t in texts(part)]
            kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
                                       ("value", pa.binary()), ("random", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, kind)],
                                             ["doc_id", "owner", "found"])

    own = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("owner"), "text").mapInArrow(
        run, f"doc_id long, owner string, found {SPAN}")


def ownership(found: DataFrame) -> DataFrame:
    """(value, owners, repositories, n) over all candidates of ``found`` (row, doc_id, owner, found).

    Distinct owners and distinct documents that hold the value, and its spans. A
    document's rows count once; a row without an id is a document of its own.
    """
    repository = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string")))
    held = found.select("owner", repository.alias("repository"), F.explode("found").alias("s"))
    return (held.groupBy(F.col("s.value").alias("value"), "owner", "repository").agg(F.count("*").alias("n"))
            .groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
            .groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n")))


def widely_copied(owners, repositories):
    """Whether a value of so many distinct owners and documents is an example that people copy."""
    return (owners >= WIDE) | ((owners > 1) & (repositories >= MANY))


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): spans are structs (kind, start, end, live, owners, copied), base kinds and live-looking others."""
    rows = materialise(scan(docs).withColumn("row", F.monotonically_increasing_id()), "secret-scan")
    held = rows.where(F.size("found") > 0).select("row", "doc_id", "owner", "found")
    each = held.select("row", F.explode("found").alias("s")).select("row", "s.*")
    owned = materialise(ownership(held).withColumn("copied", widely_copied(F.col("owners"), F.col("repositories"))), "secret-owners")
    judged = join_groups(each, owned, "value", "n", each.count(), "inner").withColumn("live", F.col("random") & ~F.col("copied"))
    judged = judged.where((F.col("kind") < len(KINDS)) | F.col("live"))
    spans = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "live", "owners", "copied"))).alias("spans"))
    return rows.select("row", "doc_id").join(spans, "row", "left").select("doc_id", "spans")


def report(secrets: DataFrame) -> DataFrame:
    """The digest columns of ``find_secrets``."""
    names = F.array(*[F.lit(k) for k in KINDS + MORE])
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean,owners:bigint,copied:boolean>>"))
    base = F.filter(spans, lambda s: s["kind"] < len(KINDS))

    def text(of):
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    def count(of, test):
        return F.size(F.filter(of, test)).cast("long")

    def of_kind(k):
        return lambda s: s["kind"] == k

    return secrets.select(
        "doc_id", *[count(base, of_kind(k)).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(spans).alias("spans"),
        count(spans, lambda s: s["live"]).alias("n_live"),
        count(spans, lambda s: s["copied"]).alias("n_copied"))
