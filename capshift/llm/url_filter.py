"""Operator 2: URL filter from fixed rules and an empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted per host. A host's bad rate is
shrunk towards its registered domain (its last two labels), the domain's towards
its suffix (the last label) and the suffix's towards the whole: each level is a
beta-binomial whose prior strength is estimated from the spread of the level's own
rates (method of moments). A host is blocked when the lower bound of its posterior
rate, mean minus ``Z`` standard deviations, exceeds ``LIMIT``. A rule that fits the
url decides before the reputation; the longest one wins.

Everything is DataFrame expressions. Outcomes are summed per host before anything is
joined, so a host with a third of all pages is one row of the reputation table; the
table is joined back by host, and only scalars (one row a level) reach the driver.

Defined cases: a null url or one without ``://`` has host and path ''; such pages
share the reputation of the empty host. Hosts without outcomes get their domain's
prior. Null page ids have no outcome; repeated pages count once each; repeated
labels of a page count as one, the worst. Empty tables give empty results. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capshift.llm.common import join_groups, materialise

# Fixed values of the query: (rule, verdict).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
LIMIT, Z = 0.5, 1.64
RHO_LEAST, RHO_MOST = 0.001, 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits columns host and path; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest ends outermost
        name, slash, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _strength(level: DataFrame) -> float:
    """Prior strength of a level (n, bad, prior): 1 / rho - 1 with the moment estimate of rho."""
    m = level.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2) / (F.col("prior") * (1 - F.col("prior"))))
        .alias("s"), F.count("*").alias("m"), F.sum(F.col("n") - 1).alias("free")).first()
    rho = (m["s"] - m["m"]) / m["free"] if m["free"] else RHO_LEAST
    return 1 / min(max(rho, RHO_LEAST), RHO_MOST) - 1


def host_reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, bound, pages) for every host of ``pages`` (page_id, host), a written table; outcomes: (page_id, bad).

    Pages are counted by host once; all levels are summed from that table.
    """
    once = outcomes.where(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    hosts = (pages.join(once, "page_id", "left").groupBy("host")
             .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count(F.lit(1)).alias("pages")))
    hosts = materialise(hosts.withColumn("suffix", F.substring_index("host", ".", -1))
                        .withColumn("domain", F.substring_index("host", ".", -2)), "url-hosts")
    counted = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    total = hosts.agg(*counted).first()
    whole = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1)

    level = hosts.groupBy("suffix").agg(*counted).withColumn("prior", F.lit(whole))
    k = F.lit(_strength(level))
    suffix = level.select("suffix", ((F.col("bad") + k * F.col("prior")) / (F.col("n") + k)).alias("prior"))
    level = hosts.groupBy("suffix", "domain").agg(*counted).join(suffix, "suffix")
    k = F.lit(_strength(level))
    domain = level.select("domain", ((F.col("bad") + k * F.col("prior")) / (F.col("n") + k)).alias("prior"))
    level = hosts.join(domain, "domain")
    k = F.lit(_strength(level))
    a, b = F.col("bad") + k * F.col("prior"), F.col("n") - F.col("bad") + k * (1 - F.col("prior"))
    spread = F.sqrt(a * b / (F.pow(a + b, F.lit(2.0)) * (a + b + 1)))
    return materialise(level.select("host", (a / (a + b) - Z * spread).alias("bound"), "pages"), "url-bounds")


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url)."""
    host, path = host_and_path()
    parted = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(rules)
    bound = host_reputation(parted, outcomes)
    own = F.when(F.col("bound") > LIMIT, "block").otherwise("allow")
    total = bound.agg(F.sum("pages").alias("n")).first()["n"] or 0
    return join_groups(parted, bound, "host", "pages", total).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad): a page is bad when the document of its id is labelled toxic or of low quality."""
    bad = ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).where(F.col("bad").isNotNull())


ORACLE_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parted AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce(rest, '') AS rest FROM cut)),
outcomes AS (
  SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND (toxic = 1 OR quality = 0 OR (toxic IS NOT NULL AND quality IS NOT NULL)) GROUP BY 1),
hosts AS (
  SELECT host, list_last(string_split(host, '.')) AS suffix,
         array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain,
         count(bad) AS n, coalesce(sum(bad), 0) AS bad
  FROM parted LEFT JOIN outcomes USING (page_id) GROUP BY 1),
whole AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS p FROM hosts),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT p FROM whole) AS prior FROM hosts GROUP BY 1),
sk AS (SELECT 1 / least(greatest(coalesce((sum(n * pow(bad / n - prior, 2) / (prior * (1 - prior))) - count(*)) / nullif(sum(n - 1), 0), 0.001), 0.001), 0.9) - 1 AS k FROM s WHERE n > 0),
sp AS (SELECT suffix, (bad + k * prior) / (n + k) AS prior FROM s, sk),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2),
dd AS (SELECT d.*, prior FROM d JOIN sp USING (suffix)),
dk AS (SELECT 1 / least(greatest(coalesce((sum(n * pow(bad / n - prior, 2) / (prior * (1 - prior))) - count(*)) / nullif(sum(n - 1), 0), 0.001), 0.001), 0.9) - 1 AS k FROM dd WHERE n > 0),
dp AS (SELECT domain, (bad + k * prior) / (n + k) AS prior FROM dd, dk),
hh AS (SELECT hosts.*, prior FROM hosts JOIN dp USING (domain)),
hk AS (SELECT 1 / least(greatest(coalesce((sum(n * pow(bad / n - prior, 2) / (prior * (1 - prior))) - count(*)) / nullif(sum(n - 1), 0), 0.001), 0.001), 0.9) - 1 AS k FROM hh WHERE n > 0),
post AS (SELECT host, bad + k * prior AS a, n - bad + k * (1 - prior) AS b FROM hh, hk),
bounds AS (SELECT host, a / (a + b) - 1.64 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) AS bound FROM post),
ruled AS (
  SELECT p.*, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM parted p)
SELECT page_id, r.host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r LEFT JOIN bounds b ON r.host = b.host
"""
