"""URL filters with empirical-Bayes host reputation.

Labelled page outcomes (1 = bad) are counted per host, and each host's rate of bad
pages is shrunk through beta-binomial priors: suffix towards all pages, registered
domain towards its suffix, host towards its domain. The strength of each prior is
estimated from the data by the method of moments. A host is blocked if the lower
bound of its posterior rate lies above ``max_bad_rate`` (by default the overall
rate: it is then credibly worse than the average host). Explicit rules come first.

Defined results: a null url, or one without ``://``, has an empty host and path, no
rule, and the verdict of the overall prior. Null outcomes are not counted. Hosts
without labelled pages are judged by the bound of their domain's prior, those of unknown
domains by their suffix's; their lower_bound, that of a host's own posterior, stays null.
Repeated rows are judged alike, once each. Hosts that are
addresses (``10.0.0.1``, ``[::1]``) are domains and suffixes of their own, which only the
overall rate stands behind. Columns of ``pages`` besides page_id and url are not read. Empty tables give empty results; without any labels the prior rate
is one half and nothing is blocked by reputation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize, table

#: (verdict, rule): host, slash, start of the path; as the contract of op10 lists them.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Labels that stand before a country's two letters in public suffixes.
KINDS = ("ac", "ad", "co", "com", "edu", "go", "gob", "gov", "gouv", "mil", "ne", "net", "or", "org", "sch")
#: What stands around a host's name (user, port); hosts under such suffixes; addresses.
PATTERNS = {
    "around": r"^[^@]*@|:[0-9]*\z",
    "kinds": rf"(^|\.)({'|'.join(KINDS)})\.[a-z][a-z]\z",
    "address": r"^([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[(?s:.*))\z",
}
#: Standard normal quantile of the one-sided posterior bound (95 %).
Z = 1.6448536269514722
#: Bounds of the estimated prior strengths, in pages.
STRENGTH = (1.0, 1000.0)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def bare_of(host: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(host, PATTERNS["around"], "")


def suffix_of(host: Column) -> Column:
    """The public suffix: the last label, or two under countries that sort their names by kind
    (``co.uk``). An address is its own."""
    bare = bare_of(host)
    last = F.when(bare.rlike(PATTERNS["kinds"]), F.substring_index(bare, ".", -2)).otherwise(F.substring_index(bare, ".", -1))
    return F.when(bare.rlike(PATTERNS["address"]), bare).otherwise(last)


def domain_of(host: Column) -> Column:
    """The registered domain: the public suffix and the label before it, if there is one."""
    bare = bare_of(host)
    last = F.when(bare.rlike(PATTERNS["kinds"]), F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))
    return F.when(bare.rlike(PATTERNS["address"]), bare).otherwise(last)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, slash, rest = rule.partition("/")
        at_host = (host == rule_host) | host.endswith("." + rule_host)
        fits = at_host & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _strength(groups: DataFrame) -> DataFrame:
    """One row: the prior strength k of groups (n, bad), by the method of moments."""
    total = groups.where("n > 0").agg(
        F.count(F.lit(1)).alias("g"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("nn"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bb"),
        F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("n2"),
        F.coalesce(F.sum(F.col("bad") * F.col("bad") / F.col("n")), F.lit(0.0)).alias("b2"),
    )
    p = F.when(F.col("nn") > 0, F.col("bb") / F.col("nn")).otherwise(F.lit(0.5))
    between = F.col("b2") - F.col("nn") * F.col("p") * F.col("p")
    within = F.col("p") * (1 - F.col("p"))
    room = F.when(F.col("nn") > 0, F.col("nn") - F.col("n2") / F.col("nn") - (F.col("g") - 1)).otherwise(F.lit(0.0))
    over = between - within * (F.col("g") - 1)
    k = F.when((room <= 0) | (over <= 0) | (within <= 0), F.lit(STRENGTH[1])).otherwise(
        F.least(F.greatest(within * room / F.nullif(over, F.lit(0.0)) - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))
    )
    return total.withColumn("p", p).select(F.round(k, 6).alias("k"))


def reputation(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """``outcomes`` (host, bad) → per host: suffix, domain, counts, the posterior of the
    rate of bad pages and its lower bound (null without any labels); plus the overall
    rate. Hosts with null outcomes only have n = 0: their posterior is their prior."""
    with Scratch(outcomes.sparkSession) as scratch:
        return materialize(_reputation(scratch.table(_counted(outcomes), "host-counts"), z), "host-reputation")


def _counted(outcomes: DataFrame) -> DataFrame:
    return (
        outcomes.groupBy(F.coalesce("host", F.lit("")).alias("host"))
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
        .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    )


def _reputation(hosts: DataFrame, z: float) -> DataFrame:
    """Of counted hosts, which are read for each level and prior."""
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    overall = suffixes.agg(*sums).select(
        ((F.coalesce("bad", F.lit(0)) + 0.5) / (F.coalesce("n", F.lit(0)) + 1.0)).alias("rate"), F.coalesce(F.col("n") > 0, F.lit(False)).alias("any")
    )
    levels = overall
    for name, groups in (("ks", suffixes), ("kd", domains), ("kh", hosts)):  # single rows
        levels = levels.crossJoin(_strength(groups).withColumnRenamed("k", name))
    suffix_rates = suffixes.crossJoin(levels).select(
        "suffix", "rate", "any", "kd", "kh", ((F.col("bad") + F.col("ks") * F.col("rate")) / (F.col("n") + F.col("ks"))).alias("suffix_rate")
    )
    domain_rates = domains.join(suffix_rates, "suffix").select(
        "domain", "suffix", "rate", "any", "kh", "suffix_rate",
        ((F.col("bad") + F.col("kd") * F.col("suffix_rate")) / (F.col("n") + F.col("kd"))).alias("domain_rate"),
    )
    total = F.col("n") + F.col("kh")
    mean = (F.col("bad") + F.col("kh") * F.col("domain_rate")) / total
    return hosts.join(domain_rates, ["domain", "suffix"]).select(
        "host", "domain", "suffix", "n", "bad", "rate", "suffix_rate", "domain_rate", mean.alias("host_rate"),
        F.when(F.col("any"), F.round(mean - z * F.sqrt(mean * (1 - mean) / (total + 1)), 9)).alias("lower_bound"),
    )


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, z: float = Z, max_bad_rate: float | None = None) -> DataFrame:
    """``pages`` (page_id, url) → page_id, host, path, rule, verdict, lower_bound."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # the pages' own hosts take part without an outcome, so that each of them has a prior at least
    hosts = outcomes.select("host", "bad").unionByName(parts.select("host", F.lit(None).cast("int").alias("bad")))
    limit = F.lit(max_bad_rate) if max_bad_rate is not None else F.col("rate")
    ranked = reputation(hosts, z).select(
        F.col("host").alias("known_host"), (F.col("lower_bound") > F.round(limit, 9)).alias("worse"), F.when(F.col("n") > 0, F.col("lower_bound")).alias("lower_bound")
    )
    judged = parts.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules)).join(
        ranked, F.col("host") == F.col("known_host"), "left"
    )
    by_method = F.when(F.col("worse"), "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", by_method).alias("verdict"), "lower_bound"
    )


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    """The number in a page's path is the document it shows; that document's labels
    are the page's outcome: bad if of low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").where(F.col("quality").isNotNull() | F.col("toxic").isNotNull())
    marks = labels.select(
        F.col("doc_id"), ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int").alias("bad")
    )
    shown = pages.select(
        host_of(F.col("url")).alias("host"),
        F.regexp_extract(path_of(F.col("url")), r"^/[a-z]+/([0-9]{1,18})(?:[^0-9]|$)", 1).try_cast("long").alias("shown"),
    )
    outcomes = shown.join(marks, F.col("shown") == F.col("doc_id")).select("host", "bad")
    return judge(pages, outcomes)


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, url,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
outcomes AS (
  SELECT host, (coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1)::BIGINT AS bad
  FROM p JOIN labels ON TRY_CAST(regexp_extract(path, '^/[a-z]+/([0-9]{{1,18}})(?:[^0-9]|$)', 1) AS BIGINT) = doc_id
  WHERE quality IS NOT NULL OR toxic IS NOT NULL),
hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad,
         CASE WHEN regexp_matches(any_value(bare), '{PATTERNS["address"]}') THEN any_value(bare)
           ELSE array_to_string(string_split(any_value(bare), '.')[CASE WHEN regexp_matches(any_value(bare), '{PATTERNS["kinds"]}') THEN -3 ELSE -2 END:], '.') END AS domain,
         CASE WHEN regexp_matches(any_value(bare), '{PATTERNS["address"]}') THEN any_value(bare)
           ELSE array_to_string(string_split(any_value(bare), '.')[CASE WHEN regexp_matches(any_value(bare), '{PATTERNS["kinds"]}') THEN -2 ELSE -1 END:], '.') END AS suffix
  FROM (SELECT *, regexp_replace(host, '{PATTERNS["around"]}', '', 'g') AS bare FROM (SELECT host, bad FROM outcomes UNION ALL SELECT host, NULL FROM p)) GROUP BY host),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM domains GROUP BY ALL),
overall AS (SELECT (coalesce(sum(bad), 0) + 0.5e0) / (coalesce(sum(n), 0) + 1.0e0) AS rate FROM suffixes),
grouped AS (SELECT 's' AS lvl, n, bad FROM suffixes UNION ALL SELECT 'd', n, bad FROM domains UNION ALL SELECT 'h', n, bad FROM hosts),
moments AS (
  SELECT lvl, count(*) AS g, sum(n)::DOUBLE AS nn, sum(bad)::DOUBLE / sum(n) AS p, sum(n * n)::DOUBLE AS n2, sum(bad * bad / n::DOUBLE) AS b2
  FROM grouped WHERE n > 0 GROUP BY lvl),
ks AS (
  SELECT lvl, round(CASE WHEN nn - n2 / nn - (g - 1) <= 0 OR (b2 - nn * p * p) - p * (1 - p) * (g - 1) <= 0 OR p * (1 - p) <= 0 THEN {STRENGTH[1]}e0
    ELSE least(greatest(p * (1 - p) * (nn - n2 / nn - (g - 1)) / ((b2 - nn * p * p) - p * (1 - p) * (g - 1)) - 1, {STRENGTH[0]}e0), {STRENGTH[1]}e0) END, 6) AS k
  FROM moments),
sr AS (
  SELECT suffix, rate, (bad + k * rate) / (n + k) AS suffix_rate FROM suffixes, overall, ks WHERE lvl = 's'),
dr AS (
  SELECT d.domain, d.suffix, rate, (bad + k * suffix_rate) / (n + k) AS domain_rate
  FROM domains d JOIN sr USING (suffix), ks WHERE lvl = 'd'),
hr AS (
  SELECT host, n, rate, k, (bad + k * domain_rate) / (n + k) AS m FROM hosts JOIN dr USING (domain, suffix), ks WHERE lvl = 'h'),
bound AS (SELECT host, n, round(rate, 9) AS lim, round(m - {Z}e0 * sqrt(m * (1 - m) / (n + k + 1)), 9) AS lower_bound FROM hr),
ruled AS (
  SELECT p.*, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM p)
SELECT page_id, r.host, path, rule,
       CASE WHEN rule IN ('example.net/de/8', 'com/en/', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN lower_bound > lim THEN 'block' ELSE 'allow' END AS verdict, CASE WHEN n > 0 THEN lower_bound END AS lower_bound
FROM ruled r LEFT JOIN bound b ON r.host = b.host
"""
