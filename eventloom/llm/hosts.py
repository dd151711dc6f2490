"""URL filters by empirical-Bayes host reputation, beside fixed rules.

Labelled pages give each host a number of outcomes and of bad ones. Shares of hosts are
beta-binomial: a host's prior is centred on its registered domain, that one's on its
suffix, that one's on all pages, and how far a prior counts is estimated from the spread
of the shares below it (moments). A host is blocked when the lower posterior bound of
its share of bad pages is over MAX_BAD; few labels leave a host close to its domain.

A page's label is that of the document whose number ends the path (labels.doc_id): bad
if its quality is 0 or it is toxic. Rules are a short list of settings; of those that
fit, the longest wins over the reputation.

A null url, or one without `://`, has an empty host and path, no rule, and the verdict of
the prior. A table without labels allows all. Repeated rows count as often as they
occur. Labels that occur twice are bad if one of them is. Extra columns are ignored.
Runs on built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rules (verdict, host and path): a host stands for its subdomains too, a path for all
#: that start with it.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: A host whose share of bad pages is surely over this is blocked.
MAX_BAD = 0.25
#: Standard deviations between posterior mean and lower bound.
SURE = 1.645
#: Limits of the estimated correlation of two pages of one group.
LEAST_RHO, MOST_RHO = 0.001, 0.5
#: A suffix has two labels where one of these stands before a country code of two letters
#: (co.uk, com.cn, gov.in); all others are the last label. The labels that
#: countries set aside for kinds of registrants.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "govt", "ltd", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch")
TWO_LABELS = f"^({'|'.join(SECOND_LEVEL)})[.][a-z][a-z]$"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def suffix_of(host: Column) -> Column:
    last_two = F.substring_index(host, ".", -2)
    return F.when(last_two.rlike(TWO_LABELS), last_two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    last_two = F.substring_index(host, ".", -2)
    return F.when(last_two.rlike(TWO_LABELS), F.substring_index(host, ".", -3)).otherwise(last_two)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, text in sorted(rules, key=lambda r: len(r[1])):
        rule_host, slash, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(slash + rule_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(name)).otherwise(verdict)
    return rule, verdict


def parsed(pages: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url").cast("string"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, n, bad): labelled pages and bad ones. pages: host, path."""
    number = F.regexp_extract("path", r"([0-9]{1,18})[^0-9]*$", 1)
    named = pages.select("host", F.when(number != "", number.cast("long")).alias("doc_id"))
    counted = named.where("doc_id is not null").groupBy("host", "doc_id").agg(F.count("*").alias("n"))
    bad = F.max(((F.col("quality") == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).cast("int"))
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    joined = counted.join(known.agg(bad.alias("is_bad")), "doc_id")
    return joined.groupBy("host").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("is_bad")).alias("bad"))


def _pull(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """One row (pull): how many pages the prior of a child counts for."""
    share = F.col("pbad") / F.col("pn")
    noise = share * (1 - share)
    joined = children.join(parents.select(key, F.col("n").alias("pn"), F.col("bad").alias("pbad")), key)
    spread = F.sum(F.col("n") * (F.col("bad") / F.col("n") - share) * (F.col("bad") / F.col("n") - share))
    rho = (spread - F.sum(noise)) / F.nullif(F.sum(noise * (F.col("n") - 1)), F.lit(0.0))
    rho = F.greatest(F.lit(LEAST_RHO), F.least(F.lit(MOST_RHO), F.coalesce(rho, F.lit(LEAST_RHO))))
    return joined.agg((1 / rho - 1).alias("pull"))


def reputation(counts: DataFrame, hosts: DataFrame, max_bad: float = MAX_BAD, sure: float = SURE) -> DataFrame:
    """(host, bad_share, bad_bound, verdict) for every host of `hosts`.

    counts: (host, n, bad). What is joined here has one row per host, domain or suffix.
    """
    counts = counts.select(
        "host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "bad", F.lit(1).alias("all")
    )
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts_n = stored(counts, "hosts")
    domains_n = stored(hosts_n.groupBy("domain", "suffix", "all").agg(*sums), "domains")
    suffixes_n = domains_n.groupBy("suffix", "all").agg(*sums)
    total = suffixes_n.groupBy("all").agg(*sums)
    # four numbers, whatever the size of the tables
    host_pull = _pull(hosts_n, domains_n, "domain").first()[0]
    domain_pull = _pull(domains_n, suffixes_n, "suffix").first()[0]
    suffix_pull = _pull(suffixes_n, total, "all").first()[0]
    share = total.agg(F.sum("bad") / F.sum("n")).first()[0] or 0.0

    def mean(pull: float, prior: Column) -> Column:
        return (F.coalesce("bad", F.lit(0)) + F.lit(pull) * prior) / (F.coalesce("n", F.lit(0)) + F.lit(pull))

    suffix_mean = suffixes_n.select("suffix", mean(suffix_pull, F.lit(share)).alias("suffix_mean"))
    domain_mean = domains_n.join(suffix_mean, "suffix").select("domain", mean(domain_pull, F.col("suffix_mean")).alias("domain_mean"))
    named = hosts.select("host").distinct()
    named = named.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    named = named.join(hosts_n.select("host", "n", "bad"), "host", "left").join(domain_mean, "domain", "left")
    named = named.join(suffix_mean, "suffix", "left")
    prior = F.coalesce("domain_mean", "suffix_mean", F.lit(share))
    out = named.select(
        "host", mean(host_pull, prior).alias("bad_share"), (F.coalesce("n", F.lit(0)) + F.lit(host_pull)).alias("weight")
    )
    bound = F.col("bad_share") - F.lit(sure) * F.sqrt(F.col("bad_share") * (1 - F.col("bad_share")) / (F.col("weight") + 1))
    out = out.select("host", "bad_share", bound.alias("bad_bound"))
    return out.withColumn("verdict", F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, max_bad: float = MAX_BAD) -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block) of every page."""
    own = stored(parsed(pages), "urls")
    judged = stored(reputation(outcomes(own, labels), own, max_bad).select("host", F.col("verdict").alias("reputed")), "reputation")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    out = own.join(judged, "host")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "reputed").alias("verdict"))


def _rule_sql() -> str:
    cases = []
    for name, text in sorted(RULES, key=lambda r: -len(r[1])):
        host, _, path = text.partition("/")
        cases.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')", text, name))
    rule = " ".join(f"WHEN {c} THEN '{t}'" for c, t, _ in cases)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in cases)
    return f"CASE {rule} END AS rule, CASE {verdict} ELSE reputed END AS verdict"


def _pull_sql(children: str, parents: str, key: str) -> str:
    return f"""(
      SELECT 1 / greatest({LEAST_RHO}, least({MOST_RHO}, coalesce(
        (sum(c.n * (c.bad / c.n - p.bad / p.n) ** 2) - sum(p.bad / p.n * (1 - p.bad / p.n)))
        / nullif(sum(p.bad / p.n * (1 - p.bad / p.n) * (c.n - 1)), 0), {LEAST_RHO}))) - 1
      FROM {children} c JOIN {parents} p ON c.{key} = p.{key})"""


def _labels_sql(host: str, n: int) -> str:
    return f"array_to_string(string_split({host}, '.')[-{n}:], '.')"


def _suffix_sql(host: str) -> str:
    return f"CASE WHEN regexp_matches({_labels_sql(host, 2)}, '{TWO_LABELS}') THEN {_labels_sql(host, 2)} ELSE {_labels_sql(host, 1)} END"


def _domain_sql(host: str) -> str:
    return f"CASE WHEN regexp_matches({_labels_sql(host, 2)}, '{TWO_LABELS}') THEN {_labels_sql(host, 3)} ELSE {_labels_sql(host, 2)} END"


#: The same in SQL.
HOST_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), urls AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS is_bad
  FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), hosts AS (
  SELECT host, {_suffix_sql("host")} AS suffix, {_domain_sql("host")} AS domain, 1 AS every,
    count(*)::DOUBLE AS n, sum(is_bad)::DOUBLE AS bad
  FROM urls JOIN known ON known.doc_id = try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS BIGINT)
  GROUP BY ALL
), domains AS (
  SELECT domain, suffix, every, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL
), suffixes AS (
  SELECT suffix, every, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL
), total AS (
  SELECT every, sum(n) AS n, sum(bad) AS bad FROM suffixes GROUP BY ALL
), pulls AS (
  SELECT {_pull_sql("hosts", "domains", "domain")} AS h, {_pull_sql("domains", "suffixes", "suffix")} AS d,
    {_pull_sql("suffixes", "total", "every")} AS s, coalesce((SELECT bad / n FROM total), 0) AS share
), suffix_means AS (
  SELECT suffix, (bad + s * share) / (n + s) AS m FROM suffixes, pulls
), domain_means AS (
  SELECT domain, (bad + d * m) / (n + d) AS m FROM domains JOIN suffix_means USING (suffix), pulls
), judged AS (
  SELECT u.host, coalesce(hosts.n, 0) + h AS weight,
    (coalesce(bad, 0) + h * coalesce(dm.m, sm.m, share)) / (coalesce(n, 0) + h) AS p
  FROM (SELECT DISTINCT host FROM urls) u CROSS JOIN pulls
  LEFT JOIN hosts ON hosts.host = u.host
  LEFT JOIN domain_means dm ON dm.domain = {_domain_sql("u.host")}
  LEFT JOIN suffix_means sm ON sm.suffix = {_suffix_sql("u.host")}
), reputed AS (
  SELECT host, CASE WHEN p - {SURE} * sqrt(p * (1 - p) / (weight + 1)) > {MAX_BAD} THEN 'block' ELSE 'allow' END AS reputed
  FROM judged
)
SELECT page_id, host, path, {_rule_sql()}
FROM urls JOIN reputed USING (host)
"""
