"""URL filter by empirical-Bayes host reputation, in DataFrame functions only.

Outcomes of labelled pages (bad or not) are counted per host, registered domain and public suffix. Each level's rate is shrunk by
a beta prior whose mean is the posterior mean of the level above and whose strength comes from the spread of the rates below it
(method of moments over the whole table): suffix from all pages, domain from suffix, host from domain. A host without labelled pages
takes the rate of its domain, else of its suffix, else of all. A host is blocked if the lower bound of its posterior rate is above the
threshold. Explicit rules come first: the longest rule that fits decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.shared import table


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


#: Verdict, host, path of the rules in force.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
#: Public suffixes of two labels.
TWO_PART = (
    "ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx", "com.sg", "com.tr",
    "com.tw", "edu.au", "gov.au", "gov.uk", "ne.jp", "net.au", "net.br", "or.jp", "org.au", "org.br", "org.uk", "sch.uk",
)
#: Strength (in pages) of a prior is kept between these; the bound is mean - Z standard deviations.
WEAKEST, STRONGEST, Z, THRESHOLD = 2.0, 200.0, 1.645, 0.5


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ://."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    cut = F.locate("://", text)
    rest = F.when(cut > 0, text.substr(cut + 3, F.length(text))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; ties go to the rule named first. Null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for r in reversed(sorted(rules, key=lambda r: -len(r.host + r.path))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.host + r.path)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


@dataclass(frozen=True)
class Reputation:
    """Posterior means by level, and the strength of a host's prior; tables grow with labelled hosts, the two numbers do not."""

    hosts: DataFrame  # host, n, bad, mean, strength
    domains: DataFrame  # domain, mean
    suffixes: DataFrame  # suffix, mean
    base: float
    host_strength: float


def _suffix(host: Column) -> Column:
    """The public suffix: two labels where the table of fixed values has them, else the last one."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_PART) & (host != two), two).otherwise(F.substring_index(host, ".", -1))


def _domain(host: Column) -> Column:
    """The registered domain: the public suffix and one label more."""
    return F.when(_suffix(host).contains("."), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _strength(rows: DataFrame) -> float:
    """rows: n, bad, centre. Prior strength by moments: how far rates spread around their centres beyond what binomial noise gives."""
    noise = F.col("centre") * (1 - F.col("centre"))
    got = rows.agg(F.sum(F.col("n") * (F.col("bad") / F.col("n") - F.col("centre")) ** 2).alias("s"), F.sum(noise).alias("e"), F.sum(F.col("n") * noise).alias("w")).first()
    if got.s is None:
        return WEAKEST
    strength = (got.w - got.e) / (got.s - got.e) - 1 if got.s > got.e else STRONGEST
    return max(WEAKEST, min(STRONGEST, strength))


def _shrunk(rows: DataFrame, strength: float) -> Column:
    return (F.col("bad") + F.lit(strength) * F.col("centre")) / (F.col("n") + F.lit(strength))


def reputations(outcomes: DataFrame) -> Reputation:
    """outcomes: host, bad (0 or 1), one row per labelled page. An empty table gives a base rate of one half and no hosts."""
    counted = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = table(counted.select("host", _domain(F.col("host")).alias("domain"), _suffix(F.col("host")).alias("suffix"), "n", "bad"), "hosts")
    every = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    base = ((every.bad or 0) + 1) / ((every.n or 0) + 2)
    total = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = hosts.groupBy("suffix").agg(*total).withColumn("centre", F.lit(base))
    suffixes = table(suffixes.select("suffix", _shrunk(suffixes, _strength(suffixes)).alias("mean")), "suffixes")
    domains = table(hosts.groupBy("domain", "suffix").agg(*total).join(suffixes.withColumnRenamed("mean", "centre"), "suffix"), "domains")
    domains = domains.select("domain", _shrunk(domains, _strength(domains)).alias("mean"))
    hosts = table(hosts.join(domains.withColumnRenamed("mean", "centre"), "domain"), "hosts")
    k = _strength(hosts)
    return Reputation(hosts.select("host", "n", "bad", _shrunk(hosts, k).alias("mean"), (F.col("n") + F.lit(k)).alias("strength")), domains, suffixes, base, k)


def bounds(hosts: DataFrame, r: Reputation) -> DataFrame:
    """hosts: host, one row each. Adds mean and bound of the posterior; a host without labelled pages has its domain's mean, else its suffix's, else that of all pages, at the strength of the prior."""
    asked = hosts.select("host", _domain(F.col("host")).alias("domain"), _suffix(F.col("host")).alias("suffix"))
    levels = [r.hosts.select("host", F.col("mean").alias("m_host"), "strength"), r.domains.withColumnRenamed("mean", "m_domain"), r.suffixes.withColumnRenamed("mean", "m_suffix")]
    for level in levels:
        asked = asked.join(level, level.columns[0], "left")
    mean, strength = F.coalesce("m_host", "m_domain", "m_suffix", F.lit(r.base)), F.coalesce("strength", F.lit(r.host_strength))
    return asked.select("host", mean.alias("mean"), (mean - Z * F.sqrt(mean * (1 - mean) / (strength + 1))).alias("bound"))


def judged(pages: DataFrame, labels: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """pages: page_id, url. labels: doc_id, quality, toxic; a url ends with the number of the document that its page shows.

    Returns page_id, host, path, rule, verdict, bound for every row. A labelled page is bad if its quality is 0 or it is toxic;
    several labels of a document count once (bad if any is); null labels are not bad. Where no rule fits, a page is blocked if the lower
    bound of its host's posterior is above the threshold. Null urls and urls without :// have an empty host and path, no bound, and are
    allowed. Repeated rows each get a row; an empty table of pages gives none; without labels every host has the bound of a rate of
    one half. Other columns of either table, whatever their names, are ignored.
    """
    host, path = parts(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("case when quality = 0 or toxic = 1 then 1 else 0 end")).alias("bad"))
    shown = seen.select("host", F.expr(r"try_cast(regexp_extract(path, '/([0-9]+)[^/0-9]*/?$', 1) as bigint)").alias("doc_id")).where("host <> '' and doc_id is not null")
    scores = bounds(seen.where("host <> ''").select("host").distinct(), reputations(shown.join(known, "doc_id").select("host", "bad")))
    name, verdict = matched(F.col("host"), F.col("path"), rules)
    return seen.join(scores.select("host", "bound"), "host", "left").select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("bound") > threshold, "block").otherwise("allow")).alias("verdict"), F.round("bound", 9).alias("bound")
    )
