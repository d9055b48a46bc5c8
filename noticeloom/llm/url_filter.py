"""URL filters: explicit rules first, empirical-Bayes host reputation for the rest.

Labelled outcomes (1 good, 0 bad) are counted by host, registered domain and public suffix. For that a
host stands without user, port and last dot; suffixes are the last label, or the last two where a table
(a parameter) has them, and the domain is the label before; addresses of numbers are their own domain and
suffix. Each
level is a beta-binomial whose prior mean is the posterior mean of the level above: suffixes shrink
to the corpus mean, domains to their suffix, hosts to their domain. The strength of each level's
prior comes from the spread of the groups at that level (method of moments), within fixed bounds.
A page passes if the lower posterior bound of the most specific known level reaches a threshold.

Defined results: a null URL, or one without ``://``, has an empty host and path; it fits no rule
and is judged by the corpus prior. An empty table gives an empty result. Repeated rows are judged
row by row. Extra input columns are ignored. The lower bound is the posterior mean less some posterior
standard deviations, as functions of columns have no quantile of the beta distribution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.llm.common import stored

#: (verdict, host/path) as the contract of the query states them.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
# Public suffixes of two labels under which registrations are common; pass a whole list where there is one.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.za", "co.in", "co.il", "co.jp", "or.jp", "ne.jp", "co.kr",
    "com.ar", "com.br", "com.cn", "com.hk", "com.mx", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua",
)
#: Most hosts that are broadcast, some 100 bytes each.
BROADCAST_HOSTS = 100_000
#: Bounds of a prior's strength, in observations.
WEAKEST, STRONGEST = 2.0, 200.0
#: Lower bound: this many posterior standard deviations below the mean must reach the threshold.
DEVIATIONS, THRESHOLD = 1.0, 0.5


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def known_as(host: Column) -> Column:
    """A host without user, port and last dot, under which its outcomes are counted."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)\A.*@", ""), r"\.?(:[0-9]*)?\z", "")


def is_address(host: Column) -> Column:
    """Whether a host is an address of numbers."""
    return host.rlike(r"\A[0-9]+(\.[0-9]+){3}\z") | host.startswith("[")


def host_suffix(host: Column, suffixes=SUFFIXES) -> Column:
    """The public suffix: two labels if the table has them, else one."""
    two = F.substring_index(host, ".", -2)
    return F.when(is_address(host), host).when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def host_domain(host: Column, suffixes=SUFFIXES) -> Column:
    """The registered domain: the suffix and the label before it, where there is one."""
    two = F.substring_index(host, ".", -2)
    return F.when(is_address(host), host).when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as text; null if none does."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        rule_host, _, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(f"/{rule_path}")
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def rule_verdict(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for verdict, text in rules:
        out = F.when(rule == text, F.lit(verdict)).otherwise(out)
    return out


def _strength(prior: Column) -> Column:
    """Prior strength by the method of moments: for a beta-binomial, var(k/n) = p(1-p)(1/n + (1-1/n)/(m+1))."""
    p = F.least(F.greatest(prior, F.lit(0.01)), F.lit(0.99))
    spread = F.sum((F.col("good") - F.col("n") * p) * (F.col("good") - F.col("n") * p))
    within = F.sum(F.col("n") * p * (1 - p))
    extra = F.sum(F.col("n") * (F.col("n") - 1) * p * (1 - p))
    rho = (spread - within) / F.nullif(extra, F.lit(0))
    return F.when(rho > 0, F.least(F.greatest(1 / rho - 1, F.lit(WEAKEST)), F.lit(STRONGEST))).otherwise(F.lit(STRONGEST))


def host_reputation(outcomes: DataFrame, suffixes=SUFFIXES) -> tuple[float, DataFrame, DataFrame, DataFrame]:
    """Posterior means and sizes: of the corpus (a mean), by suffix, by domain and by host, from outcomes(host, good 0/1).

    Counts are taken at the hosts and rolled up from there, so one hot host is pre-aggregated
    before anything is shuffled by name."""
    hosts = (
        outcomes.where(F.col("good").isNotNull())
        .groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("good").cast("double")).alias("good"))
        .withColumn("domain", host_domain(F.col("host"), suffixes)).withColumn("suffix", host_suffix(F.col("host"), suffixes))
    )
    hosts = stored(hosts, "hosts")
    roll = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    domains, suffixes = roll(hosts, "domain", "suffix"), roll(hosts, "suffix")
    whole = hosts.agg(F.coalesce(F.sum("good"), F.lit(0.0)).alias("good"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n")).first()
    p0 = (whole["good"] + 1) / (whole["n"] + 2)

    def level(groups: DataFrame, prior: str) -> DataFrame:
        m = groups.agg(_strength(F.col(prior)).alias("m")).first()["m"]  # one number a level
        return groups.withColumn("p", (F.col("good") + m * F.col(prior)) / (F.col("n") + m)).withColumn("size", F.col("n") + m)

    s = level(suffixes.withColumn("p0", F.lit(p0)), "p0").select("suffix", F.col("p").alias("sp"), F.col("size").alias("ss"))
    d = level(domains.join(s, "suffix"), "sp").select("domain", F.col("p").alias("dp"), F.col("size").alias("ds"))
    h = level(hosts.join(d, "domain"), "dp").select("host", F.col("p").alias("hp"), F.col("size").alias("hs"))
    return p0, s, d, h


def lower_bound(p: Column, size: Column, deviations: float = DEVIATIONS) -> Column:
    """Mean less some standard deviations of the beta distribution with this mean and size."""
    return p - deviations * F.sqrt(p * (1 - p) / (size + 1))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, deviations: float = DEVIATIONS, threshold: float = THRESHOLD, suffixes=SUFFIXES) -> DataFrame:
    """pages(page_id, url) with host, path, rule, verdict, posterior_mean and lower_bound.

    outcomes(url, good): labelled page outcomes, 1 good and 0 bad. Rows of pages are judged through
    their distinct hosts: only those are joined with the reputations, then once with the pages. Judged hosts
    are a table of their own, broadcast if they are few; else a host with very many pages is joined in parts."""
    p0, s, d, h = host_reputation(outcomes.select(known_as(url_host(F.col("url"))).alias("host"), F.col("good")), suffixes)
    rows = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    hosts = rows.select(known_as(F.col("host")).alias("host")).distinct().select("host", host_domain(F.col("host"), suffixes).alias("domain"), host_suffix(F.col("host"), suffixes).alias("suffix"))
    judged = stored(
        hosts.join(h, "host", "left").join(d, "domain", "left").join(s, "suffix", "left")
        .withColumn("posterior_mean", F.coalesce("hp", "dp", "sp", F.lit(p0)))
        .withColumn("size", F.coalesce("hs", "ds", "ss", F.lit(WEAKEST)))
        .select(F.col("host").alias("known_as"), "posterior_mean", lower_bound(F.col("posterior_mean"), F.col("size"), deviations).alias("lower_bound")), "judged")
    few = judged.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    return (
        rows.join(F.broadcast(judged) if few else judged, known_as(F.col("host")) == F.col("known_as"), "left")
        .withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
        .withColumn("verdict", F.coalesce(rule_verdict(F.col("rule"), rules), F.when(F.col("lower_bound") >= threshold, "allow").otherwise("block")))
        .select("page_id", "host", "path", "rule", "verdict", "posterior_mean", "lower_bound")
    )


def ruled_outcomes(pages: DataFrame, rules=RULES) -> DataFrame:
    """Labelled outcomes from the rules: pages that an allow rule fits are good, blocked ones bad."""
    verdict = rule_verdict(rule_for(url_host(F.col("url")), url_path(F.col("url")), rules), rules)
    return pages.select("url", F.when(verdict == "allow", 1).when(verdict == "block", 0).alias("good")).where(F.col("good").isNotNull())
