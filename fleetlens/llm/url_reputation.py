"""URL filter: explicit rules first, else the reputation of the host by empirical Bayes.

Labelled page outcomes (good or not) are counted by host, registered domain and suffix. Each level is the prior of the next: a beta prior whose mean is the
posterior mean of the level above and whose strength is fitted to the spread among the children (method of moments for beta-binomial counts).
A host with few or no labels is so drawn to its domain, and that to its suffix. A page is allowed if the posterior's lower bound of its host's
share of good pages, mean - Z deviations, is at least LEAST. Hosts are aggregated before any join, and joins from pages and hosts are salted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import salted_join, stored

Z = 1.0
LEAST = 0.5
#: Bounds of a fitted strength, in pseudo-observations, and the strength where nothing can be fitted.
WEAKEST, STRONGEST, USUAL = 2.0, 1000.0, 10.0
#: Public suffixes of two labels; with all others, the suffix is the last label.
# Fixed values.
LONG_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.uk")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: str | Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), _PARTS, 1), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _PARTS, 2)


def rule_of(rules: list[Rule]) -> Column:
    """The longest rule that fits host and path, as struct(rule, verdict); null if none does. Of rules of equal length the first by name counts."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def with_domain(hosts: DataFrame) -> DataFrame:
    labels = F.split("host", r"\.")
    last_two = F.concat_ws(".", F.slice(labels, -2, 2))
    n = F.when(last_two.isin(*LONG_SUFFIXES), 2).otherwise(1)
    tail = lambda k: F.when(F.size(labels) > k, F.concat_ws(".", F.slice(labels, -k, k))).otherwise(F.col("host"))
    suffix = F.when(n == 2, tail(2)).otherwise(tail(1))
    domain = F.when(n == 2, tail(3)).otherwise(tail(2))
    return hosts.withColumn("suffix", suffix).withColumn("domain", domain)


def _moments() -> list[Column]:
    """Sums from which the moments of children (good of n each) follow."""
    share = F.col("good") / F.col("n")
    some = F.col("n") > 0
    return [F.sum(F.when(some, 1)).alias("k"), F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum(F.when(some, F.col("n") * share * share)).alias("sq"), F.sum(F.when(some, F.col("n") * F.col("n"))).alias("nn")]


def _fitted() -> Column:
    """Strength of the beta prior from the sums of _moments, by the method of moments for unequal sizes."""
    mean = F.col("good") / F.col("n")
    spread = F.col("sq") - F.col("n") * mean * mean
    room = F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1)
    rho = (spread - mean * (1 - mean) * (F.col("k") - 1)) / (mean * (1 - mean) * room)
    value = F.when(rho <= 0, STRONGEST).otherwise(F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), 1 / rho - 1)))
    return F.when((F.col("k") > 1) & (F.col("good") > 0) & (F.col("good") < F.col("n")) & (room > 0), value).otherwise(USUAL)


def reputation(outcomes: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, mean, low) of every different host of `hosts`, learned from outcomes (host, good 0 or 1). mean and low: posterior mean, lower bound.

    Outcomes with null good count as unlabelled, null hosts as empty. Without any label the prior is an even one (mean 0.5).
    """
    seen = outcomes.select(F.coalesce("host", F.lit("")).alias("host"), F.col("good").cast("double").alias("good")).filter("good IS NOT NULL")
    asked = hosts.select(F.coalesce("host", F.lit("")).alias("host"), F.lit(None).cast("double").alias("good"))
    counts = seen.union(asked).groupBy("host").agg(F.coalesce(F.sum("good"), F.lit(0.0)).alias("good"), F.count("good").cast("double").alias("n"))
    by_host = stored(with_domain(counts), "reputation-hosts")
    by_domain = by_host.groupBy("domain", "suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    # three rows: the strength fitted to all children of a level, and the overall mean
    levels = [df.select(F.lit(k).alias("level"), "good", "n") for k, df in (("host", by_host), ("domain", by_domain), ("suffix", by_suffix))]
    fitted = levels[0].union(levels[1]).union(levels[2]).groupBy("level").agg(*_moments()).select("level", "good", "n", _fitted().alias("strength"))
    fixed = {r["level"]: r for r in fitted.collect()}
    if not fixed:
        return by_host.select("host", F.lit(0.5).alias("mean"), F.lit(0.0).alias("low"))
    top = (fixed["suffix"]["good"] + 1) / (fixed["suffix"]["n"] + 2)
    shrunk = lambda mean, strength: (F.col("good") + mean * strength) / (F.col("n") + strength)
    suffixes = by_suffix.select("suffix", shrunk(F.lit(top), F.lit(fixed["suffix"]["strength"])).alias("suffix_mean"))
    domains = salted_join(by_domain, suffixes, ["suffix"], "domain").select("domain", shrunk(F.col("suffix_mean"), F.lit(fixed["domain"]["strength"])).alias("domain_mean"))
    a = F.col("good") + F.col("domain_mean") * fixed["host"]["strength"]
    b = F.col("n") - F.col("good") + (1 - F.col("domain_mean")) * fixed["host"]["strength"]
    mean = a / (a + b)
    return salted_join(by_host, domains, ["domain"], "host").select("host", mean.alias("mean"), (mean - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("low"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], least: float = LEAST) -> DataFrame:
    """page_id, host, path, rule, verdict, mean, low of every row of pages (page_id, url). outcomes: (url, good) of labelled pages."""
    rows = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    known = reputation(outcomes.select(host_of("url").alias("host"), "good"), rows.select("host").distinct())
    ruled = rows.withColumn("_rule", rule_of(rules)).withColumn("spread", F.xxhash64("page_id", "path"))
    both = salted_join(ruled, known, ["host"], "spread", "left")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("low") >= least, "allow").otherwise("block"))
    return both.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "mean", "low")
