"""URL filters: rules first, then the reputation of hosts, shrunk from host to domain to suffix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import staged

# (host, path, verdict)
RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]
Z, LEAST = 1.645, 0.5  # a host is blocked if its share of good pages is below LEAST at Z standard deviations
WEAKEST, STRONGEST = 1.0, 1e6  # bounds of a prior's strength in pages
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], value: int | None) -> Column:
    """Of the longest rule that fits: its text (``value`` None) or verdict; else null."""
    out = F.lit(None).cast("string")
    for own in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == own[0]) | host.endswith("." + own[0])) & path.startswith(own[1])
        out = F.when(fits, F.lit(own[0] + own[1] if value is None else own[value])).otherwise(out)
    return out


def strength(level: DataFrame) -> Column:
    """Beta prior strength from the spread of the groups' shares (method of moments), within fixed bounds."""
    n, k, g = F.sum("n"), F.sum("good"), F.count(F.lit(1))
    p = F.try_divide(k, n)
    spread = F.sum(F.try_divide(F.col("good") * F.col("good"), F.col("n"))) - F.try_divide(k * k, n)
    noise = p * (1 - p)
    rho = F.try_divide(spread - noise * (g - 1),
                       noise * (n - F.try_divide(F.sum(F.col("n") * F.col("n")), n) - (g - 1)))
    return F.when((noise > 0) & (g > 1) & (rho > 0), F.greatest(F.lit(WEAKEST), F.least(
        F.lit(STRONGEST), F.try_divide(1 - rho, rho)))).otherwise(F.lit(STRONGEST))


def reputations(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, mean, upper) for every host of ``pages`` (page_id, host).

    A page's outcomes are the rows of ``labels`` with its id: good if quality is 1. The share of good pages of a
    suffix is shrunk towards that of all, a domain's towards its suffix's, a host's towards its domain's, each by a
    prior as strong as the spread between groups of that level allows. Hosts without outcomes get their domain's.
    """
    outcomes = labels.where("doc_id is not null and quality is not null").groupBy(
        F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("good"))
    hosts = (
        pages.join(outcomes, F.col("page_id") == F.col("_id"), "left").groupBy("host")
        .agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"))
        .withColumn("domain", F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0))
        .withColumn("suffix", F.regexp_extract("host", r"[^.]*$", 0))
    )
    hosts = staged(hosts, "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    known = F.col("n") > 0
    everything = suffixes.agg(F.try_divide(F.sum("good"), F.sum("n")).alias("p"), strength(suffixes).alias("k0"))
    by_domain = domains.where(known).agg(strength(domains).alias("k1"))
    by_host = hosts.where(known).agg(strength(hosts).alias("k2"))
    priors = everything.crossJoin(by_domain).crossJoin(by_host).first()  # three numbers and the mean
    p = F.lit(0.5 if priors.p is None else priors.p).cast("double")

    def shrunk(prior: Column, k: float) -> Column:
        return (F.col("good") + prior * k) / (F.col("n") + k)

    first = suffixes.select("suffix", shrunk(p, priors.k0).alias("m0"))
    second = domains.join(first, "suffix").select("domain", shrunk(F.col("m0"), priors.k1).alias("m1"))
    mean = shrunk(F.col("m1"), priors.k2)
    return hosts.join(second, "domain").select(
        "host", mean.alias("mean"),
        (mean + Z * F.sqrt(mean * (1 - mean) / (F.col("n") + priors.k2 + 1))).alias("upper"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
          least: float = LEAST) -> DataFrame:
    """(page_id, host, path, rule, verdict, reputation) for every row of ``pages``.

    A null url or one without ``://`` has an empty host and path; all such pages share one reputation. A null page_id
    has no outcomes; repeated rows are judged each; without labels every page that no rule fits is allowed.
    """
    parts = pages.select(F.col("page_id").cast("bigint"), host_of(F.col("url")).alias("host"),
                         path_of(F.col("url")).alias("path"))
    known = staged(reputations(parts.select("page_id", "host"), labels), "reputations")
    ruled = parts.withColumn("rule", first_rule(F.col("host"), F.col("path"), rules, None)).withColumn(
        "_verdict", first_rule(F.col("host"), F.col("path"), rules, 2))
    return ruled.join(known, "host").select(
        "page_id", "host", "path", "rule",
        F.coalesce("_verdict", F.when(F.col("upper") < least, "block").otherwise("allow")).alias("verdict"),
        F.col("mean").alias("reputation"))
