"""URL filtering by rules and by empirical-Bayes reputation of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import outputs_over, written

#: (verdict, host, path start)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or none: empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (host and path together) that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for judged, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule), F.when(fits, F.lit(judged)).otherwise(verdict)
    return rule, verdict


def registered_domain(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def suffix(host: Column) -> Column:
    """The last label of a host."""
    return F.substring_index(host, ".", -1)


def _concentration(units: DataFrame, parent_mean: float) -> float:
    """Beta-binomial concentration of the units' good shares about their parents' mean, by moments, from 2 to 200."""
    spread = units.where("n > 0").agg(F.sum("n").alias("n"), F.count("*").alias("units"), F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - parent_mean, 2)).alias("ss"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    within = parent_mean * (1 - parent_mean)
    if not spread["n"] or spread["units"] < 2 or within <= 0:
        return 20.0
    excess = spread["ss"] - (spread["units"] - 1) * within
    shared = spread["n"] - spread["nn"] / spread["n"]
    between = max(excess, 0.0) / max(shared, 1e-9)
    rho = min(max(between / within, 1 / 201), 1 / 3)
    return 1 / rho - 1


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> tuple[DataFrame, DataFrame, DataFrame, float, float]:
    """Labelled outcomes (host, good boolean) -> tables of upper posterior bounds by host, domain and suffix, a bound for all others, and the mean of all.

    A level's good share is shrunk towards its parent: suffix to all pages, domain to suffix, host to
    domain. Each prior is a beta with the parent's posterior mean and a concentration fitted by moments
    of that level's beta-binomial counts. The bound is posterior mean + z standard deviations.
    Outcomes are summed by host once, before any join; null outcomes do not count.
    """
    hosts = outcomes.where("good is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"))
    hosts = written(hosts, "host-outcomes").withColumns({"domain": registered_domain(F.col("host")), "suffix": suffix(F.col("host"))})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = ((total["good"] or 0) + 1.0) / ((total["n"] or 0) + 2.0)

    def posterior(prior: Column, strength: float) -> Column:
        return (F.col("good") + prior * strength) / (F.col("n") + strength)

    def bound(strength: float) -> Column:
        m = F.col("mean")
        return m + z * F.sqrt(m * (1 - m) / (F.col("n") + strength + 1))

    k_suffix, k_domain, k_host = (_concentration(units, mean) for units in (suffixes, domains, hosts))
    suffix_table = suffixes.withColumn("mean", posterior(F.lit(mean), k_suffix)).select("suffix", F.col("mean").alias("suffix_mean"), bound(k_suffix).alias("suffix_bound"))
    domain_table = (
        domains.join(suffix_table, "suffix").withColumn("mean", posterior(F.col("suffix_mean"), k_domain)).select("domain", F.col("mean").alias("domain_mean"), bound(k_domain).alias("domain_bound"))
    )
    host_table = hosts.join(domain_table, "domain").withColumn("mean", posterior(F.col("domain_mean"), k_host)).select("host", F.col("mean").alias("host_mean"), bound(k_host).alias("host_bound"))
    top = mean + z * (mean * (1 - mean) / (20.0 + 1)) ** 0.5
    return host_table, domain_table, suffix_table, top, mean


def judge_urls(pages: DataFrame, outcomes: DataFrame, url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, least: float = 0.8, z: float = 1.645) -> DataFrame:
    """Every page with ``host``, ``path``, ``rule``, ``verdict`` and ``bound``.

    The longest fitting rule decides. Without one a page is blocked if the upper posterior bound of its
    host's good share is under ``least`` times the share of all labelled pages: when the evidence is clear
    that the host is worse than the corpus by a fifth or more, and not when it is only surely worse, as any
    host below the mean would be with enough pages. Hosts without labelled pages take the bound of their
    domain, else of their suffix, else of all pages, which is never under it. Distinct hosts are judged
    once and joined back by host; the join splits a hot host at run time. Null or odd urls have an empty
    host and path. Without outcomes all is allowed that no rule blocks. Columns of the output's names are
    replaced.
    """
    host_table, domain_table, suffix_table, top, mean = host_reputation(outcomes, z)
    packed = pages.select(F.struct("*").alias("row"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    hosts = packed.select("host").distinct()
    judged = (
        hosts.withColumns({"domain": registered_domain(F.col("host")), "suffix": suffix(F.col("host"))})
        .join(host_table, "host", "left")
        .join(domain_table, "domain", "left")
        .join(suffix_table, "suffix", "left")
        .select(F.col("host").alias("of"), F.coalesce("host_bound", "domain_bound", "suffix_bound", F.lit(top)).alias("bound"))
    )
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    found = packed.join(judged, F.col("host") == F.col("of")).select(
        "row", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bound") < least * mean, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "bound"
    )
    return outputs_over("row", found, ["host", "path", "rule", "verdict", "bound"])


def article_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, good) of each labelled page: good is quality 1 and not toxic.

    ``labels`` judges documents, not pages. That the number in a path names the document of the page is an
    assumption of this link, which the README states. Of repeated labels the worst counts; a label without
    any judgement, a null id or a path without a number gives no outcome.
    """
    number = F.expr("try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1), '') as bigint)")
    judged = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.when(F.col("quality").isNull() & F.col("toxic").isNull(), F.lit(None)).otherwise((F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0))).alias("good"))
    paths = pages.select(url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).select("host", number.alias("number"))
    return paths.join(judged, F.col("number") == F.col("doc_id")).select("host", "good")
