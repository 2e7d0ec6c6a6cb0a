"""URL filtering: rules first, then empirical-Bayes reputation of the host.

Labelled outcomes are counted per host. Rates shrink from the host to its registered domain, from there to its suffix and to the whole;
how strongly is estimated at each level from the spread of its members' rates (a beta-binomial by moments). A host is blocked when
even the lower posterior bound of its rate of bad pages is above a limit.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from vitrina.llm.base import stored

# A host is blocked if its rate of bad pages is above this ...
LIMIT = 0.5
# ... with this many posterior standard deviations to spare.
DEVIATIONS = 1.645
# Suffixes of more than one label that count as one, besides every last label.
SUFFIXES = ("co.uk", "ac.uk", "org.uk", "com.au", "co.jp", "com.br")
BROADCAST_HOSTS = 100_000


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; empty without ``://`` and for null."""
    return F.coalesce(_lower(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct ``(rule, verdict)``, or null; a rule fits its host and all subdomains."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), r.host, r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def suffix_of(host: Column) -> Column:
    """Public suffix: the last two labels if they are listed, else the last label; without user, port and final dot."""
    bare = F.regexp_replace(host, r"^.*@|:[0-9]*$|\.$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(bare, ".", -1))


def domain_of(host: Column) -> Column:
    """Registered domain: the suffix and the label before it."""
    bare = F.regexp_replace(host, r"^.*@|:[0-9]*$|\.$", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(two.isin(*SUFFIXES), F.substring_index(bare, ".", -3)).otherwise(two)


def _strength(members: DataFrame) -> float:
    """Prior observations that the spread of rates ``bad / n`` around their parents' ``mean`` speaks for, between 1 and 1,000."""
    n, p, m = F.col("n"), F.col("bad") / F.col("n"), F.col("mean")
    k, total, squares, spread = members.filter("n > 0").agg(
        F.count("*"), F.sum(n), F.sum(n * n), F.sum(n * (p - m) * (p - m) / (m * (1 - m)))).first()
    if not k:
        return 1.0
    free = total - squares / total - (k - 1)
    rho = (spread - (k - 1)) / free if free > 0 else 0.0
    return 1 / min(max(rho, 1 / 1001), 0.5) - 1


def host_reputation(pages: DataFrame, url: str, bad: str) -> DataFrame:
    """``(host, n, bad, rate, bound)`` of every host: labelled pages, bad ones, posterior mean and lower bound of its bad rate.

    ``bad`` is null for pages without a label. Hosts are counted with partial sums, so a hot one is one row early.
    """
    hosts = pages.groupBy(url_host(F.col(url)).alias("host")).agg(
        F.count(bad).alias("n"), F.coalesce(F.sum(F.col(bad).cast("long")), F.lit(0)).alias("bad"))
    hosts = stored(hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "hosts")
    domains = stored(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = stored(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    n, b = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    overall = (b + 1) / (n + 2)

    def shrunk(members: DataFrame) -> tuple[DataFrame, float]:
        strength = _strength(members)
        return members.withColumn("rate", (F.col("bad") + strength * F.col("mean")) / (F.col("n") + strength)), strength

    suffixes, _ = shrunk(suffixes.withColumn("mean", F.lit(overall)))
    domains, _ = shrunk(domains.join(suffixes.select("suffix", F.col("rate").alias("mean")), "suffix"))
    hosts, strength = shrunk(hosts.join(domains.select("suffix", "domain", F.col("rate").alias("mean")), ["suffix", "domain"]))
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + strength + 1))
    return hosts.select("host", "n", "bad", "rate", (F.col("rate") - DEVIATIONS * deviation).alias("bound"))


def judge(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", bad: str = "bad", limit: float = LIMIT) -> DataFrame:
    """``(key, host, path, rule, verdict)`` of every page; ``verdict`` is the longest fitting rule's, else the reputation's.

    A null url, or one without ``://``, has an empty host, which is judged like any other. Repeated rows are judged alike and count
    each; an empty table gives no rows; columns other than ``key``, ``url`` and ``bad`` play no part.
    """
    scores = stored(host_reputation(pages, url, bad).select(F.col("host").alias("host_"), "bound"), "reputation")
    if scores.count() <= BROADCAST_HOSTS:
        scores = F.broadcast(scores)
    rows = pages.select(F.col(key), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    rows = rows.withColumn("r", matching_rule(F.col("host"), F.col("path"), rules)).join(scores, F.col("host") == F.col("host_"))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("bound") > limit, "block").otherwise("allow"))
    return rows.select(key, "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))
