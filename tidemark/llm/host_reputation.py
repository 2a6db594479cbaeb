"""Host reputation of urls: labelled outcomes shrunk through beta-binomial priors, from host to
registered domain to public suffix, and a filter by a bound of the posterior.

Only counts per host, domain and suffix are shuffled, made in map tasks first. A host with a
third of all pages is one row. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHARED_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "example.com", "example.net", "example.org")


def host_of(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), *LOWER)


def path_of(url: str = "url") -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: str, shared: Sequence[str] = SHARED_SUFFIXES) -> Column:
    """The public suffix of a host: a listed one of two labels, else the last label."""
    two = F.substring_index(F.col(host), ".", -2)
    return F.when(two.isin(*shared), two).otherwise(F.substring_index(F.col(host), ".", -1))


def domain_of(host: str, suffix: str) -> Column:
    """The suffix and one label more (the host itself, if it has no more)."""
    deep = F.substring_index(F.col(host), ".", -3)
    return F.when(F.instr(F.col(suffix), ".") > 0, deep).otherwise(F.substring_index(F.col(host), ".", -2))


def _strength(frame: DataFrame, group: str, mean: str) -> DataFrame:
    """Per ``group``: the prior's strength by moments. With rates p of n pages around the group's mean m,
    the intra-class correlation is r = (sum n (p - m)^2 - (k - 1) m (1 - m)) / ((N - sum n^2 / N - k + 1) m (1 - m)),
    and the strength 1 / r - 1, kept within 1 and 1000."""
    p = F.col("bad") / F.col("n")
    k, total, m = F.count("*"), F.sum("n"), F.first(mean)
    between = F.sum(F.col("n") * (p - F.col(mean)) * (p - F.col(mean)))
    within = m * (1 - m)
    icc = F.try_divide(between - (k - 1) * within, (total - F.sum(F.col("n") * F.col("n")) / total - k + 1) * within)
    strength = F.when((icc > 0) & (icc < 1), F.greatest(F.lit(1.0), F.least(F.lit(1000.0), 1 / icc - 1))).otherwise(1000.0)
    return frame.filter("n > 0").groupBy(group).agg(F.coalesce(strength, F.lit(1000.0)).alias("strength"))


def reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """Per host of ``outcomes`` (host, bad 0 or 1 or null): domain, suffix, n and bad labelled pages, the
    posterior (mean, sd) of the share of bad pages, and ``bound``, its lower bound at ``z``.

    Each level's posterior mean is the prior mean of the next: all pages, suffix, domain,
    host. Hosts without labelled pages have their domain's, a domain without any its suffix's. Without any
    label the share is a half and the bound 0 or more, so that nothing is known to be bad.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = hosts.withColumn("suffix", suffix_of("host")).withColumn("domain", domain_of("host", "suffix"))
    add = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = hosts.groupBy("suffix", "domain").agg(*add)
    suffixes = domains.groupBy("suffix").agg(*add)
    share = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("share")).scalar()
    top = suffixes.withColumn("share", share).withColumn("all", F.lit(1))
    top = top.withColumn("strength", _strength(top, "all", "share").select("strength").scalar())
    shrunk = lambda prior: (F.col("bad") + F.coalesce("strength", F.lit(1000.0)) * F.col(prior)) / (F.col("n") + F.coalesce("strength", F.lit(1000.0)))
    suffix_level = top.select("suffix", shrunk("share").alias("suffix_share"))
    domain_in = domains.join(suffix_level, "suffix")
    domain_level = domain_in.join(_strength(domain_in, "suffix", "suffix_share"), "suffix", "left").select(
        "domain", "suffix", shrunk("suffix_share").alias("domain_share")
    )
    host_in = hosts.join(domain_level.drop("suffix"), "domain")
    # hosts of one domain are often few: how much they differ is estimated over the suffix
    final = host_in.join(_strength(host_in, "suffix", "domain_share"), "suffix", "left")
    strength = F.coalesce("strength", F.lit(1000.0))
    mean = shrunk("domain_share")
    sd = F.sqrt(mean * (1 - mean) / (F.col("n") + strength + 1))
    return final.select("host", "domain", "suffix", "n", "bad", mean.alias("mean"), sd.alias("sd"), (mean - z * sd).alias("bound"))


def _fits(rule_host: str, prefix: str) -> Column:
    host = F.col("host")
    return ((host == rule_host) | host.endswith("." + rule_host)) & F.col("path").startswith(prefix)


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str]],
    limit: float = 0.25,
    z: float = 1.645,
) -> DataFrame:
    """page_id, host, path, rule, verdict, bound of every row of ``pages`` (page_id, url).

    ``outcomes``: host and bad (0, 1, null) of pages that are labelled. ``rules``: (verdict, "host/path"),
    a short list; the longest that fits decides. Else a page is blocked if its host's bound is
    above ``limit``. Pages without a host are one host, the empty one. Repeated rows are judged alike.
    """
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    rule = F.coalesce(*[F.when(_fits(*split_rule(text)), F.lit(text)) for _, text in ordered], F.lit(None).cast("string"))
    by_rule = F.coalesce(*[F.when(F.col("rule") == text, F.lit(verdict)) for verdict, text in ordered], F.lit(None).cast("string"))
    placed = pages.select("page_id", host_of().alias("host"), path_of().alias("path")).withColumn("rule", rule)
    known = reputation(outcomes, z).select("host", "bound")
    judged = placed.join(known, "host", "left")
    method = F.when(F.coalesce("bound", F.lit(0.0)) > limit, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce(by_rule, method).alias("verdict"), F.round("bound", 6).alias("bound"))


def split_rule(text: str) -> tuple[str, str]:
    host, slash, path = text.partition("/")
    return host, slash + path
