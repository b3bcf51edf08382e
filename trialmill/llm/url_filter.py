"""URL filters: explicit rules, then empirical-Bayes reputation of hosts.

Outcomes of labelled pages (bad or not) are counted for each host, registered domain and suffix.
From the top down, each group's share of bad pages is shrunk to its parent's by a beta-binomial
prior, whose strength at each level comes from the spread between groups (method of moments). A
host is blocked if the lower bound of its posterior, mean minus ``z`` standard deviations, is over
``limit``. A host without labelled pages has its domain's, or its suffix's, prior as posterior.

An explicit rule is ``host/path``: it fits that host and all below it, where the path starts with
the rule's; the longest fitting rule decides (ties: the rule first in code-point order) and goes
before reputation.

Everything is built from grouped counts and joins on hosts; only addresses are read, not pages.
The table of hosts is broadcast only when a count shows it to be small.

Defined cases: a null address, or one without ``://``, has an empty host and path; an empty host has the
posterior of the global prior. Host names compare in lower case (A-Z only). Repeated rows are judged alike, each labelled
row counts. Without labels the prior is uninformed and nothing is blocked. An empty table gives an empty
result. An address of any length is read whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialmill.llm.common import shared_dir, store

BROADCAST_HOSTS = 50_000
#: Suffixes of more than one label, for hosts that registries sell below them: what is taken where a caller gives no list. Fixed values.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "co.nz", "com.br", "com.cn", "co.in", "co.za")
#: Strength of a prior: bounds, and what holds where the spread cannot be estimated.
STRENGTH_MIN, STRENGTH_MAX = 2.0, 200.0


def host_of(url: Column) -> Column:
    """Host: after the first :// up to /, ? or #, in lower case; empty without ://."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    found = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.when(at > 0, F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path_of(url: Column) -> Column:
    """Path: after the host up to ? or #; empty without ://."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as a struct (length, rule, verdict), or null. For lists that fit into a plan (up to about a thousand)."""
    best = F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):  # later ones win
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        best = F.when(fits, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def levels_of(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; user names and ports do not count.

    ``long_suffixes`` are the suffixes of two labels, such as a public list of suffixes has them (some thousands: the plan holds
    them as one set). All others have one label.
    """
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    labels = F.split(name, r"\.")
    two = F.substring_index(name, ".", -2)
    long = two.isin(*long_suffixes)
    suffix = F.when(long, two).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(long, F.substring_index(name, ".", -3)).otherwise(two)
    return F.when(F.size(labels) < 2, name).otherwise(domain), suffix


def _strength(groups: DataFrame, bad: str, n: str) -> DataFrame:
    """One row (strength): alpha + beta of the beta prior that explains the spread of shares between groups."""
    share = F.col(bad) / F.col(n)
    s = groups.filter(F.col(n) > 0).agg(
        F.count("*").alias("k"), F.sum(bad).cast("double").alias("b"), F.sum(n).cast("double").alias("t"), F.sum(F.lit(1.0) / F.col(n)).alias("inv"), F.avg(share).alias("m"),
        F.var_samp(share).alias("v"),
    )
    within = F.col("m") * (1 - F.col("m"))
    mean_inv = F.col("inv") / F.col("k")
    # E[v] = within * (mean_inv + (1 - mean_inv) / (strength + 1))
    between = F.col("v") / within - mean_inv
    raw = F.when((F.col("k") >= 2) & (within > 0) & (between > 0) & (mean_inv < 1), (1 - mean_inv) / between - 1)
    return s.select(F.least(F.greatest(F.coalesce(raw, F.lit(STRENGTH_MAX)), F.lit(STRENGTH_MIN)), F.lit(STRENGTH_MAX)).alias("strength"))


def reputation(outcomes: DataFrame, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """outcomes (host, bad) -> (hosts, domains, suffixes, global): posterior mean and strength of each group.

    The last has one row; each table has the columns mean, weight (alpha + beta) and its key.
    """
    domain, suffix = levels_of(F.col("host"), long_suffixes)
    hosts = outcomes.groupBy("host").agg(F.sum(F.col("bad").cast("long")).alias("bad"), F.count("*").alias("n"))
    hosts = store(hosts.filter("host != ''").withColumn("domain", domain).withColumn("suffix", suffix), f"{shared_dir(outcomes.sparkSession)}/hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    every = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("mean"))
    mean = every.first()["mean"]
    k_suffix, k_domain, k_host = (_strength(g, "bad", "n").first()["strength"] for g in (suffixes, domains, hosts))

    def shrunk(groups: DataFrame, parent: Column, k: float) -> DataFrame:
        return groups.withColumn("mean", (F.col("bad") + F.lit(k) * parent) / (F.col("n") + F.lit(k))).withColumn("weight", F.col("n") + F.lit(k))

    top = shrunk(suffixes, F.lit(mean), k_suffix).select("suffix", "mean", "weight")
    mid = shrunk(domains.join(top.select("suffix", F.col("mean").alias("parent")), "suffix"), F.col("parent"), k_domain)
    mid = mid.select("domain", "mean", "weight")
    low = shrunk(hosts.join(mid.select("domain", F.col("mean").alias("parent")), "domain"), F.col("parent"), k_host).select("host", "mean", "weight")
    prior = outcomes.sparkSession.range(1).select(F.lit(mean).alias("mean"), F.lit(k_suffix).alias("weight"))
    # A group without pages of its own keeps its parent's mean with its level's prior strength.
    mid = mid.withColumn("weight", F.lit(k_host))
    top = top.withColumn("weight", F.lit(k_domain))
    return low, mid, top, prior


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), limit: float = 0.5, z: float = 1.645,
    long_suffixes: Sequence[str] = LONG_SUFFIXES, id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """For each row of ``pages``: id, host, path, rule, verdict (allow or block), bound."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    low, mid, top, prior = reputation(outcomes, long_suffixes)
    p = prior.first()
    path = shared_dir(pages.sparkSession)
    domain, suffix = levels_of(F.col("host"), long_suffixes)
    named = rows.select("host").distinct().withColumn("domain", domain).withColumn("suffix", suffix)
    all_of = named
    for table, key in ((low, "host"), (mid, "domain"), (top, "suffix")):
        all_of = all_of.join(table.select(key, F.struct("mean", "weight").alias(f"of_{key}")), key, "left")
    best = F.coalesce("of_host", "of_domain", "of_suffix", F.struct(F.lit(p["mean"]).alias("mean"), F.lit(p["weight"]).alias("weight")))
    spread = F.sqrt(F.col("best.mean") * (1 - F.col("best.mean")) / (F.col("best.weight") + 1))
    bounds = store(all_of.select("host", best.alias("best")).select("host", (F.col("best.mean") - F.lit(z) * spread).alias("bound")), f"{path}/bounds")
    if bounds.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        bounds = F.broadcast(bounds)
    rule = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return (
        rows.join(bounds, "host").withColumn("__rule", rule)
        .select("id", "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce(F.col("__rule.verdict"), own).alias("verdict"), "bound")
    )
