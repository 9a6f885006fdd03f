"""URL filters with column functions only: listed rules, and empirical-Bayes reputation of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Host, path, verdict.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
# Suffixes of two labels below which names are registered; any other suffix is the last label.
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "com.cn", "co.za")
BLOCK_ABOVE = 0.5  # a host is blocked if its share of bad pages is above this
Z = 1.645  # by a bound of so many standard deviations
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    found = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest rule that fits as struct (rule, verdict), or null. Equally long rules: the first given.

    A rule fits its host and everything below it if the path starts with its path.
    """
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for name, start, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1]))[::-1]:
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def suffix(host: Column) -> Column:
    last = F.substring_index(host, ".", -2)
    return F.when(last.isin(*TWO_LABELS), last).otherwise(F.substring_index(host, ".", -1))


def registered(host: Column) -> Column:
    """The suffix and one label more."""
    last = F.substring_index(host, ".", -2)
    return F.when(last.isin(*TWO_LABELS), F.substring_index(host, ".", -3)).otherwise(last)


def _strength(children: DataFrame) -> float:
    """How many pages the parent's rate counts for, by the moments of a beta-binomial.

    ``children`` have n, k and the parent's rate m. The more the children differ
    beyond chance, the less the parent says. Between 1 and 1000; 1 if no child
    has two pages.
    """
    n, k, m = (F.col(c).cast("double") for c in ("n", "k", "m"))
    row = children.agg(
        F.sum((k - n * m) * (k - n * m)).alias("seen"),
        F.sum(n * m * (1 - m)).alias("chance"),
        F.sum(n * (n - 1) * m * (1 - m)).alias("pairs"),
    ).first()
    if not row.pairs:
        return 1.0
    within = (row.seen - row.chance) / row.pairs
    return min(1000.0, max(1.0, 1 / within - 1)) if within > 0 else 1000.0


def reputation(pages: DataFrame, bad_col: str, host_col: str = "host") -> DataFrame:
    """One row per host: n, k (labelled and bad pages), mean, low (posterior bound of its share of bad pages).

    ``bad_col`` is 1, 0 or null (no label). Counts are summed on the map side, so
    a host with any share of the rows is one row per task. A host's prior is its
    registered domain's posterior rate, whose prior is its suffix's, whose prior
    is that of all pages; three strengths come to the driver, nothing else. Hosts
    without labels get their domain's rate.
    """
    hosts = pages.groupBy(F.col(host_col).alias("host")).agg(
        F.count(bad_col).cast("long").alias("n"), F.coalesce(F.sum(F.col(bad_col)), F.lit(0)).cast("long").alias("k")
    )
    hosts = hosts.withColumn("domain", registered(F.col("host"))).withColumn("suffix", suffix(F.col("host")))
    add = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = hosts.groupBy("domain", "suffix").agg(*add)
    suffixes = domains.groupBy("suffix").agg(*add)
    total = suffixes.agg(*add).first()
    rate = ((total.k or 0) + 1) / ((total.n or 0) + 2)
    shrunk = lambda s: (F.col("k") + s * F.col("m")) / (F.col("n") + s)
    suffixes = suffixes.withColumn("m", F.lit(rate))
    suffixes = suffixes.select("suffix", shrunk(F.lit(_strength(suffixes))).alias("m"))
    domains = domains.join(suffixes, "suffix")
    domains = domains.select("domain", shrunk(F.lit(_strength(domains))).alias("m"))
    hosts = hosts.select("host", "domain", "n", "k").join(domains, "domain")
    strength = F.lit(_strength(hosts))
    a, size = F.col("k") + strength * F.col("m"), F.col("n") + strength
    mean = a / size
    spread = F.sqrt(mean * (1 - mean) / (size + 1))
    return hosts.select("host", "n", "k", mean.alias("mean"), (mean - F.lit(Z) * spread).alias("low"))


def judge(
    pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", url_col: str = "url",
    outcome_id: str = "doc_id", bad: Column | None = None, rules: tuple[tuple[str, str, str], ...] = RULES,
    limit: float = BLOCK_ABOVE,
) -> DataFrame:
    """One row per page: ``page_id``, host, path, rule, verdict, mean, low.

    The longest fitting rule decides; else a page is blocked if its host's lower
    posterior bound is above ``limit``. ``outcomes`` are labels of pages by id; of
    repeated labels a bad one counts. Null urls have empty host and path and are
    judged as one host; null ids have no label; repeated pages are rows of their
    own and count as such; without any label nothing is blocked but by rules.
    """
    bad = F.col("bad") if bad is None else bad
    labels = outcomes.where(F.col(outcome_id).isNotNull()).groupBy(F.col(outcome_id).alias("page"))
    labels = labels.agg(F.max(bad.cast("int")).alias("bad"))
    url = F.col(url_col)
    pages = pages.select(F.col(page_id).alias("page"), host(url).alias("host"), path(url).alias("path"))
    hosts = reputation(pages.join(labels, "page", "left"), "bad").select("host", "mean", "low")
    judged = pages.join(hosts, "host").withColumn("by", rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("low") > limit, "block").otherwise("allow")
    return judged.select(
        F.col("page").alias(page_id), "host", "path", F.col("by.rule").alias("rule"),
        F.coalesce("by.verdict", own).alias("verdict"), "mean", "low",
    )
