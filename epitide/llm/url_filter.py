"""URL filter: rules first, else the reputation of the host from labelled page outcomes.

Outcomes (bad or not) are counted by host, registered domain and suffix. Each level shrinks to the one above by a
beta-binomial prior: its mean is the posterior mean of the parent, its strength comes from how much more the units of
that level differ than chance explains (analysis of variance; the same for every unit). A host is blocked if the lower
bound of its posterior, mean less Z deviations, is above LIMIT. A host without outcomes has its domain's prior.

A registered domain is the last two labels of a host, or three if the last has two letters and the one before is one of
SECOND_LEVEL; the suffix is what follows its first label. A null url, or one without "://", has the empty host and
path, and the empty host counts as a host. Repeated pages count as often as they stand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epitide.sources.scratch import materialise

Z, LIMIT = 1.645, 0.5
#: Bounds of a level's strength, in outcomes.
WEAKEST, STRONGEST = 1.0, 1000.0
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """`pages` with host and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")))


def _first_rule(rules, value) -> Column:
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):  # the longest is asked first
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def _levels(host: str) -> tuple[Column, Column]:
    labels = F.split(host, r"\.")
    wide = (F.length(F.get(labels, F.size(labels) - 1)) == 2) & F.get(labels, F.size(labels) - 2).isin(*SECOND_LEVEL)
    domain = F.substring_index(host, ".", -2)
    domain = F.when(wide, F.substring_index(host, ".", -3)).otherwise(domain)
    return domain, F.when(F.instr(domain, ".") > 0, F.expr("substring(domain, instr(domain, '.') + 1)")).otherwise(domain)


def _strength(units: DataFrame) -> tuple[float, float]:
    """Mean of all outcomes, and the strength of a prior for units (n, bad)."""
    p = F.col("bad") / F.col("n")
    r = units.where("n > 0").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * p * p).alias("npp"), F.sum(F.col("n") * p * (1 - p)).alias("within"),
    ).first()
    if not r["n"]:
        return 0.0, STRONGEST
    mean = r["bad"] / r["n"]
    if r["k"] < 2 or r["n"] <= r["k"]:
        return mean, WEAKEST
    between = max(0.0, r["npp"] - r["n"] * mean * mean) / (r["k"] - 1)
    inside = r["within"] / (r["n"] - r["k"])
    usual = (r["n"] - r["nn"] / r["n"]) / (r["k"] - 1)
    spread = between + (usual - 1) * inside
    rho = (between - inside) / spread if spread > 0 else 0.0
    return mean, min(STRONGEST, max(WEAKEST, 1 / rho - 1)) if rho > 0 else STRONGEST


def reputations(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """host, n, bad, mean, bound for each host of `pages` (page_id, host); outcomes: page_id, bad (0 or 1)."""
    one = outcomes.where(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = pages.select("page_id", "host").join(one, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    domain, suffix = _levels("host")
    hosts = materialise(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("bad").alias("db"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("db").alias("sb"))
    overall, s = _strength(suffixes.select(F.col("sn").alias("n"), F.col("sb").alias("bad")))
    _, d = _strength(domains.select(F.col("dn").alias("n"), F.col("db").alias("bad")))
    _, h = _strength(hosts)
    suffixes = suffixes.withColumn("sm", (F.col("sb") + s * overall) / (F.col("sn") + s)).select("suffix", "sm")
    domains = domains.join(suffixes, "suffix").withColumn("dm", (F.col("db") + d * F.col("sm")) / (F.col("dn") + d)).select("domain", "dm")
    a, b = F.col("bad") + h * F.col("dm"), F.col("n") - F.col("bad") + h * (1 - F.col("dm"))
    mean = a / (a + b)
    return hosts.join(domains, "domain").select("host", "n", "bad", mean.alias("mean"), (mean - Z * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("bound"))


def judged(pages: DataFrame, outcomes: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of `pages` (page_id, url), and the host's mean and bound."""
    pages = with_parts(pages.select("page_id", "url"))
    known = materialise(reputations(pages, outcomes).select("host", "mean", "bound"), "reputations")
    rows = pages.join(known, "host")
    return rows.select(
        "page_id", "host", "path", _first_rule(rules, lambda r: r.host + r.path).alias("rule"),
        F.coalesce(_first_rule(rules, lambda r: r.verdict), F.when(F.col("bound") > LIMIT, "block").otherwise("allow")).alias("verdict"), "mean", "bound",
    )
