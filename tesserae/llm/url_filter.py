"""URL filters: stated rules first, then the empirical-Bayes reputation of the host.

Labelled pages give outcomes (1: bad). The bad rate of a suffix is shrunk towards that of all pages, a registered domain's
towards its suffix's, a host's towards its domain's. At each level the strength of the prior is estimated from how much
more the rates of the children differ than chance would make them (beta-binomial, by moments). A url that no rule fits is
blocked if the lower bound of its host's posterior, the mean less z standard deviations, is above the limit.

Defined cases: a null url or one without "://" has host '' and path '', fits no rule and belongs to a host of its own
(''); without outcomes every posterior is the fallback rate's and all is allowed unless that is above the limit; null
outcomes don't count; an outcome counts as often as it stands, and once for each host of the pages with its id, however
often these are repeated; every repeated row of pages is judged; a page with several labels has several outcomes; hosts
without outcomes take their domain's or suffix's posterior; without pages there is no result; other columns are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import lower_ascii, staged

#: Suffixes of two labels under which names are registered (fixed values).
SECOND_LEVEL = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "com.cn", "com.mx")
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
LIMIT, Z, FALLBACK_RATE = 0.3, 1.6448536269514722, 0.05
#: Bounds of a prior's strength, in labelled pages.
WEAKEST, STRONGEST = 1.0, 1000.0


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*SECOND_LEVEL) & (two != host), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    three = F.substring_index(host, ".", -3)
    return F.when(F.substring_index(host, ".", -2).isin(*SECOND_LEVEL), three).otherwise(F.substring_index(host, ".", -2))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as (rule, verdict); of rules as long, the first by code point. For a short list of
    rules: it becomes one expression."""
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = lambda r: ((host == r[0]) | host.endswith("." + r[0])) & path.startswith(r[1])
    named = reduce(lambda c, r: c.when(fits(r), r[0] + r[1]), order, F.when(F.lit(False), None))
    said = reduce(lambda c, r: c.when(fits(r), r[2]), order, F.when(F.lit(False), None))
    return named.cast("string"), said.cast("string")


def strength() -> Column:
    """Aggregate: the prior's strength by the children's n, k and their parent's rate mu."""
    chance = F.col("mu") * (1 - F.col("mu"))
    over = F.sum((F.col("k") - F.col("n") * F.col("mu")) ** 2 - F.col("n") * chance)
    rho = F.try_divide(over, F.sum(F.col("n") * (F.col("n") - 1) * chance))
    return F.coalesce(F.when(rho > 0, F.least(F.greatest(1 / rho - 1, F.lit(WEAKEST)), F.lit(STRONGEST))), F.lit(STRONGEST))


def reputation(pages: DataFrame, outcomes: DataFrame, url: str = "url", key: str = "page_id", outcome_key: str = "page_id", outcome: str = "bad") -> DataFrame:
    """host, n and k of its outcomes, posterior mean and lower bound, for every host of pages."""
    labels = outcomes.select(F.col(outcome_key).alias("_key"), F.col(outcome).cast("int").alias("_bad")).where("_bad IS NOT NULL AND _key IS NOT NULL")
    of_page = labels.groupBy("_key").agg(F.count("*").alias("n"), F.sum("_bad").alias("k"))
    seen = pages.select(F.col(key).alias("_key"), host_of(F.col(url)).alias("host")).distinct().join(of_page, "_key", "left")
    hosts = seen.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    hosts = staged(hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    everything = hosts.agg(F.coalesce(F.sum("k") / F.nullif(F.sum("n"), F.lit(0)), F.lit(FALLBACK_RATE))).first()[0]

    def shrunk(children: DataFrame) -> DataFrame:
        """children, which have mu, their parent's rate, with m, the prior's strength, and rate, their own."""
        m = F.lit(children.agg(strength()).first()[0])
        return children.withColumns({"m": m, "rate": (F.col("k") + m * F.col("mu")) / (F.col("n") + m)})

    by_suffix = shrunk(suffixes.withColumn("mu", F.lit(everything))).select("suffix", F.col("rate").alias("mu"))
    by_domain = shrunk(domains.join(by_suffix, "suffix")).select("domain", F.col("rate").alias("mu"))
    last = shrunk(hosts.join(by_domain, "domain"))
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("m") + 1))
    return last.select("host", "n", "k", "rate", (F.col("rate") - Z * spread).alias("lower"))


def url_filter(pages: DataFrame, outcomes: DataFrame, url: str = "url", key: str = "page_id", outcome_key: str = "page_id", outcome: str = "bad", rules=RULES, limit: float = LIMIT) -> DataFrame:
    """key, host, path, rule and verdict of every row of pages."""
    known = reputation(pages, outcomes, url, key, outcome_key, outcome).select("host", (F.col("lower") > limit).alias("_blocked"))
    named, said = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumns({"rule": named, "_said": said})
    own = F.when(F.coalesce(F.col("_blocked"), F.lit(False)), "block").otherwise("allow")
    return judged.join(known, "host", "left").select(key, "host", "path", "rule", F.coalesce("_said", own).alias("verdict"))
