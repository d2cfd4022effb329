"""URL filtering by rules and by empirical-Bayes host reputation, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: (verdict, rule): a host, and the path that a url's path must start with.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Suffixes of two labels under which names are registered; other suffixes are one label.
LONG_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "org.au", "org.uk")
#: A host is blocked if its share of bad pages is above this with about 95 % certainty.
BAD_SHARE, ERRORS = 0.25, 1.645
#: Bad part of the one page that is added to all outcomes, so that there is a share without any.
PRIOR_BAD = 0.05
#: Bounds of the correlation of outcomes inside a group, 1 / (1 + prior weight).
LEAST_CORRELATION, MOST_CORRELATION = 0.001, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, null if none does."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{rest}"))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def suffix_of(site: Column) -> Column:
    last_two = F.substring_index(site, ".", -2)
    return F.when(last_two.isin(*LONG_SUFFIXES), last_two).otherwise(F.substring_index(site, ".", -1))


def domain_of(site: Column) -> Column:
    """The registered domain: the suffix and one label more; an IPv4 address is its own domain."""
    labels = F.when(F.substring_index(site, ".", -2).isin(*LONG_SUFFIXES), F.substring_index(site, ".", -3)).otherwise(F.substring_index(site, ".", -2))
    return F.when(site.rlike(r"^[0-9.]+$"), site).otherwise(labels)


def _prior_weight(groups: DataFrame) -> float:
    """Weight of a level's beta prior from groups (n, bad, prior mean), by moments: how much more the groups differ from their priors than chance lets them."""
    n, m = F.col("n"), F.col("prior")
    spread = n * F.pow(F.col("bad") / n - m, 2) / (m * (1 - m))
    row = groups.where("n > 0").agg(F.sum(spread).alias("s"), F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(n * n).alias("n2")).first()
    if not row["g"] or row["g"] < 2:
        correlation = LEAST_CORRELATION
    else:
        room = row["n"] - row["n2"] / row["n"] - (row["g"] - 1)
        correlation = (row["s"] - (row["g"] - 1)) / room if room > 0 else LEAST_CORRELATION
    return 1 / min(MOST_CORRELATION, max(LEAST_CORRELATION, correlation)) - 1


def reputations(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Posterior of the share of bad pages for every host of ``pages`` (page_id, url), from ``outcomes`` (page_id, bad 0 or 1).

    Each suffix is shrunk to the share over all outcomes, each registered domain to its suffix
    and each host to its domain, by beta-binomial priors whose weights come from the levels'
    own spread. Returns site, n, bad, mean and low (the mean less ``ERRORS`` deviations).
    """
    site = F.regexp_replace(F.regexp_replace(host_of(F.col("url")), "^.*@", ""), ":[0-9]*$", "")
    known = outcomes.select(F.col("page_id").alias("id"), F.col("bad").cast("int").alias("bad")).where("bad in (0, 1) and id is not null")
    joined = pages.select(F.col("page_id").alias("id"), site.alias("site")).join(known, "id", "left").where("site <> ''")
    hosts = joined.groupBy("site").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = materialize(hosts.withColumns({"domain": domain_of(F.col("site")), "suffix": suffix_of(F.col("site"))}), "hosts")
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    whole = (total["bad"] + PRIOR_BAD) / (total["n"] + 1)

    def level(groups: DataFrame) -> DataFrame:
        weight = _prior_weight(groups)
        return groups.withColumn("weight", F.lit(weight)).withColumn("mean", (F.lit(weight) * F.col("prior") + F.col("bad")) / (F.lit(weight) + F.col("n")))

    count = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = level(hosts.groupBy("suffix").agg(*count).withColumn("prior", F.lit(whole)))
    domains = materialize(level(hosts.groupBy("domain", "suffix").agg(*count).join(suffixes.select("suffix", F.col("mean").alias("prior")), "suffix")), "domains")
    own = level(hosts.join(domains.select("domain", F.col("mean").alias("prior")), "domain"))
    a, b = F.col("weight") * F.col("prior") + F.col("bad"), F.col("weight") * (1 - F.col("prior")) + F.col("n") - F.col("bad")
    return own.select("site", "n", "bad", "mean", (F.col("mean") - ERRORS * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("low"))


def judged_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, bad_share: float = BAD_SHARE) -> DataFrame:
    """Host, path, fitting rule and verdict of every row of ``pages`` (page_id, url).

    The longest rule that fits decides; where none fits, a host whose share of bad pages is
    above ``bad_share`` by its lower posterior bound is blocked, any other allowed. The join
    with the hosts' table is one that Spark broadcasts if it is small and splits where a host
    holds very many pages.

    Cases: a null url, or one without ://, has empty host and path, fits no rule and is allowed;
    a host without outcomes is judged by its domain's; null page_ids are judged, but have no
    outcome; rows that repeat are judged each; several outcomes of a page count each; empty
    tables give no rows or the prior; other columns are not read.
    """
    verdicts = {rule: verdict for verdict, rule in rules}
    site = F.regexp_replace(F.regexp_replace(F.col("host"), "^.*@", ""), ":[0-9]*$", "")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("site", site)
    bad = reputations(pages, outcomes).where(F.col("low") > bad_share).select(F.col("site").alias("bad_site"))
    ruled = F.lit(None).cast("string")
    for rule, verdict in verdicts.items():
        ruled = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(ruled)
    found = rows.join(bad, F.col("site") == F.col("bad_site"), "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce(ruled, F.when(F.col("bad_site").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
