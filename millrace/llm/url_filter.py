"""URL filters: listed rules first, then the host's reputation.

Reputation is empirical Bayes: labelled outcomes of pages are shrunk through
beta-binomial priors from host to registered domain to suffix to all pages, with
a strength for each level that its own spread shows; a host is blocked if the
lower bound of its posterior share of bad pages, the quantile at the risk taken,
lies above what is tolerated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values of the query: (verdict, host and path).
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]

#: Bad share tolerated; chance that a blocked host is no worse than that.
TOLERATED, RISK = 0.5, 0.05


def url_host(url: Column) -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z lower-cased; else ''."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end; else ''."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null; of equally long ones the first."""
    found = []
    for _, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*found, F.lit(None).cast("string")) if found else F.lit(None).cast("string")


#: Labels that under a country's two letters are public suffixes.
_SECOND = "ac|co|com|edu|go|gov|mil|ne|net|or|org"
_TWO_PARTS = rf"(^|\.)({_SECOND})\.[a-z][a-z]$"
_ADDRESS = r"^(\[.*|[0-9.]+)$"
#: Points on either side of the tolerated share at which a posterior is summed, and
#: how many standard deviations (of the log odds) around its mode.
POINTS, REACH = 256, 20


def host_name(host: Column) -> Column:
    """host without user, port and final dot."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"(:[0-9]*)?$|\.(:[0-9]*)?$", "")


def suffix_of(name: Column) -> Column:
    """The public suffix: the last label, or two as in ``co.uk``; addresses are
    their own."""
    return F.when(name.rlike(_ADDRESS), name).when(name.rlike(_TWO_PARTS), F.regexp_extract(name, r"[^.]*\.[^.]*$", 0)).otherwise(F.regexp_extract(name, r"[^.]*$", 0))


def domain_of(name: Column) -> Column:
    """The registered domain: the suffix and the label before it."""
    two = F.regexp_extract(name, r"([^.]*\.)?[^.]*\.[^.]*$", 0)
    return F.when(name.rlike(_ADDRESS), name).when(name.rlike(_TWO_PARTS), two).otherwise(F.regexp_extract(name, r"([^.]*\.)?[^.]*$", 0))


def share_below(a: Column, b: Column, tolerated: float) -> Column:
    """The chance that a beta(a, b) share is at most ``tolerated``.

    The density of the log odds is smooth whatever a and b are; it is summed at
    middle points on both sides of the tolerated share's.
    """
    mode, width = F.log(a / b), REACH * F.sqrt(1 / a + 1 / (a * a) + 1 / b + 1 / (b * b))
    cut = F.least(F.greatest(F.lit(math.log(tolerated / (1 - tolerated))), mode - width), mode + width)
    log_density = lambda z: a * F.least(z, F.lit(0.0)) - b * F.greatest(z, F.lit(0.0)) - (a + b) * F.log1p(F.exp(-F.abs(z)))
    top = log_density(mode)

    def mass(low: Column, high: Column) -> Column:
        step = (high - low) / POINTS
        return step * F.aggregate(F.sequence(F.lit(0), F.lit(POINTS - 1)), F.lit(0.0), lambda s, i: s + F.exp(log_density(low + step * (i + 0.5)) - top))

    below, above = mass(mode - width, cut), mass(cut, mode + width)
    return below / (below + above)


def _shrunk(level: DataFrame, up: str, out: str) -> DataFrame:
    """Adds p_<out> and size_<out>, mean and pages' worth of the posterior of each
    row's (n, bad), from the parent's p_<up> and size_<up>.

    How far rows lie from their parents (method of moments) tells how many pages
    a parent's mean is worth at most; the parent's own uncertainty adds to that.
    """
    p, n, k = F.col(f"p_{up}"), F.col("n"), F.col("bad")
    spread = F.sum((k - n * p) * (k - n * p) - n * p * (1 - p)) / F.nullif(F.sum(n * (n - 1) * p * (1 - p)), F.lit(0.0))
    rho = F.least(F.greatest(F.coalesce(spread, F.lit(0.0)), F.lit(0.001)), F.lit(0.5))
    most = F.lit(level.agg((1 / rho - 1).alias("most")).first()[0])  # one number
    level = level.withColumn("strength", 1 / (1 / most + 1 / F.col(f"size_{up}")))
    return level.withColumns({f"p_{out}": (F.col("strength") * p + k) / (F.col("strength") + n), f"size_{out}": F.col("strength") + n})


def host_reputation(pages: DataFrame, labels: DataFrame, tolerated: float = TOLERATED, risk: float = RISK) -> DataFrame:
    """host, n, bad, mean, blocked for every host of ``pages`` (page_id, url).

    A page is bad if its label (doc_id = page_id) says quality 0 or toxic 1;
    of several labels the worst counts, null labels count as good.  A page that is
    there several times under one host counts once.  Hosts without labelled pages
    get what their domain and suffix tell.  ``blocked``: the posterior's quantile at
    ``risk`` lies above ``tolerated``, that is, the chance of a share up to it is
    below ``risk`` (then the mean is above (1 - risk) * tolerated: others need no sum).
    """
    worst = labels.select(
        F.col("doc_id").alias("page_id"),
        F.when((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1), 1).otherwise(0).alias("worst"),
    ).groupBy("page_id").agg(F.max("worst").alias("worst"))
    name = host_name(F.col("host"))
    hosts = (
        pages.select("page_id", url_host(F.col("url")).alias("host"))
        .distinct()
        .join(worst, "page_id", "left")
        .groupBy("host")
        .agg(F.count("worst").alias("n"), F.coalesce(F.sum("worst"), F.lit(0)).alias("bad"))
        .withColumns({"domain": domain_of(name), "suffix": suffix_of(name)})
    )
    hosts = written(hosts, "hosts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    total = hosts.agg(*sums).first()
    every = {"p_all": F.lit(((total["bad"] or 0) + 1) / ((total["n"] or 0) + 2)), "size_all": F.lit((total["n"] or 0) + 2.0)}
    suffixes = _shrunk(hosts.groupBy("suffix").agg(*sums).withColumns(every), "all", "suffix").select("suffix", "p_suffix", "size_suffix")
    domains = hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes, "suffix")
    domains = _shrunk(domains, "suffix", "domain").select("domain", "p_domain", "size_domain")
    known = _shrunk(hosts.join(domains, "domain"), "domain", "host")
    p, size = F.col("p_host"), F.col("size_host")
    sure = share_below(p * size, (1 - p) * size, tolerated) < risk
    blocked = F.when(p > (1 - risk) * tolerated, sure).otherwise(F.lit(False))
    return known.select("host", "n", "bad", p.alias("mean"), blocked.alias("blocked"))


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES, tolerated: float = TOLERATED, risk: float = RISK
) -> DataFrame:
    """page_id, host, path, rule, verdict, mean for every row of ``pages``.

    Null urls, and urls without ``://``, have empty host and path and are judged
    together as one host.  Repeated rows stay, and count once in reputations; empty
    tables give no rows.  Very long urls are read whole.  A host with a great part of
    all pages is split by the adaptive skew join.
    """
    verdicts = dict((rule, verdict) for verdict, rule in reversed(rules))
    rep = host_reputation(pages, labels, tolerated, risk).select("host", "mean", "blocked")
    judged = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).join(rep, "host", "left")
    listed = F.coalesce(*(F.when(F.col("rule") == r, F.lit(v)) for r, v in verdicts.items()), F.lit(None).cast("string"))
    method = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce(listed, method).alias("verdict"), "mean")


def _level_sql(source: str, up: str, out: str) -> str:
    p = f"p_{up}"
    return f"""SELECT *, (strength * {p} + bad) / (strength + n) AS p_{out}, strength + n AS size_{out} FROM (SELECT *, 1 / (1 / most + 1 / size_{up}) AS strength FROM {source}, (
        SELECT 1 / least(greatest(coalesce(sum((bad - n * {p}) * (bad - n * {p}) - n * {p} * (1 - {p})) / nullif(sum(n * (n - 1) * {p} * (1 - {p})), 0), 0.0), 0.001), 0.5) - 1 AS most FROM {source}))"""


def _mass_sql(low: str, high: str) -> str:
    z = f"({low} + ({high} - {low}) / {POINTS} * (i + 0.5))"
    return f"({high} - {low}) / {POINTS} * list_sum(list_transform(range({POINTS}), lambda i: exp(a * least({z}, 0) - b * greatest({z}, 0) - (a + b) * ln(1 + exp(-abs({z}))) - top)))"


_NAME_SQL = r"regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?$|\.(:[0-9]*)?$', '')"
ORACLE_SQL = f"""
WITH worst AS (SELECT doc_id AS page_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS worst FROM labels GROUP BY doc_id),
p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
hosts AS (SELECT host, count(worst) AS n, coalesce(sum(worst), 0)::BIGINT AS bad, {_NAME_SQL} AS name,
    CASE WHEN regexp_matches(name, '{_ADDRESS}') THEN name WHEN regexp_matches(name, '{_TWO_PARTS}') THEN regexp_extract(name, '([^.]*\\.)?[^.]*\\.[^.]*$') ELSE regexp_extract(name, '([^.]*\\.)?[^.]*$') END AS domain,
    CASE WHEN regexp_matches(name, '{_ADDRESS}') THEN name WHEN regexp_matches(name, '{_TWO_PARTS}') THEN regexp_extract(name, '[^.]*\\.[^.]*$') ELSE regexp_extract(name, '[^.]*$') END AS suffix
    FROM (SELECT DISTINCT page_id, host FROM p) LEFT JOIN worst USING (page_id) GROUP BY host),
overall AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS p_all, sum(n)::DOUBLE + 2 AS size_all FROM hosts),
s0 AS (SELECT * FROM (SELECT suffix, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM hosts GROUP BY suffix), overall),
s1 AS ({_level_sql("s0", "all", "suffix")}),
d0 AS (SELECT * FROM (SELECT domain, suffix, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM hosts GROUP BY domain, suffix) JOIN (SELECT suffix, p_suffix, size_suffix FROM s1) USING (suffix)),
d1 AS ({_level_sql("d0", "suffix", "domain")}),
h0 AS (SELECT host, n::DOUBLE AS n, bad::DOUBLE AS bad, p_domain, size_domain FROM hosts JOIN (SELECT domain, p_domain, size_domain FROM d1) USING (domain)),
h1 AS ({_level_sql("h0", "domain", "host")}),
q AS (SELECT host, p_host * size_host AS a, (1 - p_host) * size_host AS b, ln(a / b) AS mode, {REACH} * sqrt(1 / a + 1 / (a * a) + 1 / b + 1 / (b * b)) AS width,
    least(greatest({math.log(TOLERATED / (1 - TOLERATED))}, mode - width), mode + width) AS cut, a * least(mode, 0) - b * greatest(mode, 0) - (a + b) * ln(1 + exp(-abs(mode))) AS top FROM h1),
rep AS (SELECT host, below < {RISK} * (below + above) AS blocked FROM (SELECT host, {_mass_sql("(mode - width)", "cut")} AS below, {_mass_sql("cut", "(mode + width)")} AS above FROM q)),
r AS (SELECT p.*, CASE {" ".join(f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for _, r in sorted(RULES, key=lambda x: -len(x[1])))} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in RULES)} WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN rep USING (host)
"""
