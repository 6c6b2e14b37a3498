"""URL filtering: fixed rules first, then an empirical-Bayes reputation of hosts.

Labelled pages are outcomes (bad or not) of their hosts.  A host's rate of bad
pages has a beta prior whose mean is its registered domain's rate, which is
shrunk towards its suffix's, and that towards the rate of all.  The strength of
each level's prior comes from the data: the overdispersion of its members around
their parents (method of moments of the beta-binomial).  A host is blocked when
the lower bound of its posterior, z posterior deviations below the mean, lies
above the accepted rate.  Hosts are counted before any join; a host with a third
of all pages is one row of partial counts in each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import lower_ascii, materialize, table

#: (verdict, host and path); a rule fits its host and subdomains and every path with its own as prefix.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Public suffixes of more than one label; ``*.`` stands for any label, ``!`` marks an exception to such a rule.
SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "org.uk")
#: Bounds of a level's overdispersion: prior strengths from 999 down to 1.
RHO_LOW, RHO_HIGH = 0.001, 0.5


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased, and path; both empty for null and where there is no ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules, pick) -> Column:
    """pick(verdict, rule) of the longest rule that fits, else null; rules are a short list, compiled into the plan."""
    out = F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(pick(verdict, rule))).otherwise(out)
    return out


def _tail(host: Column, n: int | Column) -> Column:
    """The last n labels of a host, or all of them."""
    labels, n = F.split(host, r"\."), F.lit(n)
    return F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), n), ".")


def suffix_labels(host: Column, suffixes) -> Column:
    """How many labels the public suffix of a host has: those of the longest rule that fits, one less for an exception; one without a rule."""
    rules = [r.lower().strip(".") for r in suffixes]
    plain = [r for r in rules if r[:1] not in "*!"]
    wild, but = [r[2:] for r in rules if r.startswith("*.")], [r[1:] for r in rules if r.startswith("!")]
    size = F.size(F.split(host, r"\."))
    out = F.lit(1)
    for n in range(1, max((r.count(".") + 1 for r in rules), default=1) + 1):  # longer ones come last and count
        fits = F.lit(False)
        if mine := [r for r in plain if r.count(".") + 1 == n]:
            fits = fits | _tail(host, n).isin(*mine)
        if mine := [r for r in wild if r.count(".") + 2 == n]:
            fits = fits | _tail(host, n - 1).isin(*mine)
        out = F.when((size >= n) & fits, n).otherwise(out)
    for n in sorted({r.count(".") + 1 for r in but}):
        out = F.when((size >= n) & _tail(host, n).isin(*[r for r in but if r.count(".") + 1 == n]), n - 1).otherwise(out)
    return out


def _parents(hosts: DataFrame, suffixes) -> DataFrame:
    n = suffix_labels(F.col("host"), suffixes)
    return hosts.withColumns({"suffix": _tail(F.col("host"), n), "domain": _tail(F.col("host"), n + 1)})


def _strength(level: DataFrame) -> float:
    """The prior strength of a level with counts n, k around parents' rates m."""
    spread = F.col("n") * F.col("m") * (1 - F.col("m"))
    off, over = level.filter("n > 0").agg(F.sum(F.pow(F.col("k") - F.col("n") * F.col("m"), 2) - spread), F.sum((F.col("n") - 1) * spread)).first()
    rho = off / over if over else RHO_LOW
    return 1 / min(RHO_HIGH, max(RHO_LOW, rho)) - 1


def _shrunk(level: DataFrame, strength: float) -> DataFrame:
    return level.withColumn("mean", (F.col("k") + strength * F.col("m")) / (F.col("n") + strength))


def reputation(outcomes: DataFrame, z: float = 1.645, suffixes=SUFFIXES) -> DataFrame:
    """host, n, k, mean and bound for every host in outcomes (host, bad: 0, 1 or null for an unlabelled page)."""
    hosts = materialize(_parents(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k")), suffixes), "hosts")
    total, bad = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    suffixes = hosts.groupBy("suffix").agg(*sums).withColumn("m", F.lit((bad + 1) / (total + 2)))
    suffixes = _shrunk(suffixes, _strength(suffixes)).select("suffix", F.col("mean").alias("m"))
    domains = hosts.groupBy("suffix", "domain").agg(*sums).join(suffixes, "suffix")
    domains = _shrunk(domains, _strength(domains)).select("domain", F.col("mean").alias("m"))
    hosts = hosts.join(domains, "domain")
    strength = _strength(hosts)
    mean = F.col("mean")
    return _shrunk(hosts, strength).select(
        "host", "n", "k", "mean", (mean - z * F.sqrt(mean * (1 - mean) / (F.col("n") + strength + 1))).alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad: float = 0.3, z: float = 1.645, suffixes=SUFFIXES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate, bound of every row of pages.

    outcomes: (host, bad) of labelled pages; repeats count.  Null urls and urls
    without ``://`` have an empty host and path and the reputation of the empty
    host.  A host without outcomes inherits its domain's rate; suffixes are a list of
    rules of public suffixes, a short one compiled into the plan.  Repeated rows are
    judged alike; an empty table gives an empty result; no other columns are read.
    """
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    unseen = parts.select("host", F.lit(None).cast("int").alias("bad"))
    known = reputation(outcomes.select("host", F.col("bad").cast("int").alias("bad")).unionByName(unseen), z, suffixes)
    h, p = F.col("host"), F.col("path")
    ruled = parts.withColumns({"rule": rule_column(h, p, rules, lambda v, r: r), "_v": rule_column(h, p, rules, lambda v, r: v)})
    judged = F.when(F.col("bound") > max_bad, "block").otherwise("allow")
    return ruled.join(known, "host").select("page_id", "host", "path", "rule", F.coalesce("_v", judged).alias("verdict"), F.col("mean").alias("bad_rate"), "bound")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of pages whose document is labelled: the last number of a path names the document.

    A label without a quality and a toxicity, and null or other urls, give no outcome; a
    document with several labels is bad if one is; empty tables give an empty result.
    """
    host, path = url_parts(F.col("url"))
    shown = pages.select(host.alias("host"), F.regexp_extract(path, r"/(\d{1,18})(?:\.html)?/?$", 1).alias("d"))
    shown = shown.filter("d <> ''").select("host", F.col("d").cast("long").alias("doc_id"))
    bad = F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int"))
    known = labels.groupBy("doc_id").agg(F.max(bad).alias("bad")).filter("bad IS NOT NULL")
    return shown.join(known, "doc_id").select("host", "bad")


def op3_host_reputation(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, page_outcomes(pages, table(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
l AS (SELECT doc_id, max(greatest(CASE WHEN quality = 0 THEN 1 WHEN quality IS NOT NULL THEN 0 END, CASE WHEN toxic = 1 THEN 1 WHEN toxic IS NOT NULL THEN 0 END)) AS bad FROM labels GROUP BY 1),
o AS (SELECT host, TRY_CAST(NULLIF(regexp_extract(path, '/([0-9]{1,18})(?:\.html)?/?$', 1), '') AS BIGINT) AS doc_id FROM p),
b AS (SELECT host, bad FROM o JOIN l USING (doc_id) WHERE bad IS NOT NULL UNION ALL SELECT host, NULL FROM p),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k, string_split(host, '.') AS s FROM b GROUP BY host),
h1l AS (SELECT host, n, k, s, CASE WHEN array_to_string(s[-2:], '.') IN ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'com.cn', 'org.uk') THEN 2 ELSE 1 END AS w FROM h0),
h AS (SELECT host, n, k, array_to_string(s[-w:], '.') AS suffix, array_to_string(s[-w - 1:], '.') AS domain FROM h1l),
t AS (SELECT (sum(k) + 1) / (sum(n) + 2.0) AS m FROM h),
s1 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM h, t GROUP BY 1),
sr AS (SELECT 1 / least(0.5, greatest(0.001, coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / nullif(sum((n - 1) * n * m * (1 - m)), 0), 0.001))) - 1 AS g FROM s1 WHERE n > 0),
s2 AS (SELECT suffix, (k + g * m) / (n + g) AS m FROM s1, sr),
d1 AS (SELECT domain, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM h JOIN s2 USING (suffix) GROUP BY 1),
dr AS (SELECT 1 / least(0.5, greatest(0.001, coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / nullif(sum((n - 1) * n * m * (1 - m)), 0), 0.001))) - 1 AS g FROM d1 WHERE n > 0),
d2 AS (SELECT domain, (k + g * m) / (n + g) AS m FROM d1, dr),
h1 AS (SELECT host, n, k, m FROM h JOIN d2 USING (domain)),
hr AS (SELECT 1 / least(0.5, greatest(0.001, coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / nullif(sum((n - 1) * n * m * (1 - m)), 0), 0.001))) - 1 AS g FROM h1 WHERE n > 0),
h2 AS (SELECT host, n, g, (k + g * m) / (n + g) AS mean FROM h1, hr),
j AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (n + g + 1)) > 0.3 AS bad FROM h2),
r AS (SELECT page_id, host, path, CASE
        WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN bad THEN 'block' ELSE 'allow' END AS verdict FROM r JOIN j USING (host)
"""
