"""URL filter: explicit rules first, else an empirical-Bayes reputation of the host.

Outcomes of labelled pages are summed per host, registered domain and suffix. Each level's rate is shrunk towards the
posterior mean of the level above by a beta-binomial prior whose strength is estimated from the data (method of
moments), and a host passes if the lower bound of its posterior reaches a threshold. Everything is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmask.llm.common import attach, read, written

#: (verdict, host, path): fits the host and its subdomains where the path starts with `path`; the longest wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Suffixes of two labels under which names are registered (a short list; see with_domains for a whole table).
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "com.cn", "co.in", "co.kr", "com.mx", "com.tr", "co.za")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """From behind the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; '' for null or no `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; '' for null or no `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host + path, its verdict) of the longest rule that fits, nulls if none does. For rule lists that fit in a plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(name + prefix)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def domain_parts(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; the port is left out, a bare suffix is its own domain."""
    labels = F.split(F.regexp_replace(host, r":\d*$", ""), r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)), F.lit(n)), ".")
    two = last(2).isin(*TWO_LABEL_SUFFIXES)
    return F.when(two, last(3)).otherwise(last(2)), F.when(two, last(2)).otherwise(last(1))


def with_domains(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """`hosts` (host) plus domain and suffix. `suffixes` (suffix, of any number of labels) replaces the built-in short list:
    the longest that a host ends with counts, else its last label."""
    domain, suffix = domain_parts(F.col("host"))
    if suffixes is None:
        return hosts.withColumn("domain", domain).withColumn("suffix", suffix)
    labels = F.split(F.regexp_replace("host", r":\d*$", ""), r"\.")
    tail = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)), n), ".")
    each = hosts.select("host").distinct().withColumn("n", F.explode(F.sequence(F.lit(1), F.size(labels)))).withColumn("suffix", tail(F.col("n")))
    known = attach(each, suffixes.select("suffix", F.lit(True).alias("known")).distinct(), ["suffix"], "host")
    longest = known.groupBy("host").agg(F.coalesce(F.max(F.when(F.col("known"), F.col("n"))), F.lit(1)).alias("n"))
    parts = longest.select("host", tail(F.col("n") + 1).alias("domain"), tail(F.col("n")).alias("suffix"))
    return attach(hosts, written(parts, "url-domains-of"), ["host"], "host")


def _strength(groups: DataFrame, least: float = 0.5, most: float = 10_000.0) -> float:
    """Prior strength for groups (n, k, m = prior mean), from the over-dispersion of k against n * m."""
    spread = F.col("m") * (1 - F.col("m"))
    over, scale = groups.agg(F.sum(F.pow(F.col("k") - F.col("n") * F.col("m"), F.lit(2.0)) - F.col("n") * spread), F.sum(F.col("n") * (F.col("n") - 1) * spread)).first()
    rho = over / scale if scale else 0.0
    return min(most, max(least, 1 / rho - 1)) if rho > 0 else most


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645, suffixes: DataFrame | None = None) -> DataFrame:
    """Posterior of every host of `pages` (host) given `outcomes` (host, good 0/1): host, n, k, mean, bound.

    Hosts without outcomes get what their domain, suffix or the whole table says. Nulls in `good` are no outcome.
    """
    counted = outcomes.filter(F.col("good").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum("good").cast("long").alias("k"))
    known = pages.select("host").distinct().join(counted, "host", "left").fillna(0, ["n", "k"])
    hosts = written(with_domains(known, suffixes), "url-hosts")
    total, good = hosts.agg(F.sum("n"), F.sum("k")).first()
    start = ((good or 0) + 1.0) / ((total or 0) + 2.0)

    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    by_suffix = written(hosts.groupBy("suffix").agg(*sums).withColumn("m", F.lit(start)), "url-suffixes")
    strength = _strength(by_suffix)
    by_suffix = by_suffix.select("suffix", ((F.col("k") + strength * F.col("m")) / (F.col("n") + strength)).alias("m"))
    by_domain = written(attach(hosts.groupBy("domain", "suffix").agg(*sums), by_suffix, ["suffix"], "domain"), "url-domains")
    strength = _strength(by_domain)
    by_domain = by_domain.select("domain", "suffix", ((F.col("k") + strength * F.col("m")) / (F.col("n") + strength)).alias("m"))
    shrunk = written(attach(hosts, by_domain, ["domain", "suffix"], "host"), "url-shrunk")
    strength = _strength(shrunk)
    a, b = F.col("k") + strength * F.col("m"), F.col("n") - F.col("k") + strength * (1 - F.col("m"))
    mean = a / (a + b)
    bound = mean - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return shrunk.select("host", "n", "k", mean.alias("mean"), bound.alias("bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, least_bound: float = 0.5, id_col: str = "page_id", url_col: str = "url", suffixes: DataFrame | None = None) -> DataFrame:
    """Verdict for every url: page_id, host, path, rule, verdict, reputation (the posterior's lower bound, 6 digits).

    `outcomes` has (page_id, good 0/1) for labelled pages; ids that are no page count for nothing, a page labelled twice
    counts twice. Null urls and urls without `://` have the host '' with a reputation of its own. Repeated rows stay.
    An empty table gives an empty result; without outcomes every host has the prior of one half with a wide bound.
    `suffixes` (suffix) is a table of public suffixes to use in place of the built-in short list.
    """
    parsed = written(pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")), "url-parsed")
    labelled = outcomes.select(F.col(id_col).alias("page_id"), F.col("good")).join(parsed.select("page_id", "host"), "page_id")
    reputation = written(host_reputation(parsed, labelled, suffixes=suffixes), "url-reputation").select("host", "bound")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = attach(parsed, reputation, ["host"], "page_id")
    by_host = F.when(F.col("bound") >= least_bound, "allow").otherwise("block")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), F.round("bound", 6).alias("reputation"))


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages. The test tables label ids only, so `labels.quality` of an id is taken as the outcome of that page."""
    outcomes = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return filter_urls(read(spark, sf_dir, "pages"), outcomes)


_TWO = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
_SHRINK = "least(10000.0, greatest(0.5, CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE 10000.0 END))"
_RHO = "sum(pow(k - n * m, 2) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0)"
OP9_SQL = rf"""
WITH parsed AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
counted AS (
  SELECT host, count(*) AS n, sum(quality) AS k FROM parsed JOIN labels ON doc_id = page_id WHERE quality IS NOT NULL GROUP BY host),
labelled AS (
  SELECT p.host, coalesce(n, 0)::DOUBLE AS n, coalesce(k, 0)::DOUBLE AS k, string_split(regexp_replace(p.host, ':[0-9]*$', ''), '.') AS l
  FROM (SELECT DISTINCT host FROM parsed) p LEFT JOIN counted c ON p.host = c.host),
hosts AS (
  SELECT host, n, k, CASE WHEN array_to_string(l[-2:], '.') IN ({_TWO}) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
         CASE WHEN array_to_string(l[-2:], '.') IN ({_TWO}) THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix FROM labelled),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM hosts) AS m FROM hosts GROUP BY suffix),
s1 AS (SELECT suffix, (k + c * m) / (n + c) AS m FROM s0, (SELECT {_SHRINK} AS c FROM (SELECT {_RHO} AS rho FROM s0))),
d0 AS (SELECT h.domain, h.suffix, sum(h.n) AS n, sum(h.k) AS k, any_value(s1.m) AS m FROM hosts h JOIN s1 ON h.suffix = s1.suffix GROUP BY h.domain, h.suffix),
d1 AS (SELECT domain, suffix, (k + c * m) / (n + c) AS m FROM d0, (SELECT {_SHRINK} AS c FROM (SELECT {_RHO} AS rho FROM d0))),
h0 AS (SELECT h.host, h.n, h.k, d1.m FROM hosts h JOIN d1 ON h.domain = d1.domain AND h.suffix = d1.suffix),
h1 AS (SELECT host, k + c * m AS a, n - k + c * (1 - m) AS b FROM h0, (SELECT {_SHRINK} AS c FROM (SELECT {_RHO} AS rho FROM h0))),
h2 AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM h1),
rules(what, name, prefix) AS (VALUES {", ".join(str(r) for r in RULES)}),
fitting AS (
  SELECT u.host, u.path, r.what, r.name || r.prefix AS rule,
         row_number() OVER (PARTITION BY u.host, u.path ORDER BY length(r.name || r.prefix) DESC, length(r.name) DESC) AS place
  FROM (SELECT DISTINCT host, path FROM parsed) u JOIN rules r ON (u.host = r.name OR ends_with(u.host, '.' || r.name)) AND starts_with(u.path, r.prefix))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.what, CASE WHEN h2.bound >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict, round(h2.bound, 6) AS reputation
FROM parsed p JOIN h2 ON p.host = h2.host LEFT JOIN fitting f ON f.host = p.host AND f.path = p.path AND f.place = 1
"""
