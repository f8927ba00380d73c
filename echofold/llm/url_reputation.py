"""URL filter: allow and block rules first, empirical-Bayes host reputation for the rest.

A url's host is what follows the first `://` up to `/`, `?`, `#` or the end, with A-Z in lower case; its
path is what follows up to `?`, `#` or the end. The longest rule (host, path prefix) that fits decides.

Other pages are judged by their host. Labelled page outcomes (good or bad) are counted per host, per
registered domain and per suffix. Each level is a beta-binomial population: its strength is estimated
by moments from the spread of the groups, and a group's mean is shrunk towards its parent's, from the
overall rate to the suffix, to the domain, to the host. A host is blocked when the upper bound of its
posterior good rate, mean + z * deviation, lies below `min_good`; an unseen host has its domain's prior.

The suffix is the last label, or the last two where `TWO_LABEL` names them; the registered domain has
one label more. Outcomes of the query: a page whose article is the text of labelled documents is good
if at least half of them have quality 1.

Scale: counts are map-side combined (8-byte counters per host), so a hot host costs nothing; texts are
reduced to MD5 before any shuffle; the join back is on the host, where adaptive execution splits skew.

Edge cases: null urls and urls without `://` have empty host and path and share the empty host's
reputation; no labelled outcome at all leaves every host at rate 1 (allow); labels that are null are
ignored and repeated ones are averaged per text; an empty table gives an empty result; only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.llm.common import stored

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
TWO_LABEL = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in")
MIN_GOOD, Z = 0.7, 1.645


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, "(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict), both null where none fits. The rules are a parameter of the plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host."""
    last = F.substring_index(host, ".", -1)
    two = F.substring_index(host, ".", -2)
    suffix = F.when(two.isin(*TWO_LABEL), two).otherwise(last)
    return F.when(two.isin(*TWO_LABEL), F.substring_index(host, ".", -3)).otherwise(two), suffix


def article_text(html: Column) -> Column:
    """The paragraphs of the first article, one a line, without tags and with entities resolved."""
    body = F.regexp_replace(F.regexp_extract(html, "(?s)<article>(.*?)</article>", 1), "(?s)<h1>.*?</h1>", "")
    text = F.regexp_replace(F.regexp_replace(body, "<p>", "\n"), "<[^>]+>", "")
    text = F.substring(text, 2, 2**31 - 1)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def outcomes_by_text(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(text_md5, good): one outcome per distinct labelled text."""
    known = labels.filter(F.col("quality").isNotNull()).select(F.col("doc_id").alias("l_id"), "quality")
    texts = documents.filter(F.col("text").isNotNull()).select("doc_id", F.md5("text").alias("text_md5"))
    both = texts.join(known, F.col("doc_id") == F.col("l_id"))
    return both.groupBy("text_md5").agg((2 * F.sum("quality") >= F.count("*")).alias("good"))


def _strength(groups: DataFrame) -> Column:
    """Moment estimate of the prior strength from (n, k) of a level's groups: 1 / rho - 1."""
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    p = F.sum(k) / F.sum(n)
    spread = F.sum(k * k / n) - F.sum(k) * F.sum(k) / F.sum(n)
    size = F.sum(n) - F.sum(n * n) / F.sum(n) - (F.count("*") - 1)
    rho = (spread / (p * (1 - p)) - (F.count("*") - 1)) / size
    rho = F.when((p <= 0) | (p >= 1) | (size <= 0), 0.01).otherwise(F.least(F.lit(0.9), F.greatest(F.lit(0.01), rho)))
    return (1 / rho - 1).alias("m")


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, good) -> (host, domain, suffix, upper): the posterior bound of every host with an outcome;
    rows with a null host, or null host and domain, hold the priors of unseen hosts."""
    domain, suffix = levels(F.col("host"))
    per_host = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("k")).withColumns({"domain": domain, "suffix": suffix})
    per_domain = per_host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    per_suffix = per_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    spark = outcomes.sparkSession
    m_host, m_domain, m_suffix = (df.agg(_strength(df)).first()["m"] or 99.0 for df in (per_host, per_domain, per_suffix))
    total = per_suffix.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    rate = total["k"] / total["n"] if total["n"] else 1.0

    def shrunk(parent: Column, m: float) -> Column:
        return (F.col("k") + F.lit(m) * parent) / (F.col("n") + F.lit(m))

    def upper(mean: Column, weight: Column) -> Column:
        return F.round(mean + F.lit(Z) * F.sqrt(mean * (1 - mean) / (weight + 1)), 6).alias("upper")

    s = per_suffix.select("suffix", shrunk(F.lit(rate), m_suffix).alias("s_mean"))
    d = per_domain.join(s, "suffix").withColumn("d_mean", shrunk(F.col("s_mean"), m_domain)).select("domain", "suffix", "d_mean")
    h = per_host.join(d, ["domain", "suffix"]).withColumn("h_mean", shrunk(F.col("d_mean"), m_host))
    none = F.lit(None).cast("string")
    at = lambda level, df: df.withColumn("level", F.lit(level))
    return (
        at("host", h.select(F.col("host").alias("name"), upper(F.col("h_mean"), F.col("n") + F.lit(m_host))))
        .unionByName(at("domain", d.select(F.col("domain").alias("name"), upper(F.col("d_mean"), F.lit(m_host)))))
        .unionByName(at("suffix", s.select(F.col("suffix").alias("name"), upper(F.col("s_mean"), F.lit(m_host)))))
        .unionByName(at("all", spark.range(1).select(none.alias("name"), upper(F.lit(rate), F.lit(m_host)))))
    )


def judged(pages: DataFrame, outcomes: DataFrame, min_good: float = MIN_GOOD, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, upper (the posterior bound behind a verdict without a rule).
    outcomes: (host, good) of the labelled pages."""
    host, path = host_and_path(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    domain, suffix = levels(F.col("host"))
    p = p.withColumns({"rule": rule, "said": said, "domain": domain, "suffix": suffix})
    known = reputation(outcomes)
    for level in ("host", "domain", "suffix"):
        r = known.filter(F.col("level") == level).select(F.col("name").alias(f"{level}_name"), F.col("upper").alias(f"{level}_upper"))
        p = p.join(r, F.col(level) == F.col(f"{level}_name"), "left")
    rest = known.filter(F.col("level") == "all").first()["upper"]
    upper = F.coalesce("host_upper", "domain_upper", "suffix_upper", F.lit(rest))
    verdict = F.coalesce("said", F.when(upper < min_good, "block").otherwise("allow"))
    return p.select("page_id", "host", "path", "rule", verdict.alias("verdict"), upper.alias("upper"))


def labelled_pages(pages: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, good) of the pages whose article is a labelled text."""
    host, _ = host_and_path(F.col("url"))
    mine = pages.select(host.alias("host"), F.md5(article_text(F.col("html"))).alias("page_md5"))
    known = outcomes_by_text(documents, labels)
    return mine.join(known, F.col("page_md5") == F.col("text_md5")).select("host", "good")


def from_tables(pages: DataFrame, documents: DataFrame, labels: DataFrame, min_good: float = MIN_GOOD) -> DataFrame:
    """The query: outcomes from the labelled texts, then every page judged."""
    return judged(pages, stored(labelled_pages(pages, documents, labels), "page-outcomes"), min_good)


SQL = r"""
WITH u AS (
  SELECT page_id, html, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages
), p AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), body AS (
  SELECT page_id, host, regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '(?s)<h1>.*?</h1>', '', 'g'), '<p>', chr(10), 'g'), '<[^>]+>', '', 'g')[2:] AS t FROM p
), article AS (
  SELECT page_id, host, md5(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&#39;', chr(39)), '&amp;', '&')) AS m FROM body
), texts AS (
  SELECT md5(text) AS m, 2 * sum(quality) >= count(*) AS good
  FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND quality IS NOT NULL GROUP BY 1
), named AS (
  SELECT page_id, host, path, array_to_string(string_split(host, '.')[-2:], '.') AS two, string_split(host, '.')[-1] AS last,
         array_to_string(string_split(host, '.')[-3:], '.') AS three
  FROM p
), lev AS (
  SELECT page_id, host, path,
         CASE WHEN two IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.in') THEN two ELSE last END AS suffix,
         CASE WHEN two IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.in') THEN three ELSE two END AS domain
  FROM named
), hosts AS (
  SELECT l.host, l.domain, l.suffix, count(*) AS n, sum(CAST(good AS BIGINT)) AS k
  FROM article a JOIN texts USING (m) JOIN lev l ON a.page_id IS NOT DISTINCT FROM l.page_id GROUP BY ALL
), domains AS (
  SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL
), total AS (
  SELECT coalesce(CAST(sum(k) AS DOUBLE) / sum(n), 1.0) AS rate FROM suffixes
), moments AS (
  SELECT what, CAST(sum(k) AS DOUBLE) / sum(n) AS q, sum(CAST(k AS DOUBLE) * k / n) - CAST(sum(k) AS DOUBLE) * sum(k) / sum(n) AS spread,
         CAST(sum(n) AS DOUBLE) - sum(CAST(n AS DOUBLE) * n) / sum(n) - (count(*) - 1) AS size, count(*) AS c
  FROM (SELECT 'host' AS what, n, k FROM hosts UNION ALL SELECT 'domain', n, k FROM domains UNION ALL SELECT 'suffix', n, k FROM suffixes) GROUP BY what
), strengths AS (
  SELECT what, 1 / (CASE WHEN q <= 0 OR q >= 1 OR size <= 0 THEN 0.01 ELSE least(0.9, greatest(0.01, (spread / (q * (1 - q)) - (c - 1)) / size)) END) - 1 AS m FROM moments
), m AS (
  SELECT coalesce(max(m) FILTER (what = 'host'), 99.0) AS mh, coalesce(max(m) FILTER (what = 'domain'), 99.0) AS md, coalesce(max(m) FILTER (what = 'suffix'), 99.0) AS ms FROM strengths
), s AS (
  SELECT suffix, (k + ms * rate) / (n + ms) AS mean FROM suffixes, m, total
), d AS (
  SELECT domain, suffix, (k + md * s.mean) / (n + md) AS mean FROM domains JOIN s USING (suffix), m
), h AS (
  SELECT host, n, (k + mh * d.mean) / (n + mh) AS mean FROM hosts JOIN d USING (domain, suffix), m
), bounds AS (
  SELECT l.page_id, l.host, l.path,
         coalesce(h.mean, d.mean, s.mean, rate) AS mean, CASE WHEN h.host IS NULL THEN 0 ELSE h.n END + mh AS w
  FROM lev l LEFT JOIN h ON l.host = h.host LEFT JOIN d ON l.domain = d.domain LEFT JOIN s ON l.suffix = s.suffix, m, total
), judged AS (
  SELECT page_id, host, path, round(mean + 1.645 * sqrt(mean * (1 - mean) / (w + 1)), 6) AS upper,
         CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM bounds
)
SELECT page_id, host, path, rule, upper,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN upper < 0.7 THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""
