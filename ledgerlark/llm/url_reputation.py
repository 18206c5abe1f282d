"""URL filter: rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes are counted by host. Beta-binomial priors shrink a host towards its registered domain, the
domain towards its suffix and the suffix towards the overall rate; each level's concentration is fitted by moments. A
page goes when even the upper credible bound of its host's good rate lies under the floor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import materialize
from ledgerlark.session import table

#: (verdict, rule) of the production filter.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A concentration is kept within these bounds.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


#: Suffixes of two labels under which domains are registered; others can be given.
TWO_LABELS = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "com.cn", "com.hk", "com.mx", "com.sg", "com.tr", "com.tw", "co.in", "co.kr", "co.za",
)


def site_of(host: Column, two_labels: Sequence[str] = TWO_LABELS) -> tuple[Column, Column, Column]:
    """The name that a host's reputation belongs to (without user, port and a dot at its end), its registered domain and its
    suffix. An address of numbers is its own domain and suffix, as is a name of one label."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":[0-9]*$", ""), r"\.$", "")
    suffix = "(?:" + "|".join(x.replace(".", r"\.") for x in two_labels) + r"|[^.]*)$"
    address = name.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$|^\[")
    pick = lambda pattern: F.when(address, name).otherwise(F.regexp_extract(name, pattern, 0))
    return name, pick(rf"(?:[^.]*\.)?(?<![^.]){suffix}"), pick(rf"(?<![^.]){suffix}")


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls. The list is a parameter, so it is bounded."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _strength(counts: DataFrame, parent_rate: str, group: list[str]) -> float:
    """Concentration of the groups' rates around their parents' rate by the method of moments: counts has n, k and the
    parent's rate; group holds the columns of the parent."""
    by_parent = counts.groupBy(*group).agg(
        F.sum(F.expr(f"n * pow(k / n - {parent_rate}, 2)")).alias("spread"), F.count("*").alias("g"), F.sum("n").alias("all"),
        (F.sum("n") - F.sum(F.expr("n * n")) / F.sum("n")).alias("free"), F.max(F.expr(f"{parent_rate} * (1 - {parent_rate})")).alias("v"),
    )
    row = by_parent.agg(F.sum("spread").alias("s"), F.sum(F.expr("v * (g - 1)")).alias("noise"), F.sum(F.expr("v * (free - (g - 1))")).alias("room")).first()
    if not row["room"] or row["room"] <= 0:
        return MOST_STRENGTH
    rho = ((row["s"] or 0.0) - row["noise"]) / row["room"]
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, (1 - rho) / rho)) if rho > 0 else MOST_STRENGTH


def _levels(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, float, float]:
    """Hosts with their posteriors (host, domain, a, b), domain rates, suffix rates, the overall rate, and the strength
    with which a host's prior counts."""
    name, domain, suffix = site_of(F.col("host"))
    counted = outcomes.where("host is not null and good is not null").groupBy(name.alias("host")).agg(F.count("*").cast("double").alias("n"), F.sum("good").cast("double").alias("k"))
    hosts = materialize(counted.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    overall = total["k"] / total["n"] if total["n"] else 0.5
    s = _strength(suffixes.withColumn("parent", F.lit(overall)), "parent", ["parent"])
    suffixes = suffixes.select("suffix", ((F.col("k") + s * overall) / (F.col("n") + s)).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix")
    s = _strength(domains, "suffix_rate", ["suffix"])
    domains = domains.select("domain", "suffix", ((F.col("k") + s * F.col("suffix_rate")) / (F.col("n") + s)).alias("domain_rate"))
    hosts = hosts.join(domains, ["domain", "suffix"])
    s = _strength(hosts, "domain_rate", ["domain"])
    a, b = F.col("k") + s * F.col("domain_rate"), F.col("n") - F.col("k") + s * (1 - F.col("domain_rate"))
    return hosts.select("host", "domain", a.alias("a"), b.alias("b")), domains, suffixes, overall, s


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, good 0/1) -> host, domain, a, b: the posterior Beta(a, b) of each labelled host's good rate.

    The registered domain is the suffix and the label before it, the suffix the last label or one of TWO_LABELS; users and
    ports are not part of a host here. Null hosts or outcomes are left out; an empty table gives no row.
    """
    return _levels(outcomes)[0]


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, floor: float = 0.5, z: float = 1.645, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict.

    A page is blocked by the method when mean + z * deviation of its host's posterior good rate lies under floor; a host
    without outcomes has the prior of its domain, else of its suffix, else the overall one. A null url, or one without ://,
    has an empty host and path; without outcomes of its own an empty host is allowed. Repeated rows and ids are
    judged each by itself; an empty table gives an empty result; extra columns are ignored.
    """
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    parsed = parsed.withColumns(dict(zip(("name", "domain", "suffix"), site_of(F.col("host")), strict=True)))
    hosts, domains, suffixes, overall, s = _levels(outcomes)
    asked = parsed.select("name", "domain", "suffix").distinct()
    known = asked.join(hosts.withColumnRenamed("host", "name"), ["name", "domain"], "left").join(domains, ["domain", "suffix"], "left").join(suffixes, "suffix", "left")
    prior = F.coalesce("domain_rate", "suffix_rate", F.lit(overall))
    known = known.select("name", "domain", (F.col("a").isNotNull() | (F.col("name") != "")).alias("judged"), F.coalesce("a", s * prior).alias("a"), F.coalesce("b", s * (1 - prior)).alias("b"))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    upper = mean + z * F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    reputation = known.select("name", "domain", (F.col("judged") & (upper < floor)).alias("bad"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    # Joined on the domain too, so that both sides are dealt anew and a hot host is split.
    judged = parsed.join(reputation, ["name", "domain"], "left")
    return judged.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled outcomes of pages: the last number of a path names the document that labels marks; a page is good
    when that has quality 1 and isn't toxic."""
    host, path = host_and_path(F.col("url"))
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int").alias("good"))
    numbered = pages.select(host.alias("host"), F.regexp_extract(path, r"([0-9]{1,18})[^0-9]*$", 1).alias("digits"))
    return numbered.where("digits <> ''").select("host", F.col("digits").cast("bigint").alias("doc_id")).join(marks, "doc_id").select("host", "good")


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, page_outcomes(pages, table(spark, sf_dir, "labels")))


QUERIES = {"op1_url_reputation": op1_url_reputation}

ORACLE_SQL = {
    "op1_url_reputation": r"""
        WITH u AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), p AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
        ), o AS (
            SELECT p.host, CASE WHEN l.quality = 1 AND coalesce(l.toxic, 0) = 0 THEN 1.0 ELSE 0.0 END AS good
            FROM p JOIN labels l ON l.doc_id = TRY_CAST(regexp_extract(p.path, '([0-9]{1,18})[^0-9]*$', 1) AS BIGINT) WHERE l.quality IS NOT NULL
        ), h AS (
            SELECT host, regexp_extract(host, '([^.]*\.)?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix, CAST(count(*) AS DOUBLE) AS n, sum(good) AS k FROM o GROUP BY host
        ), d0 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY 1, 2
        ), s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, sum(sum(k)) OVER () / sum(sum(n)) OVER () AS parent FROM d0 GROUP BY 1
        ), cs AS (
            SELECT sum(n * pow(k / n - parent, 2)) AS s, max(parent * (1 - parent)) * (count(*) - 1) AS noise,
                   max(parent * (1 - parent)) * (sum(n) - sum(n * n) / sum(n) - (count(*) - 1)) AS room FROM s0
        ), ms AS (SELECT CASE WHEN coalesce(room, 0) <= 0 OR s <= noise THEN 1000.0 ELSE least(1000.0, greatest(1.0, room / (s - noise) - 1)) END AS m FROM cs
        ), s1 AS (SELECT suffix, (k + m * parent) / (n + m) AS rate FROM s0, ms
        ), d1 AS (SELECT d0.*, s1.rate AS parent FROM d0 JOIN s1 USING (suffix)
        ), cd AS (
            SELECT sum(s) AS s, sum(v * (g - 1)) AS noise, sum(v * (free - (g - 1))) AS room FROM (
                SELECT sum(n * pow(k / n - parent, 2)) AS s, max(parent * (1 - parent)) AS v, count(*) AS g, sum(n) - sum(n * n) / sum(n) AS free FROM d1 GROUP BY suffix)
        ), md AS (SELECT CASE WHEN coalesce(room, 0) <= 0 OR s <= noise THEN 1000.0 ELSE least(1000.0, greatest(1.0, room / (s - noise) - 1)) END AS m FROM cd
        ), d2 AS (SELECT domain, (k + m * parent) / (n + m) AS rate FROM d1, md
        ), h1 AS (SELECT h.*, d2.rate AS parent FROM h JOIN d2 USING (domain)
        ), ch AS (
            SELECT sum(s) AS s, sum(v * (g - 1)) AS noise, sum(v * (free - (g - 1))) AS room FROM (
                SELECT sum(n * pow(k / n - parent, 2)) AS s, max(parent * (1 - parent)) AS v, count(*) AS g, sum(n) - sum(n * n) / sum(n) AS free FROM h1 GROUP BY domain)
        ), mh AS (SELECT CASE WHEN coalesce(room, 0) <= 0 OR s <= noise THEN 1000.0 ELSE least(1000.0, greatest(1.0, room / (s - noise) - 1)) END AS m FROM ch
        ), h2 AS (SELECT host, k + m * parent AS a, n - k + m * (1 - parent) AS b FROM h1, mh
        ), bad AS (SELECT host, a / (a + b) + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) < 0.5 AS bad FROM h2
        ), r AS (
            SELECT page_id, host, path, CASE
                WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p
        )
        SELECT page_id, r.host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bad THEN 'block' ELSE 'allow' END AS verdict
        FROM r LEFT JOIN bad USING (host)
    """,
}
