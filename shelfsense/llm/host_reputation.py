"""URL filter: explicit rules, and an empirical-Bayes reputation of hosts for the rest.

Labelled page outcomes (bad or not) are counted per host, registered domain and public suffix. Each
level is a beta-binomial whose prior mean is that of the level above without the child's own labels
and whose prior strength comes from the spread of all children of that level around their parents (a
moment estimate over all data), weakened where few labels stand behind the mean. A host with few
labels thus keeps close to its domain, a domain to its suffix, a suffix to the whole, and no label counts twice. A page is blocked if the lower posterior bound of its host's bad
rate lies above ``threshold``: the bound is taken on the logit, whose mean and variance under a beta
posterior are differences of digamma and sums of trigamma values.

One host may hold a third of all pages: counts are aggregated before the shuffle, and the join of
verdicts to pages, with one row per host on its side, is split where a host is hot.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
Z = 1.645  # one-sided 95 %
STRENGTH_MIN, STRENGTH_MAX = 1.0, 1000.0

# Public suffixes of two labels; any other host's suffix is its last label.
TWO_LABEL_SUFFIXES = ["ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk"]


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the contract.
RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lower-cased) and path of a url; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``struct(name, verdict)`` of the longest rule that fits, else null."""
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict")),
        )
        for r in sorted(rules, key=lambda r: -len(r.name))
    ]
    return F.coalesce(*fits)


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    name = F.regexp_replace(host, ":[0-9]*$", "")
    labels = F.split(name, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), n), ".")
    number = name.rlike(r"^[0-9.]+$")
    two = last(2).isin(TWO_LABEL_SUFFIXES)
    suffix = F.when(number, "").when(two, last(2)).otherwise(last(1))
    return F.when(number, name).when(two, last(3)).otherwise(last(2)), suffix


def _digamma(x: Column) -> Column:
    y = x + 6
    tail = F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * y * y * y * y)
    for i in range(6):
        tail = tail - 1 / (x + i)
    return tail


def _trigamma(x: Column) -> Column:
    y = x + 6
    tail = 1 / y + 1 / (2 * y * y) + 1 / (6 * y * y * y) - 1 / (30 * y * y * y * y * y)
    for i in range(6):
        tail = tail + 1 / ((x + i) * (x + i))
    return tail


def _strength(children: DataFrame, parent: list[str]) -> Column:
    """Prior strength of a level from the spread of children (n, k) inside their parents."""
    seen = children.filter("n > 0").groupBy(*parent).agg(
        F.count("*").alias("c"),
        F.sum("n").alias("nn"),
        F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum("k").alias("kk"),
        F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kp"),
    )
    mean = F.col("kk") / F.col("nn")
    v = mean * (1 - mean)
    spread = F.col("kp") - F.col("kk") * mean
    excess = F.sum(spread - v * (F.col("c") - 1))
    scale = F.sum(v * (F.col("nn") - F.col("n2") / F.col("nn") - (F.col("c") - 1)))
    rho = F.when(scale > 0, excess / scale)
    strength = F.when(rho > 0, (1 - rho) / rho).otherwise(F.lit(STRENGTH_MAX))
    return seen.agg(F.greatest(F.lit(STRENGTH_MIN), F.least(F.lit(STRENGTH_MAX), strength)).alias("s")).select("s").scalar()


def reputations(outcomes: DataFrame) -> DataFrame:
    """Per host: labelled pages n, bad pages k, posterior a and b, and ``low``, the lower bound.

    ``outcomes`` has host and bad (1, 0 or null for an unlabelled page).
    """
    domain, suffix = domain_and_suffix(F.col("host"))
    tally = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    hosts = (
        outcomes.groupBy("host")
        .agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("k"))
        .select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k")
    )
    domains = hosts.groupBy("domain", "suffix").agg(*tally)
    suffixes = domains.groupBy("suffix").agg(*tally)
    whole = suffixes.agg(((F.sum("k") + 0.5) / (F.sum("n") + 1)).alias("m")).select("m").scalar()
    totals = domains.select("domain", "suffix", F.col("n").alias("nd"), F.col("k").alias("kd")).join(
        suffixes.select("suffix", F.col("n").alias("ns"), F.col("k").alias("ks")), "suffix"
    )
    strengths = {"s1": _strength(suffixes, []), "s2": _strength(domains, ["suffix"]), "s3": _strength(hosts, ["domain", "suffix"])}
    c = F.col
    # A level's mean without the child's own labels, and what that mean is worth: the strength of the
    # spread around it and the labels behind it, added as variances are.
    steps = [
        ("ms", (c("ks") - c("kd") + c("s1") * c("m0")) / (c("ns") - c("nd") + c("s1"))),
        ("wd", 1 / (1 / c("s2") + 1 / (c("ns") - c("nd") + c("s1")))),
        ("md", (c("kd") - c("k") + c("wd") * c("ms")) / (c("nd") - c("n") + c("wd"))),
        ("wh", 1 / (1 / c("s3") + 1 / (c("nd") - c("n") + c("wd")))),
    ]
    own = hosts.join(totals, ["domain", "suffix"]).withColumns({**strengths, "m0": whole})
    for name, value in steps:
        own = own.withColumn(name, value)
    posterior = own.select("host", "n", "k", (c("k") + c("wh") * c("md")).alias("a"), (c("n") - c("k") + c("wh") * (1 - c("md"))).alias("b"))
    logit = _digamma(F.col("a")) - _digamma(F.col("b")) - Z * F.sqrt(_trigamma(F.col("a")) + _trigamma(F.col("b")))
    return posterior.withColumn("low", 1 / (1 + F.exp(-logit)))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Every page as page_id, host, path, rule and verdict (``allow`` or ``block``).

    ``outcomes`` has page_id and bad; several labels of a page count as one, bad if any is. A null or
    unusual url has an empty host, which is judged by the pages like it. Repeated rows and null
    page_ids keep their rows (a null page_id has no label); other columns, whatever their names, are
    not read; empty tables give no rows or, without labels, verdicts from the prior alone.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = outcomes.groupBy(F.col("page_id").alias("labelled")).agg(F.max(F.col("bad").cast("int")).alias("bad"))
    known = rows.join(labels, F.col("page_id") == F.col("labelled"), "left").select("host", "bad")
    low = reputations(known).select("host", "low")
    rule = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("low") > threshold, "block").otherwise("allow")
    return rows.join(low, "host", "left").select(
        "page_id", "host", "path", rule["name"].alias("rule"), F.coalesce(rule["verdict"], own).alias("verdict")
    )


def _digamma_sql(x: str) -> str:
    y = f"({x} + 6)"
    return f"(ln{y} - 1 / (2 * {y}) - 1 / (12 * {y} * {y}) + 1 / (120 * {y} * {y} * {y} * {y})" + "".join(f" - 1 / ({x} + {i})" for i in range(6)) + ")"


def _trigamma_sql(x: str) -> str:
    y = f"({x} + 6)"
    return f"(1 / {y} + 1 / (2 * {y} * {y}) + 1 / (6 * {y} * {y} * {y}) - 1 / (30 * {y} * {y} * {y} * {y} * {y})" + "".join(f" + 1 / (({x} + {i}) * ({x} + {i}))" for i in range(6)) + ")"


def _strength_sql(children: str, parent: str) -> str:
    return f"""(SELECT greatest(1.0, least(1000.0, CASE WHEN scale > 0 AND excess / scale > 0 THEN (1 - excess / scale) / (excess / scale) ELSE 1000.0 END))
    FROM (SELECT sum(kp - kk * kk / nn - kk / nn * (1 - kk / nn) * (c - 1)) AS excess,
                 sum(kk / nn * (1 - kk / nn) * (nn - n2 / nn - (c - 1))) AS scale
          FROM (SELECT count(*) AS c, sum(n) AS nn, sum(n * n) AS n2, sum(k) AS kk, sum(k * k / n) AS kp
                FROM {children} WHERE n > 0 GROUP BY {parent})))"""


ORACLE = f"""
WITH rows AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
outcome AS (SELECT doc_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
counted AS (
  SELECT host, string_split(host, '.') AS p, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k
  FROM rows LEFT JOIN outcome ON doc_id = page_id GROUP BY host),
hosts AS (SELECT host, array_to_string(p[-2:], '.') AS domain, p[-1] AS suffix, n, k FROM counted),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
strengths AS (SELECT {_strength_sql("suffixes", "()")} AS s1, {_strength_sql("domains", "suffix")} AS s2, {_strength_sql("hosts", "domain, suffix")} AS s3,
  (SELECT (sum(k) + 0.5) / (sum(n) + 1) FROM suffixes) AS m0),
known AS (
  SELECT h.host, h.n, h.k, d.n AS nd, d.k AS kd, u.n AS ns, u.k AS ks, s1, s2, s3, m0
  FROM hosts h JOIN domains d USING (domain, suffix) JOIN suffixes u USING (suffix), strengths),
by_suffix AS (SELECT *, (ks - kd + s1 * m0) / (ns - nd + s1) AS ms, 1 / (1 / s2 + 1 / (ns - nd + s1)) AS wd FROM known),
by_domain AS (SELECT *, (kd - k + wd * ms) / (nd - n + wd) AS md, 1 / (1 / s3 + 1 / (nd - n + wd)) AS wh FROM by_suffix),
posterior AS (SELECT host, k + wh * md AS a, n - k + wh * (1 - md) AS b FROM by_domain),
bound AS (SELECT host, 1 / (1 + exp(-({_digamma_sql("a")} - {_digamma_sql("b")} - 1.645 * sqrt({_trigamma_sql("a")} + {_trigamma_sql("b")})))) AS low FROM posterior),
ruled AS (
  SELECT r.page_id, r.host, r.path, b.low,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM rows r JOIN bound b USING (host))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN low > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
