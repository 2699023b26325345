"""URL filters by empirical-Bayes host reputation [DataFrame functions only].

Labelled outcomes of pages (good or not) are counted by host. Each host's rate of good pages is shrunk towards that of
its registered domain, which is shrunk towards that of its suffix, which is shrunk towards the rate of all pages: at
every level a beta prior has the parent's posterior mean and a strength found by matching moments over the level. A
page is blocked when the upper bound of its host's posterior lies under ``FLOOR``. Hosts without outcomes take the
posterior of the nearest ancestor that has some. Explicit rules come first: the longest that fits a url decides. They are
a literal map in the plan, so more than ``MOST_RULES`` of them are an error.

Outcomes are pre-aggregated before anything is joined. Reputation tables are staged, so that Spark knows their size: it
broadcasts those under its own threshold, and else deals both sides by key and splits a hot one (adaptive skew join).

A null url, or one without ``://``, has an empty host and path and fits no rule. Hosts are compared with A-Z lower-cased,
as they stand (ports included). Repeated pages are judged each; repeated outcomes count each; outcomes that are null
don't count. With no outcomes at all, nothing is blocked but by rules. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import ascii_lower, stage

#: (host and path, verdict): a rule fits the host and its subdomains.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Pages are blocked when mean + Z * sd of the posterior is under FLOOR; bounds of a prior's strength.
FLOOR, Z, STRENGTH = 0.5, 1.645, (2.0, 1000.0)
#: Suffixes of two labels below which domains are registered.
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "org.uk")
#: Most explicit rules.
MOST_RULES = 1000


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    last = F.substring_index(host, ".", -2)
    return F.when(last.isin(*LONG_SUFFIXES), last).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(*LONG_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; of equal lengths the longer host, then the smaller text.

    Rules are grouped by host in a literal map that is looked up with each suffix of the url's host, so a url's cost
    grows with its labels and not with the number of rules.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    by: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), -r[0].find("/"), r[0])):
        h, slash, p = rule.partition("/")
        by.setdefault(h, []).append((slash + p, rule, verdict))
    one = lambda i, r: F.struct(F.lit(r[0]).alias("path"), F.lit(-len(r[1])).alias("order"), F.lit(-len(r[1]) + len(r[0])).alias("host"), F.lit(r[1]).alias("rule"), F.lit(r[2]).alias("verdict"))
    table = F.create_map(*(x for h, rs in by.items() for x in (F.lit(h), F.array(*(one(i, r) for i, r in enumerate(rs))))))
    labels = F.split(host, "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.flatten(F.filter(F.transform(suffixes, lambda s: table[s]), lambda x: x.isNotNull())), lambda r: path.startswith(r["path"]))
    best = F.array_min(F.transform(fits, lambda r: F.struct(r["order"], r["host"], r["rule"], r["verdict"])))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def _strength(level: DataFrame) -> float:
    """Prior strength of a level by moments: rows have n, good and the parent's mean. One row comes to the driver."""
    p, m = F.col("good") / F.col("n"), F.col("prior")
    x = level.agg(F.sum("n").alias("n"), F.sum(F.col("n") * m * (1 - m)).alias("w"), F.sum(F.col("n") * (p - m) * (p - m)).alias("q"), F.sum(m * (1 - m)).alias("e")).first()
    if not x["n"]:
        return STRENGTH[1]
    spread = (x["q"] - x["e"]) / x["n"]
    if spread <= 0:
        return STRENGTH[1]
    return min(STRENGTH[1], max(STRENGTH[0], x["w"] / x["n"] / spread - 1))


def reputation(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """Posterior tables of hosts, domains and suffixes (key, a, b), and the rate over all; outcomes: url, good (0 or 1)."""
    seen = outcomes.where("good is not null").select(host_of(F.col("url")).alias("host"), F.col("good").cast("double").alias("good"))
    hosts = seen.groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    hosts = stage(hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = total["good"] / total["n"] if total["n"] else 1.0

    def level(rows: DataFrame, key: str) -> DataFrame:
        rows = stage(rows, key)
        s = _strength(rows)
        return stage(rows.withColumns({"a": F.col("good") + s * F.col("prior"), "b": F.col("n") - F.col("good") + s * (1 - F.col("prior"))}).drop("prior"), key)

    mean = (F.col("a") / (F.col("a") + F.col("b"))).alias("prior")
    suffixes = level(hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("prior", F.lit(rate)), "suffix")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    domains = level(domains.join(suffixes.select("suffix", mean), "suffix"), "domain")
    hosts = level(hosts.join(domains.select("domain", mean), "domain"), "host")
    return hosts, domains, suffixes, rate


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, floor: float = FLOOR, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict and the posterior's mean and upper bound for every page."""
    hosts, domains, suffixes, rate = reputation(outcomes)
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # Distinct hosts first: the fallback through domain and suffix is done once for each.
    known = seen.groupBy("host").agg(F.count("*").alias("pages")).withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    both = lambda t, k: t.select(k, F.struct("a", "b").alias(f"{k}_ab"))
    for table, key in ((hosts, "host"), (domains, "domain"), (suffixes, "suffix")):
        known = known.join(both(table, key), key, "left")
    ab = F.coalesce("host_ab", "domain_ab", "suffix_ab")
    mean = F.coalesce(ab["a"] / (ab["a"] + ab["b"]), F.lit(float(rate)))
    upper = mean + z * F.sqrt(mean * (1 - mean) / (F.coalesce(ab["a"] + ab["b"], F.lit(0.0)) + 1))
    known = stage(known.select("host", mean.alias("mean"), upper.alias("upper")), "known")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    out = seen.join(known, "host", "left").withColumn("_rule", rule)
    return out.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", F.when(F.col("upper") < floor, "block").otherwise("allow")).alias("verdict"), "mean", "upper")


_LEVEL = "SELECT least(1000.0, greatest(2.0, CASE WHEN coalesce(sum(n), 0) = 0 OR sum(n * (good / n - prior) ** 2) - sum(prior * (1 - prior)) <= 0 THEN 1000.0 ELSE sum(n * prior * (1 - prior)) / (sum(n * (good / n - prior) ** 2) - sum(prior * (1 - prior))) - 1 END)) AS s FROM"
_LONG = ", ".join(f"'{x}'" for x in LONG_SUFFIXES)
ORACLE = f"""
WITH p AS (SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
q AS (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS two FROM p),
k AS (SELECT *, CASE WHEN two IN ({_LONG}) THEN two ELSE string_split(host, '.')[-1] END AS suffix,
    CASE WHEN two IN ({_LONG}) THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE two END AS domain FROM q),
h AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS good FROM k JOIN labels ON page_id = doc_id WHERE quality IS NOT NULL GROUP BY ALL),
g AS (SELECT sum(good) / sum(n) AS rate FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(rate) AS prior FROM h, g GROUP BY suffix),
s1 AS ({_LEVEL} s0), s2 AS (SELECT suffix, good + s * prior AS a, n - good + s * (1 - prior) AS b FROM s0, s1),
d0 AS (SELECT domain, sum(n) AS n, sum(good) AS good, any_value(a / (a + b)) AS prior FROM h JOIN s2 USING (suffix) GROUP BY domain),
d1 AS ({_LEVEL} d0), d2 AS (SELECT domain, good + s * prior AS a, n - good + s * (1 - prior) AS b FROM d0, d1),
h0 AS (SELECT host, n, good, a / (a + b) AS prior FROM h JOIN d2 USING (domain)),
h1 AS ({_LEVEL} h0), h2 AS (SELECT host, good + s * prior AS a, n - good + s * (1 - prior) AS b FROM h0, h1),
m AS (SELECT k.*, coalesce(h2.a, d2.a, s2.a) AS a, coalesce(h2.b, d2.b, s2.b) AS b, rate FROM k LEFT JOIN h2 USING (host) LEFT JOIN d2 USING (domain) LEFT JOIN s2 USING (suffix), g),
e AS (SELECT *, coalesce(a / (a + b), rate, 1.0) AS mean, coalesce(a + b, 0.0) AS size FROM m),
r(rule, v) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in RULES)}),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM k, r
  WHERE ('.' || host) LIKE '%.' || string_split(rule, '/')[1] AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN mean + 1.645 * sqrt(mean * (1 - mean) / (size + 1)) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM e LEFT JOIN f USING (page_id)
"""
