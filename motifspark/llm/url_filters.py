"""URL filters (operator 9): empirical-Bayes reputation of hosts, in DataFrame functions only.

Labelled page outcomes are counted by host. Each level's share of bad outcomes is shrunk towards
the level above by a beta-binomial prior: suffix towards all outcomes, registered domain towards
its suffix, host towards its registered domain. How strong a prior is follows from the spread
between the groups of its level (method of moments). A page is blocked if the lower posterior
bound of its host's bad share exceeds `limit`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifspark.llm.common import cut, lookup, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict) of the rules.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

#: Suffixes of two labels under which names are registered; any other suffix has one label. A caller may
#: give the whole of a public list.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "com.br", "com.mx", "co.in", "com.cn", "com.tr", "co.za")

#: Bounds of a prior's strength in outcomes, and the standard deviations and share of the verdict.
WEAKEST, STRONGEST, DEVIATIONS, LIMIT = 0.5, 1000.0, 1.64, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def longest_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; both null without one."""
    text = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def _strength(groups: DataFrame) -> DataFrame:
    """One row `s`: strength of the prior from which the groups' bad shares come, by the analysis of
    variance estimate of their intraclass correlation."""
    sums = groups.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad").cast("double") / F.col("n")).alias("bb"))
    rho = F.expr(
        "CASE WHEN k > 1 AND n > k THEN ((bb - bad * bad / n) / (k - 1) - (bad - bb) / (n - k))"
        " / nullif((bb - bad * bad / n) / (k - 1) + ((n - nn / n) / (k - 1) - 1) * (bad - bb) / (n - k), 0) END"
    )
    return sums.withColumn("rho", rho).select(
        F.expr(f"least({STRONGEST}D, greatest({WEAKEST}D, CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE {STRONGEST}D END))").alias("s")
    )


def reputations(hosts: DataFrame, deviations: float = DEVIATIONS, two_label=TWO_LABEL_SUFFIXES) -> DataFrame:
    """hosts(host, pages, n, bad) with the posterior mean and lower bound of each host's bad share."""
    parts = F.split("host", r"\.")
    two = F.concat_ws(".", F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), 2))
    labels = F.when(two.isin(*two_label), 2).otherwise(1)
    last = lambda k: F.concat_ws(".", F.slice(parts, F.greatest(F.lit(1), F.size(parts) - k + 1), k))
    hosts = hosts.withColumns({"suffix": last(labels), "domain": last(labels + 1)})
    # Each level is read several times; the levels above are made from the written one below.
    domains = cut(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    every = suffixes.agg(F.expr("coalesce((sum(bad) + 1) / (sum(n) + 2), 0.5D)").alias("p"))

    def posterior(groups, name):
        return groups.crossJoin(F.broadcast(_strength(groups.where("n > 0")))).withColumn(name, F.expr("(bad + s * p) / (n + s)"))

    suffixes = posterior(suffixes.crossJoin(F.broadcast(every)), "q").select("suffix", F.col("q").alias("p"))
    domains = posterior(domains.join(suffixes, "suffix"), "q").select("domain", F.col("q").alias("p"))
    hosts = posterior(hosts.join(domains, "domain"), "mean")
    return hosts.withColumn("bound", F.expr(f"mean - {deviations}D * sqrt(mean * (1 - mean) / (n + s + 1))")).select("host", "pages", "n", "bad", "mean", "bound")


def url_filter(pages: DataFrame, rules=RULES, outcome: Column | None = None, limit: float = LIMIT, id_col: str = "page_id", url_col: str = "url", two_label=TWO_LABEL_SUFFIXES) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict.

    `outcome` is a boolean column of `pages`, true for a bad page, null for an unlabelled one; by
    default the pages that a rule judges are the labelled ones. A null url, or one without "://",
    has an empty host and path and is judged by the reputation of the empty host. Without any
    outcome, everything that no rule blocks is allowed. Null ids, repeated rows and repeated ids are
    kept; other columns are ignored. An empty input gives no rows.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page"), host.alias("host"), path.alias("path"), *([] if outcome is None else [outcome.alias("bad_page")]))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    bad = F.col("ruled") == "block" if outcome is None else F.col("bad_page")
    hosts = rows.groupBy("host").agg(F.count("*").alias("pages"), F.count(bad).alias("n"), F.count_if(bad).alias("bad"))
    known = cut(reputations(cut(hosts), two_label=two_label).select("host", "pages", "bound"))
    open_rows = rows.where("ruled IS NULL").select("page", "host", "path")
    judged = lookup(open_rows, known, "host", "pages", pages.count())
    out = rows.where("ruled IS NOT NULL").select("page", "host", "path", "rule", F.col("ruled").alias("verdict")).unionByName(
        judged.select("page", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("bound") > limit, "block").otherwise("allow").alias("verdict"))
    )
    return out.withColumnRenamed("page", id_col)


def op9_url_filters(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages"))


_S = "least(1000e0, greatest(0.5e0, CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE 1000e0 END))"


def _strength_sql(groups: str) -> str:
    return f"""(SELECT {_S} FROM (SELECT CASE WHEN k > 1 AND n > k THEN ((bb - bad * bad / n) / (k - 1) - (bad - bb) / (n - k))
      / nullif((bb - bad * bad / n) / (k - 1) + ((n - nn / n) / (k - 1) - 1) * (bad - bb) / (n - k), 0) END AS rho
      FROM (SELECT count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad, sum(CAST(n AS DOUBLE) * n) AS nn, sum(CAST(bad AS DOUBLE) * bad / n) AS bb
            FROM {groups} WHERE n > 0)))"""


ORACLE_SQL = f"""
WITH parsed AS (SELECT page_id, coalesce(url, '') AS u, strpos(coalesce(url, ''), '://') AS sep FROM pages),
rest AS (SELECT page_id, CASE WHEN sep > 0 THEN substr(u, sep + 3) ELSE '' END AS r FROM parsed),
split AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT *, (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') AS c1,
  (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') AS c2,
  (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') AS c3,
  (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') AS c4,
  (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') AS c5 FROM split),
ruled AS (SELECT page_id, host, path, CASE WHEN c3 THEN 'www.example.com/en/' WHEN c2 THEN 'example.com/en/' WHEN c4 THEN 'net/es/' WHEN c5 THEN 'net/fr/' WHEN c1 THEN 'com/' END AS rule,
  CASE WHEN c3 THEN 'allow' WHEN c2 OR c4 OR c5 THEN 'block' WHEN c1 THEN 'allow' END AS v FROM fits),
hosts AS (SELECT host, count(v) AS n, sum(CASE WHEN v = 'block' THEN 1 ELSE 0 END) AS bad, string_split(host, '.') AS parts FROM ruled GROUP BY host),
named AS (SELECT *, CASE WHEN array_to_string(parts[-2:], '.') IN ({", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)}) THEN 2 ELSE 1 END AS w FROM hosts),
levels AS (SELECT host, n, bad, array_to_string(parts[greatest(1, len(parts) - w + 1):], '.') AS suffix, array_to_string(parts[greatest(1, len(parts) - w):], '.') AS domain FROM named),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM levels GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
p1 AS (SELECT suffix, (bad + s * p) / (n + s) AS p FROM (SELECT *, {_strength_sql("suffixes")} AS s, (SELECT (sum(bad) + 1e0) / (sum(n) + 2e0) FROM suffixes) AS p FROM suffixes)),
p2 AS (SELECT domain, (bad + s * p) / (n + s) AS p FROM (SELECT d.*, p1.p, {_strength_sql("domains")} AS s FROM domains d JOIN p1 ON d.suffix = p1.suffix)),
p3 AS (SELECT host, n, s, (bad + s * p) / (n + s) AS mean FROM (SELECT l.*, p2.p, {_strength_sql("levels")} AS s FROM levels l JOIN p2 ON l.domain = p2.domain))
SELECT page_id, r.host, path, rule, coalesce(v, CASE WHEN mean - 1.64e0 * sqrt(mean * (1 - mean) / (n + s + 1)) > 0.5e0 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r JOIN p3 ON r.host = p3.host"""
