"""URL filter: fixed host and path rules, else empirical-Bayes host reputation.

DataFrame functions only. Labelled pages (bad: low quality or toxic) are counted by host; the bad
rate is shrunk down a hierarchy, suffix to registered domain to host: each level's prior is a beta
distribution with the parent's posterior mean and a strength estimated by moments from how much
the level's rates differ. A host is blocked when the lower bound of its posterior bad rate is above
RATIO times the rate of all labelled pages, that is, when it is surely worse than the rest. The
suffix is the host's last label, or its last two where SUFFIXES has them (other suffixes of several
labels count as registered domains); the registered domain has one label more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumweave.llm import common as C

#: Fixed values: (verdict, host and path).
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Common public suffixes of two labels.
SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr", "co.in", "com.cn", "com.tw", "com.hk", "com.sg", "com.br", "com.ar", "com.mx", "com.tr", "co.za", "co.il", "blogspot.com", "github.io")
#: Standard deviations below the posterior mean, and how many times the overall bad rate that bound may be.
Z, RATIO = 1.645, 1.0
#: Bounds of a prior's strength, in pseudo-observations.
WEAK, STRONG = 1.0, 1000.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for v, r in sorted(sorted(rules, key=lambda x: x[1], reverse=True), key=lambda x: len(x[1])):
        h, p = r.split("/", 1)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """(suffix, registered domain)."""
    two = F.substring_index(host, ".", -2)
    long = two.isin(*SUFFIXES)
    return F.when(long, two).otherwise(F.substring_index(host, ".", -1)), F.when(long, F.substring_index(host, ".", -3)).otherwise(two)


def _shrunk(children: DataFrame, parents: DataFrame | None, parent: str) -> DataFrame:
    """Adds mean, strength and prior mean to ``children`` (child, parent, n, bad), given the
    parents' means (parent, mean), or the overall rate."""
    tot = children.agg(F.sum("bad").alias("x"), F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("q"), F.count(F.lit(1)).alias("g")).withColumn("rate", F.when(F.col("m") > 0, F.col("x") / F.col("m")).otherwise(0.0))
    j = children.crossJoin(F.broadcast(tot))  # one row
    spread = F.sum(F.when(F.col("n") > 0, F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("rate"), 2)).otherwise(0.0))
    one = j.agg(spread.alias("s"), F.first("rate").alias("rate"), F.first("m").alias("m"), F.first("q").alias("q"), F.first("g").alias("g"))
    v = F.col("rate") * (1 - F.col("rate"))
    den = v * (F.col("m") - F.col("q") / F.col("m") - (F.col("g") - 1))
    rho = F.when((F.col("m") > 0) & (den > 0), (F.col("s") - v * (F.col("g") - 1)) / den).otherwise(F.lit(0.0))
    k = F.when(rho > 0, F.least(F.greatest(1 / rho - 1, F.lit(WEAK)), F.lit(STRONG))).otherwise(F.lit(STRONG))
    one = one.select(k.alias("k"), "rate")
    out = children.crossJoin(F.broadcast(one))  # one row
    out = out.withColumn("prior", F.col("rate")) if parents is None else out.join(parents.select(F.col(parent), F.col("mean").alias("prior")), parent)
    return out.withColumn("mean", (F.col("bad") + F.col("k") * F.col("prior")) / (F.col("n") + F.col("k")))


def reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """A row a host: host, n, bad, mean, bound (lower bound of the bad rate), overall (all hosts' bad rate).

    ``pages`` needs page_id and host, ``labels`` doc_id (the page), quality and toxic. A label
    with both null tells nothing. Unlabelled hosts get their domain's prior.
    """
    lab = labels.select(F.col("doc_id").alias("page_id"), F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.col("quality") == 0, F.col("toxic") == 1).cast("long").alias("bad"))
    lab = lab.where("bad is not null and page_id is not null").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    hosts = pages.select("page_id", "host").join(lab, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    suffix, domain = levels(F.col("host"))
    hosts = hosts.withColumn("suffix", suffix).withColumn("domain", domain)
    roll = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    s = _shrunk(roll(hosts, "suffix"), None, "")
    d = _shrunk(roll(hosts, "domain", "suffix"), s, "suffix")
    h = _shrunk(hosts, d, "domain")
    a, b = F.col("bad") + F.col("k") * F.col("prior"), F.col("n") - F.col("bad") + F.col("k") * (1 - F.col("prior"))
    sd = F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))
    return h.select("host", "n", "bad", "mean", (F.col("mean") - F.lit(Z) * sd).alias("bound"), F.col("rate").alias("overall"))


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule (null where none fits), verdict, and the host's bad_rate and
    bad_bound (posterior mean and lower bound, six digits) for every row of ``pages``.

    A url that is null or has no ``://`` has an empty host and path: no rule fits it and its
    reputation is that of all such pages. Rows that repeat a page_id come out each; urls may be of any length. Of rules
    of one length the first in the alphabet counts. Empty labels
    leave all that no rule blocks allowed. Other columns are ignored.
    """
    C.prepare(pages.sparkSession)
    host, path = host_path(F.col("url").cast("string"))
    rows = C.written(pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path")), "hosts")
    rep = C.written(reputation(rows, labels), "reputation")
    rule, verdict = longest_rule(F.col("host"), F.col("path"))
    learned = F.when(F.col("bound") > F.lit(RATIO) * F.col("overall"), "block").otherwise("allow")
    return rows.join(rep, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), F.round("mean", 6).alias("bad_rate"), F.round("bound", 6).alias("bad_bound"))


def sql() -> str:
    """The same in DuckDB."""

    def level(key, parent, prior):
        n, keys = f"{key}_l", key if parent is None else f"{key}, {parent}"
        v, m = "rate * (1 - rate)", "(m - q::DOUBLE / m - (g - 1))"
        join = f" JOIN {parent}_l p USING ({parent})" if parent else ""
        return f"""
{n}_n AS (SELECT {keys}, SUM(n) AS n, SUM(bad) AS bad FROM hosts GROUP BY ALL),
{n}_t AS (SELECT SUM(bad) AS x, SUM(n) AS m, SUM(n * n) AS q, COUNT(*) AS g, CASE WHEN SUM(n) > 0 THEN SUM(bad)::DOUBLE / SUM(n) ELSE 0 END AS rate FROM {n}_n),
{n}_s AS (SELECT SUM(CASE WHEN n > 0 THEN n * pow(bad::DOUBLE / n - rate, 2) ELSE 0 END) AS s FROM {n}_n, {n}_t),
{n}_r AS (SELECT rate, CASE WHEN m > 0 AND {v} * {m} > 0 THEN (s - {v} * (g - 1)) / ({v} * {m}) ELSE 0 END AS rho FROM {n}_t, {n}_s),
{n}_k AS (SELECT rate, CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, {WEAK}), {STRONG}) ELSE {STRONG} END AS k FROM {n}_r),
{n} AS (SELECT c.*, {n}_k.k, {prior} AS prior, (c.bad + {n}_k.k * {prior}) / (c.n + {n}_k.k) AS mean FROM {n}_n c CROSS JOIN {n}_k{join}),"""

    rules = sorted(RULES, key=lambda x: (-len(x[1]), x[1]))
    fits = lambda r: "((host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}'))".format(*r.split("/", 1))
    case = lambda out: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{out(v, r)}'" for v, r in rules)
    s = level("suffix", None, "rate")
    d = level("domain", "suffix", "p.mean")
    h = level("host", "domain", "p.mean")
    suffixes = ", ".join(f"'{x}'" for x in SUFFIXES)
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce(r, '') AS r FROM rest)),
lab AS (SELECT doc_id AS page_id, COUNT(*) AS n, SUM(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT host, array_to_string(string_split(host, '.')[-1 - long:], '.') AS suffix, array_to_string(string_split(host, '.')[-2 - long:], '.') AS domain, coalesce(SUM(n), 0) AS n, coalesce(SUM(bad), 0) AS bad FROM (SELECT *, (array_to_string(string_split(host, '.')[-2:], '.') IN ({suffixes}))::INT AS long FROM p) LEFT JOIN lab USING (page_id) GROUP BY ALL),
{s}{d}{h}
b AS (SELECT host, mean, rate AS overall, mean - {Z} * sqrt((bad + k * prior) * (n - bad + k * (1 - prior)) / (pow(n + k, 2) * (n + k + 1))) AS bound FROM host_l, host_l_t)
SELECT page_id, host, path, {case(lambda v, r: r)} ELSE NULL END AS rule, {case(lambda v, r: v)} WHEN bound > {RATIO} * overall THEN 'block' ELSE 'allow' END AS verdict, round(mean, 6) AS bad_rate, round(bound, 6) AS bad_bound FROM p JOIN b USING (host)
"""


def query(spark, sf_dir: str) -> DataFrame:
    """op10_url_filter."""
    return judge(C.table(spark, sf_dir, "pages"), C.table(spark, sf_dir, "labels"))
