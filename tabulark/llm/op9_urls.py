"""URL filter: empirical-Bayes host reputation (DataFrame functions only).

Page outcomes (bad or not) are counted by host; a host's rate of bad pages is
shrunk to its registered domain's, that to its suffix's and that to the whole
table's, each through a beta-binomial prior whose strength is estimated from
the spread of the groups of its level (method of moments).  A host is blocked
when the lower bound of its posterior is over a threshold.  Explicit rules
(host and path prefix, longest first) take precedence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Suffixes of two labels that count as one (fixed values; others: pass your own).
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.in", "com.cn", "co.nz", "co.za")
#: Deviations below the mean at which the bound lies, and the bound over which a host is blocked.
Z, LIMIT = 1.6449, 0.5
#: Hosts whose reputation is broadcast at most; beyond, it is joined, each of them in so many parts.
FEW, SALTS = 20_000, 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """verdict is block or allow; where is host/path, like example.net/en/."""

    verdict: str
    where: str

    def fits(self, host: Column, path: Column) -> Column:
        name, _, rest = self.where.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without a scheme or for null."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def domain_of(host: Column, two_label=TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host (its port does not count)."""
    labels = F.split(F.regexp_replace(host, ":[0-9]*$", ""), r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)), n), ".")
    two = last(2).isin(*two_label)
    return F.when(two, last(3)).otherwise(last(2)), F.when(two, last(2)).otherwise(last(1))


def host_counts(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Each host of pages(host, key) with n labelled pages, b of them bad.

    outcomes(key, bad): bad is 0 or 1; the worst of several rows of a key counts.
    """
    worst = outcomes.where(F.col("key").isNotNull() & F.col("bad").isNotNull()).groupBy("key").agg(F.max("bad").alias("bad"))
    # pages without a key meet no outcome: they stay out of the join, where all nulls would be one key
    tied = pages.where("key is not null").join(worst, "key", "left").select("host", "bad")
    tied = tied.unionByName(pages.where("key is null").select("host", F.lit(None).cast("int").alias("bad")))
    counted = tied.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("b"))
    domain, suffix = domain_of(F.col("host"))
    return counted.withColumns({"domain": domain, "suffix": suffix})


def with_host(rows: DataFrame, per_host: DataFrame, by: str) -> DataFrame:
    """rows with what per_host, a written table, says of their host; the rows of a large host stay spread."""
    if per_host.count() <= FEW:
        return rows.join(F.broadcast(per_host), "host", "left")
    salts = per_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salts, ["host", "salt"], "left").drop("salt")


def _strength(level: DataFrame, m: float) -> float:
    """Prior strength (alpha + beta) from the spread of groups (n, b) about m."""
    p = F.col("b") / F.col("n")
    k, m1, m2, s = level.where("n > 0").agg(F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("n") * (p - m) * (p - m))).first()
    if not k or k < 2 or m1 - m2 / m1 - (k - 1) <= 0:
        return 10.0
    rho = (s / (m * (1 - m)) - (k - 1)) / (m1 - m2 / m1 - (k - 1))
    return 1 / min(max(rho, 0.001), 0.5) - 1


def reputation(counts: DataFrame, z: float = Z) -> DataFrame:
    """host_counts() with bound, the lower posterior bound of the bad rate."""
    counts = written(counts, "hosts")
    n, b = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    m = (b + 0.5) / (n + 1)
    sums = [F.sum("n").alias("n"), F.sum("b").alias("b")]
    domains = counts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    ks, kd, kh = (_strength(x, m) for x in (suffixes, domains, counts))
    suffix_mean = suffixes.select("suffix", ((F.col("b") + ks * m) / (F.col("n") + ks)).alias("ms"))
    domain_mean = domains.join(suffix_mean, "suffix").select("domain", ((F.col("b") + kd * F.col("ms")) / (F.col("n") + kd)).alias("md"))
    alpha, beta = F.col("b") + kh * F.col("md"), F.col("n") - F.col("b") + kh * (1 - F.col("md"))
    mean = alpha / (alpha + beta)
    sd = F.sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)))
    return counts.join(domain_mean, "domain").select("host", "n", "b", (mean - z * sd).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], key: Column, limit: float = LIMIT) -> DataFrame:
    """A verdict for each row of pages(page_id, url, ...).

    key: the column of a page that names its outcome (null: unlabelled).
    Null, malformed and repeated urls are judged like any other row: their
    host is empty, and such pages share one reputation.  An empty table gives
    an empty result; extra columns of pages are ignored.  Urls of any length are
    read whole; of several outcomes of a key the worst counts.
    """
    host, path = parse(F.col("url"))
    seen = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    seen = seen.withColumn("key", key)
    known = written(reputation(host_counts(seen.select("host", "key"), outcomes)), "reputation")
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.where)):
        rule = F.when(r.fits(F.col("host"), F.col("path")), F.lit(r.where)).otherwise(rule)
        verdict = F.when(r.fits(F.col("host"), F.col("path")), F.lit(r.verdict)).otherwise(verdict)
    own = F.when(F.col("bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return with_host(seen, known, "page_id").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("n").alias("host_labelled"), F.col("b").alias("host_bad"))


RULES = [Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/")]


def query(spark, sf_dir: str) -> DataFrame:
    """Judge all of pages.  A page's outcome is the label of the document whose
    number ends its path: bad if its quality is 0 or it is toxic."""
    pages, labels = spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    number = F.regexp_extract(F.col("path"), r"/([0-9]{1,18})(?:\.html?)?/?$", 1).try_cast("long")
    return judge(pages, labels.select(F.col("doc_id").alias("key"), bad.alias("bad")), RULES, number)


SQL = r"""
with cut as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
seen as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
keyed as (
  select *, try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})(?:\.html?)?/?$', 1), '') as bigint) as k,
         string_split(regexp_replace(host, ':[0-9]*$', ''), '.') as l from seen),
named as (
  select *, case when len(l) >= 2 then l[-2] || '.' || l[-1] else l[-1] end as two,
         case when len(l) >= 3 then l[-3] || '.' else '' end as third from keyed),
sites as (
  select *, two in ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'com.br', 'co.jp', 'co.in', 'com.cn', 'co.nz', 'co.za') as multi from named),
worst as (
  select doc_id, max(case when quality = 0 or toxic = 1 then 1 when quality is not null or toxic is not null then 0 end) as bad
  from labels where doc_id is not null group by doc_id),
hosts as (
  select host, any_value(case when multi then third || two else two end) as domain, any_value(case when multi then two else l[-1] end) as suffix,
         count(bad) as n, coalesce(sum(bad), 0) as b from sites left join worst on k = doc_id group by host),
domains as (select domain, suffix, sum(n) as n, sum(b) as b from hosts group by domain, suffix),
suffixes as (select suffix, sum(n) as n, sum(b) as b from domains group by suffix),
whole as (select (coalesce(sum(b), 0) + 0.5e0) / (coalesce(sum(n), 0) + 1) as m from hosts),
levels as (select 's' as level, n, b from suffixes union all select 'd', n, b from domains union all select 'h', n, b from hosts),
spread as (
  select level, count(*) as k, sum(n)::double as m1, sum(n * n)::double as m2, sum(n * (b / n::double - m) * (b / n::double - m)) as s, any_value(m) as m
  from levels, whole where n > 0 group by level),
strength as (
  select level, case when k < 2 or m1 - m2 / m1 - (k - 1) <= 0 then 10e0
    else 1 / least(greatest((s / (m * (1 - m)) - (k - 1)) / (m1 - m2 / m1 - (k - 1)), 0.001e0), 0.5e0) - 1 end as kappa from spread),
kept as (
  select coalesce(max(case when level = 's' then kappa end), 10e0) as ks, coalesce(max(case when level = 'd' then kappa end), 10e0) as kd,
         coalesce(max(case when level = 'h' then kappa end), 10e0) as kh from strength),
ms as (select suffix, (b + ks * m) / (n + ks) as ms from suffixes, whole, kept),
md as (select domain, (b + kd * ms) / (n + kd) as md from domains join ms using (suffix), kept),
ab as (select host, n, b, b + kh * md as al, n - b + kh * (1 - md) as be from hosts join md using (domain), kept),
known as (select host, n, b, al / (al + be) - 1.6449e0 * sqrt(al * be / ((al + be) * (al + be) * (al + be + 1))) as bound from ab),
ruled as (
  select page_id, host, path, n, b, bound,
    case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
         when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
         when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
         when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
  from seen left join known using (host))
select page_id, host, path, rule,
  case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' when bound > 0.5 then 'block' else 'allow' end as verdict,
  n as host_labelled, b::bigint as host_bad
from ruled
"""
