"""URL filters: written rules first, then the reputation of the host by empirical Bayes.

A rule names a host and the start of a path; it fits the host and its subdomains, and the longest rule that fits
decides. Other pages are judged by what labelled pages of their host turned out to be. A host's rate of bad pages
has a beta prior centred on its registered domain's rate, which is shrunk to its suffix's, which is shrunk to the
overall rate. How strongly each level holds together is estimated from the data by moments (a beta-binomial fit of the
units around their parents). A page is blocked if the lower end of its host's posterior exceeds `max_bad`.

All counts are partial aggregates, so a host that holds most pages is one row per task before it is shuffled; pages
meet the table of hosts in a join that Spark may broadcast by size or split.

Edge cases: a null url or one without `://` has an empty host and path, which is a host like any other (no rule fits
it); hosts without labels rest on their parents; without any label the prior is even and nothing is blocked; repeated
rows count and are judged each for itself; a null id has no label; long urls are read whole; an empty table gives an
empty result. Only the id and url columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lecturelab.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class ReputationParams:
    max_bad: float = 0.5
    z: float = 1.645
    min_spread: float = 1e-3
    max_spread: float = 0.9
    #: Suffixes of more than one label; all others are the last label of a host.
    long_suffixes: tuple[str, ...] = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")


def parsed(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, URL, 1), UPPER, LOWER), F.regexp_extract(text, URL, 2)


def first_rule(host: Column, path: Column, rules: Sequence[UrlRule], what: str) -> Column:
    """`what` (name or verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, what))).otherwise(out)
    return out


def parents(host: Column, params: ReputationParams = ReputationParams()) -> tuple[Column, Column]:
    """Registered domain and suffix."""
    two, three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    long = two.isin(*params.long_suffixes)
    return F.when(long, three).otherwise(two), F.when(long, two).otherwise(F.substring_index(host, ".", -1))


def reputation(outcomes: DataFrame, params: ReputationParams = ReputationParams()) -> DataFrame:
    """`outcomes`: `host`, `bad` (1, 0, or null without a label), one row per page. Gives one row per host: its counts
    `n` and `n_bad`, and the `low` and `high` ends of its posterior rate."""
    domain, suffix = parents(F.col("host"), params)
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("x"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("x").alias("dx"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dx").alias("sx"))
    total = suffixes.agg(F.coalesce(F.sum("sn"), F.lit(0)).alias("n"), F.coalesce(F.sum("sx"), F.lit(0)).alias("x")).first()
    overall = (total["x"] + 0.5) / (total["n"] + 1)

    def strength(units: DataFrame, n: str, x: str, mean: Column, groups: Column | None) -> float:
        """Prior observations of a level: 1 / rho - 1, rho from the spread of units around their parents' rates."""
        own = units.where(F.col(n) > 0)
        spread = F.sum(F.col(n) * F.pow(F.col(x) / F.col(n) - mean, 2))
        row = own.agg(
            spread.alias("s"), F.count("*").alias("units"), F.sum(n).alias("n"), F.sum(F.col(n) * F.col(n)).alias("nn"),
            F.sum(F.col(n) * mean * (1 - mean)).alias("v"), F.lit(1).alias("one") if groups is None else F.count_distinct(groups).alias("one")).first()
        if not row["units"] or not row["v"] or row["units"] <= row["one"]:
            return 1 / params.min_spread - 1
        within = row["v"] / row["n"]
        free = row["units"] - row["one"]
        room = row["n"] - row["nn"] / row["n"] - free
        rho = (row["s"] - within * free) / (within * room) if room > 0 else params.min_spread
        return 1 / min(max(rho, params.min_spread), params.max_spread) - 1

    k_suffix = strength(suffixes, "sn", "sx", F.lit(overall), None)
    suffixes = suffixes.withColumns({
        "s_rate": (F.col("sx") + k_suffix * overall) / (F.col("sn") + k_suffix), "s_raw": (F.col("sx") + 0.5) / (F.col("sn") + 1)})
    domains = domains.join(suffixes, "suffix")
    k_domain = strength(domains, "dn", "dx", F.col("s_raw"), F.col("suffix"))
    domains = domains.withColumns({
        "d_rate": (F.col("dx") + k_domain * F.col("s_rate")) / (F.col("dn") + k_domain), "d_raw": (F.col("dx") + 0.5) / (F.col("dn") + 1)})
    hosts = hosts.join(domains.select("domain", "d_rate", "d_raw"), "domain")
    k_host = strength(hosts, "n", "x", F.col("d_raw"), F.col("domain"))
    a, b = F.col("x") + k_host * F.col("d_rate"), F.col("n") - F.col("x") + k_host * (1 - F.col("d_rate"))
    mean, size = a / (a + b), a + b
    half = params.z * F.sqrt(mean * (1 - mean) / (size + 1))
    return hosts.select("host", "n", F.col("x").alias("n_bad"), (mean - half).alias("low"), (mean + half).alias("high"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[UrlRule], key: str = "page_id", url: str = "url", params: ReputationParams = ReputationParams()) -> DataFrame:
    """key, `host`, `path`, `rule`, `verdict`, `host_labels`, `host_bad`. `labels`: `id`, `bad` (1 or 0), an id once."""
    host, path = parsed(F.col(url))
    slim = materialise(pages.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path")), "urls")
    outcomes = slim.select("_key", "host").join(labels.select(F.col("id").alias("_id"), "bad"), F.col("_key") == F.col("_id"), "left")
    table = reputation(outcomes.select("host", "bad"), params)
    rule, verdict = (first_rule(F.col("host"), F.col("path"), rules, what) for what in ("name", "verdict"))
    own = F.when(F.col("low") > params.max_bad, "block").otherwise("allow")
    return slim.join(table, "host").select(
        F.col("_key").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
        F.col("n").alias("host_labels"), F.col("n_bad").alias("host_bad"))


def oracle(rules: Sequence[UrlRule], params: ReputationParams = ReputationParams()) -> str:
    """The same verdicts as SQL for DuckDB; `outcomes` there are labels of low quality or toxic documents."""

    def longest(what: str) -> str:
        whens = " ".join(
            f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{getattr(r, what)}'"
            for r in sorted(rules, key=lambda r: (len(r.name), r.name), reverse=True))
        return f"case {whens} end"

    def tail(n: int) -> str:
        return f"array_to_string(string_split(host, '.')[-{n}:], '.')"

    def strength(units: str, n: str, x: str, mean: str, groups: str) -> str:
        low, high = params.min_spread, params.max_spread
        return f"""(select case when coalesce(v, 0) = 0 or units <= one then 1 / {low} - 1
            else 1 / least(greatest(case when n - nn / n - (units - one) > 0
                then (s - v / n * (units - one)) / (v / n * (n - nn / n - (units - one))) else {low} end, {low}), {high}) - 1 end as k
            from (select sum({n} * pow({x} / {n} - {mean}, 2)) as s, count(*) as units, sum({n}) as n, sum({n} * {n}) as nn,
                sum({n} * {mean} * (1 - {mean})) as v, {groups} as one from {units} where {n} > 0))"""

    long = ", ".join(f"'{x}'" for x in params.long_suffixes)
    return f"""
with urls as (select page_id, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{UPPER}', '{LOWER}') as host,
    regexp_extract(coalesce(url, ''), '{URL}', 2) as path from pages),
outcomes as (select doc_id as id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels where doc_id is not null group by 1),
hosts0 as (select host, count(bad)::double as n, coalesce(sum(bad), 0)::double as x,
    case when {tail(2)} in ({long}) then {tail(3)} else {tail(2)} end as domain,
    case when {tail(2)} in ({long}) then {tail(2)} else {tail(1)} end as suffix
    from urls left join outcomes on page_id = id group by host),
domains0 as (select domain, suffix, sum(n) as dn, sum(x) as dx from hosts0 group by all),
suffixes0 as (select suffix, sum(dn) as sn, sum(dx) as sx from domains0 group by all),
overall as (select (coalesce(sum(sx), 0) + 0.5::double) / (coalesce(sum(sn), 0) + 1) as m from suffixes0),
suffixes1 as (select *, (sx + 0.5::double) / (sn + 1) as s_raw from suffixes0, overall),
suffixes as (select *, (sx + k * m) / (sn + k) as s_rate from suffixes1, {strength('suffixes1', 'sn', 'sx', 'm', '1')}),
domains1 as (select d.*, s_raw, s_rate, (dx + 0.5::double) / (dn + 1) as d_raw from domains0 d join suffixes using (suffix)),
domains as (select * exclude k, (dx + k * s_rate) / (dn + k) as d_rate from domains1, {strength('domains1', 'dn', 'dx', 's_raw', 'count(distinct suffix)')}),
hosts1 as (select h.*, d_raw, d_rate from hosts0 h join domains using (domain)),
hosts as (select host, n, x, (x + k * d_rate) / (n + k) as mean, n + k as size from hosts1, {strength('hosts1', 'n', 'x', 'd_raw', 'count(distinct domain)')})
select page_id, host, path, {longest('name')} as rule,
    coalesce({longest('verdict')}, case when mean - {params.z} * sqrt(mean * (1 - mean) / (size + 1)) > {params.max_bad} then 'block' else 'allow' end) as verdict,
    n::bigint as host_labels, x::bigint as host_bad
from urls join hosts using (host)"""
