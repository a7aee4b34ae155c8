"""URL filters: rules first, then empirical-Bayes host reputation.

Labelled outcomes of pages (1: bad) are summed per host, registered domain and
public suffix. Beta-binomial priors shrink them downwards: the suffix towards the
corpus mean, the domain towards its suffix, the host towards its domain. The
strength of the prior at each level is estimated from the spread of the level's
rates (method of moments), but a prior never counts for more outcomes than its own
level rests on, and its uncertainty is added to the host's: what others did says little
of a host when few have been seen. A host is blocked when the lower posterior bound
(mean - z * standard deviation) of its bad rate passes a limit, the given one or
TOLERANCE times the bad rate of all outcomes, and a bad outcome of the host or its
domain has been seen. At z = 1.645 about one in twenty hosts that lie just at the limit
is blocked; hosts at the corpus rate are blocked more rarely.

The suffix and domain are those of the host without user and port; an address of
numbers is its own suffix and domain.

Only sums per host, domain and suffix are shuffled, summed before the shuffle, so
a hot host costs one row per task. Defined results: a null URL or one without
``://`` has an empty host and path, which the rules and the method judge as any
other host; null labels and outcomes of a null page id are no outcome; a page with a
null id is judged and has no outcome; without outcomes nothing is blocked but by
rule; repeated pages give repeated results, and each counts as an outcome; very long
URLs are read whole; an empty table gives an empty one; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Two-label public suffixes told apart; else the last label is the suffix. A parameter for longer lists.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.za")
#: Hosts that are addresses.
ADDRESS = r"^([0-9]{1,3}[.]){3}[0-9]{1,3}$|^\[.*\]$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

Z = 1.645
#: Times the corpus rate that a host's rate must pass, as far as its outcomes can tell.
TOLERANCE = 1.5
#: Hosts broadcast at most; beyond, pages are dealt out over this many salts of their host.
MOST_BROADCAST, SALTS = 1_000_000, 64
STRENGTH = (1.0, 1000.0)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def suffix_and_domain(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """Public suffix and registered domain (the suffix and one label more) of a host, which may have user, port or numbers for a name."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    number = name.rlike(ADDRESS)
    suffix = F.when(number, name).when(two.isin(list(two_label)), two).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(number, name).when(two.isin(list(two_label)), F.substring_index(name, ".", -3)).otherwise(two)
    return suffix, domain


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(text, verdict), null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _strength(level: DataFrame) -> Column:
    """Prior strength from sums n, bad per group: the method of moments for beta-binomial rates, within STRENGTH."""
    k, n, bad = F.count(F.lit(1)).cast("double"), F.sum("n").cast("double"), F.sum("bad").cast("double")
    mean = bad / n
    # sum n (p - mean)^2 = sum bad^2 / n - bad^2 / n, over the groups
    spread = F.sum(F.col("bad") * F.col("bad") / F.col("n")) - bad * bad / n
    s2 = k * spread / ((k - 1) * n)
    top = mean * (1 - mean) - s2
    low = s2 - mean * (1 - mean) / k * F.sum(1 / F.col("n"))
    # No spread beyond chance: the strongest prior; more spread than rates can have: the weakest.
    return F.when((k < 2) | (n <= 0) | (low <= 0), F.lit(STRENGTH[1])).otherwise(F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), top / low)))


def host_reputation(outcomes: DataFrame, hosts: DataFrame, *, z: float = Z, most_bad: float | None = None, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """Posterior of every host of ``hosts`` from ``outcomes`` (host, bad 0/1): n, bad, rate, bound, blocked.

    The three strengths and the mean are four numbers, taken to the driver as one row.
    """
    scratch = Scratch(hosts.sparkSession)
    suffix, domain = suffix_and_domain(F.col("host"), two_label)
    by_host = scratch.keep(outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")).withColumns({"suffix": suffix, "domain": domain}), "by_host")
    by_domain = by_host.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    k_host, k_domain, k_suffix = (x.agg(_strength(x).alias("k")).first()["k"] for x in (by_host, by_domain, by_suffix))
    size = by_suffix.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    outcomes_n = float(size["n"] or 0)
    mean = float(size["bad"]) / outcomes_n if outcomes_n else 0.0
    n, bad = F.coalesce("n", F.lit(0)), F.coalesce("bad", F.lit(0))
    # Each level has a rate and the count of outcomes that it rests on; a prior counts for at most what the level above rests on.
    level = lambda df, prior, rests, k: df.withColumn("_k", F.least(F.lit(float(k)), rests)).withColumns({"_rate": (bad + prior * F.col("_k")) / (n + F.col("_k")), "_rests": n + F.col("_k")})
    whole = F.lit(max(outcomes_n, 1.0))
    suffixes = level(by_suffix, F.lit(mean), whole, k_suffix).select("suffix", F.col("_rate").alias("p_suffix"), F.col("_rests").alias("e_suffix"))
    domains = level(by_domain.join(suffixes, "suffix"), F.col("p_suffix"), F.col("e_suffix"), k_domain).select("domain", F.col("_rate").alias("p_domain"), F.col("_rests").alias("e_domain"), F.col("bad").alias("domain_bad"))
    every = hosts.select("host").distinct().withColumns({"suffix": suffix, "domain": domain})
    joined = every.join(by_host.select("host", "n", "bad"), "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left")
    prior, rests = F.coalesce("p_domain", "p_suffix", F.lit(mean)), F.coalesce("e_domain", "e_suffix", whole)
    posterior = level(joined.withColumns({"_prior": prior, "_prior_rests": rests}), F.col("_prior"), F.col("_prior_rests"), k_host)
    share = F.col("_k") / F.col("_rests")
    variance = F.col("_rate") * (1 - F.col("_rate")) / (F.col("_rests") + 1) + share * share * F.col("_prior") * (1 - F.col("_prior")) / (F.col("_prior_rests") + 1)
    bound = F.col("_rate") - z * F.sqrt(variance)
    limit = F.lit(float(TOLERANCE * mean if most_bad is None else most_bad))
    return posterior.select("host", n.alias("host_n"), bad.alias("host_bad"), F.col("_rate").alias("rate"), bound.alias("bound"), ((bound > limit) & (F.coalesce("domain_bad", F.lit(0)) > 0)).alias("blocked"))


def url_filter(
    pages: DataFrame,
    outcomes: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    outcome_id_col: str = "page_id",
    bad_col: str = "bad",
    rules: Sequence[tuple[str, str, str]] = RULES,
    z: float = Z,
    most_bad: float | None = None,
    two_label: Sequence[str] = TWO_LABEL_SUFFIXES,
) -> DataFrame:
    """Host, path, rule and verdict of every page; hosts without a rule are judged by their reputation.

    ``outcomes`` has (page id, 0/1); it meets the pages by id, in narrow rows.
    """
    narrow = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    judged = narrow.select("id", host.alias("host"), path.alias("path"))
    known = outcomes.select(outcomes[outcome_id_col].alias("oid"), outcomes[bad_col].cast("int").alias("bad")).filter("oid is not null and bad is not null")
    seen = judged.join(known, F.col("id") == F.col("oid")).select("host", "bad")
    reputation = Scratch(pages.sparkSession).keep(host_reputation(seen, judged, z=z, most_bad=most_bad, two_label=two_label), "reputation")
    ruled = judged.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    if reputation.count() <= MOST_BROADCAST:
        joined = ruled.join(F.broadcast(reputation), "host")
    else:
        salted = reputation.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = ruled.withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"])
    return joined.select(
        F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"), F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
        "host_n", "host_bad", F.round("rate", 6).alias("rate"), F.round("bound", 6).alias("bound"),
    )


def url_filter_sql() -> str:
    """DuckDB SQL for ``url_filter`` over pages, labels (quality 0 is bad) and RULES."""
    two = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
    level = f"""count(*)::double as k, sum(n)::double as n, sum(bad)::double as bad, sum(bad * bad / n::double) as sq, sum(1.0 / n) as inv"""
    strength = f"case when k < 2 or n <= 0 or low <= 0 then {STRENGTH[1]} else greatest({STRENGTH[0]}, least({STRENGTH[1]}, top / low)) end"

    def moments(name: str, source: str) -> str:
        return f"""{name} as (select {strength} as v from (select k, n, m * (1 - m) - s2 as top, s2 - m * (1 - m) / k * inv as low
  from (select k, n, bad / n as m, k * (sq - bad * bad / n) / ((k - 1) * n) as s2, inv from (select {level} from {source}))))"""

    cases = "".join(f" when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h}{p}:{v}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    return f"""
with u as (select page_id, case when coalesce(instr(url, '://'), 0) > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
parts as (select *, string_split(name, '.') as s, regexp_matches(name, '{ADDRESS}') as a from (select *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as name from h)),
named as (select page_id, host, path, case when a then name when array_to_string(s[-2:], '.') in ({two}) then array_to_string(s[-2:], '.') else s[-1] end as suffix,
  case when a then name when array_to_string(s[-2:], '.') in ({two}) then array_to_string(s[-3:], '.') else array_to_string(s[-2:], '.') end as domain from parts),
by_host as (select host, suffix, domain, count(*) as n, sum((quality = 0)::int) as bad from named join labels on page_id = doc_id where quality is not null group by all),
by_domain as (select suffix, domain, sum(n) as n, sum(bad) as bad from by_host group by all),
by_suffix as (select suffix, sum(n) as n, sum(bad) as bad from by_domain group by all),
{moments('kh', 'by_host')},
{moments('kd', 'by_domain')},
{moments('ks', 'by_suffix')},
mean as (select coalesce(sum(bad)::double / sum(n)::double, 0) as v, greatest(coalesce(sum(n), 0), 1)::double as whole from by_suffix),
ps as (select suffix, (bad + mean.v * k) / (n + k) as p, n + k as e from (select *, least(ks.v, mean.whole) as k from by_suffix, mean, ks) x, mean),
pd as (select domain, bad, (bad + p * k) / (n + k) as p, n + k as e from (select *, least(kd.v, ps.e) as k from by_domain join ps using (suffix), kd)),
prior as (select x.host, coalesce(b.n, 0) as n, coalesce(b.bad, 0) as bad, coalesce(pd.bad, 0) as domain_bad, coalesce(pd.p, ps.p, mean.v) as p, coalesce(pd.e, ps.e, mean.whole) as e
  from (select distinct host, suffix, domain from named) x left join by_host b using (host) left join pd on pd.domain = x.domain left join ps on ps.suffix = x.suffix, mean),
post as (select *, (bad + p * k) / (n + k) as rate, n + k as total from (select *, least(kh.v, e) as k from prior, kh)),
judged as (select *, case{cases} end as rv from named),
bounded as (select *, rate - {Z} * sqrt(rate * (1 - rate) / (total + 1) + (k / total) * (k / total) * p * (1 - p) / (e + 1)) as bound from post)
select page_id, j.host, path, string_split(rv, ':')[1] as rule, coalesce(string_split(rv, ':')[2], case when bound > {TOLERANCE} * mean.v and domain_bad > 0 then 'block' else 'allow' end) as verdict,
  n::bigint as host_n, bad::bigint as host_bad, round(rate, 6) as rate, round(bound, 6) as bound
from judged j join bounded b on j.host = b.host, mean"""
