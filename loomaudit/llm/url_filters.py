"""URL filters: rules, and an empirical-Bayes reputation of hosts.

Labelled page outcomes are counted by host. The rate of bad pages is shrunk
from level to level: a suffix towards the overall rate, a registered domain
towards its suffix, a host towards its domain, each by a beta-binomial prior.
A prior's strength comes from the spread of the rates of a level around those
of the level above (method of moments). A host is blocked if the lower bound of
its posterior rate is above LIMIT. A rule that fits a URL overrides this.

Suffixes are the last label, or the last two where they are one of `suffixes`;
SUFFIXES holds the common ones, and a caller may pass the full public list. A
port is no part of them, and an address of numbers is its own domain.

A null URL, or one without "://", has an empty host and path; it shares the
reputation of the empty host. Null outcomes don't count, and without outcomes
nothing is blocked but by rules. Rows that repeat are judged each. Of rules of
equal length the alphabetically last host and path, then verdict, decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomaudit.llm.common import hinted, small_enough, written

#: Common suffixes of two labels.
SUFFIXES = tuple(
    "ac.at co.at gv.at or.at com.ar gob.ar net.ar org.ar com.au edu.au gov.au id.au net.au org.au com.bd com.br edu.br gov.br net.br org.br ac.cn com.cn edu.cn gov.cn net.cn org.cn com.co "
    "edu.co gov.co com.cy com.ec com.eg com.gh com.gr com.gt com.hk edu.hk gov.hk org.hk co.id ac.id go.id or.id ac.il co.il gov.il org.il ac.in co.in edu.in gov.in net.in org.in ac.ir co.ir "
    "ac.jp co.jp ed.jp go.jp ne.jp or.jp ac.ke co.ke go.ke or.ke ac.kr co.kr go.kr or.kr re.kr com.kw com.lb com.mt com.mx edu.mx gob.mx org.mx com.my edu.my gov.my com.ng gov.ng org.ng "
    "ac.nz co.nz geek.nz govt.nz net.nz org.nz school.nz com.pe gob.pe com.ph edu.ph gov.ph com.pk edu.pk gov.pk com.pl edu.pl gov.pl net.pl org.pl com.pt com.py com.qa com.ru com.sa edu.sa "
    "gov.sa com.sg edu.sg gov.sg com.tr edu.tr gov.tr org.tr com.tw edu.tw gov.tw org.tw ac.th co.th go.th or.th com.ua gov.ua org.ua ac.uk co.uk gov.uk ltd.uk me.uk net.uk nhs.uk org.uk "
    "plc.uk sch.uk com.uy com.ve com.vn edu.vn gov.vn ac.za co.za gov.za org.za".split()
)
#: Hosts whose verdicts may be broadcast, so that no page is shuffled; beyond, the join is shuffled and adaptive execution splits hot hosts.
BROADCAST_HOSTS = 200_000
LIMIT = 0.5
#: Standard deviations below the posterior mean at which the bound lies.
BOUND_Z = 1.645
LEAST_RHO, MOST_RHO = 0.001, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and the paths that start so."""

    host: str
    path: str
    verdict: str


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """What lies between the first :// and the next /, ? or #; A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _name(host: Column) -> Column:
    return F.regexp_replace(host, r":\d*$", "")


def _is_address(name: Column) -> Column:
    return name.rlike(r"^\d+\.\d+\.\d+\.\d+$") | name.startswith("[")


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The last label, or the last two where they are one of suffixes; an address of numbers as it is."""
    name = _name(host)
    two = F.substring_index(name, ".", -2)
    return F.when(_is_address(name), name).when(two.isin(*suffixes), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The suffix and one label more; the host where it has no more."""
    name = _name(host)
    two = F.substring_index(name, ".", -2)
    return F.when(_is_address(name), name).when(two.isin(*suffixes), F.substring_index(name, ".", -3)).otherwise(two)


def _strength(groups: DataFrame) -> float:
    """The prior's size in observations, from groups (n, bad, above): the observations, the bad ones, and the rate that the groups vary around."""
    spread = F.col("above") * (1 - F.col("above"))
    off = F.col("bad") / F.col("n") - F.col("above")
    x = groups.where("n > 0").agg(F.sum(F.col("n") * off * off).alias("s"), F.sum(spread).alias("v"), F.sum(spread * (F.col("n") - 1)).alias("w")).first()
    rho = min(MOST_RHO, max(LEAST_RHO, (x["s"] - x["v"]) / x["w"])) if x["w"] and x["w"] > 0 else LEAST_RHO
    return (1 - rho) / rho


def _shrunk(groups: DataFrame, rate: str) -> tuple[DataFrame, float]:
    """groups (n, bad, above) with their posterior mean, and the strength of the prior."""
    strength = _strength(groups)
    return groups.withColumn(rate, (F.col("bad") + strength * F.col("above")) / (F.col("n") + strength)).drop("above"), strength


def reputation(hosts: DataFrame, outcomes: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(host, n, bad, rate, bound) for each of hosts (host, repeats allowed), from outcomes (host, bad: 0 or 1; null outcomes don't count)."""
    seen = outcomes.where("bad is not null").select("host", F.lit(1).cast("bigint").alias("n"), F.col("bad").cast("bigint").alias("bad"))
    none = F.lit(0).cast("bigint")
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    counted = seen.unionByName(hosts.select("host", none.alias("n"), none.alias("bad"))).groupBy("host").agg(*sums)
    by_host = written(counted.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}), "hosts")
    by_domain = written(by_host.groupBy("domain", "suffix").agg(*sums), "domains")
    by_suffix = written(by_domain.groupBy("suffix").agg(*sums), "suffixes")
    total = by_suffix.agg(*sums).first()
    mean = total["bad"] / total["n"] if total["n"] else 0.0
    of_suffix, _ = _shrunk(by_suffix.withColumn("above", F.lit(mean)), "rate")
    of_domain, _ = _shrunk(by_domain.join(of_suffix.select("suffix", F.col("rate").alias("above")), "suffix"), "rate")
    domain_rates = written(of_domain.select("domain", F.col("rate").alias("above")), "domain-rates")
    of_host, strength = _shrunk(by_host.join(domain_rates, "domain"), "rate")
    return of_host.select("host", "n", "bad", "rate").withColumn("bound", F.col("rate") - BOUND_Z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + strength + 1)))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules: those that fit the host or a parent of it), from rules (rule_host, rule_path, verdict)."""
    labels = F.split("host", r"\.")
    parents = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("rule_host"))
    text = F.concat("rule_host", "rule_path")
    return parents.join(rules, "rule_host").groupBy("host").agg(F.collect_list(F.struct(F.length(text).alias("length"), text.alias("rule"), F.col("rule_path").alias("path"), F.col("verdict").alias("verdict"))).alias("rules"))


def judged(urls: DataFrame, outcomes: DataFrame, rules: list[Rule], key: str = "page_id", suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(key, host, path, rule, verdict) for urls (key, url); of the rules that fit, the longest decides."""
    spark = urls.sparkSession
    parts = urls.select(F.col(key).alias("key"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    table = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "rule_host string, rule_path string, verdict string")
    known = written(reputation(parts.select("host"), outcomes, suffixes).select("host", F.when(F.col("bound") > LIMIT, "block").otherwise("allow").alias("by_reputation")), "host-verdicts")
    of_host = known.join(host_rules(known, table), "host", "left")
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))
    chosen = parts.join(hinted(of_host, small_enough(known, BROADCAST_HOSTS)), "host").withColumn("best", best)
    return chosen.select(F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.col("by_reputation")).alias("verdict"))
