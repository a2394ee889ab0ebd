"""URL filter by rules and by the reputation of hosts, in empirical Bayes.

Labelled pages are counted by host.  A host's share of good pages has a beta prior whose
mean is its registered domain's posterior mean, the domain's prior comes from its public
suffix, and the suffix's from all pages.  How strong the priors are is estimated on each
level from how much the children of a parent differ beyond chance (Pearson's statistic of
the beta-binomial), is at most that of the parent's own posterior, and stands for a limited number of
pages: where hardly any host is bad, the estimate alone would let no evidence of its own block one.  A host is blocked if even the upper bound of its posterior is
below the wanted share.  All of it is aggregations and joins of DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.workspace import written

#: Rule (host/path) and verdict.
Rule = tuple[str, str]

#: Least share of good pages, and standard deviations from the posterior's mean to its bound.
MIN_GOOD = 0.5
BOUND = 1.645
#: Limits of a prior's strength, in pages.
STRENGTH = (1.0, 1e6)

#: A verdict's priors stand for so many pages at most.
MOST_PRIOR_PAGES = 20.0

#: Public suffixes of two labels; every other last label is one by itself.
TWO_LABEL_SUFFIXES = (
    "ac.jp ac.uk co.in co.jp co.kr co.nz co.uk co.za com.ar com.au com.br com.cn com.hk com.mx com.sg com.tr com.tw "
    "edu.au go.jp gov.au gov.uk ne.jp net.au net.uk or.jp org.au org.uk"
).split()

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, in small ASCII letters; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), _CAPITALS, _SMALL)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def registered_name(host: Column) -> Column:
    """The host without a user, a port and dots at its end, which say nothing of who owns it."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.*(?::[0-9]*)?$", "")


def _is_address(name: Column) -> Column:
    return name.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\[")


def _suffix_labels(name: Column, suffixes: Sequence[str]) -> Column:
    """How many labels the longest suffix of the list has that the name ends with; 1 if none does."""
    found = F.lit(1)
    for count in sorted({s.count(".") + 1 for s in suffixes} - {1}):
        of_length = [s for s in suffixes if s.count(".") + 1 == count]
        found = F.when(F.substring_index(name, ".", -count).isin(of_length), F.lit(count)).otherwise(found)
    return found


def suffix_of(host: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The longest suffix of the list that the host ends with, else its last label; an address has none."""
    name = registered_name(host)
    labels = _suffix_labels(name, suffixes)
    found = F.substring_index(name, ".", -1)
    for count in sorted({s.count(".") + 1 for s in suffixes} - {1}):
        found = F.when(labels == count, F.substring_index(name, ".", -count)).otherwise(found)
    return F.when(_is_address(name), F.lit("")).otherwise(found)


def domain_of(host: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The public suffix and the label before it; an address is a domain by itself."""
    name = registered_name(host)
    labels = _suffix_labels(name, suffixes)
    found = F.substring_index(name, ".", -2)
    for count in sorted({s.count(".") + 1 for s in suffixes} - {1}):
        found = F.when(labels == count, F.substring_index(name, ".", -count - 1)).otherwise(found)
    return F.when(_is_address(name), name).otherwise(found)


def _fits(rule: str, host: Column, path: Column) -> Column:
    name, slash, rest = rule.partition("/")
    return ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)


def rule_for(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits the host, or a parent of it, and the start of the path; else null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), len(r[0].partition("/")[0]), r[0])):
        found = F.when(_fits(rule, host, path), F.lit(rule)).otherwise(found)
    return found


def _strength(children: DataFrame) -> float:
    """The prior's strength from ``n``, ``good`` and the parent's ``mean`` of each child.

    Children that differ no more than chance explains give the greatest strength, and so
    does a level without two pages under any child.
    """
    spread = F.col("n") * F.col("mean") * (1 - F.col("mean"))
    told = children.filter((F.col("n") > 0) & (F.col("mean") > 0) & (F.col("mean") < 1))
    excess, pairs = told.agg(
        F.sum(F.pow(F.col("good") - F.col("n") * F.col("mean"), 2) / spread) - F.count("*"), F.sum(F.col("n") - 1)
    ).first()
    if not pairs or excess is None or excess <= 0:
        return STRENGTH[1]
    share = min(excess / pairs, 1.0)
    return min(max(1 / share - 1, STRENGTH[0]), STRENGTH[1])


def _with_posterior(level: DataFrame, strength: float) -> DataFrame:
    """Add ``posterior`` and ``weight``, the pages it stands for; a prior is never surer than its parent."""
    held = level.withColumn("_m", F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(strength), "backing")))
    mean = (F.col("_m") * F.col("prior") + F.col("good")) / (F.col("_m") + F.col("n"))
    return held.withColumn("posterior", mean).withColumn("weight", F.col("_m") + F.col("n")).drop("_m")


def reputations(
    judged: DataFrame, bound: float = BOUND, most_prior_pages: float = STRENGTH[1], suffixes: Sequence[str] = TWO_LABEL_SUFFIXES
) -> DataFrame:
    """``host``, ``n``, ``good``, ``posterior`` and ``upper`` of every host of ``judged(host, good)``.

    ``good`` is 1 or 0, or null for a page without a label.  The tables of hosts, domains and
    suffixes stay distributed; the driver sees two sums a level.  Without any label all
    posteriors are 1.
    """
    hosts = judged.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    levels = domain_of(F.col("host"), suffixes).alias("domain"), suffix_of(F.col("host"), suffixes).alias("suffix")
    hosts = written(hosts.select("*", *levels), "hosts")
    total, good = hosts.agg(F.sum("n"), F.sum("good")).first()
    overall = good / total if total else 1.0

    def strength(level: DataFrame) -> float:
        return min(_strength(level), most_prior_pages)

    def counted(*keys: str) -> DataFrame:
        return hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))

    def below(level: DataFrame, parents: DataFrame, key: str) -> DataFrame:
        """Children with the raw share of their parent as ``mean`` and its posterior as ``prior``."""
        parent = parents.select(
            key, F.when(F.col("n") > 0, F.col("good") / F.col("n")).alias("mean"), F.col("posterior").alias("prior"),
            F.col("weight").alias("backing"),
        )
        return written(level.join(parent, key), f"{key}-children")

    tops = counted("suffix").select("*", *[F.lit(overall).alias(c) for c in ("mean", "prior")])
    tops = tops.withColumn("backing", F.lit(float(total or 0)))
    tops = written(_with_posterior(tops, strength(tops)), "suffixes")
    domains = below(counted("suffix", "domain"), tops, "suffix")
    domains = _with_posterior(domains, strength(domains)).drop("mean", "prior", "backing")
    leaves = below(hosts, domains, "domain")
    leaves = _with_posterior(leaves, strength(leaves))
    deviation = F.sqrt(F.col("posterior") * (1 - F.col("posterior")) / (F.col("weight") + 1))
    return leaves.select("host", "n", "good", "posterior", (F.col("posterior") + bound * deviation).alias("upper"))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[Rule],
    url_col: str = "url",
    key_col: str = "key",
    min_good: float = MIN_GOOD,
    bound: float = BOUND,
    most_prior_pages: float = MOST_PRIOR_PAGES,
    suffixes: Sequence[str] = TWO_LABEL_SUFFIXES,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``upper``; such columns are replaced.

    ``outcomes(key, good)`` labels pages by the value of ``key_col``: 1 good, 0 bad; nulls
    are left out and of several labels of one key the higher counts.  The verdict is
    the rule's if one fits, else ``block`` if the host's upper bound is below
    ``min_good``, else ``allow``.  A null url, or one without ``://``, has an empty host and path;
    pages without a host share the reputation of the empty one.  Repeated rows are all
    judged and all counted.  ``suffixes`` are the public suffixes of more than one label, as many
    as are wanted; hosts under one that is not listed are taken for one registered domain.
    """
    own = ["host", "path", "rule", "verdict", "upper"]
    split = pages.select(*[c for c in pages.columns if c not in own], host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    told = outcomes.filter("key is not null and good is not null").groupBy("key").agg(F.max("good").alias("good"))
    keyed = split.select("host", F.col(key_col).alias("key"))
    judged = keyed.join(told, "key", "left").select("host", "good")
    found = written(reputations(judged, bound, most_prior_pages, suffixes), "reputations").select("host", "upper")
    ruled = split.withColumn("rule", rule_for(rules, F.col("host"), F.col("path")))
    blocked = [rule for rule, verdict in rules if verdict == "block"]
    verdict = F.when(F.col("rule").isin(blocked), "block").when(F.col("rule").isNotNull(), "allow")
    verdict = verdict.when(F.col("upper") < min_good, "block").otherwise("allow")
    return ruled.join(found, "host", "left").withColumn("verdict", verdict)
