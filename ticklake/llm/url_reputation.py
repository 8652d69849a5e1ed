"""URL filter: fixed rules first, empirical-Bayes host reputation for the rest.

Labelled page outcomes (bad or not) are counted per host, registered domain and suffix. Each
level is a beta-binomial whose prior mean is the posterior mean of the level above it and whose
prior strength is fitted over all units of the level by the method of moments. A page that no
rule fits is blocked if the lower bound of its host's posterior bad rate is above a threshold, so
a host with little evidence leans on its domain, and that on its suffix.

DataFrame functions only. Counts are combined on the map side before they are shuffled, so a host
with a third of all pages is one row per task; the join back to the pages is an equi-join that
adaptive execution splits where a host is hot.

Edge cases: a null url or one without ``://`` has empty host and path, fits no rule and is judged
by the counts of the empty host. Hosts without labelled pages get the prior of their domain. With
no outcomes at all every page that no rule blocks is allowed. Repeated rows are judged one by one;
columns of the input that are not named here are ignored. The last label of a host is its suffix
and the last two are its domain; ``long_suffixes`` names public suffixes of two labels (co.uk).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklake.llm.common import join_same

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AFTER_SCHEME = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: (verdict, host and path): the rules of the query.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Lower bound of the bad rate above which a host is blocked, and how many deviations the bound is below the mean.
#: One half: a host goes when most of its pages are bad, even if its labels flatter it by two deviations.
THRESHOLD, DEVIATIONS = 0.5, 2.0
#: Limits of a fitted prior's strength, in pages.
WEAKEST, STRONGEST = 2.0, 10000.0


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), AFTER_SCHEME, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), AFTER_SCHEME, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):  # a longer rule overrides
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def domains(host: Column, long_suffixes: Sequence[str] = ()) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host."""
    two = F.substring_index(host, ".", -2)
    if not long_suffixes:
        return two, F.substring_index(host, ".", -1)
    is_long = two.isin(list(long_suffixes))
    domain = F.when(is_long, F.substring_index(host, ".", -3)).otherwise(two)
    return domain, F.when(is_long, two).otherwise(F.substring_index(host, ".", -1))


def _strength(units: DataFrame) -> DataFrame:
    """One row: the prior strength over units (n, b), by the analysis-of-variance estimate.

    Squares are summed as integers (in millionths), so the result does not depend on the order of
    summation.
    """
    n, b = F.col("n").cast("double"), F.col("b").cast("double")
    sums = units.where("n > 0").agg(
        F.count("*").cast("double").alias("k"),
        F.sum("n").cast("double").alias("nn"),
        F.sum("b").cast("double").alias("bb"),
        (F.sum(F.floor(b * b / n * 1000000.0)).cast("double") / 1000000.0).alias("sq"),
        F.sum(F.floor(n * n / 1.0)).cast("double").alias("n2"),
    )
    between = (F.col("sq") - F.col("bb") * F.col("bb") / F.col("nn")) / (F.col("k") - 1.0)
    within = (F.col("bb") - F.col("sq")) / (F.col("nn") - F.col("k"))
    spread = (F.col("nn") - F.col("n2") / F.col("nn")) / (F.col("k") - 1.0)
    tested = sums.select(
        F.when((F.col("k") > 1) & (F.col("nn") > F.col("k")), F.struct(between.alias("m"), within.alias("w"), spread.alias("s"))).alias("v")
    )
    rho = (F.col("v.m") - F.col("v.w")) / (F.col("v.m") + (F.col("v.s") - 1.0) * F.col("v.w"))
    fitted = F.when(F.col("v.m") > F.col("v.w"), 1.0 / rho - 1.0).otherwise(F.lit(STRONGEST))
    limited = F.least(F.greatest(F.coalesce(fitted, F.lit(STRONGEST)), F.lit(WEAKEST)), F.lit(STRONGEST))
    return tested.select(limited.alias("strength"))


def reputation(hosts: DataFrame, deviations: float = DEVIATIONS, long_suffixes: Sequence[str] = ()) -> DataFrame:
    """(host, n, b) with one row per host -> (host, mean, bound): posterior bad rate and its lower bound."""
    domain, suffix = domains(F.col("host"), long_suffixes)
    by_host = hosts.select("host", "n", "b", domain.alias("domain"), suffix.alias("suffix"))
    count = [F.sum("n").alias("n"), F.sum("b").alias("b")]
    by_domain = by_host.groupBy("domain", "suffix").agg(*count)
    by_suffix = by_host.groupBy("suffix").agg(*count)
    overall = by_host.agg(((F.coalesce(F.sum("b"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("n"), F.lit(0)) + 2.0)).alias("prior"))

    def shrunk(units: DataFrame) -> DataFrame:
        # The one-row fits are broadcast by Spark itself as a nested-loop join against one row.
        k = F.col("strength")
        return units.withColumn("mean", (F.col("b") + k * F.col("prior")) / (F.col("n") + k))

    s = shrunk(by_suffix.join(_strength(by_suffix)).join(overall)).select("suffix", F.col("mean").alias("prior"))
    d = shrunk(by_domain.join(s, "suffix").join(_strength(by_domain))).select("domain", "suffix", F.col("mean").alias("prior"))
    h = shrunk(by_host.join(d, ["domain", "suffix"]).join(_strength(by_host)))
    spread = F.sqrt(F.col("mean") * (1.0 - F.col("mean")) / (F.col("n") + F.col("strength") + 1.0))
    return h.select("host", "mean", (F.col("mean") - F.lit(deviations) * spread).alias("bound"))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    threshold: float = THRESHOLD,
    deviations: float = DEVIATIONS,
    long_suffixes: Sequence[str] = (),
) -> DataFrame:
    """Pages (page_id, url) -> page_id, host, path, rule, verdict, judged_by, mean, bound.

    ``mean`` and ``bound`` are the posterior bad rate of the page's host and its lower bound, whatever judged it.
    ``outcomes`` is (url, bad): labelled pages, bad 1 or 0; rows whose bad is null are no outcome.
    """
    url = F.col("url")
    split = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    seen = outcomes.select(host_of(url).alias("host"), F.col("bad").cast("long").alias("bad")).where("bad is not null")
    # Every host of the pages has a row, also one without outcomes: it gets its domain's prior.
    counts = (
        split.select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("b"))
        .unionByName(seen.select("host", F.lit(1).cast("long").alias("n"), F.col("bad").alias("b")))
        .groupBy("host")
        .agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    )
    judged = join_same(split, reputation(counts, deviations, long_suffixes), ["host"], "left")
    judged = judged.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    by_host = F.when(F.col("bound") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), by_host).alias("verdict"),
        F.when(F.col("_rule").isNull(), F.lit("reputation")).otherwise(F.lit("rule")).alias("judged_by"),
        "mean",
        "bound",
    )


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of the pages whose source document is labelled.

    A page's url ends in the number of the document that it shows; a document is bad if any of its
    labels says low quality or toxic. Only the two id columns and the labels are read.
    """
    verdict = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(
        F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0
    )
    bad = labels.select("doc_id", verdict.alias("bad")).where("doc_id is not null").groupBy("doc_id").agg(F.max("bad").alias("bad"))
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[A-Za-z]+)?/?$", 1)
    shown = pages.select("url", F.when(number != "", number).cast("long").alias("doc_id"))
    return shown.where("doc_id is not null").join(bad, "doc_id").select("url", "bad")

