"""URL filters: a list of rules, and for all other pages the reputation of their host.

Reputation is empirical Bayes. The share of bad pages among a host's labelled pages is shrunk
towards that of its registered domain, that towards its suffix, that towards all pages. At each
level the prior is a beta distribution around the parent's mean; how strongly it pulls is
estimated from the spread of the groups (beta-binomial, by moments), and it pulls less where the
parent itself is known by few pages. A page is blocked if even the lower bound of its host's
posterior is above the limit.

Defined results: a null URL, or one without "://", has an empty host and path; such pages count as
one host. Labels that are null do not count; a page with several label rows counts once for each.
Without any labels the verdict is allow. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.tables import kept_as
from rosterloom.workspace import work_folder

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block"))
# Suffixes of two labels under which names are registered.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
LEVELS = ("suffix", "domain", "host")
# A host with more than one of so many equal shares of the pages is spread over as many parts as
# it has shares. Fewer hosts than shares can have more than one, so their list can be broadcast.
SHARES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, parts, i), F.lit("")) for i in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def domain_and_suffix(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """The registered domain and the suffix under which it is registered."""
    last = F.substring_index(host, ".", -2)
    double = last.isin(*suffixes)
    return (F.when(double, F.substring_index(host, ".", -3)).otherwise(last),
            F.when(double, last).otherwise(F.substring_index(host, ".", -1)))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does.

    The rules are few and become one CASE expression.
    """
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return found, verdict


def host_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, domain, suffix, n, bad) over labelled pages. A page is bad if it is labelled of
    no quality or toxic; `labels` names a page by its id."""
    host, _ = host_and_path(F.col("url"))
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False)))
    known = labels.filter("quality IS NOT NULL OR toxic IS NOT NULL").select(
        F.col("doc_id").alias("page_id"), bad.cast("bigint").alias("bad"))
    counts = (pages.select("page_id", host.alias("host")).join(known, "page_id")
              .groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")))
    domain, suffix = domain_and_suffix(F.col("host"))
    return counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad")


def pull(groups: DataFrame) -> float:
    """How many pages the parent's mean m is worth, from (n, bad, m) of all groups.

    Over the groups, n (bad/n - m)^2 / (m (1 - m)) is expected to sum to their number plus
    rho times the sum of n - 1; the pull is 1/rho - 1.
    """
    x = F.col("bad") / F.col("n") - F.col("m")
    sums = groups.filter("n > 0").agg(
        F.sum(F.col("n") * x * x / (F.col("m") * (1 - F.col("m")))).alias("spread"),
        F.count("*").alias("groups"), F.sum(F.col("n") - 1).alias("free")).first()
    rho = (sums["spread"] - sums["groups"]) / sums["free"] if sums["free"] else 0.5
    return 1 / min(max(rho, 1e-3), 0.5) - 1


def strength(pull_: float, parent: Column) -> Column:
    """Pages that a prior is worth: variances of the group around its parent and of what is known
    of the parent add up."""
    return F.lit(1.0) / (F.lit(1 / pull_) + F.lit(1.0) / parent)


def reputation(outcomes: DataFrame) -> tuple[dict[str, DataFrame], tuple[float, float], dict[str, float]]:
    """Per level a table (level, n, bad, mean, worth) of posteriors, the mean and the worth of all
    pages, and the pulls.

    The driver gets four sums and three pulls; the tables stay distributed.
    """
    sums = outcomes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((sums["bad"] or 0) + 0.5) / ((sums["n"] or 0) + 1.0), (sums["n"] or 0) + 1.0
    tables, pulls, above = {}, {}, None
    for level, parent in zip(LEVELS, (None, *LEVELS)):
        keys = [level] + [parent] * (parent is not None)
        groups = outcomes.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        if above is None:
            groups = groups.select("*", F.lit(overall[0]).alias("m"), F.lit(overall[1]).alias("known"))
        else:
            groups = groups.join(above.select(parent, F.col("mean").alias("m"), F.col("worth").alias("known")), parent)
        pulls[level] = pull(groups)
        groups = groups.withColumn("k", strength(pulls[level], F.col("known")))
        above = groups.withColumn("mean", F.expr("(k * m + bad) / (k + n)")).withColumn("worth", F.expr("k + n"))
        tables[level] = above.select(level, "n", "bad", "mean", "worth")
    return tables, overall, pulls


def judge_pages(pages: DataFrame, labels: DataFrame, rules=RULES, limit: float = 0.5,
                z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict, and the lower bound of the host's share of bad pages."""
    outcomes = kept_as(host_outcomes(pages, labels), work_folder(pages.sparkSession, "outcomes"))
    tables, overall, pulls = reputation(outcomes)
    host, path = host_and_path(F.col("url"))
    domain, suffix = domain_and_suffix(F.col("host"))
    rule, says = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).select(
        "*", domain.alias("domain"), suffix.alias("suffix"), rule.alias("rule"), says.alias("says"))
    hosts = kept_as(rows.groupBy("host", "domain", "suffix").agg(F.count("*").alias("pages")),
                    work_folder(pages.sparkSession, "hosts"))
    total = hosts.agg(F.sum("pages").alias("pages")).first()["pages"] or 0
    parts = F.ceil(F.col("pages") * SHARES / F.lit(max(total, 1))).cast("bigint")
    for level in LEVELS:
        one = tables[level].select(level, *[F.col(c).alias(f"{level}_{c}") for c in ("n", "bad", "mean", "worth")])
        hosts = hosts.join(one, level, "left")
    parent = F.coalesce("domain_mean", "suffix_mean", F.lit(overall[0]))
    of_suffix = F.coalesce("suffix_worth", strength(pulls["suffix"], F.lit(overall[1])))
    k = strength(pulls["host"], F.coalesce("domain_worth", strength(pulls["domain"], of_suffix)))
    a = k * parent + F.coalesce("host_bad", F.lit(0))
    b = k * (1 - parent) + F.coalesce("host_n", F.lit(0)) - F.coalesce("host_bad", F.lit(0))
    known = hosts.select("host", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"),
                         a.alias("a"), b.alias("b")).select(
        "host", "part", (F.expr("a / (a + b)") - F.lit(z) * F.sqrt(F.expr("a * b / ((a + b) * (a + b) * (a + b + 1))"))).alias("bound"))
    hot = hosts.select("host", parts.alias("parts")).filter("parts > 1")
    spread = rows.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(hot), "host", "left")
    judged = spread.withColumn("part", F.expr("pmod(row, coalesce(parts, 1))")).join(known, ["host", "part"])
    verdict = F.coalesce("says", F.when(F.col("bound") > limit, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "bound")
