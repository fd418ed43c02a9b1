"""URL filter: fixed rules first, else the reputation of the host.

Labelled page outcomes are counted by host. A host's rate of bad pages is shrunk towards that of its registered domain,
which is shrunk towards that of its suffix, which is shrunk towards the rate of all. Each level's prior is a beta whose
strength is found from the spread of the groups' rates on that level (method of moments of the beta-binomial). A page is
blocked if even the lower bound of the host's posterior rate is above the limit.

Pages are counted by host before anything moves, so a host with a third of all pages is one row of counts.

Defined cases: a null address and one without ``://`` have an empty host and path and are judged by the rate of all; null
ids and null outcomes do not count; a page labelled twice counts once, as bad if either label is; repeated pages are
judged one by one; without any label nothing is blocked but by rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratespark.llm.text import stored

#: The rules of the list: host and path, verdict. The longest that fits wins.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Suffixes of two labels under which domains are registered (fixed values).
DOUBLE_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in", "com.cn", "com.mx")
LIMIT = 0.5
DEVIATIONS = 1.645
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0
LEVELS = ("host", "domain", "suffix")


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(F.coalesce(after, F.lit("")), "^([^/?#]*)", 1)
    rest = F.substring(after, F.length(host) + 1, F.length(after))
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), "^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def registered_domain(host: Column) -> Column:
    """The suffix and one label; an address of digits, a single label and an empty host are their own domain."""
    return F.when(host.rlike(r"^[0-9.:\[\]]*$"), host).otherwise(
        F.when(F.substring_index(host, ".", -2).isin(*DOUBLE_SUFFIXES), F.substring_index(host, ".", -3))
        .otherwise(F.substring_index(host, ".", -2))
    )


def suffix(host: Column) -> Column:
    return F.when(host.rlike(r"^[0-9.:\[\]]*$"), F.lit("")).otherwise(
        F.when(F.substring_index(host, ".", -2).isin(*DOUBLE_SUFFIXES), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))
    )


def prior_strength(counts: DataFrame, level: str) -> float:
    """The prior strength for groups of ``level``, from the spread of their rates beyond chance."""
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    sums = counts.groupBy(level).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).agg(
        F.count("*"), F.sum(n), F.sum(bad), F.sum(n * n), F.sum(bad * bad / n)
    )
    groups, pages, bad_pages, squares, scatter = sums.first()
    if not groups:
        return STRONGEST
    rate = bad_pages / pages
    chance = rate * (1 - rate)
    # The expected scatter is pages rate^2 + chance ((groups - 1) + rho (pages - squares / pages - (groups - 1))).
    room = chance * (pages - squares / pages - (groups - 1))
    rho = (scatter - pages * rate * rate - (groups - 1) * chance) / room if room > 0 else 0.0
    return min(max(1 / rho - 1, WEAKEST), STRONGEST) if rho > 0 else STRONGEST


def posterior(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """By host the posterior ``rate`` of bad pages and its ``lower`` bound, for ``hosts`` (host, domain, suffix).

    ``counts`` has n > 0 labelled pages and the bad ones by host; hosts without labels take what stands above them.
    """
    pages, bad = counts.agg(F.sum("n"), F.sum("bad")).first()
    rate = F.lit(bad / pages if pages else 0.0)
    rated = hosts.select("host", "domain", "suffix")
    for level in reversed(LEVELS):
        sums = counts.groupBy(F.col(level).alias("__group")).agg(F.sum("n").alias("__n"), F.sum("bad").alias("__bad"))
        strength = prior_strength(counts, level)
        weight = F.coalesce("__n", F.lit(0)) + strength
        shrunk = (F.coalesce("__bad", F.lit(0)) + strength * rate) / weight
        rated = rated.join(sums, F.col(level) == F.col("__group"), "left").select(
            "host", "domain", "suffix", shrunk.alias("rate"), weight.alias("weight")
        )
        rate = F.col("rate")
    deviation = F.sqrt(rate * (1 - rate) / (F.col("weight") + 1))
    return rated.select("host", "rate", (rate - DEVIATIONS * deviation).alias("lower"))


def judged(pages: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule and verdict for every page.

    A labelled page is bad if its label says low quality or toxic; ``labels`` has the page's id in ``doc_id``.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    marks = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy(F.col("doc_id").alias("__id")).agg(
        F.max(F.when((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1), 1).otherwise(0)).alias("bad")
    )
    marked = rows.select("page_id", "host").distinct().join(marks, F.col("page_id") == F.col("__id"), "left")
    counts = marked.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    counts = stored(counts.select("*", registered_domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix")))
    rated = posterior(counts, counts.where("n > 0")).select(F.col("host").alias("__host"), "lower")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"))
    method = F.when(F.col("lower") > limit, "block").otherwise("allow")
    return rows.join(rated, F.col("host") == F.col("__host"), "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict")
    )
