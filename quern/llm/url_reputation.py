"""URL filter by empirical-Bayes host reputation, in DataFrame operations only.

A labelled page outcome is bad where its document has low quality or is toxic. Bad counts of a host are
shrunk through beta-binomial priors: suffix towards the whole table, registered domain towards
its suffix, host towards its domain. Each level's prior strength comes from the overdispersion
of its members around their parents' means. A host is blocked if the lower bound of its posterior
bad rate exceeds ``lift`` times the bad rate of the whole table: with a lift of 1, if it is worse than the table
with 95 % certainty. Explicit rules come first.

A page shows the document whose id is the number at the end of its url's path.

Defined results: host and path of a null url, or of one without ``://``, are empty, and the empty host is a host
like any other to the method, while no rule fits it; long urls are read whole; pages without a label (or with null labels)
only count as pages; labels of one document that occur twice count once, as the worst of them;
rules that tie in length go by the longer host, then block before allow; repeated pages each get their
row; other columns, whatever their names, are ignored; empty tables give no rows; without any label no host is blocked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: The document that a page shows: the number at the end of its path.
NUMBER = r"/([0-9]{1,18})(?:\.[A-Za-z0-9]{1,16})?/?$"
#: Suffixes of two labels unless others are given (see ``read_suffixes``); any other suffix is one label.
DOUBLE = ("co.uk", "com.au", "co.jp", "com.br")
#: z of the one-sided 95 % bound, and how many times the table's bad rate it must exceed to block.
Z, LIFT = 1.6449, 1.0
MOST_RULES, MOST_SUFFIXES = 1000, 20_000
#: Hosts that are broadcast at most, some 100 bytes each; more are joined by shuffle.
FEW_HOSTS = 100_000


def host_of(url: str | Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def shown_document(url: str | Column) -> Column:
    """The id of the document that a page shows, by its url; null without one."""
    number = F.regexp_extract(path_of(url), NUMBER, 1)
    return F.when(number != "", number).cast("long")


def read_suffixes(spark: SparkSession, path: str) -> list[str]:
    """Suffixes of two labels from a file in the public suffix list's form: one on a line, comments begin with //."""
    lines = spark.read.text(path).select(F.trim("value").alias("x")).where(F.col("x").rlike(r"^[^/!*\s.]+[.][^/\s.]+$")).distinct().limit(MOST_SUFFIXES + 1).collect()
    if len(lines) > MOST_SUFFIXES:
        raise ValueError(f"more than {MOST_SUFFIXES} suffixes")
    return sorted(r.x for r in lines)


def suffix_sql(host: str, double: Sequence[str] = DOUBLE) -> str:
    """Last label of a host without user and port, or last two where these are a known suffix."""
    bare = f"regexp_replace(regexp_replace({host}, '^.*@', ''), ':[0-9]*$', '')"
    known = ", ".join(f"'{x}'" for x in double) or "NULL"
    two = f"regexp_extract({bare}, '([^.]{{1,63}}[.][^.]{{1,63}})$', 1)"
    return f"CASE WHEN {two} IN ({known}) THEN {two} ELSE regexp_extract({bare}, '([^.]{{0,63}})$', 1) END"


def domain_sql(host: str, double: Sequence[str] = DOUBLE) -> str:
    """The suffix and the label before it; an address in numbers is its own domain."""
    bare = f"regexp_replace(regexp_replace({host}, '^.*@', ''), ':[0-9]*$', '')"
    known = ", ".join(f"'{x}'" for x in double) or "NULL"
    two = f"regexp_extract({bare}, '([^.]{{1,63}}[.][^.]{{1,63}})$', 1)"
    three = f"regexp_extract({bare}, '([^.]{{1,63}}[.][^.]{{1,63}}[.][^.]{{1,63}})$', 1)"
    return f"CASE WHEN regexp_extract({bare}, '^([0-9.]+)$', 1) <> '' THEN {bare} WHEN {two} IN ({known}) AND {three} <> '' THEN {three} WHEN {two} <> '' THEN {two} ELSE {bare} END"


def digamma_sql(x: str) -> str:
    """By recurrence to x + 6, then the asymptotic series."""
    y = f"({x} + 6)"
    return f"(ln{y} - 1 / (2 * {y}) - 1 / (12 * {y} * {y}) + 1 / (120 * {y} * {y} * {y} * {y}) - " + " - ".join(f"1 / ({x} + {i})" for i in range(6)) + ")"


def trigamma_sql(x: str) -> str:
    y = f"({x} + 6)"
    return f"(1 / {y} + 1 / (2 * {y} * {y}) + 1 / (6 * {y} * {y} * {y}) - 1 / (30 * {y} * {y} * {y} * {y} * {y}) + " + " + ".join(f"1 / (({x} + {i}) * ({x} + {i}))" for i in range(6)) + ")"


def lower_bound_sql(a: str, b: str) -> str:
    """Lower bound of Beta(a, b), its log-odds taken as normal with their exact mean and variance."""
    return f"1 / (1 + exp({Z} * sqrt({trigamma_sql(a)} + {trigamma_sql(b)}) - ({digamma_sql(a)} - {digamma_sql(b)})))"


def rule_column(host: Column, path: Column, rules: list[tuple[str, str]], pick: int) -> Column:
    """Of the longest fitting rule, its action (pick 0) or its text (pick 1); else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out = F.lit(None).cast("string")
    cut = lambda r: (r.partition("/")[0], "/" + r.partition("/")[2])
    for rule in sorted(rules, key=lambda r: (len(r[1]), len(cut(r[1])[0]), r[0] == "block")):
        end, start = cut(rule[1])
        fits = ((host == end) | host.endswith(f".{end}")) & path.startswith(start)
        out = F.when(fits, F.lit(rule[pick])).otherwise(out)
    return out


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``host, n, bad`` of every host: labelled pages and how many of them are bad."""
    worst = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy(F.col("doc_id").alias("shown")).agg(F.max(F.expr("CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END")).alias("is_bad"))
    seen = pages.select(host_of("url").alias("host"), shown_document("url").alias("shown"))
    # many pages of a host may show one document; hosts are counted before and after the join
    counted = seen.groupBy("host", "shown").agg(F.count(F.lit(1)).alias("pages"))
    return counted.join(worst, "shown", "left").groupBy("host").agg(F.sum(F.when(F.col("is_bad").isNotNull(), F.col("pages")).otherwise(0)).alias("n"), F.sum(F.coalesce(F.col("is_bad") * F.col("pages"), F.lit(0))).alias("bad"))


def strength(members: DataFrame) -> float:
    """Prior strength of a level: from its members' ``n, bad`` and their parents' mean ``m``."""
    got = members.where("n > 0 AND m > 0 AND m < 1").agg(F.expr("sum(n * pow(bad / n - m, 2) / (m * (1 - m)))").alias("q"), F.expr("sum(n - 1)").alias("room"), F.count(F.lit(1)).alias("k")).first()
    spread = (got.q - got.k) / got.room if got.room else 0.0
    return 1 / min(max(spread, 1e-4), 0.5) - 1


def reputation(pages: DataFrame, labels: DataFrame, double: Sequence[str] = DOUBLE) -> tuple[DataFrame, float, int]:
    """``host, n, bad, bound``: of every host of ``pages`` the lower bound of its posterior bad rate; the table's bad rate, and how many hosts there are.

    Only sums over the levels reach the driver. Without labels the rate is 1.
    """
    hosts = stored(outcomes(pages, labels).select("host", F.expr(domain_sql("host", double)).alias("domain"), F.expr(suffix_sql("host", double)).alias("suffix"), "n", "bad"), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("hosts")).first()
    mean = (total.bad + 0.5) / (total.n + 1) if total.n else 0.0
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("m", F.lit(mean))
    k = strength(suffixes)
    suffixes = suffixes.select("suffix", ((F.col("bad") + k * F.col("m")) / (F.col("n") + k)).alias("m"))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(suffixes, "suffix")
    k = strength(domains)
    domains = domains.select("domain", ((F.col("bad") + k * F.col("m")) / (F.col("n") + k)).alias("m"))
    members = hosts.join(domains, "domain")
    k = strength(members)
    sides = members.select("host", "n", "bad", (F.col("bad") + k * F.col("m") + 1e-6).alias("a"), (F.col("n") - F.col("bad") + k * (1 - F.col("m")) + 1e-6).alias("b"))
    return sides.select("host", "n", "bad", F.expr(lower_bound_sql("a", "b")).alias("bound")), mean if total.n else 1.0, total.hosts


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], lift: float = LIFT, double: Sequence[str] = DOUBLE) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and the host's labelled pages, bad pages and bound, for every page."""
    known, base, hosts = reputation(pages.select("url"), labels, double)
    own = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    own = own.withColumns({"rule": rule_column(F.col("host"), F.col("path"), rules, 1), "action": rule_column(F.col("host"), F.col("path"), rules, 0)})
    method = F.when(F.col("bound") > lift * base, "block").otherwise("allow")
    # a host may have a third of all pages: few hosts are sent to the pages, many are joined so that large partitions can be split
    found = own.join(F.broadcast(known) if hosts <= FEW_HOSTS else known, "host", "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("action", method).alias("verdict"), F.col("n").alias("host_labelled"), F.col("bad").alias("host_bad"), "bound")
