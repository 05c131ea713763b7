"""URL rules indexed by their rarest literal token.

A rule names a host (it and all its subdomains) and the start of a path; ``*`` stands for any run inside a host. From each
rule come a regular expression and the literal tokens that every URL it fits must contain. How many URLs contain each of
these tokens is counted over all URLs, and a rule is indexed under the rarest. A URL's tokens fetch candidate rules by an
equality join, and only those run their expression on it. A rule without a whole literal token is indexed under the empty
token, which every URL has.

The subject of a rule is the host (A-Z lower-cased) followed by the path. Host: after the first ``://`` up to ``/``, ``?``,
``#`` or the end; path: from there up to ``?``, ``#`` or the end. Of the fitting rules of a group the longest decides, then
the last by text.

Defined results: a null URL or one without ``://`` has an empty host and path, which fit no rule. Repeated rows are judged
each on its own. The rule list is joined by broadcast up to 200,000 rules and by shuffle beyond.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import broadcast_below
from .common import ascii_lower, unused, without

#: hosts that are blocked where no other rule decides
UNWANTED = (
    ("block", "ads-track.*", ""), ("block", "adult-x.*", ""), ("block", "casino-win.*", ""), ("block", "cheap-pills.*", ""),
    ("block", "free-bets.*", ""), ("block", "spam-farm.*", ""), ("block", "casino.*", ""), ("block", "porn.*", ""), ("block", "xxx.*", ""),
)


def expression(host: str, path: str) -> str:
    """Regular expression of a rule over host and path. A pattern's last run in a host reaches to the host's end."""
    inside = "".join("[^/]*" if p == "*" else re.escape(p) for p in re.split(r"(\*)", host) if p)
    return "^(?:[^/]*\\.)?" + inside + (re.escape(path) if path else "(?:/|$)")


def literals(host: str, path: str) -> list[str]:
    """Tokens that a fitting URL must have: runs of letters and digits that neither a ``*`` nor the end of the path may extend."""
    found = []
    for m in re.finditer("[a-z0-9]+", host.lower()):
        if host[m.start() - 1 : m.start()] != "*" and host[m.end() : m.end() + 1] != "*":
            found.append(m[0])
    for m in re.finditer("[a-z0-9]+", path.lower()):
        if m.end() < len(path):
            found.append(m[0])
    return sorted(set(found))


def rules(spark: SparkSession, *groups: tuple) -> DataFrame:
    """(rule, verdict, rank, pattern, tokens) of groups of (verdict, host, path) rules; the first group outranks the next."""
    rows = [
        F.struct(
            F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(-rank).alias("rank"), F.lit(expression(host, path)).alias("pattern"),
            F.array(*[F.lit(t) for t in literals(host, path) or [""]]).alias("tokens"),
        )
        for rank, group in enumerate(groups)
        for verdict, host, path in group
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def tokens(subject: Column) -> Column:
    """Distinct runs of ASCII letters and digits, and the empty token."""
    return F.array_union(F.array(F.lit("")), F.split(ascii_lower(subject), "[^a-z0-9]+"))


def index(subjects: DataFrame, rule_list: DataFrame, few: int) -> DataFrame:
    """(token, rule, verdict, rank, pattern): each rule once, under the rarest of its tokens among the subjects."""
    each = rule_list.withColumn("token", F.explode("tokens"))
    known = broadcast_below(each.select("token").distinct(), few)
    seen = subjects.select(F.explode(tokens(F.col("subject"))).alias("token")).join(known, "token").groupBy("token").count()
    counted = each.join(seen, "token", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    best = F.min_by(F.struct("token", "pattern"), F.struct("count", "token")).alias("best")
    return counted.groupBy("rule", "verdict", "rank").agg(best).select("rule", "verdict", "rank", "best.*")


def judge(df: DataFrame, rule_list: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule, rank and verdict of each URL; without a fitting rule rule and rank are null."""
    (subject,) = unused(df, "_subject")
    placed = without(df, "host", "path").withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    placed = placed.withColumn(subject, F.concat("host", "path"))
    subjects = placed.select(F.col(subject).alias("subject")).where("subject != ''")
    count = rule_list.count()
    indexed = broadcast_below(index(subjects, rule_list, count), count)
    candidates = subjects.withColumn("token", F.explode(tokens(F.col("subject")))).join(indexed, "token")
    fitting = candidates.where(F.regexp_like(F.col("subject"), F.col("pattern")))
    order = F.struct("rank", F.length("rule").alias("n"), "rule", "verdict")
    decided = fitting.groupBy("subject").agg(F.max_by(F.struct("rule", "rank", "verdict"), order).alias("_decided"))
    decided = decided.withColumnRenamed("subject", subject)
    kept = [F.col(f"`{c}`") for c in without(placed, "rule", "rank", "verdict", subject).columns]
    return placed.join(decided, subject, "left").select(
        *kept, F.col("_decided.rule").alias("rule"), F.col("_decided.rank").alias("rank"),
        F.coalesce(F.col("_decided.verdict"), F.lit(default)).alias("verdict"),
    )
