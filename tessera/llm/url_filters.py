"""Block and allow lists for URLs: expressions, an equi-join on short hash prefixes, then full digests and precedence.

A URL stands for the expressions host suffix + path prefix: every suffix of its host that starts at a label, with every
prefix of its path that is as long as some rule's path. A rule fits the URL exactly if the rule is one of these
expressions, so a join finds all rules that fit: first on the leading hex digits of the expression's SHA-256, then the
whole digests and the expressions must agree. Of the rules that fit, the longest wins; of two as long, that with the
longer host, then the one that blocks.

Rows are first reduced to distinct URLs, so a hot URL is judged once, and its rows are not shuffled to get its verdict. The rule side is broadcast only when its counted
number of rows is within ``broadcast_rules``; a larger list is joined by a shuffle. The lengths of rule paths are
gathered as a distinct list, which is bounded by the longest path.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and gets the default
verdict; repeated rows stay; a very long URL has as many expressions as its host has labels times the rules' path lengths;
the input's other columns are not read; with no rules all get the default; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, written

PREFIX_DIGITS = 8


def host_of(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; only A-Z are lower-cased."""
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) pairs such as ("block", "net/"): the host is what stands before the first ``/``."""
    df = spark.createDataFrame(list(rules), "rule_verdict string, rule string")
    return df.withColumns(
        {
            "rule_host": F.substring_index("rule", "/", 1),
            "rule_path": F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)"),
        }
    )


def expressions(urls: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """A row per distinct expression of each row's ``host`` and ``path``: columns url, n, expr_host, expr_path."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    fits = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]
    return (
        urls.where(F.col("host") != "")
        .select("url", "n", F.explode(suffixes).alias("expr_host"), F.array_compact(F.array(*fits)).alias("_paths"))
        .select("url", "n", "expr_host", F.explode("_paths").alias("expr_path"))
    )


def _hashed(df: DataFrame, host: str, path: str) -> DataFrame:
    digest = F.sha2(F.concat(F.col(host), F.lit("\n"), F.col(path)), 256)
    return df.withColumn("digest", digest).withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", broadcast_rules: int = 100_000) -> DataFrame:
    """For each row of ``pages`` (page_id, url): page_id, host, path, rule (null if none fits) and verdict.

    ``rules`` comes from ``rule_table`` or a table of its columns."""
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect())
    hashed = _hashed(rules.dropDuplicates(["rule_verdict", "rule"]), "rule_host", "rule_path")
    small = len(hashed.select(F.lit(1)).take(broadcast_rules + 1)) <= broadcast_rules
    keyed = pages.select("page_id", "url")
    urls = keyed.where("url is not null").groupBy("url").agg(F.count("*").alias("n")).withColumns({"host": host_of(), "path": path_of()})
    best = F.max(
        F.struct(
            F.length("rule").alias("n"),
            F.length("rule_host").alias("h"),
            (F.col("rule_verdict") == "block").alias("b"),
            F.col("rule").alias("rule"),
            F.col("rule_verdict").alias("verdict"),
        )
    ).alias("best")
    fitting = (
        _hashed(expressions(urls, lengths), "expr_host", "expr_path")
        .alias("u")
        .join((F.broadcast(hashed) if small else hashed).alias("r"), "prefix")
        .where("u.digest = r.digest and expr_host = rule_host and expr_path = rule_path")
        .groupBy("url")
        .agg(best, F.max("u.n").alias("n"))
    )
    return join_counted(keyed, written(fitting, "verdicts"), "url").select(
        "page_id",
        host_of().alias("host"),
        path_of().alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
