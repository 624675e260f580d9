"""URL filters by host-suffix and path-prefix expressions joined on short hash prefixes.

Each distinct (host, path) expands into the expressions ``host suffix + path
prefix``; only suffixes of as many labels, and prefixes as long, as some rule
has are formed, so the expansion is exact and bounded by the rules. The
expressions meet the rules in an equi-join on the first four bytes of the
SHA-256, full digests confirm, and the longest rule wins (longer expression,
then longer host, then block before allow).

A rule fits its host and all subdomains if the path starts with the rule's.
A null url, or one without ``://``, has empty host and path and fits nothing.
Rows are kept as they come: repeated rows each get their verdict, other columns
are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footgrid.llm.common import ascii_lower

#: The rules of the registered query, as (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


@dataclass(frozen=True)
class UrlFilter:
    """default: the verdict where no rule fits. broadcast_rules: a rule table of up to so many rows is broadcast."""

    default: str = "allow"
    broadcast_rules: int = 50_000


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def _prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def prepared_rules(rules: DataFrame) -> DataFrame:
    """One row per expression with its digests; a block beats an allow of the same expression."""
    expr = F.concat(F.col("host"), F.col("path"))
    digest = _digest(expr)
    return (
        rules.where("host IS NOT NULL AND host <> '' AND path IS NOT NULL AND verdict IS NOT NULL")
        .select(
            expr.alias("rule"), F.length("host").alias("rule_host"), F.col("verdict").alias("rule_verdict"),
            digest.alias("rule_digest"), _prefix(digest).alias("prefix"),
            F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_chars"),
        )
        .groupBy("rule", "rule_host", "rule_digest", "prefix", "labels", "path_chars")
        .agg(F.max("rule_verdict").alias("rule_verdict"))  # 'block' sorts after 'allow'
    )


def expressions(targets: DataFrame, labels: list[int], lengths: list[int]) -> DataFrame:
    """Expand (host, path) rows into their expressions' digests."""
    parts = F.split("host", r"\.")
    counts = F.array(*[F.lit(x) for x in labels]).cast("array<int>")
    cuts = F.array(*[F.lit(x) for x in lengths]).cast("array<int>")
    suffixes = F.transform(
        F.filter(counts, lambda k: k <= F.size(parts)),
        lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."),
    )
    prefixes = F.transform(
        F.filter(cuts, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    return (
        targets.where("host <> ''")
        .select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("host", "path", "suffix", F.explode("prefixes").alias("cut"))
        .select("host", "path", _digest(F.concat("suffix", "cut")).alias("digest"))
        .withColumn("prefix", _prefix(F.col("digest")))
    )


def judge(urls: DataFrame, rules: DataFrame, config: UrlFilter = UrlFilter(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``urls``."""
    ready = prepared_rules(rules)
    shape = ready.agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("labels")).alias("labels"), F.array_sort(F.collect_set("path_chars")).alias("lengths")
    ).first()
    pages = urls.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    no_rule = F.lit(None).cast("string")
    if not shape["n"]:
        return pages.select(id_col, "host", "path", no_rule.alias("rule"), F.lit(config.default).alias("verdict"))
    ready = ready.select("prefix", "rule", "rule_host", "rule_digest", "rule_verdict")
    if shape["n"] <= config.broadcast_rules:
        ready = F.broadcast(ready)
    # A URL that many rows share is expanded once.
    hits = expressions(pages.select("host", "path").distinct(), shape["labels"], shape["lengths"])
    best = (
        hits.join(ready, "prefix")
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), F.col("rule_host"), F.col("rule_verdict"))).alias("best"))
    )
    return pages.join(best, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(config.default)).alias("verdict")
    )
