"""URL allow and block rules by host-suffix and path-prefix expressions.

Every distinct (host, path) is expanded to the expressions that a rule could
have: its last k labels for each number of labels that some rule has, times the
prefixes of its path for each length that some rule's path has. Expressions meet
the rules by equality of a short digest prefix; the full digest then confirms,
and the longest rule wins. A url brings at most (label counts) x (path lengths)
rows, however long it is. The rules are broadcast only if Spark knows them to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.text import ascii_lower
from tidemark.session import materialize

SHORT_HEX = 8
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a DataFrame."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _digest(host: Column, path: Column) -> Column:
    # a host has no slash and a path starts with one or is empty, so the text is unambiguous
    return F.sha2(F.concat(host, path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    ``rules`` has verdict, host and path. A rule fits its host and all subdomains
    of it where the url's path starts with the rule's. Of the rules that fit, the
    longest (host and path together) wins; then the one with the longer host; then
    block before allow. Without a rule the verdict is ``default`` and rule is null.
    A null url or one without ``://`` has an empty host and path. Repeated rows are
    each judged; rules with a null field or an empty host fit nothing. Other columns are ignored.
    """
    known = rules.select(
        F.col("verdict").alias("r_verdict"), ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path")
    ).where("r_verdict IS NOT NULL AND r_host <> '' AND r_path IS NOT NULL")
    shapes = known.agg(
        F.sort_array(F.collect_set(F.size(F.split("r_host", r"\.")))).alias("labels"),
        F.sort_array(F.collect_set(F.length("r_path"))).alias("lengths"),
    ).first()  # two short lists of distinct lengths
    keyed = known.select(
        "*", _digest(F.col("r_host"), F.col("r_path")).alias("r_digest"), F.concat("r_host", "r_path").alias("r_rule")
    ).withColumn("r_short", F.substring("r_digest", 1, SHORT_HEX))

    urls = pages.select(
        F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    )
    targets = urls.select("host", "path").distinct()
    labels = F.array(*[F.lit(n) for n in shapes["labels"]]).cast("array<int>")
    lengths = F.array(*[F.lit(n) for n in shapes["lengths"]]).cast("array<int>")
    dots = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit("")))
    suffixed = targets.select("*", F.explode(F.filter(labels, lambda n: n <= dots + 1)).alias("n_labels")).select(
        "host", "path", F.expr("substring_index(host, '.', -n_labels)").alias("suffix")
    )
    expressions = suffixed.select(
        "*", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))).alias("n_chars")
    ).select("host", "path", _digest(F.col("suffix"), F.expr("substring(path, 1, n_chars)")).alias("digest"))
    hits = expressions.withColumn("r_short", F.substring("digest", 1, SHORT_HEX)).join(keyed, "r_short").where("digest = r_digest")
    # a table of its own, so that the join below can split a url that very many rows share
    best = hits.groupBy("host", "path").agg(
        F.max(
            F.struct(
                F.length("r_rule").alias("chars"),
                F.length("r_host").alias("host_chars"),
                (F.col("r_verdict") == "block").alias("blocks"),
                F.col("r_rule").alias("rule"),
                F.col("r_verdict").alias("verdict"),
            )
        ).alias("best")
    )
    best = materialize(best)
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
