"""URL filters: allow and block rules for hosts and path prefixes, by hashed expressions.

Each URL is expanded into (host suffix, path prefix) expressions, of the lengths that rules have.
An expression meets rules by an equi-join on the first 8 hex digits of its SHA-256 and on nothing else; full
digests then confirm a match or reject it. Of several matches the longest rule wins, then the one with the longer
host, then a block. Everything is DataFrame functions; there is one shuffle, of one row a URL, as rows
of one URL lie together and are combined before it.

Defined results: a null URL, or one without "://", has empty host and path and no rule, so it gets
the default verdict. Repeated rows come back as often as they came. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import lower_ascii

PREFIX_DIGITS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#"; path: then up to "?", "#"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules as (host, path, verdict), from values in the plan."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({quote(h.lower())}, {quote(p)}, {quote(v)})" for h, p, v in rules)
    if not values:
        return spark.sql("SELECT '' AS host, '' AS path, '' AS verdict WHERE false")
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, verdict)")


def expressions(host: Column, path: Column, host_lengths: list[int], path_lengths: list[int]) -> Column:
    """Array of host suffix + path prefix, for whole labels and the given lengths only.

    A host holds no "/", and a path is empty or begins with one, so the two parts stay apart.
    """
    sizes = F.array(*[F.lit(n) for n in host_lengths]) if host_lengths else F.array().cast("array<int>")
    fits = lambda n: (F.length(host) == n) | ((F.length(host) > n) & (F.substr(host, F.length(host) - n, F.lit(1)) == "."))
    suffixes = F.transform(F.filter(sizes, fits), lambda n: F.substr(host, F.length(host) - n + 1, n))
    cuts = F.array(*[F.lit(n) for n in path_lengths]) if path_lengths else F.array().cast("array<int>")
    prefixes = F.transform(F.filter(cuts, lambda n: F.length(path) >= n), lambda n: F.left(path, n))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Rows (id, host, path, rule, verdict) for all pages.

    rules: columns host, path, verdict. The driver only learns the distinct lengths of rules' hosts
    and paths, which the length of a host name and of a path bound, whatever the number of rules.
    Whether rules are broadcast is left to the planner, which knows their size; beyond its threshold the
    join shuffles by the hash prefix, and skewed prefixes are split by adaptive execution.
    """
    known = rules.select(
        F.concat("host", "path").alias("rule"), F.length("host").alias("hl"), F.length("path").alias("pl"), F.col("verdict").alias("rule_verdict")
    )
    sizes = known.agg(F.collect_set("hl").alias("h"), F.collect_set("pl").alias("p")).first()
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    keyed = (
        known.groupBy("rule", "hl").agg(F.max(F.col("rule_verdict")).alias("rule_verdict"))  # "block" over "allow"
        .withColumn("rule_digest", digest(F.col("rule"))).withColumn("rule_prefix", F.left("rule_digest", F.lit(PREFIX_DIGITS)))
    )
    host, path = host_and_path(F.col("_url"))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).withColumns({"_host": host, "_path": path})
    # A null comes before a URL's expressions: it meets no rule, so copies of a URL are counted by it, whatever prefixes collide.
    own = expressions(F.col("_host"), F.col("_path"), sorted(sizes["h"]), sorted(sizes["p"]))
    rows = rows.select("_id", "_url", F.explode(F.concat(F.array(F.lit(None).cast("string")), own)).alias("_expr"))
    rows = rows.withColumn("_digest", digest(F.col("_expr"))).withColumn("_prefix", F.left("_digest", F.lit(PREFIX_DIGITS)))
    met = rows.join(keyed, rows["_prefix"] == keyed["rule_prefix"], "left")
    confirmed = F.col("_digest") == F.col("rule_digest")
    best = F.max(F.when(confirmed, F.struct(F.length("rule").alias("n"), "hl", (F.col("rule_verdict") == "block").alias("b"), "rule", "rule_verdict")))
    one = met.groupBy("_id", "_url").agg(F.count(F.when(F.col("_expr").isNull(), 1)).alias("_copies"), best.alias("_best"))
    host, path = host_and_path(F.col("_url"))
    return one.select(
        F.col("_id").alias(id_col), host.alias("host"), path.alias("path"), F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.rule_verdict"), F.lit(default)).alias("verdict"),
        F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
