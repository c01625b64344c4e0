"""URL filters: a sort-merge range join of URLs with prefix rules, in DataFrame functions only.

A rule is a host, meant with all its subdomains, and a path prefix.  The canonical key of a host puts its labels in
reverse order (`com.example.`), so that a host comes right before its subdomains; a rule covers an interval of paths
below one such key: from its prefix to the last string that begins with it.  A URL is put at its path below the key of
its host and of each parent domain.  A sweep over the sorted starts and ends of intervals and the URLs between them
carries the stack of rules that are open; intervals are nested or apart, so after a start the stack is the rule's
ancestors and the rule, after an end it is the ancestors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One key's URLs are swept in this many parts, each with its own copy of the key's rules.
SALTS = 64
#: Follows every string with a given prefix: no UTF-8 text holds this byte.
_AFTER = "FF"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or end, with A-Z in lower case; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ?, # or end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """`www.example.com` as `com.example.www.`"""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _rule_stacks(rules: DataFrame) -> DataFrame:
    """(key, path, stack): each rule with its chain of enclosing rules of the same key, outermost first.

    Of rules with the same host and path, the one with the first verdict in order counts.
    """
    unique = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).select(
        reversed_host(F.col("host")).alias("key"), "path",
        F.struct(
            F.length("host").alias("host_chars"), F.length("path").alias("path_chars"),
            F.concat("host", "path").alias("rule"), "verdict",
        ).alias("entry"),
    )
    # every prefix of a rule's path may be the path of a rule around it
    inner = unique.select("key", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n"))
    pairs = inner.select("key", "path", F.expr("substring(path, 1, n)").alias("outer")).join(
        unique.select("key", F.col("path").alias("outer"), "entry"), ["key", "outer"]
    )
    return pairs.groupBy("key", "path").agg(F.array_sort(F.collect_list("entry")).alias("stack"))


def judge_urls(
    pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", salts: int = SALTS,
) -> DataFrame:
    """One row per page: id, host, path, the longest fitting rule (null if none) and its verdict, else *default*.

    *rules* has the columns host, path and verdict.  A rule fits its host and all subdomains, when the URL's path starts
    with the rule's path; longest means the longest host, then the longest path.  A null or malformed URL has empty host
    and path and gets the default.  Rules without a host, or with nulls, fit nothing.  Repeated pages give repeated
    rows.  Other columns are ignored.

    Each different (host, path) is judged once and the verdicts are joined back, so copies of one URL meet in the
    partial aggregate, not in one task.
    """
    parsed = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    usable = rules.select("host", "path", "verdict").where("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL")
    usable = usable.withColumn("host", F.translate("host", UPPER, LOWER))
    stacks = _rule_stacks(usable)

    urls = parsed.select("host", "path").distinct().where("host <> ''")
    # below the key of the host and of every parent domain
    labels = F.reverse(F.split("host", r"\."))
    below = urls.select(
        "host", "path", F.explode(F.transform(
            F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")),
        )).alias("key"),
    )
    point = below.select(
        "key", F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int").alias("salt"), F.encode("path", "UTF-8").alias("at"),
        F.lit(1).alias("turn"), F.lit(None).cast(dict(stacks.dtypes)["stack"]).alias("open"), "host", "path",
    )
    none = F.lit(None).cast("string")
    spread = stacks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    start = spread.select(
        "key", "salt", F.encode("path", "UTF-8").alias("at"), F.lit(0).alias("turn"), F.col("stack").alias("open"), none.alias("host"),
        none.alias("path"),
    )
    end = spread.select(
        "key", "salt", F.concat(F.encode("path", "UTF-8"), F.unhex(F.lit(_AFTER))).alias("at"), F.lit(2).alias("turn"),
        F.slice("stack", 1, F.size("stack") - 1).alias("open"), none.alias("host"), none.alias("path"),
    )
    # At one place starts come first, outer before inner; ends of nested intervals lie at different places unless one
    # prefix extends another by bytes FF, which UTF-8 excludes.
    sweep = Window.partitionBy("key", "salt").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    swept = start.unionByName(point).unionByName(end).withColumn("open", F.last("open", ignorenulls=True).over(sweep))
    best = swept.where("turn = 1 AND size(open) > 0").groupBy("host", "path").agg(
        F.max(F.element_at("open", -1)).alias("best")
    )
    return parsed.join(best, ["host", "path"], "left").select(
        F.col(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
