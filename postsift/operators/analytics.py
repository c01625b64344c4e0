"""Roll-ups.  Each is one aggregate with map-side combine, so hot groups cost one row per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from postsift import config as C
from postsift.functions.text import as_text, computed_once, has_term, known_amount, let
from postsift.operators.publish import top_k


def _half_up(c):
    return F.floor(c + F.lit(0.5))


def score_histogram(df: DataFrame) -> DataFrame:
    """Rows per score range; empty ranges stay in."""
    counts = df.agg(*[F.count_if(F.col("score").between(lo, hi)).alias(f"b{lo}") for lo, hi in C.SCORE_BUCKETS])
    cells = ", ".join(f"'{lo}–{hi}', b{lo}" for lo, hi in C.SCORE_BUCKETS)
    return counts.selectExpr(f"stack({len(C.SCORE_BUCKETS)}, {cells}) AS (score_range, postings)")


def count_by(df: DataFrame, column, name: str) -> DataFrame:
    return df.groupBy(column.alias(name)).agg(F.count(F.lit(1)).alias("postings"))


def count_by_source(df: DataFrame, n: int = 8) -> DataFrame:
    return top_k(count_by(df, F.col("source"), "source"), n, F.desc("postings"), "source")


def count_by_role(df: DataFrame) -> DataFrame:
    return count_by(df, F.coalesce(F.nullif(F.col("role_category"), F.lit("")), F.lit("other")), "role")


def count_by_type(df: DataFrame) -> DataFrame:
    return count_by(df, F.replace(F.col("job_type"), F.lit("_"), F.lit(" ")), "job_type")


def share_by_role(df: DataFrame) -> DataFrame:
    """Whole percent per role, halves rounded up; the window runs over the few groups."""
    total = F.sum("postings").over(Window.partitionBy())
    return count_by_role(df).withColumn("percent", _half_up(F.col("postings") * 100 / total).cast("bigint"))


def distinct_sources(df: DataFrame) -> DataFrame:
    return df.select("source").distinct().orderBy("source")


def _posts_counts(posts: DataFrame) -> DataFrame:
    return posts.agg(F.count(F.lit(1)).alias("posts"), F.count_if(F.length("contact_email") > 0).alias("posts_with_email"))


def kpi_analytics(df: DataFrame, posts: DataFrame) -> DataFrame:
    """One row of headline numbers.  A salary of 0 counts as unknown."""
    total = F.count(F.lit(1))
    rate = F.when(total > 0, F.round(F.count_if("applied") * 100.0 / total, 1)).otherwise(F.lit(0.0))
    pay = F.avg(F.when(known_amount("salary"), F.col("salary").cast("double")))
    jobs = df.agg(
        total.alias("total"), F.count_if(F.col("score") >= 80).alias("score_80"), rate.alias("apply_rate"),
        _half_up(pay / 1000).cast("bigint").alias("avg_salary_k"), F.count_if("applied").alias("applied"),
        F.count_if("saved").alias("saved"),
    )
    # both counts as one value, so the posts are read once
    counts = _posts_counts(posts).select(F.struct("posts", "posts_with_email")).scalar()
    return jobs.withColumn("_p", counts).select("*", "_p.*").drop("_p")


def kpi_stats(df: DataFrame, posts: DataFrame) -> DataFrame:
    """One row of the stats bar."""
    kind = as_text("job_type")
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(_half_up(F.avg("score")).cast("bigint"), F.lit(0)).alias("avg_score"),
        F.count_if(F.col("score") >= 80).alias("score_80"),
        F.count_if(kind == "full_time").alias("full_time"),
        F.count_if(F.contains(kind, F.lit("contract"))).alias("contract"),
        F.count_if(known_amount("salary")).alias("with_salary"),
        F.count_if("applied").alias("applied"),
        F.count_if("saved").alias("saved"),
    ).withColumn("posts", _posts_counts(posts).select("posts").scalar())


def skill_demand(
    df: DataFrame, order_by: str, *, title: str = "title", description: str = "description",
    skills: Sequence[str] = C.DEMAND_SKILLS, n: int = C.DEMAND_ROWS, match: str = "substring",
) -> DataFrame:
    """Documents that mention each skill, the n most wanted.

    Equal counts: the skill seen first (in row order, then list order) leads.  One global
    aggregate with two slots per skill, then turned into rows; nothing is exploded.
    """
    text = F.lower(F.concat_ws(" ", as_text(description), as_text(title)))
    slots = []
    lowered = [skill.lower() for skill in skills]
    hits = let(text, lambda t: F.transform(F.array(*[F.lit(k) for k in lowered]), lambda k: F.contains(t, k)))
    if match == "word":
        hits = let(text, lambda t: F.array(*[has_term(t, k, match) for k in lowered]))
    base = computed_once(df, _hits=hits).select(F.col(order_by).alias("_at"), "_hits")
    for i, skill in enumerate(skills):
        hit = F.get("_hits", F.lit(i))
        slots += [F.count_if(hit).alias(f"n{i}"), F.min(F.when(hit, F.col("_at"))).alias(f"f{i}")]
    names = [skill.replace("'", "\\'") for skill in skills]
    cells = ", ".join(f"{i}, '{name}', n{i}, f{i}" for i, name in enumerate(names))
    counted = base.agg(*slots).selectExpr(f"stack({len(names)}, {cells}) AS (place, skill, mentions, first_at)")
    return top_k(counted.where("mentions > 0"), n, F.desc("mentions"), "first_at", "place")


def skill_gap(demand: DataFrame, owned: DataFrame, skill: str = "skill", n_missing: int = C.GAP_ROWS) -> DataFrame:
    """Wanted skills split into owned and missing; only the first missing ones are listed."""
    have = owned.select(F.lower(skill).alias("_k")).distinct().withColumn("_own", F.lit(True))
    wanted = demand.withColumn("_k", F.lower("skill")).join(have, "_k", "left")
    wanted = wanted.withColumn("status", F.when(F.col("_own"), "have").otherwise("missing"))
    # the demanded skills are a few rows of a list
    order = Window.partitionBy("status").orderBy(F.desc("mentions"), "first_at", "place")
    listed = (F.col("status") == "have") | (F.col("_place") <= n_missing)
    return wanted.withColumn("_place", F.row_number().over(order)).where(listed).select("skill", "mentions", "status")


def skills_heatmap(df: DataFrame, order_by: str, n: int = C.HEATMAP_ROWS) -> DataFrame:
    """The n most listed skills with intensity (count / max) and opacity."""
    rows = df.select(F.col(order_by).alias("_at"), F.posexplode("skills").alias("_pos", "skill"))
    counted = rows.groupBy("skill").agg(F.count(F.lit(1)).alias("mentions"), F.min(F.struct("_at", "_pos")).alias("_first"))
    top = top_k(counted, n, F.desc("mentions"), "_first")
    intensity = F.col("mentions") / F.max("mentions").over(Window.partitionBy())
    return top.select("skill", "mentions", intensity.alias("intensity")).withColumn("opacity", F.lit(0.3) + F.lit(0.7) * F.col("intensity"))
