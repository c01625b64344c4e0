"""Dashboard reads: filters, sorts, stage board."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from postsift import config as C
from postsift.functions.parse import days_label
from postsift.functions.text import as_text, pretty_label
from postsift.operators.publish import top_k
from postsift.operators.score import preferred_score


@dataclass(frozen=True)
class GridFilter:
    """Settings of the listing view; an empty list restricts nothing."""

    role: str = "all"
    job_types: Sequence[str] = ()
    sources: Sequence[str] = ()
    min_score: int = 0
    remote_only: bool = False
    easy_apply_only: bool = False
    search: str = ""
    sort_by: str = "score"  # or "date", "salary"
    tab: str = "all"  # or "applied", "saved": these ignore the role


def _search(query: str, *cols: str) -> Column:
    haystack = F.lower(F.concat_ws(" ", *[as_text(c) for c in cols]))
    return F.contains(haystack, F.lit(query.lower()))


def grid_filter(df: DataFrame, spec: GridFilter) -> DataFrame:
    if spec.tab in ("applied", "saved"):
        df = df.where(F.col(spec.tab))
    elif spec.role != "all":
        df = df.where(F.col("role_category") == spec.role)
    if spec.job_types:
        df = df.where(F.col("job_type").isin(*spec.job_types))
    if spec.sources:
        df = df.where(F.col("source").isin(*spec.sources))
    if spec.min_score:
        df = df.where(F.col("score") >= spec.min_score)
    if spec.remote_only:
        df = df.where(F.contains(F.lower("location"), F.lit("remote")))
    if spec.easy_apply_only:
        df = df.where(F.coalesce("easy_apply", F.lit(False)))
    if spec.search:
        df = df.where(_search(spec.search, "title", "company", "location"))
    return df


def sort_key(sort_by: str = "score") -> Column:
    return {
        "date": F.col("posted_date"), "salary": F.coalesce("salary", F.lit(0)), "score": preferred_score(),
    }[sort_by]


def grid_sort(df: DataFrame, sort_by: str, tie_break: str, limit: int | None = None) -> DataFrame:
    """All rows, best first; rows without a date come last.  *limit* cuts to the first ones."""
    order = (sort_key(sort_by).desc_nulls_last(), F.col(tie_break))
    return df.orderBy(*order) if limit is None else top_k(df, limit, *order)


def posts_filter(posts: DataFrame, email_only: bool = False, min_score: int = 0, search: str = "") -> DataFrame:
    if email_only:
        posts = posts.where(F.length("contact_email") > 0)
    posts = posts.where(F.col("score") >= min_score)
    if search:
        posts = posts.where(_search(search, "author_name", "extracted_title", "extracted_company", "post_text"))
    return posts


def posts_top(posts: DataFrame, tie_break: str, n: int = C.POST_GRID_ROWS) -> DataFrame:
    return top_k(posts.where("is_job_posting"), n, F.desc("score"), tie_break)


def unnotified(df: DataFrame, min_score: int = 0) -> DataFrame:
    return df.where(~F.col("notified") & (F.col("score") >= min_score))


def stage_assign(df: DataFrame, stages: DataFrame, id_col: str = "id") -> DataFrame:
    """Add *stage*: the board's own entry, else applied, else saved, else NULL (untracked)."""
    own = stages.select(F.col("job_id").alias(id_col), F.col("status").alias("_own"))
    flags = F.when(F.col("applied"), F.lit("applied")).when(F.col("saved"), F.lit("saved"))
    return df.join(own, id_col, "left").withColumn("stage", F.coalesce("_own", flags)).drop("_own")


def untracked(staged: DataFrame, tie_break: str, n: int = 30) -> DataFrame:
    """Rows without a stage, the first n in order."""
    return top_k(staged.where(F.col("stage").isNull()), n, tie_break)


def card_labels(as_of: Column) -> list[Column]:
    """The derived texts of one card."""
    return [
        pretty_label(F.coalesce(F.nullif(F.col("job_type"), F.lit("")), F.lit(C.DEFAULT_JOB_TYPE)), "-").alias("type_label"),
        pretty_label(F.coalesce(F.nullif(F.col("role_category"), F.lit("")), F.lit("other"))).alias("role_label"),
        days_label("posted_date", as_of).alias("posted_label"),
        F.slice("skills", 1, 6).alias("shown_skills"),
    ]


def stage_patches(stages: DataFrame) -> DataFrame:
    """Moving to applied or saved also sets that flag: the rows to feed to apply_patches."""
    hit = stages.where(F.col("status").isin("applied", "saved"))
    return hit.select(
        F.col("job_id").alias("id"), F.array("status").alias("supplied"),
        (F.col("status") == "applied").alias("applied"), (F.col("status") == "saved").alias("saved"),
    )


def stage_counts(staged: DataFrame) -> DataFrame:
    """One row per board column in board order, zero where it is empty."""
    counts = staged.agg(*[F.count_if(F.col("stage") == s).alias(s) for s in C.STAGES])
    pairs = ", ".join(f"{i}, '{s}', {s}" for i, s in enumerate(C.STAGES, 1))
    return counts.selectExpr(f"stack({len(C.STAGES)}, {pairs}) AS (position, stage, postings)")
