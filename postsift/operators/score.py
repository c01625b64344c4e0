"""Rule scoring.  Every part is a narrow column expression; nothing shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postsift import config as C
from postsift.functions.parse import seconds_after
from postsift.functions.text import any_term, as_text, computed_once, let, term_count

PARTS = ("title", "keywords", "freshness", "applicants", "easy_apply", "remote", "salary", "company")


def score_parts(as_of: Column, rules: C.Rules = C.DEFAULT_RULES) -> Column:
    """STRUCT with the points of each rule, so that a score can be explained."""
    title, description, location, company = (
        F.lower(as_text(c)) for c in ("title", "description", "location", "company")
    )
    count = F.col("applicants").try_cast("int")
    pay = F.col("salary").try_cast("double")

    fresh = F.lit(0)
    for bound, points in reversed(C.FRESHNESS_POINTS):
        # an age is compared as a clock reading: no arithmetic for each row
        fresh = F.when(F.col("posted_date") >= seconds_after(as_of, F.lit(-3600 * bound)), F.lit(points)).otherwise(fresh)
    crowd = F.lit(0)
    for bound, points in reversed(C.APPLICANT_POINTS):
        crowd = F.when(count < bound, F.lit(points)).otherwise(crowd)
    pay_points = F.lit(0)
    for bound, points in reversed(C.SALARY_POINTS):
        pay_points = F.when(pay >= bound, F.lit(points)).otherwise(pay_points)

    def flag(test: Column, points: int) -> Column:
        return F.when(test, F.lit(points)).otherwise(F.lit(0))

    def title_points(text: Column) -> Column:
        return (
            F.when(any_term(text, rules.core_title_terms, rules.match), F.lit(C.CORE_TITLE_POINTS))
            .when(any_term(text, rules.tech_title_terms, rules.match), F.lit(C.TECH_TITLE_POINTS))
            .otherwise(F.lit(0))
        )

    def keyword_points(text: Column) -> Column:
        enough = -(-C.TERM_POINTS_CAP // C.TERM_POINTS)
        hits = term_count(text, rules.description_terms, rules.match, enough)
        return F.least(hits * C.TERM_POINTS, F.lit(C.TERM_POINTS_CAP))

    return F.struct(
        let(title, title_points).alias("title"),
        let(description, keyword_points).alias("keywords"),
        fresh.alias("freshness"),
        F.when(count.isNull(), F.lit(C.APPLICANT_UNKNOWN_POINTS)).otherwise(crowd).alias("applicants"),
        flag(F.col("easy_apply").eqNullSafe(F.lit(True)), C.EASY_APPLY_POINTS).alias("easy_apply"),
        flag(let(location, lambda t: any_term(t, rules.remote_terms, rules.match)), C.REMOTE_POINTS).alias("remote"),
        pay_points.alias("salary"),
        flag(let(company, lambda t: any_term(t, rules.preferred_companies, rules.match)), C.COMPANY_POINTS).alias("company"),
    )


def add_score(df: DataFrame, as_of: Column, rules: C.Rules = C.DEFAULT_RULES, keep_parts: bool = False) -> DataFrame:
    """Add *score*, the capped sum of all parts."""
    out = computed_once(df, _parts=score_parts(as_of, rules))
    total = sum((F.col(f"_parts.{p}") for p in PARTS), F.lit(0))
    out = out.withColumn("score", F.least(total, F.lit(C.SCORE_CAP)))
    return out.withColumnRenamed("_parts", "score_parts") if keep_parts else out.drop("_parts")


def ranked(df: DataFrame, *tie_break: str, by: str = "score") -> DataFrame:
    """Global order by score; the tie-break columns make it total."""
    return df.orderBy(F.desc(by), *tie_break)


def combined_score(model: str = "llm_score", rule: str = "score") -> Column:
    return F.coalesce(F.col(model), F.lit(0)) + F.col(rule)


def preferred_score(model: str = "llm_score", rule: str = "score") -> Column:
    return F.coalesce(F.col(model), F.col(rule))


def high_score(df: DataFrame, at_least: int = C.ALERT_SCORE) -> DataFrame:
    return df.where(F.col("score") >= at_least)


def feedback_by_bucket(scored: DataFrame, feedback: DataFrame, id_col: str = "id") -> DataFrame:
    """How often users liked rows of each score bucket.

    One row per bucket that has feedback; the join keys are unique on both sides.
    """
    bucket = F.lit(None).cast("int")
    for number, (low, high) in enumerate(C.SCORE_BUCKETS):
        bucket = F.when(F.col("score").between(low, high), F.lit(number)).otherwise(bucket)
    return (
        scored.select(F.col(id_col).alias("job_id"), "score")
        .join(feedback.select("job_id", "liked"), "job_id")
        .groupBy(bucket.alias("bucket"))
        .agg(
            F.count(F.lit(1)).alias("rated"),
            F.count_if("liked").alias("liked"),
            (F.count_if("liked") / F.count(F.lit(1))).alias("like_rate"),
        )
    )


def feedback_by_part(scored: DataFrame, feedback: DataFrame, id_col: str = "id") -> DataFrame:
    """How often users liked rows that earned points of a rule part, and rows that did not.

    Reads *score_parts* (see add_score(keep_parts=True)); one aggregate for all parts.
    """
    rows = scored.select(F.col(id_col).alias("job_id"), "score_parts").join(feedback.select("job_id", "liked"), "job_id")
    slots = []
    for part in PARTS:
        earned = F.col(f"score_parts.{part}") > 0
        slots += [
            F.count_if(earned).alias(f"{part}_n"), F.count_if(earned & F.col("liked")).alias(f"{part}_l"),
            F.count_if(~earned).alias(f"{part}_m"), F.count_if(~earned & F.col("liked")).alias(f"{part}_k"),
        ]
    cells = ", ".join(f"'{p}', {p}_n, {p}_l, {p}_m, {p}_k" for p in PARTS)
    return rows.agg(*slots).selectExpr(
        f"stack({len(PARTS)}, {cells}) AS (part, with_points, liked_with, without_points, liked_without)"
    )
