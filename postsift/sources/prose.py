"""Records out of free text: forum comments, social posts, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postsift import config as C
from postsift.functions import parse as P, text as T
from postsift.operators.classify import keyword_gate
from postsift.operators.dedup import distinct_first, first_n_per_group


def _or(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def forum_job_type(lowered: Column) -> Column:
    return (
        F.when(T.has_word(lowered, ("contract", "1099", "c2c")), F.lit("contract"))
        .when(F.contains(lowered, F.lit("part")) & lowered.rlike("part.?time"), F.lit("part_time"))
        .otherwise(F.lit("full_time"))
    )


def extract_forum_posts(
    df: DataFrame, text: str, comment_id: str, as_of: Column, *, relevant: tuple[str, ...] = C.FORUM_RELEVANT_TERMS,
    signals: tuple[str, ...] = C.FORUM_SIGNAL_TERMS, entities: str = "table",
) -> DataFrame:
    """Hiring comments of the form 'Company | Role | Location | ...'.

    The cheap length and keyword gates run before any field is extracted.
    """
    rows = df.where(F.length(text) >= C.FORUM_MIN_CHARS).select(F.col(comment_id).alias("comment_id"), F.col(text).alias("_raw"))
    rows = T.computed_once(rows, _t=T.plain_text("_raw", entities))
    rows = T.computed_once(rows, _l=F.lower("_t"))
    rows = rows.where(T.any_term(F.col("_l"), relevant)).where(T.any_term(F.col("_l"), signals))
    body = F.col("_t")
    remote = T.has_word(F.col("_l"), ("remote",))
    location = F.when(remote, F.lit("Remote")).otherwise(T.pipe_field(body, 2))
    own = F.when(
        F.coalesce(F.col("comment_id").cast("string"), F.lit("")) != "",
        F.concat(F.lit(C.FORUM_ITEM_URL), F.col("comment_id").cast("string")),
    ).otherwise(F.lit(""))
    return rows.select(
        "comment_id",
        _or(T.pipe_field(body, 1, 80), C.FORUM_DEFAULT_TITLE).alias("title"),
        _or(T.pipe_field(body, 0, 60), C.FORUM_DEFAULT_COMPANY).alias("company"),
        _or(location, C.FORUM_DEFAULT_LOCATION).alias("location"),
        F.coalesce(F.nullif(T.first_url(body), F.lit("")), own).alias("url"),
        F.lit(C.FORUM_SOURCE).alias("source"),
        F.left(body, F.lit(C.FORUM_TEXT_CHARS)).alias("description"),
        as_of.alias("posted_date"),
        forum_job_type(F.col("_l")).alias("job_type"),
        F.lit(False).alias("easy_apply"),
        T.first_email(body).alias("contact_email"),
        P.hashed_amount(body).alias("salary"),
    )


def looks_like_job(text: Column | str) -> Column:
    return keyword_gate(text, C.POST_TRIGGERS)


def extract_social_posts(
    df: DataFrame, as_of: Column, *, base_url: str = "https://www.linkedin.com", reply: str | None = None,
    order_by: tuple[str, ...] = ("seq",), per_query: int | None = None, query: str = "query",
) -> DataFrame:
    """Posts that announce an opening.

    Reads post_text, author_name, author_headline, author_profile_url, post_url, time_text and,
    if named, a model *reply* whose fields override what the text gives.
    """
    if per_query is not None:
        df = first_n_per_group(df, query, per_query, order_by).drop("rn")
    rows = df.where((F.length("post_text") >= C.POST_MIN_CHARS) & P.is_fresh_label("time_text"))
    rows = rows.withColumn("_m", T.post_reply(F.lit(None).cast("string") if reply is None else F.col(reply)))
    rows = rows.where(F.coalesce(F.col("_m.is_job_posting"), looks_like_job("post_text")))
    profile = T.absolute_url(T.as_text("author_profile_url"), base_url)
    author = T.strip(T.as_text("author_name"))
    out = rows.select(
        *order_by,
        F.left("post_text", F.lit(C.POST_TEXT_CHARS)).alias("post_text"),
        author.alias("author_name"), T.strip(T.as_text("author_headline")).alias("author_headline"), profile.alias("author_profile_url"),
        T.as_text("_m.job_title").alias("extracted_title"), T.as_text("_m.company").alias("extracted_company"),
        F.coalesce(F.nullif(T.first_email("post_text"), F.lit("")), F.col("_m.contact_email"), F.lit("")).alias("contact_email"),
        F.coalesce(F.col("_m.contact_linkedin"), profile).alias("contact_linkedin"),
        F.coalesce(F.col("_m.contact_name"), author).alias("contact_name"),
        T.absolute_url(T.as_text("post_url"), base_url).alias("post_url"),
        as_of.alias("posted_date"), F.lit(True).alias("is_job_posting"),
        F.coalesce(F.col("_m.score"), F.lit(C.POST_DEFAULT_SCORE)).alias("score"),
        F.coalesce(F.col("_m.role_category"), F.lit(C.DEFAULT_ROLE)).alias("role_category"),
    )
    return distinct_first(out, "post_url", order_by, blank="keep_one")


def extract_profiles(docs: DataFrame, doc_id: str, text: str, skills: tuple[str, ...] = C.PROFILE_SKILLS) -> DataFrame:
    """One profile per document: first address, first phone number, known skills."""
    empty, none = F.lit(""), F.array().cast("array<string>")
    return docs.select(
        F.col(doc_id).alias("doc_id"), empty.alias("name"), T.first_email(text).alias("email"),
        T.first_phone(text).alias("phone"), F.lit(C.PROFILE_DEFAULT_TITLE).alias("title"),
        F.lit(0).alias("years_experience"), T.term_list(F.lower(T.as_text(text)), skills).alias("skills"),
        none.alias("companies"), empty.alias("education"), empty.alias("summary"),
    )
