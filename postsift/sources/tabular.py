"""Tabular and RSS feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postsift import config as C
from postsift.functions import parse as P, text as T
from postsift.sources.feeds import TEXT_CHARS


def normalize_tabular(df: DataFrame, as_of: Column, labels: dict[str, str] = C.SITE_LABELS, default_source: str = C.TABULAR_SOURCE) -> DataFrame:
    """Rows of a data-frame shaped feed ('nan' texts, NaN numbers, typed pay intervals)."""
    clean = {c: T.clean_missing(c) for c in ("title", "company", "location", "job_url", "description", "interval", "site")}
    site = F.lower(clean["site"])
    known = F.create_map(*[F.lit(v) for pair in labels.items() for v in pair])
    source = F.coalesce(F.try_element_at(known, site), F.when(site == "", F.lit(default_source)), T.title_case(site))
    return df.select(
        *[F.col(c) for c in df.columns if c == "seq"],
        clean["title"].alias("title"), clean["company"].alias("company"), clean["location"].alias("location"),
        P.interval_salary("min_amount", "max_amount", clean["interval"]).alias("salary"),
        clean["job_url"].alias("url"), source.alias("source"),
        F.coalesce(P.parse_iso(F.col("date_posted").cast("string")), as_of).alias("posted_date"),
        F.col("is_easy_apply").try_cast("boolean").alias("easy_apply"),
        T.first_int(F.col("num_applicants").cast("string")).alias("applicants"),
        F.left(clean["description"], F.lit(TEXT_CHARS)).alias("description"),
    ).where(F.length("title") > 0)


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """The items of landed RSS files."""
    schema = "title STRING, link STRING, pubDate STRING, description STRING, author STRING, creator STRING, location STRING"
    return spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)


def normalize_rss(
    df: DataFrame, as_of: Column, source: str, *, labelled_title: bool, seq: str = "seq",
) -> DataFrame:
    """All RSS items.  With *labelled_title* the title reads 'Company: Role' and all rows are remote;
    otherwise the author is the company and pay is looked for in the summary."""
    summary = F.coalesce("description", F.lit(""))
    if labelled_title:
        company, title = T.split_label("title")
        location, salary, easy = F.lit("Remote"), F.lit(None).cast("int"), F.lit(True)
    else:
        title = F.col("title")
        company = F.coalesce(F.nullif(F.col("author"), F.lit("")), F.col("creator"), F.lit(""))
        location = F.coalesce(F.nullif(F.col("location"), F.lit("")), F.lit("United States"))
        salary, easy = P.parse_salary(summary), F.lit(None).cast("boolean")
    return df.select(
        *[F.col(c) for c in df.columns if c == seq],
        F.coalesce(title, F.lit("")).alias("title"), company.alias("company"), location.alias("location"),
        salary.alias("salary"), F.coalesce("link", F.lit("")).alias("url"), F.lit(source).alias("source"),
        P.parse_rfc822("pubDate", as_of).alias("posted_date"), easy.alias("easy_apply"),
        F.lit(None).cast("int").alias("applicants"), F.left(summary, F.lit(TEXT_CHARS)).alias("description"),
    ).where(F.length("title") > 0)
