"""Canonical row types and the column policies of the keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

# All timestamps are UTC wall clock (TIMESTAMP_NTZ): results never depend on the
# session time zone.
POSTING = """
    id BIGINT, title STRING, company STRING, location STRING, salary INT, url STRING, source STRING,
    score INT, llm_score INT, llm_reason STRING, llm_summary STRING, posted_date TIMESTAMP_NTZ,
    easy_apply BOOLEAN, applicants INT, description STRING, job_type STRING, role_category STRING,
    skills ARRAY<STRING>, scraped_at TIMESTAMP_NTZ, notified BOOLEAN, applied BOOLEAN, saved BOOLEAN,
    notes STRING
"""
SOCIAL_POST = """
    id BIGINT, post_text STRING, author_name STRING, author_headline STRING, author_profile_url STRING,
    extracted_title STRING, extracted_company STRING, contact_email STRING, contact_linkedin STRING,
    contact_name STRING, post_url STRING, posted_date TIMESTAMP_NTZ, scraped_at TIMESTAMP_NTZ,
    is_job_posting BOOLEAN, score INT, role_category STRING, applied BOOLEAN, saved BOOLEAN
"""
FEEDBACK = "job_id BIGINT, source_table STRING, liked BOOLEAN, rated_at TIMESTAMP_NTZ"
STAGE = "job_id BIGINT, status STRING"
PROFILE = """
    doc_id BIGINT, name STRING, email STRING, phone STRING, title STRING, years_experience INT,
    skills ARRAY<STRING>, companies ARRAY<STRING>, education STRING, summary STRING
"""
PATCH = "id BIGINT, supplied ARRAY<STRING>, applied BOOLEAN, saved BOOLEAN, notes STRING"

# What a feed emits, before dedup and scoring.
FEED_COLUMNS = (
    "title", "company", "location", "salary", "url", "source", "posted_date", "easy_apply", "applicants",
    "description", "job_type",
)

# Metadata policy: on a key match these columns come from the batch ...
METADATA_UPDATED = (
    "score", "llm_score", "llm_reason", "llm_summary", "skills", "salary", "applicants", "description",
    "role_category", "job_type", "scraped_at",
)
# ... and these are written only when the key is new.
METADATA_INSERT_ONLY = ("title", "company", "location", "source", "posted_date", "easy_apply")
# User state survives every upsert; value for new rows.
USER_STATE = {"notified": False, "applied": False, "saved": False, "notes": None}

# Overwrite policy: the 17 posting and 14 post columns a batch supplies.
OVERWRITE_POSTING = (
    "title", "company", "location", "salary", "source", "score", "llm_score", "llm_reason", "llm_summary",
    "posted_date", "easy_apply", "applicants", "description", "job_type", "role_category", "skills",
)
OVERWRITE_POST = (
    "post_text", "author_name", "author_headline", "author_profile_url", "extracted_title",
    "extracted_company", "contact_email", "contact_linkedin", "contact_name", "posted_date",
    "is_job_posting", "score", "role_category",
)

EXPORT_HEADER = (
    "Title", "Company", "Location", "Salary", "Score", "Source", "Posted Date", "Easy Apply", "Applicants", "URL",
)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Exactly the columns and types of *ddl*.

    A missing column is NULL, a list in a text column is joined by ', ', and a value that
    does not fit its type becomes NULL; no row fails.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    cells = []
    for field in StructType.fromDDL(ddl).fields:
        cell = F.col(field.name) if field.name in have else F.lit(None)
        if isinstance(have.get(field.name), ArrayType) and isinstance(field.dataType, StringType):
            cell = F.array_join(cell, ", ")
        elif have.get(field.name) != field.dataType:
            cell = cell.try_cast(field.dataType)
        cells.append(cell.alias(field.name))
    return df.select(*cells)
