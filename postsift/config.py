"""Keyword dictionaries and thresholds.

Fixed values: every word list and number in this module has to equal the rule it
states, otherwise scores and filters differ.  They are plain data; the operators
take them through :class:`Rules`, so another domain only needs another instance.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# -- fixed values: role phrases, tested in this order -------------------------
ROLE_PHRASES: dict[str, tuple[str, ...]] = {
    "data_engineer": (
        "data engineer", "data engineering", "etl engineer", "pipeline engineer", "analytics engineer",
        "data platform engineer", "data infrastructure engineer", "big data engineer",
    ),
    "ai_engineer": (
        "ai engineer", "artificial intelligence engineer", "llm engineer", "generative ai engineer",
        "prompt engineer", "ai/ml engineer",
    ),
    "ml_engineer": (
        "machine learning engineer", "ml engineer", "mlops engineer", "ml platform engineer",
        "applied ml engineer", "deep learning engineer",
    ),
    "nlp_engineer": (
        "nlp engineer", "natural language processing engineer", "conversational ai engineer", "speech engineer",
    ),
    "cv_engineer": ("computer vision engineer", "cv engineer", "vision ai engineer"),
    "data_scientist": ("data scientist", "applied scientist", "research scientist", "ml scientist"),
}
# Looser phrases tried after all of the above.
ROLE_FALLBACKS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("data_engineer", ("data engineer", "etl", "pipeline")),
    ("ai_engineer", ("ai engineer", "artificial intelligence")),
    ("ml_engineer", ("machine learning", "ml engineer", "mlops")),
    ("data_scientist", ("data scientist",)),
)
DEFAULT_ROLE = "data_engineer"

# -- fixed values: job types --------------------------------------------------
JOB_TYPES = ("full_time", "contract", "contract_to_hire", "part_time")
JOB_TYPE_PHRASES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("contract_to_hire", ("contract to hire", "contract-to-hire", "c2h")),
    ("contract", ("contract", "contractor", "1099", "corp to corp", "c2c")),
    ("part_time", ("part time", "part-time")),
)
DEFAULT_JOB_TYPE = "full_time"

# -- fixed values: scoring dictionaries ---------------------------------------
CORE_TITLE_TERMS = (
    "data engineer", "etl engineer", "pipeline engineer", "analytics engineer", "ml engineer",
    "machine learning engineer", "data pipeline", "etl developer",
)
TECH_TITLE_TERMS = (
    "spark", "kafka", "airflow", "dbt", "snowflake", "databricks", "bigquery", "redshift", "flink",
    "beam", "hive", "hadoop", "aws", "gcp", "azure", "python", "sql",
)
DESCRIPTION_TERMS = (
    "data pipeline", "etl", "spark", "kafka", "airflow", "dbt", "sql", "python", "cloud", "aws", "gcp",
    "azure", "data warehouse", "snowflake", "databricks", "bigquery", "redshift", "flink", "beam", "hive",
    "tensorflow", "pytorch", "scikit-learn", "llm", "gpt", "transformer", "mlflow", "kubeflow", "ray",
    "kubernetes", "docker", "machine learning", "deep learning", "neural network",
)
PREFERRED_COMPANIES = (
    "google", "deepmind", "amazon", "aws", "microsoft", "azure", "meta", "facebook", "apple", "openai",
    "anthropic", "nvidia", "databricks", "snowflake", "palantir", "scale ai", "cohere", "hugging face",
    "netflix", "uber", "airbnb", "stripe",
)
REMOTE_TERMS = ("remote", "hybrid")

# -- fixed values: filters ----------------------------------------------------
EXCLUDED_TERMS = (
    "unpaid", "10+ years", "15+ years", "principal engineer", "staff engineer", "vp of", "vice president",
)
MIN_SALARY = 80_000
MAX_AGE_HOURS = 48
MAX_APPLICANTS = 200

# -- fixed values: point tables (bound, points), first match wins -------------
FRESHNESS_POINTS = ((12, 25), (24, 20), (48, 10), (72, 5))  # age in hours <= bound
APPLICANT_POINTS = ((25, 20), (50, 15), (100, 10))  # applicants < bound
APPLICANT_UNKNOWN_POINTS = 10
SALARY_POINTS = ((150_000, 10), (100_000, 5))  # salary >= bound
CORE_TITLE_POINTS, TECH_TITLE_POINTS = 20, 10
TERM_POINTS, TERM_POINTS_CAP = 3, 15
EASY_APPLY_POINTS, REMOTE_POINTS, COMPANY_POINTS = 15, 10, 15
SCORE_CAP = 100

# -- fixed values: output thresholds ------------------------------------------
ALERT_SCORE = 50
POST_ALERT_SCORE = 40
DIGEST_ROWS, ALERT_ROWS, POST_ALERT_ROWS = 10, 15, 20
GRID_ROWS, POST_GRID_ROWS = 500, 200
ENRICH_ROWS = 150
SIMILARITY = 0.97

# -- fixed values: forum and social gates -------------------------------------
FORUM_MIN_CHARS, FORUM_TEXT_CHARS = 80, 3000
FORUM_RELEVANT_TERMS = (
    "data engineer", "machine learning", "ml engineer", "ai engineer", "llm", "generative ai",
    "data pipeline", "etl", "data scientist", "mlops", "nlp engineer", "computer vision", "data platform",
    "spark", "kafka", "airflow", "dbt", "snowflake", "databricks",
)
FORUM_SIGNAL_TERMS = (
    "we're hiring", "we are hiring", "we're looking", "we are looking", "join us", "join our team",
    "we need", "apply at", "apply via", "|", "remote", "onsite", "full-time", "contract",
)
FORUM_DEFAULT_TITLE = "Software Engineer (Data/AI)"
FORUM_DEFAULT_COMPANY = "Unknown Company (HN)"
FORUM_DEFAULT_LOCATION = "USA"
FORUM_SOURCE = "HackerNews"
FORUM_ITEM_URL = "https://news.ycombinator.com/item?id="

POST_MIN_CHARS, POST_TEXT_CHARS = 50, 2000
POST_TRIGGERS = (
    "we're hiring", "we are hiring", "looking for a", "open position", "job opening", "reach out", "dm me",
    "send resume", "send your cv", "apply now", "referral", "opportunity", "we need a", "join our team",
    "contact me", "email me", "#hiring", "#datajobs", "#aiengineerjobs",
)
POST_DEFAULT_SCORE = 40
POST_INVALID_REPLY_SCORE = 30
REPLY_DEFAULT_SCORE = 50

# -- fixed values: skills -----------------------------------------------------
PROFILE_SKILLS = (
    "Python", "SQL", "Spark", "Kafka", "Airflow", "dbt", "Snowflake", "Databricks", "BigQuery", "Redshift",
    "AWS", "GCP", "Azure", "Docker", "Kubernetes", "TensorFlow", "PyTorch", "scikit-learn", "MLflow",
    "Kubeflow", "Flink", "Beam", "Hive", "Hadoop", "Machine Learning", "Deep Learning", "LLM", "Transformers",
)
PROFILE_DEFAULT_TITLE = "Data Engineer"
DEMAND_SKILLS = (
    "python", "sql", "spark", "kafka", "airflow", "dbt", "snowflake", "databricks", "bigquery", "redshift",
    "aws", "gcp", "azure", "docker", "kubernetes", "tensorflow", "pytorch", "scikit-learn", "mlflow",
    "flink", "hadoop", "llm", "transformers", "ray", "scala", "java", "go", "rust", "git", "terraform",
    "fastapi",
)
DEMAND_ROWS, GAP_ROWS, HEATMAP_ROWS = 20, 10, 30

# -- fixed values: site labels of the tabular feed ----------------------------
SITE_LABELS = {
    "linkedin": "LinkedIn", "indeed": "Indeed", "glassdoor": "Glassdoor", "zip_recruiter": "ZipRecruiter",
    "google": "Google",
}
TABULAR_SOURCE = "JobSpy"

# -- fixed values: board columns and histogram buckets ------------------------
STAGES = ("saved", "applied", "phone_screen", "technical", "offer", "rejected")
SCORE_BUCKETS = ((0, 20), (21, 40), (41, 60), (61, 80), (81, 100))


@dataclass(frozen=True)
class Rules:
    """One set of dictionaries and thresholds for classify, filter and score."""

    role_phrases: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(ROLE_PHRASES))
    role_fallbacks: tuple[tuple[str, tuple[str, ...]], ...] = ROLE_FALLBACKS
    default_role: str = DEFAULT_ROLE
    job_types: tuple[str, ...] = JOB_TYPES
    job_type_phrases: tuple[tuple[str, tuple[str, ...]], ...] = JOB_TYPE_PHRASES
    default_job_type: str = DEFAULT_JOB_TYPE
    core_title_terms: tuple[str, ...] = CORE_TITLE_TERMS
    tech_title_terms: tuple[str, ...] = TECH_TITLE_TERMS
    description_terms: tuple[str, ...] = DESCRIPTION_TERMS
    preferred_companies: tuple[str, ...] = PREFERRED_COMPANIES
    remote_terms: tuple[str, ...] = REMOTE_TERMS
    excluded_terms: tuple[str, ...] = EXCLUDED_TERMS
    min_salary: int = MIN_SALARY
    max_age_hours: int = MAX_AGE_HOURS
    max_applicants: int = MAX_APPLICANTS
    easy_apply_only: bool = False
    match: str = "substring"  # or "word"

    @property
    def text_terms(self) -> tuple[str, ...]:
        """All terms that the rules look for in descriptions."""
        phrases = (t for _, terms in self.job_type_phrases for t in terms)
        return tuple(dict.fromkeys((*self.description_terms, *self.excluded_terms, *phrases)))


DEFAULT_RULES = Rules()
