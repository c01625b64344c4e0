"""Landed JSON feeds to canonical rows.

A feed is data: the schema of what is read, where the items are, and one expression per
canonical column.  A JSON null reads like an absent field.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postsift.functions import parse as P, text as T
from postsift.operators.dedup import distinct_first

TEXT_CHARS = 500  # fixed value: description length of most feeds

Build = Callable[[Column, Column], Column]  # (item, as_of) -> column


@dataclass(frozen=True)
class FeedSpec:
    source: str
    schema: str  # of one payload
    items: Callable[[Column], Column]  # payload -> array of items
    fields: Mapping[str, Build] = field(default_factory=dict)
    distinct: str | None = "url"  # key whose first row is kept
    blank: str = "drop"  # see distinct_first


# What a feed gets for the columns it does not define.
_DEFAULTS: dict[str, Build] = {
    "salary": lambda x, now: F.lit(None).cast("int"),
    "easy_apply": lambda x, now: F.lit(None).cast("boolean"),
    "applicants": lambda x, now: F.lit(None).cast("int"),
    "job_type": lambda x, now: F.lit(None).cast("string"),
}


def _text(name: str, default: str = "") -> Build:
    return lambda x, now: F.coalesce(x[name], F.lit(default))


def _short(name: str) -> Build:
    return lambda x, now: F.left(F.coalesce(x[name], F.lit("")), F.lit(TEXT_CHARS))


def _iso(name: str) -> Build:
    return lambda x, now: P.parse_iso(x[name], now)


def _flag(value: bool) -> Build:
    return lambda x, now: F.lit(value)


def _filled(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def _array(name: str) -> Callable[[Column], Column]:
    return lambda payload: payload[name]


def _dice_location(x: Column, now: Column) -> Column:
    raw = x["jobLocation"]  # an object or a list of objects
    name = F.coalesce(F.get_json_object(raw, "$.displayName"), F.get_json_object(raw, "$[0].displayName"), F.lit(""))
    return F.when((name == "") & F.coalesce(x["isRemote"], F.lit(False)), F.lit("Remote")).otherwise(name)


def _usajobs_pay(x: Column, now: Column) -> Column:
    pay = F.get(x["MatchedObjectDescriptor.PositionRemuneration"], F.lit(0))
    low, high = (F.nullif(pay[n], F.lit("")).try_cast("double") for n in ("MinimumRange", "MaximumRange"))
    return F.coalesce((low + high) / 2, low).try_cast("int")


def _remoteok_pay(x: Column, now: Column) -> Column:
    low = F.coalesce(F.nullif(x["salary_min"], F.lit(0.0)), x["annual_salary_min"])
    high = F.coalesce(F.nullif(x["salary_max"], F.lit(0.0)), x["annual_salary_max"])
    return P.midpoint(low, high)


_D = "MatchedObjectDescriptor."

FEEDS: dict[str, FeedSpec] = {
    spec.source: spec
    for spec in (
        FeedSpec(
            "Dice",
            "data ARRAY<STRUCT<title:STRING, companyName:STRING, jobLocation:STRING, detailsPageUrl:STRING, "
            "easyApply:BOOLEAN, isRemote:BOOLEAN, salary:STRING, postedDate:STRING, summary:STRING>>",
            _array("data"),
            {
                "title": _text("title"), "company": _text("companyName"), "location": _dice_location,
                "salary": lambda x, now: P.parse_salary(x["salary"], "hour"), "url": _text("detailsPageUrl"),
                "posted_date": _iso("postedDate"), "description": _short("summary"),
                "easy_apply": lambda x, now: F.coalesce(x["easyApply"], F.lit(False)),
            },
            distinct=None,
        ),
        FeedSpec(
            "Arbeitnow",
            "data ARRAY<STRUCT<slug:STRING, title:STRING, company_name:STRING, location:STRING, url:STRING, "
            "remote:BOOLEAN, tags:ARRAY<STRING>, description:STRING, created_at:STRING>>",
            _array("data"),
            {
                "title": _text("title"), "company": _text("company_name"), "url": _text("url"),
                "location": lambda x, now: _filled(x["location"], "Remote"),
                "posted_date": lambda x, now: P.parse_epoch(F.coalesce(x["created_at"], F.lit("0")), now),
                "description": lambda x, now: T.strip(
                    F.concat(_short("description")(x, now), F.lit(" "), F.coalesce(F.array_join(x["tags"], " "), F.lit("")))
                ),
                "slug": _text("slug"),
            },
            distinct="slug", blank="keep_one",
        ),
        FeedSpec(
            "Adzuna",
            "results ARRAY<STRUCT<title:STRING, company:STRUCT<display_name:STRING>, "
            "location:STRUCT<display_name:STRING>, redirect_url:STRING, description:STRING, salary_min:DOUBLE, "
            "salary_max:DOUBLE, created:STRING>>",
            _array("results"),
            {
                "title": _text("title"), "company": _text("company.display_name"), "location": _text("location.display_name"),
                "salary": lambda x, now: P.midpoint(x["salary_min"], x["salary_max"]), "url": _text("redirect_url"),
                "posted_date": _iso("created"), "description": _short("description"),
            },
            distinct=None,
        ),
        FeedSpec(
            "Remotive",
            "jobs ARRAY<STRUCT<title:STRING, company_name:STRING, candidate_required_location:STRING, salary:STRING, "
            "url:STRING, publication_date:STRING, description:STRING>>",
            _array("jobs"),
            {
                "title": _text("title"), "company": _text("company_name"),
                "location": _text("candidate_required_location", "Remote"),
                "salary": lambda x, now: P.parse_salary(x["salary"]), "url": _text("url"),
                "posted_date": _iso("publication_date"), "description": _short("description"), "easy_apply": _flag(True),
            },
        ),
        FeedSpec(
            "Himalayas",
            "jobs ARRAY<STRUCT<title:STRING, companyName:STRING, locationRestrictions:ARRAY<STRING>, salaryMin:DOUBLE, "
            "salaryMax:DOUBLE, applicationLink:STRING, url:STRING, publishedAt:STRING, description:STRING>>",
            _array("jobs"),
            {
                "title": _text("title"), "company": _text("companyName"),
                "location": lambda x, now: _filled(F.array_join(x["locationRestrictions"], ", "), "Remote"),
                "salary": lambda x, now: P.midpoint(x["salaryMin"], x["salaryMax"], missing_is_zero=True),
                "url": lambda x, now: F.coalesce(x["applicationLink"], x["url"], F.lit("")),
                "posted_date": _iso("publishedAt"), "description": _short("description"), "easy_apply": _flag(True),
            },
        ),
        FeedSpec(
            "Jobicy",
            "jobs ARRAY<STRUCT<jobTitle:STRING, companyName:STRING, jobGeo:STRING, annualSalaryMin:STRING, url:STRING, "
            "pubDate:STRING, jobDescription:STRING>>",
            _array("jobs"),
            {
                "title": _text("jobTitle"), "company": _text("companyName"), "location": _text("jobGeo", "Remote"),
                "salary": lambda x, now: P.parse_salary(x["annualSalaryMin"]), "url": _text("url"),
                "posted_date": lambda x, now: P.parse_pattern(x["pubDate"], "yyyy-MM-dd HH:mm:ss", now),
                "description": _short("jobDescription"), "easy_apply": _flag(True),
            },
        ),
        FeedSpec(
            "Jooble",
            "jobs ARRAY<STRUCT<title:STRING, company:STRING, location:STRING, salary:STRING, link:STRING, "
            "updated:STRING, snippet:STRING>>",
            _array("jobs"),
            {
                "title": _text("title"), "company": _text("company"), "location": _text("location", "United States"),
                "salary": lambda x, now: P.parse_salary(x["salary"]), "url": _text("link"),
                "posted_date": lambda x, now: P.parse_iso(x["updated"], P.parse_relative(x["updated"], now)),
                "description": _short("snippet"),
            },
        ),
        FeedSpec(
            "WorkingNomads",
            "ARRAY<STRUCT<title:STRING, company:STRING, location:STRING, url:STRING, pub_date:STRING, description:STRING>>",
            lambda payload: payload,
            {
                "title": _text("title"), "company": _text("company"),
                "location": lambda x, now: _filled(x["location"], "Remote"), "url": _text("url"),
                "posted_date": _iso("pub_date"), "description": _short("description"), "easy_apply": _flag(True),
            },
        ),
        FeedSpec(
            "USAJobs",
            "SearchResult STRUCT<SearchResultItems:ARRAY<STRUCT<MatchedObjectDescriptor:STRUCT<PositionTitle:STRING, "
            "PublicationStartDate:STRING, PositionLocation:ARRAY<STRUCT<LocationName:STRING>>, "
            "PositionRemuneration:ARRAY<STRUCT<MinimumRange:STRING, MaximumRange:STRING>>, OrganizationName:STRING, "
            "PositionURI:STRING, QualificationSummary:STRING>>>>",
            lambda payload: payload["SearchResult"]["SearchResultItems"],
            {
                "title": _text(_D + "PositionTitle"), "company": _text(_D + "OrganizationName", "US Government"),
                "location": lambda x, now: F.coalesce(F.get(x[_D + "PositionLocation"], F.lit(0))["LocationName"], F.lit("United States")),
                "salary": _usajobs_pay, "url": _text(_D + "PositionURI"), "posted_date": _iso(_D + "PublicationStartDate"),
                "description": _short(_D + "QualificationSummary"), "easy_apply": _flag(False),
                "job_type": lambda x, now: F.lit("full_time"),
            },
        ),
        FeedSpec(
            "TheMuse",
            "results ARRAY<STRUCT<name:STRING, publication_date:STRING, locations:ARRAY<STRUCT<name:STRING>>, "
            "company:STRUCT<name:STRING>, refs:STRUCT<landing_page:STRING>, contents:STRING>>",
            _array("results"),
            {
                "title": _text("name"), "company": _text("company.name"),
                "location": lambda x, now: F.coalesce(F.get(x["locations"], F.lit(0))["name"], F.lit("United States")),
                "url": _text("refs.landing_page"), "posted_date": _iso("publication_date"), "description": _short("contents"),
            },
        ),
        FeedSpec(
            "RemoteOK",
            "ARRAY<STRUCT<id:STRING, position:STRING, company:STRING, location:STRING, url:STRING, tags:ARRAY<STRING>, "
            "salary_min:DOUBLE, salary_max:DOUBLE, annual_salary_min:DOUBLE, annual_salary_max:DOUBLE, epoch:STRING, "
            "applicants:INT>>",
            # the first element is a legal notice
            lambda payload: F.slice(payload, F.lit(2), F.greatest(F.size(payload), F.lit(1))),
            {
                "title": _text("position"), "company": _text("company"),
                "location": lambda x, now: _filled(x["location"], "Remote"),
                "salary": _remoteok_pay, "applicants": lambda x, now: x["applicants"],
                "url": lambda x, now: F.coalesce(x["url"], F.concat(F.lit("https://remoteok.com/l/"), F.coalesce(x["id"], F.lit("")))),
                "posted_date": lambda x, now: P.parse_epoch(F.nullif(x["epoch"], F.lit("0")), now),
                "description": lambda x, now: F.coalesce(F.array_join(x["tags"], " "), F.lit("")), "easy_apply": _flag(True),
            },
            blank="keep_one",
        ),
    )
}


def _parsed(raw: DataFrame, spec: FeedSpec, payload: str) -> Column:
    # FAILFAST would end the job; PERMISSIVE gives NULL for an unreadable payload
    return F.from_json(F.col(payload), spec.schema, {"mode": "PERMISSIVE"})


def normalize_feed(
    raw: DataFrame, spec: FeedSpec, as_of: Column, *, payload: str = "payload", seq: str = "seq", distinct: bool = True
) -> DataFrame:
    """Canonical rows of landed payloads; rows without a title are dropped.

    *seq* orders the payloads; the position inside the payload completes the order.
    """
    # wide payloads are parsed once, then exploded
    items = raw.select(F.col(seq).alias("_seq"), F.posexplode(spec.items(_parsed(raw, spec, payload))).alias("pos", "_x"))
    build = {**_DEFAULTS, **spec.fields}
    # dotted names reach into nested structs
    x = _Item("_x")
    rows = items.select(
        F.col("_seq").alias("seq"), "pos", F.lit(spec.source).alias("source"),
        *[make(x, as_of).alias(name) for name, make in build.items()],
    ).where(F.length("title") > 0)
    if distinct and spec.distinct:
        rows = distinct_first(rows, spec.distinct, ("seq", "pos"), blank=spec.blank)
    return rows.drop("slug")


class _Item:
    """x["a.b"] as a column path below the exploded item."""

    def __init__(self, name: str):
        self.name = name

    def __getitem__(self, path: str) -> Column:
        return F.col(f"{self.name}.{path}")


def quarantine(raw: DataFrame, spec: FeedSpec, *, payload: str = "payload") -> DataFrame:
    """The payloads that hold no readable item list."""
    return raw.where(spec.items(_parsed(raw, spec, payload)).isNull())


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Landed files, one payload per file; the file name is *seq*."""
    files = spark.read.option("wholetext", True).text(path)
    return files.select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("seq"))
