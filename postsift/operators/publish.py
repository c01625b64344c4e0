"""Outputs: exports, digests, alerts and the run summary, as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from postsift import config as C, schema as S
from postsift.functions import text as T
from postsift.operators.dedup import distinct_first
from postsift.operators.score import combined_score

# Score bands (bound, label) and the label below all bounds.
DIGEST_BANDS = ((65, "#22c55e"), (40, "#f59e0b"))
DIGEST_LOWEST = "#ef4444"
ALERT_BANDS = ((80, "🟢"), (60, "🟡"))
ALERT_LOWEST = "🟠"
CARD_BANDS = ((80, "green"), (60, "yellow"), (40, "orange"))
CARD_LOWEST = "red"
MODEL_BANDS = ((80, "green"), (60, "yellow"))
MODEL_LOWEST = "slate"  # also the bands of social posts
TOTAL = "TOTAL RAW"  # fixed value: the name of the total row


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """Plans as one TakeOrdered: each task keeps k rows, nothing is sorted as a whole."""
    return df.orderBy(*order).limit(k)


def numbered(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """Row numbers for a result that is already cut to a few rows."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def anti_new(batch: DataFrame, existing: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """Batch rows whose key is not stored yet, the first one per key."""
    # one row per key first: a key that fills the batch then costs the join one row
    first = distinct_first(batch, key, order_by, blank="keep_one")
    return first.join(existing.select(key), key, "left_anti").select(*batch.columns)


def export_rows(df: DataFrame) -> DataFrame:
    """The ten display columns of the spreadsheet export."""
    posted = F.date_format(F.coalesce("posted_date", "scraped_at"), "yyyy-MM-dd HH:mm")
    applicants = F.col("applicants").cast("string")
    cells = (
        T.as_text("title"), T.as_text("company"), T.as_text("location"), T.money("salary"), F.coalesce("score", F.lit(0)),
        T.as_text("source"), F.coalesce(posted, F.lit("")), T.yes_no("easy_apply"),
        F.when(applicants.isNull() | applicants.isin("", "0"), F.lit("N/A")).otherwise(applicants), T.as_text("url"),
    )
    return df.select(*[cell.alias(name) for cell, name in zip(cells, S.EXPORT_HEADER)])


def write_export(df: DataFrame, existing: DataFrame, path: str, order_by: Sequence[str]) -> None:
    """Append the rows that the export does not hold yet as CSV files with a header."""
    export_rows(anti_new(df, existing, "url", order_by)).write.mode("append").option("header", True).csv(path)


def digest(df: DataFrame, tie_break: str, n: int = C.DIGEST_ROWS, total: Column | None = None) -> DataFrame:
    """The n best rows with rank, pay text, colour band and the totals of the header line.

    *total* is the number of rows if the caller knows it; counting them reads *df* again.
    """
    order = (F.desc("score"), F.col(tie_break))
    top = numbered(top_k(df, n, *order), *order)
    if total is None:
        total = df.agg(F.count(F.lit(1))).scalar()
    return top.select(
        "rank", tie_break, "title", "company", "location", "score",
        T.money("salary", "Not listed", "/yr").alias("salary_text"),
        F.coalesce(F.date_format("posted_date", "MMM dd, yyyy"), F.lit("")).alias("posted_text"),
        F.coalesce("easy_apply", F.lit(False)).alias("easy_badge"),
        T.band("score", DIGEST_BANDS, DIGEST_LOWEST).alias("colour"),
        T.as_text("url").alias("url"),
        total.alias("total_rows"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("shown_rows"),
    )


def _lines(*lines: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def _filled(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def alert_text() -> Column:
    """Message of one posting; lines without content are left out.  Fixed message format."""
    model = F.when(F.col("llm_score").isNotNull(), F.concat(F.lit("  🤖 AI: `"), F.col("llm_score").cast("string"), F.lit("`")))
    kind = F.replace(T.as_text("job_type"), F.lit("_"), F.lit("\\-"))
    source = T.escape_markdown(T.as_text("source"))
    summary = T.escape_markdown(F.left(T.as_text("llm_summary"), F.lit(200)))
    skills = F.array_join(F.slice("skills", 1, 5), " · ")
    url = T.as_text("url")
    return _lines(
        F.concat(T.band("score", ALERT_BANDS, ALERT_LOWEST), F.lit(" *"), T.escape_markdown(T.as_text("title")), F.lit("*")),
        F.concat(F.lit("🏢 "), T.escape_markdown(T.as_text("company")), F.lit(" · 📍 "), T.escape_markdown(T.as_text("location"))),
        F.concat(F.lit("📊 Score: `"), F.col("score").cast("string"), F.lit("`"), F.coalesce(model, F.lit(""))),
        F.when(T.known_amount("salary"), F.concat(F.lit("💰 $"), F.format_number("salary", 0), F.lit("/yr"))),
        F.when(_filled(kind), F.concat(F.lit("📋 "), kind)),
        F.when(F.col("easy_apply"), F.lit("⚡ Easy Apply")),
        F.when(_filled(source), F.concat(F.lit("🔗 Source: "), source)),
        F.when(F.size("skills") > 0, F.concat(F.lit("🛠 "), skills)),
        F.when(_filled(summary), F.concat(F.lit("\n_"), summary, F.lit("_"))),
        F.when(_filled(url), F.concat(F.lit("\n[👉 Apply Here]("), url, F.lit(")"))),
    )


def post_alert_text() -> Column:
    """Message of one social post.  Fixed message format."""
    esc = {c: T.escape_markdown(T.as_text(c)) for c in ("author_name", "author_headline", "extracted_title", "extracted_company")}
    profile, link, mail, url = (T.as_text(c) for c in ("author_profile_url", "contact_linkedin", "contact_email", "post_url"))
    text = T.escape_markdown(F.left(T.as_text("post_text"), F.lit(400)))
    role = T.title_case(T.pretty_label(T.as_text("role_category")))
    at = F.when(_filled(esc["extracted_company"]), F.concat(F.lit(" @ "), esc["extracted_company"])).otherwise(F.lit(""))
    return _lines(
        F.concat(F.lit("📢 *LinkedIn Recruiter Post* — Score `"), F.col("score").cast("string"), F.lit("`")),
        F.when(_filled(profile), F.concat(F.lit("👤 ["), esc["author_name"], F.lit("]("), profile, F.lit(")"))).otherwise(
            F.concat(F.lit("👤 *"), esc["author_name"], F.lit("*"))
        ),
        F.when(_filled(esc["author_headline"]), F.concat(F.lit("_"), esc["author_headline"], F.lit("_"))),
        F.when(_filled(esc["extracted_title"]), F.concat(F.lit("💼 "), esc["extracted_title"], at)),
        F.when(_filled(role), F.concat(F.lit("🏷 "), role)),
        F.when(_filled(mail), F.concat(F.lit("\n📧 *Email: `"), mail, F.lit("`*"))),
        F.when(_filled(link) & (link != profile), F.concat(F.lit("🔗 [Contact on LinkedIn]("), link, F.lit(")"))),
        F.when(_filled(text), F.concat(F.lit("\n"), text, F.lit("…"))),
        F.when(_filled(url), F.concat(F.lit("\n[👉 View Post on LinkedIn]("), url, F.lit(")"))),
    )


def job_alerts(df: DataFrame, tie_break: str, n: int = C.ALERT_ROWS) -> DataFrame:
    """The n rows with the best combined score, with their message."""
    out = df.withColumn("combined", combined_score())
    return top_k(out, n, F.desc("combined"), tie_break).withColumn("message", alert_text())


def post_alerts(posts: DataFrame, tie_break: str, n: int = C.POST_ALERT_ROWS, at_least: int = C.POST_ALERT_SCORE) -> DataFrame:
    """The n best posts, those with an address first."""
    out = posts.where(F.col("score") >= at_least).withColumn("has_email", _filled(F.col("contact_email")))
    return top_k(out, n, F.desc("has_email"), F.desc("score"), tie_break)


def top_table(df: DataFrame, tie_break: str, n: int = 10) -> DataFrame:
    """The n best rows as the printed table shows them."""
    order = (F.desc("score"), F.col(tie_break))
    return numbered(top_k(df, n, *order), *order).select(
        "rank", "score", F.when(T.known_amount("llm_score"), F.col("llm_score").cast("string")).otherwise(F.lit("")).alias("model"),
        F.left(T.as_text("title"), F.lit(34)).alias("title"), F.left(T.as_text("company"), F.lit(19)).alias("company"), "job_type",
    )


def run_message(
    top: DataFrame, tie_break: str, raw: Column, kept: Column, new: Column, n: int = 5, heading: str = "🤖 *Run Complete*"
) -> DataFrame:
    """One row: the message after a run, with its counts and the n best rows.  Fixed message format."""
    order = (F.desc("score"), F.col(tie_break))
    line = F.concat(
        F.col("rank").cast("string"), F.lit("\\. `"), F.col("score").cast("string"), F.lit("` ["), T.escape_markdown(T.as_text("title")),
        F.lit(" @ "), T.escape_markdown(T.as_text("company")), F.lit("]("), T.as_text("url"), F.lit(")"),
    )
    best = numbered(top_k(top, n, *order), *order).select(F.struct("rank", line.alias("line")).alias("_r"))
    # at most n rows meet here
    lines = best.agg(F.transform(F.array_sort(F.collect_list("_r")), lambda r: r["line"]).alias("lines"))
    counts = [
        F.concat(F.lit(label), value.cast("string"), F.lit("`"))
        for label, value in (("📦 Raw collected: `", raw), ("✅ After filter:  `", kept), ("🆕 New in DB:     `", new))
    ]
    head = F.array(F.lit(heading), *counts, F.lit(""), F.lit(f"🏆 *Top {n} This Run:*"))
    return lines.select(F.array_join(F.concat(head, "lines"), "\n").alias("message"))


def run_summary(
    per_source: DataFrame, stages: Mapping[str, Column] | None = None, known: Mapping[str, Column] | None = None, source: str = "source"
) -> DataFrame:
    """(section, name, rows): counts per source label, then the size of each stage.

    *stages* are aggregates over the same rows and are taken in the same pass; *known* are values that the caller has.
    """
    stages, known = stages or {}, known or {}
    label = F.split_part(F.col(source), F.lit(":"), F.lit(1))
    slots = [value.alias(f"_s{i}") for i, value in enumerate(stages.values())]
    counted = per_source.withColumn("_label", label).rollup("_label").agg(
        F.count(F.lit(1)).alias("rows"), F.grouping("_label").alias("_all"), *slots)
    is_total = F.col("_all") == 1

    def line(section: str, name: Column, rows: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), name.alias("name"), rows.cast("bigint").alias("rows"))

    own = line("source", F.when(is_total, F.lit(TOTAL)).otherwise(F.col("_label")), F.col("rows"))
    sizes = [line("stage", F.lit(n), F.col(f"_s{i}")) for i, n in enumerate(stages)] + [line("stage", F.lit(n), v) for n, v in known.items()]
    return counted.select(F.inline(F.when(is_total, F.array(own, *sizes)).otherwise(F.array(own))))


def source_rollup(df: DataFrame, source: str = "source", total_label: str = TOTAL) -> DataFrame:
    """Rows per source, 'Prefix:x' counted under 'Prefix', and a total row."""
    label = F.split_part(F.col(source), F.lit(":"), F.lit(1))
    return (
        df.select(label.alias("label"))
        .rollup("label")
        .agg(F.count(F.lit(1)).alias("rows"), F.grouping("label").alias("all"))
        .select(F.when(F.col("all") == 1, F.lit(total_label)).otherwise(F.col("label")).alias("name"), "rows")
    )
