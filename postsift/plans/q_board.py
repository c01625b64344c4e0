"""Queries: dashboard reads, roll-ups, digests and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from postsift import config as C
from postsift.functions import text as T
from postsift.functions.text import computed_once
from postsift.operators import analytics, board, classify, dedup, publish, score
from postsift.plans import oracle as O, views as V
from postsift.plans.q_core import classified, scored
from postsift.plans.q_sources import social
from postsift.plans.registry import query

_CARD = ("id", "title", "company", "location", "score", "llm_score", "salary")


# -- listing view -------------------------------------------------------------
@query("grid_filter", O.with_(O.SCORED, """SELECT id, title, company, location, score, llm_score, salary FROM s
    WHERE role_category IN ('data_engineer') AND job_type IN ('full_time', 'contract') AND score >= 40 AND contains(lower(location), 'remote')
    AND easy_apply AND source IN ('src1', 'src2', 'src4', 'Search:BUILDING') AND contains(lower(title || ' ' || company || ' ' || location), 'data engineer c')"""))
def grid_filter(spark, sf):
    spec = board.GridFilter(
        role="data_engineer", job_types=("full_time", "contract"), sources=("src1", "src2", "src4", "Search:BUILDING"), min_score=40,
        remote_only=True, easy_apply_only=True, search="Data Engineer C")
    return board.grid_filter(scored(spark, sf), spec).select(*_CARD)


@query("tab_applied", O.with_(O.SCORED, "SELECT id, title, company, location, score, llm_score, salary FROM s WHERE applied AND contains(lower(title || ' ' || company || ' ' || location), 'scientist')"))
def tab_applied(spark, sf):
    spec = board.GridFilter(role="ml_engineer", tab="applied", search="scientist")
    return board.grid_filter(scored(spark, sf), spec).select(*_CARD)


@query("grid_sort", O.with_(O.SCORED, "SELECT id, CAST(coalesce(llm_score, score) AS INT) AS shown_score FROM s ORDER BY 2 DESC, 1"))
def grid_sort(spark, sf):
    out = board.grid_sort(scored(spark, sf).select("id", "score", "llm_score"), "score", "id")
    return out.select("id", score.preferred_score().alias("shown_score"))


@query("grid_sort_salary", O.with_(O.P, "SELECT id, salary FROM p ORDER BY coalesce(salary, 0) DESC, id"))
def grid_sort_salary(spark, sf):
    return board.grid_sort(V.postings(spark, sf).select("id", "salary"), "salary", "id")


@query("grid_sort_date", O.with_(O.P, "SELECT id, posted_date FROM p ORDER BY posted_date DESC NULLS LAST, id"))
def grid_sort_date(spark, sf):
    return board.grid_sort(V.postings(spark, sf).select("id", "posted_date"), "date", "id")


@query("posts_filter", O.with_(O.SOCIAL, """SELECT seq, author_name, score FROM sp WHERE contact_email <> '' AND score >= 35
    AND contains(lower(author_name || ' ' || extracted_title || ' ' || extracted_company || ' ' || post_text), 'user')"""))
def posts_filter(spark, sf):
    return board.posts_filter(social(spark, sf), email_only=True, min_score=35, search="User").select("seq", "author_name", "score")


@query("posts_top200", O.with_(O.SOCIAL, "SELECT seq, score FROM sp WHERE is_job_posting ORDER BY score DESC, seq LIMIT 200"))
def posts_top200(spark, sf):
    return board.posts_top(social(spark, sf), "seq").select("seq", "score")


@query("posts_top20", O.with_(O.SOCIAL, """SELECT seq, contact_email <> '' AS has_email, score FROM sp WHERE score >= 40 ORDER BY contact_email <> '' DESC, score DESC, seq LIMIT 20"""))
def posts_top20(spark, sf):
    return publish.post_alerts(social(spark, sf), "seq").select("seq", "has_email", "score")


# -- roll-ups -----------------------------------------------------------------
@query("score_histogram", O.with_(O.SCORED, " UNION ALL ".join(
    f"SELECT '{lo}–{hi}' AS score_range, count(*) AS postings FROM s WHERE score BETWEEN {lo} AND {hi}" for lo, hi in C.SCORE_BUCKETS)))
def score_histogram(spark, sf):
    return analytics.score_histogram(scored(spark, sf))


@query("count_by_source_top8", O.with_(O.P, "SELECT source, count(*) AS postings FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"))
def count_by_source_top8(spark, sf):
    return analytics.count_by_source(V.postings(spark, sf))


_OTHER = "CASE WHEN id % 37 = 0 THEN '' ELSE role_category END"


@query("count_by_role", O.with_(O.CLASS, f"SELECT coalesce(nullif({_OTHER}, ''), 'other') AS role, count(*) AS postings FROM c GROUP BY 1"))
def count_by_role(spark, sf):
    return analytics.count_by_role(classified(spark, sf).withColumn("role_category", F.expr(_OTHER)))


@query("count_by_type", O.with_(O.CLASS, "SELECT replace(job_type, '_', ' ') AS job_type, count(*) AS postings FROM c GROUP BY 1"))
def count_by_type(spark, sf):
    return analytics.count_by_type(classified(spark, sf))


@query("share_by_role", O.with_(O.CLASS, """SELECT role_category AS role, count(*) AS postings, CAST(floor(count(*) * 100 / sum(count(*)) OVER () + 0.5) AS BIGINT) AS percent FROM c GROUP BY 1"""))
def share_by_role(spark, sf):
    return analytics.share_by_role(classified(spark, sf))


@query("distinct_sources", O.with_(O.P, "SELECT DISTINCT source FROM p ORDER BY 1"))
def distinct_sources(spark, sf):
    return analytics.distinct_sources(V.postings(spark, sf))


@query("kpi_analytics", O.with_(O.SCORED + ", " + O.SOCIAL, """SELECT count(*) AS total, count(*) FILTER (WHERE score >= 80) AS score_80, round(count(*) FILTER (WHERE applied) * 100.0 / count(*), 1)::DOUBLE AS apply_rate,
    CAST(floor(avg(salary) FILTER (WHERE salary <> 0) / 1000 + 0.5) AS BIGINT) AS avg_salary_k, count(*) FILTER (WHERE applied) AS applied, count(*) FILTER (WHERE saved) AS saved,
    (SELECT count(*) FROM sp) AS posts, (SELECT count(*) FROM sp WHERE contact_email <> '') AS posts_with_email FROM s"""))
def kpi_analytics(spark, sf):
    return analytics.kpi_analytics(scored(spark, sf), social(spark, sf))


@query("kpi_stats", O.with_(O.SCORED + ", " + O.SOCIAL, """SELECT count(*) AS total, CAST(floor(avg(score) + 0.5) AS BIGINT) AS avg_score, count(*) FILTER (WHERE score >= 80) AS score_80,
    count(*) FILTER (WHERE job_type = 'full_time') AS full_time, count(*) FILTER (WHERE job_type LIKE '%contract%') AS contract, count(*) FILTER (WHERE salary <> 0) AS with_salary,
    count(*) FILTER (WHERE applied) AS applied, count(*) FILTER (WHERE saved) AS saved, (SELECT count(*) FROM sp) AS posts FROM s"""))
def kpi_stats(spark, sf):
    return analytics.kpi_stats(scored(spark, sf), social(spark, sf))


# -- digests and alerts -------------------------------------------------------
@query("digest_top10", O.with_(O.SCORED, """, t AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 10)
    SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rank, id, title, company, location, score,
    CASE WHEN salary IS NULL OR salary = 0 THEN 'Not listed' ELSE '$' || format('{:,}', salary) || '/yr' END AS salary_text,
    coalesce(strftime(posted_date, '%b %d, %Y'), '') AS posted_text, coalesce(easy_apply, false) AS easy_badge,
    CASE WHEN score >= 65 THEN '#22c55e' WHEN score >= 40 THEN '#f59e0b' ELSE '#ef4444' END AS colour, url, (SELECT count(*) FROM s) AS total_rows, count(*) OVER () AS shown_rows FROM t""").replace("\n, t AS", ", t AS"))
def digest_top10(spark, sf):
    total = V.postings(spark, sf).agg(F.count(F.lit(1))).scalar()
    return publish.digest(scored(spark, sf), "id", total=total)


@query("alerts_top15", O.with_(O.SCORED, "SELECT id, CAST(coalesce(llm_score, 0) + score AS INT) AS combined FROM s ORDER BY 2 DESC, 1 LIMIT 15"))
def alerts_top15(spark, sf):
    rows = scored(spark, sf).withColumns({"llm_summary": F.lit(""), "skills": F.array().cast("array<string>")})
    return publish.job_alerts(rows, "id").select("id", "combined")


def _esc(c: str) -> str:
    return f"regexp_replace({c}, '([_*\\[\\]()~`>#+\\-=|{{}}.!])', '\\\\\\1', 'g')"


def _line(test: str, text: str) -> str:
    return f"CASE WHEN {test} THEN {text} END"


@query("alert_text", O.with_(O.SCORED, f""", a AS (SELECT *, coalesce(description, '') AS llm_summary FROM s)
    SELECT id, concat_ws(chr(10), CASE WHEN score >= 80 THEN '🟢' WHEN score >= 60 THEN '🟡' ELSE '🟠' END || ' *' || {_esc('title')} || '*',
    '🏢 ' || {_esc('company')} || ' · 📍 ' || {_esc('location')}, '📊 Score: `' || score || '`' || coalesce('  🤖 AI: `' || llm_score || '`', ''),
    {_line('salary <> 0', "'💰 $' || format('{:,}', salary) || '/yr'")}, '📋 ' || replace(job_type, '_', '\\-'), {_line('easy_apply', "'⚡ Easy Apply'")},
    '🔗 Source: ' || {_esc('source')}, {_line('id % 2 = 0', "'🛠 a · b · c · d · e'")}, {_line("llm_summary <> ''", f"chr(10) || '_' || {_esc('left(llm_summary, 200)')} || '_'")},
    {_line("url <> ''", "chr(10) || '[👉 Apply Here](' || url || ')'")}) AS message FROM a""").replace("\n, a AS", ", a AS"))
def alert_text(spark, sf):
    skills = F.when(F.col("id") % 2 == 0, F.split(F.lit("a,b,c,d,e,f"), ","))
    # a message shows 200 characters of the summary
    rows = scored(spark, sf, keep=200).withColumns({"llm_summary": T.as_text("description"), "skills": skills})
    return rows.select("id", publish.alert_text().alias("message"))


@query("post_alert_text", O.with_(O.SOCIAL, f"""SELECT seq, concat_ws(chr(10), '📢 *LinkedIn Recruiter Post* — Score `' || score || '`',
    CASE WHEN author_profile_url <> '' THEN '👤 [' || {_esc('author_name')} || '](' || author_profile_url || ')' ELSE '👤 *' || {_esc('author_name')} || '*' END,
    {_line("author_headline <> ''", f"'_' || {_esc('author_headline')} || '_'")},
    {_line("extracted_title <> ''", f"'💼 ' || extracted_title || ' @ ' || {_esc('extracted_company')}")}, '🏷 Data Engineer',
    {_line("contact_email <> ''", "chr(10) || '📧 *Email: `' || contact_email || '`*'")}, chr(10) || {_esc('left(post_text, 400)')} || '…',
    {_line("post_url <> ''", "chr(10) || '[👉 View Post on LinkedIn](' || post_url || ')'")}) AS message FROM sp"""))
def post_alert_text(spark, sf):
    return social(spark, sf).select("seq", publish.post_alert_text().alias("message"))


_DROP = f"SELECT count(*) FROM c WHERE {O.REASON} IS NULL"


def _new_urls():
    return F.count_distinct(F.nullif("url", F.lit("")))


def _reasoned(spark, sf):
    """All postings with the reason that filters them out, each rule text read once."""
    rows = computed_once(V.postings(spark, sf, V.for_rules()), _text=classify.rule_text())
    return computed_once(rows, reason=classify.reject_reason(V.as_of(), text=F.col("_text"))).select("source", "url", "reason")


@query("run_funnel", O.with_(O.CLASS, f"""SELECT 'source' AS section, split_part(source, ':', 1) AS name, count(*) AS rows FROM p GROUP BY 2
    UNION ALL SELECT 'source', 'TOTAL RAW', count(*) FROM p
    UNION ALL SELECT 'stage', 'after filter', ({_DROP})
    UNION ALL SELECT 'stage', 'new urls', count(*) FROM (SELECT DISTINCT url FROM p WHERE url <> '')"""))
def run_funnel(spark, sf):
    rows = _reasoned(spark, sf)
    return publish.run_summary(rows, {"after filter": F.count_if(F.col("reason").isNull()), "new urls": _new_urls()})


# -- board --------------------------------------------------------------------
_STAGE = "CASE {} WHEN 'view' THEN 'saved' WHEN 'click' THEN 'applied' WHEN 'signup' THEN 'phone_screen' WHEN 'purchase' THEN 'offer' ELSE 'rejected' END"


def stages(spark, sf):
    """The last event of each user, read as the stage of the posting with that id."""
    last = V.table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    return last.select(F.col("user_id").alias("job_id"), F.expr(_STAGE.format("event_type")).alias("status"))


_STAGED = f"""st AS (SELECT user_id AS job_id, {_STAGE.format('arg_max(event_type, (ts, event_id))')} AS status FROM events GROUP BY 1),
    sg AS (SELECT p.id, coalesce(status, CASE WHEN applied THEN 'applied' WHEN saved THEN 'saved' END) AS stage FROM p LEFT JOIN st ON id = job_id)"""


@query("stage_assign", O.with_(f"{O.P}, {_STAGED}", "SELECT id, stage FROM sg"))
def stage_assign(spark, sf):
    return board.stage_assign(V.postings(spark, sf), stages(spark, sf)).select("id", "stage")


@query("stage_counts", O.with_(f"{O.P}, {_STAGED}", " UNION ALL ".join(
    f"SELECT CAST({i} AS INT) AS position, '{s}' AS stage, count(*) AS postings FROM sg WHERE stage = '{s}'" for i, s in enumerate(C.STAGES, 1))))
def stage_counts(spark, sf):
    return board.stage_counts(board.stage_assign(V.postings(spark, sf), stages(spark, sf)))


@query("untracked_top30", O.with_(f"{O.P}, {_STAGED}", "SELECT id FROM sg WHERE stage IS NULL ORDER BY id LIMIT 30"))
def untracked_top30(spark, sf):
    return board.untracked(board.stage_assign(V.postings(spark, sf), stages(spark, sf)), "id").select("id")


@query("card_labels", O.with_(O.CLASS, f"""SELECT id, replace(job_type, '_', '-') AS type_label, replace(role_category, '_', ' ') AS role_label,
    CASE WHEN d = 0 THEN 'Today' ELSE d || 'd ago' END AS posted_label, 'a,b,c,d,e,f' AS shown_skills
    FROM (SELECT *, CAST(coalesce(floor({O.HOURS} / 24), 0) AS INT) AS d FROM c)"""))
def card_labels(spark, sf):
    rows = classified(spark, sf).withColumn("skills", F.split(F.lit("a,b,c,d,e,f,g"), ","))
    return rows.select("id", *board.card_labels(V.as_of())).withColumn("shown_skills", F.array_join("shown_skills", ","))


@query("run_top10", O.with_(O.SCORED, """SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS rank, score, CASE WHEN llm_score <> 0 THEN '' || llm_score ELSE '' END AS model,
    left(title, 34) AS title, left(company, 19) AS company, job_type FROM s ORDER BY score DESC, id LIMIT 10"""))
def run_top10(spark, sf):
    return publish.top_table(scored(spark, sf), "id")


@query("run_message", O.with_(O.SCORED, f"""SELECT '🤖 *Run Complete*' || chr(10) || '📦 Raw collected: `' || (SELECT count(*) FROM p) || '`' || chr(10) || '✅ After filter:  `' || (SELECT count(*) FROM c WHERE {O.REASON} IS NULL) || '`'
    || chr(10) || '🆕 New in DB:     `' || (SELECT count(DISTINCT url) FROM p WHERE url <> '') || '`' || chr(10) || chr(10) || '🏆 *Top 5 This Run:*' || chr(10)
    || string_agg(rank || '\\. `' || score || '` [' || {_esc('title')} || ' @ ' || {_esc('company')} || '](' || url || ')', chr(10) ORDER BY rank) AS message
    FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5"""))
def run_message(spark, sf):
    # the three counts are one value, taken in one pass
    counts = _reasoned(spark, sf).agg(F.struct(
        F.count(F.lit(1)).alias("raw"), F.count_if(F.col("reason").isNull()).alias("kept"), _new_urls().alias("new"))).scalar()
    return publish.run_message(scored(spark, sf), "id", *[counts[c] for c in ("raw", "kept", "new")])


@query("feedback_by_part", O.with_(O.SCORED, " UNION ALL ".join(
    f"""SELECT '{p}' AS part, count(*) FILTER (WHERE pt_{p} > 0) AS with_points, count(*) FILTER (WHERE pt_{p} > 0 AND quality = 1) AS liked_with,
    count(*) FILTER (WHERE pt_{p} = 0) AS without_points, count(*) FILTER (WHERE pt_{p} = 0 AND quality = 1) AS liked_without FROM s JOIN labels ON id = doc_id""" for p in score.PARTS)))
def feedback_by_part(spark, sf):
    rated = V.table(spark, sf, "labels").select(F.col("doc_id").alias("job_id"), (F.col("quality") == 1).alias("liked"))
    return score.feedback_by_part(scored(spark, sf, keep_parts=True), rated)
