"""Queries: text, salary and date expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from postsift.functions import parse as P, text as T
from postsift.operators import enrich
from postsift.plans import oracle as O, views as V
from postsift.plans.registry import query

_A = "CAST(floor(o_totalprice) AS BIGINT)"
PAY = f"""CASE o_orderkey % 8 WHEN 0 THEN '$' || ({_A} % 90 + 10) || ' - $' || ({_A} % 90 + 30) || ' per hour'
    WHEN 1 THEN '$' || ({_A} % 200) || 'k' WHEN 2 THEN '' || ({_A} % 9 + 1) || ',000/month'
    WHEN 3 THEN '1,' || ({_A} % 900 + 100) || ' per week' WHEN 4 THEN '$' || {_A}
    WHEN 5 THEN '' || ({_A} % 70) || '.50/hr' WHEN 6 THEN 'Competitive' ELSE ',' END"""
AGO = f"""CASE o_orderkey % 10 WHEN 0 THEN '' || ({_A} % 40) || ' hours ago' WHEN 1 THEN '' || ({_A} % 40) || ' min'
    WHEN 2 THEN '' || ({_A} % 40) || ' months' WHEN 3 THEN '' || ({_A} % 40) || 'd' WHEN 4 THEN '' || ({_A} % 40) || 'w'
    WHEN 5 THEN 'just now' WHEN 6 THEN '30+ days ago' WHEN 7 THEN '' || ({_A} % 40) || ' yr' WHEN 8 THEN '' || ({_A} % 40) || ' Days'
    ELSE '' END"""


def _orders(spark, sf, **cells):
    orders = V.table(spark, sf, "orders")
    return orders.select("o_orderkey", *[F.expr(e).alias(c) for c, e in cells.items()])


def _numbers(text: str, keep: str) -> str:
    return f"""list_avg(list_filter(list_transform(regexp_extract_all({text}, '[0-9,]+'),
      lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)), lambda v: v {keep}))"""


def _scaled(mean: str, steps: str) -> str:
    return f"CAST(trunc({mean} * (CASE {steps} ELSE 1 END)) AS INT)"


_STEPS = {
    "general": "WHEN contains(l, 'hour') AND m < 1000 THEN 2080 WHEN contains(l, 'month') AND m < 50000 THEN 12 WHEN contains(l, 'week') AND m < 10000 THEN 52",
    "hour": "WHEN contains(l, 'hour') AND m < 1000 THEN 2080",
    "unbounded": "WHEN contains(l, 'hour') OR contains(l, '/hr') THEN 2080 WHEN contains(l, 'month') THEN 12",
    "hour_month": "WHEN contains(l, 'hour') AND m < 1000 THEN 2080 WHEN contains(l, 'month') AND m < 50000 THEN 12",
    "small_is_hourly": "WHEN m < 1000 THEN 2080",
}
_PAY = f"WITH q AS (SELECT o_orderkey, {PAY} AS pay FROM orders), r AS (SELECT *, lower(pay) AS l, {_numbers('pay', '> 0')} AS m, {_numbers('pay', '>= 0')} AS m0 FROM q)"


@query("parse_salary", f"{_PAY} SELECT o_orderkey, pay, {_scaled('m', _STEPS['general'])} AS salary FROM r")
def parse_salary(spark, sf):
    return _orders(spark, sf, pay=PAY).withColumn("salary", P.parse_salary("pay"))


@query("parse_salary_profiles", f"{_PAY} SELECT o_orderkey, " + ", ".join(
    f"{_scaled('m0' if k == 'unbounded' else 'm', v.replace('m <', ('m0' if k == 'unbounded' else 'm') + ' <'))} AS {k}" for k, v in _STEPS.items() if k != "general"
) + " FROM r")
def parse_salary_profiles(spark, sf):
    out = _orders(spark, sf, pay=PAY)
    return out.select("o_orderkey", *[P.parse_salary("pay", k).alias(k) for k in P.SALARY_STYLES if k != "general"])


_ENDS = {"low": f"CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 0 ELSE {_A} END", "high": f"CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE {_A} + 1001 END"}


@query("salary_midpoint", f"""WITH q AS (SELECT o_orderkey, nullif({_ENDS['low']}, 0) AS a, {_ENDS['high']} AS b FROM orders)
    SELECT o_orderkey, CAST(trunc(coalesce((a + b) / 2, a, b)) AS INT) AS one_sided,
    CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN CAST(trunc((coalesce(a, 0) + coalesce(b, 0)) / 2) AS INT) END AS zero_filled FROM q""")
def salary_midpoint(spark, sf):
    out = _orders(spark, sf, **_ENDS)
    return out.select("o_orderkey", P.midpoint("low", "high").alias("one_sided"), P.midpoint("low", "high", True).alias("zero_filled"))


@query("parse_relative_date", f"""WITH q AS (SELECT o_orderkey, lower({AGO}) AS t FROM orders),
    r AS (SELECT *, TRY_CAST(regexp_extract(t, '([0-9]+)\\s*([smhdw])', 1) AS BIGINT) AS n, regexp_extract(t, '([0-9]+)\\s*([smhdw])', 2) AS u,
      TRY_CAST(regexp_extract(t, '([0-9]+)\\s*([hd])', 1) AS BIGINT) AS n2, regexp_extract(t, '([0-9]+)\\s*([hd])', 2) AS u2,
      coalesce(TRY_CAST(regexp_extract(t, '[0-9]+') AS BIGINT), 1) AS n3 FROM q)
    SELECT o_orderkey, {O.AS_OF} - to_seconds(CASE WHEN contains(t, 'just') OR contains(t, 'now') OR contains(t, 'today') OR contains(t, 'moment') THEN 0
      ELSE coalesce(n * CASE u WHEN 's' THEN 1 WHEN 'm' THEN CASE WHEN contains(t, 'min') THEN 60 ELSE 2592000 END WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 WHEN 'w' THEN 604800 END, 0) END) AS general,
    {O.AS_OF} - to_seconds(CASE WHEN contains(t, 'today') OR contains(t, 'now') OR contains(t, 'just') THEN 0 ELSE coalesce(n2 * CASE u2 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 END, 0) END) AS hour_day,
    {O.AS_OF} - to_seconds(CASE WHEN contains(t, 'just') OR contains(t, 'today') THEN 0 WHEN contains(t, 'hour') THEN n3 * 3600 WHEN contains(t, 'day') THEN n3 * 86400 ELSE 0 END) AS words FROM r""")
def parse_relative_date(spark, sf):
    out = _orders(spark, sf, ago=AGO)
    return out.select("o_orderkey", *[P.parse_relative("ago", V.as_of(), k).alias(k) for k in ("general", "hour_day", "words")])


@query("parse_iso_wall", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN o_orderdate + CASE WHEN o_orderkey % 5 > 0 THEN INTERVAL 9 HOUR ELSE INTERVAL 0 HOUR END ELSE {O.AS_OF} END AS wall,
    CASE o_orderkey % 5 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate + INTERVAL 9 HOUR WHEN 2 THEN o_orderdate + INTERVAL 4 HOUR ELSE {O.AS_OF} END AS converted FROM orders""")
def parse_iso_wall(spark, sf):
    day = "date_format(o_orderdate, 'yyyy-MM-dd')"
    out = _orders(spark, sf, t=f"CASE o_orderkey % 5 WHEN 0 THEN {day} WHEN 1 THEN {day} || 'T09:00:00Z' WHEN 2 THEN {day} || 'T09:00:00+05:00' WHEN 3 THEN 'soon' END")
    return out.select("o_orderkey", P.parse_iso("t", V.as_of()).alias("wall"), P.parse_iso("t", V.as_of(), "convert").alias("converted"))


@query("parse_rfc822_date", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN {O.AS_OF} ELSE o_orderdate + INTERVAL 9 HOUR + INTERVAL 30 MINUTE END AS posted_date FROM orders""")
def parse_rfc822_date(spark, sf):
    text = "date_format(o_orderdate, 'dd MMM yyyy') || ' 09:30:00'"
    out = _orders(spark, sf, t=f"CASE o_orderkey % 3 WHEN 0 THEN 'Tue, ' || {text} || ' +0100' WHEN 1 THEN {text} || ' GMT' ELSE 'yesterday' END")
    return out.select("o_orderkey", P.parse_rfc822("t", V.as_of()).alias("posted_date"))


@query("title_split", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS company,
    CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_name ELSE p_name || ': ' || p_type END AS title FROM part""")
def title_split(spark, sf):
    text = "CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand || ' : ' || p_name || ' ' ELSE p_brand || ':' || p_name || ': ' || p_type END"
    company, title = T.split_label("t")
    return V.table(spark, sf, "part").select("p_partkey", F.expr(text).alias("t")).select("p_partkey", company.alias("company"), title.alias("title"))


_EMAIL = "[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+"  # fixed value


@query("extract_email", f"SELECT doc_id, regexp_extract(text, '{_EMAIL}') AS email FROM documents")
def extract_email(spark, sf):
    return V.texts(spark, sf, "documents", "doc_id").select("doc_id", T.first_email("text").alias("email"))


@query("extract_url", O.with_(
    f"{O.P}, cm AS (SELECT id AS comment_id, {O.COMMENT.replace('o_orderkey', 'id')} AS text FROM p)",
    f"SELECT comment_id, regexp_replace(regexp_extract({O._PLAIN}, 'https?://\\S+'), '[.,)>]+$', '') AS url FROM cm"))
def extract_url(spark, sf):
    return V.comments(spark, sf).select("comment_id", T.first_url_of_html("text").alias("url"))


_ENT = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
for _name, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _ENT = f"replace({_ENT}, '{_name}', '{_char}')"


@query("strip_html", f"SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, trim({_ENT}, E' \\t\\n\\r\u00a0') AS t FROM pages)")
def strip_html(spark, sf):
    out = V.texts(spark, sf, "pages", "page_id").select("page_id", T.plain_text("html").alias("t"))
    return out.select("page_id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("digest"))


@query("strip_html_full", f"SELECT page_id, md5(t) AS digest FROM (SELECT page_id, trim({_ENT}, E' \\t\\n\\r\u00a0') AS t FROM pages)")
def strip_html_full(spark, sf):
    return V.texts(spark, sf, "pages", "page_id").select("page_id", F.md5(T.plain_text("html", "full")).alias("digest"))


@query("url_clean", """SELECT page_id, split_part(url, '?', 1) AS clean, regexp_extract(url, '^[a-z]+://[^/?#]+') || '/x/' || page_id AS joined FROM pages""")
def url_clean(spark, sf):
    pages = V.texts(spark, sf, "pages", "page_id")
    return pages.select("page_id", T.url_without_query("url").alias("clean"), T.absolute_url(F.concat(F.lit("/x/"), "page_id"), T.url_origin("url")).alias("joined"))


_REPLY = """CASE doc_id % 5 WHEN 0 THEN '{"score": ' || (n_chars % 101) || ', "reason": "r' || doc_id || '", "summary": "s", "skills": ["a", "b' || lang || '"]}'
    WHEN 1 THEN '```json\n{"score": ' || (n_chars % 101) || '}\n```' WHEN 2 THEN '{"reason": "only"}' WHEN 3 THEN 'no answer' ELSE '{"score": "high"}' END"""


@query("model_reply_parse", """SELECT doc_id, CAST(CASE doc_id % 5 WHEN 0 THEN n_chars % 101 WHEN 1 THEN n_chars % 101 WHEN 2 THEN 50 END AS INT) AS score,
    CASE doc_id % 5 WHEN 0 THEN 'r' || doc_id WHEN 1 THEN '' WHEN 2 THEN 'only' END AS reason, CASE doc_id % 5 WHEN 0 THEN 's' WHEN 1 THEN '' WHEN 2 THEN '' END AS summary,
    CASE doc_id % 5 WHEN 0 THEN 'a,b' || lang ELSE '' END AS skills FROM documents""")
def model_reply_parse(spark, sf):
    out = V.texts(spark, sf, "documents", "doc_id").select("doc_id", F.expr(_REPLY.replace("\n{", "\\n{").replace("}\n", "}\\n")).alias("t")).select("doc_id", T.model_reply("t").alias("m"))
    return out.select("doc_id", "m.score", "m.reason", "m.summary", F.array_join("m.skills", ",").alias("skills"))


@query("skills_json", f"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE len(h) END AS n_back, '[' || array_to_string(list_transform(h, lambda x: '"' || x || '"'), ',') || ']' AS encoded
    FROM (SELECT doc_id, list_filter(['the', 'tion', 'go'], lambda t: contains(lower(text), t)) AS h FROM documents)""")
def skills_json(spark, sf):
    docs = V.texts(spark, sf, "documents", "doc_id").select("doc_id", T.term_list(F.lower("text"), ("the", "tion", "go")).alias("h"))
    docs = docs.select("doc_id", T.skills_to_json("h").alias("encoded"))
    broken = F.when(F.col("doc_id") % 7 == 0, F.lit("[oops")).otherwise(F.col("encoded"))
    return docs.select("doc_id", F.size(T.skills_from_json(broken)).cast("bigint").alias("n_back"), "encoded")


@query("prompt_column", O.with_(O.P, """SELECT id, md5('Rate how well this posting fits the reader.' || chr(10) || 'Title: ' || title || chr(10) || 'Company: ' || company
    || chr(10) || 'Location: ' || location || chr(10) || 'Type: ' || coalesce(job_type, '') || chr(10) || 'Salary: '
    || CASE WHEN salary IS NULL OR salary = 0 THEN 'not listed' ELSE '' || salary END || chr(10) || 'Description: ' || left(coalesce(description, ''), 800) || chr(10)
    || 'Answer with JSON only: {"score": 0-100, "reason": "", "summary": "", "skills": []}') AS prompt FROM p"""))
def prompt_column(spark, sf):
    return V.postings(spark, sf).select("id", F.md5(enrich.prompt_column()).alias("prompt"))


@query("post_prompt", """SELECT conv_id * 1000 + turn AS id, 'Extract the opening described in this post.' || chr(10) || 'Author: ' || role || ' ' || conv_id || chr(10) || 'Post: '
    || left(text || CASE turn % 3 WHEN 0 THEN ' We''re hiring! Email me: user' || conv_id || '@mail.example.com' WHEN 1 THEN ' Apply now #hiring' ELSE '' END, 1500) || chr(10)
    || 'Answer with JSON only: {"is_job_posting": true, "job_title": null, "company": null, "contact_name": null, "contact_email": null, "contact_linkedin": null, "role_category": null, "score": 0-100}' AS prompt FROM conversations""")
def post_prompt(spark, sf):
    return V.posts(spark, sf).select("id", enrich.post_prompt_column().alias("prompt"))


@query("letter_prompt", O.with_(O.P, """SELECT id, md5('Write a short letter for this application.' || chr(10) || 'Applicant: Ann, Data Engineer, 0 years' || chr(10) || 'Skills: s1, s2, s3, s4, s5, s6, s7, s8, s9, s10, s11, s12' || chr(10) || 'Summary: '
    || chr(10) || 'Title: ' || title || chr(10) || 'Company: ' || company || chr(10) || 'Location: ' || location || chr(10) || 'Description: ' || left(coalesce(description, ''), 600)) AS prompt FROM p"""))
def letter_prompt(spark, sf):
    skills = F.transform(F.sequence(F.lit(1), F.lit(13)), lambda i: F.concat(F.lit("s"), i.cast("string")))
    none = F.lit(None).cast("string")
    profile = F.struct(F.lit("Ann").alias("name"), none.alias("title"), F.lit(None).cast("int").alias("years_experience"), skills.alias("skills"), none.alias("summary"))
    return V.postings(spark, sf).withColumn("profile", profile).select("id", F.md5(enrich.letter_prompt_column()).alias("prompt"))


@query("freshness_gate", """WITH v AS (SELECT conv_id * 1000 + turn AS id, (conv_id + turn) % 8 AS k FROM conversations)
    SELECT id, k IN (0, 3, 5, 7) AS fresh, k IN (0, 3, 4, 5, 7) AS fresh_minutes FROM v""")
def freshness_gate(spark, sf):
    return V.posts(spark, sf).select("id", P.is_fresh_label("time_text").alias("fresh"), P.is_fresh_label("time_text", minutes_are_months=False).alias("fresh_minutes"))
