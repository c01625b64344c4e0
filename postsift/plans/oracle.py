"""The same results in DuckDB SQL: shared CTEs and helpers.

Written independently of the operators: plain SQL over the tables.
"""

from __future__ import annotations

from postsift import config as C
from postsift.plans.views import COMMENT, POST, POSTING

AS_OF = "TIMESTAMP '2001-08-01 06:00:00'"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(col: str, terms) -> str:
    return "(" + " OR ".join(f"contains({col}, {quote(t)})" for t in terms) + ")"


def count_of(col: str, terms) -> str:
    return "(" + " + ".join(f"contains({col}, {quote(t)})::INT" for t in terms) + ")"


_CELLS = ",\n".join(f"{e} AS {c}" for c, e in POSTING.items())
_POSTED = f"""CASE WHEN o_orderkey % 11 = 0 THEN NULL
  ELSE {AS_OF} - to_hours(CAST(floor(o_totalprice) AS BIGINT) % 120) END AS posted_date"""

P = f"""p AS (SELECT {_CELLS}, {_POSTED}
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN documents ON doc_id = o_orderkey % (SELECT max(doc_id) + 1 FROM documents))"""

_ROLE = "CASE " + " ".join(
    f"WHEN {any_of('lower(title)', terms)} THEN '{role}'"
    for role, terms in (*C.ROLE_PHRASES.items(), *C.ROLE_FALLBACKS)
) + f" ELSE '{C.DEFAULT_ROLE}' END"
_LT = "lower(title || ' ' || coalesce(description, ''))"
_STATED = "replace(lower(coalesce(job_type, '')), ' ', '_')"
_TYPE = f"CASE WHEN {_STATED} IN ({', '.join(quote(t) for t in C.JOB_TYPES)}) THEN {_STATED} " + " ".join(
    f"WHEN {any_of(_LT, terms)} THEN '{kind}'" for kind, terms in C.JOB_TYPE_PHRASES
) + f" ELSE '{C.DEFAULT_JOB_TYPE}' END"
_EXCLUDED = "CASE " + " ".join(f"WHEN contains({_LT}, {quote(t)}) THEN 'excluded keyword: ' || {quote(t)}" for t in C.EXCLUDED_TERMS) + " END"
_REASON = f"""coalesce(
  CASE WHEN salary < 80000 THEN 'salary ' || salary || ' < 80000' END,
  {_EXCLUDED},
  CASE WHEN posted_date < {AS_OF} - INTERVAL 48 HOUR THEN 'too old: ' || strftime(posted_date, '%Y-%m-%dT%H:%M:%S') || '+00:00' END,
  CASE WHEN TRY_CAST(applicants AS INT) > 200 THEN 'too many applicants: ' || applicants END)"""
_HOURS = f"(epoch({AS_OF}) - epoch(posted_date)) / 3600"
_N = "TRY_CAST(applicants AS INT)"
_PARTS = {
    "title": f"CASE WHEN {any_of('lower(title)', C.CORE_TITLE_TERMS)} THEN 20 WHEN {any_of('lower(title)', C.TECH_TITLE_TERMS)} THEN 10 ELSE 0 END",
    "keywords": f"least(15, 3 * {count_of('ld', C.DESCRIPTION_TERMS)})",
    "freshness": f"CASE WHEN {_HOURS} <= 12 THEN 25 WHEN {_HOURS} <= 24 THEN 20 WHEN {_HOURS} <= 48 THEN 10 WHEN {_HOURS} <= 72 THEN 5 ELSE 0 END",
    "applicants": f"CASE WHEN {_N} IS NULL THEN 10 WHEN {_N} < 25 THEN 20 WHEN {_N} < 50 THEN 15 WHEN {_N} < 100 THEN 10 ELSE 0 END",
    "easy_apply": "CASE WHEN easy_apply THEN 15 ELSE 0 END",
    "remote": "CASE WHEN lower(location) LIKE '%remote%' OR lower(location) LIKE '%hybrid%' THEN 10 ELSE 0 END",
    "salary": "CASE WHEN salary >= 150000 THEN 10 WHEN salary >= 100000 THEN 5 ELSE 0 END",
    "company": f"CASE WHEN {any_of('lower(company)', C.PREFERRED_COMPANIES)} THEN 15 ELSE 0 END",
}
# c: classified, s: scored
CLASS = f"{P}, c AS (SELECT * REPLACE ({_TYPE} AS job_type), {_ROLE} AS role_category FROM p)"
SCORED = f"""{CLASS}, s0 AS (SELECT *, lower(coalesce(description, '')) AS ld FROM c),
s1 AS (SELECT *, {', '.join(f'{e} AS pt_{n}' for n, e in _PARTS.items())} FROM s0),
s AS (SELECT *, CAST(least(100, {' + '.join(f'pt_{n}' for n in _PARTS)}) AS INT) AS score FROM s1)"""
REASON = _REASON
HOURS = _HOURS


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


_POST_CELLS = ",\n".join(f"{e} AS {c}" for c, e in POST.items())
RAW_POSTS = f"v AS (SELECT {_POST_CELLS} FROM conversations)"
# what the extraction keeps; the reply is known by construction (see the view)
SOCIAL = f"""{RAW_POSTS},
x0 AS (SELECT *, id // 1000 AS conv, 
   CASE WHEN reply IS NULL OR (id // 1000) % 4 = 0 THEN NULL WHEN (id // 1000) % 4 = 3 THEN false ELSE true END AS said,
   {any_of('lower(post_text)', C.POST_TRIGGERS)} AS looks,
   CASE WHEN author_profile_url LIKE '/in%' THEN 'https://www.linkedin.com' || author_profile_url ELSE author_profile_url END AS prof
  FROM v WHERE length(post_text) >= 50 AND time_text IN ('2d', '23h', '', '1d')),
x1 AS (SELECT * FROM x0 WHERE coalesce(said, looks)),
x2 AS (SELECT *, CASE WHEN post_url = '' THEN '' ELSE 'https://www.linkedin.com' || post_url END AS full_url FROM x1),
x3 AS (SELECT *, row_number() OVER (PARTITION BY full_url ORDER BY seq) AS rn FROM x2),
sp AS (SELECT seq, left(post_text, 2000) AS post_text, author_name, author_headline, prof AS author_profile_url,
   CASE WHEN conv % 4 = 1 THEN 'Data Engineer' ELSE '' END AS extracted_title,
   CASE WHEN conv % 4 = 1 THEN 'Acme_' || (conv % 7) ELSE '' END AS extracted_company,
   regexp_extract(post_text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9.-]+') AS contact_email,
   prof AS contact_linkedin, author_name AS contact_name, full_url AS post_url, {AS_OF} AS posted_date, true AS is_job_posting,
   CAST(CASE conv % 4 WHEN 0 THEN 40 WHEN 2 THEN 30 ELSE conv % 101 END AS INT) AS score, 'data_engineer' AS role_category
  FROM x3 WHERE rn = 1)"""

_PLAIN = "replace(replace(replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '&#x27;', ''''), '&#x2F;', '/'), '&amp;', '&')"
FORUM = f"""{P}, cm AS (SELECT id AS comment_id, {COMMENT.replace('o_orderkey', 'id')} AS text FROM p),
f0 AS (SELECT comment_id, trim({_PLAIN}, E' \\t\\n\\r') AS t FROM cm WHERE length(text) >= 80),
f AS (SELECT *, lower(t) AS l, string_split(t, '|') AS parts FROM f0
   WHERE {any_of('lower(t)', C.FORUM_RELEVANT_TERMS)} AND {any_of('lower(t)', C.FORUM_SIGNAL_TERMS)})"""
