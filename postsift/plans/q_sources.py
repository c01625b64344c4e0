"""Queries: feeds, tabular rows, RSS, HTML pages, forum and social text, profiles, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from postsift import config as C
from postsift.plans import oracle as O, views as V
from postsift.plans.registry import query
from postsift.session import new_path
from postsift.sources import feeds, html, prose, tabular
from postsift.streaming import ingest

# -- JSON feeds: what each payload has to turn into ---------------------------
_NOW = f"coalesce(posted_date, {O.AS_OF})"
_D500 = "left(coalesce(description, ''), 500)"
_NULL_INT, _NULL_BOOL, _NULL_TEXT = "CAST(NULL AS INT)", "CAST(NULL AS BOOLEAN)", "CAST(NULL AS VARCHAR)"
_MID = "CAST(trunc(CASE WHEN id % 2 = 0 THEN (2 * salary + 1001) / 2 ELSE salary END) AS INT)"
_LOC3 = "CASE WHEN id % 3 > 0 THEN location ELSE '{}' END"

# source: (location, salary, url, posted, easy_apply, applicants, description, job_type, key or '')
_EXPECT = {
    "Dice": ("CASE WHEN id % 2 = 0 THEN location WHEN id % 4 = 1 THEN 'Remote' ELSE '' END", "CAST((id % 90 + 20) * 2080 AS INT)", "url", _NOW,
             "coalesce(easy_apply, false)", _NULL_INT, _D500, _NULL_TEXT, ""),
    "Arbeitnow": (_LOC3.format("Remote"), _NULL_INT, "url || '?id=' || id", "coalesce(posted_date, TIMESTAMP '1970-01-01')", _NULL_BOOL, _NULL_INT,
                  f"trim({_D500} || ' x ' || source, E' \\n')", _NULL_TEXT, "url"),
    "Adzuna": ("location", _MID, "url", _NOW, _NULL_BOOL, _NULL_INT, _D500, _NULL_TEXT, ""),
    "Remotive": (_LOC3.format("Remote"), "CAST((id % 90 + 20) * 1000 * CASE WHEN id % 90 + 20 < 50 THEN 12 ELSE 1 END AS INT)", "url", _NOW,
                 "true", _NULL_INT, _D500, _NULL_TEXT, "url+"),
    "Himalayas": ("CASE id % 3 WHEN 0 THEN 'Remote' WHEN 1 THEN location ELSE location || ', Anywhere' END",
                  "CASE WHEN salary IS NULL THEN NULL WHEN id % 2 = 0 THEN CAST(trunc((2 * salary + 1001) / 2) AS INT) ELSE CAST(trunc(salary / 2) AS INT) END",
                  "url", _NOW, "true", _NULL_INT, _D500, _NULL_TEXT, "url+"),
    "Jobicy": (_LOC3.format("Remote"), "salary", "url", _NOW, "true", _NULL_INT, _D500, _NULL_TEXT, "url+"),
    "Jooble": (_LOC3.format("United States"), "CAST((id % 900 + 1100) * 52 AS INT)", "url",
               f"CASE WHEN id % 2 = 0 THEN {_NOW} ELSE {O.AS_OF} - to_days(CAST(id % 20 AS INT)) END", _NULL_BOOL, _NULL_INT, _D500, _NULL_TEXT, "url+"),
    "WorkingNomads": (_LOC3.format("Remote"), _NULL_INT, "url", _NOW, "true", _NULL_INT, _D500, _NULL_TEXT, "url+"),
    "USAJobs": (_LOC3.format("United States"), _MID, "url", _NOW, "false", _NULL_INT, _D500, "'full_time'", "url+"),
    "TheMuse": (_LOC3.format("United States"), _NULL_INT, "url", _NOW, _NULL_BOOL, _NULL_INT, _D500, _NULL_TEXT, "url+"),
    "RemoteOK": (_LOC3.format("Remote"), _MID, "CASE WHEN url <> '' THEN url ELSE 'https://remoteok.com/l/' || id END", _NOW, "true",
                 "CAST(id % 50 AS INT)", "'x ' || source", _NULL_TEXT, "url"),
}
_CANON = ("location", "salary", "url", "posted_date", "easy_apply", "applicants", "description", "job_type")


def _feed_sql(source: str) -> str:
    *cells, key = _EXPECT[source]
    out = ", ".join(f"{e} AS {c}" for e, c in zip(cells, _CANON))
    rank = "1" if not key else f"row_number() OVER (PARTITION BY {'url' if source == 'Arbeitnow' else 'o.url'} ORDER BY seq)"
    blank = "o.url <> ''" if key == "url+" else "true"
    base = f"SELECT *, {'url' if source == 'Arbeitnow' else 'url'} AS slug FROM p WHERE id % 23 <> 0 AND id % 97 <> 0"
    if source == "Arbeitnow":
        rank = "row_number() OVER (PARTITION BY o.slug ORDER BY o.seq)"
    return O.with_(
        f"{O.P}, b AS ({base}), o AS (SELECT seq, title, company, slug, {out} FROM b), r AS (SELECT o.*, {rank} AS rn FROM o WHERE {blank})",
        f"SELECT seq, '{source}' AS source, title, company, {', '.join(c for c in _CANON if c != 'description')}, md5(description) AS description FROM r WHERE rn = 1",
    )


def _feed(source: str):
    def run(spark, sf):
        rows = feeds.normalize_feed(V.feed_payloads(spark, sf, source), feeds.FEEDS[source], V.as_of())
        return rows.select("seq", "source", "title", "company", *[c for c in _CANON if c != "description"], F.md5("description").alias("description"))

    return run


for _source in feeds.FEEDS:
    query("feed_normalize" if _source == "Adzuna" else f"feed_{_source.lower()}", _feed_sql(_source))(_feed(_source))


@query("feed_quarantine", O.with_(O.P, "SELECT seq FROM p WHERE id % 97 = 0"))
def feed_quarantine(spark, sf):
    return feeds.quarantine(V.feed_payloads(spark, sf, "Adzuna"), feeds.FEEDS["Adzuna"]).select("seq")


# -- tabular and RSS ----------------------------------------------------------
_TAB = {
    "title": "CASE WHEN id % 23 = 0 THEN 'nan' WHEN id % 29 = 0 THEN NULL ELSE title END",
    "site": "CASE id % 4 WHEN 0 THEN 'zip_recruiter' WHEN 1 THEN 'LinkedIn' WHEN 2 THEN 'other' END",
    "company": "company", "location": "CASE WHEN id % 3 = 0 THEN 'nan' ELSE location END", "job_url": "url", "description": "description",
    "interval": "CASE id % 6 WHEN 0 THEN 'hourly' WHEN 1 THEN 'monthly' WHEN 2 THEN 'weekly' WHEN 3 THEN 'daily' WHEN 4 THEN 'per day' END",
    "min_amount": "CASE WHEN id % 5 = 0 THEN CAST('NaN' AS DOUBLE) WHEN id % 5 < 4 THEN CAST(id % 100 AS DOUBLE) + 0.5 END",
    "max_amount": "CASE WHEN id % 7 > 2 THEN CAST(id % 100 AS DOUBLE) + 20.25 END",
    "is_easy_apply": "easy_apply",
    "num_applicants": "CASE id % 3 WHEN 0 THEN 'Over ' || (id % 300) WHEN 1 THEN 'few' END",
}


@query("tabular_normalize", O.with_(
    f"{O.P}, t AS (SELECT seq, {', '.join(f'{e} AS {c}' for c, e in _TAB.items())}, posted_date, id FROM p),"
    """ u AS (SELECT *, CASE WHEN isnan(min_amount) THEN NULL ELSE min_amount END AS a FROM t), w AS (SELECT *, coalesce((a + max_amount) / 2, a, max_amount) AS m FROM u)""",
    f"""SELECT seq, trim(title) AS title, company, CASE WHEN location = 'nan' THEN '' ELSE location END AS location,
    CAST(trunc(m * CASE interval WHEN 'hourly' THEN 2080 WHEN 'monthly' THEN 12 WHEN 'weekly' THEN 52 WHEN 'per day' THEN 260 ELSE 1 END) AS INT) AS salary,
    job_url AS url, CASE id % 4 WHEN 0 THEN 'ZipRecruiter' WHEN 1 THEN 'LinkedIn' WHEN 2 THEN 'Other' ELSE 'JobSpy' END AS source, coalesce(posted_date, {O.AS_OF}) AS posted_date,
    is_easy_apply AS easy_apply, CASE WHEN id % 3 = 0 THEN CAST(id % 300 AS INT) END AS applicants, md5(left(trim(coalesce(description, ''), E' \\t\\n\\r'), 500)) AS description
    FROM w WHERE title <> 'nan'"""))
def tabular_normalize(spark, sf):
    raw = V.postings(spark, sf).select(
        "seq", *[F.expr(e).alias(c) for c, e in _TAB.items()],
        F.date_format("posted_date", "yyyy-MM-dd HH:mm:ss").alias("date_posted"))
    return tabular.normalize_tabular(raw, V.as_of()).withColumn("description", F.md5("description"))


@query("rss_normalize", O.with_(
    O.P,
    f"""SELECT seq, CASE WHEN id % 4 = 0 THEN title ELSE trim(title) END AS title, CASE WHEN id % 4 = 0 THEN '' ELSE company END AS company, 'Remote' AS location, {_NULL_INT} AS salary, url, 'feed' AS source,
    {_NOW} AS posted_date, true AS easy_apply, {_NULL_INT} AS applicants, md5({_D500}) AS description FROM p"""))
def rss_normalize(spark, sf):
    raw = V.postings(spark, sf).select(
        "seq", F.expr("CASE WHEN id % 4 = 0 THEN title ELSE company || ': ' || title END").alias("title"),
        F.col("url").alias("link"), F.expr("'Mon, ' || date_format(posted_date, 'dd MMM yyyy HH:mm:ss') || ' +0000'").alias("pubDate"), "description")
    out = tabular.normalize_rss(raw, V.as_of(), "feed", labelled_title=True)
    return out.withColumn("description", F.md5("description"))


# -- HTML ---------------------------------------------------------------------
_ORIGIN = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+')"


def _unescaped(c: str) -> str:
    return f"replace(replace({c}, '&quot;', '\"'), '&amp;', '&')"


@query("page_fields", f"""SELECT page_id, {_unescaped("trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1))")} AS title,
    {_unescaped("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")} AS ad,
    {_ORIGIN} || regexp_extract(html, '<a href=.(/[^">]*).', 1) AS link FROM pages""")
def page_fields(spark, sf):
    from postsift.functions.text import url_origin

    return V.texts(spark, sf, "pages", "page_id").select(
        "page_id", html.first_text("html", html.element("h2", "job-title"), html.element("h1")).alias("title"),
        html.first_text("html", html.element("div", "ad")).alias("ad"),
        html.first_link("html", url_origin("url"), html.attribute("a", "href")).alias("link"))


_LINKS = f"""SELECT page_id, CAST(i - 1 AS INT) AS position, {_ORIGIN} || links[i] AS link FROM
    (SELECT page_id, url, links, unnest(range(1, len(links) + 1)) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS links FROM pages))"""


@query("page_links", _LINKS)
def page_links(spark, sf):
    from postsift.functions.text import url_origin

    return html.page_links(V.texts(spark, sf, "pages", "page_id"), "page_id", "html", url_origin("url"))


@query("page_cards", f"""SELECT page_id, CAST(i - 1 AS INT) AS position, {_unescaped("titles[i]")} AS title, {_ORIGIN} || {_unescaped("links[i]")} AS link FROM
    (SELECT page_id, url, links, titles, unnest(range(1, len(links) + 1)) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<li><a href="([^"]*)"', 1) AS links,
      regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS titles FROM pages))""")
def page_cards(spark, sf):
    from postsift.functions.text import url_origin

    rules = html.CardRules(cards=("div.job-card", "nav li"), texts={"title": ("h2 a", "a")}, links={"link": ("h2 a", "a[href]")})
    return html.extract_cards(V.texts(spark, sf, "pages", "page_id"), rules, url_origin("url"))


# -- prose --------------------------------------------------------------------
_EMAIL = "[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+"  # fixed value


def _part(n: int, limit: int | None) -> str:
    v = f"coalesce(trim(parts[{n + 1}], E' \\t\\n\\r'), '')"
    return f"CASE WHEN length({v}) > {limit} THEN '' ELSE {v} END" if limit else v


@query("forum_extract", O.with_(O.FORUM, f"""SELECT comment_id, coalesce(nullif({_part(1, 80)}, ''), 'Software Engineer (Data/AI)') AS title,
    coalesce(nullif({_part(0, 60)}, ''), 'Unknown Company (HN)') AS company,
    coalesce(nullif(CASE WHEN regexp_matches(l, '\\bremote\\b') THEN 'Remote' ELSE {_part(2, None)} END, ''), 'USA') AS location,
    coalesce(nullif(regexp_replace(regexp_extract(t, 'https?://\\S+'), '[.,)>]+$', ''), ''), 'https://news.ycombinator.com/item?id=' || comment_id) AS url,
    md5(left(t, 3000)) AS description, CASE WHEN regexp_matches(l, '\\bcontract\\b|\\b1099\\b|\\bc2c\\b') THEN 'contract' WHEN regexp_matches(l, 'part.?time') THEN 'part_time' ELSE 'full_time' END AS job_type,
    regexp_extract(t, '{_EMAIL}') AS contact_email,
    coalesce(TRY_CAST(nullif(regexp_extract(t, '(?i)\\$([0-9]{{2,3}})k', 1), '') AS INT) * 1000, TRY_CAST(nullif(replace(regexp_extract(t, '\\$([0-9]{{3}},?[0-9]{{3}})', 1), ',', ''), '') AS INT)) AS salary FROM f"""))
def forum_extract(spark, sf):
    out = prose.extract_forum_posts(V.comments(spark, sf), "text", "comment_id", V.as_of())
    return out.drop("source", "posted_date", "easy_apply").withColumn("description", F.md5("description"))


def social(spark, sf):
    return prose.extract_social_posts(V.posts(spark, sf), V.as_of(), reply="reply", order_by=("seq",))


@query("social_extract", O.with_(O.SOCIAL, "SELECT * FROM sp"))
def social_extract(spark, sf):
    return social(spark, sf)


_SKILLS = f"[{', '.join(O.quote(s) for s in C.PROFILE_SKILLS)}]"


@query("profile_extract", f"""SELECT doc_id, '' AS name, regexp_extract(text, '{_EMAIL}') AS email, trim(regexp_extract(text, '[\\+]?[\\d\\s\\-\\(\\)]{{10,15}}'), E' \\t\\n\\r') AS phone,
    'Data Engineer' AS title, CAST(0 AS INT) AS years_experience, array_to_string(list_filter({_SKILLS}, lambda s: contains(lower(text), lower(s))), ',') AS skills FROM documents""")
def profile_extract(spark, sf):
    out = prose.extract_profiles(V.texts(spark, sf, "documents", "doc_id"), "doc_id", "text")
    return out.drop("companies", "education", "summary").withColumn("skills", F.array_join("skills", ","))


# -- streams ------------------------------------------------------------------
@query("events_6h_counts", """SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS run_start, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS run_end,
    event_type AS source, count(*) AS rows FROM events GROUP BY ALL""")
def events_6h_counts(spark, sf):
    return ingest.counts_per_run(V.table(spark, sf, "events"), "ts", "event_type")


def _event_stream(spark, sf):
    schema = V.table(spark, sf, "events").schema
    return ingest.read_files(spark, sf, schema, pathGlobFilter="events.parquet")


@query("stream_6h_counts", """WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS run_start, event_type AS source, count(*) AS rows FROM events GROUP BY ALL)
    SELECT run_start, run_start + INTERVAL 6 HOUR AS run_end, source, rows FROM w WHERE run_start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 48 HOUR FROM events)""")
def stream_6h_counts(spark, sf):
    """The same counts from a stream: a bucket appears once the watermark has passed its end."""
    sink = new_path(spark, "counts")
    counts = ingest.counts_per_run(_event_stream(spark, sf), "ts", "event_type", late=ingest.LATE)
    ingest.run_available(counts, new_path(spark, "counts-log"), sink=sink)
    return spark.read.parquet(sink)


@query("stream_dedup", "SELECT DISTINCT 'u/' || user_id AS url FROM events")
def stream_dedup(spark, sf):
    sink = new_path(spark, "first")
    keyed = _event_stream(spark, sf).select(F.concat(F.lit("u/"), F.col("user_id")).alias("url"), "ts")
    ingest.run_available(ingest.dedup_stream(keyed, "url", "ts").select("url"), new_path(spark, "first-log"), sink=sink)
    return spark.read.parquet(sink)


@query("stream_ingest", """SELECT 'e/' || user_id AS url, arg_min(event_type, event_id) AS title, CAST(arg_max(event_id, event_id) % 101 AS INT) AS score FROM events GROUP BY user_id""")
def stream_ingest(spark, sf):
    """Landed events as postings, upserted batch by batch into a versioned snapshot."""
    root = new_path(spark, "snapshots")
    rows = _event_stream(spark, sf).select(
        F.concat(F.lit("e/"), F.col("user_id")).alias("url"), F.col("event_type").alias("title"),
        (F.col("event_id") % 101).cast("int").alias("score"), F.col("event_id").alias("seq"))
    schema = spark.createDataFrame([], "id BIGINT, url STRING, title STRING, score INT, notified BOOLEAN, applied BOOLEAN").schema
    log = new_path(spark, "ingest-log")
    ingest.run_available(rows, log, batch=ingest.upsert_batches(root, schema, ("seq",), stream=log, buckets=8))
    return ingest.read_snapshot(spark, root, schema).select("url", "title", "score")


@query("alert_once", """SELECT 'e/' || user_id AS url, CAST(max(event_id % 101) AS INT) AS score FROM events WHERE event_id % 101 >= 50 GROUP BY user_id""")
def alert_once(spark, sf):
    """Alerts from a stream, each key once."""
    root, sink = new_path(spark, "alerts-state"), new_path(spark, "alerts")
    rows = _event_stream(spark, sf).select(F.concat(F.lit("e/"), F.col("user_id")).alias("url"), (F.col("event_id") % 101).cast("int").alias("score"))
    log = new_path(spark, "alerts-log")
    ingest.run_available(rows, log, batch=ingest.alert_once_batches(root, sink, stream=log))
    return spark.read.parquet(sink).select("url", "score")
